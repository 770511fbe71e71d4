"""PNG: chunk walk, one table of chunk kinds, findings, rewriting. Order rules are in png_rules."""

from __future__ import annotations

import zlib

from inkglass.functions import limits
from inkglass.operators import packets
from inkglass.operators.bytesio import Findings, Reader, inflate, latin1, utf8
from inkglass.operators.jpeg import orientation_block, size_refusal, trailing_kind
from inkglass.operators.tiff import half_up, parse_exif

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Fixed values.
CRITICAL = ("IHDR", "PLTE", "IDAT", "IEND")
RENDER = ("tRNS", "gAMA", "cHRM", "sRGB", "iCCP", "sBIT", "bKGD", "hIST", "pHYs", "sPLT", "cICP", "mDCV", "cLLI", "acTL", "fcTL", "fdAT")
GROUPS = {"tEXt": "png-text", "zTXt": "png-text", "iTXt": "png-text", "eXIf": "png-exif", "tIME": "png-time"}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
SINGLE = ("cHRM", "gAMA", "iCCP", "sBIT", "sRGB", "cICP", "mDCV", "cLLI", "bKGD", "hIST", "tRNS", "pHYs", "tIME", "eXIf", "PLTE", "IHDR", "acTL")
COLOUR = ("cHRM", "gAMA", "iCCP", "sBIT", "sRGB", "cICP", "mDCV", "cLLI")
PRIVATE = {"caBX": "a name used for content credentials", "iDOT": "a name used to speed up decoding"}
TEXT_CODES = {"author": "png.text-author", "artist": "png.text-author", "copyright": "png.text-author", "software": "png.text-software", "creation time": "png.text-time"}


def classify(name: str) -> tuple[str, str | None]:
    """Kind and removal group (None: always kept)."""
    if name in CRITICAL:
        return "critical", None
    if name in RENDER:
        return "render", None
    if name in GROUPS:
        return {"png-text": "text", "png-exif": "exif", "png-time": "time"}[GROUPS[name]], GROUPS[name]
    return ("unknown-ancillary", "png-unknown") if name[:1] >= "a" else ("unknown-critical", None)


class Scan:
    def __init__(self, data: bytes):
        self.data, self.chunks = data, []
        self.end = self.invalid = None
        self.truncated = self.limit = False
        if not data.startswith(SIGNATURE):
            self.invalid = "the signature is missing"
            return
        at, n = 8, len(data)
        while True:
            if at + 12 > n:
                self.truncated = True
                return
            size, raw = int.from_bytes(data[at : at + 4]), data[at + 4 : at + 8]
            if size > 0x7FFFFFFF or not (raw.isalpha() and raw.isascii()):
                self.invalid = "a chunk's length or type is not valid"
                return
            if at + 12 + size > n:
                self.truncated = True
                return
            if len(self.chunks) >= limits.PNG_CHUNKS:
                self.limit = True
                return
            name = raw.decode()
            kind, group = classify(name)
            fine = zlib.crc32(memoryview(data)[at + 4 : at + 8 + size]) == int.from_bytes(data[at + 8 + size : at + 12 + size])
            self.chunks.append({"type": name, "offset": at, "length": size, "total": size + 12, "crc_ok": fine, "kind": kind, "grp": group})
            at += size + 12
            if name == "IEND":
                self.end = at
                return

    def body(self, c: dict) -> bytes:
        return self.data[c["offset"] + 8 : c["offset"] + 8 + c["length"]]


def head_fault(scan: Scan) -> str | None:
    """What is wrong with the first chunk, if anything."""
    if not scan.chunks:
        return "there is no chunk"
    if scan.chunks[0]["type"] != "IHDR":
        return "the first chunk is not IHDR"
    head = scan.body(scan.chunks[0])
    if len(head) != 13:
        return f"IHDR has {len(head)} bytes"
    width, height = int.from_bytes(head[:4]), int.from_bytes(head[4:8])
    depth, colour, packing, filtering, lacing = head[8:13]
    if not (0 < width < 1 << 31 and 0 < height < 1 << 31):
        return "IHDR has no usable size"
    if depth not in DEPTHS.get(colour, ()) or packing or filtering or lacing > 1:
        return "IHDR combines values that don't go together"
    return None


def rules(scan: Scan) -> tuple[list[str], bool]:
    """Broken rules, and whether one is fatal: png_rules over this file's chunks, and what IHDR says."""
    out: list[tuple[str, bool]] = []
    if fault := head_fault(scan):
        out.append((fault, True))
    names = [c["type"] for c in scan.chunks]
    data = [k for k, name in enumerate(names) if name == "IDAT"]
    start, palette = (data[0] if data else len(names)), (names.index("PLTE") if "PLTE" in names else len(names))
    left = next((k for k in range(start, len(names)) if names[k] not in ("IDAT", "fdAT")), len(names))
    seen: set[str] = set()
    for k, name in enumerate(names):
        if name in SINGLE and name in seen and len(out) < 30:
            out.append((f"{name} stands there again", name in ("IHDR", "PLTE")))
        if name == "IDAT" and k > left:
            out.append(("other chunks stand between IDAT chunks", True))
        if name == "PLTE" and k > start:
            out.append(("the palette follows image data", True))
        if name in COLOUR and k > min(start, palette) and len(out) < 30:
            out.append((f"{name} stands late", False))
        if name == "IEND" and scan.chunks[k]["length"]:
            out.append(("IEND is not empty", False))
        seen.add(name)
    if not data and scan.end is not None:
        out.append(("there is no image data", True))
    if {"iCCP", "sRGB"} <= seen:
        out.append(("there are two colour profiles", False))
    return [x for x, _ in out], any(f for _, f in out)


def inspect(data: bytes, sink: Findings) -> dict:
    """Findings of a PNG; returns its report's fields."""
    scan, orientation, budget, exhausted, bad_text = Scan(data), None, limits.INFLATE_FILE, False, 0

    def opened(raw: bytes, most: int) -> tuple[str, bool] | None:
        nonlocal budget, exhausted
        if budget <= 0:
            exhausted = True
            return None
        out, cut, error = inflate(raw, min(most, budget))
        budget -= len(out)
        return None if error and not out else (out, cut)

    bad_crc, render = 0, []
    for c in scan.chunks:
        at, p, name = (c["offset"], c["total"]), scan.body(c), c["type"]
        source = f"PNG {name}"
        if not c["crc_ok"]:
            bad_crc += 1
            if bad_crc <= 20:
                sink.add("png.crc-invalid", source, "the checksum is wrong", at, status="suspicious", grp="-")
        if name in ("tEXt", "zTXt", "iTXt"):
            cut = p.find(b"\0")
            if not 1 <= cut <= 79:
                bad_text += 1
                continue
            key, rest, more = latin1(p[:cut]), p[cut + 1 :], ""
            if name == "tEXt":
                value = latin1(rest)
            elif name == "zTXt":
                found = opened(rest[1:], limits.INFLATE_CHUNK) if rest[:1] == b"\0" else None
                value, more = (latin1(found[0]), " (cut)" * found[1]) if found else (None, "")
            else:
                parts = rest[2:].split(b"\0", 2)
                if len(parts) < 3:
                    bad_text += 1
                    continue
                xmp = key == "XML:com.adobe.xmp"
                body = parts[2]
                if rest[0] == 1:
                    found = opened(body, limits.XMP_BYTES if xmp else limits.INFLATE_CHUNK)
                    body = found[0] if found else None
                if xmp and body is not None:
                    packets.parse_xmp(body, sink, "PNG XMP", at, "png-text")
                    continue
                value = None if body is None else utf8(body)
            sink.add(TEXT_CODES.get(key.strip().lower(), "png.text"), f"{source} {key}", None if value is None else f"{key}: {value}{more}", at, **({} if value is not None else {"status": "unsupported"}))
        elif name == "eXIf":
            found = parse_exif(p, c["offset"] + 8, sink, "PNG EXIF", "png-exif")
            orientation = found if orientation is None else orientation
        elif name == "tIME":
            fine = len(p) == 7 and 1 <= p[2] <= 12 and 1 <= p[3] <= 31 and p[4] <= 23 and p[5] <= 59 and p[6] <= 60
            value = f"{int.from_bytes(p[:2])}-{p[2]:02d}-{p[3]:02d} {p[4]:02d}:{p[5]:02d}:{p[6]:02d} UTC" if fine else "not a valid time"
            sink.add("png.time", source, value, at, status="verified" if fine else "suspicious")
        elif name == "pHYs":
            if len(p) == 9:
                x, y = int.from_bytes(p[:4]), int.from_bytes(p[4:8])
                sink.add("png.phys", source, f"{half_up(x * 0.0254, 0):.0f} x {half_up(y * 0.0254, 0):.0f} dots per inch" if p[8] == 1 else f"{x} : {y}", at)
            else:
                sink.add("png.phys", source, "not of the right size", at, status="suspicious")
        elif name == "iCCP":
            cut = p.find(b"\0")
            found = opened(p[cut + 2 :], limits.INFLATE_CHUNK) if 1 <= cut <= 79 else None
            head = packets.icc_header(found[0]) if found else None
            sink.add("icc.profile", source, packets.icc_text(head) if head else "the header could not be read", at, status="verified" if head else "suspicious")
        elif name == "acTL":
            sink.add("png.apng", source, f"{Reader(p).u32(0)} frames" if len(p) >= 4 else "too short", at)
        elif name in PRIVATE:
            sink.add("png.known-private", source, PRIVATE[name], at, status="inferred")
        elif c["kind"].startswith("unknown"):
            kept = {"transformation": "preserved", "grp": "-"} if c["kind"] == "unknown-critical" else {}
            sink.add("png.unknown-chunk", source, f"{name}, {c['length']} bytes", at, status="unsupported", **kept)
        elif c["kind"] == "render" and name not in render:
            render.append(name)
    if render:
        sink.add("png.render-chunk", "PNG chunks", ", ".join(render))
    if bad_text:
        sink.add("png.text-malformed", "PNG text", f"{bad_text} entries", status="unsupported")
    if bad_crc > 20:
        sink.add("png.crc-invalid", "PNG chunks", f"{bad_crc} checksums are wrong", status="suspicious", grp="-")
    if scan.end is not None and scan.end < len(data):
        sink.add("png.trailing-data", "after IEND", f"{len(data) - scan.end} bytes{trailing_kind(data, scan.end)}", (scan.end, len(data) - scan.end), status="suspicious")
    if scan.truncated:
        sink.add("png.truncated", "PNG chunk walk", status="suspicious")
    if scan.invalid:
        sink.add("png.invalid", "PNG chunk walk", scan.invalid, status="suspicious")
    if scan.limit or exhausted:
        sink.add("png.limit", "PNG chunk walk", "too many chunks" if scan.limit else "too much compressed text", status="unsupported")
    issues, fatal = rules(scan)
    for issue in issues[:20]:
        sink.add("png.order", "PNG chunk rules", issue, status="suspicious")
    head = scan.body(scan.chunks[0]) if scan.chunks and scan.chunks[0]["type"] == "IHDR" else b""
    size = (int.from_bytes(head[:4]), int.from_bytes(head[4:8])) if len(head) == 13 else None
    size = size if size and all(size) else None
    if size:
        sink.add("image.dimensions", "PNG IHDR", f"{size[0]} × {size[1]} pixels")
    if size_refusal(size):
        sink.add("image.extreme-dimensions", "PNG IHDR", f"{size[0]} × {size[1]} pixels", status="suspicious")
    unsound = scan.truncated or scan.invalid is not None or scan.limit or scan.end is None or fatal or size is None or any(not c["crc_ok"] and c["kind"] == "critical" for c in scan.chunks) or any(c["kind"] == "unknown-critical" for c in scan.chunks)
    for area, state in (("Chunks", "partial" if scan.limit or scan.invalid or scan.truncated else "inspected"), ("Text and XMP", "partial" if exhausted or bad_text else "inspected"), ("EXIF", "partial" if any(c["type"] == "eXIf" for c in scan.chunks) else "inspected"), ("Colour profile", "partial"), ("Image content", "not-inspected"), ("Data hidden in pixels", "not-inspected")):
        sink.cover(area, state)
    return {"width": size and size[0], "height": size and size[1], "orientation": orientation, "structurally_unsound": bool(unsound), "copy_refusal": "the structure is damaged or incomplete" if unsound else size_refusal(size)}


def chunk(name: bytes, body: bytes) -> bytes:
    return len(body).to_bytes(4) + name + body + zlib.crc32(name + body).to_bytes(4)


def rewrite(data: bytes, groups: set[str], orientation: int | None) -> tuple[bytes, list[dict]]:
    scan, out, manifest, turned = Scan(data), [SIGNATURE], [], False
    for c in scan.chunks:
        whole = data[c["offset"] : c["offset"] + c["total"]]
        row = {"what": c["type"], "grp": c["grp"], "offset": c["offset"]}
        if c["grp"] and c["grp"] in groups:
            if c["type"] == "eXIf" and not turned and orientation not in (None, 1):
                turned, new = True, chunk(b"eXIf", orientation_block(orientation))
                out.append(new)
                manifest += [row | {"action": "rewrite-from", "bytes": len(whole)}, row | {"action": "rewrite-to", "bytes": len(new)}]
            else:
                manifest.append(row | {"action": "remove", "bytes": len(whole)})
            continue
        out.append(whole)
        if c["grp"] or c["kind"] == "render":
            manifest.append(row | {"action": "keep", "bytes": len(whole)})
    if scan.end is not None and scan.end < len(data):
        gone = "trailer" in groups
        manifest.append({"what": "trailer", "grp": "trailer", "offset": scan.end, "action": "remove" if gone else "keep", "bytes": len(data) - scan.end})
        out += [] if gone else [data[scan.end :]]
    return b"".join(out), manifest


def core(data: bytes) -> bytes:
    scan = Scan(data)
    return b"".join(data[c["offset"] : c["offset"] + c["total"]] for c in scan.chunks if c["grp"] is None)


def display(data: bytes) -> bytes:
    scan = Scan(data)
    return b"".join(data[c["offset"] : c["offset"] + c["total"]] for c in scan.chunks if c["kind"] == "render")
