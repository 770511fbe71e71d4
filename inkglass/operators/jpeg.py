"""JPEG: marker walk, one table of segment kinds, findings, rewriting."""

from __future__ import annotations

from inkglass.functions import limits
from inkglass.operators import packets
from inkglass.operators.bytesio import Findings, Reader, utf8
from inkglass.operators.tiff import parse_exif

XMP = b"http://ns.adobe.com/xap/1.0/\0"
XMP_MORE = b"http://ns.adobe.com/xmp/extension/\0"
#: Fixed values, for report and rewrite alike: marker, prefix, kind, removal group (None: always kept).
KINDS = (
    (0xFE, b"", "comment", "comments"), (0xE0, b"JFIF\0", "jfif", None), (0xE0, b"JFXX\0", "jfxx", "other-segments"), (0xE1, b"Exif\0\0", "exif", "exif"), (0xE1, XMP, "xmp", "xmp"), (0xE1, XMP_MORE, "xmp-extension", "xmp"),
    (0xE2, b"ICC_PROFILE\0", "icc", None), (0xE2, b"MPF\0", "mpf", "other-segments"), (0xED, b"Photoshop 3.0\0", "photoshop", "iptc"), (0xEE, b"Adobe", "adobe", None),
)


def classify(marker: int, payload: bytes) -> tuple[str, str | None]:
    for m, prefix, kind, group in KINDS:
        if m == marker and payload.startswith(prefix):
            return kind, group
    return ("app-other", "other-segments") if 0xE0 <= marker <= 0xEF else ("structure", None)


def is_frame(marker: int) -> bool:
    return 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC)


class Scan:
    """Segments (marker, offset, length, kind, group) and the walk's verdicts."""

    def __init__(self, data: bytes):
        self.data, self.segments = data, []
        self.end = self.invalid = self.size = self.components = None
        self.truncated = self.limit = self.late_height = self.progressive = False
        self.frames = self.scans = 0
        if data[:2] != b"\xff\xd8" or len(data) < 4:
            self.invalid = "there is no start marker"
        else:
            self.walk()

    def walk(self) -> None:
        d, n, at, in_scan = self.data, len(self.data), 2, False
        while at < n:
            if in_scan:
                at = d.find(b"\xff", at)
                if at < 0:
                    break
            if d[at] != 0xFF:
                self.invalid = "a marker is missing"
                return
            while at + 1 < n and d[at + 1] == 0xFF:
                at += 1
            if at + 1 >= n:
                break
            m = d[at + 1]
            if m == 0 or 0xD0 <= m <= 0xD7:
                if not in_scan:
                    self.invalid = "a stuffed byte stands outside image data" if m == 0 else "a restart marker stands outside image data"
                    return
                at += 2
                continue
            in_scan = False
            if m == 0xD9:
                self.end = at + 2
                return
            if m == 0x01:
                at += 2
                continue
            if m == 0xD8:
                self.invalid = "there is a second start marker"
                return
            if at + 4 > n:
                break
            size = int.from_bytes(d[at + 2 : at + 4])
            if size < 2:
                self.invalid = "a segment's length is less than two"
                return
            if at + 2 + size > n:
                break
            if len(self.segments) >= limits.JPEG_SEGMENTS:
                self.limit = True
                return
            kind, group = classify(m, d[at + 4 : at + 44])
            self.segments.append({"marker": m, "offset": at, "length": 2 + size, "after_sos": self.scans > 0, "kind": kind, "grp": group})
            if is_frame(m):
                self.frame(m, d[at + 4 : at + 2 + size])
            if m == 0xDA:
                self.scans, in_scan = self.scans + 1, True
            at += 2 + size
        self.truncated = True

    def frame(self, marker: int, p: bytes) -> None:
        self.frames += 1
        if self.frames == 1 and len(p) >= 6:
            h, w = int.from_bytes(p[1:3]), int.from_bytes(p[3:5])
            self.components, self.progressive, self.late_height = p[5], marker in (0xC2, 0xC6, 0xCA, 0xCE), h == 0
            if w and h:
                self.size = (w, h)

    @property
    def unsound(self) -> bool:
        return self.truncated or self.invalid is not None or self.limit or self.end is None or not self.frames or not self.scans

    def payload(self, s: dict) -> bytes:
        return self.data[s["offset"] + 4 : s["offset"] + s["length"]]


def size_refusal(size: tuple[int, int] | None) -> str | None:
    if size and (max(size) > limits.DECODE_EDGE or size[0] * size[1] > limits.DECODE_PIXELS):
        return "the picture is too large"
    return None


def refusal(scan: Scan) -> str | None:
    if scan.unsound:
        return "the structure is damaged or incomplete"
    if scan.frames > 1:
        return "there is more than one frame header"
    if scan.late_height or not scan.size:
        return "the height is not in the frame header"
    return size_refusal(scan.size)


def trailing_kind(data: bytes, at: int) -> str:
    if len(data) - at < 4:
        return ""
    for sign, what in ((b"\xff\xd8\xff", "a JPEG image"), (b"\x89PNG", "a PNG image"), (b"PK\3\4", "a ZIP archive"), (b"%PDF", "a PDF document")):
        if data.startswith(sign, at):
            return f", beginning like {what}"
    return ", of an unknown kind"


def app_name(payload: bytes) -> str:
    return "".join(chr(b) if 0x20 <= b < 0x7F else "�" for b in payload[:24].split(b"\0")[0])


def inspect(data: bytes, sink: Findings) -> dict:
    """Findings of a JPEG; returns its report's fields."""
    scan, orientation = Scan(data), None
    n_exif = n_xmp = 0
    icc, icc_bytes, extended = [], 0, []
    for s in scan.segments:
        at, p = (s["offset"], s["length"]), scan.payload(s)
        base, name, kind = s["offset"] + 4, f"JPEG APP{s['marker'] - 0xE0}", s["kind"]
        if kind == "jfif" and len(p) >= 14:
            r = Reader(p)
            sink.add("jpeg.jfif", f"{name} (JFIF)", f"version {p[5]}.{p[6]:02d}, density {r.u16(8)} x {r.u16(10)}" + {1: " per inch", 2: " per cm"}.get(p[7], ""), at)
            if p[12] * p[13]:
                sink.add("jpeg.jfif-thumbnail", f"{name} (JFIF)", f"{p[12]} x {p[13]} pixels", at)
        elif kind == "jfif":
            sink.add("jpeg.jfif", f"{name} (JFIF)", "too short", at, status="suspicious")
        elif kind == "jfxx":
            sink.add("jpeg.jfif-thumbnail", f"{name} (JFXX)", f"{len(p)} bytes", at)
        elif kind == "exif":
            n_exif += 1
            if n_exif > 1:
                sink.add("jpeg.duplicate", f"{name} (EXIF)", "another EXIF segment; only the first is described", at, status="suspicious", grp="exif")
            else:
                orientation = parse_exif(p[6:], base + 6, sink, "JPEG EXIF")
        elif kind == "xmp":
            n_xmp += 1
            packets.parse_xmp(p[len(XMP) :], sink, "JPEG XMP", at)
            if n_xmp > 1:
                sink.add("jpeg.duplicate", f"{name} (XMP)", "another XMP packet", at, status="suspicious", grp="xmp")
        elif kind == "xmp-extension":
            extended.append(at)
        elif kind == "icc":
            if icc_bytes + len(p) <= limits.ICC_BYTES and len(p) >= 14:
                icc.append((p[12], p[13], p[14:], s["offset"]))
                icc_bytes += len(p)
        elif kind == "mpf":
            sink.add("jpeg.mpf", f"{name} (MPF)", f"{len(p)} bytes", at)
        elif kind == "photoshop":
            packets.parse_photoshop(p[14:], base + 14, sink, "JPEG Photoshop block")
        elif kind == "adobe":
            sink.add("jpeg.adobe", f"{name} (Adobe)", f"colour transform {p[11]}" if len(p) >= 12 else "too short", at)
        elif kind == "app-other":
            sink.add("jpeg.app-unknown", name, f"{app_name(p) or 'without a name'}, {len(p)} bytes", at, status="unsupported")
        elif kind == "comment":
            sink.add("jpeg.comment", "JPEG comment", utf8(p.rstrip(b"\0")), at)
    if extended:
        sink.add("xmp.extended", "JPEG extended XMP", f"{len(extended)} segments, {sum(n for _, n in extended)} bytes", extended[0], status="unsupported")
    if icc:
        icc.sort(key=lambda x: x[0])
        whole = len(icc) == icc[0][1] and [x[0] for x in icc] == list(range(1, len(icc) + 1))
        head = packets.icc_header(b"".join(x[2] for x in icc) if whole else icc[0][2])
        at = (icc[0][3], sum(len(x[2]) for x in icc))
        if head:
            sink.add("icc.profile", "JPEG ICC profile", packets.icc_text(head), at, status="verified" if whole else "inferred", confidence="high" if whole else "medium")
        else:
            sink.add("icc.profile", "JPEG ICC profile", "the header could not be read", at, status="suspicious", confidence="medium")
    if scan.end is not None and scan.end < len(data):
        sink.add("jpeg.trailing-data", "after the end marker", f"{len(data) - scan.end} bytes{trailing_kind(data, scan.end)}", (scan.end, len(data) - scan.end), status="suspicious")
    if scan.truncated:
        sink.add("jpeg.truncated", "JPEG marker walk", status="suspicious")
    if scan.invalid:
        sink.add("jpeg.invalid-segment", "JPEG marker walk", scan.invalid, status="suspicious")
    if scan.limit:
        sink.add("jpeg.limit", "JPEG marker walk", f"more than {limits.JPEG_SEGMENTS} segments", status="unsupported")
    if scan.frames > 1:
        sink.add("jpeg.duplicate", "JPEG marker walk", f"{scan.frames} frame headers", status="suspicious")
    if scan.size:
        sink.add("image.dimensions", "JPEG frame header", f"{scan.size[0]} × {scan.size[1]} pixels" + ", progressive" * scan.progressive)
    if size_refusal(scan.size):
        sink.add("image.extreme-dimensions", "JPEG frame header", f"{scan.size[0]} × {scan.size[1]} pixels", status="suspicious")
    sink.cover("JPEG structure", "partial" if scan.limit or scan.invalid or scan.truncated else "inspected")
    sink.cover("EXIF", "partial" if n_exif else "inspected")
    sink.cover("XMP", "partial" if n_xmp or extended else "inspected", "every packet is itemised; extended XMP is not put together")
    for area, state in (("Photoshop blocks with IPTC", "partial"), ("Colour profile", "partial"), ("Image content", "not-inspected"), ("Data hidden in pixels", "not-inspected")):
        sink.cover(area, state)
    return {"width": scan.size and scan.size[0], "height": scan.size and scan.size[1], "orientation": orientation, "structurally_unsound": scan.unsound, "copy_refusal": refusal(scan)}


def orientation_block(value: int) -> bytes:
    """A TIFF block with the orientation only."""
    return b"MM\0\x2a\0\0\0\x08" + b"\0\x01" + b"\x01\x12\0\x03\0\0\0\x01" + bytes([0, value, 0, 0]) + b"\0\0\0\0"


def segment(marker: int, payload: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(payload) + 2).to_bytes(2) + payload


def rewrite(data: bytes, groups: set[str], orientation: int | None) -> tuple[bytes, list[dict]]:
    """A copy without the groups, and its manifest: action (keep, remove, rewrite-from, rewrite-to), what, grp, offset, bytes."""
    scan = Scan(data)
    out, manifest, at, turned = [], [], 0, False

    def note(action: str, what: str, group, offset: int, size: int) -> None:
        manifest.append({"action": action, "what": what, "grp": group, "offset": offset, "bytes": size})

    def put(s: dict, new: bytes | None) -> None:
        nonlocal at
        out.append(data[at : s["offset"]])
        at = s["offset"] + s["length"]
        if new is None:
            note("remove", s["kind"], s["grp"], s["offset"], s["length"])
        else:
            out.append(new)
            note("rewrite-from", s["kind"], s["grp"], s["offset"], s["length"])
            note("rewrite-to", s["kind"], s["grp"], s["offset"], len(new))

    for s in scan.segments:
        p = scan.payload(s)
        if s["grp"] and s["grp"] in groups:
            turn = s["kind"] == "exif" and not turned and orientation not in (None, 1)
            turned = turned or turn
            put(s, segment(0xE1, b"Exif\0\0" + orientation_block(orientation)) if turn else None)
        elif s["kind"] == "jfif" and "other-segments" in groups and len(p) > 14 and p[12] * p[13]:
            put(s, segment(0xE0, p[:12] + b"\0\0"))
        elif s["grp"] or s["kind"] in ("icc", "adobe", "jfif"):
            note("keep", s["kind"], s["grp"], s["offset"], s["length"])
    if scan.end is not None and scan.end < len(data):
        tail = {"offset": scan.end, "length": len(data) - scan.end, "kind": "trailer", "grp": "trailer"}
        if "trailer" in groups:
            if "other-segments" not in groups and any(s["kind"] == "mpf" for s in scan.segments):
                note("keep", "mpf index of pictures that were removed", "other-segments", 0, 0)
            put(tail, None)
        else:
            note("keep", "trailer", "trailer", tail["offset"], tail["length"])
    return b"".join([*out, data[at:]]), manifest


def core(data: bytes) -> bytes:
    """Everything but application segments, comments and the trailer."""
    scan, out, at = Scan(data), [], 0
    for s in scan.segments:
        if 0xE0 <= s["marker"] <= 0xEF or s["marker"] == 0xFE:
            out.append(data[at : s["offset"]])
            at = s["offset"] + s["length"]
    return b"".join([*out, data[at : scan.end if scan.end is not None else len(data)]])


def display(data: bytes) -> bytes:
    return b"".join(data[s["offset"] : s["offset"] + s["length"]] for s in Scan(data).segments if s["kind"] in ("icc", "adobe"))
