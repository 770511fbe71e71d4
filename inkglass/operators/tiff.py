"""EXIF: a bounded walk over TIFF directories, to findings."""

from __future__ import annotations

import math
import re
from collections import deque

from inkglass.functions import limits
from inkglass.operators.bytesio import Findings, LimitError, Reader, utf8

#: Bytes of each TIFF type.
SIZES = (0, 1, 1, 2, 4, 8, 1, 1, 2, 4, 8, 4, 8)
#: Text tags by directory.
IFD0 = {0x010F: "exif.make", 0x0110: "exif.model", 0x0131: "exif.software", 0x0132: "exif.datetime", 0x013B: "exif.artist", 0x8298: "exif.copyright", 0x010E: "exif.description"}
EXIF = {0x9003: "exif.datetime-original", 0x9004: "exif.datetime-digitized", 0x9010: "exif.timezone-offset", 0x9011: "exif.timezone-offset", 0x9012: "exif.timezone-offset", 0xA433: "exif.lens", 0xA434: "exif.lens", 0xA431: "exif.serial", 0xA435: "exif.serial", 0xA430: "exif.owner", 0xA420: "exif.unique-id"}
XP = {0x9C9B: ("title", "document-properties"), 0x9C9C: ("comment", "document-properties"), 0x9C9D: ("author", "identity"), 0x9C9E: ("keywords", "document-properties"), 0x9C9F: ("subject", "document-properties")}
POINTERS = {0x8769: "exif", 0x8825: "gps", 0xA005: "interop"}
CHARSETS = {b"ASCII\0\0\0": "ascii", b"UNICODE\0": "utf-16", b"JIS\0\0\0\0\0": "jis"}
GPS_NAMES = {0x07: "time", 0x08: "satellites", 0x09: "status", 0x0A: "measure mode", 0x0B: "precision", 0x0C: "speed unit", 0x0D: "speed", 0x10: "direction reference", 0x11: "direction", 0x12: "datum", 0x1B: "method", 0x1C: "area", 0x1D: "date", 0x1F: "position error"}


def half_up(x: float, digits: int) -> float:
    return math.floor(x * 10**digits + 0.5) / 10**digits


class Tiff:
    """Entries of a TIFF block; bad places make it malformed, not an error."""

    def __init__(self, data: bytes):
        self.reader = Reader(data, data[:2] == b"II")
        self.entries: list[dict] = []
        self.malformed: list[str] = []
        self.skipped = 0
        self.ok = data[:2] in (b"II", b"MM") and len(data) >= 8 and self.reader.u16(2) == 42
        if self.ok:
            self.walk()

    def walk(self) -> None:
        r, seen, n = self.reader, set(), 0
        queue = deque([(r.u32(4), "ifd0")])
        while queue:
            at, kind = queue.popleft()
            if at == 0:
                continue
            if at in seen or len(seen) >= limits.IFDS:
                self.malformed.append("a directory refers to itself" if at in seen else "too many directories")
                continue
            seen.add(at)
            try:
                count = r.u16(at)
            except LimitError:
                self.malformed.append("a directory lies outside the block")
                continue
            for k in range(count):
                place = at + 2 + 12 * k
                if not r.has(place, 12):
                    self.malformed.append("a directory is cut off")
                    break
                if n >= limits.IFD_ENTRIES:
                    self.malformed.append("too many entries")
                    break
                n += 1
                tag, type_, number = r.u16(place), r.u16(place + 2), r.u32(place + 4)
                size = (SIZES[type_] if type_ < len(SIZES) else 0) * number
                value = place + 8 if size <= 4 else r.u32(place + 8)
                if size == 0 or size > limits.TAG_BYTES or not r.has(value, size):
                    if tag not in POINTERS:
                        self.malformed.append(f"the value of tag {tag:04X} lies outside the block")
                        continue
                entry = {"ifd": kind, "tag": tag, "type": type_, "count": number, "at": value, "size": size, "place": place}
                self.entries.append(entry)
                if tag in POINTERS and (longs := self.longs(entry)):
                    queue.append((longs[0], POINTERS[tag]))
            else:
                nxt = at + 2 + 12 * count
                if kind in ("ifd0",) and r.has(nxt, 4):
                    queue.append((r.u32(nxt), "ifd1"))

    def raw(self, e: dict) -> bytes:
        return self.reader.take(e["at"], e["size"])

    def text(self, e: dict) -> str | None:
        if e["type"] not in (1, 2, 7):
            return None
        return utf8(self.raw(e).split(b"\0")[0]).strip() or None

    def longs(self, e: dict) -> list[int]:
        if e["type"] not in (3, 4) or not self.reader.has(e["at"], e["size"]):
            return []
        step, read = (2, self.reader.u16) if e["type"] == 3 else (4, self.reader.u32)
        return [read(e["at"] + step * k) for k in range(min(e["count"], 64))]

    def rationals(self, e: dict) -> list[float | None]:
        if e["type"] not in (5, 10):
            return []
        read = self.reader.u32 if e["type"] == 5 else self.reader.i32
        pairs = [(read(e["at"] + 8 * k), read(e["at"] + 8 * k + 4)) for k in range(min(e["count"], 16))]
        return [a / b if b else None for a, b in pairs]


def exif_date(s: str) -> str:
    return re.sub(r"^([0-9]{4}):([0-9]{2}):([0-9]{2})[ T]([0-9]{2}:[0-9]{2}:[0-9]{2})", r"\1-\2-\3 \4", s)


def parse_exif(data: bytes, base: int, sink: Findings, where: str, grp: str | None = None) -> int | None:
    """Adds what a TIFF block tells; returns its orientation. base: the block's place in the file."""
    more = {"grp": grp} if grp else {}
    t = Tiff(data)
    if not t.ok:
        sink.add("exif.malformed", where, "the header is not that of a TIFF block", (base, len(data)), status="suspicious", **more)
        return None
    orientation, others, gps, thumb = None, 0, {}, {}
    for e in t.entries:
        tag, at = e["tag"], (base + e["at"], max(e["size"], 1))
        source = f"{where}, tag {tag:04X}"
        table = IFD0 if e["ifd"] == "ifd0" else EXIF if e["ifd"] == "exif" else {}
        if e["ifd"] == "gps":
            gps[tag] = e
        elif e["ifd"] == "ifd1" and tag in (0x0201, 0x0202):
            thumb[tag] = (t.longs(e) or [None])[0]
        elif tag in table:
            if (value := t.text(e)) is not None:
                sink.add(table[tag], source, exif_date(value) if "datetime" in table[tag] else value, at, **more)
        elif e["ifd"] == "ifd0" and tag == 0x0112:
            value = (t.longs(e) or [0])[0]
            if 1 <= value <= 8:
                orientation = value if orientation is None else orientation
                sink.add("exif.orientation", source, value, at)
        elif e["ifd"] == "ifd0" and tag in XP:
            value = t.raw(e).decode("utf-16-le", "replace").split("\0")[0].strip()
            if value:
                sink.add("exif.xp-field", source, value, at, category=XP[tag][1], label=f"Windows {XP[tag][0]}", **more)
        elif e["ifd"] == "exif" and tag == 0x927C:
            sink.add("exif.makernote", source, f"{e['size']} bytes", at, status="unsupported", **more)
        elif e["ifd"] == "exif" and tag == 0x9286:
            raw = t.raw(e)
            kind = CHARSETS.get(raw[:8])
            body = raw[8:] if len(raw) >= 8 else b""
            value = body.decode("utf-16-le" if t.reader.little else "utf-16-be", "replace") if kind == "utf-16" else utf8(body)
            value = value.strip("\0 ").strip()
            if value:
                sink.add("exif.user-comment", source, value, at, **more)
        elif tag not in POINTERS and not (e["ifd"] == "ifd0" and tag in (0x0100, 0x0101)):
            others += 1
    position(t, gps, base, sink, where, more)
    if thumb.get(0x0201) is not None and thumb.get(0x0202):
        start, size = thumb[0x0201], thumb[0x0202]
        inside = t.reader.has(start, size)
        jpeg = inside and data[start : start + 2] == b"\xff\xd8"
        sink.add("exif.thumbnail", f"{where}, second directory", f"{size} bytes" + ("" if jpeg else ", not recognised as JPEG"), (base + start, size) if inside else None, status="verified" if jpeg else "suspicious", **more)
    if others:
        sink.add("exif.other-tags", where, f"{others} fields", status="unsupported", **more)
    if t.malformed:
        sink.add("exif.malformed", where, "; ".join(dict.fromkeys(t.malformed[:5])), status="suspicious", **more)
    return orientation


def position(t: Tiff, gps: dict, base: int, sink: Findings, where: str, more: dict) -> None:
    """Latitude and longitude, altitude, and the other fields of a GPS directory."""
    def degrees(tag: int) -> float | None:
        v = t.rationals(gps[tag])[:3] if tag in gps else []
        return None if not v or None in v else sum(x / 60**k for k, x in enumerate(v))

    four = [gps[k] for k in (1, 2, 3, 4) if k in gps]
    if four:
        span = (base + min(e["place"] for e in four), max(e["place"] + 12 for e in four) - min(e["place"] for e in four))
        lat, lon = degrees(2), degrees(4)
        ref = lambda k: (t.text(gps[k]) or "")[:1].upper() if k in gps else ""
        source = f"{where}, position directory"
        if len(four) < 4:
            sink.add("exif.gps-position", source, "the position is incomplete", span, status="suspicious", confidence="medium", **more)
        elif lat is None or lon is None or ref(1) not in ("N", "S") or ref(3) not in ("E", "W"):
            sink.add("exif.gps-position", source, "the position could not be decoded", span, status="suspicious", confidence="medium", **more)
        else:
            fine = lat <= 90 and lon <= 180
            sink.add("exif.gps-position", source, f"{half_up(lat, 6):.6f}° {ref(1)}, {half_up(lon, 6):.6f}° {ref(3)}", span, status="verified" if fine else "suspicious", **more)
    if 6 in gps and (v := t.rationals(gps[6])) and v[0] is not None:
        below = 5 in gps and t.raw(gps[5])[:1] == b"\1"
        sink.add("exif.gps-altitude", f"{where}, position directory", f"{half_up(v[0], 1):.1f} m {'below' if below else 'above'} sea level", (base + gps[6]["at"], gps[6]["size"]), **more)
    rest = []
    for tag in sorted(k for k in gps if k in GPS_NAMES):
        value = t.text(gps[tag])
        if value is None and (numbers := t.rationals(gps[tag])):
            value = " ".join("?" if x is None else f"{half_up(x, 3):g}" for x in numbers)
        if value is None:
            value = f"{gps[tag]['size']} bytes"
        rest.append(f"{GPS_NAMES[tag]}: {value}")
    if rest:
        sink.add("exif.gps-other", f"{where}, position directory", "; ".join(rest), **more)
