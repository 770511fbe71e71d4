"""Sample files, built from the format specifications. Everything in them is made up."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib


def tiff(little: bool, ifd0: list, exif: list = (), gps: list = (), thumb: bytes = b"") -> bytes:
    """Entries are (tag, type, count, bytes of the value)."""
    e = "<" if little else ">"
    head = (b"II" if little else b"MM") + struct.pack(e + "HI", 42, 8)
    groups = [list(ifd0), list(exif), list(gps), []]
    if exif:
        groups[0].append((0x8769, 4, 1, None))
    if gps:
        groups[0].append((0x8825, 4, 1, None))
    if thumb:
        groups[3] = [(0x0201, 4, 1, None), (0x0202, 4, 1, struct.pack(e + "I", len(thumb)))]
    places, at = [], 8
    for g in groups:
        places.append(at if g else 0)
        at += (2 + 12 * len(g) + 4 if g else 0) + sum((len(v) + 1) // 2 * 2 for *_, v in g if v is not None and len(v) > 4)
    thumb_at, out = at, head
    for k, g in enumerate(groups):
        if not g:
            continue
        rows, data, data_at = b"", b"", places[k] + 2 + 12 * len(g) + 4
        for tag, kind, n, v in sorted(g, key=lambda x: x[0]):
            if v is None:
                v = struct.pack(e + "I", {0x8769: places[1], 0x8825: places[2], 0x0201: thumb_at}[tag])
            if len(v) <= 4:
                rows += struct.pack(e + "HHI", tag, kind, n) + v.ljust(4, b"\0")
            else:
                rows += struct.pack(e + "HHII", tag, kind, n, data_at + len(data))
                data += v + b"\0" * (len(v) % 2)
        nxt = places[3] if k == 0 and thumb else 0
        out += struct.pack(e + "H", len(g)) + rows + struct.pack(e + "I", nxt) + data
    return out + thumb


def text(tag: int, s: str) -> tuple:
    return tag, 2, len(s) + 1, s.encode() + b"\0"


def short(tag: int, n: int, little: bool = False) -> tuple:
    return tag, 3, 1, struct.pack("<H" if little else ">H", n)


def rationals(tag: int, pairs: list, little: bool = False) -> tuple:
    return tag, 5, len(pairs), b"".join(struct.pack("<II" if little else ">II", *p) for p in pairs)


def gps(little: bool = False, lat=((0, 1), (15, 1), (0, 1)), lon=((0, 1), (45, 1), (0, 1))) -> list:
    return [text(1, "N"), rationals(2, lat, little), text(3, "E"), rationals(4, lon, little), (5, 1, 1, b"\0"), rationals(6, [(25, 2)], little), text(0x1D, "2020:01:02")]


def seg(marker: int, payload: bytes) -> bytes:
    return bytes([0xFF, marker]) + struct.pack(">H", len(payload) + 2) + payload


JFIF = b"JFIF\0\x01\x02\x01\0\x48\0\x48\0\0"


def jpeg(*segments: bytes, size=(64, 48), tail: bytes = b"", jfif: bytes = JFIF) -> bytes:
    frame = struct.pack(">BHHB", 8, size[1], size[0], 1) + b"\x01\x11\0"
    scan = seg(0xDA, b"\x01\x01\0\0\x3f\0") + b"\x12\x34\xff\0\x56\xff\xd0\x78"
    return b"\xff\xd8" + seg(0xE0, jfif) + b"".join(segments) + seg(0xDB, bytes(65)) + seg(0xC0, frame) + seg(0xC4, bytes(20)) + scan + b"\xff\xd9" + tail


def icc(description: str) -> bytes:
    body = b"desc\0\0\0\0" + struct.pack(">I", len(description) + 1) + description.encode() + b"\0"
    head = bytearray(128)
    head[8:10], head[12:16], head[16:20], head[36:40] = b"\x02\x40", b"mntr", b"RGB ", b"acsp"
    head[24:30] = struct.pack(">HHH", 2019, 3, 4)
    return bytes(head) + struct.pack(">I", 1) + b"desc" + struct.pack(">II", 144, len(body)) + body


XMP = b'<x:xmpmeta><rdf:RDF xmlns:xmp="u"><rdf:Description xmp:CreatorTool="Paint &amp; Co" photoshop:City="Nowhere"><dc:creator><rdf:Seq><rdf:li>Ann Example</rdf:li><rdf:li>Bo Sample</rdf:li></rdf:Seq></dc:creator><xmpMM:DocumentID>uuid:1</xmpMM:DocumentID></rdf:Description></rdf:RDF></x:xmpmeta>'


def iptc(*rows: tuple[int, bytes]) -> bytes:
    data = b"".join(b"\x1c\x02" + bytes([n]) + struct.pack(">H", len(v)) + v for n, v in rows)
    one = lambda kind, body: b"8BIM" + struct.pack(">H", kind) + b"\0\0" + struct.pack(">I", len(body)) + body + b"\0" * (len(body) % 2)
    return b"Photoshop 3.0\0" + one(0x0404, data) + one(0x040C, bytes(40)) + one(0x03ED, bytes(16))


def full_jpeg(orientation: int = 6, tail: bytes = b"PK\3\4 after the end") -> bytes:
    exif = tiff(False, [text(0x010F, "Maker"), text(0x0110, "Model 1"), text(0x0132, "2020:05:06 07:08:09"), short(0x0112, orientation), text(0x013B, "Ann Example"), (0x9C9D, 1, 8, "Bob".encode("utf-16-le") + b"\0\0")], [text(0xA431, "SN-1"), (0x927C, 7, 30, bytes(30)), (0x9286, 7, 14, b"ASCII\0\0\0a note")], gps(), b"\xff\xd8thumb\xff\xd9")
    parts = icc("A profile")
    return jpeg(
        seg(0xE1, b"Exif\0\0" + exif), seg(0xE1, b"http://ns.adobe.com/xap/1.0/\0" + XMP), seg(0xE2, b"ICC_PROFILE\0\x01\x02" + parts[:100]), seg(0xE2, b"ICC_PROFILE\0\x02\x02" + parts[100:]), seg(0xE2, b"MPF\0" + bytes(20)),
        seg(0xED, iptc((80, b"Ann Example"), (25, b"key"), (90, "Città".encode()))), seg(0xEE, b"Adobe" + bytes(6) + b"\x01"), seg(0xE5, b"XYZ\0rest"), seg(0xFE, b"a comment\0"), tail=tail, jfif=JFIF[:-2] + b"\x02\x02" + bytes(12),
    )


def chunk(name: bytes, body: bytes = b"", bad: bool = False) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body) ^ bad)


def png(*chunks: bytes, after: tuple = (), tail: bytes = b"", size=(8, 8), depth=(8, 2)) -> bytes:
    raw = zlib.compress(b"".join(b"\0" + bytes(size[0] * 3) for _ in range(size[1])))
    head = struct.pack(">IIBBBBB", *size, *depth, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + b"".join(chunks) + chunk(b"IDAT", raw) + b"".join(after) + chunk(b"IEND") + tail


def full_png() -> bytes:
    return png(
        chunk(b"iCCP", b"p\0\0" + zlib.compress(icc("A profile"))), chunk(b"pHYs", struct.pack(">IIB", 2835, 2835, 1)), chunk(b"tEXt", b"Author\0Ann Example"), chunk(b"zTXt", b"Comment\0\0" + zlib.compress(b"packed")),
        chunk(b"iTXt", b"XML:com.adobe.xmp\0\0\0\0\0" + XMP), chunk(b"iTXt", b"Title\0\x01\0\0\0" + zlib.compress("Ä".encode())), chunk(b"eXIf", tiff(False, [short(0x0112, 6), text(0x0131, "Prog")], gps=gps())), chunk(b"tIME", struct.pack(">HBBBBB", 2021, 2, 3, 4, 5, 6)), chunk(b"caBX", b"x"), chunk(b"abCd", b"unknown"), tail=b"tail bytes",
    )


def pdf(extra: bytes = b"", catalog: bytes = b"", page: bytes = b"", trailer: bytes = b"") -> bytes:
    return b"""%PDF-1.7
1 0 obj
<< /Type /Catalog /Pages 2 0 R """ + catalog + b""" >>
endobj
2 0 obj
<< /Type /Pages /Kids [3 0 R] /Count 1 >>
endobj
3 0 obj
<< /Type /Page /Parent 2 0 R """ + page + b""" >>
endobj
4 0 obj
<< /Title (A \\(small\\) title) /Author <FEFF0041006E006E> /CreationDate (D:20200102030405+01'00') /Custom (mine) >>
endobj
""" + extra + b"""
trailer
<< /Root 1 0 R /Info 4 0 R /ID [<00AA><00BB>] """ + trailer + b""" >>
startxref
0
%%EOF
"""


def object_stream(number: int, objects: dict[int, bytes], more: bytes = b"", packed=zlib.compress) -> bytes:
    table, body = [], b""
    for n, value in objects.items():
        table.append(b"%d %d" % (n, len(body)))
        body += value + b"\n"
    first = b" ".join(table) + b"\n"
    data = packed(first + body)
    return b"%d 0 obj\n<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d %s >>\nstream\n" % (number, len(objects), len(first), len(data), more) + data + b"\nendstream\nendobj\n"


def packed_pdf(more: bytes = b"", info: bytes = b"<< /Title (Packed) /Author (Ann) >>", trailer: bytes = b"", parms: bytes = b"") -> bytes:
    """Catalogue, pages and properties in an object stream, a cross-reference stream in place of the trailer."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R /OpenAction << /S /JavaScript /JS (app.alert) >> >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 3: b"<< /Type /Page /Parent 2 0 R >>", 4: info}
    return b"%PDF-1.5\n" + object_stream(9, objects, parms) + more + b"10 0 obj\n<< /Type /XRef /Size 11 /W [1 2 1] /Root 1 0 R /Info 4 0 R " + trailer + b">>\nstream\n\nendstream\nendobj\nstartxref\n0\n%%EOF\n"


def docx(**more: str | bytes) -> bytes:
    """Parts by name; defaults make a small document."""
    w = 'xmlns:w="w"'
    parts = {
        "[Content_Types].xml": "<Types/>", "_rels/.rels": "<Relationships/>",
        "word/document.xml": f'<w:document {w}><!-- no --><w:p w:rsidR="00AA"><w:ins w:author="Ann &amp; Co"><w:r w:rsidR="00AB"><w:rPr><w:vanish/></w:rPr></w:r></w:ins><w:del w:author="Bo"/></w:p></w:document>',
        "docProps/core.xml": "<cp:coreProperties><dc:creator>Ann Example</dc:creator><cp:lastModifiedBy>Bo</cp:lastModifiedBy><cp:revision>3</cp:revision></cp:coreProperties>",
        "docProps/app.xml": "<Properties><Application>Writer</Application><Company>None Inc.</Company></Properties>", "docProps/custom.xml": '<Properties><property name="Case"/><property name="Room"/></Properties>',
        "word/comments.xml": '<w:comments><w:comment w:author="Cy">secret</w:comment></w:comments>', "word/_rels/document.xml.rels": '<Relationships><Relationship Type="x/hyperlink" TargetMode="External" Target="http://example.com"/></Relationships>',
        "word/media/image1.png": b"12345", "word/vbaProject.bin": b"x",
    } | more
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def samples() -> dict[str, bytes]:
    return {
        "clean.jpg": jpeg(), "full.jpg": full_jpeg(), "turned1.jpg": full_jpeg(1), "cut.jpg": full_jpeg()[:700], "large.jpg": jpeg(size=(65535, 65535)), "wrong.png": jpeg(), "two.jpg": jpeg(seg(0xE1, b"Exif\0\0" + tiff(True, [text(0x010F, "A")])), seg(0xE1, b"Exif\0\0" + tiff(True, [text(0x010F, "B")]))),
        "clean.png": png(), "full.png": full_png(), "bad.png": png(chunk(b"tEXt", b"a\0b", bad=True)), "order.png": png(after=(chunk(b"sRGB", b"\0"), chunk(b"gAMA", bytes(4)))), "cut.png": full_png()[:-30],
        "plain.pdf": pdf(), "active.pdf": pdf(b"5 0 obj\n<< /S /JavaScript /JS (app.alert) >>\nendobj\n6 0 obj\n<< /Type /Annot /Subtype /Link /A << /S /URI /URI (http://example.com/a) >> >>\nendobj\n7 0 obj\n<< /Subtype /Text /T (Ann) >>\nendobj", b"/OpenAction 5 0 R", b"/Annots [6 0 R 7 0 R]"), "locked.pdf": pdf(trailer=b"/Encrypt 9 0 R"),
        "doc.docx": docx(), "odd.docx": docx(**{"../up.txt": b"x"}), "other.zip": docx()[:4] + bytes(100), "empty.jpg": b"", "notes.txt": b"plain text",
    }
