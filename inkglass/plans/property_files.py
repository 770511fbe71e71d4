"""Files with properties made from the driver's documents, and the properties that come out again.

Each document's whole text, in plain characters, is put into the properties of a JPEG (EXIF, XMP, IPTC,
ICC), a PNG (compressed text, EXIF, profile), a DOCX (core properties, comments, tracked changes) or a
PDF (information dictionary); the format follows from its id. The SQL tells what must come out.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zipfile
import zlib
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkglass.functions.limits import DISPLAY_CHARS
from inkglass.plans import findings as model
from inkglass.plans import inspect as plan
from inkglass.plans.queries import table
from inkglass.shared import small_batches

#: Characters but those that any of the formats holds as they are.
PLAIN = "[^ 0-9A-Za-z.,:-]"
KEPT = re.sub(PLAIN, " ", "".join(map(chr, range(256)))).encode()


COMMENT_CHARS = 60_000


def tiff(entries: list[tuple[int, int, int, bytes]]) -> bytes:
    """A TIFF block with one directory; entries are (tag, type, count, value), tags ascending."""
    at, rows, data = 8 + 2 + 12 * len(entries) + 4, b"", b""
    for tag, kind, n, value in entries:
        rows += struct.pack(">HHI", tag, kind, n) + (value.ljust(4, b"\0") if len(value) <= 4 else struct.pack(">I", at + len(data)))
        data += value + b"\0" * (len(value) % 2) if len(value) > 4 else b""
    return b"MM" + struct.pack(">HIH", 42, 8, len(entries)) + rows + bytes(4) + data


def exif(text: str, n: int) -> bytes:
    word = lambda tag, s: (tag, 2, len(s) + 1, s.encode() + b"\0")
    return tiff([word(0x010F, f"Maker {n}"), word(0x0110, f"Model {n}"), (0x0112, 3, 1, struct.pack(">H", 1 + n % 8)), word(0x0131, f"Program {n}"), word(0x0132, f"2020:01:{1 + n % 28:02d} 10:11:12"), word(0x013B, text), word(0x8298, f"Owner {n}")])


def profile(description: str) -> bytes:
    body = b"desc\0\0\0\0" + struct.pack(">I", len(description) + 1) + description.encode() + b"\0"
    head = bytearray(128)
    head[8:10], head[12:16], head[16:20], head[36:40] = b"\x02\x40", b"mntr", b"RGB ", b"acsp"
    return bytes(head) + struct.pack(">I", 1) + b"desc" + struct.pack(">II", 144, len(body)) + body


#: What the JPEG files hold: every XMP property and IPTC dataset that is itemised, by the code of its finding.
MADE_XMP = {
    "xmp.creator": ["dc:creator"], "xmp.rights": ["dc:rights"], "xmp.tool": ["xmp:CreatorTool"], "xmp.agent": ["stEvt:softwareAgent"], "xmp.date": ["xmp:CreateDate", "xmp:ModifyDate", "xmp:MetadataDate", "photoshop:DateCreated"],
    "xmp.title": ["dc:title"], "xmp.description": ["dc:description"], "xmp.keywords": ["dc:subject"], "xmp.document-id": ["xmpMM:DocumentID", "xmpMM:InstanceID", "xmpMM:OriginalDocumentID"], "xmp.device": ["tiff:Make", "tiff:Model"],
    "xmp.location": ["photoshop:City", "photoshop:State", "photoshop:Country", "exif:GPSLatitude", "exif:GPSLongitude"],
}
MADE_IPTC = {"iptc.headline": [5, 105], "iptc.keywords": [25], "iptc.date": [55, 60], "iptc.byline": [80, 122], "iptc.location": [90, 92, 95, 101], "iptc.credit": [110, 115], "iptc.copyright": [116], "iptc.caption": [120]}
#: Made in another form below.
APART = {"dc:creator", "xmp:CreatorTool", "dc:title", 120}


def jpeg_file(text: str, n: int) -> bytes:
    part = lambda marker, body: bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body
    digest = hashlib.sha1(text.encode()).hexdigest()  # a segment holds 65,533 bytes, so only comments have the whole text
    notes = [text[at : at + COMMENT_CHARS] for at in range(0, max(len(text), 1), COMMENT_CHARS)]
    more = "".join(f' {p}="{p} {n}"' for names in MADE_XMP.values() for p in names if p not in APART)
    xmp = f'<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF><rdf:Description xmp:CreatorTool="Tool &amp; {n}"{more}><dc:creator><rdf:Seq><rdf:li>First {n}</rdf:li><rdf:li>Second {n}</rdf:li></rdf:Seq></dc:creator><dc:title>Title {n}</dc:title></rdf:Description></rdf:RDF></x:xmpmeta>'
    sets = b"".join(b"\x1c\x02" + bytes([kind]) + struct.pack(">H", len(v)) + v.encode() for kind in sorted(k for kinds in MADE_IPTC.values() for k in kinds) for v in [digest if kind == 120 else f"Set {kind} {n}"])
    block = b"Photoshop 3.0\0" + b"8BIM\x04\x04\0\0" + struct.pack(">I", len(sets)) + sets + b"\0" * (len(sets) % 2)
    return b"".join([
        b"\xff\xd8", part(0xE0, b"JFIF\0\1\2\1\0\x48\0\x48\0\0"), part(0xE1, b"Exif\0\0" + exif(digest, n)), part(0xE1, b"http://ns.adobe.com/xap/1.0/\0" + xmp.encode()), part(0xE2, b"ICC_PROFILE\0\1\1" + profile(f"Profile {n}")),
        part(0xED, block), *(part(0xFE, f".{x}.".encode()) for x in notes), part(0xC0, b"\x08\x00\x30\x00\x40\x01\x01\x11\x00"), part(0xDA, b"\x01\x01\0\0\x3f\0") + b"\x12\x34", b"\xff\xd9",
    ])


def png_file(text: str, n: int) -> bytes:
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"".join([
        b"\x89PNG\r\n\x1a\n", chunk(b"IHDR", struct.pack(">IIBBBBB", 8, 8, 8, 2, 0, 0, 0)), chunk(b"iCCP", b"p\0\0" + zlib.compress(profile(f"Profile {n}"))), chunk(b"zTXt", b"Comment\0\0" + zlib.compress(text.encode())),
        chunk(b"iTXt", b"Title\0\1\0\0\0" + zlib.compress(f"Title {n}".encode())), chunk(b"tEXt", b"Author\0" + text.encode()), chunk(b"tIME", struct.pack(">HBBBBB", 2021, 1 + n % 12, 3, 4, 5, 6)), chunk(b"eXIf", exif(text, n)),
        chunk(b"IDAT", zlib.compress(b"\0" * 200)), chunk(b"IEND", b""),
    ])


def docx_file(text: str, n: int) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f'<w:document><w:p><w:ins w:author="Ann {n}"><w:r><w:rPr><w:vanish/></w:rPr><w:t>{escape(text)}</w:t></w:r></w:ins><w:del w:author="Bo {n}"/></w:p></w:document>')
        z.writestr("docProps/core.xml", f"<cp:coreProperties><dc:creator>Author {n}</dc:creator><dc:title>{escape(text)}</dc:title><cp:lastModifiedBy>Editor {n}</cp:lastModifiedBy></cp:coreProperties>")
        z.writestr("docProps/app.xml", f"<Properties><Company>Company {n}</Company></Properties>")
        z.writestr("word/comments.xml", "<w:comments>" + '<w:comment w:author="Cy">x</w:comment>' * (1 + n % 5) + "</w:comments>")
    return out.getvalue()


def pdf_file(text: str, n: int) -> bytes:
    """Every other one has its objects in an object stream."""
    objects = {1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< /Type /Pages /Kids [] /Count 0 >>", 3: f"<< /Title ({text}) /Author (Author {n}) /CreationDate (D:202001{1 + n % 28:02d}101112Z) >>"}
    if n % 8 == 7:
        starts, body = "", ""
        for number, value in objects.items():
            starts += f"{number} {len(body)} "
            body += value + " "
        data = zlib.compress((starts + body).encode())
        return f"%PDF-1.7\n4 0 obj\n<< /Type /ObjStm /N {len(objects)} /First {len(starts)} /Filter /FlateDecode /Length {len(data)} >>\nstream\n".encode() + data + b"\nendstream\nendobj\n5 0 obj\n<< /Type /XRef /Size 6 /W [1 2 1] /Root 1 0 R /Info 3 0 R >>\nstream\n\nendstream\nendobj\n%%EOF\n"
    plain = "".join(f"{number} 0 obj\n{value}\nendobj\n" for number, value in objects.items())
    return f"%PDF-1.7\n{plain}trailer\n<< /Root 1 0 R /Info 3 0 R >>\n%%EOF\n".encode()


def plain(text: str | None) -> str:
    """A text with each character that PLAIN finds replaced by a space, without spaces at its ends. As bytes, since a text
    may hold such characters only, and a pattern is slow at each."""
    return (text or "").encode("ascii", "replace").translate(KEPT).decode().strip(" ")


MAKERS = (jpeg_file, png_file, docx_file, pdf_file)


NAMES = ("jpg", "png", "docx", "pdf")


def property_files(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = NAMES) -> DataFrame:
    """file_id, name, declared_type, content: a file of each document, or of those whose files are of some kinds."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 50):
                part = ids[at : at + 50]
                made = [MAKERS[i % 4](plain(texts[at + k].as_py()), i) for k, i in enumerate(part)]
                names = [f"f{i}.{NAMES[i % 4]}" for i in part]
                yield pa.RecordBatch.from_arrays([pa.array([str(i) for i in part]), pa.array(names), pa.nulls(len(part), pa.string()), pa.array(made, pa.binary())], names=["file_id", "name", "declared_type", "content"])

    docs = table(spark, sf_dir, "documents").where(F.pmod("doc_id", F.lit(4)).isin(*(NAMES.index(k) for k in kinds)))
    small_batches(spark)
    return docs.select("doc_id", "text").mapInArrow(run, "file_id string, name string, declared_type string, content binary")


#: Findings whose values follow from what was put in.
CODES = (
    "exif.make", "exif.model", "exif.orientation", "exif.software", "exif.datetime", "exif.artist", "exif.copyright", *MADE_XMP, *MADE_IPTC, "icc.profile", "jpeg.comment", "image.dimensions",
    "png.text", "png.text-author", "png.time", "docx.author", "docx.last-modified-by", "docx.property", "docx.company", "docx.comments", "docx.comment-authors", "docx.tracked-changes", "docx.tracked-authors", "docx.hidden-text", "pdf.title", "pdf.author", "pdf.created",
)


def found_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the files' properties are."""
    found = plan.findings(plan.inspect(property_files(spark, sf_dir)))
    return found.where(F.col("code").isin(*CODES)).select("file_id", "code", "value")


def shown(value: str) -> str:
    return f"CASE WHEN length({value}) > {DISPLAY_CHARS} THEN substr({value}, 1, {DISPLAY_CHARS}) || '… (' || (length({value}) - {DISPLAY_CHARS}) || ' characters longer)' ELSE {value} END"


D_SQL = f"d AS (SELECT doc_id AS n, CAST(doc_id AS VARCHAR) AS file_id, doc_id % 4 AS k, trim(regexp_replace(coalesce(text, ''), '{PLAIN}', ' ', 'g'), ' ') AS t FROM documents)"
MADE_SQL = ", ".join(f"('{code}', '{p if isinstance(p, str) else f'Set {p}'}')" for code, names in (MADE_XMP | MADE_IPTC).items() for p in names if p not in APART)
FOUND_SQL = f"""WITH {D_SQL},
    e AS (SELECT file_id, n, k, CASE WHEN k = 0 THEN sha1(t) ELSE t END AS artist FROM d WHERE k < 2),
    v AS (SELECT file_id, 'exif.make' AS code, 'Maker ' || n AS value FROM e UNION ALL SELECT file_id, 'exif.model', 'Model ' || n FROM e UNION ALL SELECT file_id, 'exif.orientation', CAST(1 + n % 8 AS VARCHAR) FROM e UNION ALL SELECT file_id, 'exif.software', 'Program ' || n FROM e
        UNION ALL SELECT file_id, 'exif.datetime', '2020-01-' || lpad(CAST(1 + n % 28 AS VARCHAR), 2, '0') || ' 10:11:12' FROM e UNION ALL SELECT file_id, 'exif.artist', artist FROM e WHERE artist <> '' UNION ALL SELECT file_id, 'exif.copyright', 'Owner ' || n FROM e
        UNION ALL SELECT file_id, 'icc.profile', 'Profile ' || n || ', RGB display, ICC 2.4' FROM e UNION ALL SELECT file_id, 'image.dimensions', ['64 × 48 pixels', '8 × 8 pixels'][k + 1] FROM e
        UNION ALL SELECT file_id, 'xmp.creator', 'First ' || n || '; Second ' || n FROM d WHERE k = 0 UNION ALL SELECT file_id, 'xmp.tool', 'Tool & ' || n FROM d WHERE k = 0 UNION ALL SELECT file_id, 'xmp.title', 'Title ' || n FROM d WHERE k = 0
        UNION ALL SELECT file_id, 'iptc.caption', sha1(t) FROM d WHERE k = 0 UNION ALL SELECT file_id, code, made || ' ' || n FROM d, (VALUES {MADE_SQL}) AS m(code, made) WHERE k = 0
        UNION ALL SELECT file_id, 'jpeg.comment', '.' || substr(t, 1 + i * {COMMENT_CHARS}, {COMMENT_CHARS}) || '.' FROM (SELECT *, unnest(range(greatest(1, CAST(ceil(length(t) / {COMMENT_CHARS}.0) AS BIGINT)))) AS i FROM d WHERE k = 0)
        UNION ALL SELECT file_id, 'png.text', 'Comment: ' || t FROM d WHERE k = 1 UNION ALL SELECT file_id, 'png.text', 'Title: Title ' || n FROM d WHERE k = 1 UNION ALL SELECT file_id, 'png.text-author', 'Author: ' || t FROM d WHERE k = 1
        UNION ALL SELECT file_id, 'png.time', '2021-' || lpad(CAST(1 + n % 12 AS VARCHAR), 2, '0') || '-03 04:05:06 UTC' FROM d WHERE k = 1
        UNION ALL SELECT file_id, 'docx.author', 'Author ' || n FROM d WHERE k = 2 UNION ALL SELECT file_id, 'docx.last-modified-by', 'Editor ' || n FROM d WHERE k = 2 UNION ALL SELECT file_id, 'docx.property', substr(t, 1, 4000) FROM d WHERE k = 2 AND t <> '' UNION ALL SELECT file_id, 'docx.company', 'Company ' || n FROM d WHERE k = 2
        UNION ALL SELECT file_id, 'docx.comments', (1 + n % 5) || ' comments' FROM d WHERE k = 2 UNION ALL SELECT file_id, 'docx.comment-authors', 'Cy' FROM d WHERE k = 2 UNION ALL SELECT file_id, 'docx.tracked-changes', '2 tracked changes' FROM d WHERE k = 2 UNION ALL SELECT file_id, 'docx.tracked-authors', 'Ann ' || n || ', Bo ' || n FROM d WHERE k = 2 UNION ALL SELECT file_id, 'docx.hidden-text', '1 runs' FROM d WHERE k = 2
        UNION ALL SELECT file_id, 'pdf.title', t FROM d WHERE k = 3 AND t <> '' UNION ALL SELECT file_id, 'pdf.author', 'Author ' || n FROM d WHERE k = 3 UNION ALL SELECT file_id, 'pdf.created', '2020-01-' || lpad(CAST(1 + n % 28 AS VARCHAR), 2, '0') || ' 10:11:12 UTC' FROM d WHERE k = 3)
    SELECT file_id, code, {shown('value')} AS value FROM v"""


def property_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats as detected and as walked, sizes, soundness, whether copies are offered."""
    rows = plan.inspected_prints(plan.inspect(property_files(spark, sf_dir), ("name", "declared_type", "content")))
    return rows.select("file_id", "detected_format", "extension_check", "refusal", "format", "width", "height", "orientation", F.coalesce("structurally_unsound", F.lit(False)).alias("unsound"), "error", F.col("copy_refusal").isNull().alias("copies"), model.support_label(F.col("format"), F.col("copy_refusal")).alias("support"))


REPORTS_SQL = f"""WITH {D_SQL} SELECT file_id, ['jpeg', 'png', 'docx', 'pdf'][k + 1] AS detected_format, 'match' AS extension_check, CAST(NULL AS VARCHAR) AS refusal, ['jpeg', 'png', 'docx', 'pdf'][k + 1] AS format, CAST([64, 8, NULL, NULL][k + 1] AS BIGINT) AS width, CAST([48, 8, NULL, NULL][k + 1] AS BIGINT) AS height,
    CASE WHEN k < 2 THEN CAST(1 + n % 8 AS INTEGER) END AS orientation, false AS unsound, CAST(NULL AS VARCHAR) AS error, k < 2 AS copies, CASE WHEN k < 2 THEN 'inspection and copy' ELSE 'inspection only' END AS support FROM d"""


def property_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies without what is removed by default: what is left in them, and the checks that fail."""
    copies = plan.copy_inspected(plan.inspect(property_files(spark, sf_dir), ("content",)), default_only=True).where("output IS NOT NULL AND size(copy.findings) > 0")
    codes = F.array_join(F.array_sort(F.array_distinct(F.transform("after", lambda f: f["code"]))), " ")
    of = lambda status: F.size(F.filter("checks", lambda c: c["status"] == status)).cast("long")
    return copies.select("file_id", codes.alias("left_codes"), of("fail").alias("failed"), of("pass").alias("passed"))


COPIES_SQL = f"""WITH {D_SQL} SELECT file_id, CASE WHEN n % 8 <> 0 THEN 'exif.orientation ' ELSE '' END || 'icc.profile image.dimensions' || CASE WHEN k = 0 THEN ' jpeg.jfif' ELSE '' END AS left_codes, CAST(0 AS BIGINT) AS failed, CAST(9 AS BIGINT) AS passed FROM d WHERE k < 2"""


def property_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings (without facts of the structure) and sizes of originals and copies, side by side."""
    made = property_files(spark, sf_dir, ("jpg", "png"))
    rows = plan.compared_reports(plan.copy_inspected(plan.inspect(made, ("content",)), default_only=False))
    return rows.select("file_id", "original_width", "copy_width", "original_height", "copy_height", "original_orientation", F.coalesce("copy_orientation", F.lit(1)).alias("copy_orientation"), (F.col("copy_size") < F.col("original_size")).alias("smaller"), (F.col("copy_findings") < F.col("original_findings")).alias("fewer"))


COMPARISON_SQL = f"""WITH {D_SQL} SELECT file_id, CAST([64, 8][k + 1] AS BIGINT) AS original_width, CAST([64, 8][k + 1] AS BIGINT) AS copy_width, CAST([48, 8][k + 1] AS BIGINT) AS original_height, CAST([48, 8][k + 1] AS BIGINT) AS copy_height,
    CAST(1 + n % 8 AS INTEGER) AS original_orientation, CAST(1 + n % 8 AS INTEGER) AS copy_orientation, true AS smaller, true AS fewer FROM d WHERE k < 2"""

QUERIES = {"found_properties": found_properties, "property_reports": property_reports, "property_copies": property_copies, "property_comparison": property_comparison}
ORACLES = {"found_properties": FOUND_SQL, "property_reports": REPORTS_SQL, "property_copies": COPIES_SQL, "property_comparison": COMPARISON_SQL}
