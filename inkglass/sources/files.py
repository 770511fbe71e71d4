"""Files as rows: reading, size refusals, detection by content, and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkglass.functions import limits, text

SCHEMA = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
#: Extensions of each format.
EXTENSIONS = {"jpeg": ("jpg", "jpeg", "jpe", "jfif"), "png": ("png",), "pdf": ("pdf",), "docx": ("docx", "docm", "dotx", "dotm")}
DOCX_MIME = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
#: In order, (test, format, type, label, recognised though not supported).
SIGNATURES = (
    (("89504e470d0a1a0a", 0), "png", "image/png", "PNG picture", False),
    (("ffd8ff", 0), "jpeg", "image/jpeg", "JPEG picture", False),
    (("474946383761", 0), None, "image/gif", "GIF picture", True),
    (("474946383961", 0), None, "image/gif", "GIF picture", True),
    (("52494646", 0, "57454250", 8), None, "image/webp", "WebP picture", True),
    (("66747970", 4), None, "video/mp4 or image/heic", "media file with an ftyp box", True),
    (("504b0304", 0), None, "application/zip", "ZIP package", True),
    (("504b0506", 0), None, "application/zip", "ZIP package", True),
    (("49492a00", 0), None, "image/tiff", "TIFF picture", True),
    (("4d4d002a", 0), None, "image/tiff", "TIFF picture", True),
    (("d0cf11e0", 0), None, "application/x-ole-storage", "OLE compound file", True),
)


def read_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Files below a path, one row each. Empty and too large files are refused before their content
    is read: the length is a predicate of the source."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return fewer_tasks(as_files(reader.load(path).where(F.col("length").between(1, limits.FILE_BYTES))))


def fewer_tasks(found: DataFrame) -> DataFrame:
    """Rows of the binary source in fewer partitions. The source counts 4 MB for opening a file, so it would make a task for every
    32 small files; up to 32 of its partitions are read by one task, one after the other, as long as each core has four. Nothing is shuffled."""
    n, least = found.rdd.getNumPartitions(), 4 * found.sparkSession.sparkContext.defaultParallelism
    return found.coalesce(max(least, -(-n // 32))) if n > least else found


def as_files(df: DataFrame) -> DataFrame:
    """Rows of the binary source with the columns that the other functions take."""
    return df.select(F.col("path").alias("file_id"), "path", F.regexp_extract("path", r"([^/\\]*)$", 1).alias("name"), F.lit(None).cast("string").alias("declared_type"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def refused(spark: SparkSession, path: str) -> DataFrame:
    """Files that read_files() leaves out, with the reason; contents are not read. The source itself
    doesn't list empty files; where contents come from elsewhere, fingerprint() refuses them."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"))
    return rows.where((F.col("size") < 1) | (F.col("size") > limits.FILE_BYTES)).withColumn("refusal", F.when(F.col("size") < 1, "empty-file").otherwise("file-too-large"))


#: What a row number of detect() stands for: SIGNATURES, then PDF, then anything else.
KINDS = (*(s[1:] for s in SIGNATURES), ("pdf", "application/pdf", "PDF file", False), (None, "unknown", "content without a known signature", False))


def detect(content: Column) -> Column:
    """format, mime, label, recognised_unsupported from leading bytes alone, which are taken once and give a row number of KINDS."""
    def row(head: Column) -> Column:
        def fits(parts: tuple) -> Column:
            out = F.lit(True)
            for sign, at in zip(parts[::2], parts[1::2], strict=True):
                out = out & (F.substring(head, at + 1, len(sign) // 2) == F.unhex(F.lit(sign)))
            return out

        out = F.when(F.position(F.unhex(F.lit("255044462d")), head) > 0, F.lit(len(SIGNATURES))).otherwise(F.lit(len(KINDS) - 1))
        for k, (parts, *_) in reversed([*enumerate(SIGNATURES)]):
            out = F.when(fits(parts), F.lit(k)).otherwise(out)
        return out

    listed = F.array(*(F.struct(F.lit(f).cast("string").alias("format"), F.lit(m).alias("mime"), F.lit(label).alias("label"), F.lit(known).alias("recognised_unsupported")) for f, m, label, known in KINDS))
    return text.bind(lambda head: F.get(listed, F.coalesce(row(head), F.lit(len(KINDS) - 1))), F.substring(content, 1, 1024 + 5))


def size_limit(fmt: Column) -> Column:
    out = F.lit(limits.FILE_BYTES)
    for f, n in limits.FORMAT_BYTES.items():
        out = F.when(fmt == f, F.lit(n)).otherwise(out)
    return out


def extension_check(fmt: Column, extension: Column) -> Column:
    """match, mismatch or unknown."""
    known = F.lit(False)
    for f, names in EXTENSIONS.items():
        known = known | ((fmt == f) & extension.isin(*names))
    return F.when(fmt.isNull() | (extension == ""), "unknown").when(known, "match").otherwise("mismatch")


def fingerprint(files: DataFrame, docx: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each file's detection, checks, hash and refusal. docx: says if a ZIP is a DOCX (by its entries). A size that
    the source has listed must be that of the content. keep: columns that are handed on."""
    found = files.withColumn("d", detect(F.col("content")))
    if docx is not None:
        word = F.struct(F.lit("docx").alias("format"), F.lit(DOCX_MIME).alias("mime"), F.lit("DOCX package").alias("label"), F.lit(False).alias("recognised_unsupported"))
        found = found.withColumn("d", F.when((F.col("d.mime") == "application/zip") & docx, word).otherwise(F.col("d")))
    listed = F.col("size") if "size" in files.columns else F.lit(None).cast("long")
    found = found.withColumn("listed", listed).withColumn("extension", text.extension(F.col("name"))).withColumn("size", F.octet_length("content").cast("long"))
    declared = F.lower("declared_type")
    check = F.when(F.col("d.format").isNull() | F.coalesce(declared, F.lit("")).eqNullSafe(""), "unknown").when(declared == F.col("d.mime"), "match").otherwise("mismatch")
    large_zip = (F.col("d.mime") == "application/zip") & (F.col("size") > limits.FORMAT_BYTES["docx"])
    refusal = F.when(F.col("listed") != F.col("size"), "changed-while-read").when(large_zip, "zip-too-large").when(F.col("size") == 0, "empty-file").when(F.col("size") > limits.FILE_BYTES, "file-too-large").when(F.col("size") > size_limit(F.col("d.format")), "format-too-large").when(F.col("d.format").isNull(), "unsupported-format")
    return found.select(
        "file_id", "name", F.substring("declared_type", 1, 100).alias("declared_type"), "size", F.col("d.format").alias("detected_format"), F.col("d.mime").alias("detected_type"), F.when(large_zip, "ZIP archive too large to look for a DOCX in it").otherwise(F.col("d.label")).alias("detected_label"), F.col("d.recognised_unsupported").alias("recognised_unsupported"),
        "extension", extension_check(F.col("d.format"), F.col("extension")).alias("extension_check"), check.alias("declared_type_check"), F.sha2("content", 256).alias("sha256"), refusal.alias("refusal"), *keep,
    )


#: If a file's name or declared type differs from its content.
MISMATCH = "extension_check = 'mismatch' OR declared_type_check = 'mismatch'"


def mismatch_text() -> Column:
    """What a file.type-mismatch finding says, from the columns of fingerprint()."""
    parts = F.array_compact(F.array(
        F.when(F.col("extension_check") == "mismatch", F.concat(F.lit("the name ends in ."), "extension")),
        F.when(F.col("declared_type_check") == "mismatch", F.concat(F.lit("the declared type is "), "declared_type")),
    ))
    return F.concat(F.lit("The content is a "), "detected_label", F.lit(", but "), F.array_join(parts, " and "), F.lit("."))


def mismatches(prints: DataFrame) -> DataFrame:
    """One file.type-mismatch finding for each file whose name or declared type differs from its content."""
    return prints.where(MISMATCH).select("file_id", F.lit("file.type-mismatch").alias("code"), mismatch_text().alias("value"), F.lit("File name and type").alias("source"))


def describe_trailing(content: Column, start: Column) -> Column:
    """What the bytes after a picture look like; empty if fewer than four."""
    tail = content.substr(start + 1, F.lit(8))
    begins = lambda sign: tail.substr(F.lit(1), F.lit(len(sign) // 2)) == F.unhex(F.lit(sign))
    return (
        F.when(F.octet_length(content) - start < 4, "").when(begins("ffd8ff"), "starts with a JPEG signature").when(begins("89504e47"), "starts with a PNG signature")
        .when(begins("504b0304"), "starts with a ZIP signature").when(begins("25504446"), "starts with a PDF signature").otherwise("starts with no known signature")
    )
