"""Queries that make files from the driver's tables and inspect them: rows without SQL, as walkers
have none. Pictures and documents are put together from a row's text by DataFrame functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkglass.plans import findings as model
from inkglass.plans import inspect as plan
from inkglass.plans.queries import table


def number(n: Column, size: int) -> Column:
    """n as `size` bytes, the highest first."""
    return F.unhex(F.lpad(F.hex(n.cast("long")), 2 * size, "0"))


def lit(data: str) -> Column:
    return F.unhex(F.lit(data))


def segment(marker: str, body: Column) -> Column:
    return F.concat(lit("ff" + marker), number(F.octet_length(body) + 2, 2), body)


#: Characters of a comment, at most four bytes each; a segment holds 65,533 bytes.
COMMENT_CHARS = 16_000


def jpeg_of(text: Column) -> Column:
    """A JPEG with the text in comments, its hash as EXIF text (which can't hold long ones) and trailing bytes."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(COMMENT_CHARS))
    notes = F.transform(starts, lambda i: segment("fe", F.encode(F.substring(text, i, F.lit(COMMENT_CHARS)), "UTF-8")))
    notes = F.aggregate(notes, lit(""), lambda a, b: F.concat(a, b))
    artist = F.encode(F.sha1(F.encode(text, "UTF-8")), "US-ASCII")
    exif = F.concat(lit("457869660000" + "4d4d002a00000008" + "0002" + "0112000300000001" + "00060000" + "013b0002" + "00000028" + "00000026" + "00000000"), artist)
    frame = lit("ffc0000b080030004001011100")
    scan = lit("ffda0008010100003f00" + "1234ff00560078" + "ffd9")
    return F.concat(lit("ffd8"), segment("e0", lit("4a46494600010201004800480000")), segment("e1", exif), notes, frame, scan, F.encode(F.lit("after the end"), "US-ASCII"))


def many_comments(spark: SparkSession, n_files: int, comments: int = 700) -> DataFrame:
    """file_id, name, declared_type, content: pictures with more comments than a list of findings shows."""
    notes = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(comments - 1)), lambda i: segment("fe", F.encode(F.concat(F.lit("made-up note "), i), "UTF-8"))), lit(""), lambda a, b: F.concat(a, b))
    data = F.concat(lit("ffd8"), notes, lit("ffc0000b080030004001011100"), lit("ffda0008010100003f00" + "1234ff00560078" + "ffd9"))
    return spark.range(n_files).select(F.col("id").cast("string").alias("file_id"), F.concat(F.lit("many"), "id", F.lit(".jpg")).alias("name"), F.lit(None).cast("string").alias("declared_type"), data.alias("content"))


def many_pages(spark: SparkSession, n_files: int, pages: int = 5000) -> DataFrame:
    """file_id, name, declared_type, content: documents with more pages than are read, each with an annotation."""
    kids = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(pages - 1)), lambda i: F.concat((i + 3).cast("string"), F.lit(" 0 R"))), " ")
    leaves = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(pages - 1)), lambda i: F.concat((i + 3).cast("string"), F.lit(" 0 obj\n<< /Type /Page /Parent 2 0 R /Annots [<< /Subtype /Text >>] >>\nendobj\n"))), "")
    data = F.concat(F.lit("%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids ["), kids, F.lit(f"] /Count {pages} >>\nendobj\n"), leaves, F.lit("trailer\n<< /Root 1 0 R >>\n%%EOF\n"))
    return spark.range(n_files).select(F.col("id").cast("string").alias("file_id"), F.concat(F.lit("pages"), "id", F.lit(".pdf")).alias("name"), F.lit(None).cast("string").alias("declared_type"), F.encode(data, "US-ASCII").alias("content"))


def chunk(name: str, body: Column) -> Column:
    typed = F.concat(F.encode(F.lit(name), "US-ASCII"), body)
    return F.concat(number(F.octet_length(body), 4), typed, number(F.crc32(typed), 4))


def png_of(text: Column) -> Column:
    """A PNG with the text in its text entries."""
    head = lit("00000008000000080802000000")
    return F.concat(
        lit("89504e470d0a1a0a"), chunk("IHDR", head), chunk("tEXt", F.concat(F.encode(F.lit("Author"), "US-ASCII"), lit("00"), F.encode(F.regexp_replace(text, "[^ -~]", "x"), "US-ASCII"))),
        chunk("iTXt", F.concat(F.encode(F.lit("Title"), "US-ASCII"), lit("0000000000"), F.encode(text, "UTF-8"))), chunk("IDAT", lit("789c030000000001")), chunk("IEND", lit("")),
    )


def pdf_of(text: Column) -> Column:
    title = F.regexp_replace(text, r"[()\\]", " ")
    return F.encode(F.concat(F.lit("%PDF-1.7\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R /OpenAction << /S /JavaScript /JS (x) >> >>\nendobj\n2 0 obj\n<< /Kids [] /Count 0 >>\nendobj\n3 0 obj\n<< /Title ("), title, F.lit(") >>\nendobj\ntrailer\n<< /Root 1 0 R /Info 3 0 R >>\n%%EOF\n")), "UTF-8")


def made_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of each document, of a format that its id picks."""
    docs = table(spark, sf_dir, "documents")
    t = F.col("text")
    kinds = (jpeg_of(t), png_of(t), pdf_of(t), F.encode(t, "UTF-8"))
    # a select for each kind: one expression for all would be too large to be compiled
    parts = [docs.where(F.col("doc_id") % 4 == k).select(F.col("doc_id").cast("string").alias("file_id"), F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("name"), F.lit(None).cast("string").alias("declared_type"), made.alias("content")) for k, made in enumerate(kinds)]
    return reduce(DataFrame.unionByName, parts)


def inspect_made_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J, E, P, F walkers, G1, G2: the listed findings of all files."""
    return model.capped(plan.findings_of(made_files(spark, sf_dir)))


def coverage_of_made_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R8."""
    return model.coverage_gaps(plan.coverage(plan.inspect(made_files(spark, sf_dir))))


def copies_of_made_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies without what is removed by default, checked; one row a check."""
    copies = plan.copy_inspected(plan.inspect(made_files(spark, sf_dir), ("content",)), default_only=True)
    # every copy has checks; explode() would filter by their number, for which they were worked out once more
    return copies.where("output IS NOT NULL").select("file_id", F.explode_outer("checks").alias("c")).select("file_id", "c.id", "c.status", "c.n")


QUERIES = {"inspect_made_files": inspect_made_files, "coverage_of_made_files": coverage_of_made_files, "copies_of_made_files": copies_of_made_files}
