"""Counts of watched name tokens in raw PDF bytes (or any text), by DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names whose number tells something, ascending.
WATCHED = (
    "3D", "AA", "AcroForm", "Annots", "ByteRange", "EmbeddedFile", "EmbeddedFiles", "Encrypt", "GoToE", "GoToR", "ImportData", "JS", "JavaScript",
    "Launch", "Linearized", "Metadata", "Movie", "OCProperties", "ObjStm", "OpenAction", "RichMedia", "Sound", "SubmitForm", "URI", "XFA",
)
STOP = r"\x00\t\n\f\r ()<>\[\]{}/%"


def unescaped(token: Column) -> Column:
    """#xx as its character."""
    parts = F.split(token, "(?=#[0-9A-Fa-f]{2})")
    one = lambda p: F.when(p.rlike("^#[0-9A-Fa-f]{2}"), F.concat(F.decode(F.unhex(F.substring(p, 2, 2)), "ISO-8859-1"), F.substring(p, 4, 100))).otherwise(p)
    return F.array_join(F.transform(parts, one), "")


def names(text: Column) -> Column:
    """Name tokens after each slash, 48 characters at most."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"/([^{STOP}]{{1,48}})"), F.lit(1)), unescaped)


def counts(rows: DataFrame, key: str, text: Column, watched: tuple[str, ...] | None = WATCHED) -> DataFrame:
    """key, token, n."""
    found = rows.select(key, F.explode(names(text)).alias("token"))
    if watched:
        found = found.where(F.col("token").isin(*watched))
    return found.groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))


def raw_facts(content: Column) -> Column:
    """version, eof_count, eof_at_end, id_first, id_second, revisions of a PDF's bytes."""
    text = F.decode(content, "ISO-8859-1")
    ids = F.regexp_extract_all(text, F.lit(r"/ID\s*\[\s*<([0-9A-Fa-f\s]*)>\s*<([0-9A-Fa-f\s]*)>"), F.lit(1))
    seconds = F.regexp_extract_all(text, F.lit(r"/ID\s*\[\s*<([0-9A-Fa-f\s]*)>\s*<([0-9A-Fa-f\s]*)>"), F.lit(2))
    n = F.regexp_count(text, F.lit("%%EOF"))
    straight = F.when(F.contains(text, F.lit("/Linearized")), 2).otherwise(1)
    return F.struct(
        F.regexp_extract(F.decode(F.substring(content, 1, 1032), "ISO-8859-1"), r"%PDF-(\d\.\d)", 1).alias("version"), n.alias("eof_count"),
        F.contains(F.right(text, F.lit(1024)), F.lit("%%EOF")).alias("eof_at_end"), F.try_element_at(ids, F.lit(-1)).alias("id_first"), F.try_element_at(seconds, F.lit(-1)).alias("id_second"),
        F.greatest(F.lit(0), n - straight).alias("revisions"),
    )
