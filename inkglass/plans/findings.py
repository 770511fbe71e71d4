"""The finding model: catalogue lookup, the cap, identities and rollups."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkglass.functions import limits, text
from inkglass.functions.catalog import CATEGORIES, catalog, entries

#: Codes that are listed beyond the cap.
ESSENTIAL = tuple(f"{fmt}.{what}" for fmt in ("jpeg", "png", "pdf") for what in ("limit", "truncated", "invalid-segment", "invalid", "trailing-data", "order", "malformed"))


def optional(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(f"r.{name}") if name in df.columns else F.lit(None).cast(kind)


def resolve(raw: DataFrame, shown: bool = False) -> DataFrame:
    """Raw findings (file_id, seq, code, value, source and overrides) with their catalogue entry. shown: values are display texts already,
    as where one long value was made shorter before its findings.

    An override of '-' for the group means none. A code that the catalogue lacks is an error."""
    joined = raw.alias("r").join(F.broadcast(catalog(raw.sparkSession)).alias("c"), "code", "left")
    group = F.when(optional(raw, "grp") == "-", None).otherwise(F.coalesce(optional(raw, "grp"), "c.grp"))
    own = F.when(group.isNotNull(), "removable").otherwise(F.when(F.col("c.grp").isNull(), F.col("c.transformation")).otherwise("unsupported"))
    out = joined.select(
        "r.file_id", "r.seq", F.when(F.col("c.category").isNull(), F.raise_error(F.concat(F.lit("unknown finding code "), "code"))).otherwise(F.col("code")).alias("code"),
        F.coalesce(optional(raw, "category"), "c.category").alias("category"), F.coalesce(optional(raw, "label"), "c.label").alias("label"), (F.col("r.value") if shown else text.display_text(F.col("r.value"))).alias("value"), "r.source",
        F.coalesce(optional(raw, "kind"), F.lit("none")).alias("kind"), optional(raw, "offset", "long").alias("offset"), optional(raw, "length", "long").alias("length"), optional(raw, "path").alias("path"),
        F.coalesce(optional(raw, "status"), F.lit("verified")).alias("status"), F.coalesce(optional(raw, "confidence"), F.lit("high")).alias("confidence"), F.col("c.privacy").alias("privacy"),
        group.alias("grp"), F.coalesce(optional(raw, "transformation"), own).alias("transformation"),
    )
    return out.withColumn("removable", F.col("transformation") == "removable")


TOLD = ("code", "category", "label", "value", "grp", "transformation")


def resolved(found: Column, columns: tuple[str, ...] = TOLD) -> Column:
    """What resolve() makes of one file's raw findings, as an array of these columns: code, category, label, value, grp, transformation.
    A lambda's fields are all worked out, so a caller names those that it needs."""
    known = json.dumps({code: {"category": category, "label": label, "grp": grp, "transformation": transformation} for code, category, label, _, grp, transformation in entries()})
    known = F.from_json(F.lit(known), "map<string,struct<category:string,label:string,grp:string,transformation:string>>")  # a constant

    def one(f: Column) -> Column:
        def row(c: Column) -> Column:
            group = F.when(f["grp"] == "-", None).otherwise(F.coalesce(f["grp"], c["grp"]))
            own = F.when(group.isNotNull(), "removable").otherwise(F.when(c["grp"].isNull(), c["transformation"]).otherwise("unsupported"))
            made = {
                "code": f["code"], "category": F.coalesce(f["category"], c["category"]), "label": F.coalesce(f["label"], c["label"]), "value": text.display_text(f["value"]),
                "grp": group, "transformation": F.coalesce(f["transformation"], own),
            }
            return F.struct(*(made[n].alias(n) for n in columns))

        return text.bind(row, F.coalesce(F.try_element_at(known, f["code"]), F.raise_error(F.concat(F.lit("unknown finding code "), f["code"]))))

    return F.transform(found, one)


def capped(findings: DataFrame, most: int = limits.FINDINGS, more: int = limits.ESSENTIAL_MORE) -> DataFrame:
    """The findings that a list of `most` shows, with one notice where the first is refused.

    Ordinary findings stop at `most` rows, essential ones at most + more, the notice counted. Per
    file: rows up to rank `most` are listed; later essential ones are, as long as their number and
    a notice that ordinary ones before them have caused leave room. New column id; seq stays."""
    by = W.partitionBy("file_id").orderBy("seq")
    ranked = findings.withColumn("rank", F.row_number().over(by)).withColumn("essential", F.col("code").isin(*ESSENTIAL) | F.col("code").startswith("image."))
    so_far = by.rowsBetween(W.unboundedPreceding, 0)
    late = F.col("rank") > most
    ranked = ranked.withColumn("e", F.sum(F.when(late & F.col("essential"), 1).otherwise(0)).over(so_far)).withColumn("o", F.max(F.when(late & ~F.col("essential"), 1).otherwise(0)).over(so_far))
    ranked = ranked.withColumn("listed", ~late | (F.col("essential") & (most + F.col("e") - 1 + F.col("o") < most + more)))
    ranked = ranked.withColumn("refusals", F.sum(F.when(~F.col("listed"), 1).otherwise(0)).over(so_far))
    first = (~F.col("listed")) & (F.col("refusals") == 1)
    notice = {
        "code": F.lit("limit.findings"), "category": F.lit("unsupported"), "label": F.lit("Findings beyond the list"), "value": F.lit(f"Not more than {most} are listed."),
        "source": F.lit("Finding limit"), "kind": F.lit("none"), "status": F.lit("unsupported"), "confidence": F.lit("high"), "removable": F.lit(False), "transformation": F.lit("unsupported"),
        "privacy": F.lit("The file holds more items than are listed."), "offset": F.lit(None).cast("long"), "length": F.lit(None).cast("long"), "path": F.lit(None).cast("string"), "grp": F.lit(None).cast("string"),
    }
    shown = ranked.where(F.col("listed") | first)
    out = shown.select("file_id", "seq", *(F.when(F.col("listed"), F.col(c)).otherwise(notice[c]).alias(c) if c in notice else F.col(c) for c in findings.columns if c not in ("file_id", "seq")))
    number = F.row_number().over(by).cast("string")
    return out.withColumn("id", F.concat(F.when(F.col("code") == "limit.findings", "limit").otherwise(F.col("code")), F.lit("#"), number))


def category_counts(findings: DataFrame) -> DataFrame:
    """file_id, category, n, rank (of presentation)."""
    order = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category")).cast("int")
    return findings.groupBy("file_id", "category").agg(F.count(F.lit(1)).alias("n")).withColumn("rank", order)


def presented(findings: DataFrame) -> DataFrame:
    """Findings with their place: by category, limit notices first, then as found."""
    order = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category")).cast("int")
    limit = (F.col("code") == "limit.findings") | F.col("code").rlike(r"\.limit$")
    return findings.withColumn("place", F.row_number().over(W.partitionBy("file_id").orderBy(order, limit.cast("int").desc(), "seq")))


def bounded(rows: DataFrame, key: str, order: str, whole: int = 12, first: int = 10, step: int = 50, steps: int = 0) -> DataFrame:
    """The rows of a list that are shown: all up to `whole`, else the first ones and `steps` steps more."""
    n = F.count(F.lit(1)).over(W.partitionBy(key))
    rank = F.row_number().over(W.partitionBy(key).orderBy(order))
    return rows.withColumn("n", n).withColumn("rank", rank).where((F.col("n") <= whole) | (F.col("rank") <= first + step * steps))


def share_notes(findings: DataFrame) -> DataFrame:
    """Up to ten notes a file about the kinds of information found: file_id, place, id, category, n, names.

    names lists labels in the order they were found, four at most; it is null for notes that have
    none. Structural facts get no note."""
    gps = F.col("code") == "exif.gps-position"
    limit = (F.col("code") == "limit.findings") | F.col("code").rlike(r"\.limit$")
    c = F.col("category")
    note = (
        F.when((c == "location") & gps, "gps").when(c == "location", "place").when(c == "identity", "identity").when(c == "time", "time").when(c == "device-software", "device")
        .when(c == "document-properties", "properties").when(c == "embedded-content", "embedded").when(c == "active-features", "active").when((c == "unsupported") & limit, "limits").when(c == "unsupported", "unsupported")
    )
    ids = ("gps", "place", "identity", "time", "device", "properties", "embedded", "active", "limits", "unsupported")
    named = ("place", "identity", "time", "device", "properties", "embedded", "unsupported")
    rows = findings.withColumn("note", note).where("note IS NOT NULL")
    # names once each before they are gathered: there are as many as the catalogue has labels
    labels = rows.groupBy("file_id", "note", "label").agg(F.min("seq").alias("at")).groupBy("file_id", "note").agg(F.array_sort(F.collect_list(F.struct("at", "label"))).alias("names"))
    sums = rows.groupBy("file_id", "note").agg(
        F.first("category").alias("category"), F.count(F.lit(1)).alias("all"), F.count_if(F.col("status") == "verified").alias("fine"), F.max(F.coalesce(F.contains("value", F.lit("°")), F.lit(False))).alias("decoded"),
    )
    both = sums.join(labels, ["file_id", "note"])
    n = F.when((F.col("note") == "gps") & (F.col("fine") > 0), F.col("fine")).otherwise(F.col("all"))
    kind = F.when((F.col("note") == "gps") & (F.col("fine") > 0), "position").when((F.col("note") == "gps") & F.col("decoded"), "out-of-range").when(F.col("note") == "gps", "undecodable")
    names = F.when(F.col("note").isin(*named), text.list_names(F.transform("names", lambda x: text.lower_first(x["label"]))))
    return both.select("file_id", F.array_position(F.array(*map(F.lit, ids)), F.col("note")).cast("int").alias("place"), F.col("note").alias("id"), "category", n.alias("n"), kind.alias("detail"), names.alias("names"))


def kinds_text(notes: DataFrame) -> DataFrame:
    """file_id and one sentence of the categories that have notes."""
    rows = notes.where("category != 'unsupported'").groupBy("file_id", "category").agg(F.min("place").alias("place"))
    listed = rows.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("place", "category"))).alias("c"))
    return listed.select("file_id", F.concat(F.lit("Found in this file: "), F.array_join(F.transform("c", lambda x: F.replace(x["category"], F.lit("-"), F.lit(" "))), ", "), F.lit(".")).alias("kinds"))


def file_map(findings: DataFrame, sizes: DataFrame) -> DataFrame:
    """Left edge and width, in percent of the file, of each finding with a byte range."""
    rows = findings.where("kind = 'bytes'").join(sizes.select("file_id", "size"), "file_id")
    size = F.greatest("size", F.lit(1))
    return rows.select("file_id", "seq", "category", F.least(F.lit(99.4), 100.0 * F.col("offset") / size).alias("left_pct"), F.greatest(F.lit(0.6), 100.0 * F.col("length") / size).alias("width_pct"))


def coverage_gaps(coverage: DataFrame) -> DataFrame:
    return coverage.groupBy("file_id").agg(F.count_if(F.col("state") != "inspected").alias("gaps"), F.count(F.lit(1)).alias("areas"))


def support_label(fmt: Column, copy_refusal: Column) -> Column:
    return F.when(fmt.isin("pdf", "docx"), "inspection only").when(fmt.isNull(), "not supported").when(copy_refusal.isNotNull(), "inspection only for this file").otherwise("inspection and copy")
