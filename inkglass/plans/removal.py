"""Removal policy, differences between an original and its copy, and the ten checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkglass.functions import text

#: Format, group, on by default.
GROUPS = (
    ("jpeg", "exif", True), ("jpeg", "xmp", True), ("jpeg", "iptc", True), ("jpeg", "comments", True), ("jpeg", "other-segments", False), ("jpeg", "trailer", False),
    ("png", "png-text", True), ("png", "png-exif", True), ("png", "png-time", True), ("png", "png-unknown", False), ("png", "trailer", False),
)
CHECKS = (
    "format", "selected-removed", "nothing-new", "kept-as-planned", "picture-data", "display-data", "dimensions", "orientation", "original-untouched", "decode",
)


def groups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f, g, i, d) for i, (f, g, d) in enumerate(GROUPS)], "format string, grp string, place int, default_on boolean")


def group_ids(fmt: str) -> list[str]:
    return [g for f, g, _ in GROUPS if f == fmt]


def offered(findings: DataFrame, reports: DataFrame) -> DataFrame:
    """Groups that a file offers for removal: those with findings; none if copies are refused."""
    counts = findings.where("grp IS NOT NULL").groupBy("file_id", "grp").agg(F.count(F.lit(1)).alias("n"))
    fine = reports.where("copy_refusal IS NULL").select("file_id", "format")
    return counts.join(fine, "file_id").join(F.broadcast(groups(findings.sparkSession)), ["format", "grp"]).select("file_id", "grp", "place", "default_on", "n")


def offered_groups(found: Column, fmt: Column, refusal: Column, default_only: bool) -> Column:
    """The groups of offered() as an array, from one file's findings as findings.resolved() gives them; null where copies are not made."""
    out = F.when(refusal.isNotNull(), F.lit(None))
    for f in ("jpeg", "png"):
        out = out.when(fmt == f, F.array_intersect(F.transform(found, lambda x: x["grp"]), F.array(*(F.lit(g) for k, g, d in GROUPS if k == f and (d or not default_only)))))
    return out


def not_offered(selected: DataFrame, offers: DataFrame) -> DataFrame:
    """Chosen groups that a file doesn't offer; must be empty."""
    return selected.join(offers.select("file_id", "grp"), ["file_id", "grp"], "left_anti")


def selection_errors(files: DataFrame, selected: DataFrame, offers: DataFrame) -> DataFrame:
    """file_id, error, grp: `nothing-chosen` for files without a choice, `not-offered` for each chosen group that the file
    doesn't offer (once). A file without rows may be copied as chosen. Choices for files that aren't listed are not offered."""
    none = files.select("file_id").join(selected.where("grp IS NOT NULL").select("file_id"), "file_id", "left_anti").distinct()
    wrong = not_offered(selected.where("grp IS NOT NULL").select("file_id", "grp").distinct(), offers)
    return none.select("file_id", F.lit("nothing-chosen").alias("error"), F.lit(None).cast("string").alias("grp")).unionByName(wrong.select("file_id", F.lit("not-offered").alias("error"), "grp"))


def is_chosen(findings: DataFrame, selected: DataFrame) -> DataFrame:
    rows = findings.join(selected.select("file_id", "grp", F.lit(True).alias("__chosen")).distinct(), ["file_id", "grp"], "left")
    return rows.withColumn("removed", F.coalesce("__chosen", F.lit(False)) & (F.col("transformation") == "removable")).drop("__chosen")


def removed_by(findings: DataFrame, selected: DataFrame) -> DataFrame:
    return is_chosen(findings, selected).where("removed").drop("removed")


def remaining_after(findings: DataFrame, selected: DataFrame) -> DataFrame:
    """What a copy still has, structural facts left out."""
    return is_chosen(findings, selected).where("NOT removed AND category != 'structural'").drop("removed")


def differences(before: DataFrame, after: DataFrame, selected: DataFrame) -> DataFrame:
    """file_id, what (still-there, gone, new, lost), code, label, value: removals that did or didn't
    happen, findings only the copy has, and preserved findings that it lacks; a row for each finding.

    Two findings tell the same if file, code, label and value are equal, null values too. Both sides are counted
    by these in one pass."""
    marked = is_chosen(before, selected)
    kept = (F.col("transformation") == "preserved") & ~((F.col("code") == "exif.orientation") & F.coalesce(F.col("value").startswith("1"), F.lit(False)))
    told = ("file_id", "code", "label", "value")
    zero = F.lit(False)
    both = marked.select(*told, F.lit(True).alias("old"), "removed", kept.alias("kept")).unionByName(after.select(*told, zero.alias("old"), zero.alias("removed"), zero.alias("kept")))
    n = both.groupBy(*told).agg(F.count_if("old").alias("old"), F.count_if(~F.col("old")).alias("new"), F.count_if("removed").alias("removed"), F.count_if("kept").alias("kept"))
    there = F.col("new") > 0
    some = lambda what, count, when: F.array_repeat(F.lit(what), F.when(when, F.col(count)).otherwise(0).cast("int"))
    rows = F.concat(some("still-there", "removed", there), some("gone", "removed", ~there), some("new", "new", F.col("old") == 0), some("lost", "kept", ~there))
    return n.select("file_id", F.explode(rows).alias("what"), "code", "label", "value")


def checks_of(before: Column, after: Column, groups: Column) -> Column:
    """The checks of finding_checks() as an array of (id, status, n), from one file's findings and its copy's."""
    def key(f: Column) -> Column:  # of findings that tell the same
        return F.concat(f["code"], F.lit("\n"), F.length(f["label"]).cast("string"), F.lit("\n"), f["label"], F.coalesce(F.concat(F.lit("="), f["value"]), F.lit("")))

    def count(of: Column, those) -> Column:  # `those` is mostly empty
        return text.bind(lambda x: F.when(F.size(x) == 0, 0).otherwise(F.size(F.filter(of, lambda k: F.array_contains(x, k)))).cast("long"), those)

    removed = lambda f: F.coalesce(F.array_contains(groups, f["grp"]) & (f["transformation"] == "removable"), F.lit(False))
    kept = lambda f: (f["transformation"] == "preserved") & ~((f["code"] == "exif.orientation") & F.coalesce(f["value"].startswith("1"), F.lit(False)))

    def rows(x: Column) -> Column:
        numbers = (("selected-removed", count(x["removed"], F.array_intersect(x["removed"], x["new"]))), ("nothing-new", count(x["new"], F.array_except(x["new"], x["old"]))), ("kept-as-planned", count(x["kept"], F.array_except(x["kept"], x["new"]))))
        counted = F.array(*(F.struct(F.lit(i).alias("id"), n.alias("n")) for i, n in numbers))
        return F.transform(counted, lambda c: F.struct(c["id"].alias("id"), F.when(c["n"] == 0, "pass").otherwise("fail").alias("status"), c["n"].alias("n")))

    keys = lambda found: F.transform(found, key)
    return text.bind(rows, F.struct(keys(before).alias("old"), keys(after).alias("new"), keys(F.filter(before, removed)).alias("removed"), keys(F.filter(before, kept)).alias("kept")))


def finding_checks(files: DataFrame, diffs: DataFrame) -> DataFrame:
    """file_id, id, status, n of the three checks that compare findings."""
    n = diffs.groupBy("file_id").agg(*(F.count_if(F.col("what") == w).alias(k) for w, k in (("still-there", "selected-removed"), ("new", "nothing-new"), ("lost", "kept-as-planned"))))
    rows = files.select("file_id").join(n, "file_id", "left")
    one = lambda k: F.struct(F.lit(k).alias("id"), F.coalesce(F.col(f"`{k}`"), F.lit(0)).alias("n"))
    rows = rows.select("file_id", F.explode(F.array(*map(one, ("selected-removed", "nothing-new", "kept-as-planned")))).alias("x"))
    return rows.select("file_id", "x.id", F.when(F.col("x.n") == 0, "pass").otherwise("fail").alias("status"), "x.n")


def with_verdict(checks: DataFrame) -> DataFrame:
    """checks with all_passed, the verdict of their file, over its few rows."""
    return checks.withColumn("all_passed", F.bool_and(F.col("status") != "fail").over(W.partitionBy("file_id")))


def verdict(checks: DataFrame) -> DataFrame:
    """file_id, all_passed: no check has failed; skipped ones don't count as passed or failed."""
    return checks.groupBy("file_id").agg(F.bool_and(F.col("status") != "fail").alias("all_passed"), F.count_if(F.col("status") == "skipped").alias("skipped"))


def byte_accounting(manifest: DataFrame) -> DataFrame:
    """file_id and bytes by action; input - removed - rewritten-from + rewritten-to = output."""
    b = lambda a: F.coalesce(F.sum(F.when(F.col("action") == a, F.col("bytes"))), F.lit(0)).cast("long")
    return manifest.groupBy("file_id").agg(b("keep").alias("kept"), b("remove").alias("removed"), b("rewrite-from").alias("rewritten_from"), b("rewrite-to").alias("rewritten_to"))
