r"""Operator 7: quality rules with cross-document line frequency, in DataFrame functions only.

Base rules look at one text: its words, symbols, repeated lines, and the words in windows of
eight words that the text has twice or more. A text fails with fewer than 20 words or more
than 30 % of its words in repeated windows.

The method then counts, for each host and normalised line (letters with their marks and digits only, in lower
case, hashed; a line that has none as its plain text without spaces; composed and decomposed letters differ), the distinct documents that have it, and
removes lines in at least LEAST_DOCS documents of the host and in at least SHARE of all of the host's. A document is
rejected if it is depleted: fewer than LEFT of its words remain.

Documents are told apart by their whole text: exact copies on a host are one document, near copies are several.

One scan works out the base rules and the lines' hashes of each document; the rest works on these. Hot hosts
and hot lines: counts are combined before every shuffle, first by (host, line, text), then by (host, line).
Lines above the limit, few as they are, are broadcast and looked up where the documents lie, so no text is
shuffled; where their bytes are too many they are joined by shuffle.

Cases: a null or empty text has no words and fails. A null host is a host of its own. Repeated
rows get equal results and count once. An empty table gives none. Lines of spaces
are never counted or removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkglass.llm.common import BROADCAST_BYTES, bind, cut, fits, light

SPACE = "[ \\t-\\r]"
WINDOW = 8
LEAST_WORDS, REPEAT_PERCENT = 20, 30
LEAST_DOCS, SHARE, LEFT = 10, 0.01, 0.3
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def windows_of(words: Column, n: int = WINDOW) -> Column:
    """The hash of each n-word window; none of a shorter text."""
    def of(w: Column) -> Column:
        count = F.size(w) - (n - 1)
        places = F.when(count > 0, F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.xxhash64(F.slice(w, i, n)))
    return bind(of, words)


def covered(windows: Column, n: int = WINDOW) -> Column:
    """Words in windows that occur twice or more. Sorted places of equal hashes stand side by side."""
    def marked(order: Column) -> Column:
        def twice(x: Column, i: Column) -> Column:
            return ((i > 0) & (F.get(order, i - 1)["h"] == x["h"])) | ((i < F.size(order) - 1) & (F.get(order, i + 1)["h"] == x["h"]))
        return F.array_sort(F.transform(F.filter(order, twice), lambda x: x["i"]))

    def total(h: Column) -> Column:
        order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1_000_000).alias("last"))
        return F.aggregate(
            bind(marked, order), start,
            lambda s, i: F.struct((s["n"] + F.least(F.lit(n), i - s["last"])).cast("long").alias("n"), i.alias("last")),
            lambda s: s["n"],
        )

    return bind(lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(total(h)), windows)


def normal(line: Column) -> Column:
    def of(low: Column) -> Column:
        return bind(lambda x: F.when(x != "", x).otherwise(F.regexp_replace(low, f"{SPACE}+", "")), F.regexp_replace(low, r"[^\p{L}\p{M}\p{N}]+", ""))
    return bind(of, F.lower(line))


def line_hash(line: Column) -> Column:
    """The hash of a normalised line; null for a line of spaces."""
    return bind(lambda n: F.when(n != "", F.xxhash64(n)), normal(line))


def named(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> list[Column]:
    """What tells a document: id, host and the hash of its text."""
    return [F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key")]


def facts(docs: DataFrame, id_col: str, text_col: str, host_col: str, whole: bool = False) -> DataFrame:
    """doc_id, host, key, the base rules' counts and lines: (hash, words) of each line in order; with row, the whole one."""
    row = [F.struct(*docs.columns).alias("row")] if whole else []
    own = docs.select(*row, *named(docs, id_col, text_col, host_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = own.withColumn("words", words_of(F.col("text"))).withColumn("parts", F.split("text", "\n"))
    full = F.filter("parts", lambda x: x.rlike("[^ \\t-\\r]"))
    return own.select(
        *(["row"] if whole else []), "doc_id", "host", "key", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        bind(lambda x: F.size(x) - F.size(F.array_distinct(x)), full).cast("long").alias("n_dup_lines"), covered(windows_of(F.col("words"))).alias("n_repeat_words"),
        F.transform("parts", lambda x: F.struct(line_hash(x).alias("hash"), F.size(words_of(x)).alias("words"))).alias("lines"),
    )


def lines_above(own: DataFrame, least_docs: int, share: float) -> DataFrame:
    """host, hash of the lines above the limit. A row without a line stands for the host itself."""
    hashes = F.array_distinct(F.filter(F.transform("lines", lambda x: x["hash"]), lambda h: h.isNotNull()))
    seen = own.select("host", "key", F.explode(F.concat(hashes, F.array(F.lit(None).cast("long")))).alias("hash")).distinct()
    counts = seen.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= least_docs) | F.col("hash").isNull())
    counts = cut(counts, "line-counts")
    often, hosts = counts.where("hash IS NOT NULL"), counts.where("hash IS NULL").select("host", F.col("n").alias("n_docs"))
    return often.alias("o").join(light(hosts).alias("t"), F.expr("o.host <=> t.host")).where(F.col("n") >= F.col("n_docs") * share).select("o.host", "hash")


def hits_in_place(own: DataFrame, above: DataFrame) -> DataFrame:
    """own with hits: (at, words) of its lines above the limit, looked up in the lines of its host, which are broadcast."""
    hosts = F.broadcast(above.groupBy("host").agg(F.collect_set("hash").alias("limits")))
    numbered = F.transform("lines", lambda x, i: F.struct(i.alias("at"), x["words"].alias("words"), x["hash"].alias("hash")))
    found = own.alias("b").join(hosts.alias("t"), F.expr("b.host <=> t.host"), "left")
    return found.select("b.*", F.filter(numbered, lambda x: F.array_contains("limits", x["hash"])).alias("hits"))


def hits_dealt(own: DataFrame, above: DataFrame) -> DataFrame:
    """The same for more lines above the limit than can be broadcast: joined by (host, line), then by document."""
    each = own.select("doc_id", "host", "key", F.posexplode("lines").alias("at", "x")).select("doc_id", "host", "key", "at", "x.hash", "x.words").where("hash IS NOT NULL")
    hits = each.alias("l").join(above.alias("a"), F.expr("l.host <=> a.host AND l.hash = a.hash"), "left_semi")
    hits = cut(hits.groupBy("doc_id", "key", "host").agg(F.collect_set(F.struct("at", "words")).alias("hits")), "line-hits")
    return own.alias("b").join(light(hits).alias("r"), F.expr("b.doc_id <=> r.doc_id AND b.key = r.key AND b.host <=> r.host"), "left").select("b.*", "hits")


def verdicts(own: DataFrame, least_docs: int, share: float, left: float, most: int = BROADCAST_BYTES) -> DataFrame:
    """facts() with gone (numbers of the lines to remove, null if none), n_removed_words, base_failed and kept."""
    above = cut(lines_above(own, least_docs, share), "lines-above")
    both = hits_in_place(own, above) if fits(above, most) else hits_dealt(own, above)
    gone = F.when(F.size("hits") > 0, F.transform("hits", lambda x: x["at"]))
    removed = F.coalesce(F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x["words"]), F.lit(0).cast("long"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    both = both.withColumns({"gone": gone, "n_removed_words": removed, "base_failed": failed})
    return both.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("n_removed_words") >= left * F.col("n_words")))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", least_docs: int = LEAST_DOCS, share: float = SHARE, left: float = LEFT) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed_words of every row."""
    own = cut(facts(docs, id_col, text_col, host_col), "line-facts")
    return verdicts(own, least_docs, share, left).select("doc_id", *BASE, "base_failed", "kept", "n_removed_words")


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", chars_col: str = "n_chars", least_docs: int = LEAST_DOCS, share: float = SHARE, left: float = LEFT) -> DataFrame:
    """The documents that are kept, without the lines above the limit; same columns as docs.
    A column of the text's length, where there is one, follows the text."""
    own = cut(facts(docs, id_col, text_col, host_col, whole=True), "line-documents")
    found = verdicts(own, least_docs, share, left).where("kept")
    text = F.col(f"row.{text_col}")
    clean = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n"))
    found = found.select("row", clean.alias("clean_text"))

    def column(c: str) -> Column:
        if c == text_col:
            return F.col("clean_text").alias(c)
        return F.length("clean_text").cast(dict(docs.dtypes)[c]).alias(c) if c == chars_col else F.col("row")[c].alias(c)

    return found.select(*map(column, docs.columns))
