r"""Operator 3: line dedup by a segment-partition edit join, in DataFrame functions only.

Lines are the \n-split parts of a text without outer spaces; they are compared by their
characters. The first occurrence of a line is the one with the smallest (id, line number),
null ids first. An occurrence is removed if

* the same line occurs earlier, or
* it is near a different line whose first occurrence is earlier: within one edit for each
  CHARS_PER_EDIT characters of the shorter line, EDITS at most.

The join: with at most e edits, one of e + 1 segments of the shorter line stands unchanged in
the longer one, at a place that the difference in length and the segment's number bound. Each
different line is filed under its own segments and probes with the substrings that could be
segments of lines of its length or up to e shorter. A key holds length, number and substring as
a hash (keyed()). Of two lines of one length each probes for the other, so with e up to 2 shifts to the
right are enough: if only the middle segment of one is unchanged and stands further left in the
other, then a segment of the other is unchanged and stands in place or further right.

Candidates come in two steps, neither of which makes pairs of the many lines that may share a
segment: probes are matched with the filed keys (each key once), which leaves the lines with a
match. Only these get counts of twenty characters (an edit changes two at most), which the join
of pairs compares, so lines that share boilerplate but differ more are not emitted. Pairs are
then verified by bit-parallel edit distance over a diagonal band (verified()).

Hot lines: equal lines are combined before and after the shuffle, so a line enters the join
once however often it occurs.

Cases: null texts have one empty line; empty lines are counted and never removed. Lines of fewer
than CHARS_PER_EDIT characters are near none. Repeated rows share their place and are treated
alike. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkglass.llm.common import bind, cut, light

EDITS, CHARS_PER_EDIT = 2, 10
#: Characters whose counts (6 bits each, modulo 64) the two signatures hold.
COUNTED = (" entoirhsa", "ludcmpgfyw")
#: Bytes of a character in UTF-32.
WIDE = 4


def signature(line: Column, letters: str) -> Column:
    parts = [F.shiftleft(((F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))) % 64).cast("long"), 6 * k) for k, c in enumerate(letters)]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def apart(a: str, b: str) -> str:
    """SQL: a lower bound of the summed difference of two signatures' counts."""
    one = [f"((shiftright({a}, {6 * k}) & 63) - (shiftright({b}, {6 * k}) & 63) + 64) % 64" for k in range(10)]
    return " + ".join(f"least({d}, 64 - {d})" for d in one)


def allowed(length: Column, edits: int, chars: int) -> Column:
    """Edits within which a line of this length and a longer one are near."""
    return F.least(F.lit(edits), F.floor(length / chars).cast("int"))


def ways(edits: int, less: int) -> list[tuple[int, int]]:
    """(segment, shift): where a line's own segments may stand in one that is `less` characters longer."""
    found = [(i, shift) for i in range(edits + 1) for shift in range(max(-i, less - (edits - i)), min(i, less + edits - i) + 1)]
    return [(i, shift) for i, shift in found if less or edits > 2 or shift >= 0]


def slots(edits: int) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int, int]]]:
    """Keys under which a line is filed, and those with which it probes (besides): how many characters shorter
    the lines of the key are, segment, shift, and the fewest edits with which lines have it (with more they do too)."""
    fewest = {(less, i, shift): e for e in range(edits, 0, -1) for less in range(e + 1) for i, shift in ways(e, less)}
    own = [(0, i, 0, max(i, 1)) for i in range(edits + 1)]
    return own, [(*place, e) for place, e in sorted(fewest.items()) if place[0] or place[2]]


def keyed(lines: DataFrame, edits: int, chars: int) -> tuple[DataFrame, list[str], list[str]]:
    """h1 and the keys of lines (h1, line, length), and the names of those under which a line is filed and of
    those with which it probes. A key holds the length of lines, the number of a segment and the characters that
    stand in its place in this line; null where the line has no such place. Of n segments, i begins at floor(i * length / n).

    Substrings are taken of the line in UTF-32, four bytes a character: in UTF-8 each would count the characters
    from the line's start. The code for a line is kept small, because the JVM only interprets methods of more than
    8,000 bytes: what several keys need is a column, and a key checks only what its place leaves open."""
    own, others = slots(edits)
    names = [f"own{k}" for k in range(len(own))] + [f"other{k}" for k in range(len(others))]
    lengths = range(edits + 1)
    steps = lines.select("h1", F.encode("line", "UTF-32").alias("wide"), "length", *((F.col("length") - less).alias(f"shorter{less}") for less in lengths))
    steps = steps.select("*", *(allowed(F.col(f"shorter{less}"), edits, chars).alias(f"e{less}") for less in lengths))

    def begin(less: int, i: int) -> Column:
        """Where segment i begins or the one before ends, in lines that have either."""
        shorter = F.col(f"shorter{less}")
        by_edits = {e: shorter if i > e else (F.lit(float(i)) * shorter / (e + 1)).cast("int") for e in range(max(i - 1, less, 1), edits + 1)}
        return reduce(lambda more, e: F.when(F.col(f"e{less}") == e, by_edits[e]).otherwise(more), range(edits - 1, min(by_edits) - 1, -1), by_edits[edits])

    steps = steps.select("*", *(begin(less, i).alias(f"begin{less}_{i}") for less in lengths for i in range(1, edits + 2)))

    def key(less: int, i: int, shift: int, fewest: int) -> Column:
        start, end = F.col(f"begin{less}_{i}") if i else F.lit(0), F.col(f"begin{less}_{i + 1}")
        there = F.col(f"e{less}") >= fewest
        if shift < 0:
            there &= start >= -shift
        if shift > less:
            there &= end <= F.col("length") - shift
        return F.when(there, F.xxhash64(F.col(f"shorter{less}"), F.lit(i), F.substring("wide", (start + shift) * WIDE + 1, (end - start) * WIDE)))

    return steps.select("h1", *(key(*slot).alias(name) for name, slot in zip(names, own + others, strict=True))), names[: len(own)], names[len(own) :]


def verified(longer: Column, shorter: Column, edits: int) -> Column:
    """If two lines (arrays of characters, the longer one first, at most `edits` longer) are within
    `edits`: bit vectors of vertical differences over the diagonals -edits-1 to edits, which move
    down one row with every character of the shorter line."""
    return bind(lambda two: within(two["longer"], two["shorter"], edits), F.struct(longer.alias("longer"), shorter.alias("shorter")))


def within(longer: Column, shorter: Column, edits: int) -> Column:
    """verified() for two lambda variables."""
    width = 2 * edits + 3
    full = (1 << width) - 1
    m, n = F.size(longer), F.size(shorter)
    top = F.lit(1 << (width - 1))
    invert = lambda x: x.bitwiseXOR(F.lit(full))

    def step(s: Column, i: Column) -> Column:
        c = F.get(shorter, i)
        bits = [F.when(F.get(longer, i + (edits - width + 1 + b)) == c, F.lit(1 << b)).otherwise(F.lit(0)) for b in range(width)]
        return F.struct(
            s["up"].alias("up"), s["down"].alias("down"), s["d"].alias("d"), s["edge"].alias("edge"), i.alias("i"),
            reduce(lambda a, b: a + b, bits).alias("match"),
        )

    def diagonal(s: Column) -> Column:
        x = s["match"]
        return F.struct(*[s[c].alias(c) for c in ("up", "down", "d", "edge", "i")], x.bitwiseAND(s["up"]).__add__(s["up"]).bitwiseXOR(s["up"]).bitwiseOR(x).bitwiseOR(s["down"]).bitwiseAND(F.lit(full)).alias("zero"))

    def across(s: Column) -> Column:
        plus = s["down"].bitwiseOR(invert(s["zero"].bitwiseOR(s["up"])))
        minus = s["zero"].bitwiseAND(s["up"])
        return F.struct(*[s[c].alias(c) for c in ("d", "edge", "i", "zero")], plus.alias("plus"), minus.alias("minus"))

    def close(s: Column) -> Column:
        on_diagonal = s["i"] < m - edits
        half = F.shiftrightunsigned(s["zero"], 1)
        d = F.when(on_diagonal, s["d"] + F.when(s["zero"].bitwiseAND(top) == 0, 1).otherwise(0)).otherwise(
            s["d"] + F.when(s["plus"].bitwiseAND(s["edge"]) != 0, 1).otherwise(0) - F.when(s["minus"].bitwiseAND(s["edge"]) != 0, 1).otherwise(0))
        edge = F.when(on_diagonal, s["edge"]).otherwise(F.shiftrightunsigned(s["edge"], 1))
        return F.struct(
            s["minus"].bitwiseOR(invert(half.bitwiseOR(s["plus"]))).alias("up"),
            half.bitwiseAND(s["plus"]).alias("down"), d.alias("d"), edge.alias("edge"),
        )

    start = F.struct(F.lit(((1 << (edits + 1)) - 1) << (width - edits - 1)).alias("up"), F.lit(0).alias("down"), F.lit(edits).alias("d"), F.lit(1 << (width - 2)).alias("edge"))
    merge = lambda s, i: bind(close, bind(across, bind(diagonal, step(s, i))))
    return (m - n <= edits) & (F.aggregate(F.sequence(F.lit(0), n - 1), start, merge, lambda s: s["d"]) <= edits)


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key (of the text), at, line, h1, h2 (two hashes of the line), for lines that are not empty."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = own.select("doc_id", F.xxhash64("text").alias("key"), F.posexplode(F.transform(F.split("text", "\n"), lambda x: F.trim(x))).alias("at", "line")).where("line != ''")
    return rows.select("doc_id", "key", "at", "line", F.length("line").alias("length"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))


def line_pairs(lines: DataFrame, edits: int, chars: int) -> DataFrame:
    """h1_a, h2_a, first_a, line_a and the same of b: pairs of different lines that share a key and whose
    counts don't prove them apart."""
    long = lines.where(F.col("length") >= chars)
    filed, own, others = keyed(long, edits, chars)
    names = own + others
    # keys follow from the line: any occurrence's are right
    filed = filed.groupBy("h1").agg(*(F.max(n).alias(n) for n in names))
    filed = cut(filed, "line-keys")

    def listed(columns: list[str]) -> DataFrame:
        return filed.select("h1", F.explode(F.array(*columns)).alias("k")).where("k IS NOT NULL")

    index = listed(own)
    once = index.groupBy("k").agg(F.min("h1").alias("one"), F.max("h1").alias("two"))
    found = listed(names).join(once, "k").where("one != two OR one != h1")
    found = cut(found.select("k", "h1"), "line-probes")
    matched = light(cut(found.select("k").distinct(), "line-matched"))
    index = cut(index.join(matched, "k", "left_semi"), "line-index")

    members = light(cut(found.select("h1").union(index.select("h1")).distinct(), "line-members"))
    texts = long.join(members, "h1", "left_semi").groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.max("line").alias("line"))
    texts = cut(texts.withColumns({f"counts{k}": signature(F.col("line"), x) for k, x in enumerate(COUNTED)}), "line-texts")
    counts = light(texts.select("h1", "counts0", "counts1"))
    i, p = index.join(counts, "h1").alias("i"), found.join(counts, "h1").alias("p")
    near = f"{apart('i.counts0', 'p.counts0')} + {apart('i.counts1', 'p.counts1')} <= {2 * edits}"
    pairs = i.join(p, F.expr(f"i.k = p.k AND i.h1 != p.h1 AND {near}")).select(F.least("i.h1", "p.h1").alias("a"), F.greatest("i.h1", "p.h1").alias("b"))
    pairs = cut(pairs.distinct(), "line-pairs")
    one, two = (texts.select(*(F.col(c).alias(f"{c}_{x}") for c in ("h1", "h2", "first", "line"))) for x in "ab")
    return pairs.join(one, F.col("a") == F.col("h1_a")).join(two, F.col("b") == F.col("h1_b"))


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, chars: int = CHARS_PER_EDIT) -> DataFrame:
    """doc_id, key, gone: numbers (from 0) of the lines to remove, for documents that have such lines."""
    lines = lines_of(docs, id_col, text_col)
    again = cut(lines.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2", "first"), "lines-again")

    found = line_pairs(lines, edits, chars)
    swap = F.length("line_a") < F.length("line_b")
    longer, shorter = F.when(swap, F.col("line_b")).otherwise(F.col("line_a")), F.when(swap, F.col("line_a")).otherwise(F.col("line_b"))
    found = found.select("h1_a", "h2_a", "h1_b", "h2_b", "first_a", "first_b", F.split(longer, "").alias("longer"), F.split(shorter, "").alias("shorter"))
    # verified() is for one number of edits: each pair takes its own
    e = allowed(F.size("shorter"), edits, chars)
    fits = reduce(lambda rest, n: F.when(e == n, (F.size("longer") - F.size("shorter") <= n) & verified(F.col("longer"), F.col("shorter"), n)).otherwise(rest), range(1, edits + 1), F.lit(False))
    found = found.where(fits)
    later = F.col("first_a") < F.col("first_b")
    near = cut(found.select(F.when(later, F.col("h1_b")).otherwise(F.col("h1_a")).alias("h1"), F.when(later, F.col("h2_b")).otherwise(F.col("h2_a")).alias("h2")).distinct(), "lines-near")

    # equal lines: all but the first go; near lines: all go
    drop = again.join(near, ["h1", "h2"], "left_anti").unionByName(near.withColumn("first", F.lit(None).cast(again.schema["first"].dataType)))
    drop = cut(drop, "lines-drop")
    hits = lines.select("doc_id", "key", "at", "h1", "h2").join(light(drop), ["h1", "h2"])
    gone = hits.where(F.col("first").isNull() | ~F.struct("doc_id", "at").eqNullSafe(F.col("first")))
    return gone.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("at")).alias("gone"))


def with_removed(docs: DataFrame, id_col: str, text_col: str, columns: list[Column], **options) -> DataFrame:
    gone = removed_lines(docs, id_col, text_col, **options)
    own = docs.select(*columns, F.col(id_col).alias("__id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__key"))
    return own.join(gone.select(F.col("doc_id").alias("__doc"), F.col("key").alias("__of"), "gone"), F.expr("__id <=> __doc AND __key = __of"), "left")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_lines (that are not empty), n_removed, removed (line numbers from 0, ascending)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")).cast("long").alias("n_lines")
    found = with_removed(docs, id_col, text_col, [F.col(id_col).alias("doc_id"), n], **options)
    return found.select("doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("gone", F.array().cast("array<int>")).alias("removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", **options) -> DataFrame:
    """docs without the removed lines; all rows and columns stay, a column of the text's length follows it."""
    found = with_removed(docs, id_col, text_col, [F.struct(*docs.columns).alias("__row")], **options)
    lines = F.split(F.col("__row")[text_col], "\n")
    found = found.select("__row", F.when(F.col("gone").isNull(), F.col("__row")[text_col]).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("gone", i)), "\n")).alias("__text"))

    def column(c: str) -> Column:
        if c == text_col:
            return F.col("__text").alias(c)
        return F.length("__text").cast(dict(docs.dtypes)[c]).alias(c) if c == chars_col else F.col("__row")[c].alias(c)

    return found.select(*map(column, docs.columns))
