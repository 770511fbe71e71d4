r"""Operator 2: quotation linking for conversations, in DataFrame functions only.

A line's quote level is the number of > at its start (spaces between them do not count). Lines
of one level that stand together form a run. A message's own lines are those of level 0, without
attributions ("On ... wrote:" right before a quoted line); a run of a higher level is a quoted
passage. Lines are normalised (without quote marks, lower case, letters with their marks
and digits only) and hashed; a passage's hash is that of its joined lines, and each of
its lines has one too. Originals are indexed by their own lines and own runs.

The message itself and later turns of its conversation are never originals. An original with the
passage as a whole wins: the smallest earlier turn of the same conversation, else the smallest
(conversation, turn) elsewhere, for which the two smallest conversations of a hash are enough.
For the other passages the lines are joined to all their originals, and the original with most
lines wins; among equals an earlier turn of the same conversation, then the smallest.

Hot hashes: passages with the same lines are joined once, originals of a hash are combined
before, and those of a hash with more than SALT_ROWS are dealt to several parts. Lines that stand in many passages
and many originals are looked up only where a rarer line has found an original (see by_lines). Of each passage
the two best conversations are kept (the best may be the message's own), and its originals in
conversations that quote it.

A message replies to the original of its first passage of the lowest level, if that is an
earlier turn of its conversation. `root_turn` and `depth` come from doubling parent pointers,
so reply order in a conversation is (root_turn, depth, turn). clean_text has the own lines.

Cases: null or empty texts have no passages and an empty clean text. Null conversations or
turns are never linked to. Repeated messages count as one original and give repeated rows.
An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkglass.llm.common import bind, cut

#: Originals of a hash in one part of the join.
SALT_ROWS = 1000
#: A line that would bring more votes than this (passages that quote it times originals that have it) is common.
COMMON_PAIRS = 1_000_000
#: One character class, not a group in a loop: Java's matcher would nest once a mark.
MARKS = "^[ \\t>]*>[ \\t]?"
#: How mail programs introduce what they quote.
ATTRIBUTION = r"^[ \t]*(?:On[ \t].*[ \t]wrote|Am[ \t].*[ \t]schrieb.*|Le[ \t].*[ \t]a \u00e9crit|El[ \t].*[ \t]escribi\u00f3)[ \t]*:[ \t]*$"


def normal(line: Column) -> Column:
    return F.regexp_replace(F.lower(line), r"[^\p{L}\p{M}\p{N}]+", " ")


def parsed(messages: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Each message with its lines as (level, run, body, hash)."""
    own = messages.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def line(x: Column) -> Column:
        mark = F.regexp_extract(x, MARKS, 0)
        body = F.substring(x, F.length(mark) + 1, F.length(x))
        return F.struct((F.length(mark) - F.length(F.replace(mark, F.lit(">"), F.lit("")))).alias("level"), F.when(F.length(mark) > 0, body).otherwise(x).alias("body"))

    def runs(raw: Column) -> Column:
        change = lambda x, i: F.when((i == 0) | (F.get(raw, i - 1)["level"] != x["level"]), i).otherwise(F.lit(-1))
        # a run ends before the next start
        run = lambda starts, s, k: F.slice(raw, s + 1, F.coalesce(F.get(starts, k + 1), F.size(raw)) - s)
        one = lambda starts: lambda s, k: F.struct(F.get(raw, s)["level"].alias("level"), F.transform(run(starts, s, k), lambda x: F.trim(normal(x["body"]))).alias("lines"))
        return bind(lambda starts: F.transform(starts, one(starts)), F.filter(F.transform(raw, change), lambda i: i >= 0))

    def with_attributions(raw: Column) -> Column:
        """Level -1 for lines that introduce a quoted one."""
        introduces = lambda x, i: (x["level"] == 0) & (F.coalesce(F.get(raw, i + 1)["level"], F.lit(0)) > 0) & x["body"].rlike(ATTRIBUTION)
        return F.transform(raw, lambda x, i: F.struct(F.when(introduces(x, i), -1).otherwise(x["level"]).alias("level"), x["body"].alias("body")))

    own = own.withColumn("raw", bind(with_attributions, F.transform(F.split("text", "\n"), line))).withColumn("runs", bind(runs, F.col("raw")))
    clean = F.array_join(F.transform(F.filter("raw", lambda x: x["level"] == 0), lambda x: x["body"]), "\n")
    return own.withColumn("clean_text", clean).select("conv_id", "turn", "role", "text", "clean_text", "raw", "runs")


def hashes(lines: Column) -> Column:
    """(hash, weight) of a run's lines with words and of the run as a whole."""
    full = F.filter(lines, lambda x: x != "")
    whole = F.when(F.size(full) > 0, F.array(F.struct(F.xxhash64(F.array_join(full, " ")).alias("h"), F.lit(1_000_000).alias("w")))).otherwise(F.array().cast("array<struct<h:bigint,w:int>>"))
    return F.concat(whole, F.when(F.size(full) > 1, F.transform(full, lambda x: F.struct(F.xxhash64(x).alias("h"), F.lit(1).alias("w")))).otherwise(F.array().cast("array<struct<h:bigint,w:int>>")))


def two_best(rows: DataFrame, by: str) -> DataFrame:
    """The smallest `far` of each `by` and the smallest of its other rows (one a conversation), as `fars`."""
    first = rows.groupBy(by).agg(F.min("far").alias("one"))
    second = rows.join(first, by).where("far > one").groupBy(by).agg(F.min("far").alias("two"))
    return first.join(second, by, "left").select(by, F.array("one", "two").alias("fars"))


def elsewhere(conv) -> Column:
    """The first of `fars` of another conversation than conv_id."""
    return F.get(F.filter("fars", lambda x: x.isNotNull() & (conv(x) != F.col("conv_id"))), F.lit(0))


def ballots(lines: DataFrame, votes: DataFrame, me: list[str]) -> DataFrame:
    """Each passage of lines with the original that votes (passage, conv_id, turn, w: minus the number) give it: to, and its w. Null if there is none."""
    per_conv = votes.groupBy("passage", "conv_id").agg(F.min(F.struct("w", "turn")).alias("x"))
    tops = two_best(per_conv.select("passage", F.struct(F.col("x.w").alias("w"), F.col("conv_id").alias("c"), F.col("x.turn").alias("t")).alias("far")), "passage")
    own = lines.alias("l").join(votes.alias("v"), F.expr("l.passage = v.passage AND l.conv_id = v.conv_id AND v.turn < l.turn")).groupBy(*[F.col(f"l.{c}") for c in me]).agg(F.min(F.struct("v.w", F.col("v.turn").alias("t"))).alias("mine"))
    best = lines.join(tops, "passage", "left").join(own, me, "left").withColumn("there", elsewhere(lambda x: x["c"]))
    here = F.col("mine").isNotNull() & (F.col("there").isNull() | (F.col("mine.w") <= F.col("there.w")))
    to = F.when(here, F.struct(F.col("conv_id").alias("c"), F.col("mine.t").alias("t"))).when(F.col("there").isNotNull(), F.struct(F.col("there.c").alias("c"), F.col("there.t").alias("t")))
    return best.select(*me, "passage", to.alias("to"), F.when(here, F.col("mine.w")).otherwise(F.col("there.w")).alias("w"))


def all_votes(wanted: DataFrame, originals: DataFrame) -> DataFrame:
    """passage, conv_id, turn, w for wanted (passage, h, n): the originals of every line. Those of a line are dealt in parts."""
    parts = originals.groupBy("h").agg((F.floor(F.count(F.lit(1)) / SALT_ROWS) + 1).cast("long").alias("parts"))
    asked = wanted.join(parts, "h").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = originals.join(parts, "h").withColumn("part", F.pmod(F.xxhash64("conv_id", "turn"), F.col("parts")))
    votes = asked.select("passage", "h", "n", "part").join(dealt.select("h", "part", "conv_id", "turn"), ["h", "part"])
    return votes.groupBy("passage", "conv_id", "turn").agg((-F.sum("n")).alias("w"))


def by_lines(lines: DataFrame, originals: DataFrame, me: list[str]) -> DataFrame:
    """me and `to` of passages (me, hs, passage) by the number of their lines that an original has.

    A line that many passages quote and many originals have would bring each of these to each of those. Such a common line
    is looked up only for originals that a rarer line of the passage has found. An original that common lines alone would
    find has no more votes than the passage has common lines: where the best has more, it is the best of all, and
    only passages where it hasn't are counted again with the originals of every line."""
    wanted = lines.select("passage", "hs").dropDuplicates(["passage"]).select("passage", F.explode("hs").alias("h")).groupBy("passage", "h").agg(F.count(F.lit(1)).alias("n"))
    asked = wanted.groupBy("h").agg(F.count(F.lit(1)).alias("asked"))
    common = originals.groupBy("h").agg(F.count(F.lit(1)).alias("there")).join(asked, "h").where(F.col("asked") * F.col("there") > COMMON_PAIRS).select("h")
    common = cut(common, "common-lines")
    if common.isEmpty():
        found = ballots(lines, cut(all_votes(wanted, originals), "votes"), me)
        return found.where("to IS NOT NULL").select(*me, "to")
    often = cut(wanted.join(common, "h", "left_semi"), "common-wanted")
    rare = cut(all_votes(wanted.join(common, "h", "left_anti"), originals), "rare-votes")
    # common lines of originals that are known already
    more = rare.select("passage", "conv_id", "turn").join(often, "passage").join(originals, ["h", "conv_id", "turn"], "left_semi")
    votes = rare.unionByName(more.select("passage", "conv_id", "turn", (-F.col("n")).alias("w"))).groupBy("passage", "conv_id", "turn").agg(F.sum("w").alias("w"))
    most = often.groupBy("passage").agg(F.sum("n").alias("most"))
    found = cut(ballots(lines, cut(votes, "votes"), me).join(most, "passage", "left"), "line-ballots")
    settled = F.coalesce(-F.col("w") > F.coalesce("most", F.lit(0)), F.col("most").isNull())
    sure = found.where(settled & F.col("to").isNotNull()).select(*me, "to")
    open_ = cut(lines.join(found.where(~settled).select(*me), me, "left_semi"), "line-open")
    if open_.isEmpty():
        return sure
    again = wanted.join(open_.select("passage").distinct(), "passage", "left_semi")
    rest = ballots(open_, cut(all_votes(again, originals), "votes"), me)
    return sure.unionByName(rest.where("to IS NOT NULL").select(*me, "to"))


def link(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, clean_text, max_level, n_quoted_lines, n_passages, n_linked,
    quoted_conv, quoted_turn (of the first passage), parent_turn, root_turn, depth."""
    whole = parsed(messages, conv, turn, role, text)
    mine = whole.select("conv_id", "turn", F.xxhash64("text").alias("key"), "runs").where("conv_id IS NOT NULL AND turn IS NOT NULL")

    quoted = mine.where(F.exists("runs", lambda r: r["level"] > 0)).select("conv_id", "turn", "key", F.posexplode("runs").alias("at", "run")).where("run.level > 0").dropDuplicates(["conv_id", "turn", "key", "at"])
    quoted = quoted.select("conv_id", "turn", "key", "at", F.col("run.level").alias("level"), F.explode(hashes(F.col("run.lines"))).alias("x")).select("conv_id", "turn", "key", "at", "level", "x.h", "x.w")

    wanted = quoted.select("h").distinct()
    originals = mine.select("conv_id", "turn", F.explode(F.flatten(F.transform(F.filter("runs", lambda r: r["level"] == 0), lambda r: F.transform(hashes(r["lines"]), lambda x: x["h"])))).alias("h"))
    originals = originals.join(wanted, "h", "left_semi")
    originals = cut(originals.groupBy("h", "conv_id", "turn").agg(F.lit(1).alias("one")), "originals")
    me = ["conv_id", "turn", "key", "at", "level"]

    # passages as a whole
    near = originals.groupBy("h", "conv_id").agg(F.min("turn").alias("near_turn"))
    ends = two_best(near.select("h", F.struct(F.col("conv_id").alias("c"), F.col("near_turn").alias("t")).alias("far")), "h")
    found = quoted.where("w > 1").join(near, ["h", "conv_id"], "left").join(ends, "h", "left")
    to = F.when(F.col("near_turn") < F.col("turn"), F.struct(F.col("conv_id").alias("c"), F.col("near_turn").alias("t"))).otherwise(elsewhere(lambda x: x["c"]))
    found = cut(found.select(*me, to.alias("to")), "whole-quotes")
    whole_best = found.where("to IS NOT NULL")

    # the others by their lines
    lines = quoted.where("w = 1").join(found.where("to IS NULL").select(*me), me, "left_semi").groupBy(*me).agg(F.array_sort(F.collect_list("h")).alias("hs"))
    lines = cut(lines.withColumn("passage", F.xxhash64("hs")), "line-quotes")
    line_best = by_lines(lines, originals, me)

    best = whole_best.unionByName(line_best).select(*me, F.struct("to").alias("best"))
    per = cut(best.groupBy("conv_id", "turn", "key").agg(F.count(F.lit(1)).alias("n_linked"), F.min(F.struct("level", "at", F.col("best.to").alias("to"))).alias("first")).select("conv_id", "turn", "key", "n_linked", F.col("first.to.c").alias("quoted_conv"), F.col("first.to.t").alias("quoted_turn")), "quotes")

    roots = reply_roots(per.where("quoted_conv = conv_id AND quoted_turn < turn").groupBy("conv_id", "turn").agg(F.min("quoted_turn").alias("parent")))
    quoted_lines = F.filter("raw", lambda x: x["level"] > 0)
    out = whole.select(
        "conv_id", "turn", "role", "clean_text", F.xxhash64("text").alias("key"), F.greatest(F.array_max(F.transform("raw", lambda x: x["level"])), F.lit(0)).cast("int").alias("max_level"),
        F.size(quoted_lines).cast("long").alias("n_quoted_lines"), F.size(F.filter("runs", lambda r: r["level"] > 0)).cast("long").alias("n_passages"),
    )
    out = out.join(per, ["conv_id", "turn", "key"], "left").join(roots, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", "clean_text", "max_level", "n_quoted_lines", "n_passages", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "quoted_conv", "quoted_turn",
        F.col("parent").alias("parent_turn"), F.coalesce("root", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("int").alias("depth"),
    )


def reply_roots(parents: DataFrame) -> DataFrame:
    """conv_id, turn, parent, root, depth of replies: each round a pointer jumps to its target's
    target, so a chain of n replies takes log2(n) rounds."""
    now = cut(parents.select("conv_id", "turn", "parent", F.col("parent").alias("root"), F.lit(1).alias("depth"), F.lit(True).alias("open")), "replies")
    while not now.where("open").isEmpty():
        at = now.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("root").alias("next"), F.col("depth").alias("more"))
        joined = now.join(at, (F.col("conv_id") == F.col("c")) & (F.col("root") == F.col("t")), "left")
        now = cut(joined.select("conv_id", "turn", "parent", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("open")), "replies")
    return now.select("conv_id", "turn", "parent", "root", "depth")
