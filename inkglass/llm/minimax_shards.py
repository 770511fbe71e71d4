"""Operator 5: minimax contiguous partition into shards, with DataFrame functions only.

Equal texts form a group that stays together. Groups are ordered by a hash of their text. The sizes of at
most 2**BITS blocks, which share the leading bits of their hash, go to the driver. There a binary search
finds the smallest capacity at which a greedy pass needs no more than n shards, checking each
capacity greedily over prefix sums. A block may hold many groups, so blocks in which a cut could fall, for any capacity
that is still possible, are divided by further bits (OPEN_MOST at a time, the largest first) until these are single groups: the
capacity is then the smallest over all groups, as if all their sizes had been there. The cuts are then made
within that capacity, each shard taking what is nearest to its share of the remaining bytes as long as the rest still fits.

A row's slot is the number of rows before it in its shard. It is the start of its block in the shard plus
its place in the block; blocks with many rows (copies of one text) are numbered in parts by
a hash of the id, so no task numbers all rows of a hot group.

Cases: a null text counts as empty (16 bytes) and is in the group of empty texts. Repeated
rows get slots of their own. An empty table gives no rows. Fewer groups than shards leave
shards empty. Texts of one 64-bit hash are one group. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkglass.llm.common import cut

#: Blocks: 2**18 rows at most reach the driver at first, then 2**MORE_BITS for each that is divided, of OPEN_MOST at a time.
BITS, MORE_BITS, OPEN_MOST = 18, 4, 4096
OVERHEAD = 16
#: A block with more than this share of all rows (and over 1,000 rows) is numbered in parts.
HOT_SHARE, HOT_LEAST, PARTS = 1 / 2048, 1000, 64


def greedy_stop(prefix: list[int], start: int, capacity: int) -> int:
    """The last block boundary that a shard beginning at boundary start can reach."""
    return bisect_right(prefix, prefix[start] + capacity) - 1


def fits(prefix: list[int], start: int, capacity: int, shards: int) -> bool:
    end = len(prefix) - 1
    for _ in range(shards):
        if start == end:
            return True
        stop = greedy_stop(prefix, start, capacity)
        if stop == start:
            return False
        start = stop
    return start == end


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """Binary search for the least largest shard."""
    prefix = [0, *accumulate(sizes)]
    low, high = max([-(-prefix[-1] // shards), *sizes], default=0), max(prefix[-1], 0)
    while low < high:
        middle = (low + high) // 2
        if fits(prefix, 0, middle, shards):
            high = middle
        else:
            low = middle + 1
    return low


def cuts(sizes: list[int], shards: int) -> list[int]:
    """The first block of each shard (and the end): contiguous, none over the smallest capacity."""
    prefix, capacity = [0, *accumulate(sizes)], smallest_capacity(sizes, shards)
    at, out, end = 0, [0], len(sizes)
    for left in range(shards, 1, -1):
        share = (prefix[end] - prefix[at]) / left
        most = greedy_stop(prefix, at, capacity)
        stop = bisect_right(prefix, prefix[at] + share) - 1
        if stop < most and prefix[stop + 1] - prefix[at] - share < share - (prefix[stop] - prefix[at]):
            stop += 1
        while stop < most and not fits(prefix, stop, capacity, left - 1):
            stop += 1
        at = max(at, min(stop, most))
        out.append(at)
    return [*out, end]


class Element(NamedTuple):
    """All rows whose order key has these leading bits: `first` is the smallest such key, `bits` their number."""

    first: int
    bits: int
    bytes: int
    n: int
    #: If they are one group.
    atomic: bool


def measured(rows: DataFrame, bits: int) -> list[Element]:
    """The elements of so many bits that rows fall into, in order."""
    first = F.shiftleft(F.shiftright("u", 64 - bits), 64 - bits)
    sums = rows.groupBy(first.alias("first")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), (F.min("u") == F.max("u")).alias("atomic"))
    return sorted(Element(r["first"], bits, r["bytes"], r["n"], r["atomic"]) for r in sums.collect())


def undecided(elements: list[Element], shards: int, low: int, high: int) -> list[int]:
    """Elements of several groups in which a greedy cut may fall, for some capacity from low to high."""
    prefix = [0, *accumulate(e.bytes for e in elements)]
    found, near, far = {k for k, e in enumerate(elements) if e.bytes > low and not e.atomic}, 0, 0
    for _ in range(shards - 1):
        near = prefix[bisect_right(prefix, near + low) - 1]
        far = min(prefix[-1], far + high)
        found.update(k for k in range(max(0, bisect_right(prefix, near) - 1), min(bisect_right(prefix, far), len(elements))) if not elements[k].atomic)
    return sorted(found)


def opened(rows: DataFrame, elements: list[Element], chosen: list[int], more: int) -> list[Element]:
    """elements with the chosen ones divided by so many further bits."""
    spark, gone = rows.sparkSession, set(chosen)
    parts = [e for k, e in enumerate(elements) if k not in gone]
    for bits in sorted({elements[k].bits for k in chosen}):
        wanted = spark.createDataFrame([(elements[k].first,) for k in chosen if elements[k].bits == bits], "at long")
        own = rows.withColumn("at", F.shiftleft(F.shiftright("u", 64 - bits), 64 - bits)).join(F.broadcast(wanted), "at", "left_semi")  # OPEN_MOST rows at most
        parts += measured(own, min(64, bits + more))
    return sorted(parts)


def divided(rows: DataFrame, shards: int, bits: int, more: int) -> list[Element]:
    """Elements fine enough that the smallest capacity over them is that over all groups.

    Capacities are between the largest group that is known (or an equal share) and the smallest capacity over the elements so
    far. Only elements in which a cut of such a capacity may fall are divided, until these are single groups."""
    elements = measured(rows, bits)
    while True:
        sizes = [e.bytes for e in elements]
        low = max([-(-sum(sizes) // shards), *(e.bytes for e in elements if e.atomic)], default=0)
        high = smallest_capacity(sizes, shards)
        chosen = undecided(elements, shards, low, high) if high > low else []
        if not chosen:
            return elements
        largest = sorted(chosen, key=lambda k: -elements[k].bytes)[:OPEN_MOST]
        elements = opened(rows, elements, largest, more)


def assign(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, more: int = MORE_BITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    spark = docs.sparkSession
    data = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(data) + OVERHEAD).cast("long").alias("size"),
        F.crc32(data.cast("binary")).alias("text_crc32"), F.xxhash64(data).bitwiseXOR(F.lit(-(1 << 63))).alias("u"),  # in the order of unsigned hashes
    )
    rows = cut(rows, "shard-rows").withColumn("block", F.shiftright("u", 64 - bits))
    elements = divided(rows, shards, bits, more)
    at = cuts([e.bytes for e in elements], shards)
    # a row's shard is the number of cuts at or before it
    begins = [elements[k].first for k in at[1:-1] if k < len(elements)]
    rows = rows.withColumn("shard", reduce(lambda n, b: n + (F.col("u") >= F.lit(b)).cast("int"), begins, F.lit(0)))

    counts: dict[tuple[int, int], int] = {}
    for shard in range(shards):
        for e in elements[at[shard] : at[shard + 1]]:
            key = shard, e.first >> (64 - bits)
            counts[key] = counts.get(key, 0) + e.n
    total = sum(counts.values())
    hot = sorted({block for (_, block), n in counts.items() if n > max(HOT_LEAST, total * HOT_SHARE)})  # fewer than 1 / HOT_SHARE
    rows = rows.withColumn("part", F.when(F.col("block").isin(hot), F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).otherwise(F.lit(0)).cast("int") if hot else F.lit(0))
    inside = {(r["shard"], r["block"], r["part"]): r["n"] for r in rows.where(F.col("block").isin(hot)).groupBy("shard", "block", "part").agg(F.count(F.lit(1)).alias("n")).collect()} if hot else {}
    placed, slots, hot_set = [], [0] * shards, set(hot)
    for (shard, block), n in counts.items():  # in the order of shards and blocks
        for part in range(PARTS) if block in hot_set else (0,):
            placed.append((shard, block, part, slots[shard]))
            slots[shard] += inside.get((shard, block, part), 0) if block in hot_set else n
    places = spark.createDataFrame(placed, "shard int, block long, part int, first long", verifySchema=False)  # 2**bits + shards + PARTS / HOT_SHARE rows at most
    order = W.partitionBy("shard", "block", "part").orderBy("u", "doc_id", "size", "text_crc32")
    return (
        rows.withColumn("place", F.row_number().over(order)).join(F.broadcast(places), ["shard", "block", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("place") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
