"""Operator 6: exact join of documents by the Jaccard distance of their five-word shingles.

Nearly all pairs of documents are at distance 1, and at that distance a Voronoi window (home
distance plus twice the threshold) would copy every document into every region of document
pivots. The first level therefore takes single shingles as pivots: a document's home region is
that of its rarest shingle, and its window holds the next rarest, as many as a linked document
can lack (20 % of the set). Two linked documents meet in a region. Shingles are ordered by a
table of counts over all documents (of a fixed size, so counts are upper bounds), then by hash.
Documents of a region share a shingle, and there distances spread.

Inside a region documents are joined as follows.

1. Equal sets are one class and enter once. The smallest class is the region's pivot; each class
   is verified against the pivot that it meets most often, then components that meet by one
   pair each. Classes of one connected component need no more links, so regions with one component are done.
2. What is left is joined by document pivots. Sets are mapped to parities of their hashes' last
   bits, at least four bits an element, whose Hamming distance is a metric and never more than the
   sets' difference. A large region is first split by size (linked sets differ by a quarter at
   most), so its maps have one width and one bound N on the set size. Its largest components each
   give a pivot. A class is at home in the cell of a pivot within RADIUS * N; by the triangle
   inequality, what is linked with it is within RADIUS * N and the largest distance of a link, so
   each class goes to all cells within that window and nowhere else. Classes at home in no cell
   form the rest. Cells and the rest are divided again while they are large. A region whose cells
   together have nearly as many pairs to compare as itself (all its classes are near one another) is
   dealt out in blocks of bounded size instead, what isn't in its largest component against all;
   so are small regions.
3. Pairs of different components that these maps don't prove apart are verified exactly.

Links between classes so found connect what all links connect. Set elements are 64-bit hashes
of the words' 64-bit hashes.

Hot groups: copies are combined before any shuffle of sets; regions of shingles that the count
table shows to be frequent are combined before the shuffle and joined in splittable form;
others have at most as many rows as that count, and are streamed in sorted order.

Cases: a text of fewer than five words has one shingle, the whole sequence. Without words or
text the set is empty and linked with nothing (component: the id itself). A null id gets its set's size and a
null component and links nothing. Repeated rows give repeated rows. Empty tables give none.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkglass.llm.common import cut, light, small_batches, text_bytes, text_slices
from inkglass.llm.components import components

WORDS, PERCENT = 5, 80
#: The count table has 2**TABLE_BITS counters, in pieces of 2**PIECE_BITS.
TABLE_BITS, PIECE_BITS = 22, 16
#: Shingles that the table counts so often are joined in splittable form.
FREQUENT = 4096
#: Members of a cell that is compared at once; pivots of a larger region; radius of a cell.
CELL, PIVOTS, RADIUS = 1024, 8, 0.5
#: Rows of a block: those outside the largest component, and those against which they go.
BLOCK_Q, BLOCK_M = 1024, 2048
FACTORS = (np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
ROOT = 0xD1342543DE82EF95
LETTERS = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Rounds in which components that meet are tried by one pair each.
CONTRACTIONS = 1
#: Members of one pivot that are verified in one place.
TOGETHER = 512
#: Bytes of text that are hashed together.
SLICE = 1_000_000
#: Bits of the smallest parity map.
BASE_BITS = 10

_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ROOT**i and ROOT**-i modulo 2**64 for i < n, kept by the worker."""
    if len(_powers.get(1, ())) < n:
        whole = max(n, 1 << 20)
        for sign, root in ((1, ROOT), (-1, pow(ROOT, -1, 1 << 64))):
            out = np.full(whole, root, np.uint64)
            out[0] = 1
            _powers[sign] = np.cumprod(out)
    return _powers[1][:n], _powers[-1][:n]


def shingle_rows(texts: list[bytes], k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts in a row, and how many each text has.

    Words are hashed together: with running sums of LETTERS[byte] * ROOT**place, a word's sum is a
    difference, brought to place 0. A short text's one shingle also counts its words."""
    joined = b"\n".join(texts).lower()  # of bytes: A-Z only
    letters = np.frombuffer(joined, np.uint8)
    up, down = powers(len(letters) + 1)
    space = SPACE[letters]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    starts, stops = edges[::2], edges[1::2]
    sums = np.zeros(len(letters) + 1, np.uint64)
    np.cumsum(LETTERS[letters] * up[:-1], out=sums[1:])
    words = mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    word_ends = np.searchsorted(starts, ends)
    n_words = np.diff(np.concatenate([[0], word_ends]))
    total = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        total += words[j : j + len(total)] * FACTORS[j]
    total = mix(total + np.uint64(k))
    counts = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    # a text's shingles begin at its first k - full ones; short texts are put in by themselves
    first = word_ends - n_words
    out = np.zeros(int(counts.sum()), np.uint64)
    begin = np.cumsum(counts) - counts
    full = n_words >= k
    at = np.repeat(first[full] - begin[full], counts[full]) if full.any() else np.zeros(0, np.int64)
    place = np.flatnonzero(np.repeat(full, counts))
    out[place] = total[place + at]
    for i in np.flatnonzero((n_words > 0) & ~full).tolist():
        w = words[first[i] : word_ends[i]]
        out[begin[i]] = mix((w * FACTORS[: len(w)]).sum(keepdims=True).astype(np.uint64) + np.uint64(len(w)))[0]
    return out, counts


def shingle_sets(texts: list[bytes], k: int = WORDS) -> list[np.ndarray]:
    """The sorted hashes of each text's different shingles."""
    rows, counts = shingle_rows(texts, k)
    return [np.unique(x) for x in np.split(rows, np.cumsum(counts)[:-1])] if len(texts) else []


def lacking(n: int, percent: int) -> int:
    """How many of n shingles a document linked with this one can lack, and one."""
    return n - -(-percent * n // 100) + 1


def lacking_early(n: int, percent: int) -> int:
    """As lacking(), for documents that are no smaller: the overlap is at least 2 p / (100 + p) of n."""
    return n - -(-2 * percent * n // (100 + percent)) + 1


def parity_map(s: np.ndarray) -> bytes:
    """A bit for each value of the hashes' last bits: 1 if an odd number of elements has it. There are
    at least four bits an element. Two maps differ in no more bits than the sets do in elements."""
    bits = max(BASE_BITS, (4 * len(s)).bit_length())
    odd = np.bincount((s & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Maps (rows of 64-bit words) over fewer last bits: halves laid over one another."""
    while maps.shape[-1] > words:
        half = maps.shape[-1] // 2
        maps = maps[..., :half] ^ maps[..., half:]
    return maps


def as_words(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def summed(rows: DataFrame, pieces, bits: int = TABLE_BITS) -> list[np.ndarray]:
    """Sums of tables of 2**bits counters over all partitions. pieces(batches) yields, for a
    partition, (start of a piece, counters). Returns the pieces in order; they have a fixed size."""
    import pyarrow as pa

    def local(batches):
        for k, counts in pieces(batches):
            kind = "<u1" if counts.max() < 256 else "<u8"
            yield pa.RecordBatch.from_pydict({"piece": pa.array([k], pa.int32()), "counts": [kind[1:2].encode() + kind[2:].encode() + zlib.compress(counts.astype(kind).tobytes(), 1)]})

    def add(batches):
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = np.frombuffer(zlib.decompress(data[2:]), f"<{data[:2].decode()}").astype("<u8")
                own[k] = own[k] + counts if k in own else counts
        for k, counts in own.items():
            yield pa.RecordBatch.from_pydict({"piece": pa.array([k], pa.int32()), "counts": [zlib.compress(counts.tobytes(), 1)]})

    schema = "piece int, counts binary"
    n = 1 << max(0, bits - PIECE_BITS)
    found = rows.mapInArrow(local, schema).repartition(min(n, 16), "piece").mapInArrow(add, schema).collect()  # 2**bits counters in all
    out = [np.zeros(1 << min(bits, PIECE_BITS), np.uint64) for _ in range(n)]
    for r in found:
        out[r["piece"]] = np.frombuffer(zlib.decompress(r["counts"]), "<u8")
    return out


def table_pieces(places, bits: int):
    """For summed(): the counters of the places (an array) of each batch."""
    def run(batches):
        total = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for at in places(batch):
                found, counts = np.unique(at, return_counts=True)
                total[found] += counts.astype(np.uint32)
        step = 1 << min(bits, PIECE_BITS)
        for k in range((1 << bits) // step):
            part = total[k * step : (k + 1) * step]
            if part.any():
                yield k, part
    return run


def documents_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("data"))


def levels(own: DataFrame, k: int) -> np.ndarray:
    """A byte a counter: twice the binary logarithm of how many shingles of the documents are there."""
    def places(batch):
        for _, texts in text_slices(batch, 1, SLICE):
            yield (shingle_rows(texts, k)[0] >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    counts = np.concatenate(summed(own, table_pieces(places, TABLE_BITS))).astype(float)
    return np.minimum(2 * np.log2(counts + 1), 255).astype(np.uint8)


def features(own: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n, same (a hash of the set), window (rarest shingles; the frequent ones apart), map (of parities)."""
    import pyarrow as pa

    level = own.sparkSession.sparkContext.broadcast(zlib.compress(levels(own, k).tobytes(), 1))
    often = int(2 * np.log2(FREQUENT + 1))

    def run(batches):
        import xxhash

        table = np.frombuffer(zlib.decompress(level.value), np.uint8)
        for batch in batches:
            for at, texts in text_slices(batch, 1, SLICE):
                out: list[list] = [[], [], [], [], [], []]
                for s in shingle_sets(texts, k):
                    ranks = table[(s >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
                    first = np.lexsort((s, ranks))[: lacking(len(s), percent)] if len(s) else np.zeros(0, np.int64)
                    hot = ranks[first] >= often
                    window = s.view(np.int64)[first]
                    for column, x in zip(out, (len(s), xxhash.xxh3_128_digest(s.tobytes()), window[~hot], window[hot], parity_map(s), lacking_early(len(s), percent) if len(s) else 0), strict=True):
                        column.append(x)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.list_(pa.int64())), pa.array(out[4], pa.binary()), pa.array(out[5], pa.int32())],
                    names=["doc_id", "n", "same", "window", "frequent", "map", "early"],
                )

    return own.mapInArrow(run, "doc_id long, n long, same binary, window array<long>, frequent array<long>, map binary, early int")


def sets_of(own: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """id, items (the set's hashes as bytes) of the documents with these ids (and of some others: a
    table of hashed ids, of a fixed size, tells which documents to take)."""
    import pyarrow as pa

    def place(x: np.ndarray) -> np.ndarray:
        return (mix(x.astype(np.int64).view(np.uint64)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def places(batch):
        yield place(batch.column(0).to_numpy(zero_copy_only=False))

    there = np.packbits(np.concatenate(summed(ids.select("id"), table_pieces(places, TABLE_BITS))) > 0)
    told = own.sparkSession.sparkContext.broadcast(zlib.compress(there.tobytes(), 1))

    def run(batches):
        bits = np.unpackbits(np.frombuffer(zlib.decompress(told.value), np.uint8)).astype(bool)
        for batch in batches:
            wanted = pa.array(bits[place(batch.column(0).to_numpy(zero_copy_only=False))])
            batch = batch.filter(wanted)
            for at, texts in text_slices(batch, 1, SLICE):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array([s.tobytes() for s in shingle_sets(texts, k)], pa.binary())], names=["id", "items"])

    return own.where("doc_id IS NOT NULL").mapInArrow(run, "id long, items binary")


def verified(pairs: DataFrame, own: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are links, by their whole sets. Each set goes once to where its pairs'
    first documents are; a first document with many pairs is in several places."""
    import pyarrow as pa

    pairs = cut(pairs, "jaccard-pairs")
    n = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).cast("int").alias("parts"))
    both = pairs.join(n, "a")
    to = both.select(F.col("b").alias("id"), "a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    to = to.unionByName(n.select(F.col("a").alias("id"), "a", F.lit(None).cast("long").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")))
    to = cut(to, "jaccard-ways")
    sets = sets_of(own, to.select("id").distinct(), k)
    met = sets.join(light(to), "id")

    def run(batches):
        now, s = None, None
        for batch in batches:
            a, b, fine = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            parts = batch.column(2).to_pylist()
            for i, x in enumerate(batch.column(3)):
                t = np.frombuffer(x.as_buffer(), np.uint64)
                if b[i] is None:
                    now, s = (a[i], parts[i]), t.copy()
                elif now == (a[i], parts[i]):
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    if 100 * both >= percent * (len(s) + len(t) - both):
                        fine.append(i)
            yield batch.select(["a", "b"]).take(pa.array(fine, pa.int64()))

    rows = met.select("a", "b", "part", "items").repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return cut(rows.mapInArrow(run, "a long, b long").distinct(), "jaccard-links")


def not_apart(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that sizes and maps (facts: id, n, map) don't prove apart."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)
            yield batch.select(["a", "b"]).filter(pa.array([may_link((m, x), (n, y), percent) for m, x, n, y in rows], pa.bool_()))

    one = facts.select(F.col("id").alias("a"), F.col("n").alias("m"), F.col("map").alias("x"))
    two = facts.select(F.col("id").alias("b"), "n", F.col("map").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "m", "x", "n", "y").mapInArrow(run, "a long, b long")


def may_link(a: tuple[int, bytes], b: tuple[int, bytes], percent: int) -> bool:
    """False if sizes or parity maps prove that two sets aren't linked: linked sets differ in at most
    (100 - p) / (100 + p) of their sizes' sum."""
    (m, x), (n, y) = a, b
    if 100 * min(m, n) < percent * max(m, n):
        return False
    words = min(len(x), len(y)) // 8
    apart = int(np.bitwise_count(folded(as_words(x), words) ^ folded(as_words(y), words)).sum())
    return (100 + percent) * apart <= (100 - percent) * (m + n)


def star(classes: DataFrame) -> DataFrame:
    """region, pivot, id: each member of a region with the region's pivot. A link's shingle is among
    the first `early` of the smaller document, so a region in which no member has it so early is left
    out; the pivot is the smallest class that has."""
    rows = classes.select("id", "early", F.posexplode("window").alias("at", "region")).select("region", (F.col("at") >= F.col("early")).alias("late"), "id")
    first = F.first(F.struct("late", "id")).over(W.partitionBy("region").orderBy("late", "id").rowsBetween(W.unboundedPreceding, W.currentRow))
    rest = rows.withColumn("first", first).where("NOT first.late AND first.id != id").select("region", F.col("first.id").alias("pivot"), "id")
    hot = classes.select("id", F.size("window").alias("before"), "early", F.posexplode("frequent").alias("at", "region")).select("region", (F.col("before") + F.col("at") >= F.col("early")).alias("late"), "id")
    least = hot.where("NOT late").groupBy("region").agg(F.min("id").alias("pivot"))
    return rest.unionByName(hot.join(least, "region").where("pivot != id").select("region", "pivot", "id"))


def keyed(*parts: int) -> int:
    """A number for a region made of others."""
    return int(mix(np.array(parts, np.int64).view(np.uint64) * FACTORS[: len(parts)]).sum(dtype=np.uint64).view(np.int64))


def banded(members: DataFrame, percent: int) -> DataFrame:
    """Regions split by set size: linked sets are in the same band or in neighbours, so each class is in
    the region of its own band and in that of the next one."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)) + 1e-9)
    rows = members.select("region", "id", "n", "component", "map", F.explode(F.array(band, band + 1)).alias("band"))
    return rows.select(F.xxhash64("region", "band").alias("region"), "id", "n", "component", "map")


def divided(members: DataFrame, percent: int, pivots: int) -> DataFrame:
    """One level of cells: members (region, id, n, component, map, size, width, most_n) of large regions in
    the cells of pivots within whose window they are, and in the rest if they are at home in none."""
    import pyarrow as pa

    # a component is chosen by its share of the region: about `pivots` in all, those with more than a share of one surely
    each = members.groupBy("region", "component").agg(F.count(F.lit(1)).alias("m"), F.first("size").alias("size"), F.min_by(F.struct("id", "map"), "id").alias("pivot"))
    chosen = each.where(F.pmod(F.xxhash64("region", "component"), F.lit(1 << 30)) <= F.lit(pivots * float(1 << 30)) * F.col("m") / F.col("size"))
    chosen = chosen.groupBy("region").agg(F.collect_list("pivot").alias("pivots"))
    link = 2 * (100 - percent) / (100 + percent)  # of N, the largest distance of two linked sets

    def run(batches):
        last = None
        for batch in batches:
            cells, taken = [], []
            columns = [batch.column(i).to_pylist() for i in (0, 4, 5, 6)]
            for i, (region, own, width, most) in enumerate(zip(*columns, strict=True)):
                words = width // 8
                if region != last:  # rows of a region come together
                    last, found = region, batch.column(7)[i].as_py() or []
                    maps = np.stack([folded(as_words(p["map"]), words) for p in found]) if found else np.zeros((0, words), np.uint64)
                    names, rest = [keyed(region, p["id"]) for p in found], keyed(region, -1, -1)
                d = np.bitwise_count(maps ^ folded(as_words(own), words)).sum(1)
                to = [names[k] for k in np.flatnonzero(d <= (RADIUS + link) * most + 1e-6).tolist()]
                if not found or d.min() > RADIUS * most:
                    to.append(rest)
                cells += to
                taken += [i] * len(to)
            rows = batch.select([1, 2, 3, 4]).take(pa.array(taken, pa.int64()))
            parents = batch.select([0, 8]).take(pa.array(taken, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), *rows.columns, *parents.columns], names=["region", "id", "n", "component", "map", "parent", "before"])

    pairs = (F.col("size") * (F.col("size") - F.col("largest"))).alias("pairs")
    rows = members.join(chosen, "region", "left").select("region", "id", "n", "component", "map", "width", "most_n", "pivots", pairs)
    return rows.mapInArrow(run, "region long, id long, n long, component long, map binary, parent long, before long")


def open_cells(members: DataFrame) -> DataFrame:
    """Members of regions with two components or more, with the region's size and largest component, the
    smallest width of its maps and its largest set."""
    by = members.groupBy("region", "component").agg(F.count(F.lit(1)).alias("m"), F.min(F.octet_length("map")).alias("width"), F.max("n").alias("most_n"))
    regions = by.groupBy("region").agg(F.sum("m").alias("size"), F.max(F.struct("m", "component")).alias("most"), F.count(F.lit(1)).alias("k"), F.min("width").alias("width"), F.max("most_n").alias("most_n")).where("k > 1")
    return members.join(regions.select("region", "size", F.col("most.m").alias("largest"), F.col("most.component").alias("main"), "width", "most_n"), "region")


def blocks(members: DataFrame) -> DataFrame:
    """Members in blocks: what isn't in a region's largest component, against all of the region."""
    n_q, n_m = F.ceil((F.col("size") - F.col("largest")) / BLOCK_Q).cast("int"), F.ceil(F.col("size") / BLOCK_M).cast("int")
    hashed = F.xxhash64("id", "region")
    outside = F.col("component") != F.col("main")
    q = members.where(outside).select("*", F.pmod(hashed, n_q).alias("q"), F.explode(F.sequence(F.lit(0), n_m - 1)).alias("m"), F.lit(True).alias("asks"))
    m = members.select("*", F.explode(F.sequence(F.lit(0), n_q - 1)).alias("q"), F.pmod(hashed, n_m).alias("m"), F.lit(False).alias("asks"))
    return q.select("region", "q", "m", "asks", "id", "n", "component", "map").unionByName(m.select("region", F.col("q").cast("long").alias("q"), F.col("m").alias("m"), "asks", "id", "n", "component", "map").select("region", "q", "m", "asks", "id", "n", "component", "map"))


def compared(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a < b) of a block's two sides that have different components and may be links. Blocks
    come sorted, one after another; a block has a bounded number of rows."""
    import pyarrow as pa

    def pairs_of(block: list[tuple]):
        q, m = [r for r in block if r[3]], [r for r in block if not r[3]]
        if not q or not m:
            return
        by_size: dict[int, list[tuple]] = {}
        for r in m:
            by_size.setdefault(len(r[7]) // 8, []).append(r)
        for words, rows in by_size.items():
            ids, sizes, comp = (np.array([r[i] for r in rows]) for i in (4, 5, 6))
            whole = np.stack([as_words(r[7]) for r in rows])
            maps = {words: whole}
            for r in q:
                i, n, c, x = r[4:8]
                at = np.flatnonzero((comp != c) & (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n)))
                if not len(at):
                    continue
                w = min(words, len(x) // 8)
                if w not in maps:
                    maps[w] = folded(whole, w)
                apart = np.bitwise_count(maps[w][at] ^ folded(as_words(x), w)).sum(1, dtype=np.int64)
                for j in ids[at[(100 + percent) * apart <= (100 - percent) * (sizes[at] + n)]].tolist():
                    yield min(i, j), max(i, j)

    def made(out: set[tuple]):
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    def run(batches):
        block: list[tuple] = []
        out: set[tuple] = set()
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block and block[0][:3] != r[:3]:
                    out.update(pairs_of(block))
                    block = []
                    if len(out) > 100_000:
                        yield made(out)
                        out = set()
                block.append(r)
        out.update(pairs_of(block) if block else ())
        if out:
            yield made(out)

    placed = rows.select("region", "q", "m", "asks", "id", "n", "component", "map").repartition("region", "q", "m").sortWithinPartitions("region", "q", "m")
    return placed.mapInArrow(run, "a long, b long").distinct()


def cells(members: DataFrame, percent: int, cell: int, pivots: int) -> DataFrame:
    """Blocks in which all pairs of different components that may be links meet."""
    def small_and_large(rows: DataFrame) -> DataFrame:
        done.append(blocks(rows.where(F.col("size") <= cell)))
        return rows.where(F.col("size") > cell)

    done: list[DataFrame] = []
    large = small_and_large(cut(open_cells(members), "jaccard-cells"))
    if not large.isEmpty():
        large = small_and_large(cut(open_cells(banded(large, percent)), "jaccard-bands"))
    while not large.isEmpty():
        parts = cut(open_cells(divided(large, percent, pivots)), "jaccard-cells")
        pairs = parts.groupBy("parent", "before", "region").agg(F.first(F.col("size") * (F.col("size") - F.col("largest"))).alias("pairs"))
        stuck = pairs.groupBy("parent", "before").agg(F.sum("pairs").alias("pairs")).where("pairs > 0.7 * before").select("parent")
        stuck = light(cut(stuck, "jaccard-stuck"))
        done.append(blocks(large.join(stuck, F.col("region") == F.col("parent"), "left_semi")))
        large = small_and_large(parts.join(stuck, "parent", "left_anti").drop("parent", "before"))
    return reduce(DataFrame.unionByName, done)


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = PERCENT, cell: int = CELL, pivots: int = PIVOTS) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (smallest id with the same set) of every document."""
    small_batches(docs.sparkSession)
    own = documents_of(docs, id_col, text_col)
    found = cut(features(own, k, percent), "jaccard-features")
    full = found.where("n > 0 AND doc_id IS NOT NULL")
    classes = cut(full.groupBy("same").agg(F.min("doc_id").alias("id")), "jaccard-classes")
    one_each = full.join(classes.withColumnRenamed("same", "of"), (F.col("same") == F.col("of")) & (F.col("doc_id") == F.col("id"))).select("id", "n", "window", "frequent", "map", "early")

    stars = cut(star(one_each), "jaccard-stars")
    met = cut(stars.groupBy("pivot", "id").agg(F.count(F.lit(1)).alias("times")), "jaccard-met")
    best = met.groupBy("id").agg(F.max(F.struct("times", F.col("pivot"))).alias("best")).select(F.col("best.pivot").alias("a"), F.col("id").alias("b"))
    facts = one_each.select("id", "n", "map")
    links = verified(not_apart(best, facts, percent), own, k, percent)
    labels = components(links)

    def label(rows: DataFrame, column: str, name: str) -> DataFrame:
        return rows.join(labels.select(F.col("id").alias("__l"), F.col("component").alias("__c")), F.col(column) == F.col("__l"), "left").withColumn(name, F.coalesce("__c", column)).drop("__l", "__c")

    # of each two components that still meet, the pair that meets most often: what they link needs no more looks
    for _ in range(CONTRACTIONS):
        meeting = label(label(met, "pivot", "x"), "id", "y").where("x != y")
        nearest = meeting.groupBy(F.least("x", "y").alias("c"), F.greatest("x", "y").alias("d")).agg(F.max(F.struct("times", "pivot", "id")).alias("m")).select(F.col("m.pivot").alias("a"), F.col("m.id").alias("b"))
        links = links.unionByName(verified(not_apart(nearest, facts, percent), own, k, percent))
        labels = components(links)

    # regions in which a class and the pivot aren't connected yet
    apart = label(label(met.select("pivot", "id"), "pivot", "x"), "id", "y").where("x != y").select("pivot", "id")
    left = stars.join(apart, ["pivot", "id"], "left_semi").select("region").distinct()
    rows = stars.join(left, "region", "left_semi")
    rows = cut(rows.select("region", F.explode(F.array("pivot", "id")).alias("id")).distinct(), "jaccard-left")
    # regions with the same members need one look
    print_of = rows.groupBy("region").agg(F.count(F.lit(1)).alias("k"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("x"), F.sum(F.xxhash64(F.lit(1), "id").cast("decimal(38,0)")).alias("y"))
    once = print_of.groupBy("k", "x", "y").agg(F.min("region").alias("region")).select("region")
    rows = cut(rows.join(once, "region", "left_semi").join(facts, "id"), "jaccard-left")
    members = label(rows, "id", "component").select("region", "id", "n", "component", "map")
    pairs = cut(compared(cells(members, percent, cell, pivots), percent), "jaccard-rest")
    if not pairs.isEmpty():
        links = links.unionByName(verified(pairs, own, k, percent))
        labels = components(links)

    mine = found.select("doc_id", "n", "same").join(classes.select(F.col("same").alias("of"), F.col("id").alias("class_id")), F.col("same") == F.col("of"), "left")
    mine = mine.withColumn("class_id", F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id"))))
    mine = mine.join(labels.select(F.col("id").alias("l"), "component"), F.col("class_id") == F.col("l"), "left")
    return mine.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "class_id").alias("component_id"), "class_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs (same columns) with one document, that of the smallest id, of each component. Documents
    without words or id stay; rows that repeat a kept id stay together."""
    others = join(docs, id_col, text_col, **options).where("component_id != doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(others, docs[id_col] == F.col("__gone"), "left_anti")
