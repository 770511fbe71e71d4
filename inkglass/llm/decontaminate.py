"""Operator 4: benchmark decontamination by a set of n-grams.

Words are runs of ASCII letters and digits and of any character beyond ASCII, A-Z lower-cased.
Every n-word window of every benchmark item (an item of fewer words is one window) is a key.
The keys' words are numbered, so a document becomes a row of small numbers; windows of it are
looked up by a 64-bit combination of these, and every hit is compared word by word.

The set is held in arrays (a key, a place and an item for each window) and broadcast while the
items have at most `most_bytes` of text, which is summed first; with them it takes some ten times
as much memory, or up to 40 times if nearly all words differ (test_ngram_set_memory). Beyond that
nothing of the items passes the driver but a table of bits of a fixed size, in which every window
of an item has set a bit: windows of documents whose bit is set are joined by shuffle with the
items' windows, word by word, and the hits put together by document.

Cases: null or empty texts and items have no words. Items with a null id are ignored in the
list of ids but their windows count as hits. Repeated items count once. Repeated documents give
repeated rows. Without items or documents nothing is hit.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkglass.llm.common import cut, small_batches, text_bytes

WINDOW = 10
MOST_BYTES = 4_000_000
#: Bits of the table of windows beyond MOST_BYTES: 2**27, so 16 MB.
TABLE_BITS = 27
#: Letters and digits and all bytes beyond ASCII stay, A-Z lower-cased; all else is a space.
KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: An odd factor for each place of a window.
FACTORS = (np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def keys_of(numbers: np.ndarray, n: int) -> np.ndarray:
    """The key of each n-word window."""
    if len(numbers) < n:
        return np.zeros(0, np.uint64)
    words = mix(numbers.astype(np.uint64) + np.uint64(7))
    out = np.zeros(len(numbers) - n + 1, np.uint64)
    for k in range(n):
        out += words[k : k + len(out)] * FACTORS[k]
    return mix(out)


def windows_of(words: list[bytes], window: int) -> tuple[int, int]:
    """Length and number of an item's windows."""
    n = min(window, len(words))
    return n, len(words) - n + 1 if n else 0


class Windows:
    """Windows of one length: sorted keys, each with the place of its words and the range of its items."""

    def __init__(self, n: int, flat: np.ndarray, places: np.ndarray, items: np.ndarray):
        self.n, self.flat = n, flat
        keys = keys_of(flat, n)[places]
        order = np.lexsort((items, keys))
        keys, places, items = keys[order], places[order], items[order]
        begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        first = np.repeat(begins, np.diff(np.append(begins, len(keys))))
        # different windows with one key, if ever, are compared one by one
        mixed = np.zeros(len(keys), bool)
        for k in range(n):
            mixed |= flat[places + k] != flat[places[first] + k]
        begins = np.union1d(begins, np.flatnonzero(np.isin(first, first[mixed])))
        self.keys, self.places, self.begins, self.items = keys[begins], places[begins].astype(np.int32), np.append(begins, len(keys)), items.astype(np.int32)

    def hits(self, numbers: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which windows of a document (their places) occur here, and the items that have them."""
        found = keys_of(numbers, self.n)[at]
        low, high = np.searchsorted(self.keys, found, "left"), np.searchsorted(self.keys, found, "right")
        many = high - low
        at, which = np.repeat(at, many), np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        fine = np.ones(len(at), bool)
        for k in range(self.n):
            fine &= numbers[at + k] == self.flat[self.places[which] + k]
        which = np.unique(which[fine])
        return at[fine], np.unique(np.concatenate([self.items[self.begins[w] : self.begins[w + 1]] for w in which.tolist()])) if len(which) else which


class NgramSet:
    """Windows of all items, by length."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.words: dict[bytes, int] = {}
        self.names = [i for i, _ in items]
        flat: list[np.ndarray] = []
        places: dict[int, list[np.ndarray]] = {}
        at = 0
        for k, (_, text) in enumerate(items):
            words = text.translate(KEEP).split()
            flat.append(np.array([self.words.setdefault(w, len(self.words) + 1) for w in words], np.int32))
            n, many = windows_of(words, window)
            if many:
                places.setdefault(n, []).append(np.stack([np.arange(at, at + many), np.full(many, k)]))
            at += len(words)
        joined = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        self.by_length = [Windows(n, joined, *np.concatenate(parts, 1)) for n, parts in places.items()]

    def scan(self, data: bytes) -> tuple[int, np.ndarray, set]:
        """Number of words, which of them are hit, and the items with occurring windows."""
        words = data.translate(KEEP).split()
        get = self.words.get
        numbers = np.array([get(w, 0) for w in words], np.int64)
        hit, items = np.zeros(len(words), bool), set()
        known = numbers > 0
        if not known.any():
            return len(words), hit, items
        runs = np.concatenate([[0], np.cumsum(known)])
        for x in self.by_length:
            whole = np.flatnonzero(runs[x.n :] - runs[: -x.n] == x.n) if len(words) >= x.n else ()  # windows of known words only
            if len(whole):
                at, found = x.hits(numbers, whole)
                for k in range(x.n):
                    hit[at + k] = True
                items.update(self.names[i] for i in found.tolist())
        return len(words), hit, items


def without_hits(data: bytes, hit: np.ndarray) -> bytes:
    """The text without its hit words, from each run's first letter to its last."""
    flags = np.frombuffer(data.translate(KEEP), np.uint8) != 32
    starts = np.flatnonzero(flags & ~np.concatenate([[False], flags[:-1]]))
    stops = np.flatnonzero(flags & ~np.concatenate([flags[1:], [False]])) + 1
    edges = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    out, at = [], 0
    for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):
        out += [data[at : starts[a]]]
        at = int(stops[b - 1])
    return b"".join([*out, data[at:]])


def text_keys(words: list[bytes], n: int) -> tuple[list[bytes], np.ndarray]:
    """The text of each n-word window and its 64-bit key."""
    import xxhash

    texts = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    return texts, np.fromiter(map(xxhash.xxh3_64_intdigest, texts), np.uint64, len(texts))


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """item, n, key, words of each window of items (i, t)."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = text.translate(KEEP).split()
                n, many = windows_of(words, window)
                for at in range(0, many, 5000):
                    texts, keys = text_keys(words[at : at + 5000 + n - 1], n)
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(texts), pa.string()), pa.array([n] * len(texts), pa.int32()), pa.array(keys.view(np.int64)), pa.array(texts, pa.binary())], names=["item", "n", "key", "words"])

    return cut(items.mapInArrow(run, "item string, n int, key long, words binary").distinct(), "leak-windows")


def bit_table(keys: DataFrame) -> np.ndarray:
    """2**TABLE_BITS bits, one set for each key: its leading bits. Tasks send theirs in pieces of 2**16 bits."""
    import pyarrow as pa

    step = 1 << 16

    def local(batches):
        own = np.zeros(1 << TABLE_BITS, bool)
        for batch in batches:
            own[(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
        for k in range(len(own) // step):
            part = own[k * step : (k + 1) * step]
            if part.any():
                yield pa.RecordBatch.from_pydict({"piece": pa.array([k], pa.int32()), "bits": [zlib.compress(np.packbits(part).tobytes(), 1)]})

    def add(batches):
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                bits = np.frombuffer(zlib.decompress(data), np.uint8)
                own[k] = own[k] | bits if k in own else bits
        for k, bits in own.items():
            yield pa.RecordBatch.from_pydict({"piece": pa.array([k], pa.int32()), "bits": [zlib.compress(bits.tobytes(), 1)]})

    schema = "piece int, bits binary"
    out = np.zeros(1 << (TABLE_BITS - 3), np.uint8)
    for r in keys.select("key").mapInArrow(local, schema).repartition(16, "piece").mapInArrow(add, schema).collect():  # 2**TABLE_BITS bits in all
        out[r["piece"] * step // 8 :][: step // 8] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return out


def shuffled_hits(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """doc_id, key (of the text), places (start, n) and items of the hits of docs (doc_id, data)."""
    import pyarrow as pa

    known = item_windows(items, window)
    lengths = sorted(r["n"] for r in known.select("n").distinct().collect())  # `window` numbers at most
    told = docs.sparkSession.sparkContext.broadcast(zlib.compress(bit_table(known).tobytes(), 1))

    def run(batches):
        table = np.frombuffer(zlib.decompress(told.value), np.uint8)
        for batch in batches:
            for doc, key, text in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = text.translate(KEEP).split()
                for n in lengths:
                    for begin in range(0, len(words) - n + 1, 5000):
                        texts, keys = text_keys(words[begin : begin + 5000 + n - 1], n)
                        slot = (keys >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
                        at = np.flatnonzero(table[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1)
                        if len(at):
                            some = [texts[i] for i in at.tolist()]
                            yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()] * len(at), doc.type), pa.array([key.as_py()] * len(at), pa.int64()), pa.array(at + begin, pa.int64()), pa.array([n] * len(at), pa.int32()), pa.array(keys[at].view(np.int64)), pa.array(some, pa.binary())], names=["doc_id", "of", "at", "n", "key", "words"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.xxhash64("data").alias("of"), "data").mapInArrow(run, f"doc_id {kind}, of long, at long, n int, key long, words binary").alias("d")
    met = rows.join(known.alias("k"), F.expr("d.key = k.key AND d.n = k.n AND d.words = k.words")).select("d.doc_id", "d.of", "d.at", "d.n", "k.item")
    return cut(met.groupBy("doc_id", "of").agg(F.collect_set(F.struct("at", "n")).alias("places"), F.collect_set("item").alias("items")), "leak-hits")


def scan(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, most_bytes: int = MOST_BYTES, keep: list[str] | None = None, spans: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, the columns of keep, and
    with spans the text without its hit spans as `clean_text`."""
    import pyarrow as pa

    spark = docs.sparkSession
    small_batches(spark)
    keep = [c for c in keep or [] if c not in (id_col,)]
    own = items.select(F.col(item_id).cast("string").alias("i"), text_bytes(item_text).alias("t")).distinct()
    size = own.agg(F.coalesce(F.sum(F.octet_length("t") + 16), F.lit(0))).first()[0]
    inner = docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("data"), *(F.col(c).alias(f"keep_{c}") for c in keep))
    if size <= most_bytes:
        told = spark.sparkContext.broadcast(pickle.dumps(NgramSet([(r["i"], bytes(r["t"])) for r in own.collect()], window)))  # most_bytes of text at most
        rows = inner.select("*", F.lit(None).cast("array<struct<at:bigint,n:int>>").alias("places"), F.lit(None).cast("array<string>").alias("items"))
    else:
        told = None
        hits = shuffled_hits(inner.select("doc_id", "data"), own, window).alias("h")
        rows = inner.alias("d").join(hits, F.expr("d.doc_id <=> h.doc_id AND xxhash64(d.data) = h.of"), "left").select("d.*", "h.places", "h.items")

    def run(batches):
        ngrams = pickle.loads(told.value) if told else None
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "clean_text")}
            n_columns = 2 + len(keep)
            for k, data in enumerate(batch.column(1).to_pylist()):
                if ngrams:
                    n, hit, found = ngrams.scan(data)
                else:
                    n, found = len(data.translate(KEEP).split()), set(batch.column(n_columns + 1)[k].as_py() or ())
                    hit = np.zeros(n, bool)
                    for place in batch.column(n_columns)[k].as_py() or ():
                        hit[place["at"] : place["at"] + place["n"]] = True
                listed = sorted(x for x in found if x is not None)
                n_hit = int(hit.sum())
                clean = (without_hits(data, hit) if n_hit else data).decode("utf-8", "replace") if spans else None
                for c, v in zip(out, (n, n_hit, len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), n_hit > 0, clean), strict=True):
                    out[c].append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out["n_words"], pa.int64()), pa.array(out["n_hit"], pa.int64()), pa.array(out["n_items"], pa.int64()), pa.array(out["items_sha256"], pa.string()), pa.array(out["contaminated"], pa.bool_())]
                + [batch.column(2 + i) for i in range(len(keep))] + ([pa.array(out["clean_text"], pa.string())] if spans else []),
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", *(f"keep_{c}" for c in keep)] + ["clean_text"] * spans,
            )

    schema = inner.select("doc_id", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.lit("").alias("items_sha256"), F.lit(True).alias("contaminated"), *(f"keep_{c}" for c in keep), *([F.lit("").alias("clean_text")] * spans)).schema
    for field in schema.fields:
        field.nullable = True
    return rows.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, items: DataFrame, remove: str = "documents", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs (same columns) without its contaminated documents, or, with remove="spans", with their
    hit spans cut out of the text."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    found = scan(docs, items, id_col, text_col, keep=docs.columns, spans=remove == "spans", **options)
    if remove == "documents":
        found = found.where(~F.col("contaminated"))
    new = F.when(F.col("contaminated"), F.col("clean_text")).otherwise(F.col(f"keep_{text_col}")) if remove == "spans" else F.col(f"keep_{text_col}")
    return found.select(*(F.col("doc_id").alias(c) if c == id_col else new.alias(c) if c == text_col else F.col(f"keep_{c}").alias(c) for c in docs.columns))
