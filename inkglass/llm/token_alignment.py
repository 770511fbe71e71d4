"""Operator 12: tokens of two tokenizers aligned by the bytes that they cover.

Each byte of space+text has a label: none, A-end, B-end or both. A regular expression takes spans
up to each both-label; the labels of a span count its group's tokens. The last A and B token of a
group end together and are a link.

Texts are cut before spaces and line feeds that follow other than white space. Tokenizer A always
ends a pre-token there. B has no piece that goes across, which is looked up in its vocabulary; where
that or A's pre-tokenizer doesn't allow cuts, whole texts are one chunk. Labels and ids of a text are
then those of its chunks in a row, and a worker keeps what it knows of different chunks.

How often a pair is linked is summed over the corpus. Pairs with at least 2^-20 of all links, of
which there are 2^20 at most, are brought to the documents' links by broadcast; only links of
others are dealt by pair. A document has one row for each different pair.

Cases: texts that are null or empty, or that either tokenizer doesn't give back byte for byte, have
no tokens: zeros and an empty string. Special tokens' strings are plain text. Repeated rows give
equal rows and count each; ids may be null or repeated. An empty table gives none. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkglass.llm.common import cut, small_batches, text_slices
from inkglass.llm.pair_index_bpe import byte_characters
from inkglass.llm.wordtable import ChunkTable, gather

#: Fixed value: Unicode's white space.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
CHUNK = re.compile(f"[ \n]*[^ \n]+(?:(?<=[{WHITE}])[ \n]+[^ \n]*)*|[ \n]+")
#: A piece with a space or line feed after other than white space would go across a cut.
ACROSS = re.compile(f"[^{WHITE}][ \n]")
#: Label strings: `0` no token ends, `1` one of A, `2` one of B, `3` both.
SPAN = re.compile(rb"[012]*3")
#: Bytes of text that are looked up together, and bytes of chunks that a worker keeps.
SLICE, MOST_BYTES = 4_000_000, 32_000_000
#: A pair with this share of all links is one of at most so many.
HEAVY_PAIRS = 1 << 20


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        file = json.load(open(path_a, encoding="utf-8"))
        alphabet = byte_characters()
        self.bytes_a = {i: bytes(alphabet[c] for c in s) for s, i in file["model"]["vocab"].items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = {i: bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)}
        self.space = self.b.piece_to_id("▁")
        # chunks begin with a space, for which the one stands that B adds, or with a line feed, before which B's must stand alone
        plain_b = self.b.encode("\nx")[:1] == [self.space]
        cutter = file.get("pre_tokenizer") or {}
        plain_a = file.get("normalizer") is None and cutter.get("type") == "ByteLevel" and cutter.get("use_regex") and not cutter.get("add_prefix_space")
        self.by_chunks = bool(plain_a and plain_b and self.b.normalize("Ⅰ a  b\t") == "▁Ⅰ▁a▁▁b\t" and not any(ACROSS.search(p.replace("▁", " ")) or "▁\n" in p for p in pieces))
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.whole = np.zeros(1 << 14, bool)
        #: n_a, n_b and n_links of a chunk, and where its links start.
        self.sizes = [np.zeros(1 << 14, np.int64) for _ in range(4)]
        self.links = np.zeros(1 << 16, np.int64)
        self.n_links = self.held = 0

    def ids_b(self, chunks: list[str]) -> list[list[int]]:
        """B's ids of chunks; the space that B adds is the chunk's own first one or is taken off."""
        lists = self.b.encode([c[1:] if c[0] == " " else c for c in chunks])
        for k, c in enumerate(chunks):
            if c == " ":
                lists[k] = [self.space]
            elif c[0] != " ":
                del lists[k][0]
        return lists

    def add(self, chunks: list[str]) -> None:
        for at in range(0, len(chunks), 5000):
            self.add_some(chunks[at : at + 5000])

    def add_some(self, chunks: list[str]) -> None:
        all_a = [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        all_b = self.ids_b(chunks)
        data = [c.encode() for c in chunks]
        joined = lambda names, ids: b"".join(map(names.__getitem__, ids))
        whole = np.array([joined(self.bytes_a, a) == d == joined(self.bytes_b, b) for a, b, d in zip(all_a, all_b, data, strict=True)], bool)
        flat = lambda lists: [i for ids, w in zip(lists, whole, strict=True) if w for i in ids]
        a, b = flat(all_a), flat(all_b)
        lengths = np.fromiter(map(len, data), np.int64, len(data)) * whole
        labels = np.full(lengths.sum(), ord("0"), np.uint8)
        for ids, names, label in ((a, self.bytes_a, 1), (b, self.bytes_b, 2)):
            labels[np.cumsum([len(names[i]) for i in ids], dtype=np.int64) - 1] += label
        spans = SPAN.findall(labels.tobytes())
        more_a, more_b = (np.array([s.count(label) for s in spans], np.int64) for label in (b"1", b"2"))
        stops_a, stops_b = np.cumsum(more_a + 1), np.cumsum(more_b + 1)
        links = np.array(a, np.int64)[stops_a - 1] << 32 | np.array(b, np.int64)[stops_b - 1]
        shown_a, shown_b = list(map(str, a)), list(map(str, b))
        texts = [f"{shown_a[x]}|{shown_b[y]}" for x, y in zip((stops_a - 1).tolist(), (stops_b - 1).tolist(), strict=True)]
        for k in np.flatnonzero(more_a + more_b).tolist():
            x, y = stops_a[k], stops_b[k]
            texts[k] = ",".join(shown_a[x - more_a[k] - 1 : x]) + "|" + ",".join(shown_b[y - more_b[k] - 1 : y])
        # the number of groups up to the end of each chunk
        upto = np.searchsorted(np.cumsum([len(s) for s in spans]), np.cumsum(lengths), "right")
        starts = np.concatenate([[0], upto[:-1]])
        first, stop = len(self.number), len(self.number) + len(chunks)
        self.whole = ChunkTable.room(self.whole, stop)
        self.sizes = [ChunkTable.room(x, stop) for x in self.sizes]
        self.links = ChunkTable.room(self.links, self.n_links + len(links))
        self.whole[first:stop] = whole
        for x, values in zip(self.sizes, (list(map(len, all_a)), list(map(len, all_b)), upto - starts, self.n_links + starts), strict=True):
            x[first:stop] = values
        self.links[self.n_links : self.n_links + len(links)] = links
        self.n_links += len(links)
        self.number.update(zip(chunks, range(first, stop), strict=True))
        shown = [";".join(texts[x:y]) for x, y in zip(starts.tolist(), upto.tolist(), strict=True)]
        self.groups += shown
        self.held += 2 * sum(map(len, data)) + sum(map(len, shown))

    def align(self, texts: list[str | None]):
        """(n_a, n_b, n_groups, hash of the groups, linked pairs as a << 32 | b) of each text."""
        if self.held > MOST_BYTES:
            self.clear()
        chunks = [(CHUNK.findall(" " + t) if self.by_chunks else [" " + t]) if t else [] for t in texts]
        known = self.number
        self.add(list(dict.fromkeys(c for x in chunks for c in x if c not in known)))
        for x in chunks:
            n = list(map(known.__getitem__, x))
            at = np.array(n, np.int64)
            if not n or not self.whole[at].all():
                yield 0, 0, 0, "", self.links[:0]
                continue
            n_a, n_b, n_links = (int(x[at].sum()) for x in self.sizes[:3])
            shown = ";".join(map(self.groups.__getitem__, n))
            yield n_a, n_b, n_links, hashlib.sha256(shown.encode()).hexdigest(), gather(self.links, self.sizes[3][at], self.sizes[2][at])


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner_of(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


ROWS = "doc_id {}, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<int>"


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    """Each document's counts, the hash of its groups, and its different links with their numbers."""
    import pyarrow as pa

    def run(batches):
        both = aligner_of(path_a, path_b)
        for batch in batches:
            for at, texts in text_slices(batch, 1, SLICE):
                found = list(both.align(texts))
                pairs = [np.unique(x[4], return_counts=True) for x in found]
                columns = [batch.column(0).slice(at, len(texts)), *(pa.array([x[k] for x in found], pa.int64()) for k in range(3)), pa.array([x[3] for x in found], pa.string())]
                offsets = pa.array(np.cumsum([0, *(len(p) for p, _ in pairs)]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([p[k] for p in pairs]), kind)) for k, kind in ((0, pa.int64()), (1, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*columns, *lists], names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"])

    small_batches(docs.sparkSession)
    inner = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return inner.mapInArrow(run, ROWS.format(inner.schema["doc_id"].dataType.simpleString()))


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, n (links that hold it) and best (no pair of its B id has more) from links: pair, times."""
    counts = cut(links.groupBy("pair").agg(F.sum("times").alias("n")).withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))), "alignment-pairs")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))  # a row for each id of B's vocabulary at most
    return counts.join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    n_best counts links whose pair is linked most often of its B id's pairs, count_sum adds up how
    often the pairs of a document's links are linked in all documents."""
    rows = cut(aligned(docs, path_a, path_b, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "alignment")
    links = rows.select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    pairs = cut(pair_counts(links), "alignment-counts")
    total = pairs.agg(F.sum("n")).first()[0] or 0
    heavy = F.broadcast(pairs.filter(F.col("n") * HEAVY_PAIRS >= total))
    sums = (F.sum(F.col("times") * F.col("n")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"))
    near = links.join(heavy, "pair").groupBy("row").agg(*sums)
    # no pair here has more than 2^-20 of the links
    far = links.join(heavy.select("pair"), "pair", "left_anti").join(pairs.filter(F.col("n") * HEAVY_PAIRS < total), "pair").groupBy("row").agg(*sums)
    found = near.unionByName(far).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return rows.join(found, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256")
