"""Operator 1: token ids in binary shards, compressed by a Re-Pair grammar.

Documents are range-partitioned by id, so the files in order of their names hold them in
ascending order. Within a shard the most frequent id pairs are replaced by nonterminals,
again and again: first inside the white-space-separated chunks (each different chunk once,
weighted by how often it occurs), then across chunks, each time until no pair occurs LEAST times.
A round replaces all frequent pairs that cannot overlap one another, in falling order of
frequency; of a run of equal symbols every other place. Only places whose pair was frequent or has
just changed are counted again, so late rounds are short. No pair spans two documents, so every
document begins at a symbol of its own.

A file holds the rules, the length that each nonterminal expands to, and for each document
its first symbol and its first token. With the lengths, a reader finds the symbol that covers
any token without expanding what stands before it (TokenReader, which reads a file in place; GrammarFile has a whole one).

Cases: a null or empty text has the end id only. Null ids come first. Repeated ids stay
apart, in order of their texts' hashes. An empty table writes no file and gives no rows.
Columns other than the id and the text are not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkglass.llm.common import SharedFile, cut, file_system, new_folder, small_batches, text_bytes
from inkglass.llm.wordtable import gather, table_of

#: Files with symbols of 3 and of 4 bytes.
MAGIC = {b"IGRP": 3, b"IGR4": 4}
HEAD = "<4sIIIQQQ"
#: Nonterminals are numbered from here; token ids are below it.
BASE = 1 << 18
#: Symbols from here on take 4 bytes.
THREE_BYTES = 1 << 24
#: A shard is closed after so many chunks.
SHARD_CHUNKS = 1_500_000
#: A pair is replaced if a shard has it so often.
LEAST = 4
#: Places beyond which pairs are counted roughly (never too few) before they are counted.
MANY = 1_000_000


def choose(codes: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """Places of frequent pairs among codes, by falling count, of which no two can share a symbol of the text."""
    often = np.flatnonzero(counts >= least)
    often = often[np.lexsort((codes[often], -counts[often]))]
    out: list[int] = []
    if not len(often):
        return np.array(out, np.int64)
    first, second = codes[often] >> 32, codes[often] & 0xFFFFFFFF
    # a byte for each symbol, which is less work than sets of them
    lefts, rights = bytearray(int(max(first.max(), second.max())) + 1), bytearray(int(max(first.max(), second.max())) + 1)
    for k, a, b in zip(often.tolist(), first.tolist(), second.tolist(), strict=True):
        if not (rights[a] or lefts[b]) and (a != b or not (lefts[a] or rights[b])):
            lefts[a] = rights[b] = 1
            out.append(k)
    return np.array(out, np.int64)


class Grammar:
    """Rules made so far: rule k is nonterminal BASE + k."""

    def __init__(self):
        self.rules: list[np.ndarray] = []
        self.ends = [0]

    def rewrite(self, symbols: np.ndarray, joined: np.ndarray, weights: np.ndarray | None, least: float):
        """All rounds over symbols; joined[i] says if i and the symbol after it may become one. Returns the
        symbols that are left and a mask of their places."""
        n = len(symbols)
        # places and symbols of a shard fit 32 bits, which halves what each round moves through memory
        symbols, joined, there = symbols.astype(np.uint32), joined.copy(), np.ones(n, bool)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        places, again = np.flatnonzero(joined[:-1]).astype(np.int32), np.zeros(n, bool)
        while len(places):
            codes = (symbols[places].astype(np.int64) << 32) | symbols[after[places]]
            if weights is None and len(places) > MANY:
                slots = (codes * 0x9E3779B97F4A7C1 >> 20) & 0x3FFFFF
                some = np.bincount(slots, minlength=1)[slots] >= least
                places, codes = places[some], codes[some]
            fine = every_other(places, codes, after)
            where, found = pd.factorize(codes)
            counts = np.bincount(where[fine], None if weights is None else weights[places[fine]], minlength=len(found))
            chosen = choose(found, counts, least)
            if not len(chosen):
                break
            slot = np.full(len(found), -1, np.int64)
            slot[chosen] = np.arange(len(chosen))
            rule = slot[where]
            hit = fine & (rule >= 0)
            first, rest = places[hit], places[(counts >= least)[where] & ~hit]
            second = after[first]
            symbols[first] = BASE + self.ends[-1] + rule[hit]
            joined[first] = joined[second]
            there[second] = False
            after[first] = after[second]
            inside = after[first] < n
            before[after[first][inside]] = first[inside]
            left = before[first]
            again[places] = False
            again[rest] = again[first] = again[left[left >= 0]] = True
            places = np.flatnonzero(again & there & joined).astype(np.int32)
            places = places[after[places] < n]
            self.rules.append(np.stack([found[chosen] >> 32, found[chosen] & 0xFFFFFFFF], 1))
            self.ends.append(self.ends[-1] + len(chosen))
        return symbols[there].astype(np.int64), there


def every_other(places: np.ndarray, codes: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which of the places (ascending) can be replaced at once: of a run of one symbol the first, third ..."""
    fine = np.ones(len(places), bool)
    same = np.flatnonzero(codes >> 32 == codes & 0xFFFFFFFF)
    if len(same):
        at = places[same]
        begins = np.concatenate([[True], after[at[:-1]] != at[1:]])
        number = np.arange(len(same))
        fine[same] = (number - np.maximum.accumulate(np.where(begins, number, 0))) % 2 == 0
    return fine


def compress(numbers: np.ndarray, lengths: np.ndarray, ids: np.ndarray, starts: np.ndarray, counts: np.ndarray, end_id: int):
    """(grammar, symbols, symbol offset of each document, token offset of each document)."""
    grammar = Grammar()
    often = np.bincount(numbers, minlength=1)  # as many as the table has chunks
    used = np.flatnonzero(often)
    rank = np.zeros(len(often), np.int64)
    rank[used] = np.arange(len(used))
    inverse, often = rank[numbers], often[used]
    n = counts[used]
    symbols = gather(ids, starts[used], n).astype(np.int64)
    chunk = np.repeat(np.arange(len(used)), n)
    joined = np.ones(len(symbols), bool)
    joined[np.cumsum(n)[n > 0] - 1] = False
    symbols, keep = grammar.rewrite(symbols, joined, often[chunk].astype(float), LEAST)
    chunk = chunk[keep]
    n = np.bincount(chunk, minlength=len(used)).astype(np.int64)
    begin = np.cumsum(n) - n
    # each document's chunks and then the end id, which is one more chunk
    used_n, used_begin = np.append(n, 1), np.append(begin, len(symbols))
    symbols = np.append(symbols, end_id)
    tokens = np.append(counts[used], 1)
    stops = np.cumsum(lengths + 1) - 1
    order = np.full(len(numbers) + len(lengths), len(used), np.int64)
    inner = np.ones(len(order), bool)
    inner[stops] = False
    order[inner] = inverse
    token_at = np.concatenate([[0], np.cumsum(tokens[order])[stops]]).astype(np.uint64)
    symbols = gather(symbols, used_begin[order], used_n[order])
    symbol_ends = np.cumsum(used_n[order])[stops]
    joined = np.ones(len(symbols), bool)
    joined[symbol_ends - 1] = False
    joined[np.maximum(symbol_ends - 2, 0)] = False  # the end id stays by itself
    document = np.repeat(np.arange(len(lengths)), np.diff(np.concatenate([[0], symbol_ends])))
    symbols, keep = grammar.rewrite(symbols, joined, None, LEAST)
    document = document[keep]
    per = np.bincount(document, minlength=len(lengths))
    return grammar, symbols, np.concatenate([[0], np.cumsum(per)]).astype(np.uint64), token_at


def pack(doc_ids: list, grammar: Grammar, symbols: np.ndarray, symbol_at: np.ndarray, token_at: np.ndarray) -> bytes:
    """A file's bytes: head, round ends, rules, expansion lengths, documents, symbols of 3 bytes, or of 4 where there are many rules."""
    rules = np.concatenate(grammar.rules) if grammar.rules else np.zeros((0, 2), np.int64)
    magic = b"IGRP" if BASE + len(rules) < THREE_BYTES else b"IGR4"
    lengths = np.ones(len(rules), np.uint64)
    for a, b in zip(grammar.ends, grammar.ends[1:], strict=False):
        lengths[a:b] = np.where(rules[a:b] < BASE, 1, lengths[np.maximum(rules[a:b] - BASE, 0)]).sum(1)
    nulls = sum(x is None for x in doc_ids)
    return b"".join([
        struct.pack(HEAD, magic, BASE, len(rules), len(grammar.ends), len(doc_ids), len(symbols), nulls),
        np.array(grammar.ends, "<u4").tobytes(), rules.astype("<u4").tobytes(), lengths.astype("<u8").tobytes(),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(), symbol_at.astype("<u8").tobytes(), token_at.astype("<u8").tobytes(),
        np.ascontiguousarray(symbols.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : MAGIC[magic]]).tobytes(),
    ])


class GrammarFile:
    """A file's bytes, read at random."""

    def __init__(self, data: bytes):
        magic, self.base, n_rules, n_ends, n_docs, n_symbols, nulls = struct.unpack_from(HEAD, data)
        if magic not in MAGIC:
            raise ValueError("not a grammar file")
        at = struct.calcsize(HEAD)

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.ends = take("<u4", n_ends)
        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2).astype(np.int64)
        self.lengths = take("<u8", n_rules).astype(np.int64)
        ids = take("<i8", n_docs).tolist()
        self.doc_ids = [None] * nulls + ids[nulls:]
        self.symbol_at = take("<u8", n_docs + 1).astype(np.int64)
        self.token_at = take("<u8", n_docs + 1).astype(np.int64)
        packed = np.zeros((n_symbols, 4), np.uint8)
        width = MAGIC[magic]
        packed[:, :width] = take("u1", width * n_symbols).reshape(-1, width)
        self.symbols = packed.view("<u4").reshape(-1).astype(np.int64)
        # all expansions in a row, terminals first
        top = self.base
        flat, starts = [np.arange(top, dtype=np.uint32)], np.concatenate([np.arange(top), np.zeros(n_rules, np.int64)])
        self.widths = np.concatenate([np.ones(top, np.int64), self.lengths])
        self.flat = np.concatenate([flat[0], np.zeros(int(self.lengths.sum()), np.uint32)])
        for a, b in zip(self.ends.tolist(), self.ends.tolist()[1:], strict=False):
            pair = self.rules[a:b].reshape(-1)
            part = gather(self.flat, starts[pair], self.widths[pair])
            starts[self.base + a : self.base + b] = top + np.cumsum(self.lengths[a:b]) - self.lengths[a:b]
            self.flat[top : top + len(part)] = part
            top += len(part)
        self.starts = starts

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        return gather(self.flat, self.starts[symbols], self.widths[symbols])

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document."""
        return self.expand(self.symbols[self.symbol_at[k] : self.symbol_at[k + 1]])

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """The ids start to stop of the file; only symbols that cover them are expanded."""
        k = int(np.searchsorted(self.token_at, start, "right")) - 1
        last = int(np.searchsorted(self.token_at, stop, "left"))
        part = self.symbols[self.symbol_at[k] : self.symbol_at[last]]
        ends = int(self.token_at[k]) + np.cumsum(self.widths[part])
        a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
        first = int(ends[a] - self.widths[part[a]]) if a < len(part) else start
        return self.expand(part[a:b])[start - first : stop - first]


class TokenReader:
    """Any ids of a file, which is opened for random access (an object with read_at(size, offset)). Rules and offsets are
    read once; of the symbols only those that cover the ids are, and of the first and last of these only what is asked for is expanded."""

    def __init__(self, file):
        self.file = file
        magic, self.base, n_rules, n_ends, n_docs, self.n_symbols, _ = struct.unpack(HEAD, file.read_at(struct.calcsize(HEAD), 0))
        if magic not in MAGIC:
            raise ValueError("not a grammar file")
        self.width = MAGIC[magic]
        at = struct.calcsize(HEAD) + 4 * n_ends

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            size = np.dtype(kind).itemsize * n
            out = np.frombuffer(file.read_at(size, at), kind, n).astype(np.int64)
            at += size
            return out

        self.rules, self.lengths = take("<u4", 2 * n_rules).reshape(-1, 2), take("<u8", n_rules)
        at += 8 * n_docs
        self.symbol_at, self.token_at = take("<u8", n_docs + 1), take("<u8", n_docs + 1)
        self.symbols_from = at

    def symbols(self, start: int, stop: int) -> np.ndarray:
        data = np.frombuffer(self.file.read_at((stop - start) * self.width, self.symbols_from + start * self.width), np.uint8).reshape(-1, self.width)
        out = np.zeros((len(data), 4), np.uint8)
        out[:, : self.width] = data
        return out.view("<u4").reshape(-1).astype(np.int64)

    def widths(self, symbols: np.ndarray) -> np.ndarray:
        """How many ids symbols stand for."""
        if not len(self.lengths):
            return np.ones(len(symbols), np.int64)
        return np.where(symbols < self.base, 1, self.lengths[np.maximum(symbols - self.base, 0)])

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """The ids start to stop."""
        start, stop = max(0, start), min(stop, int(self.token_at[-1]))
        if start >= stop:
            return np.zeros(0, np.uint32)
        k, last = int(np.searchsorted(self.token_at, start, "right")) - 1, int(np.searchsorted(self.token_at, stop, "left"))
        symbols, first = self.symbols(int(self.symbol_at[k]), int(self.symbol_at[last])), int(self.token_at[k])
        while True:
            # what lies outside goes at each level, so no more than the ids asked for and a path to either end is expanded
            ends = first + np.cumsum(self.widths(symbols))
            a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
            first = int(ends[a - 1]) if a else first
            symbols = symbols[a:b]
            pairs = symbols >= self.base
            if not pairs.any():
                return symbols[start - first : stop - first].astype(np.uint32)
            n = np.where(pairs, 2, 1)
            out, at = np.empty(int(n.sum()), np.int64), np.cumsum(n) - n
            out[at] = np.where(pairs, self.rules[np.maximum(symbols - self.base, 0), 0], symbols)
            out[at[pairs] + 1] = self.rules[symbols[pairs] - self.base, 1]
            symbols = out


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, shard_chunks: int = SHARD_CHUNKS) -> DataFrame:
    """Writes all documents and returns one row a file: part, k, path, n_docs, n_tokens, n_symbols, n_rules."""
    import pyarrow as pa

    small_batches(docs.sparkSession)
    schema = "part int, k int, path string, n_docs long, n_tokens long, n_symbols long, n_rules long"

    def write(batches):
        from pyspark import TaskContext

        part, k, table = TaskContext.get().partitionId(), 0, table_of(tokenizer_path)
        ids: list = []
        numbers, lengths, size = [], [], 0

        def close():
            nonlocal k
            flat, per = np.concatenate(numbers), np.concatenate(lengths)
            grammar, symbols, symbol_at, token_at = compress(flat, per, table.ids, table.starts, table.counts, end_id)
            path = f"{folder}/part-{part:06d}-{k:05d}.rp"
            with SharedFile(path) as f:
                f.write(pack(ids, grammar, symbols, symbol_at, token_at))
            out = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "k": pa.array([k], pa.int32()), "path": [path], "n_docs": [len(ids)], "n_tokens": [int(token_at[-1])], "n_symbols": [len(symbols)], "n_rules": [grammar.ends[-1]]})
            k += 1
            return out

        for batch in batches:
            got, texts = batch.column(0).to_pylist(), batch.column(1)
            at = 0
            while at < len(got):
                # about 4 MB of text at a time, one document at least
                stop, room = at + 1, len(texts[at].as_buffer() or b"")
                while stop < len(got) and room < 4_000_000:
                    room += len(texts[stop].as_buffer() or b"")
                    stop += 1
                if table.full:  # numbers so far belong to the table as it is
                    if size:
                        yield close()
                        ids, numbers, lengths, size = [], [], [], 0
                    table.clear()
                flat, per = table.numbers(texts.slice(at, stop - at).to_pylist())
                ids += got[at:stop]
                numbers.append(flat)
                lengths.append(per)
                size += len(flat) + len(per)
                at = stop
                if size >= shard_chunks:
                    yield close()
                    ids, numbers, lengths, size = [], [], [], 0
        if ids:
            yield close()

    inner = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("data"))
    ranged = inner.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("data"))
    return cut(ranged.mapInArrow(write, schema), "shards")


def read_shards(files: DataFrame) -> DataFrame:
    """What the files hold: doc_id, start, n_tokens, ids_crc32, n_symbols, by document."""
    import pyarrow as pa

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, n_symbols long"

    def read(batches):
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, name = file_system(path)
                with fs.open_input_stream(name) as f:
                    file = GrammarFile(f.read())
                for at in range(0, len(file.doc_ids), 200):
                    part = range(at, min(at + 200, len(file.doc_ids)))
                    # expanded together, then cut by the documents' first tokens
                    ids = file.expand(file.symbols[file.symbol_at[at] : file.symbol_at[part.stop]]).astype("<u4")
                    cuts = (file.token_at[at : part.stop + 1] - file.token_at[at]).tolist()
                    if cuts[-1] != len(ids):
                        raise ValueError("a file's offsets aren't those of its symbols")
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array([file.doc_ids[k] for k in part], pa.int64()), "start": [first + int(file.token_at[k]) for k in part], "n_tokens": np.diff(cuts).tolist(),
                        "ids_crc32": [zlib.crc32(ids[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], "n_symbols": [int(file.symbol_at[k + 1] - file.symbol_at[k]) for k in part],
                    })

    # the sums of parts, a row for each task that wrote, stand in one task; files are added up part by part
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("before", F.sum("n").over(W.orderBy("part")) - F.col("n")).drop("n")
    within = F.sum("n_tokens").over(W.partitionBy("part").orderBy("k")) - F.col("n_tokens")
    ordered = files.withColumn("within", within).join(F.broadcast(parts), "part").withColumn("first", F.col("before") + F.col("within"))
    n = max(1, min(files.count(), 10_000))
    return ordered.select("path", "first").repartition(n, "path").mapInArrow(read, schema)


def token_shards(docs: DataFrame, tokenizer_path: str, folder: str | None = None, **options) -> DataFrame:
    """Writes docs to grammar files below folder (one of its own by default) and reads them back."""
    return read_shards(write_shards(docs, folder or new_folder(docs.sparkSession, "repair"), tokenizer_path, **options))
