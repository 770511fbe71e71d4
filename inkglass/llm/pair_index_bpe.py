"""Operator 10: byte-level BPE by a pair occurrence index, and its inverse.

Texts are cut into pre-tokens by the tokenizer's pattern. The different pre-tokens that a
Python worker has not met before lie in one array of symbols; an index maps each pair to all
its positions there. Active ranks leave a heap in ascending order; a rank's merge is applied
at every position of its pair at once, and the lists of the pairs beside it are updated. Ids of known
pre-tokens come from the worker's table.

Cases: a null or empty text has no ids and decodes to the empty text. The tokenizer's special
strings in a text give their ids. Repeated rows give equal rows; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkglass.llm.common import small_batches, text_slices
from inkglass.llm.wordtable import ChunkTable, gather

#: Fixed value: the pattern that byte-level pre-tokenizers use.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose classes no Unicode version has changed since they were given. A text
#: with any other is cut by the library's own pre-tokenizer.
SETTLED = r"[^\x00-ɏΑ-ΡΣ-ώЀ-џ‐-‧‰-›€ぁ-ゔァ-ヺ一-龥가-힣]"
MOST_PRETOKENS = 350_000
#: Bytes of text that are encoded together.
SLICE = 4_000_000


def byte_characters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest for 256 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairIndexEncoder:
    def __init__(self, tokenizer_path: str):
        import regex
        from tokenizers import Tokenizer

        data = json.load(open(tokenizer_path, encoding="utf-8"))
        back = byte_characters()
        vocab = data["model"]["vocab"]
        self.bytes_of = {i: bytes(back[c] for c in s) for s, i in vocab.items()}
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.first = np.zeros(256, np.int64)
        for c, b in back.items():
            self.first[b] = vocab[c]
        rank: dict[int, int] = {}
        self.made: list[tuple[int, int]] = []
        for merge in data["model"]["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            code = vocab[a] << 32 | vocab[b]
            rank.setdefault(code, len(self.made))
            self.made.append((code, vocab[a + b]))
        # codes of pairs in order, and a last one that none has, with their ranks; those of two bytes in a table, too
        self.codes = np.array([*sorted(rank), 1 << 62], np.int64)
        self.ranks = np.array([rank.get(c, -1) for c in self.codes.tolist()], np.int64)
        pairs = self.first[:, None] << 32 | self.first
        at = np.searchsorted(self.codes, pairs)
        self.byte_ranks = np.where(self.codes[at] == pairs, self.ranks[at], -1)
        self.find = regex.compile(PATTERN).findall
        self.odd = regex.compile(SETTLED).search
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.library = Tokenizer.from_file(tokenizer_path).pre_tokenizer
        top = max(self.bytes_of) + 1
        sizes = np.array([len(self.bytes_of.get(i, b"")) for i in range(top)], np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(top)), np.uint8)
        self.sizes, self.at = sizes, np.cumsum(sizes) - sizes
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.int64)
        self.starts = np.zeros(1 << 14, np.int64)
        self.counts = np.zeros(1 << 14, np.int64)
        self.texts: list[str] = []
        self.n_ids = 0

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each has, by the index of all words' pairs. All places of a rank are
        merged at once; place n stands for what lies before and after a word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        n, ends = len(data), np.cumsum(sizes)
        begins = ends - sizes
        symbols = np.append(self.first[data], -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends[sizes > 0] - 1] = before[begins[sizes > 0]] = n
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def put(ranks: np.ndarray, places: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
            for at, s in enumerate(ranks[cuts[:-1]].tolist()):
                part = places[cuts[at] : cuts[at + 1]]
                if s in index:
                    index[s].append(part)
                else:
                    index[s] = [part]
                    heapq.heappush(active, s)

        def indexed(codes: np.ndarray, places: np.ndarray) -> None:
            at = np.searchsorted(self.codes, codes)
            hit = np.flatnonzero(self.codes[at] == codes)
            if len(hit):
                put(self.ranks[at[hit]], places[hit])

        if n > 1:
            ranks = self.byte_ranks[data[:-1], data[1:]]
            places = np.flatnonzero((ranks >= 0) & (after[: n - 1] < n))
            if len(places):
                put(ranks[places], places)
        while active:
            r = heapq.heappop(active)
            code, new = self.made[r]
            a, b = code >> 32, code & 0xFFFFFFFF
            parts = index.pop(r)
            i = np.sort(parts[0] if len(parts) == 1 else np.concatenate(parts))
            j = after[i]
            fits = (symbols[i] == a) & (symbols[j] == b)
            fits[1:] &= i[1:] != i[:-1]
            i = i[fits]
            if a == b and len(i) > 1:  # of a run of equal symbols the first, third ...
                number = np.arange(len(i))
                begun = np.concatenate([[True], after[i[:-1]] != i[1:]])
                i = i[(number - np.maximum.accumulate(np.where(begun, number, 0))) % 2 == 0]
            if not len(i):
                continue
            j = after[i]
            symbols[i], symbols[j] = new, -1
            k = after[i] = after[j]
            before[k] = i
            h = before[i]
            indexed(np.concatenate([new << 32 | symbols[k], symbols[h] << 32 | new]), np.concatenate([i, h]))
        left = symbols[:n] >= 0
        until = np.concatenate([[0], np.cumsum(left)])
        return symbols[:n][left], until[ends] - until[begins]

    def pieces(self, text: str) -> list[str]:
        if self.odd(text):
            at = [x for _, x in self.library.pre_tokenize_str(text)]
            return [text[a:b] for a, b in at]
        return self.find(text)

    def pretokens(self, text: str) -> list[str]:
        """Pre-tokens and special strings in a row."""
        if self.cut_special is None or not any(s in text for s in self.special):
            return self.pieces(text)
        return [p for k, part in enumerate(self.cut_special(text)) for p in ([part] if k % 2 else self.pieces(part))]

    def add(self, tokens: set[str]) -> None:
        new = sorted(tokens.difference(self.number))
        for at in range(0, len(new), 100_000):
            part = new[at : at + 100_000]
            # a special string is one symbol, which has no pair
            flat, counts = self.merge([b"\0" if p in self.special else p.encode() for p in part])
            stops = np.cumsum(counts)
            for k, p in enumerate(part) if self.special else ():
                if p in self.special:
                    flat[stops[k] - 1] = self.special[p]
            first = len(self.number)
            self.number.update(zip(part, range(first, first + len(part)), strict=True))
            self.ids = ChunkTable.room(self.ids, self.n_ids + len(flat))
            self.starts, self.counts = ChunkTable.room(self.starts, first + len(part)), ChunkTable.room(self.counts, first + len(part))
            self.ids[self.n_ids : self.n_ids + len(flat)] = flat
            self.counts[first : first + len(part)] = counts
            self.starts[first : first + len(part)] = self.n_ids + stops - counts
            self.n_ids += len(flat)
            shown, stops = list(map(str, flat.tolist())), stops.tolist()
            self.texts += [",".join(shown[a:b]) for a, b in zip([0, *stops], stops, strict=False)]

    def encode(self, texts: list[str | None]):
        """For each text its ids and the ids' decimal text."""
        tokens = [self.pretokens(t) if t else [] for t in texts]
        seen = set().union(*tokens) if tokens else set()
        if len(self.number) + len(seen) > MOST_PRETOKENS:
            self.clear()
        self.add(seen)
        number, shown = self.number.__getitem__, self.texts.__getitem__
        for t in tokens:
            n = list(map(number, t))
            at = np.array(n, np.int64)
            yield gather(self.ids, self.starts[at], self.counts[at]), ",".join(map(shown, n))

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids in UTF-8; what is no UTF-8 becomes U+FFFD."""
        data = gather(self.flat, self.at[ids], self.sizes[ids]).tobytes()
        return data.decode("utf-8", "replace").encode()


_encoders: dict[str, PairIndexEncoder] = {}


def encoder_of(path: str) -> PairIndexEncoder:
    if path not in _encoders:
        _encoders[path] = PairIndexEncoder(path)
    return _encoders[path]


def encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with a column of ids more; every other column stays."""
    import pyarrow as pa

    kept = [c for c in docs.columns if c != ids_col]

    def run(batches):
        coder = encoder_of(tokenizer_path)
        for batch in batches:
            for a, texts in text_slices(batch, len(kept), SLICE):
                ids = [x.astype(np.int32) for x, _ in coder.encode(texts)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, len(texts)) for i in range(len(kept))), pa.array(ids, pa.list_(pa.int32()))], names=[*kept, ids_col])

    small_batches(docs.sparkSession)
    own = "__text"
    schema = docs.select(*kept).withColumn(ids_col, F.array().cast("array<int>")).schema
    return docs.select(*kept, F.col(text_col).alias(own)).mapInArrow(run, schema)


def decode(docs: DataFrame, tokenizer_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """docs with the text of its ids; null ids give null."""
    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        coder = encoder_of(tokenizer_path)
        return ids.map(lambda x: None if x is None else coder.decode(np.asarray(x, np.int64)).decode())

    return docs.withColumn(text_col, run(ids_col))


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    import pyarrow as pa

    def run(batches):
        coder = encoder_of(tokenizer_path)
        for batch in batches:
            for a, texts in text_slices(batch, 1, SLICE):
                out = [(len(ids), hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()) for ids, shown in coder.encode(texts)]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(a, len(texts)), "n_tokens": [x[0] for x in out], "ids_sha256": [x[1] for x in out], "decoded_sha256": [x[2] for x in out]})

    small_batches(docs.sparkSession)
    inner = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return inner.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
