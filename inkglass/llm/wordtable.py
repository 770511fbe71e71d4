"""Chunks of text mapped to token ids by way of a table that a Python worker keeps.

Where a tokenizer's file says that white space ends every pre-token and is dropped, and that texts are
normalised by nothing but NFC and lower-casing, a text's ids are those of its white-space-separated
chunks in a row. Each different chunk is encoded once by the library and looked up after. With any other
tokenizer a whole text is one chunk.
"""

from __future__ import annotations

import json
from itertools import chain, repeat

import numpy as np

#: Chunks kept at most; beyond it the table is begun anew (a matter of speed only).
MOST_CHUNKS = 1_200_000


def among(characters: bytes) -> np.ndarray:
    """Which of the 256 bytes are among these."""
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


WORDS = among(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
MARKS, ENDS = among(b".,"), among(b" \n")


def marks_apart(text: bytes) -> bytes:
    """A space before each full stop or comma that ends a chunk after an ASCII letter or digit: it is a pre-token of its own."""
    data = np.frombuffer(text, np.uint8)
    at = np.flatnonzero(MARKS[data[1:-1]]) + 1
    at = at[WORDS[data[at - 1]] & ENDS[data[at + 1]]]
    return np.insert(data, at, 32).tobytes() if len(at) else text


#: Fixed value: a pre-tokenizer that drops white space, with letters, single digits and other characters apart.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Bytes of chunks that the table holds before it is begun anew.
MOST_BYTES = 64_000_000


def parts_of(what: dict | None, name: str) -> list[dict]:
    """The steps of a normalizer or pre-tokenizer."""
    return [] if what is None else what[name] if what["type"] == "Sequence" else [what]


def cuts_at_spaces(file: dict) -> tuple[bool, bool]:
    """If the chunks between white space can be encoded one by one, and if letters become lower case."""
    steps = parts_of(file.get("normalizer"), "normalizers")
    kinds = {x["type"] for x in steps}
    spaces = all(x.get("pattern") == {"Regex": r"\s+"} and x.get("content") == " " for x in steps if x["type"] == "Replace")
    cutters = parts_of(file.get("pre_tokenizer"), "pretokenizers")
    split = bool(cutters) and (cutters[0]["type"], cutters[0].get("pattern"), cutters[0].get("behavior"), cutters[0].get("invert")) == ("Split", {"Regex": SPLIT}, "Removed", True)
    rest = all(x["type"] == "ByteLevel" and not x.get("use_regex", True) and not x.get("add_prefix_space", True) for x in cutters[1:])
    return kinds <= {"NFC", "Replace", "Lowercase"} and spaces and split and rest, "Lowercase" in kinds


def lowered(text: bytes, lowers: bool) -> bytes:
    """A-Z in lower case, as a tokenizer that lowers does it, unless the text has combining marks, which could compose
    with one case only, or what might be a special string."""
    return text.lower() if lowers and b"<|" not in text and b"\xcc" not in text and b"\xcd" not in text else text


def plainer(text: bytes, lowers: bool) -> bytes:
    """The text with fewer different chunks and the same ids: in lower case, and end marks apart."""
    return marks_apart(lowered(text, lowers))


def all_plainer(texts: list[bytes], lowers: bool):
    """plainer() of all texts at once, as an Arrow array; each has one white space more at its end, which tells it from the next
    and is no end of a chunk for marks_apart()."""
    import pyarrow as pa

    joined = b"\x0b".join([*(lowered(t, lowers) for t in texts), b""])
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    data = np.frombuffer(joined, np.uint8)
    at = np.flatnonzero(MARKS[data[1:-1]]) + 1
    at = at[WORDS[data[at - 1]] & ENDS[data[at + 1]]]
    offsets = np.concatenate([[0], ends + np.searchsorted(at, ends)]).astype(np.int32)
    plain = np.insert(data, at, 32) if len(at) else data
    return pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(plain)])


def plain_letters(chunk: str) -> bool:
    """If a chunk is of letters below U+0250 only: none of them changes in NFC or becomes a mark in lower case
    (but for one), so the tokenizer takes it as one pre-token."""
    return chunk.isalpha() and max(chunk) < "\u0250" and "\u0130" not in chunk


class ChunkTable:
    """Chunk (bytes) -> number; flat ids with the start of each chunk's."""

    def __init__(self, tokenizer_path: str, most: int = MOST_CHUNKS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = self.letters = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.most = most
        file = json.load(open(tokenizer_path, encoding="utf-8"))
        self.by_chunks, self.lowers = cuts_at_spaces(file)
        names = self.tokenizer.get_vocab()
        #: By id, if it ends a word; None for tokenizers that don't mark the ends of words.
        self.ends_word = np.zeros(max(names.values()) + 1, bool)
        self.ends_word[[i for name, i in names.items() if name.endswith("</w>")]] = True
        if not self.ends_word.any() or not self.by_chunks:
            self.ends_word = None
        if self.ends_word is not None and not any(plain_letters(x["content"]) for x in file["added_tokens"]):
            # chunks of plain letters need no NFC and no pattern: white space cuts them as the pattern does; the model is shared
            self.letters = Tokenizer(self.tokenizer.model)
            self.letters.normalizer = normalizers.Lowercase() if self.lowers else normalizers.Sequence([])
            levels = [pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)] * any(x["type"] == "ByteLevel" for x in parts_of(file.get("pre_tokenizer"), "pretokenizers"))
            self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), *levels])
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.counts = np.zeros(1 << 14, np.int64)
        self.n_ids = self.held = 0

    @staticmethod
    def room(array: np.ndarray, n: int) -> np.ndarray:
        if n <= len(array):
            return array
        out = np.zeros(max(n, 2 * len(array)), array.dtype)
        out[: len(array)] = array
        return out

    def apart(self, part: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks in a row and how many each has; one call of the library for each."""
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.uint32, int(counts.sum())), counts

    def together(self, part: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for chunks of plain letters, in one call. Each is one pre-token, whose last id ends a word."""
        flat = np.array(self.letters.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
        stops = np.flatnonzero(self.ends_word[flat]) + 1
        if len(stops) != len(part) or stops[-1] != len(flat):
            return self.apart(part)
        return flat, np.diff(stops, prepend=0)

    def add(self, new: list[bytes]) -> None:
        texts = [c.decode("utf-8", "replace") for c in new]
        plain = [self.ends_word is not None and (c.isalpha() or plain_letters(t)) for c, t in zip(new, texts, strict=True)]
        for kind, encode in ((True, self.together), (False, self.apart)):
            self.add_parts([c for c, p in zip(new, plain, strict=True) if p == kind], [t for t, p in zip(texts, plain, strict=True) if p == kind], encode)

    def add_parts(self, new: list[bytes], texts: list[str], encode) -> None:
        for at in range(0, len(new), 5000):
            part = new[at : at + 5000]
            flat, counts = encode(texts[at : at + 5000])
            first = len(self.number)
            self.number.update(zip(part, range(first, first + len(part)), strict=True))
            self.held += sum(map(len, part))
            self.ids = self.room(self.ids, self.n_ids + len(flat))
            self.starts = self.room(self.starts, first + len(part))
            self.counts = self.room(self.counts, first + len(part))
            self.ids[self.n_ids : self.n_ids + len(flat)] = flat
            self.counts[first : first + len(part)] = counts
            self.starts[first : first + len(part)] = self.n_ids + np.cumsum(counts) - counts
            self.n_ids += len(flat)

    def numbers(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Chunk numbers of all texts in a row, and how many each text has. Chunks that are not in
        the table yet are encoded and come in."""
        import pyarrow as pa
        import pyarrow.compute as pc

        # cut and told apart in Arrow: only different chunks become objects of Python
        if self.by_chunks:
            lists = pc.ascii_split_whitespace(all_plainer(texts, self.lowers))
            listed, lengths = lists.flatten(), pc.list_value_length(lists).to_numpy().astype(np.int64)
        else:
            listed, lengths = pa.array(texts, pa.binary()).view(pa.string()), np.ones(len(texts), np.int64)
        told = listed.dictionary_encode()
        names, places = told.dictionary.view(pa.binary()).to_pylist(), told.indices.to_numpy()
        empty = names.index(b"") if b"" in names else -1
        if empty >= 0:  # before or after white space
            full = places != empty
            ends = np.concatenate([[0], np.cumsum(full)])[np.concatenate([[0], np.cumsum(lengths)])]
            places, lengths = places[full], np.diff(ends)
        numbers = np.fromiter(map(self.number.get, names, repeat(-1)), np.int64, len(names))
        missing = [k for k in np.flatnonzero(numbers < 0).tolist() if k != empty]
        if missing:
            absent = [names[k] for k in missing]
            self.add(absent)
            numbers[missing] = np.fromiter(map(self.number.__getitem__, absent), np.int64, len(absent))
        flat = numbers[places]
        return flat, lengths

    @property
    def full(self) -> bool:
        """If the table should be begun anew before more texts."""
        return len(self.number) > self.most or self.held > MOST_BYTES


def gather(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """values[s:s+c] of all (s, c) in a row."""
    total = int(counts.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(counts)
    return values[np.repeat(starts - (ends - counts), counts) + np.arange(total)]


_tables: dict[str, ChunkTable] = {}


def table_of(path: str) -> ChunkTable:
    """This worker's table for a tokenizer file."""
    if path not in _tables:
        _tables[path] = ChunkTable(path)
    return _tables[path]
