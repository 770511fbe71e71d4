import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkglass.llm import decontaminate, jaccard_regions, line_edits, line_rules, minimax_shards, pair_index_bpe, quotes, repair_files, url_rules, warc_members
from inkglass.llm.components import components
from inkglass.llm.queries import QUERIES, TOKENIZERS

from . import brute

SF = "/root/testdata/sf0.001"
WORD, BYTE = f"{TOKENIZERS}/word_bpe_49k.json", f"{TOKENIZERS}/byte_bpe_50k.json"
DOC = "doc_id long, text string, source string, block string, line string, n long, key string, region string"
ODD = ["", None, " ", "\n", "One", "a b c d", "É è\u00a0ß  \u2028 x'll 12 \x1c\x1f end", "<|endoftext|> a<|endoftext|>b", "ΑΣ ΣΑΣ İstanbul ǅ \u0558 \U0001f600", "x" * 50_000, "w " * 30_000, "a\r\nb\tc\x0bd", "'S 'Re don't DON'T"]


def small(spark, texts, **more):
    rows = [(i, t, "h", "b", "l", 1, "k", "r") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def documents(name="documents"):
    t = pq.read_table(f"{SF}/{name}.parquet").to_pylist()
    return t


def edge_rows():
    """Odd texts with repeated rows, a null id and extra columns."""
    rows = [(i, t, "h" if i % 2 else None, "b", "l", 1, "k", "r") for i, t in enumerate(ODD)]
    return [*rows, rows[4], rows[6], rows[6], (None, "no id here at all", "h", None, None, None, None, None), (99, ODD[6], None, None, None, None, None, None)]


def test_token_files(spark):
    docs = [(r["doc_id"], r["text"]) for r in documents()]
    tokenizer = Tokenizer.from_file(WORD)
    found = repair_files.token_shards(spark.read.parquet(f"{SF}/documents.parquet"), WORD, shard_chunks=5000).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found) == brute.token_rows(docs, tokenizer)
    rows = edge_rows()
    found = repair_files.token_shards(spark.createDataFrame(rows, DOC), WORD).collect()
    expect = brute.token_rows([r[:2] for r in rows], tokenizer)
    strip = lambda x: sorted((r[0] is not None, r[0] or 0, *r[1:]) for r in x)
    assert strip((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found) == strip(expect)
    assert repair_files.token_shards(spark.createDataFrame([], DOC), WORD).count() == 0


def test_grammar_reads_at_random():
    rng = np.random.default_rng(3)
    words = [rng.integers(5, 40, rng.integers(0, 6)).astype(np.uint32) for _ in range(60)]
    counts = np.array([len(w) for w in words])
    flat, starts = np.concatenate(words), np.cumsum(counts) - counts
    lengths = rng.integers(0, 80, 50)
    numbers = rng.zipf(1.4, lengths.sum()) % 60
    parts = np.split(numbers, np.cumsum(lengths)[:-1])
    plain = [np.concatenate([*(words[i] for i in p), [1]]).astype(np.uint32) for p in parts]
    file = repair_files.GrammarFile(repair_files.pack(list(range(50)), *repair_files.compress(numbers, lengths, flat, starts, counts, 1)))
    assert len(file.rules) > 5 and len(file.symbols) < sum(map(len, plain)) * 0.7
    for k, p in enumerate(plain):
        assert (file.document(k) == p).all()
    whole = np.concatenate(plain)
    for _ in range(200):
        a, b = sorted(rng.integers(0, len(whole) + 1, 2))
        assert (file.tokens(int(a), int(b)) == whole[a:b]).all()


class Counted:
    """Bytes to read at random, and how many were."""

    def __init__(self, data):
        self.data, self.n = data, 0

    def read_at(self, size, offset):
        self.n += size
        return self.data[offset : offset + size]


@pytest.mark.parametrize("three", [1 << 24, 1])
def test_tokens_are_read_in_place(monkeypatch, three):
    monkeypatch.setattr(repair_files, "THREE_BYTES", three)
    rng = np.random.default_rng(4)
    words = [rng.integers(5, 40, rng.integers(0, 6)).astype(np.uint32) for _ in range(60)]
    counts = np.array([len(w) for w in words])
    flat, starts = np.concatenate(words), np.cumsum(counts) - counts
    lengths = np.append(rng.integers(0, 80, 50), 60_000)
    numbers = rng.zipf(1.4, lengths.sum()) % 60
    parts = np.split(numbers, np.cumsum(lengths)[:-1])
    whole = np.concatenate([np.concatenate([*(words[i] for i in p), [1]]).astype(np.uint32) for p in parts])
    data = repair_files.pack(list(range(51)), *repair_files.compress(numbers, lengths, flat, starts, counts, 1))
    assert data[:4] == (b"IGRP" if three > 1 else b"IGR4")
    assert all((repair_files.GrammarFile(data).document(k)[-1:] == 1).all() for k in range(51))
    reader = repair_files.TokenReader(Counted(data))
    for _ in range(200):
        a, b = sorted(rng.integers(0, len(whole) + 1, 2))
        assert (reader.tokens(int(a), int(b)) == whole[a:b]).all()
    assert len(reader.tokens(-5, 0)) == 0 and (reader.tokens(-5, 3) == whole[:3]).all() and len(reader.tokens(5, 5)) == 0
    # a document's symbols are read, not the file's
    before = reader.file.n
    reader.tokens(3, 9)
    assert reader.file.n - before < len(data) / 50
    empty = repair_files.TokenReader(Counted(repair_files.pack([], repair_files.Grammar(), np.zeros(0, np.int64), np.zeros(1, np.uint64), np.zeros(1, np.uint64))))
    assert len(empty.tokens(0, 10)) == 0


def test_token_files_of_other_tokenizers(spark):
    """Tokenizers that keep case and white space get whole texts."""
    texts = ["Hello World. The END, ok", "a  b\n\nC.", *(t for t in ODD if t is None or len(t) < 1000)]
    tokenizer = Tokenizer.from_file(BYTE)
    found = repair_files.token_shards(small(spark, texts), BYTE).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found) == brute.token_rows(list(enumerate(texts)), tokenizer)


def test_grammar_ends_without_frequent_pairs():
    """Re-Pair goes on until no pair of symbols occurs LEAST times in places that don't overlap."""
    from collections import Counter

    rng = np.random.default_rng(8)
    words = [rng.integers(5, 15, rng.integers(1, 9)).astype(np.uint32) for _ in range(200)] + [np.full(5000, 9, np.uint32), np.full(7, 4, np.uint32)]
    counts = np.array([len(w) for w in words])
    flat, starts = np.concatenate(words), np.cumsum(counts) - counts
    lengths = rng.integers(1, 90, 40)
    numbers = np.concatenate([rng.zipf(1.3, lengths.sum() - 3) % 201, [200, 201, 200]])
    grammar, symbols, symbol_at, _ = repair_files.compress(numbers, lengths, flat, starts, counts, 1)
    pairs = Counter()
    for a, b in zip(symbol_at.tolist(), symbol_at.tolist()[1:]):
        part, last = symbols[a : b - 1].tolist(), None
        for i, pair in enumerate(zip(part, part[1:])):
            if pair[0] != pair[1] or last != (i - 1, pair):
                pairs[pair] += 1
                last = (i, pair)
    assert max(pairs.values(), default=0) < repair_files.LEAST
    longest = np.concatenate([np.ones(repair_files.BASE, np.int64), repair_files.GrammarFile(repair_files.pack(list(range(40)), grammar, symbols, symbol_at, np.zeros(41, np.uint64))).lengths]).max()
    assert longest >= 1024  # runs of one symbol are halved again and again


def test_plain_chunks_are_encoded_together():
    from inkglass.llm.wordtable import ChunkTable

    table, rng = ChunkTable(WORD), random.Random(11)
    letters = [chr(c) for c in range(0x24F) if chr(c).isalpha()] + list("etaoin")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 12))) for _ in range(4000)] + ["a1", "don't", "\u0130x", "\u1e9b\u0323", "x" * 30_000]
    numbers, _ = table.numbers([" ".join(texts).encode()])
    for number, text in zip(numbers.tolist(), texts, strict=True):
        at = table.starts[number]
        assert table.ids[at : at + table.counts[number]].tolist() == table.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_texts_made_plainer_at_once():
    """A batch's texts get the chunks that they get one by one, in a few steps for all; plain letters are encoded without NFC and pattern."""
    import sys

    from inkglass.llm import wordtable

    rng, table = random.Random(8), wordtable.ChunkTable(WORD)
    pool = ["a", "B", "9", ".", ",", " ", "\n", "\x0b", "\u00e9", "\u00c9", "e\u0301.", "<|", "end. ", "x,\n", "\u4e2d."]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(12))).encode() for _ in range(3000)] + [b"", b".", b"a.", b" ", b"a. "]
    found = wordtable.all_plainer(texts, True).to_pylist()
    assert [x.encode()[:-1] for x in found] == [wordtable.plainer(t, True) for t in texts] and {x[-1] for x in found} == {"\x0b"}
    assert wordtable.all_plainer([], True).to_pylist() == []
    assert table.letters is not table.tokenizer and table.letters.pre_tokenizer is not None
    numbers, lengths = table.numbers(texts)
    ids = [table.ids[table.starts[k] : table.starts[k] + table.counts[k]].tolist() for k in numbers.tolist()]
    ends = [0, *lengths.cumsum().tolist()]
    assert all(sum(ids[a:b], []) == table.tokenizer.encode(t.decode(), add_special_tokens=False).ids for t, a, b in zip(texts, ends, ends[1:], strict=False))
    calls = 0

    def count(*_):
        nonlocal calls
        calls += 1

    sys.setprofile(count)
    wordtable.ChunkTable.numbers(table, texts)
    sys.setprofile(None)
    assert calls < 10 * len(texts)


def test_pair_index(spark):
    docs = [(r["doc_id"], r["text"]) for r in documents()] + [r[:2] for r in edge_rows()]
    tokenizer = Tokenizer.from_file(BYTE)

    def plain(d, t):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        return (d is not None, d or 0, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest())

    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = pair_index_bpe.round_trip(df, BYTE).collect()
    assert sorted((r[0] is not None, r[0] or 0, *r[1:]) for r in found) == sorted(plain(*x) for x in docs)
    both = pair_index_bpe.decode(pair_index_bpe.encode(df, BYTE), BYTE).collect()
    assert all(r.decoded == (r.text or "") for r in both) and len(both) == len(docs)


def test_pair_index_random():
    coder, tokenizer, rng = pair_index_bpe.PairIndexEncoder(BYTE), Tokenizer.from_file(BYTE), random.Random(5)
    pool = [chr(c) for c in [*range(0, 0x250), 0x3A3, 0x5D0, 0x627, 0x4E2D, 0x558, 0x58B, 0x1F600, 0x2028, 0x85, 0x1680, 0x200B, 0x0301]] + [" ", " ", "the", " and", "\n\n", "'s"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(1500)]
    for t, (ids, shown) in zip(texts, coder.encode(texts), strict=True):
        plain = tokenizer.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == plain and shown == ",".join(map(str, plain)), repr(t)
        assert coder.decode(ids).decode() == tokenizer.decode(plain, skip_special_tokens=False)


def test_pair_index_merges_places_together():
    """Steps of a merge follow the ranks that occur, not the words; runs of equal symbols and odd words come out as the library's."""
    import sys

    coder, tokenizer, rng = pair_index_bpe.PairIndexEncoder(BYTE), Tokenizer.from_file(BYTE), random.Random(6)

    def steps(words):
        calls = 0

        def count(*_):
            nonlocal calls
            calls += 1

        sys.setprofile(count)
        try:
            coder.merge(words)
        finally:
            sys.setprofile(None)
        return calls

    words = ["notwithstanding", "aaaaaaa", "understandably"]
    assert steps([w.encode() for w in words * 1000]) < 2 * steps([w.encode() for w in words * 10])
    words = ["".join(rng.choice("aab=") for _ in range(rng.randrange(1, 60))) for _ in range(500)] + ["=" * n for n in range(1, 70)]
    words = [w for w in words if len(coder.pretokens(w)) == 1]
    flat, counts = coder.merge([w.encode() for w in words])
    assert counts.tolist() == [len(tokenizer.encode(w).ids) for w in words] and flat.tolist() == [i for w in words for i in tokenizer.encode(w).ids]


def test_decontaminate(spark):
    items = [(r["item_id"], r["text"]) for r in documents("benchmark")] + [(900, "short item"), (900, "short item"), (901, ""), (902, None), (None, "only five words stand here")]
    rows = [(r["doc_id"], r["text"]) for r in documents()] + [(5000, f"Some {items[0][1].upper()} and a SHORT item; only five words stand here!"), (5001, None), (5002, ""), (5002, ""), (None, "short item")]
    rows += [(5003, " ".join(x for x in [items[1][1], *[f"z{i}" for i in range(6000)], items[2][1]]))]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    sort = lambda x: sorted((r[0] is not None, r[0] or 0, *r[1:]) for r in x)
    expect = sort(brute.contamination(rows, items))
    assert sort(tuple(r) for r in decontaminate.scan(df, bench).collect()) == expect
    assert sort(tuple(r) for r in decontaminate.scan(df, bench, most_bytes=300).collect()) == expect
    clash = df.withColumn("data", F.lit(1)).withColumn("keep_text", F.lit("k")).withColumn("places", F.lit(2)).withColumn("items", F.lit("i"))
    for most in (10**6, 300):
        spans = decontaminate.decontaminate(clash, bench, remove="spans", most_bytes=most)
        assert spans.columns == clash.columns and {tuple(r)[2:] for r in spans.collect()} == {(1, "k", 2, "i")}
    clean = decontaminate.decontaminate(df, bench).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in clean) == sorted((not x[0], x[1]) for x in expect if not x[-1])
    spans = decontaminate.decontaminate(df, bench, remove="spans")
    assert spans.columns == df.columns and spans.count() == len(rows)
    assert not any(r[-1] for r in decontaminate.scan(spans, bench).collect())
    assert "Some " in spans.where("doc_id = 5000").first().text
    assert decontaminate.scan(df, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.scan(df.limit(0), bench).count() == 0


def test_ngram_set_memory():
    """With the set, items of MOST_BYTES take at most 60 times their text, even if all words differ."""
    import tracemalloc

    for words in ([f"w{i % 20_000}" for i in range(200_000)], [f"w{i}" for i in range(200_000)]):
        items = [(str(k), " ".join(words[k : k + 100]).encode()) for k in range(0, len(words), 100)]
        size = sum(len(t) for _, t in items)
        tracemalloc.start()
        found = decontaminate.NgramSet(items)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak <= 60 * size and 60 * decontaminate.MOST_BYTES <= 250_000_000, peak / size
        assert found.scan(items[7][1])[1].all() and "700" in found.scan(items[7][1])[2]


@pytest.mark.parametrize(("bits", "more"), [(4, 3), (1, 60)])
def test_shards_are_smallest_over_all_groups(spark, bits, more, monkeypatch):
    """Blocks of many groups are divided until no cut could be better."""
    rng = random.Random(bits + more)
    monkeypatch.setattr(minimax_shards, "OPEN_MOST", 40)
    for shards, hot in ((7, 0), (5, 400)):
        rows = [(i, "x" * rng.choice([1, 5, 50, 900]) + str(rng.randrange(250))) for i in range(500)] + [(1000 + i, "hot" * 30) for i in range(hot)]
        frame = spark.createDataFrame([(i, t, "c", 1, 2, 3) for i, t in rows], "doc_id long, text string, shard string, size int, u int, block int")
        found = minimax_shards.assign(frame, shards, bits=bits, more=more).toPandas()
        hashes = {r.text: r.h for r in frame.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
        sizes: dict = {}
        for _, t in rows:
            sizes[hashes[t]] = sizes.get(hashes[t], 0) + len(t) + 16
        groups = [sizes[h] for h in sorted(sizes, key=lambda h: h % 2**64)]
        assert len(found) == len(rows) and found.groupby("shard")["size"].sum().max() <= minimax_shards.smallest_capacity(groups, shards)
        assert found.groupby("text_crc32")["shard"].nunique().max() == 1
        for _, part in found.groupby("shard"):
            assert sorted(part.slot) == list(range(len(part)))


def test_shards(spark):
    rng = random.Random(1)
    for _ in range(300):
        sizes = [rng.choice([1, 2, 3, 5, 100]) for _ in range(rng.randrange(0, 30))]
        n = rng.randrange(1, 8)
        best = minimax_shards.smallest_capacity(sizes, n)

        def least(at, left, memo={}):  # noqa: B006
            if left == 1:
                return sum(sizes[at:])
            return min(max(sum(sizes[at:k]), least(k, left - 1)) for k in range(at, len(sizes) + 1))

        if len(sizes) <= 10 and n <= 4:
            assert best == least(0, n), (sizes, n)
        at = minimax_shards.cuts(sizes, n)
        assert len(at) == n + 1 and at[0] == 0 and at[-1] == len(sizes) and at == sorted(at)
        assert all(sum(sizes[a:b]) <= best for a, b in zip(at, at[1:], strict=False))
    rows = [(r["doc_id"], r["text"]) for r in documents()] + [(7000 + i, "copy") for i in range(3000)] + [(1, None), (1, None), (2, ""), (None, "x")]
    found = minimax_shards.assign(spark.createDataFrame(rows, "doc_id long, text string"), 7).toPandas()
    assert len(found) == len(rows)
    assert set(found.law) == {"bytes"} and found.grown_shard.isna().all()
    for _, part in found.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    text = {d: t or "" for d, t in rows}
    place = {}
    for r in found.itertuples():
        t = text[None if r.doc_id != r.doc_id else int(r.doc_id)] if r.doc_id == r.doc_id else "x"
        if int(r.doc_id if r.doc_id == r.doc_id else -1) not in (1, 2):
            assert place.setdefault(t, r.shard) == r.shard
    totals = found.groupby("shard")["size"].sum()
    assert totals.max() - totals.min() <= found.groupby("text_crc32")["size"].sum().max()
    assert minimax_shards.assign(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("shards", [3, 7])
def test_shards_by_brute_force(spark, shards):
    import xxhash

    rng = random.Random(shards)
    texts = ["x" * rng.randrange(400) + str(i) for i in range(50)]
    rows = [(i, rng.choice(texts)) for i in range(300)] + [(1000 + i, texts[0]) for i in range(100)]
    groups = defaultdict(list)
    for d, t in rows:
        groups[t].append(d)
    order = sorted(groups, key=lambda t: (xxhash.xxh64(t, seed=42).intdigest() >> 46, t))
    assert len({xxhash.xxh64(t, seed=42).intdigest() >> 46 for t in order}) == len(order)
    found = {r.doc_id: r for r in minimax_shards.assign(spark.createDataFrame(rows, "doc_id long, text string"), shards).collect()}
    totals, last = Counter(), 0
    for t in order:
        at = {found[d].shard for d in groups[t]}
        assert len(at) == 1 and last <= min(at)
        last = min(at)
        totals[last] += (len(t) + 16) * len(groups[t])
    assert max(totals.values()) == brute.shard_load([(len(t) + 16) * len(groups[t]) for t in order], shards)


def near_texts(rng, groups=12, words=60):
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(25)]
    out = []
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(words // 2, words))] + (passage if g % 2 else [])
        for _ in range(rng.randrange(1, 14)):
            copy = list(base)
            for _ in range(rng.randrange(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("cell", [1024, 4])
def test_jaccard(spark, monkeypatch, cell):
    monkeypatch.setattr(jaccard_regions, "FREQUENT", 6 if cell == 4 else 4096)
    monkeypatch.setattr(jaccard_regions, "BLOCK_Q", 3)
    monkeypatch.setattr(jaccard_regions, "BLOCK_M", 5)
    rng = random.Random(cell)
    template = [f"t{i}" for i in range(80)]
    worn = [" ".join(template[:40] + [f"u{i}{j}" for j in range(rng.randrange(3, 6))] + template[40:]) for i in range(25)]
    rows = list(enumerate([*near_texts(rng), *worn, *near_texts(rng), "one two", "ONE two", "one two three", "", None, "w " * 20_000])) + [(3, "again")][:0]
    rows += [rows[0], rows[5], rows[5]]
    df = spark.createDataFrame([(d, t, "h", "b", "l", 1, "k", "r") for d, t in rows] + [(None, "one two", "h", "b", "l", 1, "k", "r")], DOC)
    found = jaccard_regions.join(df, cell=cell, pivots=2).collect()
    assert len(found) == len(rows) + 1
    expect = brute.jaccard(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == expect
    assert [(r.n_shingles, r.component_id) for r in found if r.doc_id is None] == [(1, None)]
    kept = jaccard_regions.keep_one(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {None} | {d for d, (_, c) in expect.items() if c == d}
    assert jaccard_regions.join(df.limit(0)).count() == 0


def test_windows_leave_cells_out(spark):
    """Classes of a region go to the cells of near pivots only, and all that may be links still meet."""
    rng = np.random.default_rng(12)
    sets, component = [], []
    for c in range(6):  # clusters of sets at distances of about a third, beyond a link; some are linked
        base = rng.integers(0, 1 << 63, 200).astype(np.uint64)
        for k in range(40):
            s = base.copy()
            some = rng.choice(200, 20 if k % 4 else 4, replace=False)
            s[some] = rng.integers(0, 1 << 63, len(some)).astype(np.uint64)
            sets.append(np.unique(s))
            component.append(1000 * c + (0 if k < 30 else k))
    for k in range(120):  # and others that are like nothing else
        sets.append(np.unique(rng.integers(0, 1 << 63, 180 + k % 40).astype(np.uint64)))
        component.append(90_000 + k)
    rows = [(7, i, len(s), component[i], jaccard_regions.parity_map(s)) for i, s in enumerate(sets)]
    members = spark.createDataFrame(rows, "region long, id long, n long, component long, map binary")
    bands = jaccard_regions.open_cells(jaccard_regions.banded(members, 80))
    parts = jaccard_regions.divided(bands, 80, 8).collect()
    n, cells = bands.count(), {r.region for r in parts}
    assert len(cells) > 6 and len(parts) < 1.2 * n  # all windows with all cells would make eight times as many
    in_cell = {}
    for r in parts:
        in_cell.setdefault(r.id, set()).add(r.region)
    links = 0
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                links += 1
                assert in_cell[i] & in_cell[j]
    assert links > 100


def test_jaccard_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents()]
    found = jaccard_regions.join(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute.jaccard(rows)


def test_may_link_never_drops_a_link():
    rng = np.random.default_rng(9)
    for _ in range(400):
        both = rng.integers(0, 1 << 63, rng.integers(1, 400)).astype(np.uint64) * np.uint64(2)
        more = [rng.integers(0, 1 << 63, rng.integers(0, 1 + len(both) // 6)).astype(np.uint64) for _ in range(2)]
        s, t = (np.unique(np.concatenate([both, m])) for m in more)
        inter = len(np.intersect1d(s, t))
        if 100 * inter >= 80 * (len(s) + len(t) - inter):
            assert jaccard_regions.may_link((len(s), jaccard_regions.parity_map(s)), (len(t), jaccard_regions.parity_map(t)), 80)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(5, 5), (None, 3)]
    parent = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.id: r.component for r in found} == {x: root(x) for x in parent}


def test_quality(spark):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in documents()]
    boiler = "All of this page is subject to the terms of the site 2024."
    rows += [(3000 + i, f"{boiler}\n" + " ".join(f"v{i}x{j}" for j in range(30)), "site") for i in range(15)]
    rows += [(4000, f"{boiler}\n{boiler[:40].upper()}{boiler[40:]}\nand words of its own", "site"), (4001, None, None), (4002, "", "site"), (4003, "a b c d e f g h i " * 4000, None)] + [(3000, rows[-1][1], "x")][:0]
    rows += [rows[0], rows[0]]
    rows += [(4000 + 100 * i, f"{boiler}\na few more words", "x") for i in range(5, 6)]
    rows += [(5000 + i, "\n".join([" ".join(f"c{k}" for k in range(40)), " ".join(f"d{k}" for k in range(40)) + f" e{i}"]), "site") for i in range(40)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, line int")
    found = line_rules.judge(df).collect()
    assert sorted(tuple(r) for r in found) == sorted(brute.quality(rows))
    verdict = {r.doc_id: r for r in found}
    assert not verdict[4000].base_failed and not verdict[4000].kept and verdict[3000].kept and verdict[3000].n_removed_words == 13
    assert all(verdict[5000 + i].n_removed_words == 40 and verdict[5000 + i].kept for i in range(40))  # near copies are several documents
    kept = line_rules.apply_rules(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in found if r.kept)
    assert boiler not in kept.where("doc_id = 3001").first().text
    assert line_rules.judge(df.limit(0)).count() == 0


@pytest.mark.parametrize("shared", [2, 4, 8, 10, 12])
def test_quality_of_templates(spark, shared):
    """Pages that share template lines are different documents, however many lines they share; exact copies are one."""
    line = lambda name, n=12: " ".join(f"{name}{chr(97 + k)}" for k in range(n))
    name = lambda i: chr(97 + i // 26) + chr(97 + i % 26)
    template = [line(f"t{name(k)}") for k in range(shared)]
    rows = [(i, "\n".join([*template, line(f"own{name(i)}")]), "pages") for i in range(40)]
    article = "\n".join(line(f"n{name(k)}") for k in range(shared))
    rows += [(1000 + i, article, "copies") for i in range(60)] + [(1000 + i, article, "copies") for i in range(5)]
    found = line_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    pages, copies = [r for r in found if r.doc_id < 1000], [r for r in found if r.doc_id >= 1000]
    assert all(r.n_removed_words == 12 * shared and r.kept == (12 >= 0.3 * r.n_words) and not r.base_failed for r in pages)
    assert len(copies) == 65 and all(r.n_removed_words == 0 and r.kept for r in copies)
    assert sorted(tuple(r) for r in found) == sorted(brute.quality(rows))


def test_quality_of_lines_without_letters(spark):
    """Numbers and symbols count as lines; lines that differ in a number are different."""
    words = lambda i: " ".join(f"{chr(97 + i)}w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(30))
    rows = [(i, f"{words(i)}\n+49 (0)30 1234\n* * *\n \t\n+49 (0)30 {1000 + i}", "site") for i in range(15)]
    rows += [(100 + i, f"{words(i)}\nStep {10 ** i} of the guide", "steps") for i in range(12)]
    rows += [(200 + i, f"{words(i)}\n\u0663\u0664", "other") for i in range(12)]
    found = {r.doc_id: r for r in line_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert [found[i].n_removed_words for i in range(15)] == [6] * 15
    assert [found[100 + i].n_removed_words for i in range(12)] == [0] * 12 and [found[200 + i].n_removed_words for i in range(12)] == [1] * 12


def test_line_edits(spark):
    rng = random.Random(4)
    rows = [(r["doc_id"], r["text"]) for r in documents()[:60]]
    base = ["".join(rng.choice("abcdefgh ëß") for _ in range(rng.choice([3, 9, 10, 12, 18, 20, 21, 40, 90]))).strip() or "a" for _ in range(40)]

    def edited(s):
        s = list(s)
        for _ in range(rng.randrange(0, 4)):
            k, at = rng.randrange(3), rng.randrange(len(s))
            s[at : at + 1] = [[], [s[at], "q"], ["z"]][k]
        return "".join(s)

    rows += [(1000 + i, "\n".join(edited(rng.choice(base)) for _ in range(6))) for i in range(120)]
    rows += [(None, base[0] + "\n\n" + base[1]), (2000, None), (2001, ""), (2002, "\n \n" + base[2] + "\n" + base[2]), (2003, "x" * 30_000)]
    rows += [rows[70], rows[70]]
    df = spark.createDataFrame([(*r, "l", "k", 3) for r in rows], "doc_id long, text string, line string, key string, n_chars long")
    expect = brute.removed_lines(rows)
    found = line_edits.report(df).collect()
    assert len(found) == len(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.removed) for r in found) == sorted((d is None, d or 0, sorted(expect.get((d, t), ()))) for d, t in rows)
    clean = line_edits.dedup_lines(df)
    assert clean.columns == df.columns
    texts = {r.doc_id: (r.text, r.n_chars) for r in clean.collect()}
    for d, t in rows[60:180]:
        left = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in expect.get((d, t), ()))
        assert texts[d] == (left if expect.get((d, t)) else t, len(left))
    assert line_edits.report(df.limit(0)).count() == 0


def test_line_keys_are_compiled(spark, monkeypatch, capsys):
    """The JVM interprets methods of more than 8,000 bytes of bytecode, and Spark gives up whole stages of 64 KB."""
    from inkglass.llm.common import cut

    made = {}
    monkeypatch.setattr(line_edits, "cut", lambda df, what: cut(made.setdefault(what, df), what))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        line_edits.report(spark.createDataFrame([(1, "one line of text\nand another")], "doc_id long, text string"))
        capsys.readouterr()
        made["line-keys"].explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(-?\d+)", capsys.readouterr().out)]
    assert len(sizes) > 1 and all(0 < x <= 8000 for x in sizes), sizes


@pytest.mark.parametrize("edits, chars", [(1, 4), (2, 1), (3, 5)])
def test_line_edits_of_wide_characters(spark, edits, chars):
    """Keys count characters, of whatever bytes; a line of other length may lie on the other side of a bound."""
    rng = random.Random(edits)
    rows = []
    for i in range(80):
        a = "".join(rng.choice("ab\u00eb\u2603\U0001f600") for _ in range(rng.randrange(1, 24)))
        b = list(a)
        for _ in range(rng.randrange(0, edits + 2)):
            k, at = rng.randrange(3), rng.randrange(len(b) + 1)
            b[at : at + (k > 0)] = [] if k == 2 else [rng.choice("q\U0001f601")]
        rows += [(2 * i, f"1 {a} 1\n {a}"), (2 * i + 1, f"{''.join(b)}  ")]
    expect = {(d, at) for (d, _), places in brute.removed_lines(rows, edits, chars).items() for at in places}
    found = line_edits.report(spark.createDataFrame(rows, "doc_id long, text string"), edits=edits, chars=chars).collect()
    assert {(r.doc_id, at) for r in found for at in r.removed} == expect and len(expect) > 40


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_bit_parallel_distance(spark, edits):
    from pyspark.sql import functions as F

    rng = random.Random(edits)
    pairs = []
    for _ in range(600):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(6, 30)))
        b = list(a)
        for _ in range(rng.randrange(0, edits + 3)):
            k, at = rng.randrange(3), rng.randrange(len(b))
            b[at : at + 1] = [[], [b[at], rng.choice("ab")], [rng.choice("ab")]][k]
            b = b or ["a"]
        a, b = sorted((a, "".join(b)), key=len, reverse=True)
        if len(a) - len(b) <= edits and len(b) > edits:
            pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", line_edits.verified(F.split("a", ""), F.split("b", ""), edits).alias("x")).collect():
        assert r.x == (brute.levenshtein(r.a, r.b) <= edits), r


def test_quotes(spark):
    first = "Where is the key?\nI can't find it."
    rows = [
        (1, 0, "user", first), (1, 1, "assistant", "> Where is the key?\n> I can't find it.\nOn the table."),
        (1, 2, "user", ">> where is the KEY\n> On the table.\nThanks!"), (1, 3, "user", "> not said by anyone\nwell"), (1, 4, "user", "plain"),
        (2, 0, "user", "> On the table.\nWho said so?"), (4, 0, "user", "Well.\nOn Monday, A wrote:\n> On the table.\nOn Tuesday, B wrote:\nYes."), (4, 1, "user", ">" * 100_000 + " On the table."), (2, 1, "user", None), (2, 2, "user", ""), (None, 0, "user", "> Thanks!"), (2, None, "user", "Thanks!"), (2, 3, None, ">" * 2000), (1, 4, "user", "plain"),
    ]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, level int, h int")
    found = {(r.conv_id, r.turn): r for r in quotes.link(df).collect()}
    assert quotes.link(df).count() == len(rows)
    at = lambda c, t: (found[c, t].max_level, found[c, t].n_passages, found[c, t].n_linked, found[c, t].quoted_conv, found[c, t].quoted_turn, found[c, t].parent_turn, found[c, t].root_turn, found[c, t].depth)
    assert at(1, 0) == (0, 0, 0, None, None, None, 0, 0)
    assert at(1, 1) == (1, 1, 1, 1, 0, 0, 0, 1)
    assert at(1, 2) == (2, 2, 2, 1, 1, 1, 0, 2)
    assert at(1, 3) == (1, 1, 0, None, None, None, 3, 0)
    assert at(2, 0) == (1, 1, 1, 1, 1, None, 0, 0)
    assert found[1, 2].clean_text == "Thanks!" and found[1, 0].clean_text == first and found[2, 1].clean_text == ""
    assert found[4, 0].clean_text == "Well.\nOn Tuesday, B wrote:\nYes." and at(4, 0)[:5] == (1, 1, 1, 1, 1)
    assert at(4, 1)[:5] == (100_000, 1, 1, 1, 1) and at(2, 3)[:3] == (2000, 1, 0)
    chain = [(7, 0, "user", "line 0")] + [(7, i, "user", f"> line {i - 1}\nline {i}") for i in range(1, 40)]
    deep = quotes.link(spark.createDataFrame(chain, "conv_id long, turn long, role string, text string")).collect()
    assert all((r.root_turn, r.depth) == (0, r.turn) for r in deep)
    assert quotes.link(df.limit(0)).count() == 0


def test_quotes_of_many_originals(spark, monkeypatch):
    monkeypatch.setattr(quotes, "SALT_ROWS", 2)
    rows = [
        # the message says what it quotes, or a later turn does; another conversation is the original
        (1, 0, "u", "> the long words\nthe long words"), (1, 1, "u", "the long words"), (5, 3, "u", "the long words"),
        # every line stands earlier elsewhere, one original has them all
        *[(2, k, "u", x) for k, x in enumerate(["hello", "my question", "many thanks"])], (7, 0, "u", "hello\nmy question\nand more\nmany thanks"), (8, 0, "u", "> hello\n> my question\n> many thanks\nyes"),
        # as many lines: the same conversation, but not a later turn
        (9, 0, "u", "red\nblue\nx"), (9, 1, "u", "> red\n> blue\nyes"), (9, 2, "u", "red\nblue\ny"), (3, 0, "u", "red\nblue\nz"),
    ]
    found = {(r.conv_id, r.turn): (r.quoted_conv, r.quoted_turn) for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert found[1, 0] == (5, 3) and found[8, 0] == (7, 0) and found[9, 1] == (9, 0)


@pytest.mark.parametrize(("seed", "common"), [(1, 10**6), (2, 2), (3, 60)])
def test_quotes_by_brute_force(spark, monkeypatch, seed, common):
    monkeypatch.setattr(quotes, "SALT_ROWS", 2)
    monkeypatch.setattr(quotes, "COMMON_PAIRS", common)  # with 2 all but the rarest lines are common
    rng = random.Random(seed)
    said = [f"line {w} of many" for w in "abcdefgh"] + ["...", "", "line a of many line b of many", "Über 12"]
    written = lambda x: rng.choice((x, x.upper(), x.replace(" ", "  "), x + "!"))

    def message():
        out = []
        for _ in range(rng.randrange(1, 5)):
            mark = rng.choice(("", "", "> ", ">", ">> ", "> > "))
            if mark and rng.random() < 0.3:
                out.append("On Monday, A wrote:")
            out += [mark + written(rng.choice(said)) for _ in range(rng.randrange(1, 4))]
        return "\n".join(out)

    rows = [(c, t, message()) for c in range(8) for t in rng.sample(range(12), 7)]
    expected = brute.quotations(rows)
    assert sum(r[1] > 0 for r in expected.values()) > 10 and any(r[6] > 1 for r in expected.values())
    found = quotes.link(spark.createDataFrame([(c, t, "u", x) for c, t, x in [*rows, *rows[:5]]], "conv_id long, turn long, role string, text string")).collect()
    assert len(found) == len(rows) + 5
    assert {(r.conv_id, r.turn): (r.n_passages, r.n_linked, r.quoted_conv, r.quoted_turn, r.parent_turn, r.root_turn, r.depth) for r in found} == expected


def test_warc(spark, tmp_path):
    rows = [(r["page_id"], r["url"], r["html"]) for r in documents("pages")]
    rows += [(9000, None, None), (9001, "http://a/\r\nX: 1", ""), (9002, "u", rows[0][2]), (9002, "u", rows[0][2]), (None, "u", rows[0][2]), (None, "u", "alone"), (8999, "v", "WARC/1.1\r\n\r\n" * 50_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, size int")
    sort = lambda x: sorted((r[0] is not None, r[0] or 0, *map(str, r[1:])) for r in x)
    found = warc_members.archive(df, f"file://{tmp_path}/w", file_bytes=200_000, payloads=True).collect()
    assert sort((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == sort(brute.archive(rows))
    import gzip
    import zlib

    whole, members = sorted((tmp_path / "w").glob("whole-*.gz")), sorted((tmp_path / "w").glob("members-*.gz"))
    assert len(whole) == len(members) > 3 and not list((tmp_path / "w").glob("*.part"))
    for a, b in zip(whole, members, strict=True):
        assert gzip.decompress(a.read_bytes()) == gzip.decompress(b.read_bytes())
        one = zlib.decompressobj(31)
        one.decompress(a.read_bytes())
        assert one.eof and not one.unused_data
    assert warc_members.archive(df.limit(0)).count() == 0


def test_urls(spark):
    cases = {
        "http://a.com/x": ("a.com", "/x", "com/", "allow"), "HTTP://WWW.Example.COM/en/1?q": ("www.example.com", "/en/1", "www.example.com/en/", "allow"), "https://m.example.com/en/2": ("m.example.com", "/en/2", "example.com/en/", "block"),
        "http://example.com/EN/": ("example.com", "/EN/", "com/", "allow"), "http://badexample.com/en/": ("badexample.com", "/en/", "com/", "allow"), "http://x.net/es/": ("x.net", "/es/", "net/es/", "block"), "http://net/fr/a": ("net", "/fr/a", "net/fr/", "block"),
        "http://x.net/de/": ("x.net", "/de/", None, "allow"), "http://x.org?sessionid=1": ("x.org", "", None, "block"), "no mark": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"), "http://com": ("com", "", None, "allow"), "a://b.org/calendar/2020/": ("b.org", "/calendar/2020/", None, "block"),
    }
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(cases)], "page_id long, url string, host string, path string")
    found = {r.page_id: tuple(r)[1:5] for r in url_rules.judge(df).collect()}
    assert found == dict(enumerate(cases.values()))
    assert url_rules.judge(df.limit(0)).count() == 0
    rules = url_rules.rule_list(url_rules.HOST_RULES, url_rules.PATTERN_RULES)
    index, always = url_rules.rule_index(rules, {"com": 10, "example": 3, "www": 5})
    names = lambda t: {rules[k].name for k in index[t]}
    assert names("com") == {"com/"} and "example.com/en/" in names("example") and names("logout") == {"login"} == names("signin") and names("phpsessid") == {"session"} and not always


def test_thousands_of_url_rules(spark, monkeypatch):
    """Only rules whose token a URL has are tried; the verdicts are those of trying all."""
    rng = random.Random(6)
    name = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 5)))
    hosts = list({(f"{name()}.{rng.choice(['com', 'net', 'org'])}", rng.choice(["/", f"/{name()}/"])): rng.choice(["allow", "block"]) for _ in range(3000)}.items())
    hosts = [(h, p, v) for (h, p), v in hosts]
    patterns = [(f"p{i}", rf"(?ia)/{w}([/?#]|$)") for i, w in enumerate(sorted({name() + name() for _ in range(1500)}))]
    patterns += [("upper", "/Foo/"), ("free", "z.?z.?z"), ("class", "[/.](?:yy|Xx)[/?]")]
    words = [p[1][6:-8] for p in patterns[:-3]]
    urls = [f"http://{rng.choice(['', 'www.'])}{rng.choice(hosts)[0]}{rng.choice(['/', rng.choice(hosts)[1]])}{rng.choice([name(), rng.choice(words).upper(), 'Foo/', 'foo/', 'zazbz', 'Xx/', 'xx/', 'yy?'])}" for _ in range(600)] + [None, "", "x://Foo/", "x://İ.com/yy/Foo/"]

    def plain(url):
        host, path = url_rules.split_url(url)
        fits = [(len(h + p), h + p, v) for h, p, v in hosts if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fits:
            return max(fits)[1:]
        import re

        return None, "block" if any(re.search(p, url or "") for _, p in patterns) else "allow"

    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    host_table = spark.createDataFrame(hosts, "host string, path string, verdict string")
    pattern_table = spark.createDataFrame(patterns, "name string, pattern string")
    found = {r.page_id: tuple(r)[1:] for r in url_rules.judge(df, host_table, pattern_table).collect()}
    assert {i: x[2:4] for i, x in found.items()} == {i: plain(u) for i, u in enumerate(urls)}
    assert sum(x[5] for x in found.values()) / len(urls) < 20
    # rules that are too many to be sent to all tasks
    monkeypatch.setattr(url_rules, "RULE_BYTES", 1000)
    joined = {r.page_id: tuple(r)[1:] for r in url_rules.judge(df, host_table, pattern_table).collect()}
    assert joined == found
    assert url_rules.judge(df.limit(0), host_table, pattern_table).count() == 0
    with pytest.raises(ValueError, match="without a token"):
        url_rules.judge(df, host_table, spark.createDataFrame([(f"p{i}", "zz") for i in range(200)], "name string, pattern string"))


def test_pipeline(spark):
    import corpus_pipeline

    found = corpus_pipeline.run(spark, SF).collect()
    docs = documents()
    quality = {r[0]: r for r in brute.quality([(r["doc_id"], r["text"], r["source"]) for r in docs])}
    kept = line_rules.apply_rules(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert {r.doc_id for r in kept} == {d for d, r in quality.items() if r[7]}
    rows = [(r.doc_id, r.text) for r in kept]
    gone = brute.removed_lines(rows)
    rows = [(d, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get((d, t), ()))) for d, t in rows]
    one = brute.jaccard(rows)
    rows = [(d, t) for d, t in rows if one[d][1] == d]
    hit = {r[0] for r in brute.contamination(rows, [(r["item_id"], r["text"]) for r in documents("benchmark")]) if r[-1]}
    rows = [(d, t) for d, t in rows if d not in hit]
    assert hit and len(found) == len(rows) > 50
    texts = {d: hashlib.sha256(t.encode()).hexdigest() for d, t in rows}
    assert {r.doc_id: r.decoded_sha256 for r in found} == texts


def test_queries_run_and_match_sql(spark):
    import duckdb

    from inkglass.llm.queries import ORACLES

    db = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "conversations", "embeddings"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, query in QUERIES.items():
        found = query(spark, SF)
        assert found.count() > 0
        if name in ORACLES:
            result = db.execute(ORACLES[name])
            names = [d[0] for d in result.description]
            assert sorted(names) == sorted(found.columns)
            expect = sorted(str([r[names.index(c)] for c in found.columns]) for r in result.fetchall())
            assert sorted(str(list(r)) for r in found.collect()) == expect, name


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_segments_find_all_near_lines(edits):
    """Of two lines within `edits`, one has a segment of the other where ways() looks for it."""
    rng = random.Random(edits)

    def segments(s):
        n, base, short = edits + 1, len(s) // (edits + 1), edits + 1 - len(s) % (edits + 1)
        starts = [i * base + max(0, i - short) for i in range(n)]
        return [(a, base + (i >= short)) for i, a in enumerate(starts)]

    def probes(x, y):
        less = len(x) - len(y)
        places = segments(y)
        return any(0 <= places[i][0] + shift and x[places[i][0] + shift :][: places[i][1]] == y[places[i][0] :][: places[i][1]] for i, shift in line_edits.ways(edits, less))

    found = 0
    for _ in range(20_000):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(edits + 1, 14)))
        b = list(a)
        for _ in range(rng.randrange(1, edits + 1)):
            k, at = rng.randrange(3), rng.randrange(len(b))
            b[at : at + 1] = [[], [b[at], rng.choice("ab")], [rng.choice("ab")]][k]
            b = b or ["a"]
        a, b = sorted((a, "".join(b)), key=len, reverse=True)
        if len(b) > edits and brute.levenshtein(a, b) <= edits:
            found += 1
            assert probes(a, b) or (len(a) == len(b) and probes(b, a)), (a, b)
    assert found > 10_000
