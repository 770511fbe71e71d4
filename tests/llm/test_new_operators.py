"""Operators 11 to 13 against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkglass.llm import exact_copies, token_alignment, vector_codes
from inkglass.llm.common import cut, join_groups
from inkglass.llm.queries import TOKENIZERS

from .test_operators import DOC, SF, documents, edge_rows

BYTE, PIECE = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
MORE_ODD = [
    "\r\n x;\r\n y", " lead", "tail ", "two  spaces\n\n new", "▁a b", "<s> x </s><|endoftext|> <0x41>", "a\x00b \x1c \x1f!\x1c x", "　全角 文　 字",
    "é é कि की", "tab\t tab \t\n x", "\U0001f600 ok'll 'S don't", "     ", "\n\n\n a\n  b   \n", "{\r\n};\r\n }\r", "a" * 30_000,
]


def copies(rows):
    """(doc_id, keep_id, group_size, kept) of (doc_id, text) rows by their order in the table."""
    groups = defaultdict(list)
    for at, (i, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]+", "", t or "")].append((-len(t or ""), i is None, i or 0, at))
    out = []
    for norm, members in groups.items():
        first = min(members)
        out += [(rows[m[3]][0], rows[first[3]][0], len(members), m == first, hashlib.sha256(norm.encode()).hexdigest()) for m in members]
    return out


def told(rows):
    """Rows of one id and one text are told apart by nothing, so only their number counts."""
    return Counter(map(tuple, rows))


@pytest.mark.parametrize("content_hash", [exact_copies.md5_128, lambda b: F.substring(F.md5(b), 1, 1)], ids=["md5", "colliding"])
def test_exact_copies(spark, content_hash):
    given = [(r["doc_id"], r["text"]) for r in documents()]
    found = exact_copies.report(spark.read.parquet(f"{SF}/documents.parquet"), content_hash=content_hash).collect()
    assert told(found) == told(copies(given)) and any(not r.kept for r in found)
    rows = [*edge_rows(), (200, "a\tb", *["x"] * 6), (201, "ab", *["x"] * 6), (202, " a b ", *["x"] * 6), (203, "a b\n\n", *["x"] * 6)]
    rows = [(*r[:5], 1, *r[6:]) for r in rows]
    frame = spark.createDataFrame(rows, DOC)
    assert told(exact_copies.report(frame, content_hash=content_hash).collect()) == told(copies([r[:2] for r in rows]))
    # a table with columns of the names used inside; one row of each group stays, whole
    clash = frame.select("doc_id", "text", F.col("n").alias("row"), F.col("key"), F.lit(7).alias("norm"), F.lit("k").alias("kept"), F.lit(1).alias("d"))
    left = exact_copies.dedup(clash, content_hash=content_hash)
    assert left.columns == clash.columns
    assert told(r[:1] for r in left.collect()) == told((r[0],) for r in copies([r[:2] for r in rows]) if r[3])
    assert exact_copies.report(spark.createDataFrame([], DOC), content_hash=content_hash).count() == 0


def test_groups_join_with_hot_and_null_keys(spark):
    rows = cut(spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit(-1)).otherwise(F.col("id") % 5000).alias("k")), "test-rows")
    groups = cut(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k IS NULL OR k < 4000"), "test-groups")
    joined = join_groups(rows, groups, ["k"], "n")
    sizes = Counter(r.k for r in rows.collect())
    assert {(r.id, r.n) for r in joined.collect()} == {(r.id, sizes[r.k] if r.k is None or r.k < 4000 else None) for r in rows.collect()}


def alignment(texts):
    """What operator 12 returns for (doc_id, text) rows, from whole texts."""
    a, b = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True
    back = token_alignment.byte_characters()
    names = {i: bytes(back[c] for c in s) for s, i in a.get_vocab(with_added_tokens=False).items()}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found = []
    for doc_id, text in texts:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bytes_a, bytes_b = [names[i] for i in ids_a], [piece(i) for i in ids_b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            found.append((doc_id, 0, 0, [], []))
            continue
        at_a = {e: k for k, e in enumerate(accumulate(map(len, bytes_a)))}
        at_b = {e: k for k, e in enumerate(accumulate(map(len, bytes_b)))}
        groups, links, x, y = [], [], 0, 0
        for end in sorted(at_a.keys() & at_b.keys()):
            s, t = at_a[end] + 1, at_b[end] + 1
            groups.append(",".join(map(str, ids_a[x:s])) + "|" + ",".join(map(str, ids_b[y:t])))
            links.append((ids_a[s - 1], ids_b[t - 1]))
            x, y = s, t
        found.append((doc_id, len(ids_a), len(ids_b), groups, links))
    counts = Counter(p for f in found for p in f[4])
    best = Counter()
    for (_, t), n in counts.items():
        best[t] = max(best[t], n)
    return [
        (d, n_a, n_b, len(g), len(p), sum(counts[x] == best[x[1]] for x in p), sum(counts[x] for x in p), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for d, n_a, n_b, g, p in found
    ]


@pytest.mark.parametrize("heavy", [token_alignment.HEAVY_PAIRS, 50], ids=["all-broadcast", "most-dealt"])
def test_token_alignment(spark, monkeypatch, heavy):
    monkeypatch.setattr(token_alignment, "HEAVY_PAIRS", heavy)
    given = [(r["doc_id"], r["text"]) for r in documents()]
    found = token_alignment.align(spark.read.parquet(f"{SF}/documents.parquet"), BYTE, PIECE)
    assert sorted(map(tuple, found.collect())) == sorted(alignment(given))
    rows = [*edge_rows(), *((300 + i, t, *["x"] * 3, 1, "x", "x") for i, t in enumerate(MORE_ODD))]
    frame = spark.createDataFrame(rows, DOC).withColumns({"pairs": F.lit(1), "row": F.lit(2), "n_a": F.lit("x")})
    assert told(token_alignment.align(frame, BYTE, PIECE).collect()) == told(alignment([r[:2] for r in rows]))
    assert token_alignment.align(spark.createDataFrame([], DOC), BYTE, PIECE).count() == 0


def test_chunks_change_nothing(monkeypatch):
    rng = random.Random(1)
    parts = ["a", "b ", " ", "\n", "\r", "\t", "\x85", "　", "\x1c", ";", "}", "▁", "é", "1", "'s", "中", "<", "|", ">", "\xa0", "(", "  "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    chunked, whole = token_alignment.Aligner(BYTE, PIECE), token_alignment.Aligner(BYTE, PIECE)
    assert chunked.by_chunks
    whole.by_chunks = False
    plain = lambda aligner: [(*x[:4], x[4].tolist()) for x in aligner.align(texts)]
    first = plain(chunked)
    assert first == plain(whole)
    chunked.clear()
    assert plain(chunked) == first


def codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Operator 13 in plain integers for (vec_id, vector, label) rows that are usable."""
    floor = lambda x: math.floor(scale * int(x)) if abs(x) >= 2**53 else math.floor(x * scale)
    whole = [[floor(float(x)) for x in v] for _, v, _ in rows]
    width = len(whole[0]) // parts
    cuts = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in whole]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1]))[:entries]
    books = [[cuts[k][p] for k in order] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, v: min((gap(v, c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for v in cuts:
                members[near(p, v[p])[1]].append(v[p])
            for e, vs in members.items():
                books[p][e] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    found = [[near(p, v[p]) for p in range(parts)] for v in cuts]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(g for g, _ in f) for f in found]
    sums = Counter()
    for (_, _, label), e in zip(rows, errors, strict=True):
        sums[label] += e
    fit = lambda e: e if e < 2**63 else None
    return [(i, "".join(f"{e:02x}" for _, e in f), fit(e), fit(sums[label]), sha) for (i, _, label), f, e in zip(rows, found, errors, strict=True)]


VEC = "vec_id long, embedding array<double>, label int, code string, block binary"


def test_vector_codes(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.3, 16).tolist(), [None, 1, 1, 2][i % 4]) for i in range(300)]
    rows += [(7, rows[7][1], 1), (None, rows[9][1], None), (400, [0.0] * 16, 3), (401, [0.0] * 16, 3)]
    bad = [(500, None, 1), (501, [None, *[0.1] * 15], 1), (502, [math.nan, *[0.1] * 15], 1), (503, [math.inf, *[0.1] * 15], 2), (504, [], 1), (505, [0.5] * 8, 1)]
    frame = lambda x: spark.createDataFrame([(*r, "c", None) for r in x], VEC)
    assert told(vector_codes.compress(frame(rows + bad).repartition(5)).collect()) == told(codes(rows))
    few = rows[:5]
    assert told(vector_codes.compress(frame(few)).collect()) == told(codes(few))
    huge = [(i, [x * 10.0 ** (i % 40) for x in v], label) for i, v, label in rows[:60]]
    assert told(vector_codes.compress(frame(huge), entries=4).collect()) == told(codes(huge, entries=4))
    assert vector_codes.compress(frame([])).count() == 0 and vector_codes.compress(frame(bad[:4])).count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(frame([(1, [0.1] * 9, 1)]))
