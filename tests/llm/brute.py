"""Plain versions of the operators for small tables."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def removed_lines(docs, edits=2, chars=10):
    """{(doc_id, text): removed line numbers}; docs: (doc_id, text)."""
    first = {}
    key = lambda d, i: (d is not None, d or 0, i)
    occurrences = defaultdict(list)
    for d, t in docs:
        for i, line in enumerate((t or "").split("\n")):
            if line := line.strip(" "):
                occurrences[line].append((d, t, i))
                first[line] = min(first.get(line, (True, 1 << 62, 0)), key(d, i))
    by_length = defaultdict(list)
    for line in first:
        by_length[len(line)].append(line)

    def near(a, b):
        most = min(edits, min(len(a), len(b)) // chars)
        return abs(len(a) - len(b)) <= most and sum((Counter(a) - Counter(b)).values()) <= most and levenshtein(a, b) <= most

    out = defaultdict(set)
    for line, places in occurrences.items():
        again = any(other != line and first[other] < first[line] and near(line, other) for n in range(len(line) - edits, len(line) + edits + 1) for other in by_length[n])
        for d, t, i in places:
            if again or key(d, i) != first[line]:
                out[d, t].add(i)
    return out


def words4(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def contamination(docs, items, window=10):
    keys = defaultdict(set)
    for i, t in items:
        w = words4(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            keys[tuple(w[k : k + n])].add(i)
    lengths = {len(k) for k in keys}
    out = []
    for d, t in docs:
        w, hit, found = words4(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (of := keys.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= of
        listed = sorted(str(x) for x in found if x is not None)
        out.append((d, len(w), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit)))
    return out


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def jaccard(docs, percent=80):
    """{doc_id: (n_shingles, component_id)}"""
    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    index = defaultdict(set)
    for d, s in sets.items():
        seen = set().union(*(index[x] for x in s)) if s else set()
        for e in seen:
            if 100 * len(s & sets[e]) >= percent * len(s | sets[e]):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
        for x in s:
            index[x].add(d)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def base_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


def normal_line(line):
    import regex

    low = line.lower()
    return regex.sub(r"[^\p{L}\p{M}\p{N}]+", "", low) or re.sub("[\x20\x09-\x0D]+", "", low)


def quality(docs, least_docs=10, share=0.01, left=0.3):
    """Rows of judge(): docs are (doc_id, text, host). Documents are sets of whole texts, by host."""
    texts, having = defaultdict(set), defaultdict(set)
    for _, t, h in docs:
        texts[h].add(t or "")
        for line in (t or "").split("\n"):
            having[h, normal_line(line)].add(t or "")
    out = []
    for d, t, h in docs:
        n, chars, symbols, dups, repeated = base_rules(t)
        above = lambda x: x != "" and len(having[h, x]) >= least_docs and len(having[h, x]) >= share * len(texts[h])  # noqa: B023, E731
        gone = sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in (t or "").split("\n") if above(normal_line(x)))
        failed = n < 20 or 100 * repeated > 30 * n
        out.append((d, n, chars, symbols, dups, repeated, failed, not failed and n - gone >= left * n, gone))
    return out


def quote_runs(text):
    """[(level, non-empty normalised lines)] of a message's runs."""
    import regex

    lines = []
    for x in (text or "").split("\n"):
        body = re.sub(r"^[ \t>]*>[ \t]?", "", x)
        lines.append((x[: len(x) - len(body)].count(">"), body))
    levels = [-1 if n == 0 and i + 1 < len(lines) and lines[i + 1][0] > 0 and re.match(r"[ \t]*On[ \t].*[ \t]wrote[ \t]*:[ \t]*$", body) else n for i, (n, body) in enumerate(lines)]
    runs = []
    for n, (_, body) in zip(levels, lines, strict=True):
        if not runs or runs[-1][0] != n:
            runs.append((n, []))
        if word := regex.sub(r"[^\p{L}\p{M}\p{N}]+", " ", body.lower()).strip():
            runs[-1][1].append(word)
    return runs


def quotations(messages):
    """{(conv, turn): (n_passages, n_linked, quoted_conv, quoted_turn, parent, root, depth)}; messages: (conv, turn, text),
    one text a place. Every passage is held against every other message."""
    said, out = {}, {}
    for c, t, text in messages:
        own = [x for n, x in quote_runs(text) if n == 0 and x]
        said[c, t] = {" ".join(x) for x in own} | {y for x in own if len(x) > 1 for y in x}
    for c, t, text in messages:
        passages = sorted((n, i, x) for i, (n, x) in enumerate(quote_runs(text)) if n > 0)
        earlier = [p for p in said if not (p[0] == c and p[1] >= t)]
        linked = []
        for _, _, x in passages:
            if not x:
                continue
            whole = [p for p in earlier if " ".join(x) in said[p]]
            votes = {p: sum(y in said[p] for y in x) for p in earlier} if len(x) > 1 else {}
            most = max(votes.values(), default=0)
            of = whole or [p for p, n in votes.items() if n == most > 0]
            if of:
                linked.append(min(of, key=lambda p: (p[0] != c, p)))
        out[c, t] = [len(passages), len(linked), *(linked[0] if linked else (None, None))]
    for (c, t), row in out.items():
        at, depth = t, 0
        while out[c, at][2] == c:
            at, depth = out[c, at][3], depth + 1
        row += [row[3] if row[2] == c else None, at, depth]
    return {k: tuple(v) for k, v in out.items()}


def shard_load(sizes, shards):
    """The least largest sum of contiguous parts, over all places of the cuts."""
    sums = np.concatenate([[0], np.cumsum(sizes)])
    best = sums.copy()
    for _ in range(shards - 1):
        best = np.array([min(max(best[k], sums[n] - sums[k]) for k in range(n + 1)) for n in range(len(sums))])
    return int(best[-1])


def archive(pages):
    first = {}
    for p, _, html in pages:
        if p is not None:
            first[html or ""] = min(first.get(html or "", p), p)
    out = []
    for p, _, html in pages:
        data = (html or "").encode()
        f = first.get(html or "")
        revisit = f is not None and p != f
        out.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", f if revisit else None))
    return out


def token_rows(docs, tokenizer, end_id=1):
    start, out = 0, []
    for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, end_id], "<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out
