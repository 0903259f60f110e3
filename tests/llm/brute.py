"""Row-by-row reference versions, and the edge-case table that the tests share."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(UPPER, UPPER.lower())
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK = re.compile(r"[^\x20\x09-\x0D]+")

LONG = " ".join(f"w{i * i % 977}" for i in range(20_000))
PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, rid long, id long, w string, n string, size string, "
          "shard string, slot string, `__order` string, kept string, copies string, token string")


def edge_rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows; the last columns clash with inner names."""
    texts = [None, "", " \t\n", LONG, LONG, "The Quick brown fox", "the quick  brown fox", "THE quick brown fox",
             f"Say {PASSAGE} now", f"Say {PASSAGE} now", PASSAGE.upper(), "Ünï cödé ÄÖ wörds", "\x00 nul \x0b tab",
             "Licensed under CC BY-NC 4.0. All rights reserved. cc by", "one", "a b c d", "a b c d e", "x " * 50]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", i, -1, -2, "w", "n", "9", "s", "t", "o", "k", "c", "t")
            for i, t in enumerate(texts)]
    rows += [rows[5], rows[8], rows[0], (None, "the quick brown fox", *([None] * 14)), (None, None, *([None] * 14))]
    return rows


def edge_docs(spark):
    """The edge table, written and read, so that its rows have places."""
    return stored(spark, edge_rows(), SCHEMA)


def stored(spark, rows, schema):
    from cohortlens.llm.common import cut
    return cut(spark.createDataFrame(rows, schema).repartition(3), "test")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, k=5):
    w = BLANK.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def component_ids(rows):
    """rows: (id, text), ids unique; least id of each component of similar sets."""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def repeated_cover(texts, length):
    """Flags per byte: covered by a string of ``length`` bytes that occurs twice or more."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(t[i:i + length] for t in data for i in range(len(t) - length + 1))
    out = []
    for t in data:
        flags = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                flags[i:i + length] = [True] * length
        out.append((t, flags))
    return out


def hits(text, items, n=10):
    """Flags per word and the sorted ids of items found."""
    w = words(text)
    flags, found = [False] * len(w), set()
    for item, passage in items:
        p = words(passage)
        k = min(len(p), n)
        windows = {tuple(p[i:i + k]) for i in range(len(p) - k + 1)} if p else set()
        for i in range(len(w) - k + 1 if p else 0):
            if tuple(w[i:i + k]) in windows:
                flags[i:i + k] = [True] * k
                found.add(str(item))
    return flags, sorted(found)


def targets(sizes, weights=(5, 2, 1), cap=3):
    """Target per source by sharing the excess again and again. sizes: {source: words}."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = sum(w[s] for s in names if s not in full)
        left = total - sum(cap * sizes[s] for s in full)
        out = {s: cap * sizes[s] if s in full else left * w[s] / rest for s in names}
        more = {s for s in names if s not in full and out[s] >= cap * sizes[s]}
        if not more:
            return out
        full |= more


def group_rows(rows, key=0):
    out = defaultdict(list)
    for r in rows:
        out[r[key]].append(r)
    return out
