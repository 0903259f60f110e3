"""op12 on edge cases, against dictionaries; the transducer against sorted lists."""

import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings, strategies as st

from brute import LOWER, edge_docs, edge_rows, stored
from cohortlens.llm import source_audit, transducer
from cohortlens.llm.hashing import word_windows

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def audited(rows, p):
    """rows: (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    docs_with, counts, groups = Counter(), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        groups[lang].add(source)
        for t in set(TERM.findall(text.translate(LOWER))):
            docs_with[lang, t] += 1
    kept = defaultdict(list)
    for (lang, t), n in docs_with.items():
        if n >= p.min_docs:
            kept[lang].append(t)
    for text, lang, source in rows:
        for t in TERM.findall(text.translate(LOWER)):
            if t in kept[lang]:
                counts[lang, source][t] += 1
                counts[lang][t] += 1
    out = []

    def share(c, lang, t):
        return 1 + p.unit * (c[t] + p.smoothing) // (sum(c.values()) + p.smoothing * len(kept[lang]))

    for lang, sources in groups.items():
        for s in sources:
            pairs = [(-sum(abs(share(counts[lang, s], lang, t) - share(counts[lang, o], lang, t)) for t in kept[lang]), o.encode())
                     for o in sources if o != s]
            f = {t: share(counts[lang, s], lang, t) - share(counts[lang], lang, t) for t in kept[lang] if counts[lang, s][t]}
            terms = [(-v, t.encode()) for t, v in f.items() if v > 0]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:p.top])):
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


def test_edge_table(spark):
    p = source_audit.Params(min_docs=2)
    docs = edge_docs(spark)
    got = source_audit.source_audit(docs, p)
    assert sorted(map(tuple, got.collect())) == audited([(r[1], r[2], r[3]) for r in edge_rows()], p)
    assert source_audit.source_audit(docs.where("false"), p).count() == 0
    # no term is kept anywhere: pairs of value 0 only
    bare = source_audit.source_audit(docs, source_audit.Params(min_docs=10_000)).collect()
    assert bare and {(r.part, r.value) for r in bare} == {("pair", 0)}


def test_many_pieces_passes_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(source_audit, "PIECE", 7)
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcéß"), rng.integers(1, 5))) for _ in range(150)]
    rows = [(" ".join(rng.choice(words, rng.integers(0, 40))), ["aa", "a", "", None, "a\x00b"][rng.integers(5)], f"s{rng.integers(4)}") for _ in range(300)]
    docs = stored(spark, rows, "text string, lang string, source string")
    p = source_audit.Params(min_docs=3, top=9)
    monkeypatch.setattr(source_audit, "CELLS", 1)
    got = source_audit.source_audit(docs, p, most_bytes=600)
    assert sorted(map(tuple, got.collect())) == audited(rows, p)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.binary(min_size=0, max_size=6), min_size=1, max_size=40), st.lists(st.binary(min_size=1, max_size=6), min_size=1, max_size=20),
       st.integers(1, 9))
def test_transducer_maps_keys_to_ordinals(keys, words, piece):
    keys = sorted(keys)
    machine = transducer.join([transducer.build(keys[i:i + piece]) for i in range(0, len(keys), piece)])
    assert machine.size == len(keys) and [machine.key(i) for i in range(len(keys))] == keys
    words += [k for k in keys if k]
    data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    at, ordinal = machine.ordinals(data, ends - [len(w) for w in words], ends, np.full(len(words), machine.start), np.zeros(len(words), np.int64))
    assert dict(zip(at.tolist(), ordinal.tolist())) == {i: keys.index(w) for i, w in enumerate(words) if w in keys}


def test_transducer_is_minimal():
    final, first, label, to = transducer.unpack(transducer.build([b"tap", b"taps", b"top", b"tops"]))
    assert len(final) == 5 and len(label) == 5


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab .é", max_size=12), max_size=8), st.integers(1, 20))
def test_windows_find_every_word(texts, step):
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])
    got = [(int(r), data[s:e].tobytes()) for parts in word_windows(data, offsets, source_audit.LETTERS, step) for s, e, r in zip(*parts)]
    assert got == [(i, w.encode()) for i, t in enumerate(texts) for w in TERM.findall(t)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", ""]), st.text("aBé .", max_size=20)), max_size=8), st.integers(1, 12))
def test_documents_with_a_term_count_once(docs, stretch):
    import pyarrow as pa
    before, source_audit.STRETCH = source_audit.STRETCH, stretch
    try:
        batch = pa.RecordBatch.from_arrays([pa.array([d[0] for d in docs], pa.string()), pa.array([d[1] for d in docs], pa.string())], ["lang", "text"])
        got = Counter()
        for part in source_audit._term_documents([batch]):
            for r in part.to_pylist():
                got[r["lang"], r["term"]] += r["n_docs"]
    finally:
        source_audit.STRETCH = before
    assert got == Counter((lang, t) for lang, text in docs for t in set(TERM.findall(text.translate(LOWER))))
