"""op4, op5, op6, op9 and op10 on edge cases, against row-by-row versions and round trips."""

import base64
import hashlib
import random
import tracemalloc
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pytest

import brute
from brute import edge_docs, edge_rows, stored
from conftest import SF_MID
from cohortlens.llm import chat_format, jaccard_join, queries, suffix_dedup, toxicity, warc
from cohortlens.llm.common import cut, table
from cohortlens.llm.components import _large_star, _small_star, components
from test_native import same


# op4

def test_toxicity_held_out(spark):
    docs, labels = table(spark, SF_MID, "documents"), table(spark, SF_MID, "labels")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == docs.count()
    for r in got.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    judged = [(got[r.doc_id].score, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    bad, good = [s for s, t in judged if t], [s for s, t in judged if not t]
    auc = sum((b > g) + (b == g) / 2 for b in bad for g in good) / (len(bad) * len(good))
    assert auc > 0.85


def test_toxicity_edges(spark):
    docs = edge_docs(spark)
    labels = stored(spark, [(5, 1), (5, 0), (8, 0), (None, 1), (9, None), (3, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(edge_rows())
    assert len({r.score for r in got if r.doc_id in (0, 1, 2)}) == 1
    none = toxicity.toxicity(docs, labels.where("false")).collect()
    assert {r.score for r in none} == {0.0}
    assert toxicity.toxicity(docs.where("false"), labels).count() == 0
    kept = toxicity.drop_toxic(docs, labels.where("false"))
    assert kept.columns == docs.columns and kept.count() == len(edge_rows())


def test_toxicity_learns_words_and_pairs():
    rows = [(i, ("bad " if i % 4 == 0 else "so so ") + f"filler{i % 7} text", int(i % 4 == 0)) for i in range(400)]
    p = toxicity.Params()
    group = pa.table({"id": [r[0] for r in rows], "order": [r[0] for r in rows], "toxic": [r[2] for r in rows],
                      "features": toxicity.row_features(pa.array([r[1] for r in rows]), p.bits)})
    learnt = toxicity._learn(p)(None, group)
    model = toxicity.Model(p.bits, learnt["feature"].to_numpy()[:-1], learnt["weight"].to_numpy()[:-1], learnt["weight"][-1].as_py(), True)
    scores = toxicity.score_batch(model, model.dense(), pa.array(["bad filler1 text", "so so filler1 text", None, ""]))
    assert scores[0] > 0.3 > scores[1] and scores[2] == scores[3]
    assert len(model.index) < 200


def test_toxicity_learner_holds_one_number_a_feature():
    p, rng = toxicity.Params(bits=14, epochs=1), np.random.default_rng(0)
    rows = 4_000
    found = [np.flatnonzero(rng.random(1 << p.bits) < 0.1).astype(np.int32) for _ in range(rows)]
    group = pa.table({"id": np.arange(rows), "order": rng.permutation(rows), "toxic": rng.integers(0, 2, rows),
                      "features": pa.array(found, pa.list_(pa.int32()))})
    size = 4 * sum(map(len, found))
    del found
    tracemalloc.start()
    try:
        learnt = toxicity._learn(p)(None, group)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert learnt.num_rows
    # NumPy's memory, without Arrow's
    assert most < 1.7 * size, (most, size)


def test_toxicity_training_takes_small_batches_in_any_order(spark, monkeypatch):
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    docs = stored(spark, [(i, ("bad " if i % 4 == 0 else "so so ") + f"filler{i % 7} text") for i in range(400)], "doc_id long, text string")
    labels = stored(spark, [(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    whole = toxicity.train(docs, labels)
    monkeypatch.setattr(toxicity, "SLICE", 7)
    monkeypatch.setattr(toxicity, "HANDED", 1 << 16)
    before, learn = [spark.conf.get(k, None) for k in keys], toxicity.learn

    def watched(p):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def small():
                for batch in batches:
                    assert batch.num_rows <= 7
                    yield batch
            yield from learn(small(), p).to_batches()
        return run

    monkeypatch.setattr(toxicity, "_learn_batches", watched)
    got = toxicity.train(docs.repartition(5, "text"), labels)
    assert whole.trained and np.array_equal(got.index, whole.index) and np.array_equal(got.weight, whole.weight) and got.bias == whole.bias
    assert [spark.conf.get(k, None) for k in keys] == before


def test_toxicity_learner_is_ftrl_proximal():
    """Against the update rules written out per coordinate."""
    p = toxicity.Params(bits=10, min_rows=2, epochs=3, l1=0.5)
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["bad", "good", "so", "it", "we", "go"], 6)) for _ in range(60)]
    labels = [int("bad" in t.split()[:3]) for t in texts]
    found = toxicity.row_features(pa.array(texts), p.bits)
    group = pa.table({"id": list(range(60)), "order": list(range(60)), "toxic": labels, "features": found})
    learnt = toxicity._learn(p)(None, group)
    got = dict(zip(learnt["feature"].to_pylist(), learnt["weight"].to_pylist()))
    bias, z, n = 1 << p.bits, {}, {}
    seen = {}
    for x in found:
        for f in x.tolist():
            seen[f] = seen.get(f, 0) + 1

    def weight(f):
        l1 = 0.0 if f == bias else p.l1
        zf, nf = z.get(f, 0.0), n.get(f, 0.0)
        if abs(zf) <= l1:
            return 0.0
        return -(zf - np.sign(zf) * l1) / ((p.beta + nf ** 0.5) / p.alpha + p.l2)

    draw = np.random.default_rng(p.seed)
    for _ in range(p.epochs):
        for k in draw.permutation(60):
            row = [f for f in found[k].tolist() if seen[f] >= p.min_rows] + [bias]
            w = {f: weight(f) for f in row}
            g = 1 / (1 + np.exp(-sum(w.values()))) - labels[k]
            for f in row:
                sigma = ((n.get(f, 0.0) + g * g) ** 0.5 - n.get(f, 0.0) ** 0.5) / p.alpha
                z[f] = z.get(f, 0.0) + g - sigma * w[f]
                n[f] = n.get(f, 0.0) + g * g
    want = {f: weight(f) for f in z if f == bias or weight(f) != 0}
    assert set(got) == set(want) and all(abs(got[f] - want[f]) < 1e-9 for f in want)


# op5

PAGES = [(1, "http://a.example.org/x?b=1#t", "<p>é</p>"), (2, "http://a.example.org/x?b=1", "<p>é</p>"), (3, None, None), (4, "https://B.example.org:443", ""),
         (5, "ftp://u:p@c.example.org:21/y z\r\nq", "text"), (6, "no host", "text"), (None, "http://d.example.org/", "alone"),
         (None, "http://d.example.org/", "text"), (7, "http://d.example.org/", brute.LONG)]


def test_url_keys():
    assert warc.url_key("http://m.a.org:80/x?y#z") == "org,a,m)/x?y"
    assert warc.url_key("https://B.Example.org") == "org,example,b)/"
    assert warc.url_key(None) == "" and warc.url_key("") == ""


@pytest.mark.parametrize("lines", [2, 1000])
def test_warc_round_trip(spark, lines, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", lines)
    pages = stored(spark, [(*p, "clash", 0) for p in PAGES], "page_id long, url string, html string, key string, rid long")
    folder, top = warc.write_archive(pages)
    from pyspark.sql import functions as F
    keys = pages.select(warc.url_keys(F.col("url")).alias("key"), F.monotonically_increasing_id().alias("rid"))
    got = warc.lookup(keys.union(keys).union(spark.createDataFrame([("zz)/", 0), (None, 0), ("org,example,b)/", None), (None, None)], "key string, rid long")), folder, top).collect()
    want = []
    for page, _, html in PAGES:
        body = (html or "").encode()
        best = max((p for p, _, h in PAGES if (h or "").encode() == body), key=lambda p: (p is not None, p or 0))
        want.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
                     "response" if page == best else "revisit", None if page == best else best))
    same([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], want)
    assert {bytes(r.payload) for r in got if r.record_type == "response"} == {(h or "").encode() for _, _, h in PAGES}


def test_warc_empty(spark):
    pages = stored(spark, PAGES, "page_id long, url string, html string").where("page_id = -1")
    folder, top = warc.write_archive(pages)
    assert top.count() == 0
    assert warc.lookup(spark.createDataFrame([("a", 1)], "key string, rid long"), folder, top).count() == 0


# op6

@pytest.mark.parametrize("batch, hot", [(3, 2), (3, 20_000), (20_000, 4)])
def test_repeated_spans(spark, batch, hot):
    rng = random.Random(1)
    base = "".join(rng.choice("abé ") for _ in range(400))
    texts = [None, "", "short", base, base, base[:150] + "X" + base[150:], base[60:180], "q" * 40, "ab" * 30, base[100:130] + "Y" + base[200:230] + "\x00"]
    texts += ["".join(rng.choice("ab") for _ in range(120)) for _ in range(8)]
    texts += [f"{i:03d}" + base[20:60] + f"{i:03d}" for i in range(8)]
    docs = stored(spark, [(i, t, "clash", "clash") for i, t in enumerate(texts)], "doc_id long, text string, rid string, spans string")
    for length, gram in ((24, 6), (40, 12)):
        got = {r.id: r for r in suffix_dedup.repeated_spans(docs, length, gram, batch, hot).collect()}
        for i, (data, flags) in enumerate(brute.repeated_cover(texts, length)):
            mine = [False] * len(data)
            for s, e in got[i].spans:
                mine[s:e] = [True] * (e - s)
            assert mine == flags, (length, i)
            assert all(a[1] < b[0] for a, b in zip(got[i].spans, got[i].spans[1:]))


def test_repeated_spans_edges(spark):
    docs = edge_docs(spark)
    got = suffix_dedup.repeated_spans(docs).collect()
    assert len(got) == len(edge_rows())
    assert all((len(r.spans) == 1 and r.spans[0] == (0, len(r.text))) == (r.text == brute.LONG) for r in got)
    assert suffix_dedup.repeated_spans(docs.where("false")).count() == 0


def test_long_texts_are_cut_between_starts(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 256)
    rng = random.Random(2)
    text = "".join(rng.choice("abcd") for _ in range(2000))
    whole = {(r, s) for rows, a, b, *_ in suffix_dedup.text_segments(pa.array([text, "ab", text[:300]]), 50, 10)
             for r, x, y in zip(rows.tolist(), a.tolist(), b.tolist()) for s in range(x, y + 1)}
    assert whole == {(0, s) for s in range(1951)} | {(2, s) for s in range(251)}


# op9

def near_texts(seed, groups=6, copies=7):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    texts = [None, "", " \n", "one two", "One  two", "a b c d e", "A b c d e f"]
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(60)] + passage
        for c in range(copies):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    texts += [" ".join([f"u{i}a{j}" for j in range(5)] + passage) for i in range(12)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("most", [1, 3, 64])
@pytest.mark.parametrize("seed", [1, 2])
def test_similar_sets(spark, seed, most):
    rows = [(10 + i, t, "clash") for i, t in enumerate(near_texts(seed))]
    docs = stored(spark, rows, "doc_id long, text string, rid string")
    want = brute.component_ids([(d, t) for d, t, _ in rows])
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_sets(docs, most=most).collect()}
    assert got == want


def two_level_texts(seed, groups=4):
    """24 shingles each, 8 of them posted: a passage of all texts and one per group; linked pairs post 4 common tokens of the group and 1 of all."""
    rng = random.Random(seed)

    def fresh(n):
        return [f"v{rng.randrange(10 ** 9)}" for _ in range(n)]

    def sets(texts):
        return [s.tolist() for s in jaccard_join.shingle_sets(pa.array([" ".join(t) for t in texts]))]

    passages = [fresh(5) for _ in range(500)]
    everywhere = min(zip(sets(passages), passages))[1]
    texts = [everywhere + fresh(23) for _ in range(12)]
    while groups:
        mine = fresh(20)
        own, common = sets([mine, everywhere + mine])
        if not set(common[1:5]) <= set(own):
            continue
        ends = [everywhere + mine + fresh(3) for _ in range(2000)]
        pair = [t for t, s in zip(ends, sets(ends)) if set(s[:8]) & set(common) == set(common[:5])][:2]
        others = [mine + fresh(8) for _ in range(100)]
        first = [t for t, s in zip(others, sets(others)) if set(common[1:5]) < set(s[:8])][:1]
        if len(pair) < 2 or not first:
            continue
        texts += first + pair
        groups -= 1
        if groups % 2:
            # a near copy, so that clusters are compared instead of single texts
            texts.append(pair[0][1:] + fresh(1))
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("seed", [1, 2])
def test_similar_sets_with_common_tokens_in_usual_and_in_long_lists(spark, seed):
    rows = list(enumerate(two_level_texts(seed)))
    docs = cut(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), "test")
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_sets(docs, most=8).collect()}
    assert got == brute.component_ids(rows)


def test_similar_sets_edges(spark):
    docs = edge_docs(spark)
    got = jaccard_join.similar_sets(docs).collect()
    assert len(got) == len(edge_rows())
    want = brute.component_ids([(r[0], r[1]) for r in edge_rows() if r[0] is not None])
    assert all((r.n_shingles, r.component_id) == want[r.id] for r in got if r.id is not None)
    assert {r.component_id for r in got if r.id is None and r.n_shingles} == {5}
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    blank = [r[0] for r in edge_rows() if not brute.shingles(r[1])]
    same([(r.doc_id,) for r in kept.collect()], [(d,) for d in blank] + [(c,) for c in {c for n, c in want.values() if n}])
    assert jaccard_join.similar_sets(docs.where("false")).count() == 0


def test_one_of_each_without_ids_and_with_one_id_twice(spark):
    texts = [" ".join(f"t{k}w{j}" for j in range(20)) for k in range(8)]
    rows = [(None, t) for t in texts[:4]] + [(None, texts[0] + " more"), (None, texts[1]), (None, ""), (None, None)]
    rows += [(7, texts[4]), (7, texts[5]), (7, texts[5]), (9, texts[5] + " more"), (None, texts[6]), (3, texts[6]), (8, texts[6])]
    rows.append((None, texts[7]))
    docs = cut(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), "test")
    kept = [(r.doc_id, r.text) for r in jaccard_join.one_of_each(docs).collect()]
    same(kept, [(None, t) for t in texts[:4]] + [(None, ""), (None, None), (7, texts[4]), (7, texts[5]), (3, texts[6]), (None, texts[7])])


def test_python_steps_of_similar_sets_take_small_batches(spark, monkeypatch):
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    words = " ".join(f"w{i}" for i in range(3000))
    docs = stored(spark, [(i, f"a{i} {words}" if i < 20 else f"b{i} c d e f g") for i in range(60)], "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "SLICE", 7)
    monkeypatch.setattr(jaccard_join, "HANDED", 1 << 16)
    before, emit, compare = [spark.conf.get(k, None) for k in keys], jaccard_join._emit_sets, jaccard_join._compare

    def watched(run, *cols):
        def seen(batches):
            for batch in batches:
                size = sum(len(t) for c in cols for t in batch.column(c).to_pylist())
                # one row may go beyond the bytes
                assert batch.num_rows <= 7 and size < (1 << 16) + 40_000, (batch.num_rows, size)
                yield from run([batch])
        return seen

    monkeypatch.setattr(jaccard_join, "_emit_sets", watched(emit, "text"))
    monkeypatch.setattr(jaccard_join, "_compare", watched(compare, "text_x", "text_y"))
    got = {r.id: r.component_id for r in jaccard_join.similar_sets(docs).collect()}
    assert got == {i: 0 if i < 20 else i for i in range(60)}
    assert [spark.conf.get(k, None) for k in keys] == before


def test_shingle_sets_hold_little_beside_the_texts():
    texts = pa.array([" ".join(f"w{i}x{j}" for j in range(300)) for i in range(2000)])
    jaccard_join.shingle_sets(texts[:1])
    tracemalloc.start()
    try:
        sets = jaccard_join.shingle_sets(texts)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # NumPy's memory, without Arrow's
    assert most - sum(s.nbytes for s in sets) < 10 << 20


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}


def test_pairs_that_are_not_there_are_not_compared(spark):
    def jobs(name, run):
        spark.sparkContext.setJobGroup(name, name)
        try:
            assert run().count() == 0
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    docs = stored(spark, [(1, "a b c d e f"), (2, "a b c d e g")], "rid long, text string")
    none = spark.createDataFrame([], "x long, y long")
    assert jobs("no-pairs", lambda: jaccard_join.compare(none, docs)) <= 6


def test_a_star_reads_its_edges_twice_at_most(spark):
    edges = stored(spark, [(2, 1), (3, 1), (5, 4)], "u long, v long")
    for star in (_large_star, _small_star):
        assert star(edges)._jdf.queryExecution().executedPlan().toString().count("FileScan") <= 2


# op10

CONVERSATIONS = [(1, 0, "user", "hi"), (1, 1, "assistant", r"\### Assistant: </turn> ok ####"), (1, 2, None, None), (2, None, "assistant", "é\\"), (2, 5, "assistant", ""),
                 (None, 0, "assistant", "</turn>\n### User: x"), (3, 1, "tool: a\\#", "x" * 50_000), (3, 0, "system", "<<</turn>"), (4, 0, "assistant", "same"), (4, 0, "assistant", "same")]


def test_chat_round_trip(spark):
    rows = stored(spark, [(*r, "clash") for r in CONVERSATIONS], "conv_id long, turn long, role string, text string, formatted string")
    parts = cut(chat_format.format_chat(rows), "chat")
    got = chat_format.read_back(parts).collect()
    want = []
    for conv, turns in brute.group_rows(CONVERSATIONS).items():
        turns = sorted(turns, key=lambda r: (r[1] is not None, r[1] or 0))
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        want.append((conv, len(turns), hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns).encode()).hexdigest(),
                     len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    same([tuple(r)[:5] for r in got], want)
    lengths = brute.group_rows([(r.conv_id, len(r.formatted)) for r in parts.collect()])
    assert {r.conv_id: r.formatted_chars for r in got} == {k: sum(n for _, n in v) for k, v in lengths.items()}
    assert chat_format.read_back(chat_format.format_chat(rows.where("false"))).count() == 0


def test_chat_parts_split_long_conversations(spark):
    rows = stored(spark, [(7, i, "assistant" if i % 2 else "user", f"turn {i} ### {i}") for i in range(3000)], "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        parts = cut(chat_format.format_chat(rows), "chat")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert parts.count() >= 6
    got = chat_format.read_back(parts).collect()
    text = "".join(f"{'assistant' if i % 2 else 'user'}\nturn {i} ### {i}\n" for i in range(3000))
    assert [(r.n_turns, r.turns_sha256) for r in got] == [(3000, hashlib.sha256(text.encode()).hexdigest())]


def test_query_adds_the_control_conversation(spark):
    got = {r.conv_id: r for r in queries.op10_chat_format(spark, SF_MID).collect()}
    text = "\\### Assistant: </turn> ok"
    assert got[-7].n_turns == 2 and got[-7].loss_chars == len(text)
    assert got[-7].loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
