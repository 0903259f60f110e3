"""op1, op2, op3, op7 and op8 on edge cases, against row-by-row versions."""

import hashlib
import re
from collections import Counter

import pytest

import brute
from brute import edge_docs, edge_rows, stored
from cohortlens.llm import decontaminate, exact_dedup, license_scan, mixing, sharding

KEY = lambda r: tuple((x is None, str(x)) for x in r)


def same(got, want):
    assert sorted(map(tuple, got), key=KEY) == sorted(map(tuple, want), key=KEY)


def expected_scan(text):
    w = brute.words(text)
    base = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
    places = [(label, i) for label, p in base.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    starts = [i for _, i in places]
    return (len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for x, _ in places})))


def test_license_scan_edges(spark):
    got = license_scan.license_scan(edge_docs(spark)).collect()
    same([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got],
         [(r[0], *expected_scan(r[1])) for r in edge_rows()])
    noted = next(r for r in got if r.doc_id == 13)
    assert noted.labels == "cc-by,cc-by-nc,reserved" and noted.score == 1.0
    assert all(0 <= r.score <= 1 for r in got)


def test_license_scan_needs_every_phrase(spark):
    docs = stored(spark, [(0, "free and unencumbered software"), (1, "free and unencumbered software, in the public domain"),
                          (2, "public domain free and unencumbered software " * 3)], "doc_id long, text string")
    got = {r.doc_id: (r.labels, len(r.places)) for r in license_scan.license_scan(docs).collect()}
    assert got == {0: ("", 1), 1: ("unlicense", 2), 2: ("unlicense", 6)}


@pytest.mark.parametrize("fan_in", [2, 16])
def test_exact_dedup_edges(spark, fan_in):
    got = exact_dedup.exact_dedup(edge_docs(spark), fan_in=fan_in).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = Counter(norm(r[1]) for r in edge_rows())
    best = {}
    for r in edge_rows():
        rank = (-len(r[1] or ""), r[0] is None, r[0] or 0)
        best[norm(r[1])] = min(best.get(norm(r[1]), (rank, r[0])), (rank, r[0]), key=lambda x: x[0])
    same([(r.id, r.keep_id, r.group_size, r.text_sha256) for r in got],
         [(r[0], best[norm(r[1])][1], groups[norm(r[1])], hashlib.sha256(norm(r[1]).encode()).hexdigest()) for r in edge_rows()])
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter({hashlib.sha256(g.encode()).hexdigest(): 1 for g in groups})
    assert all(r.id == r.keep_id for r in got if r.kept)


ITEMS = [(1, brute.PASSAGE), (2, "the quick brown"), (10, None), (11, "..."), (None, "c d e"), (12, brute.PASSAGE + " nu xi")]


@pytest.mark.parametrize("bound", [2_000_000, 0])
def test_contamination_edges(spark, bound):
    items = stored(spark, ITEMS, "item_id long, text string")
    got = decontaminate.contamination(edge_docs(spark), items, max_broadcast_windows=bound).collect()
    want = []
    for r in edge_rows():
        flags, found = brute.hits(r[1], ITEMS)
        want.append((r[0], len(flags), sum(flags), [x for x in found if x != "None"], any(flags)))
    same([(r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got], want)
    for r in got:
        assert r.n_hit == sum(s.e - s.s for s in r.spans)


def test_remove_contaminated_keeps_rows_as_they_were(spark):
    items = stored(spark, ITEMS, "item_id long, text string")
    docs = edge_docs(spark)
    got = decontaminate.remove_contaminated(docs, items)
    assert got.columns == docs.columns
    same(got.collect(), [r for r in edge_rows() if not any(brute.hits(r[1], ITEMS)[0])])
    assert decontaminate.remove_contaminated(docs, items.where("false")).count() == len(edge_rows())


def test_mix_edges(spark):
    docs = edge_docs(spark)
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for r in edge_rows():
        sizes[r[3]] += len(brute.BLANK.findall(r[1] or ""))
    want = brute.targets(sizes)
    assert len(got) == len(edge_rows())
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
    assert sorted(got) == sorted(mixing.mix(docs).collect())


@pytest.mark.parametrize("weights", [(5, 2, 1), (1,), (50, 1)])
def test_mix_meets_targets(spark, weights):
    rows = [(i, "w " * (1 + i * i % 90), f"s{i % 5 if i % 3 else 0}") for i in range(600)]
    got = mixing.mix(stored(spark, rows, "doc_id long, text string, source string"), weights).collect()
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    for s, t in brute.targets(sizes, weights).items():
        assert abs(taken[s] - t) <= 0.01 * t + 5


def test_mixed_rows_repeats_rows(spark):
    docs = edge_docs(spark)
    plan = Counter()
    for r in mixing.mix(docs).collect():
        plan[r.id] += r.copies
    got = mixing.mixed_rows(docs)
    assert got.columns == docs.columns
    assert got.count() == sum(plan.values())


def test_shards_edges(spark):
    docs = edge_docs(spark)
    got = sharding.shard_rows(docs, 4, bucket_bytes=2_000)
    assert got.columns == [c for c in docs.columns if c not in ("size", "shard", "slot", "__order")] + ["size", "text_crc32", "shard", "slot"]
    rows = got.collect()
    per = brute.group_rows([(r.shard, r.slot) for r in rows])
    assert sorted(len(v) for v in per.values()) == [5, 6, 6, 6]
    assert all(sorted(x for _, x in v) == list(range(len(v))) for v in per.values())
    import zlib
    same([(r.doc_id, r.text, r["size"], r.text_crc32) for r in rows],
         [(r[0], r[1], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in edge_rows()])


def test_no_texts_are_shuffled_with_the_windows(spark):
    docs = stored(spark, [(1, brute.PASSAGE + " and more", "x")], "doc_id long, text string, source string")
    items = spark.createDataFrame([("a", brute.PASSAGE)], "item_id string, text string")
    out = decontaminate.contamination(docs, items, keep=("source",), max_broadcast_windows=0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # what joins the windows: places, the window and its hash
    probe = next(line for line in plan[plan.index("Join Inner"):].split("\n") if "Project" in line)
    columns = probe[probe.index("[") + 1:]
    assert "kept" not in columns and ", w#" not in columns and out.first().n_hit == 12


def test_shards_with_a_third_of_all_rows_equal(spark):
    rows = [(7, "the same text")] * 1_000 + [(1_000 + i, f"text {i}") for i in range(2_000)]
    docs = stored(spark, rows, "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = sharding.shard_rows(docs, 4, bucket_bytes=2_000)
        plan = out._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        assert plan.count("SortMergeJoin") == 0
        got = out.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    same([(r.doc_id, r.text) for r in got], rows)
    per = brute.group_rows([(r.shard, r.doc_id) for r in got])
    # copies go to all shards alike
    assert all(150 < sum(d == 7 for _, d in v) < 350 for v in per.values())


def test_shards_do_not_depend_on_partitions(spark):
    docs = stored(spark, [(i, "x" * (i % 17)) for i in range(500)], "doc_id long, text string")
    place = lambda df: sorted((r.doc_id, r.shard, r.slot) for r in sharding.shard_rows(df, 7, bucket_bytes=1_000).collect())
    first = place(docs)
    assert first == place(docs.repartition(5, "text"))
    order = [d for d, _, _ in sorted(first, key=lambda x: x[1:])]
    assert order != sorted(order)


def test_written_shards_read_back(spark):
    docs = stored(spark, [(i, f"t{i}") for i in range(50)], "doc_id long, text string")
    path = sharding.write_shards(sharding.shard_rows(docs, 3))
    assert spark.read.parquet(path).select("doc_id", "text").subtract(docs).count() == 0


def test_empty_tables(spark):
    none = edge_docs(spark).where("doc_id = -5")
    assert license_scan.license_scan(none).count() == 0
    assert exact_dedup.exact_dedup(none).count() == 0
    assert decontaminate.contamination(none, none.selectExpr("doc_id item_id", "text")).count() == 0
    assert mixing.mix(none).count() == 0 and mixing.mixed_rows(none).count() == 0
    assert sharding.shard_rows(none).count() == 0
