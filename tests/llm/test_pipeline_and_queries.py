"""The pipeline stage by stage, and the queries that have SQL against it."""

from collections import Counter

import pytest

import brute
import corpus_pipeline
from conftest import SF_SMALL
from cohortlens.llm import oracle
from cohortlens.llm.common import cut, table


@pytest.fixture(scope="module")
def stages(spark):
    docs = table(spark, SF_SMALL, "documents")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF_SMALL), name)
        out.append((name, docs))
    return dict(out)


def test_only_the_last_stage_adds_columns(stages):
    names = stages["documents"].columns
    assert [s.columns == names for s in stages.values()] == [True] * 5 + [False]


def test_near_duplicates_keep_one_of_each(stages):
    before = [(r.doc_id, r.text) for r in stages["toxicity"].collect()]
    groups = brute.component_ids(before)
    want = {c for n, c in groups.values() if n} | {d for d, (n, _) in groups.items() if not n}
    assert sorted(r.doc_id for r in stages["near_duplicates"].collect()) == sorted(want)


def test_decontamination_drops_hit_documents(spark, stages):
    items = [(r.item_id, r.text) for r in table(spark, SF_SMALL, "benchmark").collect()]
    want = [r.doc_id for r in stages["near_duplicates"].collect() if not any(brute.hits(r.text, items)[0])]
    assert sorted(r.doc_id for r in stages["decontamination"].collect()) == sorted(want)


def test_mixing_meets_targets(stages):
    size = lambda t: len(brute.BLANK.findall(t or ""))
    sizes, taken, copies = Counter(), Counter(), Counter()
    for r in stages["decontamination"].collect():
        sizes[r.source] += size(r.text)
    for r in stages["mixing"].collect():
        taken[r.source] += size(r.text)
        copies[r.doc_id] += 1
    assert max(copies.values()) <= 3
    for s, t in brute.targets(sizes).items():
        assert abs(taken[s] - t) <= 0.05 * t + 20


def test_sharding_keeps_all_rows(spark, stages):
    rows = stages["sharding"].collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in stages["mixing"].collect())
    per = brute.group_rows([(r.shard, r.slot) for r in rows])
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1 or len(rows) < 40
    assert all(sorted(x for _, x in v) == list(range(len(v))) for v in per.values())
    assert corpus_pipeline.run(spark, SF_SMALL).count() == len(rows)


def test_edge_table_through_all_stages(spark):
    """Nulls in any column, empty and very long texts, repeated rows and clashing names; then no rows at all."""
    docs = brute.edge_docs(spark)
    for start in (docs, docs.where("false")):
        now, names = cut(start, "edge"), start.columns
        before = now.count()
        for name, stage in corpus_pipeline.STAGES:
            now = cut(stage(spark, now, SF_SMALL), name)
            after = now.count()
            if name != "sharding":
                assert now.columns == names
            if name == "mixing":
                assert after <= 3 * before
            elif name == "sharding":
                assert after == before
            else:
                assert after <= before
            before = after
        assert {"size", "text_crc32", "shard", "slot"} <= set(now.columns)


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_query_matches_sql(spark, name):
    import os
    import sys
    sys.path.insert(0, os.path.join(os.path.dirname(corpus_pipeline.__file__), "tools"))
    from check_oracle import compare
    res = compare(spark, SF_SMALL, [name], verbose=False)[name]
    assert res[0] == "OK", res
