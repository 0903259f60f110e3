"""Findings of round 3: inputs that failed, and work that was done twice or moved too often."""

import numpy as np
import pytest
from pyspark.sql import functions as F

LINES = "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string"


def _lines(spark, path, prices):
    rows = [(i, 1, i, i, p, 0.05, "R" if i % 2 else "N", "O" if i < 3 else "F") for i, p in enumerate(prices)]
    spark.createDataFrame(rows, LINES).write.parquet(str(path / "lineitem.parquet"))
    return str(path)


def test_a_score_of_one_is_no_error_in_accuracy_bce(spark, tmp_path):
    from cohortlens.operators import metrics as M
    from cohortlens.plans.catalog.metrics import accuracy_bce
    got = {r.l_linestatus: r for r in accuracy_bce(spark, _lines(spark, tmp_path, [1000.0, 52500.0, 105000.0, 3000.0])).collect()}
    assert got["O"].n == 3 and got["F"].n == 1 and np.isnan(got["O"].bce) and np.isfinite(got["F"].bce)
    z = spark.createDataFrame([(0.25,), (1.0,), (0.0,), (1.5,), (None,)], "p double").select(M.logit("p").alias("z")).collect()
    assert z[0].z == pytest.approx(np.log(1 / 3)) and z[1].z == np.inf and z[2].z == -np.inf and np.isnan(z[3].z) and z[4].z is None


def test_a_score_of_one_is_no_error_in_logit_metrics(spark, tmp_path):
    from cohortlens.plans.catalog.metrics import logit_metrics
    got = {r.l_linestatus: r for r in logit_metrics(spark, _lines(spark, tmp_path, [1000.0, 52500.0, 105000.0, 3000.0])).collect()}
    assert np.isfinite(got["O"].mean_sigmoid) and np.isfinite(got["O"].argmax_acc) and np.isnan(got["O"].bce_single) and np.isfinite(got["F"].bce_onehot)


def test_texts_are_encoded_once(spark):
    from cohortlens.operators import vectors as V
    texts = spark.createDataFrame([("a", "The age is 40"), ("b", None), ("c", "40 40 x")], "pid string, text string")
    vecs = V.encode_texts(texts)
    plan = vecs.select("pid", F.posexplode("vec"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    got = {r.pid: np.array(r.vec) for r in vecs.collect()}
    assert not got["b"].any() and np.linalg.norm(got["a"]) == pytest.approx(1) and sorted(np.abs(got["c"][got["c"] != 0])) == pytest.approx([1 / 5 ** 0.5, 2 / 5 ** 0.5])


def test_variants_share_one_pass(spark):
    from conftest import SF_SMALL
    from cohortlens.operators import cohort as C, text as X
    from cohortlens.sources import testdata as td
    cohort = C.scan_cohort(td.scans(spark, SF_SMALL))
    items = X.variant_items(cohort, variants=("plain", "label", "json", "json_label"))
    alone = {"plain": X.clinical_items(cohort), "label": X.clinical_items(cohort, include_label=True),
             "json": X.json_items(cohort), "json_label": X.json_items(cohort, include_label=True)}
    for variant, one in alone.items():
        got = items.where(F.col("variant") == variant).select("pid", "scandate", "text")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, one.collect()))
    one_pass = X.variant_items(cohort)._jdf.queryExecution().optimizedPlan().toString().count("max_by")
    assert one_pass == X.clinical_items(cohort)._jdf.queryExecution().optimizedPlan().toString().count("max_by")
    with pytest.raises(ValueError):
        X.variant_items(cohort, variants=("plain", "other"))


def test_small_groups_have_twenty_replicates(spark, tmp_path, monkeypatch):
    from cohortlens.operators import bootstrap as B
    from cohortlens.plans.catalog.metrics import bootstrap_small_groups
    from cohortlens.plans.oracle import all_sql
    seen = []
    monkeypatch.setattr(B, "bootstrap", lambda df, *args, **kw: seen.append(kw["n"]) or df)
    bootstrap_small_groups(spark, _lines(spark, tmp_path, [1000.0, 2000.0]))
    assert seen == [20] and "range(20)" in all_sql()["bootstrap_small_groups"]


def _replicates(spark, large_group):
    from cohortlens.operators import bootstrap as B
    rng = np.random.default_rng(2)
    rows = [(g, f"{g}-{i}", int(rng.integers(0, 2)), float(rng.random())) for g, size in (("a", 60), ("b", 3), ("c", 1), (None, 4)) for i in range(size)]
    df = spark.createDataFrame(rows, "g string, rowkey string, label int, prob double")
    metrics = [B.accuracy_metric(), B.mean_metric("prob")]
    return df, metrics, B.aggregate_replicates(df, metrics, "rowkey", ["g"], 9, 1105, ["x", "y"], large_group)


@pytest.mark.parametrize("large_group", [2, 50, 1000])
def test_aggregates_of_replicates_equal_the_exploded_form(spark, large_group):
    from cohortlens.operators import bootstrap as B
    df, metrics, got = _replicates(spark, large_group)
    got = {(r.g, r.replicate): (r.x, r.y) for r in got.collect()}
    w = B.replicate_weights(df, "rowkey", 9)
    want = [{(r.g, r.replicate): r.value for r in m.fn(w, ["g", "replicate"], "weight").collect()} for m in metrics]
    assert len(got) == 36 and got.keys() == want[0].keys()
    for k, pair in got.items():
        for mine, other in zip(pair, (want[0][k], want[1][k])):
            assert (mine is None) == (other is None) and (mine is None or mine == pytest.approx(other, abs=1e-12))


def test_replicates_of_small_groups_are_not_shuffled(spark):
    plan = _replicates(spark, 1000)[2]._jdf.queryExecution().executedPlan().toString()
    # the rows go to their groups, and the replicates stay there
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Generate explode") < plan.index("Exchange hashpartitioning")


def test_named_files_do_not_pass_the_driver(spark, tmp_path, monkeypatch):
    from cohortlens.sources import io as IO
    for i in range(3):
        np.save(tmp_path / f"{i}.npy", np.full((1, 2), i, np.float32))
    names = [str(tmp_path / "0.npy"), f"file://{tmp_path}/0.npy", "1.npy", "2.npy"]
    paths = spark.createDataFrame([(n,) for n in names], "path string")
    # no name needs a place on the driver, and two spellings of a file are both kept
    got = IO.read_named_vectors(spark, paths, folder=str(tmp_path), most_files=0)
    assert sorted((r.path, r.vec[0]) for r in got.collect()) == sorted(zip(names, [0.0, 0.0, 1.0, 2.0]))


def test_tiled_contrastive_moves_a_vector_once_a_stripe(spark, monkeypatch):
    from cohortlens.operators import vectors as V
    monkeypatch.setattr(V, "STRIPES", 3)
    rng = np.random.default_rng(7)
    rows = [(b, f"p{i:03}", rng.normal(size=4).tolist(), rng.normal(size=4).tolist()) for b, size in ((0, 100), (4, 5), (5, 1)) for i in range(size)]
    df = spark.createDataFrame(rows, "batch_id long, pid string, img array<double>, txt array<double>").repartition(3)
    tiles = V.pack_tiles(df, "img", "txt", "batch_id", "pid", 2)
    cells = V.stripe_cells(tiles, "batch_id", 2)
    moved = cells.where("batch_id = 0").groupBy("_side").agg(F.sum("_n").alias("n")).collect()
    # 50 tiles, but 3 stripes: each vector goes to 3 cells, not to 50
    assert {r._side: r.n for r in moved} == {0: 300, 1: 300}
    got = {r.batch_id: r for r in V.tiled_contrastive(df, "img", "txt", tile=2).collect()}
    want = {r.batch_id: r for r in V.in_batch_contrastive(df, "img", "txt").collect()}
    assert set(got) == set(want)
    for b in want:
        assert got[b].n == want[b].n and got[b].loss == pytest.approx(want[b].loss, rel=1e-5) and got[b].acc == pytest.approx(want[b].acc)


def test_draws_in_32_bits_are_the_stream_of_the_columns(spark):
    from cohortlens.functions.hashing import poisson_weight, stream_uniform
    from cohortlens.operators import bootstrap as B
    h = np.concatenate([np.random.default_rng(1).integers(0, 2 ** 32, 5000), [0, 1, 2 ** 32 - 1]])
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(h)], "i int, h long").withColumn("b", F.explode(F.array(F.lit(0), F.lit(7), F.lit(99))))
    want = df.withColumn("u", stream_uniform(F.col("h"), F.col("b"))).select("i", "b", poisson_weight(F.col("u")).alias("w")).toPandas()
    for b in (0, 7, 99):
        drawn = B._draws(h, b, B._limits())
        assert drawn.dtype == np.uint8 and (drawn == want[want.b == b].sort_values("i").w.to_numpy()).all()


def test_rows_of_a_range_carry_no_null_lists(spark, tmp_path):
    from cohortlens.operators import bootstrap as B
    from cohortlens.sources import testdata as td
    df = td.predictions(spark, _lines(spark, tmp_path, [1000.0, 2000.0, 3000.0]))
    plan = B.auc_replicates(df, "rowkey", ["l_linestatus"], 5, 1105, "label", "score")._jdf.queryExecution().optimizedPlan().toString()
    assert "null AS _pos" not in plan and "[] AS _pos" in plan
