"""Physical-plan properties: pushdown and pruning on real Parquet, top-k before the shuffle, no self-join in AUC."""

import os
import tempfile

import pandas as pd

from conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_cohort_filters_reach_the_parquet_scan(spark):
    from cohortlens.operators.cohort import curate_scans, dedupe_max
    d = tempfile.mkdtemp(prefix="plan-")
    pdf = pd.DataFrame({"pid": ["a", "a", "b"], "scandate": pd.to_datetime(["2001-01-01", None, "2002-01-01"]).date,
                        "slice_thickness": [1.0, 2.5, 6.0], "bmi": [20.0, 21.0, 22.0], "unused": ["x", "y", "z"]})
    spark.createDataFrame(pdf).write.parquet(os.path.join(d, "scans"))
    raw = spark.read.parquet(os.path.join(d, "scans"))
    q = dedupe_max(curate_scans(raw, 5).select("pid", "scandate", "bmi"), ["pid", "scandate"])
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = _plan(q)
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    for f in ("IsNotNull(scandate)", "LessThan(slice_thickness,5.0)", "IsNotNull(pid)"):
        assert f in pushed, pushed
    assert "unused" not in plan.split("ReadSchema:")[1].split("\n")[0]
    assert q.count() == 1


def test_latest_k_limits_before_exchange(spark):
    from cohortlens.operators.sequences import latest_k
    from cohortlens.sources import testdata as td
    q = latest_k(td.vec_scans(spark, SF_SMALL), 3)
    assert "WindowGroupLimit" in _plan(q)


def test_auc_plan_has_no_join(spark):
    from cohortlens.operators.metrics import auc
    from cohortlens.sources import testdata as td
    plan = _plan(auc(td.predictions(spark, SF_SMALL), "label", "score", by="l_linestatus"))
    assert "Join" not in plan
