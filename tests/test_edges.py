"""Inputs that once failed or lost rows: repeated vectors, zero vectors, constant columns, missing labels, ids and columns."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from rowwise_impute import impute as rowwise


def _scan(spark, dates):
    rows = [("a", i, i, pd.Timestamp(d).date(), 1) for i, d in enumerate(dates)]
    return spark.createDataFrame(rows, "pid string, rid int, scanorder int, scandate date, lung_cancer int")


def test_two_vectors_for_a_scan_fail_instead_of_dropping_one(spark):
    from cohortlens.operators.sequences import assemble
    vecs = spark.createDataFrame([("a", "20020101", [1.0, 1.0]), ("a", "20020101", [9.0, 9.0]), ("a", "20010101", [2.0, 2.0])],
                                 "pid string, scan_key string, vec array<float>")
    with pytest.raises(Exception, match="several scan vectors"):
        assemble(_scan(spark, ["2001-01-01", "2002-01-01"]), vecs, 2).collect()
    one = assemble(_scan(spark, ["2001-01-01", "2002-01-01"]), vecs.where("vec[0] < 9"), 2).first()
    assert one.img == [[1.0, 1.0], [2.0, 2.0]]


def test_class_stack_repeated_and_missing(spark):
    from cohortlens.operators.sequences import class_stack
    cv = spark.createDataFrame([("a", 0, [1.0]), ("a", 1, [2.0]), ("b", 0, [3.0])], "pid string, class int, vec array<float>")
    got = {r.pid: r.expr for r in class_stack(cv).collect()}
    assert got == {"a": [[1.0], [2.0]], "b": None}
    with pytest.raises(Exception, match="repeated class vector"):
        class_stack(cv.union(cv)).collect()


def test_zero_vector_is_null_not_an_error(spark):
    from cohortlens.operators.sequences import l2_normalize
    from cohortlens.operators.vectors import zero_shot_prob
    df = spark.createDataFrame([([0.0, 0.0], [[1.0, 0.0], [0.0, 1.0]]), ([3.0, 4.0], [[1.0, 0.0], [0.0, 1.0]])],
                               "v array<float>, c array<array<float>>")
    got = df.select(l2_normalize(F.col("v")).alias("n"), zero_shot_prob(F.col("v"), F.col("c")).alias("p")).collect()
    assert got[0].n == [None, None] and got[0].p is None
    assert got[1].n == pytest.approx([0.6, 0.8]) and 0 < got[1].p < 1


def test_constant_column_has_no_zscore(spark):
    from cohortlens.operators.sequences import zscore_columns
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (None, None)], "a double, b double")
    got = zscore_columns(df, ["a", "b"]).collect()
    assert [r.b for r in got] == [None] * 3 and got[0].a == pytest.approx(-got[1].a)


def test_profile_without_labels_keeps_the_counts(spark):
    from cohortlens.operators.cohort import profile
    df = spark.createDataFrame([("a", None), ("a", None), ("b", None)], "pid string, y int")
    assert [tuple(r) for r in profile(df, "y").collect()] == [(None, 0, 3, 2)]


def test_json_of_a_missing_column_raises(spark):
    from cohortlens.operators import cohort as C
    from cohortlens.operators.text import json_items
    from cohortlens.sources import testdata as td
    cohort = C.scan_cohort(td.scans(spark, SF_SMALL))
    with pytest.raises(ValueError, match="nodule_attenuation"):
        json_items(cohort, scan_level=True)


def test_clashing_patient_columns_stay(spark):
    from cohortlens.sources.io import attach_patients
    s = spark.createDataFrame([("a", 1)], "pid string, age int")
    p = spark.createDataFrame([("a", 2, "x")], "pid string, age int, site string")
    assert attach_patients(s, p).first().asDict() == {"pid": "a", "age": 1, "age_patient": 2, "site": "x"}


def test_unknown_date_code_raises():
    from cohortlens.functions.dates import java_pattern
    assert java_pattern("%Y-%m-%dT%H") == "yyyy-MM-dd'T'HH"
    with pytest.raises(ValueError, match="%Q"):
        java_pattern("%Q")


def test_bootstrap_of_small_groups_has_no_error(spark):
    from cohortlens.operators import bootstrap as B
    rows = [(g, i, i % 2, 0.1 * i) for g in range(40) for i in range(g % 5 + 1)]
    df = spark.createDataFrame(rows, "g int, k int, label int, prob double").withColumn("rowkey", F.concat_ws("|", "g", "k"))
    got = B.bootstrap(df, [B.accuracy_metric(), B.mean_metric("prob"), B.auc_metric()], by="g", n=50).collect()
    assert len(got) == 40 and all(r.mean_0 is not None for r in got)
    assert all(r.mean_2 is None for r in got if r.g % 5 == 0)


def test_rows_without_id_have_weights_of_their_own(spark, tmp_path):
    from cohortlens.plans.jobs import job_bootstrap
    rng = np.random.default_rng(3)
    label = rng.integers(0, 2, 4000)
    pdf = pd.DataFrame({"id": range(4000), "label": label, "prob": np.round(np.clip(rng.normal(0.45 + 0.1 * label, 0.2), 0, 1), 1)})
    spark.createDataFrame(pdf).write.option("header", True).csv(str(tmp_path / "p.csv"))
    spark.createDataFrame(pdf.drop(columns="id")).write.option("header", True).csv(str(tmp_path / "q.csv"))
    width = []
    for path, key in (("p.csv", "id"), ("q.csv", None)):
        r = job_bootstrap(spark, str(tmp_path / path), key=key).first()
        width.append(r.uci_0 - r.lci_0)
    assert width[1] == pytest.approx(width[0], rel=0.5)


def test_auc_replicates_match_the_exploded_form(spark):
    from cohortlens.operators import bootstrap as B
    from cohortlens.operators import metrics as M
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"rowkey": [str(i) for i in range(900)], "g": ["a", "b", None] * 300, "label": rng.integers(0, 2, 900),
                        "prob": np.where(rng.random(900) < 0.4, 0.5, np.round(rng.random(900), 2))})
    df = spark.createDataFrame(pdf)
    got = B.auc_replicates(df, "rowkey", ["g"], 7, 1105, "label", "prob", buckets=16)
    w = B.replicate_weights(df, "rowkey", 7)
    want = M.auc(w, "label", "prob", ["g", "replicate"], "weight").withColumnRenamed("auc", "value")
    as_dict = lambda d: {(r.g, r.replicate): r.value for r in d.collect()}
    got, want = as_dict(got), as_dict(want)
    assert got.keys() == want.keys() and len(got) == 21
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_auc_bootstrap_moves_each_row_once(spark):
    from cohortlens.operators import bootstrap as B
    from cohortlens.sources import testdata as td
    plan = B.bootstrap(td.predictions(spark, SF_SMALL), B.auc_metric("label", "score"), by="l_linestatus")._jdf.queryExecution().executedPlan().toString()
    below = plan.split("MapInArrow")[1]
    assert "Exchange rangepartitioning(_s" in below and "Exchange hash" not in below
    assert "sequence" not in below  # no replicate before the row shuffle


def test_row_sample_sorts_one_bucket_only(spark):
    from cohortlens.operators.split import row_sample
    df = spark.range(5000).withColumn("wide", F.lit("x" * 50))
    q = row_sample(df, 0.3, "id")
    assert q.count() == 1500 and q.columns == ["id", "wide"]
    plan = q._jdf.queryExecution().optimizedPlan().toString()
    window = plan.split("Window [row_number()")[1]
    assert "_edge" in window.split("Join")[0] or "_b" in window


def test_impute_with_large_offset(spark):
    from cohortlens.operators.impute import chained_impute
    rng = np.random.default_rng(1)
    x = rng.normal(size=3000)
    X = np.column_stack([x + 1e8, 2 * x + rng.normal(scale=0.1, size=3000) - 1e8])
    X[rng.random(3000) < 0.2, 1] = np.nan
    df = spark.createDataFrame([(i, float(a), None if np.isnan(b) else float(b)) for i, (a, b) in enumerate(X)], "id int, a double, b double")
    for est in ("least_squares", "bayesian_ridge"):
        got = chained_impute(df, ["a", "b"], keep=["id"], estimator=est).orderBy("id").toPandas()[["a", "b"]].to_numpy()
        shifted = rowwise(X - [1e8, -1e8], estimator="ols" if est == "least_squares" else est) + [1e8, -1e8]
        assert np.abs(got - shifted).max() < 1e-3
        assert np.array_equal(got[~np.isnan(X)], X[~np.isnan(X)])


def test_impute_patterns_that_the_fitted_rows_lack(spark):
    from cohortlens.operators.impute import chained_impute
    rng = np.random.default_rng(2)
    x = rng.normal(size=500)
    fit = spark.createDataFrame([(float(a), float(3 * a + 1), None if i % 5 == 0 else float(-a)) for i, a in enumerate(x)], "a double, b double, c double")
    new = spark.createDataFrame([(0, None, 4.0, -1.0), (1, 2.0, None, None), (2, None, None, None)], "id int, a double, b double, c double")
    got = {r.id: r for r in chained_impute(new, ["a", "b", "c"], keep=["id"], estimator="least_squares", fit_on=fit).collect()}
    assert got[0].a == pytest.approx(1.0, abs=1e-6)
    assert got[1].b == pytest.approx(7.0, abs=1e-6) and got[1].c == pytest.approx(-2.0, abs=1e-6)
    assert got[2].a == pytest.approx(x.mean(), abs=1e-6)


def test_arrow_query_from_another_folder(tmp_path):
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.path.insert(0, {root!r})\n"
            "from cohortlens import get_spark\n"
            "import __spark_entry__ as E\n"
            "s = get_spark('local[2]')\n"
            f"print('ROWS', E.queries()['project_vectors'](s, {SF_SMALL!r}).count())\n")
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300,
                         env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert "ROWS 8000" in out.stdout, out.stderr[-2000:]


GOLDEN = ("The age of the subject is 63. The BMI of the subject is 24.50. The sex of the subject is male. "
          "The race of the subject is Black. The subject does not have Emphysema. The subject is a current smoker.")


def test_golden_sentence(spark):
    from cohortlens.functions.text import clinical_text
    df = spark.createDataFrame([(63.7, 24.5, None, 1, 2, 0, 1)], "age double, bmi double, pkyr double, gender int, race int, emphysema int, smo_status int")
    got = df.select(clinical_text(["age", "bmi", "pkyr", "gender", "race", "emphysema", "smo_status"]).alias("t")).first().t
    assert got == GOLDEN


def test_moments_do_not_depend_on_partitions(spark):
    from cohortlens.operators.vectors import moment_matrix
    rng = np.random.default_rng(4)
    X, Y = rng.normal(size=(900, 5)), rng.normal(size=(900, 3))
    df = spark.createDataFrame(pd.DataFrame({"x": list(X), "y": list(Y)}))
    Z = np.concatenate([np.ones((900, 1)), X, Y], axis=1)
    for parts in (1, 8, 200):
        assert np.allclose(moment_matrix(df.repartition(parts), "x", "y", fan_in=4, block=2), Z.T @ Z, rtol=1e-6)


def test_first_row_whole_or_by_column(spark):
    from cohortlens.operators.cohort import attach_nodule_count, dedupe_first
    df = spark.createDataFrame([("a", 1, None, 5.0), ("a", 2, 7, 6.0), (None, 3, 1, 1.0)], "pid string, rid long, x int, nodule_count double")
    assert dedupe_first(df, "pid").collect() == [("a", 1, 7, 5.0)]
    assert dedupe_first(df, "pid", whole_row=True).collect() == [("a", 1, None, 5.0)]
    year = df.withColumn("scandate", F.lit("2001"))
    left = year.drop("nodule_count")
    assert attach_nodule_count(left, year).where("pid = 'a'").count() == 4
    assert sorted((r.rid, r.nodule_count) for r in attach_nodule_count(left, year, by_rid=True).collect()) == [(1, 5.0), (2, 6.0), (3, 1.0)]


def test_unknown_race_code_fails_where_strict(spark):
    from cohortlens.functions.text import clinical_text, strict_race
    df = spark.createDataFrame([(1.0,), (None,), (99.0,)], "race double")
    assert [bool(r[0]) for r in df.select(clinical_text(["race"])).collect()] == [True, False, False]
    strict = clinical_text(["race"], {"race": strict_race})
    assert [bool(r[0]) for r in df.where("race = 1 OR race IS NULL").select(strict).collect()] == [True, False]
    with pytest.raises(Exception, match="unknown race code 99"):
        df.select(strict).collect()


def test_profile_of_a_continuous_label_broadcasts_totals_only(spark):
    from cohortlens.operators.cohort import profile
    df = spark.createDataFrame([(str(i % 3), float(i)) for i in range(50)], "pid string, y double")
    got = profile(df, "y")
    assert got.count() == 50 and got.first().n_subjects == 3
    empty = profile(df.withColumn("y", F.lit(None).cast("double")), "y").collect()
    assert empty == [(None, 0, 50, 3)]


def test_row_sample_pairs_no_rows_on_large_inputs(spark):
    from cohortlens.operators.split import row_sample
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = row_sample(spark.range(1000), 0.3, "id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "CartesianProduct" not in plan
