"""Classifier heads against a NumPy solver, alignment properties, job smoke tests with sinks."""

import os
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL


def _numpy_logreg(X, y, iters=50):
    A = np.column_stack([np.ones(len(X)), X])
    w = np.zeros(A.shape[1])
    for _ in range(iters):
        p = 1 / (1 + np.exp(-A @ w))
        H = A.T @ (A * (p * (1 - p))[:, None]) + 1e-8 * np.eye(A.shape[1])
        w -= np.linalg.solve(H, A.T @ (p - y))
    return 1 / (1 + np.exp(-A @ w))


def _auc(y, s):
    order = np.argsort(s)
    ranks = np.empty(len(s))
    ranks[order] = np.arange(1, len(s) + 1)
    P = y.sum()
    return (ranks[y == 1].sum() - P * (P + 1) / 2) / (P * (len(y) - P))


def test_linear_head_auc_matches_numpy_solver(spark):
    from cohortlens.operators import classify as K
    rng = np.random.default_rng(7)
    X = rng.normal(size=(400, 6))
    y = ((X @ rng.normal(size=6) + rng.normal(scale=1.5, size=400)) > 0).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"pid": [str(i) for i in range(400)], "label": y,
                                             "features": list(X.astype(np.float32))}))
    model = K.fit_linear(df)
    pred = K.predict(model, df).toPandas().sort_values("pid", key=lambda s: s.astype(int))
    ours = _auc(pred["label"].to_numpy(), pred["prob"].to_numpy())
    ref = _auc(y, _numpy_logreg(X.astype(np.float32).astype(np.float64), y))
    assert abs(ours - ref) < 0.005
    ev = K.evaluate(K.predict(model, df)).collect()[0]
    assert ev["auc"] == pytest.approx(ours, abs=1e-9) and 0 <= ev["accuracy"] <= 1 and ev["n"] == 400


def test_rank_features_half_even_top(spark):
    from cohortlens.operators.classify import rank_features, weights_frame
    w = weights_frame(spark, [0.1, -0.9, 0.3, 0.9, -0.2, 0.0, 0.5, 0.05, -0.4, 0.2, 0.6, 0.7, -0.8, 0.15, 0.25])
    r = rank_features(w).orderBy("rank").collect()
    assert [x.idx for x in r] == [1, 3]  # round(1.5) == 2, tie |0.9| broken by index


def test_paired_alignment_recovers_shared_signal(spark):
    from cohortlens.operators.vectors import paired_alignment
    rng = np.random.default_rng(0)
    z = rng.normal(size=(2000, 2))
    X = np.column_stack([z, rng.normal(size=(2000, 4))]) @ rng.normal(size=(6, 6))
    Y = np.column_stack([z, rng.normal(size=(2000, 3))]) @ rng.normal(size=(5, 5))
    df = spark.createDataFrame(pd.DataFrame({"x": list(X.astype(np.float32)), "y": list(Y.astype(np.float32))}))
    al = paired_alignment(df.repartition(4), "x", "y", k=3)
    assert al["corr"][0] > 0.99 and al["corr"][1] > 0.99 and al["corr"][2] < 0.2
    assert al["n"] == 2000


def test_jobs_write_and_score(spark):
    from cohortlens.plans import jobs as J
    from cohortlens.sources import testdata as td
    out = tempfile.mkdtemp(prefix="jobs-")
    scans, vecs, txt = td.vec_scans(spark, SF_SMALL), td.scan_vectors(spark, SF_SMALL), td.text_vectors(spark, SF_SMALL)
    feats = J.job_predict(scans, vecs, txt, out_dir=out)
    assert spark.read.parquet(os.path.join(out, "features")).count() == feats.count() == scans.select("pid").distinct().count()
    pred, auc = J.job_zeroshot(scans, vecs, td.class_vectors(spark, SF_SMALL), out_dir=out)
    assert spark.read.parquet(os.path.join(out, "zeroshot_predictions")).count() == pred.count()
    a = auc.collect()[0]["auc"]
    assert a is None or 0 <= a <= 1
    al, metrics = J.job_align(scans, vecs, txt, k=4, batch_size=16)
    rows = metrics.collect()
    assert sum(r["n"] for r in rows) == scans.select("pid").distinct().count()
    assert all(0 <= r["acc"] <= 1 and r["loss"] > 0 for r in rows)


def test_newton_coefficients_match_a_numpy_solver(spark):
    from cohortlens.operators import classify as K
    rng = np.random.default_rng(3)
    X = rng.normal(size=(700, 5)) * [1, 100, 0.01, 1, 1] + [0, 50, 3, 0, 0]
    X[:, 4] = 2.5  # constant
    y = (rng.random(700) < 1 / (1 + np.exp(-(0.5 * X[:, 0] - 0.02 * (X[:, 1] - 50) + 60 * (X[:, 2] - 3))))).astype(int)
    rows = [(str(i), int(y[i]), X[i].tolist()) for i in range(700)] + [("n", None, [0.0] * 5), ("m", 1, None)]
    df = spark.createDataFrame(rows, "pid string, label int, features array<double>").repartition(40)
    model = K.fit_newton(df)
    assert model.converged and model.steps < 15 and model.coefficients[4] == 0
    A = np.column_stack([np.ones(700), X[:, :4]])
    w = np.zeros(5)
    for _ in range(60):
        p = 1 / (1 + np.exp(-A @ w))
        w -= np.linalg.solve(A.T @ (A * (p * (1 - p))[:, None]), A.T @ (p - y))
    assert np.allclose([model.intercept, *model.coefficients[:4]], w, rtol=1e-8, atol=1e-8)
    pred = {r.pid: r.prob for r in K.predict_newton(model, df.where("features IS NOT NULL AND label IS NOT NULL")).collect()}
    assert np.allclose([pred[str(i)] for i in range(700)], 1 / (1 + np.exp(-A @ w)))
    # classes that a plane separates: a ridge gives a finite solution
    apart = spark.createDataFrame([(int(x > 0), [float(x)]) for x in (-3, -2, -1, 1, 2, 3)], "label int, features array<double>")
    assert not K.fit_newton(apart, max_steps=5).converged and K.fit_newton(apart, ridge=0.1).converged
    with pytest.raises(ValueError, match="no row"):
        K.fit_newton(apart.where("false"))


@pytest.mark.parametrize("tile", [1, 7, 64])
def test_tiled_contrastive_equals_the_whole_matrix(spark, tile):
    from cohortlens.operators import vectors as V
    rng = np.random.default_rng(5)
    rows = [(b, f"p{i:03}", rng.normal(size=6).tolist(), rng.normal(size=6).tolist()) for b, size in ((0, 40), (1, 1), (9, 13)) for i in range(size)]
    rows[3] = (*rows[3][:2], rows[2][2], rows[2][3])  # a repeated vector: the first maximum counts
    df = spark.createDataFrame(rows, "batch_id long, pid string, img array<double>, txt array<double>").repartition(5)
    got = {r.batch_id: r for r in V.tiled_contrastive(df, "img", "txt", tile=tile).collect()}
    want = {r.batch_id: r for r in V.in_batch_contrastive(df, "img", "txt").collect()}
    assert set(got) == set(want)
    for b in want:
        assert got[b].n == want[b].n and got[b].loss == pytest.approx(want[b].loss, rel=1e-5) and got[b].acc == pytest.approx(want[b].acc)
