"""Classifier heads on assembled, frozen features.

``fit_newton`` is a distributed Newton solver of the logistic head: one pass
over the rows a step, whose Arrow batches give gradient and Hessian, summed in
a tree; the driver solves a system of the number of features.  The other heads
use ``pyspark.ml`` estimators (distributed L-BFGS); acceptance is AUC against
a NumPy solver on a fixture, not equal coefficients with the gradient-trained
reference heads.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

import numpy as np
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators import metrics as M
from cohortlens.operators import sums as S
from cohortlens.session import materialize


def features_image_text(seq: DataFrame, out: str = "features") -> DataFrame:
    """C1/C2 input: newest image vector ++ first text row."""
    return seq.withColumn(out, F.concat(F.col("img")[0], F.col("expr")[0]))


def features_latest_image(seq: DataFrame, out: str = "features") -> DataFrame:
    """C3 input: newest image vector only."""
    return seq.withColumn(out, F.col("img")[0])


def _vec(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn("_fv", array_to_vector(F.col(col).cast("array<double>")))


def fit_linear(train: DataFrame, features: str = "features", label: str = "label", reg: float = 0.0, max_iter: int = 100):
    """Logistic regression (one logit, sigmoid)."""
    lr = LogisticRegression(featuresCol="_fv", labelCol="_y", regParam=reg, maxIter=max_iter)
    return lr.fit(_vec(train, features).withColumn("_y", F.col(label).cast("double")))


@dataclass(frozen=True)
class NewtonModel:
    """Logistic head: one coefficient per feature, in the features' own units."""

    coefficients: np.ndarray
    intercept: float
    steps: int
    loss: float
    converged: bool


def _newton_sums(beta: np.ndarray, centre: np.ndarray, spread: np.ndarray):
    def run(batches):
        d = len(beta)
        loss, n, gradient, hessian = 0.0, 0, np.zeros(d), np.zeros((d, d))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack(batch.column("features").to_numpy(zero_copy_only=False)).astype(float)
            x = np.column_stack([np.ones(len(x)), (x - centre) / spread])
            y = batch.column("label").to_numpy(zero_copy_only=False).astype(float)
            z = x @ beta
            p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            loss += float((np.logaddexp(0, z) - y * z).sum())
            gradient += x.T @ (p - y)
            hessian += (x * (p * (1 - p))[:, None]).T @ x
            n += len(y)
        yield S.partial(np.concatenate([[n, loss], gradient, hessian.ravel()]))
    return run


def _moments(batches):
    """Rows, sums and sums of squares of the features of a partition."""
    total = None
    for batch in batches:
        if batch.num_rows:
            x = np.stack(batch.column("features").to_numpy(zero_copy_only=False)).astype(float)
            part = np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])
            total = part if total is None else total + part
    if total is not None:
        yield S.partial(total)


def fit_newton(train: DataFrame, features: str = "features", label: str = "label", ridge: float = 0.0, max_steps: int = 50,
               tol: float = 1e-10) -> NewtonModel:
    """Logistic regression by Newton steps (iteratively reweighted least squares).

    Each step is one pass whose partitions return a gradient and a Hessian of
    (features + 1) squared numbers, added in a tree of bounded fan-in; nothing else
    reaches the driver.  Features are standardised while fitting; ``ridge``
    penalises the standardised coefficients, per row.  A step that raises the
    loss is halved.  Rows without features or label are left out; without any
    row the fit is an error.  ``converged`` is False where ``max_steps`` did not
    bring the largest gradient per row below ``tol`` (classes that a plane
    separates have no finite solution without ``ridge``).
    """
    rows = train.where(F.col(features).isNotNull() & F.col(label).isNotNull()).select(
        F.col(features).cast("array<double>").alias("features"), F.col(label).cast("double").alias("label"))
    rows = materialize(rows)
    n_parts = rows.rdd.getNumPartitions()
    moments = S.tree_sum(rows.mapInArrow(_moments, S.SCHEMA), n_parts)
    if moments is None:
        raise ValueError("no row with features and a label")
    n, d = moments[0], (len(moments) - 1) // 2
    centre = moments[1:d + 1] / n
    spread = np.sqrt(np.maximum(moments[d + 1:] / n - centre ** 2, 0))
    # a constant feature keeps its place with a coefficient of 0
    constant = spread <= 1e-12 * np.maximum(1, np.abs(centre))
    spread = np.where(constant, 1.0, spread)
    penalty = np.concatenate([[0.0], np.full(d, ridge)])
    beta, move, last, steps, slope = np.zeros(d + 1), None, np.inf, 0, np.inf
    while steps < max_steps:
        steps += 1
        sums = S.tree_sum(rows.mapInArrow(_newton_sums(beta, centre, spread), S.SCHEMA), n_parts)
        loss = sums[1] / n + penalty @ beta ** 2 / 2
        if loss > last + 1e-12 * abs(last) and np.abs(move).max() > 1e-12:
            move = move / 2
            beta = beta - move
            continue
        gradient = sums[2:d + 3] / n + penalty * beta
        hessian = sums[d + 3:].reshape(d + 1, d + 1) / n + np.diag(penalty)
        last, slope = loss, np.abs(gradient).max()
        if slope <= tol:
            break
        move = -np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        beta = beta + move
    coefficients = np.where(constant, 0.0, beta[1:] / spread)
    return NewtonModel(coefficients, float(beta[0] - coefficients @ centre), steps, float(last), bool(slope <= tol))


def predict_newton(model: NewtonModel, df: DataFrame, features: str = "features", label: str = "label", key: str = "pid") -> DataFrame:
    """Prediction frame (pid, label, prob) of a Newton head, by column functions."""
    weights = F.array(*[F.lit(float(w)) for w in model.coefficients])
    z = F.aggregate(F.zip_with(F.col(features), weights, lambda x, w: x.cast("double") * w), F.lit(float(model.intercept)), lambda acc, x: acc + x)
    return df.select(key, F.col(label).cast("int").alias("label"), M.sigmoid(z).alias("prob"))


def fit_mlp(train: DataFrame, dim: int, features: str = "features", label: str = "label", max_iter: int = 100,
            seed: int = 1105):
    """MLP head, layers [d, 2d, 2d, 2] (sigmoid hidden units)."""
    mlp = MultilayerPerceptronClassifier(featuresCol="_fv", labelCol="_y", layers=[dim, 2 * dim, 2 * dim, 2],
                                         maxIter=max_iter, seed=seed)
    return mlp.fit(_vec(train, features).withColumn("_y", F.col(label).cast("double")))


def predict(model, df: DataFrame, features: str = "features", label: str = "label", key: str = "pid") -> DataFrame:
    """Prediction frame (pid, label, prob = P(class 1))."""
    out = model.transform(_vec(df, features))
    return out.select(key, F.col(label).cast("int").alias("label"),
                      vector_to_array("probability")[1].alias("prob"))


def evaluate(pred: DataFrame, label: str = "label", prob: str = "prob") -> DataFrame:
    """C4: AUC (A8), accuracy at 0.5 (A9), BCE from the logit of prob (A11), n."""
    eps = 1e-12
    p = F.least(F.greatest(F.col(prob), F.lit(eps)), F.lit(1 - eps))
    z = pred.withColumn("_z", F.log(p / (1 - p)))
    stats = z.agg(M.accuracy(label, prob).alias("accuracy"), M.bce_with_logits("_z", label).alias("loss"),
                  F.count(F.lit(1)).alias("n")).withColumn("_k", F.lit(0))
    a = M.auc(pred, label, prob).withColumn("_k", F.lit(0))
    return a.join(stats, "_k").drop("_k")


def weights_frame(spark: SparkSession, weights: Sequence[float]) -> DataFrame:
    """Coefficient vector (driver-size: one number per feature) -> (idx, weight)."""
    return spark.createDataFrame([(i, float(w)) for i, w in enumerate(weights)], "idx int, weight double")


def rank_features(weights: DataFrame, top: int | None = None, frac: float = 0.1) -> DataFrame:
    """O2: features by |weight| descending (ties by index); top ``round(frac * n)`` (half-even)
    unless ``top`` is given.  Output (rank, idx, importance)."""
    from pyspark.sql import Window
    w = Window.orderBy(F.desc("importance"), F.asc("idx"))
    ranked = weights.select("idx", F.abs("weight").alias("importance")).withColumn("rank", F.row_number().over(w))
    if top is None:
        n = weights.count()
        top = int(round(frac * n))
    return ranked.where(F.col("rank") <= top).select("rank", "idx", "importance")
