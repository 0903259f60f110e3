"""Evaluation metrics as distributed aggregations.

ROC AUC is computed with the tie-aware rank-sum identity

    AUC = sum_s pos(s) * (neg(<s) + neg(s)/2) / (P * N)

over score cells ``(group, score) -> (pos, neg)``.  ``neg(<s)`` is a prefix
sum; to keep every window partitioned, score cells are partitioned by score
ranges, whose bounds Spark takes from a bounded sample (equal scores always
share a partition): the prefix is the running total of the lower partitions
(a window over a frame of ``groups x partitions`` rows) plus a running sum
inside the partition.  No window ever spans all rows or all distinct scores,
and no list of bounds that grows with the rows reaches the driver's plan.
"""

from __future__ import annotations

import math
from statistics import NormalDist
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scores that are looked up as frequent at most, and the rank error of their search.
HEAVY_QUANTILES, HEAVY_ERROR = 256, 1e-3


def _cols(by) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def heavy_scores(df: DataFrame, score: str) -> list[float]:
    """Scores that fill two or more of 256 approximate quantiles: 128 at most, whatever the size of ``df``."""
    probs = [i / HEAVY_QUANTILES for i in range(1, HEAVY_QUANTILES)]
    q = df.where(F.col(score).isNotNull()).agg(
        F.percentile_approx(F.col(score).cast("double"), probs, int(math.ceil(1.0 / HEAVY_ERROR))).alias("q")).first()["q"] or []
    return sorted({x for x, y in zip(q, q[1:]) if x == y})


def range_partitions(df: DataFrame, buckets="auto") -> int:
    """Number of score ranges: the session's shuffle partitions, unless given."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) if buckets == "auto" else max(1, int(buckets))


def with_score_range(cells: DataFrame, score: str, buckets="auto", out: str = "_bucket") -> DataFrame:
    """``cells`` partitioned by score ranges in order, with the partition's number.

    Bounds come from Spark's bounded sample of each partition; a number given
    to the shuffle keeps partitions from being merged or split later.
    """
    return cells.repartitionByRange(range_partitions(cells, buckets), score).withColumn(out, F.spark_partition_id())


def score_cells(df: DataFrame, label: str, score: str, by=(), weight: str | None = None) -> DataFrame:
    """(by..., score) -> pos, neg  (weighted counts; NULL label or score dropped).

    Partial aggregation collapses rows map-side, so the shuffle carries at most
    one row per (group, distinct score) per partition.
    """
    by = _cols(by)
    w = F.col(weight) if weight else F.lit(1)
    y = F.col(label)
    rows = df.where(y.isNotNull() & F.col(score).isNotNull())
    return rows.groupBy(*by, score).agg(
        F.sum(F.when(y == 1, w).otherwise(0)).cast("double").alias("_pos"),
        F.sum(F.when(y == 1, 0).otherwise(w)).cast("double").alias("_neg"),
    )


def auc_from_cells(cells: DataFrame, score: str, by=(), buckets="auto") -> DataFrame:
    """AUC per group from score cells; NULL when a group lacks one of the classes.

    Linear plan, no self-join: (1) running negatives inside each
    (group, bucket) window give the in-bucket part of the numerator;
    (2) bucket totals form a small frame (groups x buckets rows) whose
    running sum over lower buckets adds the cross-bucket part.
    """
    by = _cols(by)
    cells = with_score_range(cells, score, buckets)
    inside = Window.partitionBy(*by, "_bucket").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    part = F.col("_pos") * (F.coalesce(F.sum("_neg").over(inside), F.lit(0.0)) + F.col("_neg") / 2)
    buckets = (cells.select(*by, "_bucket", "_pos", "_neg", part.alias("_num"))
               .groupBy(*by, "_bucket")
               .agg(F.sum("_num").alias("_num"), F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg")))
    return auc_from_buckets(buckets, by)


def auc_from_buckets(buckets: DataFrame, by=()) -> DataFrame:
    """AUC per group from score buckets in order: _bucket, _num (pairs won inside), _pos, _neg."""
    by = _cols(by)
    lower = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn(
        "_num", F.col("_num") + F.col("_pos") * F.coalesce(F.sum("_neg").over(lower), F.lit(0.0)))
    agg = buckets.groupBy(*by).agg(F.sum("_num").alias("_num"), F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N"))
    return agg.select(*by, F.when((F.col("_P") > 0) & (F.col("_N") > 0),
                                  F.col("_num") / (F.col("_P") * F.col("_N"))).alias("auc"))


def auc(df: DataFrame, label: str = "label", score: str = "prob", by=(), weight: str | None = None,
        buckets="auto") -> DataFrame:
    """Tie-aware ROC AUC per group (``by``), optionally weighted; ``buckets``: number of score ranges."""
    return auc_from_cells(score_cells(df, label, score, by, weight), score, by, buckets)


def accuracy(label: str = "label", score: str = "prob", threshold: float = 0.5, weight: str | None = None) -> Column:
    """(weighted) share of rows with ``(score > threshold) == label``."""
    hit = ((F.col(score) > threshold).cast("int") == F.col(label)).cast("double")
    if weight is None:
        return F.avg(hit)
    w = F.col(weight).cast("double")
    # weights that sum to 0 (an empty replicate) have no metric
    return F.try_divide(F.sum(hit * w), F.sum(w))


def argmax_accuracy(logits: str, label: str = "label") -> Column:
    """Share of rows whose arg-max logit index equals the label."""
    v = F.col(logits)
    pred = F.array_position(v, F.array_max(v)) - 1
    return F.avg((pred == F.col(label)).cast("double"))


def bce_with_logits(logit: str, label: str = "label", weight: str | None = None) -> Column:
    """Mean binary cross-entropy from logits, numerically stable form."""
    z, y = F.col(logit), F.col(label).cast("double")
    loss = F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))
    if weight is None:
        return F.avg(loss)
    w = F.col(weight).cast("double")
    return F.try_divide(F.sum(loss * w), F.sum(w))


def logit(p) -> Column:
    """Logarithm of the odds of a probability: infinite at 0 and 1, NaN outside of [0, 1], NULL for NULL."""
    p = (F.col(p) if isinstance(p, str) else p).cast("double")
    # a probability of 1 has no quotient
    return (F.when(p == 1, F.lit(math.inf)).when(p == 0, F.lit(-math.inf)).when((p > 1) | (p < 0), F.lit(math.nan))
            .otherwise(F.log(F.try_divide(p, 1 - p))))


def sigmoid(c) -> Column:
    """M3."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def softmax2_prob1(z0, z1) -> Column:
    """M3: softmax over two logits, probability of class 1."""
    z0 = F.col(z0) if isinstance(z0, str) else z0
    z1 = F.col(z1) if isinstance(z1, str) else z1
    return sigmoid(z1 - z0)


def z_value(confidence: float) -> float:
    return NormalDist().inv_cdf(1 - (1 - confidence) / 2)


def mean_ci(df: DataFrame, value_cols: Sequence[str], by=(), confidence: float = 0.95,
            percentiles: bool = False) -> DataFrame:
    """Per group and metric i: mean_i, lci_i, uci_i = mu -/+ z * std_pop / sqrt(n).

    NULL values (undefined replicates) are skipped and not counted in n.
    ``percentiles`` adds the percentile interval ``plo_i, phi_i`` (Q23 option).
    """
    by = _cols(by)
    z = z_value(confidence)
    lo, hi = (1 - confidence) / 2, 1 - (1 - confidence) / 2
    aggs, outs = [], []
    for i, c in enumerate(value_cols):
        aggs += [F.avg(c).alias(f"_mu{i}"), F.stddev_pop(c).alias(f"_sd{i}"), F.count(c).alias(f"_n{i}")]
        if percentiles:
            aggs.append(F.percentile(c, F.array(F.lit(lo), F.lit(hi))).alias(f"_pq{i}"))
        me = F.lit(z) * F.col(f"_sd{i}") / F.sqrt(F.col(f"_n{i}"))
        outs += [F.col(f"_mu{i}").alias(f"mean_{i}"), (F.col(f"_mu{i}") - me).alias(f"lci_{i}"),
                 (F.col(f"_mu{i}") + me).alias(f"uci_{i}")]
        if percentiles:
            outs += [F.col(f"_pq{i}")[0].alias(f"plo_{i}"), F.col(f"_pq{i}")[1].alias(f"phi_{i}")]
    return df.groupBy(*by).agg(*aggs).select(*by, *outs)


def one_hot2(label) -> Column:
    """M4: one-hot of a binary label as [1-y, y] (float)."""
    y = F.col(label) if isinstance(label, str) else label
    return F.array(F.when(y == 0, 1.0).otherwise(0.0), F.when(y == 1, 1.0).otherwise(0.0))


def argmax_index(logits) -> Column:
    """M4: 0-based index of the first maximum of an array."""
    v = F.col(logits) if isinstance(logits, str) else logits
    return F.array_position(v, F.array_max(v)) - 1


def bce_with_logits_onehot(logits: str, label: str = "label") -> Column:
    """A11 with N x 2 outputs: mean over rows and both outputs of BCE(logit_j, onehot_j)."""
    z = F.col(logits)
    t = one_hot2(label)

    def term(j):
        zj, yj = z[j], t[j]
        return F.greatest(zj, F.lit(0.0)) - zj * yj + F.log1p(F.exp(-F.abs(zj)))
    return F.avg((term(0) + term(1)) / 2)
