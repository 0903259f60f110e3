"""Repeatable sampling and splitting.

Exact-size selection by hash order: every row gets ``u = md5(key|seed)``;
the k rows with the smallest ``(u, key)`` are chosen, k = round-half-even
(frac * n) as pandas' ``sample(frac=...)``.  No global sort: the leading 16
bits of u form a histogram per stratum (at most strata x 65,536 rows), whose
running counts give the bucket that the k-th row falls into.  Rows of that
bucket, about n / 65,536, are ranked; lower buckets are taken whole.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.hashing import RANDOM_SEED, hash_bucket, uniform

BUCKET_BITS = 16


def _cols(x) -> list[str]:
    if not x:
        return []
    return [x] if isinstance(x, str) else list(x)


def hash_positions(df: DataFrame, key: str, by: Sequence[str] | str = (), seed: int = RANDOM_SEED,
                   bits: int = BUCKET_BITS) -> DataFrame:
    """Adds ``_pos`` (0-based rank of (u, key) inside the stratum) and ``_n`` (stratum size)."""
    by = _cols(by)
    x = df.withColumn("_u", uniform(F.col(key), seed=seed)).withColumn("_b", hash_bucket(F.col("_u"), bits))
    hist = x.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    hist = (hist.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
                .withColumn("_n", F.sum("_c").over(Window.partitionBy(*by)))
                .drop("_c"))
    x = x.join(hist, [*by, "_b"], "inner")
    inside = Window.partitionBy(*by, "_b").orderBy("_u", key)
    return x.withColumn("_pos", F.col("_before") + F.row_number().over(inside) - 1).drop("_before", "_b")


def take_fraction(df: DataFrame, frac: float, key: str, by: Sequence[str] | str = (),
                  seed: int = RANDOM_SEED) -> DataFrame:
    """R1 / R2 core: exactly round_half_even(frac * n) rows per stratum, repeatable.

    Only rows of the bucket that the k-th row falls into are ranked; lower
    buckets are taken by a filter, so the other rows are never sorted or moved.
    """
    by = _cols(by)
    x = df.withColumn("_u", uniform(F.col(key), seed=seed)).withColumn("_b", hash_bucket(F.col("_u")))
    hist = x.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(*by).orderBy("_b")
    hist = hist.withColumn("_end", F.sum("_c").over(upto)).withColumn(
        "_k", F.bround(F.lit(float(frac)) * F.sum("_c").over(Window.partitionBy(*by)), 0))
    # one row per stratum: its bucket that holds the k-th row, and the rows still wanted there
    edge = hist.where((F.col("_end") >= F.col("_k")) & (F.col("_end") - F.col("_c") < F.col("_k"))).select(
        *[F.col(c).alias(f"_by_{c}") for c in by], F.col("_b").alias("_edge"), (F.col("_k") - F.col("_end") + F.col("_c")).alias("_left"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    # one row per stratum: broadcast, so that no plan pairs all rows with all strata
    x = x.join(F.broadcast(edge), same & (F.col("_b") <= F.col("_edge")))
    inside = Window.partitionBy(*by).orderBy("_u", key)
    ranked = x.where(F.col("_b") == F.col("_edge")).withColumn("_r", F.row_number().over(inside)).where(F.col("_r") <= F.col("_left"))
    return x.where(F.col("_b") < F.col("_edge")).unionByName(ranked.drop("_r")).select(*df.columns)


def row_sample(df: DataFrame, frac: float, key: str = "rid", seed: int = RANDOM_SEED) -> DataFrame:
    """``frac`` of the rows without replacement; frac >= 1 keeps all rows."""
    if frac >= 1.0:
        return df
    return take_fraction(df, frac, key, (), seed)


def stratified_split(cohort: DataFrame, label: str, val_frac: float, seed: int = RANDOM_SEED,
                     key: str = "pid") -> tuple[DataFrame, DataFrame]:
    """R2: patient-level stratified (train, validation) split.

    Per patient the max-label row (A3); inside each label value
    ``round(val_frac * n)`` patients go to validation, all their rows with
    them.  Patients whose labels are all NULL stay in train.  ``val_frac == 0``
    returns the whole cohort as both sets.
    """
    if val_frac == 0:
        return cohort, cohort
    per_patient = cohort.where(F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias("_lab"))
    val_patients = take_fraction(per_patient, val_frac, key, "_lab", seed).select(key)
    val = cohort.join(val_patients, key, "left_semi")
    train = cohort.join(val_patients, key, "left_anti")
    return train, val


def split_column(cohort: DataFrame, label: str, val_frac: float, seed: int = RANDOM_SEED,
                 key: str = "pid", out: str = "split") -> DataFrame:
    """R2 as one frame: every row tagged 'train' or 'val' (single pass, no union)."""
    per_patient = cohort.where(F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias("_lab"))
    val_patients = take_fraction(per_patient, val_frac, key, "_lab", seed).select(key, F.lit("val").alias(out))
    return cohort.join(val_patients, key, "left").withColumn(out, F.coalesce(F.col(out), F.lit("train")))
