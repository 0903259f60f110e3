"""Partition invariance: same rows with 1 and 8 shuffle partitions."""

import pytest

from conftest import SF_SMALL

import __spark_entry__ as E

NAMES = ["cohort_first_non_null", "latest_scan", "study_year", "stratified_split", "row_sample", "bootstrap_auc",
         "bootstrap_exact", "auc_many_scores", "seq_image_text", "in_batch_contrastive", "impute_chained",
         "hash_embed", "importance_top"]


def _rows(spark, name, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = E.queries()[name](spark, SF_SMALL)
        return sorted(tuple(None if v is None else (round(v, 6) if isinstance(v, float) else v) for v in r)
                      for r in df.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("name", NAMES)
def test_same_result_with_1_and_8_partitions(spark, name):
    a, b = _rows(spark, name, 1), _rows(spark, name, 8)
    assert a == b
