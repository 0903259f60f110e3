"""Helpers shared by the training-data operators."""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortlens.session import checkpoint_dir, ship_library

#: Words of op1, op3 and op4: runs of ASCII letters and digits and of anything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of op7 and op9: runs of anything but ASCII white space.
BLANK_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_library(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pin_splits(spark: SparkSession) -> None:
    """Keep the split of file scans as it is for the rest of the session.

    Spark derives the split of smaller tables from the cores of the moment;
    operators that number the rows of a table in several scans need the same
    split after an executor has come or gone.
    """
    key = "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(max(1, spark.sparkContext.defaultParallelism)))


@contextmanager
def small_batches(spark: SparkSession, rows: int, size: int) -> Iterator[None]:
    """Python steps that run inside take about so many rows or bytes at once, unless the session has limits of its own.

    By default it is 10,000 rows or 64 MB, which the executor holds outside of
    its heap (twice while a column grows) and the Python worker again.
    """
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    ours = [key for key in limits if spark.conf.get(key, None) is None]
    try:
        for key in ours:
            spark.conf.set(key, str(limits[key]))
        yield
    finally:
        for key in ours:
            spark.conf.unset(key)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    Cuts the lineage in compressed, columnar form; survives lost executors.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def words(col: Column, pattern: str = WORD) -> Column:
    """Array of the words of a text, A-Z lower-cased; null gives an empty array."""
    return F.regexp_extract_all(lower_ascii(F.coalesce(col, F.lit(""))), F.lit(pattern), F.lit(0))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have (case-insensitive)."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = "_" + name
    return name


def hot_salt(*cols: Column, n: int = 64) -> Column:
    """Salt in 0..n-1 from the row's own identifiers."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")
