"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Each query reads the driver's tables through the adapters in
``cohortlens.sources.testdata`` and runs the library operator over the whole
tables.  Outputs go through ``present`` (stable types, 6-digit doubles).
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortlens.plans.present import present
from cohortlens.session import ship_library

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def register(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_library(spark)
            return present(fn(spark, sf_dir))
        wrapped.__name__ = f"q_{name}"
        wrapped.__doc__ = fn.__doc__
        wrapped.raw = fn
        QUERIES[name] = wrapped
        return wrapped
    return deco


def all_queries() -> dict[str, QueryFn]:
    from cohortlens.plans.catalog import metrics, cohort, text, vectors, models  # noqa: F401  (register)
    return dict(QUERIES)
