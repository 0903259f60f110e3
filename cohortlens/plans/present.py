"""Stable output types for cross-engine comparison.

Doubles are rounded to 6 places (signed zero normalised), integer types
widened to bigint, dates and timestamps rendered as ISO text, booleans as 0/1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6


def present(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
            # "+ 0.0" turns a rounded -0.0 into 0.0 (IEEE), so both zeros print alike
            c = F.round(c.cast("double"), DIGITS) + F.lit(0.0)
        elif isinstance(t, (T.IntegerType, T.ShortType, T.ByteType, T.LongType)):
            c = c.cast("bigint")
        elif isinstance(t, T.BooleanType):
            c = c.cast("int").cast("bigint")
        elif isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        cols.append(c.alias(f.name))
    return df.select(*cols)
