"""Lenient date parsing and formatting."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# strftime -> Java pattern letters understood by date_format / try_to_date
_STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%j": "DDD", "%a": "EEE"}

# accepted input layouts, tried in order (full date before bare year: a bare
# 'yyyy' pattern would otherwise swallow '19990315' as a year)
DATE_LAYOUTS = ("yyyyMMdd", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss",
                "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy/MM/dd", "MM/dd/yyyy", "d MMM yyyy", "yyyy-MM", "yyyy")


def java_pattern(fmt: str) -> str:
    """Java pattern of a strftime format; plain text is quoted, an unknown code raises."""
    out = []
    for part in re.findall(r"%.|[^%]+|%$", fmt):
        if part == "%%":
            out.append("%")
        elif part.startswith("%"):
            if part not in _STRFTIME:
                raise ValueError(f"unknown date code {part!r} in {fmt!r}")
            out.append(_STRFTIME[part])
        else:
            out.append(re.sub(r"[A-Za-z]+", lambda m: f"'{m[0]}'", part.replace("'", "''")))
    return "".join(out)


def parse_date(c) -> Column:
    """String, number or date -> DATE; unparsable -> NULL (never raises).

    Numbers are read through their integer text (19990315 -> '19990315').
    """
    col = F.col(c) if isinstance(c, str) else c
    text = F.trim(col.cast("string"))
    # numeric input such as 19990315.0 is read through its integer text
    num = text.try_cast("double")
    text = F.when(num.isNotNull() & (F.floor(num) == num),
                  F.floor(num).cast("bigint").cast("string")).otherwise(text)
    return F.coalesce(*[F.try_to_date(text, p) for p in DATE_LAYOUTS])


def format_date(c, fmt: str = "%Y%m%d") -> Column:
    """Parse leniently, then format with a strftime pattern; NULL stays NULL."""
    col = F.col(c) if isinstance(c, str) else c
    return F.date_format(parse_date(col), java_pattern(fmt))


def year_text(c) -> Column:
    """D3: date -> 'yyyy'."""
    return format_date(c, "%Y")


def minus_days(d, days) -> Column:
    """Date minus an integer number of days (NULL safe)."""
    d = F.col(d) if isinstance(d, str) else d
    days = F.col(days) if isinstance(days, str) else days
    return F.date_sub(d, days.cast("int"))


def days_between(later, earlier) -> Column:
    """Whole days between two dates, NULL if either is NULL."""
    later = F.col(later) if isinstance(later, str) else later
    earlier = F.col(earlier) if isinstance(earlier, str) else earlier
    return F.date_diff(later, earlier)


def date_text(c, fmt: str = "%Y%m%d") -> Column:
    """Format a DATE/TIMESTAMP column (no parsing) with a strftime pattern."""
    col = F.col(c) if isinstance(c, str) else c
    return F.date_format(col, java_pattern(fmt))


def as_date(df, name: str) -> Column:
    """D1 for a named column, by schema type: dates pass through, timestamps
    are truncated, text and numbers go through the lenient parser."""
    from pyspark.sql import types as T
    t = df.schema[name].dataType
    if isinstance(t, T.DateType):
        return F.col(name)
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return F.col(name).cast("date")
    return parse_date(name)
