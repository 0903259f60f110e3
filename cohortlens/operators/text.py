"""Text items for the encoder (T2-T5; the dataset side of L1).

Output rows are ``(pid, scandate, text)`` -- or ``(pid, scandate, class,
text)`` for class prompts -- with ``scandate`` rendered ``yyyyMMdd``.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import text as T
from cohortlens.functions.dates import format_date
from cohortlens.operators.cohort import NLST, CohortSpec, argmax_rows


def _rows(df: DataFrame, spec: CohortSpec, scan_level: bool) -> tuple[DataFrame, list[str]]:
    """Scan-level rows with scan variables, or the latest scan per patient (A3)."""
    if scan_level:
        return df, spec.variables + list(spec.scan)
    return argmax_rows(df, "pid", "scanorder"), spec.variables


def _with_outcome(text: Column, columns: Sequence[str], label: str) -> Column:
    """Clinical sentences and the outcome sentence."""
    fup = F.col("lc_fup_days") if "lc_fup_days" in columns else None
    sub = F.col("lc_subtype") if "lc_subtype" in columns else None
    # no leading space when no variable sentence exists
    return F.trim(F.concat_ws(" ", text, T.outcome_text(F.col(label), fup, sub)))


def _json(rows: DataFrame, names: Sequence[str]) -> Column:
    types = dict(rows.dtypes)
    missing = [c for c in names if c not in types]
    if missing:
        raise ValueError(f"columns that the JSON asks for are missing: {missing}")
    return T.json_text([(c, types[c]) for c in names])


def variant_items(df: DataFrame, spec: CohortSpec = NLST, variants: Sequence[str] = ("plain", "label", "json"),
                  scan_level: bool = False, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """T2, T3 and T5 in one pass: (pid, scandate, variant, text) of every row and variant.

    The rows (a patient's latest scan, or all scans) are found once, whatever
    the number of variants; ``keep`` may store them for several passes.
    """
    rows, variables = _rows(df, spec, scan_level)
    texts = {
        "plain": lambda: T.clinical_text(variables),
        "label": lambda: _with_outcome(T.clinical_text(variables), rows.columns, "lung_cancer"),
        "json": lambda: _json(rows, variables),
        "json_label": lambda: _json(rows, variables + list(spec.labelset)),
    }
    unknown = [v for v in variants if v not in texts]
    if unknown:
        raise ValueError(unknown[0])
    text = F
    for v in dict.fromkeys(variants):
        text = text.when(F.col("variant") == v, texts[v]())
    items = keep(rows).withColumn("variant", F.explode(F.array(*[F.lit(v) for v in variants])))
    return items.select("pid", format_date("scandate", "%Y%m%d").alias("scandate"), "variant", text.alias("text"))


def clinical_items(df: DataFrame, spec: CohortSpec = NLST, scan_level: bool = False, include_label: bool = False,
                   label: str = "lung_cancer", date_format: str = "%Y%m%d",
                   formatters: dict | None = None, invert_smo_status: bool = False) -> DataFrame:
    """T2 (+ T3 when ``include_label``): one text per patient (or scan).

    ``invert_smo_status`` reads smo_status with the opposite coding (1 = former),
    for tables that follow the data dictionary rather than the templates (Q12).
    """
    if invert_smo_status:
        base = T.FORMATTERS["smo_status"]
        formatters = {**(formatters or {}), "smo_status": lambda x: base(F.when(x.isNotNull(), 1 - x))}
    rows, variables = _rows(df, spec, scan_level)
    text = T.clinical_text(variables, formatters)
    if include_label:
        text = _with_outcome(text, rows.columns, label)
    return rows.select("pid", format_date("scandate", date_format).alias("scandate"), text.alias("text"))


def class_items(df: DataFrame, spec: CohortSpec = NLST, classes: Sequence[int] = (0, 1),
                date_format: str = "%Y%m%d") -> DataFrame:
    """T4: per patient, one prompt per class: clinical sentences + that class's outcome sentence."""
    rows, variables = _rows(df, spec, False)
    base = rows.select("pid", format_date("scandate", date_format).alias("scandate"),
                       T.clinical_text(variables).alias("_base"))
    cls = base.withColumn("class", F.explode(F.array(*[F.lit(int(c)) for c in classes])))
    return cls.select("pid", "scandate", "class",
                      F.concat_ws(" ", F.when(F.col("_base") != "", F.col("_base")),
                                  T.class_sentence(F.col("class"))).alias("text"))


def json_items(df: DataFrame, spec: CohortSpec = NLST, scan_level: bool = False, include_label: bool = False,
               date_format: str = "%Y%m%d") -> DataFrame:
    """T5: the row's variables (and labels) as JSON with readable keys."""
    rows, variables = _rows(df, spec, scan_level)
    names = variables + (list(spec.labelset) if include_label else [])
    text = _json(rows, names)
    return rows.select("pid", format_date("scandate", date_format).alias("scandate"), text.alias("text"))
