"""Longitudinal sequence assembly (W2, W3, W5, J7-J9, S5, SEQ-A..SEQ-D, M1, M2, R0).

Per patient: the latest ``slen`` scans (newest first), their vectors, a
padding mask, days before the newest scan, a label and an optional second
modality (text vector, class-vector stack or clinical row).

Plan: rank-limit per patient first (Catalyst inserts a WindowGroupLimit on
both sides of the exchange, so a patient with millions of scans ships at most
``slen`` rows per map partition), then join the vectors (late
materialisation: only kept scans are looked up), then one ``groupBy(pid)``
collects at most ``slen`` structs per patient.  Missing vectors fail the
task in strict mode (``raise_error`` inside the plan, no extra job).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.dates import as_date, date_text

# fixed values: global image-feature statistics used for z-scoring
IMAGE_MEAN = 0.26725134
IMAGE_STD = 0.7492173

NO_LABEL_PHASES = ("pretrain", "predict")


def latest_k(scans: DataFrame, slen: int, order: str = "scanorder", tiebreak: str = "rid",
             by: str = "pid", pos: str = "pos") -> DataFrame:
    """Newest ``slen`` rows per patient with 0-based position (ties by ``tiebreak``)."""
    w = Window.partitionBy(by).orderBy(F.col(order).desc(), F.col(tiebreak).asc())
    # filter on the bare row_number so Catalyst infers a WindowGroupLimit
    # (partial top-k before the shuffle: a hot patient ships <= slen rows per task)
    ranked = scans.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= slen)
    return ranked.withColumn(pos, (F.col("_rn") - 1).cast("int")).drop("_rn")


def zscore_vec(v: Column, mean: float = IMAGE_MEAN, std: float = IMAGE_STD) -> Column:
    """M1: scalar z-score of every element, kept as float."""
    return F.transform(v, lambda x: ((x - F.lit(mean)) / F.lit(std)).cast("float"))


def broadcast_scalar(v: Column, scalar: Column) -> Column:
    """[scalar] * size(v): lets a per-row scalar enter a lambda through ``zip_with``.

    An outer expression referenced inside a lambda is re-evaluated for every
    element (quadratic in the vector length); passed as a second array it is
    evaluated once per row.
    """
    return F.array_repeat(scalar, F.size(v))


def l2_normalize(v: Column) -> Column:
    """V4: x / ||x||; the elements of a zero vector, which has no direction, are NULL."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.zip_with(v, broadcast_scalar(v, norm), lambda x, n: F.try_divide(x, n))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two equal-length numeric arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda acc, x: acc + x)


def strict_lookup(vec: Column, what: str) -> Column:
    """J7-J9 strict mode: a missing vector fails the job (the reference raises on a missing file)."""
    return F.when(vec.isNull(), F.raise_error(F.lit(f"missing {what} vector"))).otherwise(vec)


def class_stack(class_vectors: DataFrame, classes: Sequence[int] = (0, 1)) -> DataFrame:
    """(pid, class, vec) -> (pid, expr = [vec_class0, vec_class1, ...]) ordered by class."""
    cv = class_vectors.where(F.col("class").isin(list(classes)))
    g = cv.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("class", "vec"))).alias("_cv"))
    seen = F.size(F.array_distinct(F.transform("_cv", lambda s: s["class"])))
    # a missing class leaves no stack (strict lookups then fail); a repeated one is an error of its own
    g = g.withColumn("_cv", F.when(F.size("_cv") > seen, F.raise_error(F.concat(F.lit("repeated class vector of "), F.col("pid").cast("string"))))
                     .when(seen == len(classes), F.col("_cv")))
    return g.select("pid", F.transform("_cv", lambda s: s["vec"]).alias("expr"))


def assemble(scans: DataFrame, scan_vectors: DataFrame, slen: int = 3, date_col: str = "scandate",
             key_date_col: str = "scandate", key_format: str = "%Y%m%d", label: str = "lung_cancer",
             phase: str = "test", zscore: bool = False, normalize_padding: bool = True,
             keep: Sequence[str] = (), strict: bool = True, path_col: str | None = None) -> DataFrame:
    """Core of SEQ-A..D: (pid, times, padding, img, label, *keep-of-newest-row).

    ``date_col`` gives the day offsets (W3), ``key_date_col`` + ``key_format``
    build the vector key (T1/J7).  ``zscore`` applies M1 to the padded matrix
    (padding included unless ``normalize_padding=False``, Q18).
    ``strict=False`` leaves out scans without a vector (and leaves missing text
    or class vectors NULL) instead of failing.
    ``path_col`` switches J7 to S6: vectors are matched on the location held in
    that column of the scan table (``scan_vectors`` then needs a ``path``).
    """
    top = latest_k(scans, slen)
    top = top.withColumn("_day", as_date(top, date_col))
    if path_col is None:
        top = top.withColumn("scan_key", date_text(as_date(top, key_date_col), key_format))
        vecs = scan_vectors.select("pid", "scan_key", F.col("vec").alias("_vec"))
        j = top.join(vecs, ["pid", "scan_key"], "left")
    else:
        vecs = scan_vectors.select(F.regexp_replace("path", "^file:", "").alias("_path"), F.col("vec").alias("_vec"))
        j = top.join(vecs, F.regexp_replace(F.col(path_col), "^file:", "") == F.col("_path"), "left").drop("_path")
    vec = strict_lookup(F.col("_vec"), "scan") if strict else F.col("_vec")
    if not strict:
        j = j.where(F.col("_vec").isNotNull())
    item = F.struct(F.col("pos"), vec.alias("vec"), F.col("_day").alias("day"),
                    F.col(label).alias("label") if label in top.columns else F.lit(None).alias("label"),
                    *[F.col(k) for k in keep])
    g = j.groupBy("pid").agg(F.array_sort(F.collect_list(item)).alias("_items"))
    # two vectors for one scan would push an older scan out of the sequence
    seen = F.size(F.array_distinct(F.transform("_items", lambda x: x["pos"])))
    g = g.withColumn("_items", F.when(F.size("_items") > seen, F.raise_error(
        F.concat(F.lit("several scan vectors for one scan of "), F.col("pid").cast("string")))).otherwise(F.col("_items")))
    n = F.size("_items")
    idx = F.sequence(F.lit(0), F.lit(slen - 1))
    first = F.col("_items")[0]
    zero = F.array_repeat(F.lit(0.0).cast("float"), F.size(first["vec"]))
    times = F.transform(idx, lambda i: F.when(i < n, F.date_diff(first["day"], F.col("_items")[i]["day"]))
                        .otherwise(0).cast("float"))
    padding = F.transform(idx, lambda i: F.when(i < n, F.lit(1.0)).otherwise(F.lit(0.0)).cast("float"))
    img = F.transform(idx, lambda i: F.when(i < n, F.col("_items")[i]["vec"].cast("array<float>")).otherwise(zero))
    if zscore:
        if normalize_padding:
            img = F.transform(img, lambda r: zscore_vec(r))
        else:
            img = F.transform(idx, lambda i: F.when(i < n, zscore_vec(F.col("_items")[i]["vec"])).otherwise(zero))
    lab = F.lit(0).cast("bigint") if phase in NO_LABEL_PHASES else F.coalesce(first["label"].cast("bigint"), F.lit(0).cast("bigint"))
    return g.select("pid", times.alias("times"), padding.alias("padding"), img.alias("img"), lab.alias("label"),
                    *[first[k].alias(k) for k in keep])


def image_text_sequences(scans: DataFrame, scan_vectors: DataFrame, text_vectors: DataFrame, slen: int = 3,
                         variant: str = "plain", date_col: str = "scandate", text_path_col: str | None = None, **kw) -> DataFrame:
    """SEQ-A: raw vectors, days from ``date_col``, text vector of the patient as a (1, d) matrix.

    With ``text_path_col`` (S6) the text vector is the one at the location that
    the oldest scan of the sequence names (``text_vectors`` then needs a ``path``).
    """
    seq = assemble(scans, scan_vectors, slen, date_col=date_col, **kw)
    strict = kw.get("strict", True)
    if text_path_col is None:
        tv = text_vectors.where(F.col("variant") == variant).select("pid", F.col("vec").alias("_t"))
        out = seq.join(tv, "pid", "left")
    else:
        last = latest_k(scans, slen).groupBy("pid").agg(F.max_by(text_path_col, "pos").alias("_path"))
        tv = text_vectors.select(F.regexp_replace("path", "^file:", "").alias("_path"), F.col("vec").alias("_t"))
        out = seq.join(last.withColumn("_path", F.regexp_replace("_path", "^file:", "")), "pid", "left").join(tv, "_path", "left").drop("_path")
    return out.withColumn("expr", F.when(F.lit(strict) | F.col("_t").isNotNull(), F.array(
        (strict_lookup(F.col("_t"), "text") if strict else F.col("_t")).cast("array<float>")))).drop("_t")


def zeroshot_sequences(scans: DataFrame, scan_vectors: DataFrame, class_vectors: DataFrame, slen: int = 3,
                       classes: Sequence[int] = (0, 1), **kw) -> DataFrame:
    """SEQ-C: as SEQ-A with the (classes, d) stack of class vectors."""
    seq = assemble(scans, scan_vectors, slen, **kw)
    cs = class_stack(class_vectors, classes).withColumnRenamed("expr", "_e")
    out = seq.join(cs, "pid", "left")
    stack = strict_lookup(F.col("_e"), "class") if kw.get("strict", True) else F.col("_e")
    return out.withColumn("expr", stack.cast("array<array<float>>")).drop("_e")


def channel_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A5: one row with mean_<c> and std_<c> (sample, ddof=1), NULLs skipped."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"std_{c}")]
    return df.agg(*aggs)


def zscore_columns(df: DataFrame, cols: Sequence[str], stats: DataFrame | None = None) -> DataFrame:
    """M2: per-channel z-score with statistics of ``stats`` (default: ``df`` itself).

    The one-row statistics frame is attached with a broadcast join on a
    constant key (its size is fixed: one row).  A constant column, which has
    no z-score, becomes NULL.
    """
    stats = channel_stats(stats if stats is not None else df, cols)
    s = stats.withColumn("_k", F.lit(0))
    out = df.withColumn("_k", F.lit(0)).join(F.broadcast(s), "_k")
    for c in cols:
        out = out.withColumn(c, F.try_divide(F.col(c) - F.col(f"mean_{c}"), F.col(f"std_{c}")))
    return out.drop("_k", *[f"mean_{c}" for c in cols], *[f"std_{c}" for c in cols])


def image_tabular_sequences(scans: DataFrame, scan_vectors: DataFrame, scalar: Sequence[str],
                            categorical: Sequence[str], slen: int = 3, date_col: str = "shifted_scandate",
                            **kw) -> DataFrame:
    """SEQ-B: z-scored vectors; clinical row of the newest scan = z-scored scalars (stats over all rows
    of ``scans``) then raw categoricals, as a (1, d) float matrix; days from ``shifted_scandate``."""
    z = zscore_columns(scans, scalar)
    seq = assemble(z, scan_vectors, slen, date_col=date_col, zscore=True, keep=list(scalar) + list(categorical), **kw)
    row = F.array(*[F.col(c).cast("float") for c in list(scalar) + list(categorical)])
    return seq.withColumn("expr", F.array(row)).drop(*scalar, *categorical)


def image_sequences(scans: DataFrame, scan_vectors: DataFrame, slen: int = 3, date_col: str = "shifted_scandate",
                    **kw) -> DataFrame:
    """SEQ-D: z-scored vectors only, days from ``shifted_scandate``."""
    return assemble(scans, scan_vectors, slen, date_col=date_col, zscore=True, **kw)


def explode_sequences(seq: DataFrame) -> DataFrame:
    """Long form (pid, part, pos, dim, value, time, padding, label) for checks and exports.

    One pipeline over ``seq`` (a row per part, then two posexplodes), so the
    assembly is computed once.
    """
    parts = ["img"] + (["expr"] if "expr" in seq.columns else [])
    x = seq.withColumn("part", F.explode(F.array(*[F.lit(p) for p in parts])))
    nul = F.lit(None).cast("array<float>")
    mat = F.col("img") if len(parts) == 1 else F.when(F.col("part") == "img", F.col("img")).otherwise(F.col("expr"))
    x = x.select("pid", "label", "part", mat.alias("_m"),
                 F.when(F.col("part") == "img", F.col("times")).otherwise(nul).alias("_t"),
                 F.when(F.col("part") == "img", F.col("padding")).otherwise(nul).alias("_p"))
    x = x.select("pid", "label", "part", "_t", "_p", F.posexplode("_m").alias("pos", "_row"))
    x = x.select("pid", "label", "part", "pos", F.col("_t")[F.col("pos")].alias("time"),
                 F.col("_p")[F.col("pos")].alias("padding"), F.posexplode("_row").alias("dim", "value"))
    return x


def latest_label(df: DataFrame, label: str, null_label: str = "zero", phase: str = "test",
                 order: str = "scanorder", tiebreak: str = "rid") -> DataFrame:
    """Per patient the label of the newest scan; 0 in pretrain/predict phases.

    ``null_label``: 'zero' (NULL -> 0, the reference behaviour), 'drop' (remove
    such patients) or 'keep' (leave NULL).  Arg-max by aggregation, no sort.
    """
    ordering = F.struct(F.col(order).alias("_o"), (-F.col(tiebreak)).alias("_t"))
    g = df.where(F.col(order).isNotNull()).groupBy("pid").agg(F.max_by(F.col(label), ordering).alias("label"))
    if phase in NO_LABEL_PHASES:
        return g.withColumn("label", F.lit(0).cast("bigint"))
    if null_label == "zero":
        return g.withColumn("label", F.coalesce(F.col("label").cast("bigint"), F.lit(0).cast("bigint")))
    if null_label == "drop":
        return g.where(F.col("label").isNotNull()).withColumn("label", F.col("label").cast("bigint"))
    return g.withColumn("label", F.col("label").cast("bigint"))


def class_count(df: DataFrame, label: str) -> DataFrame:
    """Number of label classes; ``n_classes_with_null`` counts NULL as a class (reference behaviour)."""
    return df.agg(F.count_distinct(label).alias("n_classes"),
                  (F.count_distinct(label) + F.max(F.col(label).isNull().cast("int"))).alias("n_classes_with_null"))
