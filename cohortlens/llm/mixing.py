"""op7: mixing sources to target weights by entropy balancing.

Targets come from water filling.  For every source, the document rates that
meet its target at the least relative entropy are an exponential tilt of the
document's size, cut at the most copies allowed: rate = min(cap, exp(lambda x)).
Lambda solves the convex dual by Newton steps, all sources at once, each step
one aggregation.  As the rate depends on source and size only, the steps run on
the (source, size) histogram, which is exact.  Rates become whole copies by
systematic rounding along the sizes, and the rest of a source's target is then
met by single copies of ever smaller documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from cohortlens.llm.common import BLANK_WORD, cut, free_name

#: Rows that a task ranks together at most, about.
RANK_ROWS = 1_000


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """sid (1..), source, source_size, n, target from columns source, size, n.

    Sources by code point, null last, take ``weights`` in turn and share the
    sum of all sizes; no target exceeds ``cap`` times the source's size, and
    the excess is shared again by weight.  One row per source; the ranking of
    sources is the only global window, over these rows.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n"),
                                      F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    sid = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("sid", sid)
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("most") / F.col("w"))
    by = Window.orderBy("ratio", "sid")
    total = F.sum("source_size").over(Window.partitionBy())
    filled = F.coalesce(F.sum("most").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (total - filled) / rest)
    per = per.withColumn("free", F.col("ratio") > F.col("level"))
    level = F.min(F.when(F.col("free"), F.struct("ratio", "sid", "level"))).over(Window.partitionBy())["level"]
    return per.select("sid", "source", "source_size", "n", "least",
                      F.when(F.col("free"), F.col("w") * level).otherwise(F.col("most")).alias("target"))


def tilt(hist: DataFrame, sources: DataFrame, cap: float = 3.0, tolerance: float = 1e-10, most_steps: int = 60) -> DataFrame:
    """sid, mean, lam: the dual solution of every source (Newton, kept inside a bracket that holds the root).

    ``hist``: sid, size, n. A source at its cap, without words or without a
    target needs no steps.
    """
    mean = F.col("source_size") / F.col("n")
    open_ = (F.col("source_size") > 0) & (F.col("target") > 0) & (F.col("target") < F.col("source_size") * cap)
    bound = mean / F.col("least")
    share = F.col("target") / F.col("source_size")
    state = sources.where(open_).select(
        "sid", "target", mean.alias("mean"), F.lit(0.0).alias("lam"),
        F.least(F.lit(0.0), F.log(share) * bound).alias("lo"),
        F.when(share > 1, F.log(F.lit(cap)) * bound).otherwise(0.0).alias("hi"), F.lit(float("inf")).alias("gap"))
    state, steps = cut(state, "tilt"), 0
    while steps < most_steps:
        for _ in range(4):
            x = F.col("size") / F.col("mean")
            free = F.exp(F.least(F.col("lam") * x, F.lit(700.0)))
            tokens = F.col("n") * F.col("size")
            sums = hist.join(state, "sid").groupBy("sid").agg(
                *[F.first(c).alias(c) for c in ("target", "mean", "lam", "lo", "hi")],
                F.sum(tokens * F.least(free, F.lit(cap))).alias("g"),
                F.sum(F.when(free < cap, tokens * x * free).otherwise(0.0)).alias("slope"))
            more = F.col("g") < F.col("target")
            sums = sums.withColumn("lo", F.when(more, F.col("lam")).otherwise(F.col("lo"))).withColumn(
                "hi", F.when(more, F.col("hi")).otherwise(F.col("lam")))
            newton = F.col("lam") + (F.col("target") - F.col("g")) / F.nullif(F.col("slope"), F.lit(0.0))
            middle = (F.col("lo") + F.col("hi")) / 2
            state = sums.select("sid", "target", "mean",
                                F.when((newton > F.col("lo")) & (newton < F.col("hi")), newton)
                                .when(F.col("g") == F.col("target"), F.col("lam")).otherwise(middle).alias("lam"),
                                "lo", "hi", (F.abs(F.col("g") - F.col("target")) / F.col("target")).alias("gap"))
            steps += 1
        state = cut(state, "tilt")
        if (state.agg(F.max("gap")).first()[0] or 0.0) <= tolerance:
            break
    return state.select("sid", "mean", "lam")


def cell_copies(hist: DataFrame, sources: DataFrame, duals: DataFrame, cap: int = 3, passes: int = 8) -> DataFrame:
    """sid, size, n, copies: whole copies that each cell (source, size) takes in total, between 0 and cap * n."""
    cells = hist.join(sources.select("sid", "source_size", "target"), "sid").join(duals, "sid", "left")
    rate = (F.when(F.col("lam").isNotNull(), F.least(F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(700.0))), F.lit(float(cap))))
            .when(F.col("target") > 0, F.lit(float(cap))).when(F.col("source_size") > 0, F.lit(0.0)).otherwise(1.0))
    down = Window.partitionBy("sid").orderBy(F.col("size").desc())
    cells = cells.withColumn("upto", F.sum(F.col("n") * rate).over(down) + 0.5)
    cells = cells.withColumn("copies", F.floor("upto") - F.coalesce(F.lag(F.floor("upto")).over(down), F.lit(0)))
    cells = cells.withColumn("copies", F.least(F.greatest(F.col("copies"), F.lit(0)), F.col("n") * cap))
    whole, before = Window.partitionBy("sid"), down.rowsBetween(Window.unboundedPreceding, -1)
    for _ in range(passes):
        # what is left is less than the size of the cell that ends the pass, so at least halved
        cells = cells.withColumn("left", F.col("target") - F.sum(F.col("copies") * F.col("size")).over(whole))
        room = F.when(F.col("left") > 0, F.col("n") * cap - F.col("copies")).otherwise(F.col("copies"))
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("left"))
        cells = cells.withColumn("room", F.when(fits, room).otherwise(0))
        spare = F.abs("left") - F.coalesce(F.sum(F.col("room") * F.col("size")).over(before), F.lit(0))
        cells = cells.withColumn("spare", spare)
        step = F.when((F.col("room") > 0) & (F.col("spare") > 0), F.least(F.col("room"), F.floor(F.col("spare") / F.col("size")))).otherwise(0)
        cells = cells.withColumn("copies", F.col("copies") + F.when(F.col("left") > 0, step).otherwise(-step))
    return cells.select("sid", "size", "n", "copies")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: int = 3, seed: int = 7, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Whole copies per document so that sources meet their targets.

    Returns rid (the row's number in ``docs``), id, source, size (words), source_size, target (of the source),
    copies (0 to ``cap``), taken (copies * size).  Null or blank texts have
    size 0 and one copy, which takes no words; a null source is a source of
    its own, the last; documents of equal source and size differ in copies
    by a hash of their id, then by their place in the input, so reruns on the
    same table agree; a table without words has targets of 0.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = cut(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                           F.size(F.regexp_extract_all(text, F.lit(BLANK_WORD), F.lit(0))).cast("long").alias("size")), "sizes")
    raw = cut(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    sources = cut(source_targets(raw, weights, cap), "targets")
    names = sources.select("sid", F.col("source").alias("name"))
    hist = cut(raw.join(names, F.col("source").eqNullSafe(F.col("name"))).select("sid", "size", "n"), "cells")
    cells = cell_copies(hist, sources, tilt(hist, sources, float(cap)), cap)
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / RANK_ROWS))
    cells = cut(cells.withColumn("parts", parts).join(
        sources.select("sid", F.col("source").alias("name"), "source_size", "target"), "sid"), "copies")
    at = rows.join(cells.withColumnRenamed("size", "cell"), F.col("source").eqNullSafe(F.col("name")) & (F.col("size") == F.col("cell")))
    order = F.xxhash64(F.lit(seed), "id", F.when(F.col("id").isNull(), F.col("rid")))
    # rank inside the cell in two steps: count by hash range, then rank inside the range
    at = at.select("rid", "id", "source", "size", "source_size", "target", "sid", "n", "copies", order.alias("order"),
                   F.floor((F.shiftrightunsigned(order, 33) * F.col("parts")) / F.lit(2.0 ** 31)).alias("part"))
    counts = at.groupBy("sid", "size", "part").agg(F.count("*").alias("in_part"))
    earlier = Window.partitionBy("sid", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("sid", "size", "part", F.coalesce(F.sum("in_part").over(earlier), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("sid", "size", "part").orderBy("order", "rid"))
    at = at.withColumn("rank", rank).join(counts, ["sid", "size", "part"])
    extra = (F.col("before") + F.col("rank") <= F.col("copies") % F.col("n")).cast("int")
    copies = F.expr("copies div n") + extra
    return at.select("rid", "id", "source", "size", "source_size", "target", copies.cast("int").alias("copies"),
                     (copies * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: int = 3, text_col: str = "text",
               id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (``cap`` times at most), with their columns as they were.

    Null is a source of its own; null and blank texts weigh nothing; repeated
    rows and null ids are rows like others; names may clash with inner ones; an
    empty table gives no rows.
    """
    rid = free_name(docs, "rid")
    names = docs.columns
    # the row number must not depend on how a later scan is split
    rows = cut(docs.withColumn(rid, F.monotonically_increasing_id()), "numbered")
    plan = mix(rows.select(*names, rid), weights, cap, id_col=rid, text_col=text_col, source_col=source_col)
    plan = plan.where("copies > 0").select(F.col("id").alias(rid), F.col("copies").alias(free_name(rows, "copies")))
    copies = plan.columns[1]
    out = rows.join(plan, rid)
    return out.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*names)
