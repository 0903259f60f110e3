"""Bootstrap of any (weighted) metric as one Spark job.

The reference resamples each group ``n`` times with replacement in a driver
loop.  Here the replicate is a column: row r gets weight
``Poisson(1)^{-1}(u(r, b, seed))`` in replicate b (the standard Poisson
bootstrap), rows with weight 0 are dropped, and every metric is computed with
the replicate as an extra group key.  Weights depend only on the row key, so
results are repeatable and independent of partitioning.  Sums (accuracy, mean)
collapse to (group, replicate) before the shuffle; Python aggregates
(``python_metric``) are updated per Arrow batch and merged in a tree.  AUC
moves each row once, to its range of scores, through which an Arrow task
streams with running sums of all replicates; the few scores that hold a large
share of the rows are summed per replicate on the map side instead.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass
from functools import reduce
from operator import and_
from typing import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cohortlens.functions.hashing import (GOLDEN32, MASK32, MIX32, RANDOM_SEED, hash32, poisson_thresholds,
                                          poisson_weight, stream_uniform)
from cohortlens.operators import metrics as M
from cohortlens.session import ensure_parallelism, materialize

# A metric takes (weighted rows, group columns, weight column) and returns
# a frame (group columns..., value).
MetricFn = Callable[[DataFrame, list, str], DataFrame]


@dataclass(frozen=True)
class Metric:
    name: str
    fn: MetricFn
    # base frame used to fix data-dependent parameters (e.g. AUC buckets)
    prepare: Callable[[DataFrame], "Metric"] | None = None
    # input columns the metric reads (None = all); only these ride through the replicate fan-out
    columns: tuple | None = None
    # (rows, key, group columns, n, seed) -> (group columns..., replicate, value), for metrics that draw
    # the Poisson weights themselves
    replicates: Callable[[DataFrame, str, list, int, int], DataFrame] | None = None
    # numbers that the metric gives: ``value``, or ``value_0``, ``value_1``, ... where there are several
    outputs: int = 1
    # weight column -> aggregate, where the metric is one: such metrics share one aggregation
    agg: Callable[[str], "F.Column"] | None = None


#: Values of a group column that ``group_product`` accepts.
MAX_GROUP_VALUES = 10_000

def row_key(df: DataFrame, key: str) -> DataFrame:
    """``df`` with its key as text; rows without one are told apart by their place."""
    place = F.concat(F.lit("place "), F.monotonically_increasing_id().cast("string"))
    return df.withColumn(key, F.coalesce(F.col(key).cast("string"), place))


def _limits() -> np.ndarray:
    """Poisson thresholds as 32-bit numbers: a draw's weight is the number of limits that its bits reach."""
    limits = [math.ceil(t * 2.0 ** 32) for t in poisson_thresholds()]
    return np.array([t for t in limits if t <= MASK32], np.uint32)


def _draws(h: np.ndarray, replicate: int, limits: np.ndarray) -> np.ndarray:
    """Poisson weights of one replicate, as small unsigned numbers; the same stream as ``stream_uniform`` and ``poisson_weight``."""
    x = h.astype(np.uint32) + np.uint32((replicate * GOLDEN32) & MASK32)
    half, mix = np.uint32(16), np.uint32(MIX32)
    for _ in range(2):
        x ^= x >> half
        x *= mix
    x ^= x >> half
    weight = np.zeros(len(x), np.uint8)
    for limit in limits:
        weight += x >= limit
    return weight


def _codes(batch: pa.RecordBatch, names: Sequence[str]) -> tuple[np.ndarray, list[tuple]]:
    """A number per row for its values in ``names`` (one group without names), and the values of each number."""
    code, keys = np.zeros(batch.num_rows, np.int64), [()]
    for name in names:
        d = batch.column(name).dictionary_encode(null_encoding="encode")
        values = d.dictionary.to_pylist()
        found, code = np.unique(code * len(values) + d.indices.to_numpy(zero_copy_only=False), return_inverse=True)
        keys = [(*keys[f // len(values)], values[f % len(values)]) for f in found.tolist()]
    return code, keys


def _heavy_sums(by: Sequence[str], n: int, schema: pa.Schema):
    """Per batch: replicate sums of every (group, frequent score)."""
    def run(batches):
        limits = _limits()
        for batch in batches:
            code, keys = _codes(batch, [*by, "_s"])
            h, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_h", "_y"))
            h, y = h.astype(np.uint32), y.astype(bool)
            sums = np.zeros((2, n, len(keys)), np.int64)
            for b in range(n):
                w = _draws(h, b, limits)
                sums[0, b] = np.bincount(code, np.where(y, w, 0), len(keys))
                sums[1, b] = np.bincount(code, np.where(y, 0, w), len(keys))
            rows = [{**dict(zip(by, k)), "_s": k[-1], "_pos": sums[0, :, i].tolist(), "_neg": sums[1, :, i].tolist()} for i, k in enumerate(keys)]
            yield pa.RecordBatch.from_pylist(rows, schema)
    return run


class _Running:
    """Sums of one group in one range of scores, for all replicates; the last score's rows stay open."""

    def __init__(self, n: int):
        self.score, self.open = None, np.zeros((2, n))
        self.below, self.pos, self.won = np.zeros(n), np.zeros(n), np.zeros(n)

    def close(self) -> None:
        pos, neg = self.open
        self.won += pos * (self.below + neg / 2)
        self.below, self.pos, self.open = self.below + neg, self.pos + pos, np.zeros_like(self.open)

    def add(self, score: np.ndarray, h: np.ndarray, y: np.ndarray, packed: dict[int, tuple], limits: np.ndarray) -> None:
        """Rows in the order of their scores; ``packed`` rows carry sums of all replicates."""
        if self.score is not None and score[0] != self.score:
            self.close()
        runs = np.flatnonzero(np.append(True, score[1:] != score[:-1]))
        at = np.array(sorted(packed), np.int64)
        sums = np.array([packed[i] for i in at.tolist()]).reshape(len(at), *self.open.shape)
        positive, apart = y.astype(float), len(runs) == len(score)
        for b in range(self.open.shape[1]):
            w = _draws(h, b, limits)
            p = w * positive
            q = w - p
            p[at], q[at] = sums[:, 0, b], sums[:, 1, b]
            if not apart:
                p, q = np.add.reduceat(p, runs), np.add.reduceat(q, runs)
            p[0], q[0] = p[0] + self.open[0, b], q[0] + self.open[1, b]
            self.open[:, b] = p[-1], q[-1]
            if len(p) == 1:
                continue
            p, q = p[:-1], q[:-1]
            below = np.cumsum(q)
            pos, done = p.sum(), below[-1]
            self.won[b] += p @ (below - q / 2) + self.below[b] * pos
            self.below[b] += done
            self.pos[b] += pos
        self.score = score[-1]


def _stream_ranges(by: Sequence[str], n: int, schema: pa.Schema):
    """Rows of one range of scores, sorted by group and score: the range's sums per group and replicate."""
    def run(batches):
        from pyspark import TaskContext
        bucket, limits = TaskContext.get().partitionId(), _limits()
        key, state = None, None

        def sums(key: tuple, state: _Running) -> pa.RecordBatch:
            state.close()
            fixed = {**dict(zip(by, key)), "_bucket": bucket}
            columns = [pa.array([fixed[f.name]] * n, f.type) for f in list(schema)[:len(by) + 1]]
            return pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(n), pa.int32()), *map(pa.array, (state.won, state.pos, state.below))], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            code, keys = _codes(batch, by)
            score = batch.column("_s").to_numpy(zero_copy_only=False)
            h = batch.column("_h").fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint32)
            y = batch.column("_y").fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
            at = np.flatnonzero(batch.column("_pos").value_lengths().to_numpy(zero_copy_only=False))
            packed = {int(i): (batch.column("_pos")[int(i)].as_py(), batch.column("_neg")[int(i)].as_py()) for i in at}
            edges = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(code)]
            for lo, hi in zip(edges, edges[1:]):
                if state is None or keys[code[lo]] != key:
                    if state is not None:
                        yield sums(key, state)
                    key, state = keys[code[lo]], _Running(n)
                state.add(score[lo:hi], h[lo:hi], y[lo:hi], {i - lo: v for i, v in packed.items() if lo <= i < hi}, limits)
        if state is not None:
            yield sums(key, state)
    return run


def auc_replicates(df: DataFrame, key: str, by: Sequence[str], n: int, seed: int, label: str, score: str,
                   buckets="auto") -> DataFrame:
    """AUC of every Poisson replicate: by..., replicate, value (NULL without both classes).

    One row shuffle, whatever ``n``: rows go to ranges of scores, sorted there
    by Spark (which spills), and stream through with running sums, so a task
    holds one Arrow batch and ``n`` sums however many rows its range has.  A
    score with a large share of the rows is summed before the shuffle.
    """
    by = list(by)
    heavy = M.heavy_scores(df, score)
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).select(
        *by, hash32(F.col(key), seed=seed).alias("_h"), (F.col(label) == 1).alias("_y"), F.col(score).cast("double").alias("_s"))
    keys = [rows.schema[c] for c in by]
    sums = [T.StructField("_pos", T.ArrayType(T.LongType())), T.StructField("_neg", T.ArrayType(T.LongType()))]
    # empty lists, not NULL: after a NULL list Spark's Arrow writer goes over all of a batch's rows again, row by row
    none = [F.array().cast(f.dataType).alias(f.name) for f in sums]
    parts = rows.where(~F.col("_s").isin(heavy)).select("*", *none) if heavy else rows.select("*", *none)
    if heavy:
        packed_schema = T.StructType([*keys, rows.schema["_s"], *sums])
        packed = rows.where(F.col("_s").isin(heavy)).mapInArrow(_heavy_sums(by, n, to_arrow_schema(packed_schema)), packed_schema)
        packed = packed.select(*by, "_s", F.posexplode(F.arrays_zip("_pos", "_neg")).alias("replicate", "w")).groupBy(*by, "_s", "replicate").agg(
            F.sum("w._pos").alias("_pos"), F.sum("w._neg").alias("_neg"))
        packed = packed.groupBy(*by, "_s").agg(F.sort_array(F.collect_list(F.struct("replicate", "_pos", "_neg"))).alias("w"))
        packed = packed.select(*by, F.lit(None).cast("bigint").alias("_h"), F.lit(None).cast("boolean").alias("_y"), "_s",
                               F.col("w._pos").alias("_pos"), F.col("w._neg").alias("_neg"))
        parts = parts.unionByName(packed)
    schema = T.StructType([*keys, T.StructField("_bucket", T.IntegerType()), T.StructField("replicate", T.IntegerType()),
                           *[T.StructField(c, T.DoubleType()) for c in ("_num", "_pos", "_neg")]])
    ranges = parts.repartitionByRange(M.range_partitions(df, buckets), "_s").sortWithinPartitions(*by, "_s")
    out = ranges.mapInArrow(_stream_ranges(by, n, to_arrow_schema(schema)), schema)
    return M.auc_from_buckets(out, [*by, "replicate"]).withColumnRenamed("auc", "value")


def auc_metric(label: str = "label", score: str = "prob", buckets="auto") -> Metric:
    return Metric("auc", lambda d, by, w: M.auc(d, label, score, by, w, buckets=buckets).withColumnRenamed("auc", "value"), None,
                  (label, score), lambda d, key, by, n, seed: auc_replicates(d, key, by, n, seed, label, score, buckets))


def _aggregate(name: str, agg: Callable[[str], "F.Column"], columns: tuple | None) -> Metric:
    return Metric(name, lambda d, by, w: d.groupBy(*by).agg(agg(w).alias("value")), None, columns, agg=agg)


def accuracy_metric(label: str = "label", score: str = "prob", threshold: float = 0.5) -> Metric:
    return _aggregate("accuracy", lambda w: M.accuracy(label, score, threshold, w), (label, score))


def mean_metric(col: str) -> Metric:
    return _aggregate("mean", lambda w: F.try_divide(F.sum(F.col(col) * F.col(w)), F.sum(F.when(F.col(col).isNotNull(), F.col(w)))), (col,))


def expression_metric(name: str, agg: Callable[[str], "F.Column"]) -> Metric:
    """Any user aggregate written as ``weight_col -> Column`` (Catalyst side)."""
    return _aggregate(name, agg, None)


#: Rows from which on a group's replicates are summed by all tasks that read it, instead of by one.
LARGE_GROUP = 100_000
#: Rows of all replicates that one task sums of small groups, about: its sums stay in memory.
PART_DRAWS = 4_000_000


def aggregate_replicates(df: DataFrame, metrics: Sequence[Metric], key: str, by: Sequence[str], n: int, seed: int,
                         names: Sequence[str], large_group: int = LARGE_GROUP) -> DataFrame:
    """by..., replicate, ``names``: metrics that are aggregates, all in one aggregation over the replicates.

    A row of a small group moves once, to its group, and has its replicates
    there; the sums need no further shuffle.  A group of ``large_group`` rows
    or more would be one task's work: its replicates are summed where its rows
    are read, which leaves ``n`` sums a task to move.
    """
    by = list(by)
    aggs = [m.agg("weight").alias(name) for m, name in zip(metrics, names)]

    def summed(weighted: DataFrame) -> DataFrame:
        return weighted.groupBy(*by, "replicate").agg(*aggs)

    if not by:
        return summed(replicate_weights(df, key, n, seed))
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= large_group)
    large = sizes.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)])
    some = materialize(large)
    same = [df[c].eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)]
    many = some.count()
    # at most one in ``large_group`` rows is a large group
    small = df.join(F.broadcast(some), reduce(and_, same), "left_anti") if many else df
    tasks = max(M.range_partitions(df), -(-small.count() * n // PART_DRAWS))
    parts = summed(replicate_weights(small, key, n, seed, place=[tasks, *by]))
    if not many:
        return parts
    return parts.unionByName(summed(replicate_weights(df.join(F.broadcast(some), reduce(and_, same), "left_semi"), key, n, seed)))


def replicate_weights(df: DataFrame, key: str, n: int = 100, seed: int = RANDOM_SEED,
                      replicate: str = "replicate", weight: str = "weight", place: Sequence[int | str] = ()) -> DataFrame:
    """Explode rows into n replicates with Poisson(1) weights.

    One md5 of the row key seeds a per-row stream; replicate b takes draw b
    of it (``stream_uniform``), so the per-(row, replicate) cost is a few
    integer operations inside whole-stage codegen.  Zero weights are kept
    (they add nothing to weighted sums) because a filter on the uniform would
    be pushed below the projection and re-evaluate the hash chain.  With
    ``place`` (arguments of ``repartition``) the rows go to partitions by these
    columns first, so that sums by them and the replicate need no shuffle.
    """
    # hash the key once, then drop it: only narrow columns are copied n times
    hashed = df.withColumn("_h", hash32(F.col(key), seed=seed)).drop(key)
    out = ((hashed.repartition(*place) if place else ensure_parallelism(hashed, "_h"))
           .withColumn(replicate, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
           .withColumn("_u", stream_uniform(F.col("_h"), F.col(replicate)))
           .withColumn(weight, poisson_weight(F.col("_u")))
           .drop("_h", "_u"))
    return out


def _rng(seed: int, *parts) -> "np.random.Generator":
    import hashlib
    h = hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()
    return np.random.default_rng([seed, int(h[:8], 16), int(h[8:16], 16)])


#: Children of a node of the block tree, which one split deals a node's draws to.
TREE_FAN = 64


def _split_draws(g: Sequence[str], seed: int, level: int, schema: pa.Schema):
    """Per node: every replicate's draws dealt to the node's children in proportion to their rows."""
    def run(batches):
        for batch in batches:
            rows = []
            for node in batch.to_pylist():
                sizes = np.array([c["_s"] for c in node["_children"]], np.int64)
                rng = _rng(seed, *[node[c] for c in g], level, node["_node"])
                dealt = rng.multinomial(np.array(node["_t"], np.int64), sizes / sizes.sum())
                rows += [{**{c: node[c] for c in g}, "_node": child["_node"], "_t": dealt[:, i].tolist()} for i, child in enumerate(node["_children"])]
            yield pa.RecordBatch.from_pylist(rows, schema)
    return run


def block_draws(blocks: DataFrame, g: Sequence[str], n: int, seed: int, most_blocks: int) -> DataFrame:
    """g..., _blk, _t: draws of all ``n`` replicates per block, a group's total being its number of rows.

    ``blocks``: g..., _blk, _s (rows).  Blocks are the leaves of a tree of
    ``TREE_FAN`` children a node; from the root down, each node deals its draws
    to its children in one vectorised multinomial draw.  A task sees one node's
    children at a time, however many blocks a group has.
    """
    g = list(g)
    levels = [blocks.select(*g, F.col("_blk").cast("long").alias("_node"), "_s")]
    while TREE_FAN ** (len(levels) - 1) < most_blocks:
        up = levels[-1].withColumn("_node", F.floor(F.col("_node") / TREE_FAN))
        levels.append(up.groupBy(*g, "_node").agg(F.sum("_s").alias("_s")))
    # the root of every group draws as many rows as the group has
    draws = levels[-1].select(*g, "_node", F.array_repeat("_s", n).alias("_t"))
    schema = T.StructType([*[blocks.schema[c] for c in g], T.StructField("_node", T.LongType()), T.StructField("_t", T.ArrayType(T.LongType()))])
    for level in range(len(levels) - 2, -1, -1):
        children = (levels[level].withColumn("_up", F.floor(F.col("_node") / TREE_FAN)).groupBy(*g, "_up")
                    .agg(F.sort_array(F.collect_list(F.struct("_node", "_s"))).alias("_children")))
        children = children.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(g)], "_up", "_children")
        same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(g)]
        nodes = draws.join(children, reduce(and_, [*same, F.col("_node") == F.col("_up")])).select(*g, "_node", "_t", "_children")
        draws = nodes.mapInArrow(_split_draws(g, seed, level, to_arrow_schema(schema)), schema)
    return draws.withColumnRenamed("_node", "_blk")


def multinomial_weights(df: DataFrame, key: str, by: Sequence[str], columns: Sequence[str], n: int = 100,
                        seed: int = RANDOM_SEED, block_rows: int = 100_000) -> DataFrame:
    """Exact resampling: each replicate draws exactly n_g rows with replacement per group.

    Never a whole group in one task: rows are hashed into blocks of about
    ``block_rows`` inside their group; ``block_draws`` deals every replicate's
    n_g draws to the blocks; per block one task draws the rows of all
    replicates and returns weighted ``(label, score)`` cells.  A NULL group is
    a group; rows without a key are told apart by their place.
    Output: by..., replicate, columns..., weight (cells with weight 0 omitted).
    """
    by, columns = list(by), list(columns)
    g = by or ["_g"]
    df = row_key(df, key)
    rows = df.select(*by, key, *columns) if by else df.select(F.lit(0).alias("_g"), key, *columns)
    sizes = rows.groupBy(*g).agg(F.count(F.lit(1)).alias("_n"))
    # one row per group: broadcast where they are few, so that a large group is not dealt to one task
    few = sizes.limit(MAX_GROUP_VALUES + 1).count() <= MAX_GROUP_VALUES
    largest = sizes.agg(F.max("_n")).first()[0] or 0
    named = sizes.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(g)], "_n")
    same = [rows[c].eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(g)]
    rows = rows.join(F.broadcast(named) if few else named, reduce(and_, same)).drop(*[f"_g{i}" for i in range(len(g))])
    rows = rows.withColumn("_blk", F.pmod(hash32(F.col(key), seed=seed), F.ceil(F.col("_n") / block_rows)).cast("long")).drop("_n")
    blocks = rows.groupBy(*g, "_blk").agg(F.count(F.lit(1)).alias("_s"))
    draws = block_draws(blocks, g, n, seed, -(-largest // block_rows))
    out_schema = T.StructType([rows.schema[c] for c in g] + [T.StructField("replicate", T.IntegerType())] +
                              [rows.schema[c] for c in columns] + [T.StructField("weight", T.LongType())])
    arrow = to_arrow_schema(out_schema)

    def draw_block(rows_, drawn):
        if not rows_.num_rows or not drawn.num_rows:
            return arrow.empty_table()
        rows_ = rows_.sort_by([(key, "ascending")])
        m, group = rows_.num_rows, [rows_[c][0].as_py() for c in g]
        code, cells = _codes(rows_.select(columns).combine_chunks().to_batches()[0], columns)
        rng = _rng(seed, *group, "rows", drawn["_node"][0].as_py())
        parts = []
        for b, size in enumerate(drawn["_t"][0].as_py()):
            weight = np.bincount(code[rng.integers(0, m, size=size)], minlength=len(cells))
            held = np.flatnonzero(weight)
            parts.append((np.full(len(held), b), held, weight[held]))
        replicate, held, weight = (np.concatenate(c) for c in zip(*parts))
        fixed = [pa.array([v], arrow.field(c).type).take(pa.array(np.zeros(len(held), np.int64))) for c, v in zip(g, group)]
        values = [pa.array([x[i] for x in cells], arrow.field(c).type).take(pa.array(held)) for i, c in enumerate(columns)]
        return pa.Table.from_arrays([*fixed, pa.array(replicate, pa.int32()), *values, pa.array(weight, pa.int64())], schema=arrow)

    other = [f"_g{i}" for i in range(len(g))]
    draws = draws.select(*[F.col(c).alias(o) for c, o in zip(g, other)], F.col("_blk").alias("_node"), "_t")
    w = rows.groupBy(*g, "_blk").cogroup(draws.groupBy(*other, "_node")).applyInArrow(draw_block, out_schema)
    return w if by else w.drop("_g")


@dataclass(frozen=True)
class PythonAggregate:
    """A metric written in Python over weighted rows, with a state that can be merged.

    ``update(state, columns, weight)`` adds rows: ``columns`` maps names to
    NumPy arrays, ``weight`` holds their (whole) weights; ``merge(a, b)`` adds
    states; ``finish(state)`` gives a number, or a tuple of ``outputs`` numbers
    (None or NaN where undefined).  States are pickled between tasks and should
    stay small whatever the number of rows.
    """

    name: str
    columns: tuple
    init: Callable[[], object]
    update: Callable[[object, dict, np.ndarray], object]
    merge: Callable[[object, object], object]
    finish: Callable[[object], object]
    outputs: int = 1


#: States that one merge takes of a (group, replicate), about.
MERGE_FAN = 32


def _group_states(agg: PythonAggregate, by: Sequence[str], draws: int | None, step: int, schema: pa.Schema):
    """Per batch: a state for every group, for ``draws`` replicates of Poisson weights (or the weights given)."""
    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        limits = _limits()
        for batch in batches:
            if not batch.num_rows:
                continue
            code, keys = _codes(batch, by)
            order = np.argsort(code, kind="stable")
            edges = np.searchsorted(code[order], np.arange(len(keys) + 1))
            values = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in agg.columns}
            out = []
            for i, k in enumerate(keys):
                rows = order[edges[i]:edges[i + 1]]
                mine = {c: v[rows] for c, v in values.items()}
                if draws is None:
                    weights = [(None, batch.column("_w").to_numpy(zero_copy_only=False)[rows])]
                else:
                    h = batch.column("_h").to_numpy(zero_copy_only=False)[rows].astype(np.uint32)
                    weights = ((b, _draws(h, b, limits).astype(np.int64)) for b in range(draws))
                for b, w in weights:
                    state = agg.update(agg.init(), mine, w)
                    out.append({**dict(zip(by, k)), **({} if b is None else {"replicate": b}), "_part": part, "_state": pickle.dumps(state)})
            yield pa.RecordBatch.from_pylist(out, schema)
            part += step
    return run


def _merge_runs(agg: PythonAggregate, keys: Sequence[str], schema: pa.Schema, finish: bool = False):
    """States sorted by ``keys``: neighbours of one key are merged as they stream through."""
    def run(batches):
        key, state, out = None, None, []

        def row():
            fixed = dict(zip(keys, key))
            if not finish:
                return {**fixed, "_state": pickle.dumps(state)}
            value = agg.finish(state)
            values = value if isinstance(value, (tuple, list)) else (value,)
            if len(values) != agg.outputs:
                raise ValueError(f"{agg.name}: finish gave {len(values)} values, {agg.outputs} were declared")
            # without a defined value the replicate has none
            return {**fixed, "value": [None if v is None or v != v else float(v) for v in values]}

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*keys, "_state")]
            for *k, blob in zip(*columns):
                if k == key:
                    state = agg.merge(state, pickle.loads(blob))
                else:
                    if key is not None:
                        out.append(row())
                    key, state = k, pickle.loads(blob)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if key is not None:
            yield pa.RecordBatch.from_pylist([row()], schema)
    return run


def python_aggregate(df: DataFrame, agg: PythonAggregate, by: Sequence[str], weight: str | None = None, key: str | None = None,
                     n: int = 1, seed: int = RANDOM_SEED) -> DataFrame:
    """by..., (replicate,) value (array of ``outputs`` numbers) of a Python aggregate.

    With ``weight`` the rows carry their weights; with ``key`` each of ``n``
    replicates draws Poisson weights.  A batch of rows gives one state per
    (group, replicate), so a hot group is worked on by all tasks that read it;
    states meet ``MERGE_FAN`` at a time, level by level, and stream through a
    merge, so no task gathers a group.  States are written to the checkpoint
    folder between, so Python does not run twice over the rows.
    """
    by = list(by)
    draws = None if key is None else n
    rows = df.select(*by, *[F.col(c) for c in agg.columns if c not in by],
                     *([hash32(F.col(key), seed=seed).alias("_h")] if key else []), *([F.col(weight).alias("_w")] if weight else []))
    keys = [*by, *(["replicate"] if key else [])]
    fields = [*[rows.schema[c] for c in by], *([T.StructField("replicate", T.IntegerType())] if key else [])]
    state = T.StructField("_state", T.BinaryType())
    schema = T.StructType([*fields, T.StructField("_part", T.LongType()), state])
    states = materialize(rows.mapInArrow(_group_states(agg, by, draws, rows.rdd.getNumPartitions(), to_arrow_schema(schema)), schema))
    parts = (states.agg(F.max("_part")).first()[0] or 0) + 1

    def merged(frame: DataFrame, by_part: list, out: T.StructType, finish: bool = False) -> DataFrame:
        placed = frame.repartition(*by_part) if by_part else frame.coalesce(1)
        return placed.sortWithinPartitions(*by_part).mapInArrow(_merge_runs(agg, by_part, to_arrow_schema(out), finish), out)

    while parts > MERGE_FAN:
        parts = -(-parts // MERGE_FAN)
        states = merged(states.withColumn("_part", F.floor(F.col("_part") / MERGE_FAN)), [*keys, "_part"], schema)
    value = T.StructField("value", T.ArrayType(T.DoubleType()))
    return merged(states, keys, T.StructType([*fields, value]), finish=True)


def python_metric(agg: PythonAggregate) -> Metric:
    """A Python aggregate as a metric of the bootstrap; a tuple gives one metric per output, in order."""
    def weighted(d, by, w):
        return _spread(python_aggregate(d, agg, by, weight=w), agg.outputs)

    def drawn(d, key, by, n, seed):
        return _spread(python_aggregate(d, agg, by, key=key, n=n, seed=seed), agg.outputs)

    return Metric(agg.name, weighted, None, agg.columns, drawn, agg.outputs)


def _spread(df: DataFrame, outputs: int) -> DataFrame:
    rest = [c for c in df.columns if c != "value"]
    names = ["value"] if outputs == 1 else [f"value_{i}" for i in range(outputs)]
    return df.select(*rest, *[F.col("value")[i].alias(name) for i, name in enumerate(names)])


def group_product(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Every combination of the distinct values of the group columns.

    Built by exploding per-column value sets; the output has exactly one row
    per combination, which is the result's own size.  A column of more than
    ``MAX_GROUP_VALUES`` values is an error.
    """
    by = list(by)
    sets = df.agg(*[F.collect_set(c).alias(c) for c in by])
    for c in by:
        few = F.when(F.size(c) <= MAX_GROUP_VALUES, F.col(c)).otherwise(
            F.raise_error(F.lit(f"more than {MAX_GROUP_VALUES} values of the group column {c}")))
        sets = sets.withColumn(c, F.explode(few))
    return sets


def bootstrap(df: DataFrame, metrics: Sequence[Metric] | Metric, by: Sequence[str] | str = (), n: int = 100,
              confidence: float = 0.95, key: str = "rowkey", seed: int = RANDOM_SEED,
              include_empty: bool = False, mode: str = "poisson", percentiles: bool = False) -> DataFrame:
    """Mean and normal CI of each metric over n bootstrap replicates, per group.

    Output columns: group columns, then ``mean_i, lci_i, uci_i`` per metric i.
    ``include_empty`` adds group combinations without rows (NULL metrics).
    ``mode='poisson'`` (default): Poisson(1) row weights, one Catalyst job.
    ``mode='multinomial'``: exact fixed-size resamples (the reference's
    ``sample(frac=1, replace=True)``), multinomial draws down a tree of row
    blocks; needs metrics that declare their input columns.
    """
    metrics = [metrics] if isinstance(metrics, Metric) else list(metrics)
    by = M._cols(by)
    df = row_key(df, key)
    own = mode == "poisson"
    metrics = [m.prepare(df) if m.prepare and not (own and m.replicates) else m for m in metrics]
    if all(m.columns is not None for m in metrics):
        needed = list(dict.fromkeys([*by, *[c for m in metrics for c in m.columns]]))
        src = df.select(key, *[c for c in needed if c != key])
    else:
        src = df
    if mode == "multinomial":
        if not all(m.columns is not None for m in metrics):
            raise ValueError("multinomial mode needs metrics with declared input columns")
        cols = list(dict.fromkeys(c for m in metrics for c in m.columns if c not in by))
        w = multinomial_weights(src, key, by, cols, n, seed)
    else:
        w = replicate_weights(src, key, n, seed)
    keys = [*by, "replicate"]
    values = [["value"] if m.outputs == 1 else [f"value_{i}" for i in range(m.outputs)] for m in metrics]
    ends = np.cumsum([len(v) for v in values]).tolist()
    names = [f"_m{i}" for i in range(ends[-1])]
    sums = [i for i, m in enumerate(metrics) if own and m.agg and not m.replicates]
    frames = [aggregate_replicates(src, [metrics[i] for i in sums], key, by, n, seed, [names[ends[i] - 1] for i in sums])] if sums else []
    for i, m in enumerate(metrics):
        if i in sums:
            continue
        r = m.replicates(src, key, by, n, seed) if own and m.replicates else m.fn(w, keys, "weight")
        frames.append(r.withColumnsRenamed(dict(zip(values[i], names[ends[i] - len(values[i]):ends[i]]))))
    per_rep = reduce(lambda a, b: a.join(b, keys, "full"), frames)
    out = M.mean_ci(per_rep, names, by, confidence, percentiles)
    if include_empty and by:
        out = group_product(df, by).join(out, by, "left")
    return out


def point_metrics(df: DataFrame, metrics: Sequence[Metric] | Metric, by=()) -> DataFrame:
    """The metrics on the unweighted data (weight 1), for comparison with the bootstrap mean."""
    metrics = [metrics] if isinstance(metrics, Metric) else list(metrics)
    by = M._cols(by)
    keys = by or ["_all"]
    base = df.withColumn("_w1", F.lit(1)).withColumn("_all", F.lit(0))
    out = None
    for i, m in enumerate(metrics):
        r = m.fn(base, keys, "_w1").withColumnRenamed("value", f"value_{i}")
        out = r if out is None else out.join(r, keys, "full")
    return out.drop("_all")
