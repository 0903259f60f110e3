"""Vector scoring and alignment.

Element-wise work stays in Catalyst (``transform``/``aggregate``/
``zip_with``).  Matrix products go through Arrow batches (``mapInPandas``):
one NumPy matmul per batch with the weights shipped once per task, never a
Python call per row.  In-batch contrastive scoring (V6) groups rows into
bounded batches and multiplies inside each batch only -- there is no global
cross product.
"""

from __future__ import annotations

import math
from typing import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.session import materialize
from cohortlens.functions.hashing import RANDOM_SEED
from cohortlens.operators.sequences import dot, l2_normalize
from cohortlens.operators.split import hash_positions

# fixed value: initial contrastive temperature, logit scale = ln(1 / 0.07)
LOGIT_SCALE = math.log(1 / 0.07)


# ------------------------------------------------------------------ V2
def time_encoding(img: Column, times: Column, dim: int) -> Column:
    """V2: x + sinusoidal time code: even dims sin(t*w_k), odd dims cos(t*w_k),
    w_k = exp(-2k*ln(10000)/dim), t = days of that position."""
    coef = -math.log(10000.0) / dim

    def row_code(row, t):
        return F.transform(row, lambda x, j: x.cast("double") + F.when(
            j % 2 == 0, F.sin(t * F.exp(F.floor(j / 2) * 2 * F.lit(coef))))
            .otherwise(F.cos(t * F.exp(F.floor(j / 2) * 2 * F.lit(coef)))))
    return F.zip_with(img, times, lambda row, t: row_code(row, t.cast("double")))


# ------------------------------------------------------------------ V3 / V9 / V8
def _matrix(col: pd.Series) -> np.ndarray:
    if len(col) == 0:
        return np.zeros((0, 0))
    return np.stack(col.to_numpy()).astype(np.float64)


def map_vectors(df: DataFrame, in_col: str, out_col: str, fn: Callable[[np.ndarray], np.ndarray],
                keep: Sequence[str] = ()) -> DataFrame:
    """Apply a batch function (n, d_in) -> (n, d_out) to a vector column via Arrow batches."""
    keep = list(keep)
    schema = T.StructType([df.schema[k] for k in keep] + [T.StructField(out_col, T.ArrayType(T.FloatType()))])

    def run(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            y = fn(_matrix(pdf[in_col])).astype(np.float32)
            out = pdf[keep].copy()
            out[out_col] = list(y)
            yield out
    return df.select(*keep, in_col).mapInPandas(run, schema)


def project(df: DataFrame, in_col: str, weight: np.ndarray, out_col: str = "proj", keep: Sequence[str] = (),
            bias: np.ndarray | None = None) -> DataFrame:
    """V3: x @ W (+ b), one matmul per Arrow batch; W travels with the task closure (size d_in x d_out)."""
    W = np.asarray(weight, dtype=np.float64)
    b = None if bias is None else np.asarray(bias, dtype=np.float64)
    return map_vectors(df, in_col, out_col, lambda X: X @ W + (0 if b is None else b), keep)


def mlp_forward(layers: Sequence[tuple[np.ndarray, np.ndarray]]) -> Callable[[np.ndarray], np.ndarray]:
    """V9: Linear -> ReLU -> Linear -> ReLU -> ... -> Linear (no activation on the last layer)."""
    layers = [(np.asarray(W, np.float64), np.asarray(b, np.float64)) for W, b in layers]

    def fwd(X: np.ndarray) -> np.ndarray:
        for i, (W, b) in enumerate(layers):
            X = X @ W + b
            if i < len(layers) - 1:
                X = np.maximum(X, 0.0)
        return X
    return fwd


def text_encoder_mlp(df: DataFrame, in_col: str, layers, out_col: str = "encoded", keep=()) -> DataFrame:
    """V9 as a batch job."""
    return map_vectors(df, in_col, out_col, mlp_forward(layers), keep)


# models built by ``make_predict_fn`` live here for the life of a (reused) Python worker
_MODEL_CACHE: dict[str, Callable] = {}


def cached_model(key: str, make_predict_fn):
    """The predict function for ``key``, built at most once per Python worker process."""
    fn = _MODEL_CACHE.get(key)
    if fn is None:
        fn = _MODEL_CACHE[key] = make_predict_fn()
    return fn


def score_batches(df: DataFrame, make_predict_fn: Callable[[], Callable[[np.ndarray], np.ndarray]],
                  in_col: str, out_col: str = "score", keep: Sequence[str] = (), out_type=T.DoubleType()) -> DataFrame:
    """V8: batch scoring of an already trained model; the model is built once per Python worker
    by ``make_predict_fn`` (U3, cached by a hash of the pickled factory) and called on whole
    Arrow batches."""
    import hashlib

    from pyspark import cloudpickle
    keep = list(keep)
    schema = T.StructType([df.schema[k] for k in keep] + [T.StructField(out_col, out_type)])
    key = hashlib.md5(cloudpickle.dumps(make_predict_fn)).hexdigest()

    def run(batches):
        predict = cached_model(key, make_predict_fn)
        for pdf in batches:
            if len(pdf) == 0:
                continue
            y = predict(_matrix(pdf[in_col]))
            out = pdf[keep].copy()
            out[out_col] = list(y) if isinstance(out_type, T.ArrayType) else np.asarray(y, dtype=np.float64).ravel()
            yield out
    return df.select(*keep, in_col).mapInPandas(run, schema)


# ------------------------------------------------------------------ V1
def hashing_encoder(dim: int = 64) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """Shipped test encoder for V1: signed feature hashing of lower-case word tokens, L2-normalised.

    token -> h = first 32 bits of md5(token); bucket = h mod dim;
    sign = +1 if (h div dim) is even else -1.
    """
    def make():
        import functools
        import hashlib
        import itertools
        import re
        tok = re.compile(r"[a-z0-9]+")

        # words that come back are looked up; numbers of the texts, of which there is no end, leave again
        @functools.lru_cache(maxsize=1 << 14)
        def slot(t: str) -> int:
            h = int(hashlib.md5(t.encode("utf-8")).hexdigest()[:8], 16)
            return h % (2 * dim)

        def predict(texts: np.ndarray) -> np.ndarray:
            slots = [[] if t is None else list(map(slot, tok.findall(str(t).lower()))) for t in texts]
            row = np.repeat(np.arange(len(slots)), [len(x) for x in slots])
            at = np.fromiter(itertools.chain.from_iterable(slots), np.int64, len(row))
            # h mod 2 dim: the bucket, above dim where the sign is negative
            n = np.bincount(row * (2 * dim) + at, minlength=len(slots) * 2 * dim).reshape(len(slots), 2, dim)
            v = (n[:, 0] - n[:, 1]).astype(np.float64)
            norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
            return (v / np.where(norm > 0, norm, 1.0)).astype(np.float32)
        return predict
    return make


# Encoders addressed by name; a factory takes ``dim`` and returns a make_predict_fn
ENCODERS: dict[str, Callable[..., Callable[[], Callable[[np.ndarray], np.ndarray]]]] = {"hashing": hashing_encoder}


def register_encoder(name: str, factory) -> None:
    """Make a user encoder available by name (e.g. a sentence model loaded inside the factory)."""
    ENCODERS[name] = factory


def encode_texts(df: DataFrame, text_col: str = "text", out_col: str = "vec",
                 make_predict_fn=None, dim: int = 64, batch_size: int = 500, encoder: str = "hashing") -> DataFrame:
    """V1: batched text -> vector with a pluggable encoder (``predict_batch_udf``).

    ``make_predict_fn`` (U3) builds the model once per Python worker and maps a
    batch of texts to an (n, d) float array; without it the encoder named
    ``encoder`` in ``ENCODERS`` is used (default: the hashing encoder).
    """
    from pyspark.ml.functions import predict_batch_udf
    make = make_predict_fn or ENCODERS[encoder](dim)
    # a later filter or explode of the vectors must not run the encoder a second time
    enc = predict_batch_udf(make, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size).asNondeterministic()
    return df.withColumn(out_col, enc(F.col(text_col)))


# ------------------------------------------------------------------ V5 / V6 / V7
def zero_shot_prob(img: Column, class_vecs: Column, logit_scale: float = LOGIT_SCALE) -> Column:
    """V5: softmax over classes of exp(scale) * cos(img, class_c); probability of class 1.

    Only the paired (image, own class texts) products are computed -- the
    b x b x c tensor of the reference is never formed.
    """
    from cohortlens.operators.sequences import broadcast_scalar
    s = math.exp(logit_scale)
    i = l2_normalize(img)
    logits = F.transform(class_vecs, lambda c: F.lit(s) * dot(i, l2_normalize(c)))
    # softmax_1 = 1 / sum_c exp(z_c - z_1); z_1 enters the lambda as an array, not an outer reference
    ratios = F.zip_with(logits, broadcast_scalar(logits, logits[1]), lambda z, z1: F.exp(z - z1))
    return F.lit(1.0) / F.aggregate(ratios, F.lit(0.0), lambda acc, r: acc + r)


def assign_batches(df: DataFrame, key: str, batch_size: int, epoch: int = 0, seed: int = RANDOM_SEED,
                   out: str = "batch_id") -> DataFrame:
    """Shuffled fixed-size batches (last one short): batch = floor(hash-order position / b).

    Positions come from the bucketed hash order of ``split.hash_positions``
    (no global sort); the epoch is mixed into the hash.
    """
    x = hash_positions(df.withColumn("_ek", F.concat_ws("|", F.col(key).cast("string"), F.lit(str(epoch)))), "_ek",
                       (), seed)
    return x.withColumn(out, F.floor(F.col("_pos") / batch_size).cast("bigint")).drop("_u", "_n", "_pos", "_ek")


def in_batch_contrastive(df: DataFrame, img_col: str, txt_col: str, batch_col: str = "batch_id",
                         logit_scale: float = LOGIT_SCALE) -> DataFrame:
    """V6: per batch, logits = exp(scale) * norm(img) @ norm(txt).T; symmetric cross-entropy
    with the diagonal as target and arg-max retrieval accuracy (image -> own text).

    Output (batch_id, n, loss, acc); batches are bounded by the batch size.
    """
    s = math.exp(logit_scale)
    schema = T.StructType([T.StructField(batch_col, T.LongType()), T.StructField("n", T.LongType()),
                           T.StructField("loss", T.DoubleType()), T.StructField("acc", T.DoubleType())])

    def per_batch(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_order")
        a, b = _matrix(pdf[img_col]), _matrix(pdf[txt_col])
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b /= np.linalg.norm(b, axis=1, keepdims=True)
        L = s * a @ b.T
        n = L.shape[0]

        def ce(M):
            m = M.max(axis=1, keepdims=True)
            lse = np.log(np.exp(M - m).sum(axis=1)) + m[:, 0]
            return float(np.mean(lse - np.diag(M)))
        loss = (ce(L) + ce(L.T)) / 2
        acc = float(np.mean(L.argmax(axis=1) == np.arange(n)))
        return pd.DataFrame({batch_col: [int(pdf[batch_col].iloc[0])], "n": [n], "loss": [loss], "acc": [acc]})
    x = df.select(batch_col, F.col("pid").alias("_order") if "pid" in df.columns else F.lit(0).alias("_order"),
                  img_col, txt_col)
    return x.groupBy(batch_col).applyInPandas(per_batch, schema)


#: Vectors of one side that a block of a tiled similarity matrix holds.
TILE = 1_024
#: Stripes of tiles that a side of the matrix is cut into, and vectors that a stripe holds at most.
STRIPES, STRIPE_ROWS = 16, 65_536


def _unit_rows(col) -> np.ndarray:
    m = _matrix(col)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _pack_tile(batch_col: str):
    def run(key, group):
        group = group.sort_by("_pos")
        sides = [_unit_rows(group[c].to_pandas()).tobytes() for c in ("_img", "_txt")]
        return pa.table({batch_col: pa.array([key[0].as_py()], pa.int64()), "_tile": pa.array([key[1].as_py()], pa.int64()),
                         "_n": pa.array([group.num_rows], pa.int32()), "_img": pa.array([sides[0]], pa.binary()), "_txt": pa.array([sides[1]], pa.binary())})
    return run


def pack_tiles(df: DataFrame, img_col: str, txt_col: str, batch_col: str, key: str, tile: int) -> DataFrame:
    """(batch, _tile, _n, _img, _txt): unit vectors of ``tile`` rows in the order of ``key``.

    A row's place is its number in its range of keys and the rows of the
    ranges below; no task sorts a whole batch.
    """
    rows = df.select(F.col(batch_col).cast("long").alias(batch_col), F.col(key).alias("_key"), F.col(img_col).alias("_img"), F.col(txt_col).alias("_txt"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(rows.repartitionByRange(parts, batch_col, "_key").withColumn("_range", F.spark_partition_id()))
    below = Window.partitionBy(batch_col).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(batch_col, "_range").agg(F.count(F.lit(1)).alias("_rows"))
    sizes = sizes.select(batch_col, "_range", F.coalesce(F.sum("_rows").over(below), F.lit(0)).alias("_below"))
    place = F.row_number().over(Window.partitionBy(batch_col, "_range").orderBy("_key")) - 1
    rows = rows.withColumn("_in", place).join(sizes, [batch_col, "_range"]).withColumn("_pos", (F.col("_in") + F.col("_below")).cast("long"))
    rows = rows.select(batch_col, "_pos", "_img", "_txt", F.floor(F.col("_pos") / tile).alias("_tile"))
    packed = rows.groupBy(batch_col, "_tile").applyInArrow(_pack_tile(batch_col), f"`{batch_col}` long, _tile long, _n int, _img binary, _txt binary")
    return materialize(packed)


def stripe_cells(tiles: DataFrame, batch_col: str, tile: int) -> DataFrame:
    """Tiles of both sides in every cell of the grid of stripes: (batch, _x, _y, _side, _tile, _n, _vecs).

    Side 0 are the matrix's rows, side 1 its columns.  A side has ``STRIPES``
    stripes, more only where one would hold over ``STRIPE_ROWS`` vectors: a
    vector moves once for each stripe of the other side.
    """
    # one row a batch
    last = tiles.groupBy(batch_col).agg((F.max("_tile") + 1).alias("_tiles"))
    most = max(1, STRIPE_ROWS // tile)
    width = F.least(F.ceil(F.col("_tiles") / STRIPES), F.lit(most))
    last = last.select(batch_col, width.alias("_width"), F.ceil(F.col("_tiles") / width).alias("_stripes"))
    own = tiles.join(last, batch_col).withColumn("_stripe", F.floor(F.col("_tile") / F.col("_width")))
    own = own.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_stripes") - 1)))
    sides = [own.select(batch_col, F.col(x).alias("_x"), F.col(y).alias("_y"), F.lit(side).alias("_side"), "_tile", "_n", F.col(vecs).alias("_vecs"))
             for side, x, y, vecs in ((0, "_stripe", "_other", "_img"), (1, "_other", "_stripe", "_txt"))]
    return sides[0].unionByName(sides[1])


class _Lines:
    """Running states of a cell's rows: maximum, sum of exponentials below it, place of the first maximum, own value."""

    def __init__(self, tiles: list[np.ndarray], places: list[int]):
        self.tiles, self.places = tiles, places
        self.starts = np.cumsum([0, *map(len, tiles)])
        n = self.starts[-1]
        self.top, self.total, self.best, self.own = np.full(n, -np.inf), np.zeros(n), np.zeros(n), np.full(n, np.nan)

    def add(self, b: np.ndarray, place: int, scale: float, tile: int) -> np.ndarray:
        """Another tile of columns, in order; the states of these columns over the cell's rows."""
        z = np.concatenate([scale * a @ b.T for a in self.tiles])
        own = np.full(len(b), np.nan)
        if place in self.places:
            i = self.places.index(place)
            at = slice(self.starts[i], self.starts[i + 1])
            own = np.diag(z[at]).copy()
            self.own[at] = own
        best = z.argmax(axis=1)
        new = z[np.arange(len(z)), best]
        self.best = np.where(new > self.top, place * tile + best, self.best)
        top = np.maximum(self.top, new)
        self.total = self.total * np.exp(self.top - top) + np.exp(z - top[:, None]).sum(axis=1)
        self.top = top
        high = z.argmax(axis=0)
        peak = z[high, np.arange(len(b))]
        # tiles of a stripe follow each other, so rows are in the batch's order
        return np.stack([peak, np.exp(z - peak).sum(axis=0), self.places[0] * tile + high.astype(float), own])

    def states(self):
        for place, lo, hi in zip(self.places, self.starts, self.starts[1:]):
            yield place, np.stack([x[lo:hi] for x in (self.top, self.total, self.best, self.own)])


def _cell_states(scale: float, tile: int, batch_col: str):
    """Cells sorted by their sides: a stripe of rows is held, the other stripe's tiles stream past it."""
    schema = pa.schema([(batch_col, pa.int64()), ("_side", pa.int32()), ("_tile", pa.int64()), ("_part", pa.int64()), ("_state", pa.binary())])

    def run(batches):
        cell, rows, lines = None, [], None

        def row(side, place, part, state):
            return pa.RecordBatch.from_pylist([{batch_col: cell[0], "_side": side, "_tile": place, "_part": part, "_state": state.tobytes()}], schema)

        def done():
            if lines is not None:
                for place, state in lines.states():
                    yield row(0, place, cell[2], state)

        for batch in batches:
            for r in batch.to_pylist():
                at = (r[batch_col], r["_x"], r["_y"])
                if at != cell:
                    yield from done()
                    cell, rows, lines = at, [], None
                vecs = np.frombuffer(r["_vecs"]).reshape(r["_n"], -1)
                if r["_side"] == 0:
                    rows.append((vecs, r["_tile"]))
                    continue
                if lines is None:
                    lines = _Lines([v for v, _ in rows], [t for _, t in rows])
                yield row(1, r["_tile"], cell[1], lines.add(vecs, r["_tile"], scale, tile))
        yield from done()
    return run


def _fold_states(tile: int, batch_col: str):
    """States of one line of blocks, in order, merged as they stream through: sums of a tile's losses and hits."""
    schema = pa.schema([(batch_col, pa.int64()), ("_side", pa.int32()), ("n", pa.int64()), ("_loss", pa.float64()), ("_hits", pa.int64())])

    def run(batches):
        key, state = None, None

        def row():
            top, total, best, own = state
            hits = int((best == key[2] * tile + np.arange(len(best))).sum())
            return pa.RecordBatch.from_pylist([{batch_col: key[0], "_side": key[1], "n": len(top), "_loss": float((np.log(total) + top - own).sum()),
                                                "_hits": hits}], schema)

        for batch in batches:
            for r in batch.to_pylist():
                at, new = (r[batch_col], r["_side"], r["_tile"]), np.frombuffer(r["_state"]).reshape(4, -1)
                if at != key:
                    if key is not None:
                        yield row()
                    key, state = at, new
                    continue
                top = np.maximum(state[0], new[0])
                total = state[1] * np.exp(state[0] - top) + new[1] * np.exp(new[0] - top)
                # blocks come in order, so the first of equal maxima stays
                state = np.stack([top, total, np.where(new[0] > state[0], new[2], state[2]), np.where(np.isnan(new[3]), state[3], new[3])])
        if key is not None:
            yield row()
    return run


def tiled_contrastive(df: DataFrame, img_col: str, txt_col: str, batch_col: str = "batch_id", key: str = "pid",
                      logit_scale: float = LOGIT_SCALE, tile: int = TILE) -> DataFrame:
    """V6 for batches of any size: (batch_id, n, loss, acc) as ``in_batch_contrastive``.

    A batch's similarity matrix is computed in blocks of ``tile`` x ``tile``.
    Its sides are cut into stripes of tiles; a task holds one stripe of rows,
    past which a stripe of columns streams, whatever the batch size.  Every row
    and column of a cell has its running (maximum, sum of exponentials, place
    of the maximum), and these are merged line by line.  A vector moves once
    for each of the ``STRIPES`` stripes of the other side (beyond
    ``STRIPES`` x ``STRIPE_ROWS`` vectors a batch has more stripes).  Places
    follow ``key``; the first of equal maxima counts.
    """
    cells = stripe_cells(pack_tiles(df.where(F.col(batch_col).isNotNull()), img_col, txt_col, batch_col, key, tile), batch_col, tile)
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), STRIPES * STRIPES)
    # every cell of the grid once: its rows against its columns
    states = cells.repartition(tasks, batch_col, "_x", "_y").sortWithinPartitions(batch_col, "_x", "_y", "_side", "_tile").mapInArrow(
        _cell_states(math.exp(logit_scale), tile, batch_col), f"`{batch_col}` long, _side int, _tile long, _part long, _state binary")
    lines = states.repartition(batch_col, "_side", "_tile").sortWithinPartitions(batch_col, "_side", "_tile", "_part")
    sums = lines.mapInArrow(_fold_states(tile, batch_col), f"`{batch_col}` long, _side int, n long, _loss double, _hits long")
    rows_only = F.col("_side") == 0
    n = F.sum(F.when(rows_only, F.col("n")))
    return sums.groupBy(batch_col).agg(n.alias("n"), (F.sum("_loss") / n / 2).alias("loss"),
                                       (F.sum(F.when(rows_only, F.col("_hits"))) / n).alias("acc"))


def fused_features(seq: DataFrame, out: str = "features") -> DataFrame:
    """V7: concatenation of the newest image vector and the first text row per patient."""
    return seq.select("pid", F.concat(F.col("img")[0], F.col("expr")[0]).alias(out))


# ------------------------------------------------------------------ A6
def vector_set_stats(df: DataFrame, col: str = "vec") -> DataFrame:
    """Mean of per-vector means and mean of per-vector population stds."""
    from cohortlens.operators.sequences import broadcast_scalar
    v = F.col(col)
    n = F.size(v).cast("double")
    s1 = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    mean = s1 / n
    # two-pass form; the mean enters the lambda as an array (evaluated once per row)
    dev2 = F.zip_with(v, broadcast_scalar(v, mean), lambda x, m: (x.cast("double") - m) * (x.cast("double") - m))
    var = F.aggregate(dev2, F.lit(0.0), lambda acc, x: acc + x) / n
    per = df.select(mean.alias("_m"), F.sqrt(var).alias("_s"))
    return per.agg(F.avg("_m").alias("mean_of_means"), F.avg("_s").alias("mean_of_stds"))


# ------------------------------------------------------------------ V10
def moment_matrix(df: DataFrame, x_col: str, y_col: str, fan_in: int = 32, block: int = 128) -> np.ndarray:
    """Sum of z z' over the rows, z = [1, x, y], in one pass.

    Every task adds up its Arrow batches and emits the matrix in blocks of
    ``block`` lines; partial sums are added ``fan_in`` at a time in as many
    levels as the number of tasks asks for, each block on its own.  The driver
    receives one matrix of (1 + d1 + d2)^2 numbers, bounded by the dimensions.
    """
    schema = T.StructType([T.StructField("g", T.IntegerType()), T.StructField("k", T.IntegerType()),
                           T.StructField("width", T.IntegerType()), T.StructField("part", T.BinaryType())])

    def partial(batches):
        from pyspark import TaskContext
        acc = None
        for pdf in batches:
            if len(pdf) == 0:
                continue
            X, Y = _matrix(pdf[x_col]), _matrix(pdf[y_col])
            Z = np.concatenate([np.ones((len(X), 1)), X, Y], axis=1)
            acc = Z.T @ Z if acc is None else acc + Z.T @ Z
        if acc is not None:
            starts = range(0, len(acc), block)
            yield pd.DataFrame({"g": TaskContext.get().partitionId(), "k": np.arange(len(starts)), "width": len(acc),
                                "part": [acc[i:i + block].tobytes() for i in starts]})

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("g")
        total = sum(np.frombuffer(b) for b in pdf["part"])
        return pd.DataFrame({"g": [int(pdf["up"].iloc[0])], "k": [int(pdf["k"].iloc[0])], "width": [int(pdf["width"].iloc[0])],
                             "part": [total.tobytes()]})

    parts = materialize(df.select(x_col, y_col).mapInPandas(partial, schema))
    top = parts.agg(F.max("g")).first()[0]
    if top is None:
        raise ValueError("no pairs to align")
    while top > 0:
        top //= fan_in
        parts = parts.withColumn("up", F.expr(f"g div {fan_in}").cast("int")).groupBy("up", "k").applyInPandas(combine, schema)
    rows = sorted(parts.collect(), key=lambda r: r["k"])
    return np.concatenate([np.frombuffer(r["part"]).reshape(-1, r["width"]) for r in rows])


def pair_moments(df: DataFrame, x_col: str, y_col: str, fan_in: int = 32):
    """n, sum x, sum y, X'X, Y'Y, X'Y of paired vectors."""
    S = moment_matrix(df, x_col, y_col, fan_in)
    d1 = len(df.select(x_col).first()[0])
    x, y = slice(1, 1 + d1), slice(1 + d1, None)
    return float(S[0, 0]), S[0, x], S[0, y], S[x, x], S[y, y], S[x, y]


def _inv_sqrt(C: np.ndarray) -> np.ndarray:
    ev, V = np.linalg.eigh(C)
    return V @ np.diag(1.0 / np.sqrt(np.clip(ev, 1e-12, None))) @ V.T


def paired_alignment(df: DataFrame, img_col: str, txt_col: str, k: int = 16, ridge: float = 1e-6):
    """Learn linear maps of both modalities into a shared k-dim space (ridge CCA).

    Returns dict(A, B, bias_a, bias_b, corr): ``x @ A + bias_a`` and
    ``y @ B + bias_b`` are centred, whitened and maximally correlated.
    """
    n, sx, sy, Sxx, Syy, Sxy = pair_moments(df, img_col, txt_col)
    mx, my = sx / n, sy / n
    Cxx = Sxx / n - np.outer(mx, mx)
    Cyy = Syy / n - np.outer(my, my)
    Cxy = Sxy / n - np.outer(mx, my)
    Cxx += ridge * np.trace(Cxx) / len(Cxx) * np.eye(len(Cxx))
    Cyy += ridge * np.trace(Cyy) / len(Cyy) * np.eye(len(Cyy))
    Wx, Wy = _inv_sqrt(Cxx), _inv_sqrt(Cyy)
    U, s, Vt = np.linalg.svd(Wx @ Cxy @ Wy)
    k = min(k, len(s))
    A, B = Wx @ U[:, :k], Wy @ Vt.T[:, :k]
    return {"A": A, "B": B, "bias_a": -mx @ A, "bias_b": -my @ B, "corr": s[:k], "n": n}
