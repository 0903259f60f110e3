"""op4: toxicity by FTRL-proximal logistic regression on hashed word n-grams and skip-grams.

Tasks turn a bounded sample of labelled rows into distinct feature numbers;
one learner runs over them with per-coordinate rates, L1 and L2, leaving out
features that few rows have.  The non-zero weights (some hundreds, at most the
table size) are broadcast, and every whole text is scored from its distinct
features in vectorised Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.llm.common import small_batches
from cohortlens.llm.hashing import mix, steps, text_bytes, word_hashes, word_table

#: Features: single words, word pairs at distance 1 (bigrams), 2 and 3 (skip-grams).
DISTANCES = (1, 2, 3)
WORDS = word_table(blank_words=False)
#: Rows and bytes, about, that a Python step of the training takes at once.
SLICE = 200
HANDED = 1 << 20


@dataclass(frozen=True)
class Params:
    """``max_rows`` bounds the labelled rows that training reads (about; chosen by a hash of the id).

    Features of fewer than ``min_rows`` training rows are left out.
    """

    bits: int = 20
    max_rows: int = 20_000
    min_rows: int = 4
    epochs: int = 5
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 1.0
    threshold: float = 0.3
    seed: int = 4


@dataclass(frozen=True)
class Model:
    """Sparse weights of the hashed features; an untrained model scores 0."""

    bits: int
    index: np.ndarray
    weight: np.ndarray
    bias: float
    trained: bool

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.bits, np.float64)
        w[self.index] = self.weight
        return w


def held_out(id_col: str) -> Column:
    """Rows that training never reads: CRC-32 of the id as text leaves 2 modulo 4."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def features(h: np.ndarray, rows: np.ndarray, bits: int):
    """Yields (feature index, row) arrays by kind. ``rows``: offsets of the rows' words."""
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    shift = np.uint64(64 - bits)
    yield (mix(h) >> shift).astype(np.int64), row
    for d in DISTANCES:
        if len(h) > d:
            same = row[:-d] == row[d:]
            pair = mix(h[:-d] * np.uint64(2 * d + 1) + h[d:] + np.uint64(d))
            yield (pair[same] >> shift).astype(np.int64), row[:-d][same]


def row_features(texts: pa.Array, bits: int) -> list[np.ndarray]:
    """Distinct features of each text."""
    data, offsets = text_bytes(texts)
    out = []
    for a, b in steps(offsets):
        h, rows = word_hashes(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], WORDS)
        parts = list(features(h, rows, bits))
        idx, row = np.concatenate([i for i, _ in parts]), np.concatenate([r for _, r in parts])
        by = np.argsort(row, kind="stable")
        out += [np.unique(x).astype(np.int32) for x in np.split(idx[by], np.searchsorted(row[by], np.arange(1, b - a)))]
    return out


def _featurise(p: Params):
    def run(batches):
        for batch in batches:
            found = row_features(batch.column("text"), p.bits)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("order"), batch.column("toxic"), pa.array(found, pa.list_(pa.int32()))],
                ["id", "order", "toxic", "features"])
    return run


def _compact(found: list[np.ndarray], lengths: list[np.ndarray], keep: np.ndarray) -> list[np.ndarray]:
    """Of every row the numbers, among the kept features, of those it has, and last that of the bias. Empties ``found``."""
    number = (np.cumsum(keep) - 1).astype(np.int32)
    bias, docs = int(keep.sum()), []
    for k, (values, length) in enumerate(zip(found, lengths)):
        found[k] = None
        used = keep[values]
        ends = np.concatenate([[0], np.cumsum(used)])[np.cumsum(length)]
        docs += np.split(np.insert(number[values[used]], ends, bias), (ends + np.arange(1, len(ends) + 1))[:-1])
    return docs


def learn(batches: Iterable[pa.RecordBatch], p: Params) -> pa.Table:
    """Feature and weight, the bias last, from batches of rows in any order.

    Beside the batch at hand it holds 4 bytes for each feature of a row, and
    coordinates only for features that enough rows have.
    """
    order, ids, labels, found, lengths = [], [], [], [], []
    seen = np.zeros(1 << p.bits, np.int32)
    for batch in batches:
        for out, name in ((order, "order"), (ids, "id"), (labels, "toxic")):
            out.append(batch.column(name).to_numpy().copy())
        column = batch.column("features")
        found.append(column.flatten().to_numpy().astype(np.int32))
        lengths.append(np.diff(column.offsets.to_numpy()))
        seen += np.bincount(found[-1], minlength=len(seen)).astype(np.int32)
    keep = seen >= p.min_rows
    del seen
    docs = _compact(found, lengths, keep)
    order, ids, labels = (np.concatenate(x) for x in (order, ids, labels))
    by = np.lexsort((ids, order))
    kept = np.flatnonzero(keep)
    size = len(kept) + 1
    z, n, l1 = np.zeros(size), np.zeros(size), np.full(size, p.l1)
    l1[-1] = 0.0  # the bias

    def weights(i):
        return np.where(np.abs(z[i]) <= l1[i], 0.0, (np.sign(z[i]) * l1[i] - z[i]) / ((p.beta + np.sqrt(n[i])) / p.alpha + p.l2))

    rng = np.random.default_rng(p.seed)
    for _ in range(p.epochs):
        for k in by[rng.permutation(len(docs))]:
            i = docs[k].astype(np.intp)
            w = weights(i)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[k]
            root = np.sqrt(n[i])
            n[i] += g * g
            z[i] += g - (np.sqrt(n[i]) - root) / p.alpha * w
    w = weights(np.arange(size))
    live = np.flatnonzero(w[:-1])
    return pa.table({"feature": np.append(kept[live], 1 << p.bits), "weight": np.append(w[live], w[-1])})


def _learn(p: Params):
    def run(key, group):
        return learn(group.to_batches(SLICE), p)
    return run


def _learn_batches(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from learn(batches, p).to_batches()
    return run


def train(docs: DataFrame, labels: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Model from the labelled rows outside the held-out quarter.

    Rows without id or label are not used; of several labels of one id the
    largest counts; repeated documents count each time.  Without any training
    row the model is untrained.
    """
    marked = (labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & ~held_out(id_col))
              .groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").cast("int").alias("toxic")))
    n = marked.count()
    order = F.xxhash64(F.lit(p.seed), "id")
    if n > p.max_rows:
        marked = marked.where(F.pmod(order, F.lit(n)) < p.max_rows)
    # about max_rows rows of 12 bytes: a proven bound, as is the learner's input
    sample = (docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
              .join(F.broadcast(marked), "id").select("id", order.alias("order"), "toxic", "text")
              .mapInArrow(_featurise(p), "id long, order long, toxic int, features array<int>"))
    with small_batches(docs.sparkSession, SLICE, HANDED):
        learnt = sample.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_learn_batches(p), "feature long, weight double").toPandas()
    if learnt.empty:
        return Model(p.bits, np.zeros(0, np.int64), np.zeros(0), 0.0, False)
    learnt = learnt.sort_values("feature")
    index, weight = learnt["feature"].to_numpy(np.int64), learnt["weight"].to_numpy()
    return Model(p.bits, index[:-1], weight[:-1], float(weight[-1]), True)


def score_batch(model: Model, dense: np.ndarray, texts: pa.Array) -> np.ndarray:
    """Scores of the texts, each from the sum over its distinct features."""
    if not model.trained:
        return np.zeros(len(texts))
    data, offsets = text_bytes(texts)
    out = np.full(len(texts), model.bias)
    for a, b in steps(offsets):
        h, rows = word_hashes(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], WORDS)
        found = []
        for idx, row in features(h, rows, model.bits):
            live = np.flatnonzero(dense[idx])
            found.append(row[live] << model.bits | idx[live])
        hits = np.unique(np.concatenate(found))
        out[a:b] += np.bincount(hits >> model.bits, dense[hits & ((1 << model.bits) - 1)], b - a)
    return 1.0 / (1.0 + np.exp(-np.clip(out, -35, 35)))


def scorer(docs: DataFrame, model: Model):
    """A column function that maps a text column to its score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cache: dict[str, np.ndarray] = {}

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        if "w" not in cache:
            cache["w"] = shared.value.dense()
        return pa.array(score_batch(shared.value, cache["w"], texts))

    return score


def toxicity(docs: DataFrame, labels: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores per row of ``docs``: id, held_out, score (0 to 1), predicted (score >= threshold).

    Only the text enters a score.  Null and empty texts get the model's bias;
    a null id is not held out; repeated rows are scored one by one; other
    columns are not read.
    """
    score = scorer(docs, train(docs, labels, p, id_col, text_col))
    out = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), score(F.col(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= p.threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with their columns as they were.

    Null and empty texts score the model's bias and stay where that is below
    the threshold; a null id teaches nothing and is judged by its text;
    repeated rows share one fate; without training rows nothing is rejected; an
    empty table gives no rows.
    """
    score = scorer(docs, train(docs, labels, p, id_col, text_col))
    return docs.where(score(F.col(text_col)) < p.threshold)
