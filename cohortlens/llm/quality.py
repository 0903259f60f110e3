"""op13: quality by random-indexing word vectors and a small two-layer network.

Words are runs of letters, of digits or of punctuation; a word that repeats
one of the two words before it counts as one common word of its own.  Every
word has a fixed sparse index vector, drawn from its hash, for either side.
One pass over all texts adds the index vectors of each word's neighbours to
its context vector; words are hashed into a table of fixed size, tasks return
their sums as blocks, and a tree of bounded fan-in adds them up.  All sums are
integers, so they do not depend on the split of the input.

A text is the mean of its words' unit vectors, drawn towards the corpus mean
by a few words' weight.  The network learns from a bounded sample of labelled
rows; a temperature, fitted on a part of the sample that the network has not
seen, calibrates its probabilities.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.llm.hashing import STEP, _power_tables, mix, text_bytes

#: Class of each byte: 0 white space, 1 letters and anything beyond ASCII, 2 digits, 3 the rest.
CLASS = np.full(256, 3, np.uint8)
CLASS[[9, 10, 11, 12, 13, 32]] = 0
CLASS[65:91] = CLASS[97:123] = CLASS[128:] = 1
CLASS[48:58] = 2
#: Hash that stands for a repeated word.
REPEAT = np.uint64(0x5EED)
#: Neighbours on either side that make up a word's context.
WINDOW = 2
#: Rows of the word table that one block holds; blocks that one task adds up.
BLOCK_ROWS, FAN = 512, 32
#: Fixed point of word vectors when texts are pooled.
UNIT = 1 << 20


@dataclass(frozen=True)
class Params:
    """``max_rows`` bounds the labelled rows that training reads (about; chosen by a hash of the id)."""

    bits: int = 14
    dims: int = 32
    index_ones: int = 2
    max_rows: int = 10_000
    pull: int = 4
    hidden: int = 32
    epochs: int = 60
    batch: int = 64
    rate: float = 0.01
    decay: float = 1e-3
    calibration: float = 0.2
    threshold: float = 0.3
    seed: int = 13


@dataclass(frozen=True)
class Vectors:
    """Word vectors in fixed point, and their mean over all words of the corpus."""

    table: np.ndarray
    mean: np.ndarray


@dataclass(frozen=True)
class Network:
    """Standardisation, two layers and the temperature."""

    centre: np.ndarray
    spread: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    output: np.ndarray
    bias: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = (x - self.centre) / self.spread
        return np.maximum(x @ self.hidden + self.hidden_bias, 0) @ self.output + self.bias

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def held_out(id_col: str) -> Column:
    """Rows that training never reads: CRC-32 of the id as text is divisible by 5."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def _end_of_step(data: np.ndarray, offsets: np.ndarray, to: int) -> int:
    """``to``, moved on to the end of the run of bytes or of the row that it falls into."""
    while to < len(data) and CLASS[data[to]] == CLASS[data[to - 1]]:
        edge = int(offsets[np.searchsorted(offsets, to)])
        if edge == to:
            break
        gap = np.flatnonzero(CLASS[data[to:to + 4096]] != CLASS[data[to - 1]])
        to = min(to + (int(gap[0]) if len(gap) else 4096), edge, len(data))
    return to


def word_stream(data: np.ndarray, offsets: np.ndarray, step: int = 4 * STEP) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Hashes and rows of the words, some ``step`` bytes at a time, behind the last words of the step before; and the number of these."""
    at, n = 0, len(data)
    old = raw, words, kinds, rows = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.uint8, np.int64))
    while at < n:
        to = _end_of_step(data, offsets, min(at + step, n))
        part, kind = data[at:to], CLASS[data[at:to]]
        edge = np.ones(to - at, bool)
        edge[1:] = kind[1:] != kind[:-1]
        edge[offsets[np.searchsorted(offsets, at, "right"):np.searchsorted(offsets, to)] - at] = True
        starts = np.flatnonzero(edge)
        ends = np.append(starts[1:], to - at)
        real = kind[starts] > 0
        starts, ends = starts[real], ends[real]
        up, down = _power_tables(to - at + 1)
        total = np.zeros(to - at + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:to - at], out=total[1:])
        new = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        raw, kinds = np.concatenate([old[0], new]), np.concatenate([old[2], kind[starts]])
        rows = np.concatenate([old[3], np.searchsorted(offsets, starts + at, "right") - 1])
        again = np.zeros(len(raw), bool)
        for d in range(1, WINDOW + 1):
            again[d:] |= (raw[d:] == raw[:-d]) & (rows[d:] == rows[:-d]) & (kinds[d:] == 1)
        words = np.where(again, REPEAT, raw)
        words[:len(old[1])] = old[1]
        yield words, rows, len(old[1])
        old = tuple(x[-WINDOW:] for x in (raw, words, kinds, rows))
        at = to


def _bucket(words: np.ndarray, p: Params) -> np.ndarray:
    return (words >> np.uint64(64 - p.bits)).astype(np.int64)


def _add_contexts(sums: np.ndarray, words: np.ndarray, rows: np.ndarray, carried: int, p: Params) -> None:
    """Adds the index vectors of every word's neighbours to its row of ``sums``; the last column counts words."""
    buckets, width = _bucket(words, p), p.dims + 1
    plus, minus = [buckets[carried:] * width + p.dims], []
    for d in range(1, min(WINDOW, len(words) - 1) + 1):
        # a pair counts when its second word is new
        pair = np.flatnonzero((rows[d:] == rows[:-d]) & (np.arange(d, len(rows)) >= carried))
        for side, word, near in ((0, pair, pair + d), (1, pair + d, pair)):
            draw = mix(words[near] + np.uint64(side + 1))
            for k in range(p.index_ones):
                bits = draw >> np.uint64(20 * k)
                cell = buckets[word] * width + (bits % np.uint64(p.dims)).astype(np.int64)
                down = (bits >> np.uint64(19)) & np.uint64(1) == 1
                minus.append(cell[down])
                plus.append(cell[~down])
    flat = sums.reshape(-1)
    flat += np.bincount(np.concatenate(plus), minlength=len(flat))
    if minus:
        flat -= np.bincount(np.concatenate(minus), minlength=len(flat))


def _contexts(p: Params):
    def run(batches):
        from pyspark import TaskContext
        sums = np.zeros((1 << p.bits, p.dims + 1), np.int64)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for words, rows, carried in word_stream(data, offsets, 16 * STEP):
                _add_contexts(sums, words, rows, carried, p)
        part = TaskContext.get().partitionId()
        for block in range(-(-len(sums) // BLOCK_ROWS)):
            cells = sums[block * BLOCK_ROWS:(block + 1) * BLOCK_ROWS]
            if cells.any():
                yield _block(block, part, cells)
    return run


def _block(block: int, part: int, cells: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"block": block, "part": part, "cells": zlib.compress(cells.tobytes(), 1)}],
                                      pa.schema([("block", pa.int32()), ("part", pa.int64()), ("cells", pa.binary())]))


def _add_blocks(key, group):
    total = sum(np.frombuffer(zlib.decompress(c.as_py()), np.int64) for c in group["cells"])
    return pa.Table.from_batches([_block(key[0].as_py(), key[1].as_py(), total)])


def word_vectors(docs: DataFrame, p: Params = Params(), text_col: str = "text") -> Vectors:
    """Vectors of the hashed words from all texts; an empty table gives zero vectors."""
    schema = "block int, part long, cells binary"
    blocks = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_contexts(p), schema)
    parts = docs.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // FAN)
        blocks = blocks.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("block", "part").applyInArrow(_add_blocks, schema)
    sums = np.zeros((1 << p.bits, p.dims + 1), np.int64)
    # the word table, of fixed size
    for r in blocks.collect():
        cells = np.frombuffer(zlib.decompress(r["cells"]), np.int64).reshape(-1, p.dims + 1)
        sums[r["block"] * BLOCK_ROWS:][:len(cells)] += cells
    context, seen = sums[:, :-1].astype(float), sums[:, -1]
    length = np.sqrt((context * context).sum(1, keepdims=True))
    table = np.rint(UNIT * context / np.maximum(length, 1)).astype(np.int64)
    return Vectors(table, (table * (seen / max(1, seen.sum()))[:, None]).sum(0) / UNIT)


def pool(texts: pa.Array, vectors: Vectors, p: Params) -> np.ndarray:
    """One vector per text: the mean of its words' vectors and of ``pull`` times the corpus mean."""
    sums, words_in = np.zeros((len(texts), p.dims), np.int64), np.zeros(len(texts), np.int64)
    data, offsets = text_bytes(texts)
    for words, rows, carried in word_stream(data, offsets, STEP):
        words, rows = words[carried:], rows[carried:]
        if len(rows):
            begins = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
            sums[rows[begins]] += np.add.reduceat(vectors.table[_bucket(words, p)], begins, axis=0)
            words_in += np.bincount(rows, minlength=len(texts))
    return (sums / UNIT + p.pull * vectors.mean) / (words_in + p.pull)[:, None]


def fit(x: np.ndarray, y: np.ndarray, p: Params) -> Network:
    """Network for the rows of ``x`` by mini-batches with adaptive moments; the last share of the rows fits the temperature."""
    rng = np.random.default_rng(p.seed)
    n = max(1, len(y) - int(p.calibration * len(y)))
    centre, spread = x[:n].mean(0), x[:n].std(0) + 1e-6
    z = (x - centre) / spread
    layers = [rng.normal(0, 1 / np.sqrt(p.dims), (p.dims, p.hidden)), np.zeros(p.hidden), rng.normal(0, 1 / np.sqrt(p.hidden), p.hidden), np.zeros(1)]
    first, second, step = [np.zeros_like(v) for v in layers], [np.zeros_like(v) for v in layers], 0
    for _ in range(p.epochs):
        order = rng.permutation(n)
        for at in range(0, n, p.batch):
            rows = order[at:at + p.batch]
            inner = np.maximum(z[rows] @ layers[0] + layers[1], 0)
            error = (_sigmoid(inner @ layers[2] + layers[3]) - y[rows]) / len(rows)
            back = np.outer(error, layers[2]) * (inner > 0)
            slopes = [z[rows].T @ back + p.decay * layers[0], back.sum(0), inner.T @ error + p.decay * layers[2], np.array([error.sum()])]
            step += 1
            for v, g, m, s in zip(layers, slopes, first, second):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= p.rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
    net = Network(centre, spread, layers[0], layers[1], layers[2], float(layers[3][0]))
    return Network(**{**net.__dict__, "temperature": fit_temperature(net.logits(x[n:]), y[n:])})


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """Temperature of the least log loss, between 1/4 and 16, by golden section on its logarithm; 1 without rows."""
    if not len(y):
        return 1.0

    def loss(log_t):
        z = logits / np.exp(log_t)
        return (np.logaddexp(0, z) - y * z).mean()

    lo, hi, ratio = np.log(0.25), np.log(16.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def _pooled(shared, p: Params):
    def run(batches):
        for batch in batches:
            x = pool(batch.column("text"), shared.value, p)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("quality"), batch.column("mark"),
                                              pa.array(list(x), pa.list_(pa.float64()))], ["id", "quality", "mark", "x"])
    return run


def train(docs: DataFrame, labels: DataFrame, vectors: Vectors, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> Network | None:
    """Network from the labelled rows outside the held-out fifth; None without any.

    Rows without id or label are not used; of several labels of one id the
    largest counts, of several texts of one id the one of the least hash.
    """
    spark = docs.sparkSession
    marked = (labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull() & ~held_out(id_col))
              .groupBy(F.col(id_col).alias("id")).agg(F.max("quality").cast("int").alias("quality")))
    n = marked.count()
    if n > p.max_rows:
        marked = marked.where(F.pmod(F.xxhash64(F.lit(p.seed), "id"), F.lit(n)) < p.max_rows)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # about max_rows rows of 12 bytes: a proven bound, as is the learner's input
    sample = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("mark")).join(F.broadcast(marked), "id")
    shared = spark.sparkContext.broadcast(vectors)
    rows = (sample.select("id", "quality", "mark", "text").mapInArrow(_pooled(shared, p), "id long, quality int, mark long, x array<double>")
            .groupBy("id").agg(F.max("quality").alias("quality"), F.min_by("x", "mark").alias("x")))

    def learn(key, group):
        group = group.sort_by([("order", "ascending"), ("id", "ascending")])
        x = np.stack([v.values.to_numpy() for v in group["x"]])
        net = fit(x, group["quality"].to_numpy().astype(float), p)
        parts = [np.atleast_1d(v).ravel() for v in net.__dict__.values()]
        return pa.table({"weights": pa.array([np.concatenate(parts)], pa.list_(pa.float64()))})

    order = rows.withColumn("order", F.xxhash64(F.lit(p.seed + 1), "id")).withColumn("all", F.lit(0))
    learnt = order.groupBy("all").applyInArrow(learn, "weights array<double>").collect()
    if not learnt:
        return None
    shapes = [(p.dims,), (p.dims,), (p.dims, p.hidden), (p.hidden,), (p.hidden,), (), ()]
    flat, out = np.array(learnt[0]["weights"]), []
    for shape in shapes:
        size = int(np.prod(shape))
        out.append(flat[:size].reshape(shape))
        flat = flat[size:]
    return Network(*out[:5], float(out[5]), float(out[6]))


def scorer(docs: DataFrame, labels: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text"):
    """A column function that maps a text column to its score, learnt from ``docs`` and ``labels``."""
    vectors = word_vectors(docs, p, text_col)
    net = train(docs, labels, vectors, p, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, net))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        known, learnt = shared.value
        if learnt is None:
            return pa.array(np.full(len(texts), 0.5))
        return pa.array(learnt.probabilities(pool(texts, known, p)))

    return score


def quality(docs: DataFrame, labels: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores per row of ``docs``: id, held_out, score (0 to 1, higher is better), predicted (score >= threshold).

    Only the text enters a score.  Null, empty and blank texts count as the
    corpus mean; a very long text is read in steps; a null id is not held out
    and teaches nothing; repeated rows are scored alike; other columns are not
    read; without labelled rows every score is 0.5; an empty table gives no rows.
    """
    score = scorer(docs, labels, p, id_col, text_col)
    out = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), score(F.col(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= p.threshold).cast("int"))


def drop_poor(docs: DataFrame, labels: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model predicts as good, with their columns as they were; edge cases as in ``quality``."""
    score = scorer(docs, labels, p, id_col, text_col)
    return docs.where(score(F.col(text_col)) >= p.threshold)
