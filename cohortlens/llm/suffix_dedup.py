"""op6: removal of long repeated byte strings by column-wise suffix sorting.

Every start of an ``length``-byte string is assigned to one anchor: the least
hashed ``gram`` inside the string.  Equal strings have equal anchors at equal
distance, so the texts are cut into segments around their anchors and laid side
by side, anchor below anchor.  Then the collection's suffixes are sorted column
by column from the right: each round puts one symbol in front of every
segment's suffix, which a stable counting sort turns into the next order (the
column in the old order is the Burrows-Wheeler transform of the round), and
the common prefixes of neighbours follow from range minima of the old ones.
A start whose neighbour shares ``length`` bytes is repeated.

A round is a column of at most 2 * length, not of the longest text.  Segments
whose anchor occurs once are dropped, equal segments are counted instead of
sorted, the rest is sorted in batches of bounded size; anchors with more
different segments than a batch holds are resolved by counting the digests of
their strings.  All three are exact.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm.common import cut, pin_splits
from cohortlens.llm.hashing import _power_tables, steps, text_bytes

LENGTH = 400
GRAM = 100
#: Starts that one vectorised step handles; longer texts are cut there (starts, not strings, are divided).
CHUNK = 1 << 18
#: Segments that one sorting batch holds, about.
BATCH = 4_000
#: Different segments that one anchor may have in a batch; beyond that the strings themselves are counted.
HOT = 20_000
#: Rows that a task hands over at once.
SLICE = 4_000
PAD = 0xFF  # no byte of UTF-8

ANCHORS = "f long, sh long, rid long, a long, b long, rel int"


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, from prefix and suffix minima of blocks."""
    n = len(x)
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    grid = padded.reshape(blocks, w)
    front = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - w + 1], front[w - 1:n])


def find_anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every start in ``data``: runs of starts (first, last) with one anchor, its place and its hash."""
    n = len(data)
    up, down = _power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    g = (total[gram:] - total[:-gram]) * down[:n - gram + 1]
    g = (g ^ (g >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    bits = np.uint64(int(len(g)).bit_length())
    packed = (g >> bits << bits) | np.arange(len(g), dtype=np.uint64)
    least = _sliding_min(packed, length - gram + 1)
    place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return place, g


def text_segments(texts: pa.Array, length: int, gram: int):
    """Yields (row, a, b, p, f, digest) arrays: starts a..b of a row have their anchor at p, of hash f."""
    data, offsets = text_bytes(texts)
    for lo, hi in steps(offsets, CHUNK):
        base, end = int(offsets[lo]), int(offsets[hi])
        for at in range(base, max(base + 1, end - length + 1), CHUNK):
            part = data[at:min(at + CHUNK + length - 1, end)]
            if len(part) < length:
                continue
            place, g = find_anchors(part, length, gram)
            # starts whose string would leave its row are none
            start = np.arange(at, at + len(place))
            row = np.searchsorted(offsets, start, "right") - 1
            real = start + length <= offsets[row + 1]
            cuts = np.flatnonzero((place[1:] != place[:-1]) | (row[1:] != row[:-1]) | (real[1:] != real[:-1])) + 1
            first = np.concatenate([[0], cuts])
            last = np.concatenate([cuts - 1, [len(place) - 1]])
            keep = real[first]
            first, last = first[keep], last[keep]
            view = memoryview(part)
            digest = np.array([int.from_bytes(hashlib.blake2b(view[x:y], digest_size=8).digest(), "little", signed=True)
                               for x, y in zip(first.tolist(), (last + length).tolist())], np.int64)
            rows = row[first]
            yield rows, start[first] - offsets[rows], start[last] - offsets[rows], at + place[first] - offsets[rows], g[place[first]].view(np.int64), digest


def _emit_anchors(length: int, gram: int):
    def run(batches):
        for batch in batches:
            rid = batch.column("rid").to_numpy()
            for rows, a, b, p, f, digest in text_segments(batch.column("text"), length, gram):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(f), pa.array(digest), pa.array(rid[rows]), pa.array(a), pa.array(b), pa.array((p - a).astype(np.int32))],
                    ["f", "sh", "rid", "a", "b", "rel"])
    return run


def column_sort(contents: list[bytes], rel: np.ndarray, n_starts: np.ndarray, length: int) -> np.ndarray:
    """repeated[i, j]: whether start j of segment i also starts in another segment at the same distance from the anchor.

    ``rel``: place of the anchor in the segment; ``n_starts``: starts of the segment.
    """
    m = len(contents)
    sizes = np.array([len(c) for c in contents], np.int64)
    left = int(rel.max())
    width = left + int((sizes - rel).max())
    lines = np.full((m, width), PAD, np.uint8)
    for i, (content, at) in enumerate(zip(contents, (left - rel).tolist())):
        lines[i, at:at + len(content)] = np.frombuffer(content, np.uint8)
    columns = np.ascontiguousarray(lines.T)
    del lines
    repeated = np.zeros((m, int(n_starts.max())), bool)
    order = np.arange(m)
    common = np.zeros(m + 1, np.int16)  # common[i]: prefix shared by suffixes i-1 and i of the order
    for c in range(width - 1, -1, -1):
        symbols = columns[c][order]
        by = np.argsort(symbols, kind="stable")
        ranked = symbols[by]
        least = np.minimum.reduceat(common, by + 1)
        order = order[by]
        new = np.zeros(m + 1, np.int16)
        same = ranked[1:] == ranked[:-1]
        new[1:m][same] = np.minimum(least[:-1][same] + 1, length)
        common = new
        if c <= left:
            hit = np.flatnonzero(common[1:m] >= length) + 1
            if len(hit):
                both = np.union1d(order[hit - 1], order[hit])
                j = c - (left - rel[both])
                fits = (j >= 0) & (j < n_starts[both])
                repeated[both[fits], j[fits]] = True
    return repeated


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


_SPAN_SCHEMA = pa.schema([("rid", pa.int64()), ("s", pa.int64()), ("e", pa.int64())])


def _sort_batch(length: int):
    def run(group):
        contents = group["content"].to_pylist()
        rel = group["rel"].to_numpy().astype(np.int64)
        a, rid, alone = (group[c].to_numpy() for c in ("a", "rid", "alone"))
        n_starts = np.array([len(c) - length + 1 for c in contents], np.int64)
        repeated = column_sort(contents, rel, n_starts, length)
        found = [(rid[i], a[i] + x, a[i] + y) for i in np.flatnonzero(alone & repeated.any(axis=1))
                 for x, y in _runs(repeated[i, :n_starts[i]])]
        return pa.table([pa.array([x[k] for x in found], pa.int64()) for k in range(3)], schema=_SPAN_SCHEMA)
    return run


def _sliced(rows, names, types):
    """Record batches of at most SLICE of the rows."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == SLICE:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


def _window_digests(length: int):
    def strings(batch):
        for rid, a, alone, f, content in zip(*(batch.column(c).to_pylist() for c in ("rid", "a", "alone", "f", "content"))):
            view = memoryview(content)
            for i in range(len(content) - length + 1):
                yield f, hashlib.blake2b(view[i:i + length], digest_size=16).digest(), rid, a + i, alone

    def run(batches):
        types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_()]
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                yield from _sliced(strings(batch.slice(at, SLICE)), ["f", "digest", "rid", "s", "alone"], types)
    return run


def _cut_segments(length: int):
    def segments(batch):
        for rid, text, wanted in zip(batch.column("rid").to_pylist(), batch.column("text"), batch.column("segments")):
            data = text.as_py().encode()
            for x in wanted.as_py():
                yield x["f"], rid, x["a"], x["rel"], x["alone"], data[x["a"]:x["b"] + length]

    def run(batches):
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
        for batch in batches:
            yield from _sliced(segments(batch), ["f", "rid", "a", "rel", "alone", "content"], types)
    return run


def repeated_starts(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, batch: int = BATCH, hot: int = HOT) -> DataFrame:
    """rid, s, e: runs of starts (bytes) whose ``length``-byte strings also start elsewhere. ``rows``: rid, text."""
    anchors = cut(rows.mapInArrow(_emit_anchors(length, gram), ANCHORS), "anchors")
    # tables, not aggregates, on the small side of joins: Spark splits a hot anchor's partition only then
    often = cut(anchors.groupBy("f").agg(F.count("*").alias("n")).where("n > 1").select("f"), "often")
    anchors = cut(anchors.join(often, "f"), "repeated-anchors")
    # equal segments are one row with a count
    kinds = anchors.groupBy("f", "sh", "rel").agg(F.count("*").alias("n"), F.min(F.struct("rid", "a", "b")).alias("one"))
    kinds = cut(kinds, "segment-kinds")
    whole = anchors.join(kinds.where("n > 1").select("f", "sh", "rel"), ["f", "sh", "rel"]).select(
        "rid", F.col("a").alias("s"), F.col("b").alias("e"))
    per_f = kinds.groupBy("f").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1")
    per_f = cut(per_f, "open-anchors")
    asked = kinds.join(per_f.select("f", "kinds"), "f").select(
        "f", "one.rid", "one.a", "one.b", "rel", (F.col("n") == 1).alias("alone"), "kinds")
    # a text is asked for at most as many segments as it has
    wanted = asked.groupBy("rid").agg(F.collect_list(F.struct("f", "a", "b", "rel", "alone")).alias("segments"))
    segments = rows.join(wanted, "rid").mapInArrow(_cut_segments(length), "f long, rid long, a long, rel int, alone boolean, content binary")
    segments = cut(segments, "segments")
    crowded = per_f.where(F.col("kinds") > hot).select("f")
    n = segments.count()
    if n == 0:
        return whole
    usual = segments.join(crowded, "f", "left_anti").withColumn("batch", F.pmod(F.xxhash64("f"), F.lit(-(-n // batch))))
    spans = usual.groupBy("batch").applyInArrow(_sort_batch(length), "rid long, s long, e long")
    # too many different segments for a batch: count the strings themselves
    strings = segments.join(crowded, "f", "left_semi").mapInArrow(_window_digests(length), "f long, digest binary, rid long, s long, alone boolean")
    twice = strings.groupBy("f", "digest").agg(F.count("*").alias("n")).where("n > 1").select("f", "digest")
    counted = strings.where("alone").join(twice, ["f", "digest"]).select("rid", "s", F.col("s").alias("e"))
    return whole.unionByName(spans).unionByName(counted)


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batch: int = BATCH, hot: int = HOT,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, text and spans, the maximal byte ranges [s, e) covered by repeated strings.

    ``docs`` must be a table read from storage, as its rows are numbered in
    several scans.  Null text counts as empty; texts shorter than ``length``
    have no span; repeated rows repeat each other; a string that overlaps
    itself counts; other columns are not read; an empty table gives no rows.
    """
    pin_splits(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    starts = cut(repeated_starts(rows, length, gram, batch, hot), "starts")
    spans = starts.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("s", (F.col("e") + length).alias("e")))).alias("spans"))
    named = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                        F.monotonically_increasing_id().alias("rid"))
    return named.join(spans, "rid", "left").select("id", "text", merge_spans()("spans").alias("spans"))


def merge_spans():
    """Column function: sorted ranges, those that overlap or touch made one."""
    @F.arrow_udf("array<struct<s:bigint,e:bigint>>")
    def merge(spans: pa.Array) -> pa.Array:
        out = []
        for row in spans.to_pylist():
            merged: list[dict] = []
            for x in row or []:
                if merged and x["s"] <= merged[-1]["e"]:
                    merged[-1]["e"] = max(merged[-1]["e"], x["e"])
                else:
                    merged.append(dict(x))
            out.append(merged)
        return pa.array(out, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))
    return merge


def kept_bytes():
    """Column function of (text, spans): the bytes outside the spans."""
    @F.arrow_udf("binary")
    def kept(text: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for data, row in zip(text.cast(pa.binary()).to_pylist(), spans.to_pylist()):
            at, parts = 0, []
            for x in row:
                parts.append(data[at:x["s"]])
                at = x["e"]
            out.append(b"".join(parts) + data[at:])
        return pa.array(out, pa.binary())
    return kept
