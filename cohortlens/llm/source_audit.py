"""op12: how the vocabularies of sources differ, by a minimal acyclic transducer of the kept terms.

Document frequencies name the kept terms of each language.  Sorted, they are
built into transducers in ranges of ``PIECE`` terms (one task each); joined,
they map (language, term) to its ordinal in byte order.  All texts then stream
through the transducer, which recounts the kept terms per group; ordinals
break ties and are turned back into terms at the end.  A transducer of at most
``MOST_BYTES`` is broadcast at a time; a larger vocabulary takes several
passes, each over the texts of its languages only.  Shares are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.llm import transducer
from cohortlens.llm.common import cut
from cohortlens.llm.hashing import LOWER, text_bytes, word_windows

#: Bytes of terms, which are runs of ASCII letters (lower-cased here) and of anything beyond ASCII.
LETTERS = ((np.arange(256) >= 97) & (np.arange(256) <= 122)) | (np.arange(256) >= 128)
#: Ends a language in a key; terms have no such character.
MARK = "\x00"
#: Terms that one task builds a transducer of, about.
PIECE = 8_192
#: Bytes of packed transducers that the driver joins and broadcasts at a time.
MOST_BYTES = 64 << 20
#: Bytes of text of which a task takes the distinct terms at once, unless a single word is longer.
STRETCH = 4 << 20
#: Cells (groups x terms) that one task compares at once, unless a language has more groups.
CELLS = 1 << 16


@dataclass(frozen=True)
class Params:
    """A term is kept in a language where ``min_docs`` of its documents have it; ``smoothing`` is added to every count."""

    min_docs: int = 30
    smoothing: int = 5
    unit: int = 1_000_000_000
    top: int = 50


@dataclass(frozen=True)
class Piece:
    """A packed transducer, the first of its ordinals, and its first and last key."""

    base: int
    low: str
    high: str
    blob: bytes


def _plain(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    empty = F.lit("")
    return docs.select(*[F.coalesce(F.col(c).cast("string"), empty).alias(n)
                         for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])


def _distinct_terms(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Each row's distinct words: row numbers and the words beside them."""
    inside = np.zeros(ends[-1] - starts[0] + 1, np.int8)
    inside[starts - starts[0]] += 1
    inside[ends - starts[0]] -= 1
    letters = low[starts[0]:ends[-1]][np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(letters)).dictionary_encode()
    size = len(words.dictionary)
    pairs = np.unique(rows * size + words.indices.to_numpy())
    return pairs // size, words.dictionary.take(pa.array(pairs % size))


def _term_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, term, n_docs of the documents of a stretch of text; a document that spans several stretches counts once."""
    def frame(lang, term, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(term, pa.string()), pa.array(n, pa.int64())], ["lang", "term", "n_docs"])

    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        names, code = langs.dictionary, langs.indices.to_numpy()
        data, offsets = text_bytes(batch.column("text"))
        low = LOWER[data]
        open_row, open_terms = -1, set()
        for starts, ends, rows in word_windows(low, offsets, LETTERS, STRETCH):
            if not len(starts):
                continue
            row, term = _distinct_terms(low, starts, ends, rows)
            # the first row may go on from the stretch before, the last one may go on in the next
            for r in sorted({int(row[0]), int(row[-1])}):
                if r != open_row:
                    if open_terms:
                        yield frame([names[code[open_row]].as_py()] * len(open_terms), sorted(open_terms), [1] * len(open_terms))
                    open_row, open_terms = r, set()
                lo, hi = np.searchsorted(row, [r, r + 1])
                open_terms.update(term[lo:hi].to_pylist())
            lo, hi = np.searchsorted(row, row[0], "right"), np.searchsorted(row, row[-1])
            if lo < hi:
                words = term[lo:hi].dictionary_encode()
                size = len(words.dictionary)
                cells, n = np.unique(code[row[lo:hi]].astype(np.int64) * size + words.indices.to_numpy(), return_counts=True)
                yield frame(names.take(pa.array(cells // size)), words.dictionary.take(pa.array(cells % size)).cast(pa.string()), n)
        if open_terms:
            yield frame([names[code[open_row]].as_py()] * len(open_terms), sorted(open_terms), [1] * len(open_terms))


def kept_terms(rows: DataFrame, p: Params = Params()) -> DataFrame:
    """lang, term of the terms that enough documents of a language have."""
    found = rows.select("lang", "text").mapInArrow(_term_documents, "lang string, term string, n_docs long")
    found = found.groupBy("lang", "term").agg(F.sum("n_docs").alias("n_docs"))
    return cut(found.where(F.col("n_docs") >= p.min_docs).select("lang", "term"), "kept-terms")


def _build_piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = {"n": 0, "low": None, "high": None}

    def keys():
        for batch in batches:
            for key in batch.column("key").to_pylist():
                seen.update(n=seen["n"] + 1, low=key if seen["low"] is None else seen["low"], high=key)
                yield key.encode()

    blob = transducer.build(keys())
    if seen["n"]:
        yield pa.RecordBatch.from_pylist([{"low": seen["low"], "high": seen["high"], "n": seen["n"], "blob": blob}])


def vocabulary(terms: DataFrame) -> DataFrame:
    """low, high, n, blob: a transducer per range of sorted keys (language, mark, term)."""
    keys = terms.select(F.concat("lang", F.lit(MARK), "term").alias("key"))
    n_pieces = max(1, -(-terms.count() // PIECE))
    ranges = keys.repartitionByRange(n_pieces, "key").sortWithinPartitions("key")
    return cut(ranges.mapInArrow(_build_piece, "low string, high string, n long, blob binary"), "vocabulary")


def passes(pieces: DataFrame, most_bytes: int = MOST_BYTES) -> Iterator[list[Piece]]:
    """The pieces in order, some ``most_bytes`` at a time; only these reach the driver together."""
    # one short row per some thousand terms
    index = pieces.select("low", "n", F.octet_length("blob").alias("size")).orderBy("low").collect()
    at, base = 0, 0
    while at < len(index):
        to, size = at + 1, index[at]["size"]
        while to < len(index) and size + index[to]["size"] <= most_bytes:
            size += index[to]["size"]
            to += 1
        got = pieces.where((F.col("low") >= index[at]["low"]) & (F.col("low") <= index[to - 1]["low"])).orderBy("low").collect()
        group = []
        for r in got:
            group.append(Piece(base, r["low"], r["high"], bytes(r["blob"])))
            base += r["n"]
        yield group
        at = to


def _recount(shared):
    """Per batch: lang, source, ord (global) and n of the kept terms found."""
    def run(batches):
        base, machine = shared.value
        for batch in batches:
            names = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist()))
            groups = {g: i for i, g in enumerate(dict.fromkeys(names))}
            group_of = np.array([groups[g] for g in names], np.int64)
            begins = {lang: machine.walk((lang + MARK).encode()) for lang in {g[0] for g in groups}}
            state = np.array([begins[g[0]][0] for g in names], np.int64)
            before = np.array([begins[g[0]][1] for g in names], np.int64)
            data, offsets = text_bytes(batch.column("text"))
            cells, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
            parts = []
            low = LOWER[data]
            for starts, ends, rows in word_windows(low, offsets, LETTERS):
                words, ordinal = machine.ordinals(low, starts, ends, state[rows], before[rows])
                parts.append(np.unique(group_of[rows[words]] * machine.size + ordinal, return_counts=True))
                if len(parts) == 16:
                    cells, sums = _added(cells, sums, parts)
                    parts = []
            cells, sums = _added(cells, sums, parts)
            if len(cells):
                of = cells // machine.size
                langs, sources = (pa.array([g[i] for g in groups], pa.string()).take(pa.array(of)) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([langs, sources, pa.array(cells % machine.size + base), pa.array(sums)], ["lang", "source", "ord", "n"])
    return run


def _added(cells: np.ndarray, sums: np.ndarray, parts: list) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([cells, *[k for k, _ in parts]])
    n = np.concatenate([sums, *[c for _, c in parts]])
    out, place = np.unique(keys, return_inverse=True)
    return out, np.bincount(place, n, len(out)).astype(np.int64)


def recount(rows: DataFrame, pieces: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """lang, source, ord, n: occurrences of every kept term in every group that has it."""
    sc = rows.sparkSession.sparkContext
    found = None
    for group in passes(pieces, most_bytes):
        shared = sc.broadcast((group[0].base, transducer.join([g.blob for g in group])))
        # only languages with keys between the first and the last one
        mine = rows.where((F.concat("lang", F.lit(MARK)) <= group[-1].high) & (F.concat("lang", F.lit("\x01")) > group[0].low))
        part = mine.mapInArrow(_recount(shared), "lang string, source string, ord long, n long")
        part = cut(part.groupBy("lang", "source", "ord").agg(F.sum("n").alias("n")), "term-counts")
        found = part if found is None else found.union(part)
        shared.destroy()
    empty = rows.sparkSession.createDataFrame([], "lang string, source string, ord long, n long")
    return empty if found is None else found


def _name_terms(shared):
    def run(batches):
        base, machine = shared.value
        for batch in batches:
            ords = batch.column("ord").to_numpy()
            names = {o: machine.key(int(o) - base).rsplit(MARK.encode(), 1)[-1].decode() for o in np.unique(ords)}
            at = batch.schema.get_field_index("item")
            yield batch.set_column(at, "item", pa.array([names[o] for o in ords], pa.string()))
    return run


def name_terms(rows: DataFrame, pieces: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``rows`` (with ord and a null item) with the terms of their ordinals."""
    sc, out = rows.sparkSession.sparkContext, None
    for group in passes(pieces, most_bytes):
        machine = transducer.join([g.blob for g in group])
        shared = sc.broadcast((group[0].base, machine))
        mine = rows.where(F.col("ord").between(group[0].base, group[0].base + machine.size - 1))
        part = cut(mine.mapInArrow(_name_terms(shared), rows.schema), "named-terms")
        out = part if out is None else out.union(part)
        shared.destroy()
    return rows if out is None else out


def share(n: Column, total: Column, terms: Column, p: Params) -> Column:
    """1 + floor(unit * (n + smoothing) / (total + smoothing * terms)), in exact integers."""
    top = F.lit(p.unit).cast("decimal(12,0)") * (n + p.smoothing).cast("decimal(24,0)")
    below = (total + p.smoothing * terms).cast("decimal(24,0)")
    return 1 + F.call_function("div", top, below)


def _compare_block(key, block):
    """Sums of |share - share| over one block of terms, for every two of a language's groups; x < y."""
    absent = block["ord"].to_numpy() < 0
    gid, value, term = (block[c].to_numpy() for c in ("gid", "share", "ord"))
    by = np.argsort(gid[absent])
    groups, baseline = gid[absent][by], value[absent][by]
    _, column = np.unique(term[~absent], return_inverse=True)
    shares = np.repeat(baseline[:, None], column.max() + 1, axis=1)
    shares[np.searchsorted(groups, gid[~absent]), column] = value[~absent]
    x, y, f = [], [], []
    for i in range(len(groups) - 1):
        x.append(np.full(len(groups) - 1 - i, groups[i]))
        y.append(groups[i + 1:])
        f.append(np.abs(shares[i + 1:] - shares[i]).sum(1))
    none = [np.zeros(0, np.int64)]
    x, y, f = (np.concatenate(c or none) for c in (x, y, f))
    return pa.table({"lang": pa.array([key[0].as_py()] * len(x), pa.string()), "x": x, "y": y, "f": f})


def source_audit(docs: DataFrame, p: Params = Params(), text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                 most_bytes: int = MOST_BYTES) -> DataFrame:
    """lang, source, part, item, value, rank: how far sources of a language are apart, and what marks each.

    ``pair``: every other source of the language with the summed difference of
    both vocabularies' shares.  ``term``: the ``top`` terms whose share in the
    group is above the language's.  Nulls in any of the three columns count as
    empty strings, which are a language or a source of their own; texts
    without terms and groups without kept terms take part with counts of 0; a
    language without kept terms has pairs of value 0 and no terms.  Ties go by
    the item's bytes; repeated rows count each time; other columns are not
    read; an empty table gives no rows.
    """
    rows = _plain(docs, text_col, lang_col, source_col)
    terms = kept_terms(rows, p)
    pieces = vocabulary(terms)
    found = cut(recount(rows, pieces, most_bytes), "found-terms")
    kept = terms.groupBy("lang").agg(F.count("*").alias("n_terms"))
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = (rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(kept, "lang", "left")
              .fillna(0, ["total", "n_terms"]))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long")
    groups = cut(groups.withColumn("gid", number), "groups")
    per_lang = cut(groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count("*").alias("n_groups")), "languages")

    # terms: share in the group above the share in the language
    lang_counts = found.groupBy("lang", "ord").agg(F.sum("n").alias("lang_n"))
    cells = (found.join(groups, ["lang", "source"]).join(per_lang, "lang")
             .withColumn("share", share(F.col("n"), F.col("total"), F.col("n_terms"), p)))
    cells = cut(cells, "shares")
    above = cells.join(lang_counts, ["lang", "ord"]).withColumn(
        "value", F.col("share") - share(F.col("lang_n"), F.col("lang_total"), F.col("n_terms"), p)).where("value > 0")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ord"))
    best = above.withColumn("rank", place).where(F.col("rank") <= p.top)
    best = cut(best.select("lang", "source", F.lit("term").alias("part"), F.lit(None).cast("string").alias("item"), "value", "rank", "ord"), "best-terms")
    best = name_terms(best, pieces, most_bytes).drop("ord")

    # pairs: blocks of terms, each with every group's share of an absent term
    block = F.floor(F.col("ord") / F.greatest(F.lit(64), F.floor(F.lit(CELLS) / F.col("n_groups"))))
    cells = cells.select("lang", block.alias("block"), "gid", "ord", "share")
    absent = (cells.select("lang", "block").distinct().join(groups, "lang")
              .select("lang", "block", "gid", F.lit(-1).cast("long").alias("ord"), share(F.lit(0).cast("long"), F.col("total"), F.col("n_terms"), p).alias("share")))
    sums = cells.unionByName(absent).groupBy("lang", "block").applyInArrow(_compare_block, "lang string, x long, y long, f long")
    sums = cut(sums.groupBy("lang", "x", "y").agg(F.sum("f").alias("value")), "differences")
    both = sums.union(sums.select("lang", F.col("y").alias("x"), F.col("x").alias("y"), "value"))
    # languages without kept terms: nothing to sum, only the pairs themselves
    bare = groups.where("n_terms = 0").select("lang", F.col("gid").alias("x"))
    both = both.union(bare.join(bare.withColumnRenamed("x", "y"), "lang").where("x <> y").select("lang", "x", "y", F.lit(0).cast("long")))
    one = groups.select("lang", F.col("gid").alias("x"), "source")
    other = groups.select("lang", F.col("gid").alias("y"), F.col("source").alias("item"))
    order = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = both.join(one, ["lang", "x"]).join(other, ["lang", "y"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value", order.alias("rank"))
    return pairs.unionByName(best)
