"""op3: benchmark decontamination with a broadcast set of n-gram hashes.

Each benchmark item gives its windows of ``n`` words (one shorter window if the
item is shorter).  The distinct windows, keyed by hash, are broadcast after
their count is checked; every document is exploded once into token windows
that probe the set inside one codegen stage; matches are verified word by word.
Only hits and one row per document reach the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortlens.llm.common import pin_splits, words

#: Bytes of windows and item ids that are broadcast at most, and what a window takes besides its letters, about.
MOST_BROADCAST_BYTES, WINDOW_BYTES = 256 << 20, 200


def item_windows(benchmark: DataFrame, n: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows: n_win, win (words), key, items (sorted ids as strings)."""
    w = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w"))
    w = w.where(F.size("w") > 0).select("item", "w", F.least(F.size("w"), F.lit(n)).alias("n_win"))
    w = w.select("item", "w", "n_win", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n_win") + 1)).alias("at"))
    return (w.select("item", "n_win", F.slice("w", F.col("at"), F.col("n_win")).alias("win"))
            .groupBy("n_win", "win").agg(F.sort_array(F.collect_set("item")).alias("items"))
            .select("n_win", "win", F.xxhash64("win").alias("key"), "items"))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  keep: tuple[str, ...] = (), max_broadcast_windows: int = 2_000_000) -> DataFrame:
    """Per document: id, n_words, n_hit, items (sorted), spans (merged word ranges), contaminated.

    A word is hit if any occurrence of a benchmark window covers it.  ``keep``
    names further columns to carry along.  Null or wordless texts have no
    words and no hits; items without words have no window; null item ids do
    not count as items but their windows still hit; repeated documents are
    judged row by row; an empty benchmark hits nothing.  Above
    ``max_broadcast_windows`` windows, or ``MOST_BROADCAST_BYTES`` of them, the
    probe is a shuffled join instead of a broadcast one, with the same result.
    """
    grams = item_windows(benchmark, n)
    size = F.sum(F.octet_length(F.array_join("win", " ")) + F.octet_length(F.array_join("items", " ")) + WINDOW_BYTES)
    n_grams, lengths, n_bytes = grams.agg(F.count("*"), F.collect_set("n_win"), size).first()
    lengths = sorted(lengths) or [n]
    few = n_grams <= max_broadcast_windows and (n_bytes or 0) <= MOST_BROADCAST_BYTES
    kept = F.struct(F.lit(0).alias("none"), *keep)
    pin_splits(docs.sparkSession)
    docs_ = docs.select(F.col(id_col).alias("id"), kept.alias("kept"), F.monotonically_increasing_id().alias("rid"),
                        words(F.col(text_col)).alias("w"))
    # outer: rows of wordless documents stay
    rows = docs_.select("*", F.posexplode_outer("w").alias("pos", "word")).drop("word")
    rows = rows.withColumn("len", F.lit(lengths[0]) if len(lengths) == 1 else F.explode(F.array(*map(F.lit, lengths))))
    rows = rows.withColumn("gram", F.slice("w", F.col("pos") + 1, F.col("len")))
    rows = rows.withColumn("probe", F.when(F.size("gram") == F.col("len"), F.xxhash64("gram")))
    if not few:
        return _merged(_shuffled_hits(docs_, rows, grams), id_col, keep)
    hit = rows.join(F.broadcast(grams), (rows.probe == grams.key) & (rows.len == grams.n_win), "left")
    real = F.coalesce(F.col("gram") == F.col("win"), F.lit(False))
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    # what a document carries along travels once, on its first row
    hit = hit.where(real | first).select(
        "rid", F.when(first, F.struct("id", "kept", F.size("w").alias("n"))).alias("doc"),
        F.when(real, F.struct(F.col("pos").alias("s"), (F.col("pos") + F.col("len")).alias("e"))).alias("span"),
        F.when(real, F.col("items")).alias("items"))
    return _merged(hit, id_col, keep)


def _shuffled_hits(docs: DataFrame, rows: DataFrame, grams: DataFrame) -> DataFrame:
    """Hits where the windows are too many to broadcast: only windows and places are shuffled, documents join by their place."""
    probes = rows.where("probe IS NOT NULL").select("rid", "pos", "len", "probe", "gram")
    hit = probes.join(grams, (probes.probe == grams.key) & (probes.len == grams.n_win) & (probes.gram == grams.win))
    spans = hit.select("rid", F.struct(F.col("pos").alias("s"), (F.col("pos") + F.col("len")).alias("e")).alias("span"), "items")
    whole = docs.select("rid", F.struct("id", "kept", F.size("w").alias("n")).alias("doc"))
    none = whole.select("rid", "doc", F.lit(None).cast("struct<s:int,e:int>").alias("span"), F.lit(None).cast("array<string>").alias("items"))
    spans = spans.withColumn("doc", F.lit(None).cast(whole.schema["doc"].dataType))
    return none.unionByName(spans)


def _merged(hit: DataFrame, id_col: str, keep: tuple[str, ...]) -> DataFrame:
    """One row per document: spans that overlap or touch become one, items are sorted."""
    by_doc = hit.groupBy("rid").agg(
        F.first("doc", ignorenulls=True).alias("doc"), F.sort_array(F.collect_set("span")).alias("hits"),
        F.flatten(F.collect_set("items")).alias("items"))
    merged = F.aggregate(
        "hits", F.array().cast("array<struct<s:int,e:int>>"),
        lambda acc, h: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["e"] >= h["s"]),
                              F.concat(F.slice(acc, 1, F.size(acc) - 1),
                                       F.array(F.struct(F.element_at(acc, -1)["s"].alias("s"),
                                                        F.greatest(F.element_at(acc, -1)["e"], h["e"]).alias("e")))))
        .otherwise(F.concat(acc, F.array(h))))
    out = by_doc.withColumn("spans", merged).withColumn("items", F.sort_array(F.array_distinct("items")))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["e"] - s["s"])
    return out.select(F.col("doc.id").alias(id_col), *[F.col(f"doc.kept.{c}").alias(c) for c in keep],
                      F.col("doc.n").cast("long").alias("n_words"), n_hit.alias("n_hit"), "items", "spans",
                      (F.size("spans") > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without benchmark windows, all columns as they were.

    Null, empty and wordless texts stay; repeated rows are judged one by one;
    names may clash with inner ones; an empty benchmark removes nothing, an
    empty table gives no rows.
    """
    names = docs.columns
    judged = contamination(docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)]), benchmark, n,
                           id_col="c0", text_col=f"c{names.index(text_col)}",
                           keep=tuple(f"c{i}" for i in range(1, len(names))))
    return judged.where(~F.col("contaminated")).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
