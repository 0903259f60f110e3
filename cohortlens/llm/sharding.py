"""op8: two-pass external shuffle into shards of equal row counts.

Pass 1 scatters rows into buckets of bounded size by a seeded hash; pass 2
permutes every bucket (Fisher-Yates, seeded by the bucket) inside one task and
numbers its rows.  Bucket offsets turn these numbers into one global random
order, which is cut into shards whose row counts differ by one at most
(law ``rows``).  Copies of one row that would fill a bucket by themselves are
scattered by their place in the input instead, so they go to all buckets alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F, types as T

from cohortlens.llm.common import pin_splits, scratch

#: Columns that the operator adds; input columns of these names are replaced.
ADDED = ("size", "text_crc32", "shard", "slot")
ROW_OVERHEAD = 16
#: Buckets at most; beyond, buckets grow. The offsets of so many (16 bytes each) are broadcast.
MOST_BUCKETS = 1 << 20
_INNER = ("__order", "__bucket", "__pos", "__id", "__crc", "__size", "__hot")


def _fisher_yates(seed: int):
    def run(key, group):
        import numpy as np
        import pyarrow as pa
        bucket = key[0].as_py()
        # arrival order depends on the shuffle: start from an order of the rows' own
        keys = [("__order", "ascending"), ("text_crc32", "ascending"), ("size", "ascending")]
        group = group.sort_by(keys)
        order = np.arange(group.num_rows)
        np.random.default_rng([seed, bucket]).shuffle(order)
        group = group.take(pa.array(order))
        at = group.schema.get_field_index("__pos")
        return group.set_column(at, "__pos", pa.array(np.arange(group.num_rows), pa.int64()))
    return run


def shard_rows(docs: DataFrame, n_shards: int = 40, seed: int = 8, bucket_bytes: int = 16 << 20,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` in a seeded random order, cut into ``n_shards`` shards.

    Adds size (UTF-8 bytes + 16), text_crc32, shard and slot (position in the
    shard, from 0); input columns of these names are replaced.  Null text has
    size 16 and CRC 0.  Rows with a null id, and rows of which copies fill a
    bucket, are scattered by their place in the input (whose splits are pinned
    for the session), others by their id and text, so reruns agree on the same
    table; equal rows may swap places.  With fewer rows than shards the last
    shards stay empty; an empty table gives no rows.
    """
    pin_splits(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.drop(*[c for c in docs.columns if c.lower() in (*ADDED, *_INNER)])
    rows = rows.select("*", (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    n_buckets = min(max(1, -(-total // bucket_bytes)), MOST_BUCKETS)
    same = [F.col(id_col).alias("__id"), F.col("text_crc32").alias("__crc"), F.col("size").alias("__size")]
    # copies of one row that fill a bucket: no more such rows than buckets
    hot = rows.select(*same).groupBy("__id", "__crc", "__size").count().where(F.col("count") * F.col("__size") > -(-total // n_buckets))
    hot = F.broadcast(hot.select("__id", "__crc", "__size", F.lit(True).alias("__hot")))
    rows = rows.join(hot, (rows[id_col] == hot["__id"]) & (rows["text_crc32"] == hot["__crc"]) & (rows["size"] == hot["__size"]), "left")
    place = F.when(F.col(id_col).isNull() | F.col("__hot"), F.monotonically_increasing_id())
    order = F.xxhash64(F.lit(seed), F.col(id_col), F.octet_length(text), place).alias("__order")
    rows = rows.select("*", order).drop("__id", "__crc", "__size", "__hot")
    bucket = F.pmod("__order", F.lit(n_buckets)).alias("__bucket")
    # one row per bucket: total size / bucket size of them, MOST_BUCKETS at most
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.select(bucket).groupBy("__bucket").agg(F.count("*").alias("__n"))
               .select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset")))
    rows = rows.select("*", bucket, F.lit(0).cast("long").alias("__pos"))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
    mixed = rows.groupBy("__bucket").applyInArrow(_fisher_yates(seed), schema).join(F.broadcast(offsets), "__bucket")
    base, extra = divmod(n, n_shards)
    at, wide = F.col("__offset") + F.col("__pos"), extra * (base + 1)
    low, high = F.lit(base + 1), F.lit(max(base, 1))
    first = at < wide
    shard = F.when(first, F.floor(at / low)).otherwise(extra + F.floor((at - wide) / high)).cast("int")
    slot = F.when(first, F.pmod(at, low)).otherwise(F.pmod(at - wide, high)).cast("long")
    return mixed.select("*", shard.alias("shard"), slot.alias("slot")).drop("__order", "__bucket", "__pos", "__offset")


def write_shards(shards: DataFrame, path: str | None = None) -> str:
    """Write Parquet files under ``path/shard=<n>``; their rows carry the slot."""
    path = path or scratch(shards.sparkSession, "shards")
    shards.write.partitionBy("shard").parquet(path)
    return path
