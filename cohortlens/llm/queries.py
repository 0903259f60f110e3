"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.llm.chat_format import format_chat, read_back
from cohortlens.llm.common import cut, table
from cohortlens.llm.decontaminate import contamination
from cohortlens.llm.exact_dedup import exact_dedup
from cohortlens.llm.fill_middle import fill_in_middle, restore
from cohortlens.llm.jaccard_join import similar_sets
from cohortlens.llm.license_scan import license_scan
from cohortlens.llm.mixing import mix
from cohortlens.llm.quality import quality
from cohortlens.llm.sharding import shard_rows, write_shards
from cohortlens.llm.source_audit import source_audit
from cohortlens.llm.suffix_dedup import kept_bytes, repeated_spans
from cohortlens.llm.toxicity import toxicity
from cohortlens.llm.warc import lookup, url_keys, write_archive


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of all documents."""
    return license_scan(table(spark, sf_dir, "documents")).drop("places")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates among all documents."""
    return exact_dedup(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents."""
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and looked up again by their URL keys."""
    pages = table(spark, sf_dir, "pages")
    folder, top = write_archive(pages)
    keys = pages.select(url_keys(F.col("url")).alias("key"), F.monotonically_increasing_id().alias("rid"))
    return lookup(keys, folder, top, payload=False).drop("rid")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """400-byte strings that occur more than once in all documents, removed."""
    out = repeated_spans(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return out.select(F.col("id").alias("doc_id"), F.octet_length("text").cast("long").alias("n_bytes"), removed.alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2(kept_bytes()("text", "spans"), 256).alias("kept_sha256"))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to source weights 5, 2, 1."""
    out = mix(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards, written and read back."""
    path = write_shards(shard_rows(table(spark, sf_dir, "documents"), 40))
    out = spark.read.schema("doc_id long, size long, text_crc32 long, shard int, slot long").parquet(path)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of similar documents among all."""
    out = similar_sets(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one with control strings in its texts, formatted, written and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return read_back(cut(format_chat(rows.unionByName(extra)), "chat"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents rewritten for filling in the middle, and rebuilt."""
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    rebuilt = restore(F.col("output"), F.col("form"))
    return out.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                      F.sha2(rebuilt.cast("binary"), 256).alias("restored_sha256"))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of all sources of every language."""
    return source_audit(table(spark, sf_dir, "documents"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_exact_dedup, op3_decontaminate, op4_toxicity, op5_warc, op6_suffix_dedup, op7_mix, op8_shard, op9_jaccard,
                                  op10_chat_format, op11_fill_middle, op12_source_audit, op13_quality)}
