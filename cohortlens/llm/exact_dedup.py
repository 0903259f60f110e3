"""op2: exact de-duplication by a tree merge of sorted digest runs.

Every input partition is a run of (digest, best row, count).  Runs are merged
in rounds: in round r, ``fan_in`` neighbouring runs become one, keyed by
(digest, run number div fan_in^r), so that a digest which fills a third of all
rows meets at most ``fan_in`` partial rows at any merge.  Each level keeps the
smallest verified candidate; the winners then go down the same tree to the
rows, again at most ``fan_in`` to one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortlens.llm.common import cut

#: Characters that do not count when texts are compared.
BLANKS = r"[\x20\x09-\x0D]+"
KEY = ["digest", "n_norm", "check"]


def digest_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: run number, digest and verification values, rank of the row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    norm = F.regexp_replace(text, BLANKS, "")
    return (docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("rid"),
                        F.spark_partition_id().alias("run"), F.length(text).alias("cp"), norm.alias("norm"))
            .select("rid", "run",
                    F.unhex(F.sha2("norm", 256)).alias("digest"), F.octet_length("norm").alias("n_norm"),
                    F.xxhash64("norm").alias("check"),
                    F.struct((-F.col("cp")).alias("neg_cp"), F.col("id").isNull().alias("no_id"), "id", "rid").alias("best")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16) -> DataFrame:
    """Groups of equal texts and the row of each that stays.

    Texts are equal when identical without ASCII white space; rows count as
    equal only if SHA-256, length and a second hash all agree.  Of a group the
    row with the most code points, then the smallest id stays.

    Returns per input row: id, keep_id, group_size, kept, text_sha256.
    Null text counts as empty (one group with texts of white space only);
    a null id ranks last; rows that tie in all of it (repeated rows) keep one,
    the first in file order; an empty table gives no rows; other columns are
    not read, so their names cannot clash.
    """
    rows = cut(digest_runs(docs, id_col, text_col), "digests")
    top_run = rows.agg(F.max("run")).first()[0] or 0
    level = (rows.groupBy(*KEY, F.col("run").alias("node"))
             .agg(F.min("best").alias("best"), F.count("*").alias("n")))
    levels, last = [level], top_run
    while last > 0:
        last //= fan_in
        level = (level.withColumn("node", F.expr(f"node div {fan_in}").cast("int")).groupBy(*KEY, "node")
                 .agg(F.min("best").alias("best"), F.sum("n").alias("n")))
        levels.append(level)
    winner = levels.pop()
    while levels:
        below = levels.pop().select(*KEY, F.col("node").alias("sub"), F.expr(f"node div {fan_in}").cast("int").alias("node"))
        winner = below.join(winner, [*KEY, "node"]).drop("node").withColumnRenamed("sub", "node")
    out = rows.select("rid", "best.id", *KEY, F.col("run").alias("node")).join(winner, [*KEY, "node"])
    return out.select("id", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"),
                      (F.col("rid") == F.col("best.rid")).alias("kept"),
                      F.lower(F.hex("digest")).alias("text_sha256"))
