"""Adapters from the driver's test tables to the cohort data model.

The driver ships TPC-H-like tables, not clinical ones.  These adapters derive
the F1..F7 shapes of FIXTURES.md from them with plain column expressions, so
every registered query reads the given tables and grows with them.  NULLs
are injected by modulus of the key (the source tables have none).

The same definitions are written as SQL in ``cohortlens.plans.oracle`` for the
DuckDB oracle; keep the two in step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.functions.hashing import uniform


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _null_when(cond, value):
    return F.when(cond, F.lit(None)).otherwise(value)


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 scan-level clinical table from ``orders`` (one row per order)."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    k, c, price, status = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice"), F.col("o_orderstatus")
    order_w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    lung_cancer = F.when(status == "F", 1).when(status == "O", 0).cast("int")
    return o.select(
        F.col("o_custkey").cast("string").alias("pid"),
        k.alias("rid"),
        _null_when(k % 101 == 0, F.col("o_orderdate").cast("date")).alias("scandate"),
        (F.row_number().over(order_w) - 1).cast("int").alias("scanorder"),
        (F.lit(40) + c % 40).cast("double").alias("age"),
        _null_when(k % 5 == 0, F.lit(18) + price / 25000).cast("double").alias("bmi"),
        _null_when(k % 3 == 0, (k % 30).cast("double")).alias("quit_time"),
        _null_when(k % 11 == 0, (F.lit(10) + c % 35).cast("double")).alias("smo_duration"),
        _null_when(k % 13 == 0, price / 5000).cast("double").alias("smo_intensity"),
        _null_when(k % 7 == 0, price / 10000).cast("double").alias("pkyr"),
        (F.lit(1) + c % 2).cast("int").alias("gender"),
        (c % 7).cast("int").alias("race"),
        _null_when(k % 17 == 0, (k % 2).cast("int")).alias("copd"),
        F.when(k % 3 == 1, 1).otherwise(0).cast("int").alias("emphysema"),
        F.when(c % 5 == 0, 1).otherwise(0).cast("int").alias("phist"),
        _null_when(k % 19 == 0, F.when(c % 3 == 0, 1).otherwise(0)).cast("int").alias("fhist"),
        F.when(k % 4 == 1, 1).otherwise(0).cast("int").alias("smo_status"),
        (k % 365).cast("int").alias("duration"),
        _null_when(k % 6 == 0, (k * 7) % 2000 - 300).cast("int").alias("scan_fup_days"),
        lung_cancer.alias("lung_cancer"),
        F.when(status == "P", F.lit(None)).when((status == "F") & (k % 3 == 0), 1)
         .otherwise(0).cast("int").alias("cancer_year1"),
        F.when((status == "F") & (k % 3 == 0), "adenocarcinoma")
         .when((status == "F") & (k % 3 == 1), "squamous cell carcinoma").alias("lc_subtype"),
        _null_when(k % 6 == 0, (k * 7) % 2000 - 300).cast("int").alias("fup_days"),
        (F.lit(1) + (k % 9) * F.lit(0.5)).cast("double").alias("slice_thickness"),
        _null_when(k % 4 == 0, (k % 23).cast("double") * 1.5).alias("nodule_size"),
        _null_when(k % 4 == 0, (k % 7).cast("double")).alias("nodule_count"),
    )


def test_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 held-out list from ``customer``: ~20% of patients, duplicates, unknown pids."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    key = F.col("c_custkey")
    chosen = c.where(uniform(F.lit("test"), key) < 0.2)
    rows = chosen.select(key.cast("string").alias("patient_id"), (key % 3).cast("int").alias("study_yr"))
    dups = chosen.where(key % 4 == 0).select(
        key.cast("string").alias("patient_id"), (key % 3).cast("int").alias("study_yr"))
    absent = c.where(key % 50 == 0).select(
        (key + 100000000).cast("string").alias("patient_id"), F.lit(0).cast("int").alias("study_yr"))
    return rows.unionByName(dups).unionByName(absent)


def _vec_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as a scan: each 15 in a row are five patients with 1 to 5 scans."""
    e = table(spark, sf_dir, "embeddings")
    m = F.col("vec_id") % 15
    j = F.when(m < 1, 0).when(m < 3, 1).when(m < 6, 2).when(m < 10, 3).otherwise(4)
    return e.select(
        F.col("vec_id"), (F.expr("vec_id div 15") * 5 + j).alias("k"),
        (m - (j * (j + 1) / 2).cast("int")).cast("int").alias("slot"),
        F.col("embedding").alias("vec"), F.col("label"))


def vec_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan table of the vector fixtures: patient k has 1 to 5 scans, no embedding is left out."""
    b = _vec_base(spark, sf_dir)
    scandate = F.date_add(F.lit("2000-01-01").cast("date"), (F.col("slot") * 200 + F.col("k") % 50).cast("int"))
    vid = F.col("vec_id")
    return b.select(
        F.concat(F.lit("p"), F.col("k").cast("string")).alias("pid"),
        vid.alias("rid"),
        F.col("slot").alias("scanorder"),
        scandate.alias("scandate"),
        F.date_sub(scandate, (vid % 3).cast("int")).alias("shifted_scandate"),
        (F.col("label") % 2).cast("int").alias("lung_cancer"),
        (F.lit(40) + F.col("k") % 40).cast("double").alias("age"),
        _null_when(vid % 6 == 1, (F.lit(20) + (vid % 13) * F.lit(0.5)).cast("double")).alias("bmi"),
        (F.col("k") % 2).cast("int").alias("gender"),
        ((F.col("k") + 1) % 2).cast("int").alias("smo_status"),
    )


def scan_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pid, scan_key yyyyMMdd, vec) for every kept scan."""
    s = vec_scans(spark, sf_dir)
    vecs = _vec_base(spark, sf_dir).select("vec_id", "vec")
    return s.join(vecs, s.rid == vecs.vec_id).select(
        "pid", F.date_format("scandate", "yyyyMMdd").alias("scan_key"), "vec")


def text_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one patient text vector = the first scan's embedding, variant 'plain'."""
    b = _vec_base(spark, sf_dir).where(F.col("slot") == 0)
    return b.select(F.concat(F.lit("p"), F.col("k").cast("string")).alias("pid"),
                    F.lit("plain").alias("variant"), "vec")


def class_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4 class vectors: embedding 2k is class 0 of patient k, 2k+1 is class 1 (more patients than have scans)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.concat(F.lit("p"), F.expr("vec_id div 2").cast("string")).alias("pid"),
                    (F.col("vec_id") % 2).cast("int").alias("class"), F.col("embedding").alias("vec"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7 predictions from ``lineitem``: label R=1, prob=discount (ties), score=price (distinct)."""
    li = table(spark, sf_dir, "lineitem")
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
                      F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"))
    return li.select(
        key.alias("rowkey"),
        F.col("l_returnflag"), F.col("l_linestatus"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).cast("int").alias("label"),
        # -0.0 and 0.0 are the same score
        F.when(F.col("l_discount") == 0, F.lit(0.0)).otherwise(F.col("l_discount")).alias("prob"),
        (F.col("l_extendedprice") / 105000.0).alias("score"),
    )


def doc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` left join ``labels``: real missing labels."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id", "left")


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patient-level attributes from ``customer``: site (market segment) and region code (nation)."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("pid"), F.col("c_mktsegment").alias("site"),
                    F.col("c_nationkey").cast("int").alias("nation"))


def vector_files(vectors: DataFrame, name, folder: str) -> DataFrame:
    """Stand-in input of the file readers: every ``vec`` as ``folder/<name>.npy``; pid and path of the files.

    Tasks write through the file system that the folder's address names.
    """
    def write(batches):
        import numpy as np
        from pyarrow import fs
        target, base = fs.FileSystem.from_uri(folder)
        for pdf in batches:
            for file, vec in zip(pdf["file"], pdf["vec"]):
                at = f"{base}/{file}.npy"
                target.create_dir(at.rsplit("/", 1)[0], recursive=True)
                with target.open_output_stream(at) as out:
                    np.save(out, np.asarray(vec, np.float32).reshape(4, -1))
            yield pdf.assign(path=folder.rstrip("/") + "/" + pdf["file"] + ".npy")[["pid", "path"]]

    return vectors.select("pid", "vec", name.alias("file")).mapInPandas(write, "pid string, path string")
