"""Readers and sinks: tabular dispatch, NaN handling, .npy ingest by key and by path, sinks."""

import os
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F


def test_read_tabular_csv_parquet_and_unknown(spark):
    from cohortlens.sources.io import read_tabular
    d = tempfile.mkdtemp(prefix="io-")
    pdf = pd.DataFrame({"patient_id": ["007", "8"], "study_yr": [0, 2], "x": [1.5, np.nan]})
    pdf.to_csv(os.path.join(d, "t.csv"), index=False)
    df = read_tabular(spark, os.path.join(d, "t.csv"), dtypes={"patient_id": "string"})
    rows = sorted(df.collect(), key=lambda r: r.study_yr)
    assert rows[0].study_yr == 0 and rows[1].x is None
    spark.createDataFrame(pdf).write.parquet(os.path.join(d, "t.parquet"))
    assert read_tabular(spark, os.path.join(d, "t.parquet")).where(F.col("x").isNull()).count() == 1
    with pytest.raises(NotImplementedError):
        read_tabular(spark, os.path.join(d, "t.xyz"))


def test_npy_ingest_keys_and_paths(spark):
    from cohortlens.sources import io as IO
    d = tempfile.mkdtemp(prefix="npy-")
    os.makedirs(os.path.join(d, "scans"))
    os.makedirs(os.path.join(d, "classes", "p1"))
    rng = np.random.default_rng(0)
    a, b = rng.random((2, 4)).astype(np.float32), rng.random(8).astype(np.float32)
    np.save(os.path.join(d, "scans", "p1time20010203.npy"), a)
    np.save(os.path.join(d, "scans", "p2time19991231.npy"), b)
    np.save(os.path.join(d, "classes", "p1", "class0.npy"), b)
    np.save(os.path.join(d, "classes", "p1", "class1.npy"), b * 2)
    sv = {(r.pid, r.scan_key): r.vec for r in IO.ingest_scan_vectors(spark, os.path.join(d, "scans")).collect()}
    assert np.allclose(sv[("p1", "20010203")], a.ravel()) and len(sv[("p2", "19991231")]) == 8
    cv = {(r.pid, r["class"]): r.vec for r in IO.ingest_class_vectors(spark, os.path.join(d, "classes")).collect()}
    assert np.allclose(cv[("p1", 1)], b * 2)
    vecs = IO.read_npy_vectors(spark, os.path.join(d, "scans"))
    tbl = spark.createDataFrame([("p1", os.path.join(d, "scans", "p1time20010203.npy"))], "pid string, scan_fpath string")
    got = IO.vectors_by_path(tbl, vecs).collect()[0]
    assert np.allclose(got.vec, a.ravel())


def test_sinks_roundtrip(spark):
    from cohortlens.sources import io as IO
    d = tempfile.mkdtemp(prefix="sink-")
    pred = spark.createDataFrame([("a", 1, 0.7), ("b", 0, 0.2)], "pid string, label int, prob double")
    IO.write_predictions(pred, os.path.join(d, "p.csv"), "csv")
    back = IO.read_tabular(spark, os.path.join(d, "p.csv"))
    assert sorted(r.prob for r in back.collect()) == [0.2, 0.7]
    tv = spark.createDataFrame([("a", "plain", [0.1, 0.2])], "pid string, variant string, vec array<float>")
    IO.write_text_vectors(tv, os.path.join(d, "tv"))
    assert spark.read.parquet(os.path.join(d, "tv")).where("variant = 'plain'").count() == 1


def test_sequences_by_path_column(spark):
    from cohortlens.operators import sequences as S
    from cohortlens.sources import io as IO
    d = tempfile.mkdtemp(prefix="seqpath-")
    rows = []
    for i, (pid, order) in enumerate([("a", 0), ("a", 1), ("b", 0)]):
        path = os.path.join(d, f"v{i}.npy")
        np.save(path, np.full(3, i, dtype=np.float32))
        rows.append((pid, i, order, f"2001-01-0{i + 1}", path, 1))
    scans = spark.createDataFrame(rows, "pid string, rid long, scanorder int, scandate string, scan_fpath string, lung_cancer int")
    seq = S.assemble(scans, IO.read_npy_vectors(spark, d), 2, path_col="scan_fpath").orderBy("pid").collect()
    assert [list(v) for v in seq[0].img] == [[1.0] * 3, [0.0] * 3] and seq[0].times[1] == 1.0
    assert seq[1].padding == [1.0, 0.0]


def test_invert_smo_status(spark):
    from cohortlens.operators.text import clinical_items
    from cohortlens.operators.cohort import CohortSpec
    spec = CohortSpec(scalar=(), categorical=("smo_status",))
    df = spark.createDataFrame([("a", 1, 0, "2001", 1)], "pid string, rid long, scanorder int, scandate string, smo_status int")
    assert clinical_items(df, spec).collect()[0].text == "The subject is a current smoker."
    assert clinical_items(df, spec, invert_smo_status=True).collect()[0].text == "The subject is not a current smoker."


def test_load_cohort_joins_patient_table(spark):
    from cohortlens.sources.io import load_cohort
    d = tempfile.mkdtemp(prefix="cohort-")
    pd.DataFrame({"pid": ["007", "8", "8"], "scandate": ["20010101", "20020101", "20030101"], "bmi": [20.0, np.nan, 22.0]}
                 ).to_csv(os.path.join(d, "scans.csv"), index=False)
    pd.DataFrame({"pid": ["007"], "site": ["A"]}).to_csv(os.path.join(d, "patients.csv"), index=False)
    df = load_cohort(spark, os.path.join(d, "scans.csv"), os.path.join(d, "patients.csv"))
    rows = {(r.pid, r.scandate): r for r in df.collect()}
    assert dict(df.dtypes)["pid"] == "string" and len(rows) == 3
    assert rows[("007", 20010101)].site == "A" and rows[("8", 20020101)].site is None
    assert rows[("8", 20020101)].bmi is None


def test_named_files_only(spark):
    from cohortlens.sources import io as IO
    d = tempfile.mkdtemp(prefix="named-")
    os.makedirs(os.path.join(d, "p1"))
    for name in ("atime20010101", "btime20010102", "c[1]{x}time20010103", "p1/class0", "p1/class1", "a"):
        np.save(os.path.join(d, name + ".npy"), np.arange(6, dtype=np.float32).reshape(2, 3) + len(name))
    # a file that no row names and that cannot be decoded
    open(os.path.join(d, "ztime20010101.npy"), "wb").write(b"not an array")
    scans = spark.createDataFrame([("a", "2001-01-01"), ("a", "2001-01-01"), ("c[1]{x}", "2001-01-03"), ("q", None), (None, "2001-01-01")], "pid string, scandate string")
    got = {(r.pid, r.scan_key): r.vec for r in IO.scan_vectors_of(spark, scans, d).collect()}
    assert set(got) == {("a", "20010101"), ("c[1]{x}", "20010103")} and got["a", "20010101"] == [13.0 + i for i in range(6)]
    one = spark.createDataFrame([("a",), ("p1",)], "pid string")
    assert [r.variant for r in IO.text_vectors_of(spark, one.where("pid = 'a'"), d, "json").collect()] == ["json"]
    assert sorted(r["class"] for r in IO.class_vectors_of(spark, one.where("pid = 'p1'"), d).collect()) == [0, 1]
    with pytest.raises(Exception, match="(?i)path.*not.*exist"):
        IO.scan_vectors_of(spark, spark.createDataFrame([("missing", "2001-01-01")], "pid string, scandate string"), d)
    paths = spark.createDataFrame([(os.path.join(d, "a.npy"),), ("file://" + os.path.join(d, "a.npy"),), (None,), (os.path.join(d, "btime20010102.npy"),)], "path string")
    read = IO.read_named_vectors(spark, paths, most_files=1)
    assert sorted(r.path for r in read.collect()) == sorted(p.path for p in paths.collect() if p.path)
    assert IO.read_named_vectors(spark, paths.where("false")).count() == 0


def test_embed_path_of_the_oldest_kept_scan(spark):
    from cohortlens.operators import sequences as S
    rows = [("a", 0, 0, "2001-01-01", "/t/0.npy"), ("a", 1, 1, "2001-01-02", "/t/1.npy"), ("a", 2, 2, "2001-01-03", "/t/2.npy")]
    scans = spark.createDataFrame(rows, "pid string, rid long, scanorder int, scandate string, embed_fpath string").withColumn("lung_cancer", F.lit(1))
    vecs = spark.createDataFrame([("a", f"2001010{i + 1}", [float(i)]) for i in range(3)], "pid string, scan_key string, vec array<float>")
    texts = spark.createDataFrame([(f"file:/t/{i}.npy", [10.0 + i]) for i in range(3)], "path string, vec array<float>")
    seq = S.image_text_sequences(scans, vecs, texts, 2, text_path_col="embed_fpath").first()
    assert seq.expr == [[11.0]]


def test_sinks_keep_other_variants(spark):
    from cohortlens.sources import io as IO
    path = os.path.join(tempfile.mkdtemp(prefix="variants-"), "out")

    def rows(variant, x):
        return spark.createDataFrame([("a", variant, [x])], "pid string, variant string, vec array<float>")

    for variant, x in (("plain", 1.0), ("json", 2.0), ("plain", 3.0)):
        IO.write_text_vectors(rows(variant, x), path)
    assert {r.variant: r.vec for r in spark.read.parquet(path).collect()} == {"plain": [3.0], "json": [2.0]}
    assert {r.variant for r in IO.committed_variants(spark, path).collect()} == {"plain", "json"}


def test_stored_vectors_are_not_shuffled(spark):
    from cohortlens.operators import sequences as S
    from cohortlens.sources import io as IO, testdata as td
    from conftest import SF_SMALL
    store = IO.write_vector_store(td.scan_vectors(spark, SF_SMALL), "store_of_test", os.path.join(tempfile.mkdtemp(prefix="store-"), "t"), buckets=16)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = S.assemble(td.vec_scans(spark, SF_SMALL), store, 3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE store_of_test")
    side = plan[:plan.index("Bucketed: true")].split("SortMergeJoin")[-1].split("\n")
    # from the join down to the bucketed scan there is no exchange
    scan = next(i for i, line in enumerate(side) if "store_of_test" in line or "FileScan parquet" in line and "scan_key" in line)
    depth = [len(line) - len(line.lstrip(" :+-*()0123456789")) for line in side]
    assert "Exchange" not in "".join(line for line, k in zip(side[scan - 3:scan], depth[scan - 3:scan]))
