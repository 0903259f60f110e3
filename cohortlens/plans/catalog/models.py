"""Queries: classifier heads, ranking, alignment and end-to-end jobs."""

import numpy as np
from pyspark.sql import functions as F

from cohortlens.operators import classify as K
from cohortlens.operators import cohort as C
from cohortlens.operators import sequences as S
from cohortlens.operators import vectors as V
from cohortlens.plans import jobs as J
from cohortlens.plans.catalog import register
from cohortlens.session import scratch_path
from cohortlens.sources import io as IO
from cohortlens.sources import testdata as td


def _vec_inputs(spark, sf_dir):
    return td.vec_scans(spark, sf_dir), td.scan_vectors(spark, sf_dir), td.text_vectors(spark, sf_dir)


@register("importance_top")
def importance_top(spark, sf_dir):
    """O2: rank dimensions by |class-mean difference| of the embeddings; top round(10%)."""
    e = td.table(spark, sf_dir, "embeddings")
    long = e.select((F.col("label") % 2).alias("cls"), F.posexplode("embedding").alias("idx", "x"))
    w = long.groupBy("idx").agg((F.avg(F.when(F.col("cls") == 1, F.col("x"))) -
                                 F.avg(F.when(F.col("cls") == 0, F.col("x")))).alias("weight"))
    return K.rank_features(w)


@register("latest_label")
def latest_label(spark, sf_dir):
    """Label of each patient's newest scan, NULL -> 0."""
    return S.latest_label(C.scan_cohort(td.scans(spark, sf_dir)), "lung_cancer")


@register("label_classes")
def label_classes(spark, sf_dir):
    """Distinct label values, with and without NULL counted as a class."""
    return S.class_count(td.doc_labels(spark, sf_dir), "quality")


@register("linear_head")
def linear_head(spark, sf_dir):
    """C1 (+ L6): logistic regression on newest image ++ text vector; validation predictions."""
    _, pred, _ = J.job_fit(*_vec_inputs(spark, sf_dir), head="linear", evaluate=False)
    return pred


def _price_features(spark, sf_dir):
    p = td.predictions(spark, sf_dir)
    return p.withColumn("features", F.array("score", "prob", F.col("score") * F.col("prob"), (F.col("l_linestatus") == "O").cast("double")))


@register("newton_head")
def newton_head(spark, sf_dir):
    """C1 by Newton steps: at the solution the fitted moments of every feature equal the observed ones."""
    rows = _price_features(spark, sf_dir)
    pred = K.predict_newton(K.fit_newton(rows), rows.select("features", "label", F.col("rowkey").alias("pid"), "l_linestatus").withColumn(
        "pid", F.struct("pid", "features")))
    long = pred.select("label", "prob", F.posexplode(F.concat(F.array(F.lit(1.0)), F.col("pid.features"))).alias("idx", "x"))
    return long.groupBy("idx").agg(F.avg(F.col("x") * F.col("label")).alias("observed"), F.avg(F.col("x") * F.col("prob")).alias("fitted"))


@register("mlp_head")
def mlp_head(spark, sf_dir):
    """MLP head [d, 2d, 2d, 2] on frozen features; validation predictions."""
    _, pred, _ = J.job_fit(*_vec_inputs(spark, sf_dir), head="mlp", evaluate=False)
    return pred


@register("latest_only_head")
def latest_only_head(spark, sf_dir):
    """Newest image vector only; validation predictions."""
    _, pred, _ = J.job_fit(*_vec_inputs(spark, sf_dir), head="latest_image", evaluate=False)
    return pred


@register("job_fit")
def job_fit(spark, sf_dir):
    """L6 + C4: fit the linear head and evaluate (AUC, accuracy, loss, n)."""
    _, _, ev = J.job_fit(*_vec_inputs(spark, sf_dir), head="linear")
    return ev


@register("job_test")
def job_test(spark, sf_dir):
    """L2 + V8: score every patient with a given linear head (batch scoring)."""
    from cohortlens.plans.catalog.vectors import fixture_weights
    w, b = fixture_weights(128, 1)
    pred, _ = J.job_test(*_vec_inputs(spark, sf_dir), J.linear_scorer(w[:, 0], b[0]), evaluate=False)
    return pred


@register("job_test_fitted")
def job_test_fitted(spark, sf_dir):
    """L2 + V8: score every patient with a head fitted by L6."""
    model, _, _ = J.job_fit(*_vec_inputs(spark, sf_dir), head="linear", evaluate=False)
    make = J.linear_scorer(model.coefficients.toArray(), model.intercept)
    pred, _ = J.job_test(*_vec_inputs(spark, sf_dir), make, evaluate=False)
    return pred


@register("evaluate_predictions")
def evaluate_predictions(spark, sf_dir):
    """C4: AUC, accuracy, loss and n of a prediction table."""
    return K.evaluate(td.predictions(spark, sf_dir), "label", "score")


@register("job_predict")
def job_predict(spark, sf_dir):
    """L3: 50% row subset -> fused features per patient."""
    f = J.job_predict(*_vec_inputs(spark, sf_dir), subset=0.5)
    return f.select("pid", F.posexplode("features").alias("idx", "value"))


@register("job_zeroshot")
def job_zeroshot(spark, sf_dir):
    """L4: zero-shot predictions from class vectors and their AUC."""
    pred, _ = J.job_zeroshot(td.vec_scans(spark, sf_dir), td.scan_vectors(spark, sf_dir), td.class_vectors(spark, sf_dir),
                             evaluate=False)
    return pred


@register("job_embed")
def job_embed(spark, sf_dir):
    """L1: plain / label / JSON text vectors of the training patients (hashing encoder)."""
    cohort = C.scan_cohort(td.scans(spark, sf_dir))
    train = C.train_split(cohort, C.test_split(cohort, td.test_list(spark, sf_dir)))
    out = J.job_embed(train)
    return out.select("pid", "variant", F.posexplode("vec").alias("dim", "value"))


@register("job_class_embed")
def job_class_embed(spark, sf_dir):
    """L1/L4: class-prompt vectors (pid, class, vec)."""
    out = J.job_class_embed(C.scan_cohort(td.scans(spark, sf_dir)))
    return out.select("pid", "class", F.posexplode("vec").alias("dim", "value"))


@register("job_bootstrap")
def job_bootstrap(spark, sf_dir):
    """L5 + S1 + S9: predictions written as CSV, read back, bootstrapped per l_linestatus."""
    path = scratch_path(spark, "predictions") + ".csv"
    p = td.predictions(spark, sf_dir).select("rowkey", "l_linestatus", "label", "prob")
    p.write.option("header", True).csv(path)
    return J.job_bootstrap(spark, path, by=["l_linestatus"], key="rowkey",
                           schema="rowkey string, l_linestatus string, label int, prob double")


@register("sink_predictions")
def sink_predictions(spark, sf_dir):
    """Predictions written as CSV and read back."""
    path = scratch_path(spark, "sink") + ".csv"
    IO.write_predictions(td.predictions(spark, sf_dir).withColumnRenamed("rowkey", "pid"), path, "csv")
    return IO.read_tabular(spark, path, "pid string, label int, prob double")


@register("sink_features")
def sink_features(spark, sf_dir):
    """Fused features written by the prediction job and read back."""
    path = scratch_path(spark, "sink")
    J.job_predict(*_vec_inputs(spark, sf_dir), subset=0.5, out_dir=path)
    return spark.read.parquet(f"{path}/features").select("pid", F.posexplode("features").alias("idx", "value"))


@register("sink_text_vectors")
def sink_text_vectors(spark, sf_dir):
    """Text vectors written by variant and read back."""
    cohort = C.scan_cohort(td.scans(spark, sf_dir))
    path = scratch_path(spark, "sink")
    J.job_embed(C.train_split(cohort, C.test_split(cohort, td.test_list(spark, sf_dir))), out_dir=path)
    back = spark.read.parquet(f"{path}/text_vectors")
    return back.select("pid", F.col("variant").cast("string").alias("variant"), F.posexplode("vec").alias("dim", "value"))


@register("sink_text_vectors_by_variant")
def sink_text_vectors_by_variant(spark, sf_dir):
    """Variants written one by one, the first one twice; every write leaves the other variants as they are."""
    cohort = C.scan_cohort(td.scans(spark, sf_dir))
    first, path = scratch_path(spark, "sink"), scratch_path(spark, "sink")
    J.job_embed(C.train_split(cohort, C.test_split(cohort, td.test_list(spark, sf_dir))), out_dir=first)
    vectors = spark.read.parquet(f"{first}/text_vectors")
    variants = [r["variant"] for r in IO.committed_variants(spark, f"{first}/text_vectors").orderBy("variant").collect()]
    for variant in [*variants, variants[0]]:
        IO.write_text_vectors(vectors.where(F.col("variant") == variant), path)
    back = spark.read.parquet(path)
    return back.select("pid", F.col("variant").cast("string").alias("variant"), F.posexplode("vec").alias("dim", "value"))


@register("sink_class_vectors")
def sink_class_vectors(spark, sf_dir):
    """Class vectors written by class and read back."""
    path = scratch_path(spark, "sink")
    J.job_class_embed(C.scan_cohort(td.scans(spark, sf_dir)), out_dir=path)
    back = spark.read.parquet(f"{path}/class_vectors")
    return back.select("pid", F.col("class").cast("int").alias("class"), F.posexplode("vec").alias("dim", "value"))


@register("paired_alignment")
def paired_alignment(spark, sf_dir):
    """Canonical correlations of the learned image/text alignment."""
    seq = S.image_text_sequences(*_vec_inputs(spark, sf_dir), 3, phase="pretrain")
    pairs = seq.select(F.col("img")[0].alias("img0"), F.col("expr")[0].alias("txt"))
    al = V.paired_alignment(pairs, "img0", "txt", k=8)
    return spark.createDataFrame([(i, float(c)) for i, c in enumerate(al["corr"])], "component int, corr double")


@register("alignment_moments")
def alignment_moments(spark, sf_dir):
    """The moment sums behind the alignment, upper triangle of sum z z' with z = [1, image, text]."""
    seq = S.image_text_sequences(*_vec_inputs(spark, sf_dir), 3, phase="pretrain")
    m = V.moment_matrix(seq.select(F.col("img")[0].alias("img0"), F.col("expr")[0].alias("txt")), "img0", "txt")
    i, j = np.triu_indices(len(m))
    return spark.createDataFrame([(int(a), int(b), float(m[a, b])) for a, b in zip(i, j)], "i int, j int, value double")


@register("job_align")
def job_align(spark, sf_dir):
    """Align, project, normalise, in-batch retrieval metrics per batch."""
    _, metrics = J.job_align(*_vec_inputs(spark, sf_dir), k=16)
    return metrics
