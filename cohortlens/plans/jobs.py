"""End-to-end jobs of the modelled workflow.

Each job takes DataFrames (or a session and paths), returns its result frame
and, when ``out_dir`` is given, writes it (Parquet; CSV for predictions on
request).  Nothing is collected to the driver except bounded model
parameters (classifier coefficients, alignment matrices).
"""

from __future__ import annotations

import os
from typing import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators import bootstrap as B
from cohortlens.operators import classify as K
from cohortlens.operators import sequences as S
from cohortlens.operators import split as P
from cohortlens.operators import text as X
from cohortlens.operators import vectors as V
from cohortlens.operators.cohort import NLST, CohortSpec, vector_key
from cohortlens.operators.metrics import auc
from cohortlens.session import materialize
from cohortlens.sources import io as IO


def job_embed(cohort: DataFrame, spec: CohortSpec = NLST, variants: Sequence[str] = ("plain", "label", "json"),
              make_predict_fn=None, dim: int = 64, batch_size: int = 500, out_dir: str | None = None,
              scan_level: bool = False) -> DataFrame:
    """L1: text items (plain / with label / JSON / JSON with labels) -> encoder -> (pid, variant, vec).

    ``scan_level`` gives one vector per scan, with its key ``{pid}time{yyyyMMdd}`` in ``vkey``.
    """
    # a sink passes over its rows more than once
    items = X.variant_items(cohort, spec, variants, scan_level, materialize if out_dir else lambda rows: rows)
    out = V.encode_texts(items, "text", "vec", make_predict_fn, dim, batch_size)
    keys = [vector_key("pid", "scandate").alias("vkey")] if scan_level else []
    out = out.select("pid", *keys, "variant", "vec")
    if out_dir:
        IO.write_text_vectors(out, os.path.join(out_dir, "text_vectors"))
    return out


def job_class_embed(cohort: DataFrame, spec: CohortSpec = NLST, classes=(0, 1), make_predict_fn=None, dim: int = 64,
                    out_dir: str | None = None) -> DataFrame:
    """L1/L4 (class variant): class prompts -> encoder -> (pid, class, vec)."""
    items = X.class_items(cohort, spec, classes)
    out = V.encode_texts(items, "text", "vec", make_predict_fn, dim).select("pid", "class", "vec")
    if out_dir:
        IO.write_text_vectors(out, os.path.join(out_dir, "class_vectors"), partition_by=("class",))
    return out


def job_fit(scans: DataFrame, scan_vectors: DataFrame, text_vectors: DataFrame, head: str = "linear",
            slen: int = 3, val_frac: float = 0.2, label: str = "lung_cancer", seed: int = 1105, evaluate: bool = True):
    """Split patients (R2) -> assemble (SEQ-A) -> fit a head on frozen features -> predictions on val.

    Returns (model, validation predictions, evaluation frame or None).
    """
    train_scans, val_scans = P.stratified_split(scans, label, val_frac, seed)
    seq_tr = S.image_text_sequences(train_scans, scan_vectors, text_vectors, slen, label=label)
    seq_va = S.image_text_sequences(val_scans, scan_vectors, text_vectors, slen, label=label)
    if head == "latest_image":
        tr, va = K.features_latest_image(seq_tr), K.features_latest_image(seq_va)
    else:
        tr, va = K.features_image_text(seq_tr), K.features_image_text(seq_va)
    if head == "mlp":
        dim = len(tr.select("features").first()["features"])
        model = K.fit_mlp(tr, dim)
    else:
        # ridge: on few patients the unpenalised optimum is not unique
        model = K.fit_linear(tr, reg=1e-2)
    pred = K.predict(model, va)
    return model, pred, K.evaluate(pred) if evaluate else None


def job_test(scans: DataFrame, scan_vectors: DataFrame, text_vectors: DataFrame, make_predict_fn, slen: int = 3,
             label: str = "lung_cancer", out_dir: str | None = None, csv: bool = False, evaluate: bool = True):
    """L2: assemble -> batch scoring with a trained model (V8) -> prediction sink (S9) -> AUC."""
    seq = K.features_image_text(S.image_text_sequences(scans, scan_vectors, text_vectors, slen, label=label))
    pred = V.score_batches(seq, make_predict_fn, "features", "prob", keep=["pid", "label"])
    pred = pred.withColumn("label", F.col("label").cast("int"))
    if out_dir:
        IO.write_predictions(pred, os.path.join(out_dir, "test_predictions"), "csv" if csv else "parquet")
    return pred, auc(pred, "label", "prob") if evaluate else None


def job_predict(scans: DataFrame, scan_vectors: DataFrame, text_vectors: DataFrame, subset: float = 1.0,
                slen: int = 3, seed: int = 1105, out_dir: str | None = None) -> DataFrame:
    """L3: optional row subset (R1) -> assemble (label 0, predict phase) -> fused features (V7) -> sink."""
    rows = P.row_sample(scans, subset, "rid", seed) if subset < 1.0 else scans
    seq = S.image_text_sequences(rows, scan_vectors, text_vectors, slen, phase="predict")
    out = V.fused_features(seq)
    if out_dir:
        IO.write_features(out, os.path.join(out_dir, "features"))
    return out


def job_zeroshot(scans: DataFrame, scan_vectors: DataFrame, class_vectors: DataFrame | None = None, slen: int = 3,
                 label: str = "lung_cancer", out_dir: str | None = None, evaluate: bool = True,
                 cohort: DataFrame | None = None):
    """L4: SEQ-C -> paired cosine zero-shot (V5) -> predictions (S9) -> AUC.

    Without ``class_vectors`` they are built from ``cohort`` first (class prompts through the encoder).
    """
    if class_vectors is None:
        class_vectors = job_class_embed(cohort, out_dir=out_dir)
    seq = S.zeroshot_sequences(scans, scan_vectors, class_vectors, slen, label=label)
    pred = seq.select("pid", F.col("label").cast("int").alias("label"),
                      V.zero_shot_prob(F.col("img")[0], F.col("expr")).alias("prob"))
    if out_dir:
        IO.write_predictions(pred, os.path.join(out_dir, "zeroshot_predictions"))
    return pred, auc(pred, "label", "prob") if evaluate else None


def job_bootstrap(spark, predictions_path: str, by: Sequence[str] = (), n: int = 100, confidence: float = 0.95,
                  key: str | None = None, schema: str | None = None) -> DataFrame:
    """Read saved predictions (S1) -> bootstrap AUC mean and CI.

    ``schema`` spares the read that infers it.  Without ``key`` every row is
    drawn by its place in the files, so equal rows have weights of their own.
    """
    pred = IO.read_tabular(spark, predictions_path, schema)
    if key is None:
        key = "_key"
        pred = pred.withColumn(key, F.monotonically_increasing_id())
    return B.bootstrap(pred, B.auc_metric("label", "prob"), by=list(by), n=n, confidence=confidence, key=key)


def job_align(scans: DataFrame, scan_vectors: DataFrame, text_vectors: DataFrame, slen: int = 3, k: int = 16,
              batch_size: int = 32, epoch: int = 0):
    """Pairs (newest image, text) -> alignment (V10) -> projections (V3) -> L2 (V4) -> in-batch
    retrieval loss and accuracy (V6).  Returns (alignment dict, per-batch metrics)."""
    seq = S.image_text_sequences(scans, scan_vectors, text_vectors, slen, phase="pretrain")
    pairs = seq.select("pid", F.col("img")[0].alias("img0"), F.col("expr")[0].alias("txt"))
    al = V.paired_alignment(pairs, "img0", "txt", k)
    pi = V.project(pairs, "img0", al["A"], "zi", keep=["pid", "txt"], bias=al["bias_a"])
    pt = V.project(pi, "txt", al["B"], "zt", keep=["pid", "zi"], bias=al["bias_b"])
    batches = V.assign_batches(pt, "pid", batch_size, epoch)
    return al, V.in_batch_contrastive(batches, "zi", "zt")


def linear_scorer(coefficients: np.ndarray, intercept: float):
    """A ``make_predict_fn`` for V8 from logistic-regression parameters (sigmoid of x.w + b)."""
    w, b = np.asarray(coefficients, dtype=np.float64), float(intercept)

    def make():
        return lambda X: 1.0 / (1.0 + np.exp(-(X @ w + b)))
    return make
