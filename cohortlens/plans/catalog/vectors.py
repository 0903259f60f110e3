"""Queries: vector statistics, sequence assembly and scoring (A5, A6, M1, M2, SEQ-A..D, V1-V9)."""

import math
import uuid

import numpy as np
from pyspark.sql import functions as F

from cohortlens.operators import cohort as C
from cohortlens.operators import sequences as S
from cohortlens.operators import text as X
from cohortlens.operators import vectors as V
from cohortlens.plans.catalog import register
from cohortlens.session import materialize, scratch_path
from cohortlens.sources import io as IO
from cohortlens.sources import testdata as td

SLEN = 3
BATCH = 32
SCALARS = ("age", "bmi")
CATEGORICALS = ("gender", "smo_status")


def fixture_weights(d_in: int, d_out: int, layer: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Deterministic weights for the projection / MLP queries (stand-in for a trained model)."""
    i = np.arange(d_in, dtype=np.float64)[:, None]
    j = np.arange(d_out, dtype=np.float64)[None, :]
    W = np.sin(layer + 1.0 + 0.37 * i + 1.91 * j) / math.sqrt(d_in)
    b = 0.1 * np.cos(layer + np.arange(d_out, dtype=np.float64))
    return W, b


def _emb(spark, sf_dir):
    return td.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"), "label")


def _explode_vec(df, key, col, idx="dim", val="value"):
    return df.select(key, F.posexplode(col).alias(idx, val))


def _seq_a(spark, sf_dir):
    return S.image_text_sequences(td.vec_scans(spark, sf_dir), td.scan_vectors(spark, sf_dir),
                                  td.text_vectors(spark, sf_dir), SLEN)


def _seq_c(spark, sf_dir):
    return S.zeroshot_sequences(td.vec_scans(spark, sf_dir), td.scan_vectors(spark, sf_dir),
                                td.class_vectors(spark, sf_dir), SLEN)


@register("channel_stats")
def channel_stats(spark, sf_dir):
    """A5: mean and sample std of the scalar clinical variables."""
    return S.channel_stats(td.scans(spark, sf_dir), C.NLST.scalar)


@register("zscore_vectors")
def zscore_vectors(spark, sf_dir):
    """M1: global z-score of every vector element."""
    e = _emb(spark, sf_dir).select("vec_id", S.zscore_vec(F.col("vec")).alias("z"))
    return _explode_vec(e, "vec_id", "z")


@register("zscore_clinical")
def zscore_clinical(spark, sf_dir):
    """M2: per-channel z-score of the scalar variables (stats of the same frame)."""
    s = td.scans(spark, sf_dir).select("pid", "rid", *C.NLST.scalar)
    return S.zscore_columns(s, C.NLST.scalar)


@register("vector_stats")
def vector_stats(spark, sf_dir):
    """Mean of per-vector means and of per-vector population stds."""
    return V.vector_set_stats(_emb(spark, sf_dir), "vec")


@register("seq_image_text")
def seq_image_text(spark, sf_dir):
    """SEQ-A (W2, W3, W5, J7, J8): latest 3 raw vectors + mask + days + text vector + label."""
    return S.explode_sequences(_seq_a(spark, sf_dir))


@register("seq_from_files")
def seq_from_files(spark, sf_dir):
    """SEQ-A from .npy files: scan vectors by patient and date, text vectors by the path in the table; others are not opened."""
    scans, folder = td.vec_scans(spark, sf_dir), scratch_path(spark, "npy")
    named = F.concat("pid", F.lit("time"), "scan_key")
    materialize(td.vector_files(td.scan_vectors(spark, sf_dir), named, f"{folder}/scans"))
    texts = materialize(td.vector_files(td.text_vectors(spark, sf_dir), F.col("pid"), f"{folder}/texts"))
    kept = S.latest_k(scans, SLEN).join(texts.withColumnRenamed("path", "embed_fpath"), "pid")
    vecs = IO.scan_vectors_of(spark, kept, f"{folder}/scans")
    by_path = IO.read_named_vectors(spark, kept, "embed_fpath")
    return S.explode_sequences(S.image_text_sequences(kept, vecs, by_path, SLEN, text_path_col="embed_fpath"))


@register("seq_vector_store")
def seq_vector_store(spark, sf_dir):
    """SEQ-A against scan vectors stored in buckets of (pid, scan_key); the vectors are not shuffled."""
    name = f"scan_vectors_{uuid.uuid4().hex}"
    store = IO.write_vector_store(td.scan_vectors(spark, sf_dir), name, scratch_path(spark, "store"), buckets=16)
    return S.explode_sequences(S.image_text_sequences(td.vec_scans(spark, sf_dir), store, td.text_vectors(spark, sf_dir), SLEN))


@register("seq_image_tabular")
def seq_image_tabular(spark, sf_dir):
    """SEQ-B (M1, M2): z-scored vectors + clinical row, days from shifted_scandate."""
    seq = S.image_tabular_sequences(td.vec_scans(spark, sf_dir), td.scan_vectors(spark, sf_dir),
                                    SCALARS, CATEGORICALS, SLEN)
    return S.explode_sequences(seq)


@register("seq_zeroshot")
def seq_zeroshot(spark, sf_dir):
    """SEQ-C (S5, J9): as SEQ-A with the (2, d) class-vector stack."""
    return S.explode_sequences(_seq_c(spark, sf_dir))


@register("seq_image")
def seq_image(spark, sf_dir):
    """SEQ-D: z-scored vectors only, days from shifted_scandate."""
    return S.explode_sequences(S.image_sequences(td.vec_scans(spark, sf_dir), td.scan_vectors(spark, sf_dir), SLEN))


@register("time_encoding")
def time_encoding(spark, sf_dir):
    """V2: sinusoidal day code added to each position of the SEQ-A image matrix."""
    seq = _seq_a(spark, sf_dir)
    enc = seq.select("pid", V.time_encoding(F.col("img"), F.col("times"), 64).alias("enc"))
    pos = enc.select("pid", F.posexplode("enc").alias("pos", "row"))
    return pos.select("pid", "pos", F.posexplode("row").alias("dim", "value"))


@register("l2_normalize")
def l2_normalize(spark, sf_dir):
    """V4: unit-length vectors."""
    e = _emb(spark, sf_dir).select("vec_id", S.l2_normalize(F.col("vec")).alias("n"))
    return _explode_vec(e, "vec_id", "n")


@register("l2_normalize_zero")
def l2_normalize_zero(spark, sf_dir):
    """V4 on vectors of which every seventh is zero: their elements are NULL."""
    e = _emb(spark, sf_dir)
    v = F.when(F.col("vec_id") % 7 == 0, F.transform("vec", lambda x: x * 0)).otherwise(F.col("vec"))
    return _explode_vec(e.select("vec_id", S.l2_normalize(v).alias("n")), "vec_id", "n")


@register("zero_shot_scores")
def zero_shot_scores(spark, sf_dir):
    """V5 + M3: paired cosine of the newest image vector with each class text, softmax, P(class 1)."""
    seq = _seq_c(spark, sf_dir)
    return seq.select("pid", "label", V.zero_shot_prob(F.col("img")[0], F.col("expr")).alias("prob"))


@register("in_batch_contrastive")
def in_batch_contrastive(spark, sf_dir):
    """V6 + O3/O4: hash-shuffled batches of 32 patients, symmetric CE loss and retrieval accuracy."""
    seq = _seq_a(spark, sf_dir).select("pid", F.col("img")[0].alias("img0"), F.col("expr")[0].alias("txt"))
    b = V.assign_batches(seq, "pid", BATCH)
    return V.in_batch_contrastive(b, "img0", "txt")


@register("tiled_contrastive")
def tiled_contrastive(spark, sf_dir):
    """All patients as one batch, its similarity matrix in tiles of 64 x 64."""
    seq = _seq_a(spark, sf_dir).select("pid", F.col("img")[0].alias("img0"), F.col("expr")[0].alias("txt"), F.lit(0).cast("long").alias("batch_id"))
    return V.tiled_contrastive(seq, "img0", "txt", tile=64)


@register("fused_features")
def fused_features(spark, sf_dir):
    """V7: newest image vector ++ text vector per patient."""
    f = V.fused_features(_seq_a(spark, sf_dir))
    return _explode_vec(f, "pid", "features", "idx")


@register("project_vectors")
def project_vectors(spark, sf_dir):
    """V3: linear projection 64 -> 16 by Arrow-batched matmul."""
    W, b = fixture_weights(64, 16, 0)
    p = V.project(_emb(spark, sf_dir), "vec", W, "proj", keep=["vec_id"], bias=b)
    return _explode_vec(p, "vec_id", "proj")


@register("text_encoder_mlp")
def text_encoder_mlp(spark, sf_dir):
    """V9: 3-layer ReLU MLP 64 -> 32 -> 32 -> 16."""
    layers = [fixture_weights(64, 32, 1), fixture_weights(32, 32, 2), fixture_weights(32, 16, 3)]
    m = V.text_encoder_mlp(_emb(spark, sf_dir), "vec", layers, "enc", keep=["vec_id"])
    return _explode_vec(m, "vec_id", "enc")


@register("hash_embed")
def hash_embed(spark, sf_dir):
    """V1: clinical sentences encoded by the shipped hashing encoder (predict_batch_udf)."""
    items = X.clinical_items(C.scan_cohort(td.scans(spark, sf_dir)))
    enc = V.encode_texts(items, "text", "vec", dim=64)
    return _explode_vec(enc, "pid", "vec")
