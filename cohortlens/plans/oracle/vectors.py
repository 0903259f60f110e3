"""Oracle SQL: vector statistics, sequences and scoring."""

import math

from cohortlens.plans.oracle import A_SCANS, A_VEC, ORACLE, U, register, with_
from cohortlens.plans.oracle.cohort import COHORT
from cohortlens.plans.oracle.text import BASE, LATEST

MU, SD = 0.26725134, 0.7492173  # fixed values: image-feature statistics
SCALE = math.exp(math.log(1 / 0.07))
R6 = "round(CAST({} AS DOUBLE), 6)"

register("channel_stats", with_(A_SCANS) + "SELECT " + ", ".join(
    f"round(avg({c}), 6) AS mean_{c}, round(stddev_samp({c}), 6) AS std_{c}"
    for c in ["age", "bmi", "quit_time", "smo_duration", "smo_intensity", "pkyr"]) + " FROM scans")

EMB_LONG = "el AS (SELECT vec_id, d AS dim, CAST(embedding[d + 1] AS DOUBLE) AS x FROM embeddings, unnest(range(len(embedding))) t(d))"

register("zscore_vectors", with_(EMB_LONG) + f"""
SELECT vec_id, CAST(dim AS BIGINT) AS dim, {R6.format(f"CAST((x - {MU}) / {SD} AS FLOAT)")} AS value FROM el""")

register("zscore_clinical", with_(A_SCANS) + "SELECT pid, CAST(rid AS BIGINT) AS rid, " + ", ".join(
    f"(round(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER (), 6) + 0.0) AS {c}"
    for c in ["age", "bmi", "quit_time", "smo_duration", "smo_intensity", "pkyr"]) + " FROM scans")

register("vector_stats", with_(EMB_LONG, """
per AS (SELECT vec_id, avg(x) AS m, stddev_pop(x) AS s FROM el GROUP BY vec_id)""") + """
SELECT round(avg(m), 6) AS mean_of_means, round(avg(s), 6) AS mean_of_stds FROM per""")

# ------------------------------------------------------------- sequences
SEQ = """
top AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY scanorder DESC, rid) - 1 AS pos FROM vec_scans
        QUALIFY row_number() OVER (PARTITION BY pid ORDER BY scanorder DESC, rid) <= 3),
head AS (SELECT pid, {date} AS d0, lung_cancer AS lab0 FROM top WHERE pos = 0),
slots AS (SELECT h.pid, h.d0, coalesce(h.lab0, 0) AS label, s.range AS pos FROM head h CROSS JOIN range(3) s),
filled AS (
  SELECT sl.pid, sl.pos, sl.label,
         CASE WHEN t.pid IS NULL THEN 0 ELSE date_diff('day', t.{date}, sl.d0) END AS time,
         CAST(CASE WHEN t.pid IS NULL THEN 0.0 ELSE 1.0 END AS DOUBLE) AS padding,
         v.vec
  FROM slots sl
  LEFT JOIN top t ON t.pid = sl.pid AND t.pos = sl.pos
  LEFT JOIN scan_vectors v ON v.pid = t.pid AND v.scan_key = strftime(t.scandate, '%Y%m%d')),
img AS (
  SELECT f.pid, 'img' AS part, f.pos, d AS dim, f.time, f.padding, f.label,
         CASE WHEN f.vec IS NULL THEN 0.0 ELSE CAST(f.vec[d + 1] AS DOUBLE) END AS x
  FROM filled f, unnest(range(64)) t(d))"""


def _seq_select(value_expr: str, with_expr: str | None) -> str:
    img = (f"SELECT pid, part, CAST(pos AS BIGINT) AS pos, CAST(dim AS BIGINT) AS dim, {R6.format(value_expr)} AS value, "
           "round(CAST(time AS DOUBLE), 6) AS time, round(padding, 6) AS padding, CAST(label AS BIGINT) AS label FROM img")
    if with_expr is None:
        return img
    return img + "\nUNION ALL\n" + with_expr


def _expr_rows(src: str) -> str:
    # src provides (pid, pos, dim, x) for the second modality
    return (f"SELECT e.pid, 'expr' AS part, CAST(e.pos AS BIGINT) AS pos, CAST(e.dim AS BIGINT) AS dim, "
            f"{R6.format('e.x')} AS value, CAST(NULL AS DOUBLE) AS time, CAST(NULL AS DOUBLE) AS padding, "
            f"CAST(h.label AS BIGINT) AS label FROM ({src}) e JOIN (SELECT DISTINCT pid, label FROM slots) h ON e.pid = h.pid")


TEXT_LONG = "SELECT pid, 0 AS pos, d AS dim, CAST(vec[d + 1] AS DOUBLE) AS x FROM text_vectors, unnest(range(len(vec))) t(d)"
CLASS_LONG = "SELECT pid, class AS pos, d AS dim, CAST(vec[d + 1] AS DOUBLE) AS x FROM class_vectors, unnest(range(len(vec))) t(d)"

register("seq_image_text", with_(A_VEC, SEQ.format(date="scandate")) + _seq_select("x", _expr_rows(TEXT_LONG)))

register("seq_from_files", ORACLE["seq_image_text"])
register("seq_vector_store", ORACLE["seq_image_text"])

register("seq_zeroshot", with_(A_VEC, SEQ.format(date="scandate")) + _seq_select("x", _expr_rows(CLASS_LONG)))

ZX = f"CAST((x - {MU}) / {SD} AS FLOAT)"
register("seq_image", with_(A_VEC, SEQ.format(date="shifted_scandate")) + _seq_select(ZX, None))

TAB_LONG = """
SELECT t.pid, 0 AS pos, c.dim, c.x FROM (
  SELECT pid,
         CAST((age - avg(age) OVER ()) / stddev_samp(age) OVER () AS FLOAT) AS za,
         CAST((bmi - avg(bmi) OVER ()) / stddev_samp(bmi) OVER () AS FLOAT) AS zb,
         CAST(gender AS FLOAT) AS g, CAST(smo_status AS FLOAT) AS s, scanorder, rid
  FROM vec_scans QUALIFY row_number() OVER (PARTITION BY pid ORDER BY scanorder DESC, rid) = 1) t,
  LATERAL (SELECT * FROM (VALUES (0, t.za), (1, t.zb), (2, t.g), (3, t.s)) v(dim, x)) c"""

register("seq_image_tabular", with_(A_VEC, SEQ.format(date="shifted_scandate")) + _seq_select(ZX, _expr_rows(TAB_LONG)))

register("time_encoding", with_(A_VEC, SEQ.format(date="scandate")) + f"""
SELECT pid, CAST(pos AS BIGINT) AS pos, CAST(dim AS BIGINT) AS dim,
       round(x + CASE WHEN dim % 2 = 0 THEN sin(time * exp((dim // 2) * 2 * {-math.log(10000.0) / 64!r}))
                      ELSE cos(time * exp((dim // 2) * 2 * {-math.log(10000.0) / 64!r})) END, 6) AS value
FROM img""")

register("l2_normalize", with_(EMB_LONG) + f"""
SELECT vec_id, CAST(dim AS BIGINT) AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 6) AS value FROM el""")

register("l2_normalize_zero", with_(EMB_LONG) + f"""
SELECT vec_id, CAST(dim AS BIGINT) AS dim,
       CASE WHEN vec_id % 7 <> 0 THEN round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 6) END AS value FROM el""")

register("zero_shot_scores", with_(A_VEC, SEQ.format(date="scandate"), f"""
img0 AS (SELECT f.pid, f.label, CAST(f.vec AS DOUBLE[]) AS v FROM filled f WHERE f.pos = 0),
logits AS (SELECT i.pid, i.label, c.class, {SCALE!r} * list_cosine_similarity(i.v, CAST(c.vec AS DOUBLE[])) AS z
           FROM img0 i JOIN class_vectors c ON c.pid = i.pid)""") + """
SELECT pid, CAST(any_value(label) AS BIGINT) AS label,
       round(exp(max(z) FILTER (WHERE class = 1) - max(z)) / sum(exp(z - (SELECT max(z2.z) FROM logits z2 WHERE z2.pid = l.pid))), 6) AS prob
FROM logits l GROUP BY pid""")

register("in_batch_contrastive", with_(A_VEC, SEQ.format(date="scandate"), f"""
items0 AS (SELECT f.pid, CAST(f.vec AS DOUBLE[]) AS img, CAST(t.vec AS DOUBLE[]) AS txt
           FROM filled f JOIN text_vectors t ON t.pid = f.pid WHERE f.pos = 0),
items AS (SELECT *, (row_number() OVER (ORDER BY {U("pid || '|0|1105'")}, pid || '|0') - 1) // 32 AS batch FROM items0),
pairs AS (SELECT a.batch, a.pid AS i, b.pid AS j, {SCALE!r} * list_cosine_similarity(a.img, b.txt) AS z
          FROM items a JOIN items b ON a.batch = b.batch),
rows_ AS (SELECT batch, i, ln(sum(exp(z - max_z))) + any_value(max_z) AS lse, max(z) FILTER (WHERE i = j) AS diag,
                 arg_max(j, z) AS best
          FROM (SELECT *, max(z) OVER (PARTITION BY batch, i) AS max_z FROM pairs) GROUP BY batch, i),
cols_ AS (SELECT batch, j, ln(sum(exp(z - max_z))) + any_value(max_z) AS lse, max(z) FILTER (WHERE i = j) AS diag
          FROM (SELECT *, max(z) OVER (PARTITION BY batch, j) AS max_z FROM pairs) GROUP BY batch, j),
per AS (SELECT r.batch, count(*) AS n, avg(r.lse - r.diag) AS li, avg(CASE WHEN r.best = r.i THEN 1.0 ELSE 0.0 END) AS acc
        FROM rows_ r GROUP BY r.batch),
per_t AS (SELECT batch, avg(lse - diag) AS lt FROM cols_ GROUP BY batch)""") + """
SELECT CAST(p.batch AS BIGINT) AS batch_id, CAST(p.n AS BIGINT) AS n, round((p.li + t.lt) / 2, 6) AS loss, round(p.acc, 6) AS acc
FROM per p JOIN per_t t ON p.batch = t.batch""")

register("tiled_contrastive", ORACLE["in_batch_contrastive"].replace("- 1) // 32 AS batch", "- 1) * 0 AS batch"))

register("fused_features", with_(A_VEC, SEQ.format(date="scandate")) + f"""
SELECT f.pid, CAST(d AS BIGINT) AS idx, {R6.format("CASE WHEN d < 64 THEN f.vec[d + 1] ELSE t.vec[d - 63] END")} AS value
FROM filled f JOIN text_vectors t ON t.pid = f.pid, unnest(range(128)) r(d) WHERE f.pos = 0""")


def _weights_sql(name: str, d_in: int, d_out: int, layer: int) -> str:
    return (f"{name} AS (SELECT i.range AS i, j.range AS j, sin({layer} + 1.0 + 0.37 * i.range + 1.91 * j.range) / sqrt({d_in}) AS w "
            f"FROM range({d_in}) i CROSS JOIN range({d_out}) j),\n"
            f"{name}_b AS (SELECT range AS j, 0.1 * cos({layer} + range) AS b FROM range({d_out}))")


register("project_vectors", with_(EMB_LONG, _weights_sql("w0", 64, 16, 0)) + f"""
SELECT el.vec_id, CAST(w0.j AS BIGINT) AS dim, {R6.format("CAST(sum(el.x * w0.w) + any_value(b.b) AS FLOAT)")} AS value
FROM el JOIN w0 ON el.dim = w0.i JOIN w0_b b ON b.j = w0.j GROUP BY el.vec_id, w0.j""")


def _layer(src: str, w: str, relu: bool) -> str:
    e = f"sum(s.x * {w}.w) + any_value({w}_b.b)"
    if relu:
        e = f"greatest({e}, 0.0)"
    return (f"SELECT s.vec_id, {w}.j AS dim, {e} AS x FROM {src} s JOIN {w} ON s.dim = {w}.i "
            f"JOIN {w}_b ON {w}_b.j = {w}.j GROUP BY s.vec_id, {w}.j")


register("text_encoder_mlp", with_(EMB_LONG, _weights_sql("w1", 64, 32, 1), _weights_sql("w2", 32, 32, 2),
                                   _weights_sql("w3", 32, 16, 3),
                                   f"h1 AS ({_layer('el', 'w1', True)})", f"h2 AS ({_layer('h1', 'w2', True)})",
                                   f"h3 AS ({_layer('h2', 'w3', False)})") + f"""
SELECT vec_id, CAST(dim AS BIGINT) AS dim, {R6.format("CAST(x AS FLOAT)")} AS value FROM h3""")

def hash_vectors_sql(items_cte: str, keys: str) -> str:
    """CTEs (after ``items(keys..., text)``) computing the signed hashing encoder, plus the final SELECT."""
    k = [c.strip() for c in keys.split(",")]
    on = " AND ".join(f"s.{c} = g.{c}" for c in k)
    onn = " AND ".join(f"n.{c} = g.{c}" for c in k)
    return items_cte + f""",
toks AS (SELECT {keys}, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS tok FROM items),
h AS (SELECT {keys}, ('0x' || substr(md5(tok), 1, 8))::BIGINT AS hv FROM toks),
sums AS (SELECT {keys}, hv % 64 AS dim, sum(CASE WHEN (hv // 64) % 2 = 0 THEN 1.0 ELSE -1.0 END) AS s FROM h GROUP BY {keys}, hv % 64),
norms AS (SELECT {keys}, sqrt(sum(s * s)) AS nrm FROM sums GROUP BY {keys}),
grid AS (SELECT {", ".join("i." + c for c in k)}, r.range AS dim FROM items i CROSS JOIN range(64) r)
SELECT {", ".join("g." + c for c in k)}, CAST(g.dim AS BIGINT) AS dim,
       {R6.format("CAST(CASE WHEN n.nrm > 0 THEN coalesce(s.s, 0.0) / n.nrm ELSE 0.0 END AS FLOAT)")} AS value
FROM grid g LEFT JOIN sums s ON {on} AND s.dim = g.dim LEFT JOIN norms n ON {onn}"""


register("hash_embed", with_(A_SCANS, COHORT, LATEST) + hash_vectors_sql(f"""
, items AS (SELECT pid, {BASE} AS text FROM latest)""".lstrip(", "), "pid").replace("items AS", "items AS", 1))
