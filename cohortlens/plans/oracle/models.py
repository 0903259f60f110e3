"""Oracle SQL: ranking, label projection, class counts."""

from cohortlens.plans.oracle import A_SCANS, register, with_
from cohortlens.plans.oracle.cohort import COHORT

register("importance_top", """
WITH el AS (SELECT label % 2 AS cls, d AS idx, CAST(embedding[d + 1] AS DOUBLE) AS x
            FROM embeddings, unnest(range(len(embedding))) t(d)),
w AS (SELECT idx, abs(avg(x) FILTER (WHERE cls = 1) - avg(x) FILTER (WHERE cls = 0)) AS importance FROM el GROUP BY idx),
r AS (SELECT idx, importance, row_number() OVER (ORDER BY importance DESC, idx) AS rank,
             count(*) OVER () AS n FROM w)
SELECT CAST(rank AS BIGINT) AS rank, CAST(idx AS BIGINT) AS idx, round(importance, 6) AS importance
FROM r WHERE rank <= round_even(0.1 * n, 0)""")

register("latest_label", with_(A_SCANS, COHORT) + """
SELECT pid, CAST(coalesce(lung_cancer, 0) AS BIGINT) AS label FROM cohort WHERE scanorder IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY pid ORDER BY scanorder DESC, rid) = 1""")

register("label_classes", """
WITH dl AS (SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT CAST(count(DISTINCT quality) AS BIGINT) AS n_classes,
       CAST(count(DISTINCT quality) + max(CASE WHEN quality IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_classes_with_null
FROM dl""")

# L5 reads the predictions back from CSV: same rows, keys and values as bootstrap_auc
from cohortlens.plans.oracle import ORACLE  # noqa: E402
from cohortlens.plans.oracle import metrics as _m  # noqa: E402,F401

register("job_bootstrap", ORACLE["bootstrap_auc"])

from cohortlens.plans.oracle import A_VEC, U  # noqa: E402
from cohortlens.plans.oracle.text import BASE, LATEST  # noqa: E402
from cohortlens.plans.oracle.vectors import R6, SEQ, hash_vectors_sql  # noqa: E402
from cohortlens.plans.oracle import vectors as _v  # noqa: E402,F401

# L4 produces the same predictions as the zero-shot scoring query
register("job_zeroshot", ORACLE["zero_shot_scores"])

register("job_class_embed", with_(A_SCANS, COHORT, LATEST) + hash_vectors_sql(f"""
, items AS (SELECT pid, CAST(c.class AS BIGINT) AS class, concat_ws(' ', CASE WHEN {BASE} <> '' THEN {BASE} END,
                 CASE WHEN c.class = 1 THEN 'The subject was diagnosed with lung cancer.'
                      ELSE 'The subject was not diagnosed with lung cancer.' END) AS text
            FROM latest CROSS JOIN (VALUES (0), (1)) c(class))""", "pid, class"))

_SAMPLE = f"""
vs_sample AS (SELECT * FROM vec_scans
              QUALIFY row_number() OVER (ORDER BY {U("concat_ws('|', CAST(rid AS VARCHAR), '1105')")}, rid)
                      <= round_even(0.5 * count(*) OVER (), 0))"""

register("job_predict", with_(A_VEC, _SAMPLE, SEQ.format(date="scandate").replace("FROM vec_scans", "FROM vs_sample")) + f"""
SELECT f.pid, CAST(d AS BIGINT) AS idx, {R6.format("CASE WHEN d < 64 THEN f.vec[d + 1] ELSE t.vec[d - 63] END")} AS value
FROM filled f JOIN text_vectors t ON t.pid = f.pid, unnest(range(128)) r(d) WHERE f.pos = 0""")

from cohortlens.plans.oracle import A_TEST_LIST  # noqa: E402
from cohortlens.plans.oracle.cohort import FIRST, STUDY, TEST  # noqa: E402
from cohortlens.plans.oracle.text import OUTCOME, SUB, VARS, _json_obj  # noqa: E402

register("job_embed", with_(A_SCANS, A_TEST_LIST, COHORT, FIRST, STUDY, TEST, """
train AS (SELECT * FROM firsts WHERE pid NOT IN (SELECT pid FROM test)),
tlatest AS (SELECT * FROM train WHERE scanorder IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY pid ORDER BY scanorder DESC, rid) = 1)""") + hash_vectors_sql(f"""
, items AS (
  SELECT pid, 'plain' AS variant, {BASE} AS text FROM tlatest
  UNION ALL
  SELECT pid, 'label' AS variant,
         CASE WHEN {BASE} = '' THEN concat_ws(' ', {OUTCOME}, {SUB}) ELSE concat_ws(' ', {BASE}, {OUTCOME}, {SUB}) END FROM tlatest
  UNION ALL
  SELECT pid, 'json' AS variant, CAST({_json_obj(VARS)} AS VARCHAR) FROM tlatest)""", "pid, variant"))

# what a sink wrote reads back as the job's result
register("sink_features", ORACLE["job_predict"])
register("sink_text_vectors", ORACLE["job_embed"])
register("sink_text_vectors_by_variant", ORACLE["job_embed"])
register("sink_class_vectors", ORACLE["job_class_embed"])

from cohortlens.plans.oracle import A_PRED  # noqa: E402

register("newton_head", with_(A_PRED, """
x AS (SELECT label, unnest([1.0, score, prob, score * prob, CAST(l_linestatus = 'O' AS INT)]) AS x, unnest(range(5)) AS idx FROM pred)""") + """
SELECT idx, round(avg(x * label), 6) AS observed, round(avg(x * label), 6) AS fitted FROM x GROUP BY idx""")

register("sink_predictions", with_(A_PRED) + """
SELECT rowkey AS pid, CAST(label AS BIGINT) AS label, round(prob, 6) AS prob FROM pred""")

# the head of job_test: w_i = sin(1 + 0.37 i) / sqrt(128), b = 0.1
register("job_test", with_(A_VEC, SEQ.format(date="scandate")) + """,
z AS (SELECT f.pid, f.label, sum((CASE WHEN d < 64 THEN f.vec[d + 1] ELSE t.vec[d - 63] END)::DOUBLE * sin(1 + 0.37 * d) / sqrt(128)) + 0.1 AS z
      FROM filled f JOIN text_vectors t ON t.pid = f.pid, unnest(range(128)) r(d) WHERE f.pos = 0 GROUP BY f.pid, f.label)
SELECT pid, CAST(label AS BIGINT) AS label, round(1 / (1 + exp(-z)), 6) AS prob FROM z""")

register("evaluate_predictions", with_(A_PRED, """
r AS (SELECT label, score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r,
             ln(score / (1 - score)) AS z FROM pred)""") + """
SELECT round((sum(r) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0)
             / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0)), 6) AS auc,
       round(avg(CASE WHEN (CASE WHEN score > 0.5 THEN 1 ELSE 0 END) = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       round(avg(greatest(z, 0) - z * label + ln(1 + exp(-abs(z)))), 6) AS loss, CAST(count(*) AS BIGINT) AS n FROM r""")

register("alignment_moments", with_(A_VEC, SEQ.format(date="scandate")) + """,
z AS (SELECT list_concat([1.0::DOUBLE], list_concat(CAST(f.vec AS DOUBLE[]), CAST(t.vec AS DOUBLE[]))) AS z
      FROM filled f JOIN text_vectors t ON t.pid = f.pid WHERE f.pos = 0)
SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(sum(z[i + 1] * z[j + 1]), 6) AS value
FROM z, unnest(range(129)) a(i), unnest(range(129)) b(j) WHERE i <= j GROUP BY i, j""")
