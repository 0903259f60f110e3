"""Oracle SQL: AUC, accuracy, loss, bootstrap."""

from cohortlens.plans.oracle import A_PRED, HASH32, SEED, STREAM_U, Z95, poisson_case, register, with_

# Mann-Whitney with average ranks: (sum of positive ranks - P(P+1)/2) / (P*N)
_RANKED = """
ranked AS (
  SELECT {g} label,
         rank() OVER (PARTITION BY {p} ORDER BY {s}) + (count(*) OVER (PARTITION BY {p}, {s}) - 1) / 2.0 AS r
  FROM pred)"""


def _auc_sql(group: str | None, score: str) -> str:
    g = f"{group}, " if group else ""
    p = group if group else "1"
    cte = _RANKED.format(g=g, p=p, s=score)
    body = f"""
SELECT {g}round((sum(r) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0)
       / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0)), 6) AS auc
FROM ranked {"GROUP BY " + group if group else ""}"""
    return with_(A_PRED, cte) + body


register("auc_global", _auc_sql(None, "prob"))
register("auc_by_group", _auc_sql("l_linestatus", "prob"))
register("auc_many_scores", _auc_sql("l_linestatus", "score"))

register("accuracy_bce", with_(A_PRED, """
lg AS (SELECT l_linestatus, label, score, ln(score / (1 - score)) AS z FROM pred)""") + """
SELECT l_linestatus,
       round(avg(CASE WHEN (CASE WHEN score > 0.5 THEN 1 ELSE 0 END) = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       round(avg(greatest(z, 0) - z * label + ln(1 + exp(-abs(z)))), 6) AS bce,
       CAST(count(*) AS BIGINT) AS n
FROM lg GROUP BY l_linestatus""")


def _weighted(groups: str, n: int) -> str:
    return f"""
reps AS (SELECT range AS b FROM range({n})),
w0 AS (
  SELECT {groups}, b, label, prob, score, {STREAM_U(HASH32(f"rowkey || '|{SEED}'"), 'b')} AS u
  FROM pred CROSS JOIN reps),
w AS (SELECT *, {poisson_case('u')} AS wt FROM w0),
wp AS (SELECT * FROM w WHERE wt > 0)"""


def _rep_auc(groups: str, score: str = "prob") -> str:
    # weighted Mann-Whitney: each positive row counts the negative weight below
    # its score plus half the negative weight at its score (RANGE peers)
    return f"""
negs AS (
  SELECT {groups}, b, label, wt, {score} AS s,
         sum(CASE WHEN label = 0 THEN wt ELSE 0 END) OVER (PARTITION BY {groups}, b ORDER BY {score}
             RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS neg_le,
         sum(CASE WHEN label = 0 THEN wt ELSE 0 END) OVER (PARTITION BY {groups}, b, {score}) AS neg_eq
  FROM wp),
rep_auc AS (
  SELECT {groups}, b,
         CASE WHEN sum(CASE WHEN label = 1 THEN wt ELSE 0 END) > 0 AND sum(CASE WHEN label = 0 THEN wt ELSE 0 END) > 0
              THEN sum(CASE WHEN label = 1 THEN wt * (neg_le - neg_eq / 2.0) ELSE 0 END)
                   / (sum(CASE WHEN label = 1 THEN wt ELSE 0 END) * sum(CASE WHEN label = 0 THEN wt ELSE 0 END)) END AS m
  FROM negs GROUP BY {groups}, b)"""


def _ci(src: str, col: str, i: int) -> str:
    me = f"{Z95} * stddev_pop({col}) / sqrt(count({col}))"
    return (f"round(avg({col}), 6) AS mean_{i}, round(avg({col}) - {me}, 6) AS lci_{i}, "
            f"round(avg({col}) + {me}, 6) AS uci_{i}")


register("bootstrap_auc", with_(A_PRED, _weighted("l_linestatus", 100), _rep_auc("l_linestatus")) + f"""
SELECT l_linestatus, {_ci('rep_auc', 'm', 0)} FROM rep_auc GROUP BY l_linestatus""")

register("bootstrap_auc_scores", with_(A_PRED, _weighted("l_linestatus", 100), _rep_auc("l_linestatus", "score")) + f"""
SELECT l_linestatus, {_ci('rep_auc', 'm', 0)} FROM rep_auc GROUP BY l_linestatus""")

register("bootstrap_small_groups", with_(
    A_PRED, """
pg AS (SELECT *, CAST(split_part(rowkey, '|', 1) AS BIGINT) * 2 + CAST(CAST(split_part(rowkey, '|', 2) AS BIGINT) > 4 AS BIGINT) AS grp
       FROM pred)""",
    _weighted("grp", 20).replace("score, (", "score, ln(score) AS log_score, (", 1).replace("FROM pred CROSS JOIN", "FROM pg CROSS JOIN"), """
reps2 AS (SELECT grp, b,
    sum(wt * CASE WHEN (CASE WHEN score > 0.5 THEN 1 ELSE 0 END) = label THEN 1.0 ELSE 0.0 END) / nullif(sum(wt), 0) AS a,
    sum(wt * log_score) / nullif(sum(wt), 0) AS m FROM w GROUP BY grp, b)""") + f"""
SELECT grp, {_ci('reps2', 'a', 0)}, {_ci('reps2', 'm', 1)} FROM reps2 GROUP BY grp""")

register("bootstrap_multi_metric", with_(
    A_PRED,
    _weighted("g", 100).replace("FROM pred CROSS JOIN", "FROM (SELECT *, 0 AS g FROM pred) CROSS JOIN"),
    _rep_auc("g"), """
rep_acc AS (
  SELECT g, b, sum(wt * CASE WHEN (CASE WHEN score > 0.5 THEN 1 ELSE 0 END) = label THEN 1.0 ELSE 0.0 END) / sum(wt) AS a
  FROM wp GROUP BY g, b),
both_ AS (SELECT r.b, r.m, a.a FROM rep_auc r JOIN rep_acc a ON r.b = a.b)""") + f"""
SELECT {_ci('both_', 'm', 0)}, {_ci('both_', 'a', 1)} FROM both_""")

register("bootstrap_exact_sizes", with_(A_PRED) + """
SELECT l_linestatus, range AS replicate, CAST(count(*) AS BIGINT) AS drawn, CAST(1 AS BIGINT) AS near
FROM pred CROSS JOIN range(100) GROUP BY l_linestatus, range""")

register("bootstrap_python_scalar", with_(A_PRED, _weighted("l_linestatus", 50), """
reps2 AS (SELECT l_linestatus, b, sum(wt * score) FILTER (WHERE label = 1) / nullif(sum(wt) FILTER (WHERE label = 1), 0) AS m
  FROM w GROUP BY l_linestatus, b)""") + f"""
SELECT l_linestatus, {_ci('reps2', 'm', 0)} FROM reps2 GROUP BY l_linestatus""")

register("bootstrap_python_tuple", with_(A_PRED, _weighted("l_linestatus", 50), """
reps2 AS (SELECT l_linestatus, b,
    sum(wt) FILTER (WHERE label = 1 AND score > 0.5) / nullif(sum(wt) FILTER (WHERE label = 1), 0) AS sens,
    sum(wt) FILTER (WHERE label = 0 AND score <= 0.5) / nullif(sum(wt) FILTER (WHERE label = 0), 0) AS spec,
    sum(CASE WHEN CAST(score > 0.5 AS INT) = label THEN wt ELSE 0 END) / sum(wt) AS acc
  FROM w GROUP BY l_linestatus, b)""") + f"""
SELECT l_linestatus, {_ci('reps2', 'sens', 0)}, {_ci('reps2', 'spec', 1)}, {_ci('reps2', 'acc', 2)} FROM reps2 GROUP BY l_linestatus""")

_EMPTY_PRED = """
pe AS (
  SELECT rowkey, label, prob, score, l_linestatus,
         CASE WHEN l_linestatus = 'O' AND prob >= 0.05 THEN 'hi' WHEN prob < 0.05 THEN 'lo' ELSE 'mid' END AS band
  FROM pred)"""

register("bootstrap_empty_cells", with_(
    A_PRED, _EMPTY_PRED,
    _weighted("l_linestatus, band", 100).replace("FROM pred CROSS JOIN", "FROM pe CROSS JOIN"),
    _rep_auc("l_linestatus, band"), """
cells AS (SELECT a.l_linestatus, b.band FROM (SELECT DISTINCT l_linestatus FROM pe) a CROSS JOIN (SELECT DISTINCT band FROM pe) b),
summary AS (
  SELECT l_linestatus, band, avg(m) AS mu, stddev_pop(m) AS sd, count(m) AS n FROM rep_auc GROUP BY l_linestatus, band)""") + f"""
SELECT c.l_linestatus, c.band,
       round(s.mu, 6) AS mean_0, round(s.mu - {Z95} * s.sd / sqrt(s.n), 6) AS lci_0, round(s.mu + {Z95} * s.sd / sqrt(s.n), 6) AS uci_0
FROM cells c LEFT JOIN summary s ON c.l_linestatus = s.l_linestatus AND c.band = s.band""")

register("logit_metrics", with_(A_PRED, """
lg AS (SELECT l_linestatus, label, ln(score / (1 - score)) AS z FROM pred)""") + """
SELECT l_linestatus,
       round(avg(1 / (1 + exp(-(z - 0.0)))), 6) AS mean_softmax,
       round(avg(1 / (1 + exp(-z))), 6) AS mean_sigmoid,
       round(avg(CASE WHEN (CASE WHEN z > 0.0 THEN 1 ELSE 0 END) = label THEN 1.0 ELSE 0.0 END), 6) AS argmax_acc,
       round(avg(((0 - 0 * (1 - label) + ln(1 + exp(-0.0)))
                 + (greatest(z, 0) - z * label + ln(1 + exp(-abs(z))))) / 2), 6) AS bce_onehot,
       round(avg(greatest(z, 0) - z * label + ln(1 + exp(-abs(z)))), 6) AS bce_single
FROM lg GROUP BY l_linestatus""")
