"""Independent DuckDB SQL for every registered query (the correctness oracle).

Each query is ``WITH <adapters>, <steps> SELECT ...`` over the driver's
pre-registered views.  The adapters restate ``cohortlens.sources.testdata``
section 2), not from the Spark code, and where possible use a different
formulation (e.g. average-rank Mann-Whitney for AUC, RANGE frames, ordered
aggregates).  Doubles are rounded to 6 places and integers cast to BIGINT
to match ``cohortlens.plans.present``.
"""

from __future__ import annotations

SEED = 1105  # fixed value: default seed of the modelled workflow
Z95 = 1.959963984540054  # fixed value: standard normal 97.5% quantile


def U(text: str) -> str:
    """Uniform in [0,1) from md5 of a text expression (same rule as Spark side)."""
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0)"


def HASH32(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT)"


def MIX(x: str) -> str:
    """Same 32-bit mixer as ``cohortlens.functions.hashing.mix32``."""
    for _ in range(2):
        x = f"((xor({x} >> 16, {x}) * 73244475) & 4294967295)"
    return f"xor({x} >> 16, {x})"


def STREAM_U(base: str, idx: str) -> str:
    return f"({MIX(f'(({base}) + CAST({idx} AS BIGINT) * 2654435769) & 4294967295')} / 4294967296.0)"


def poisson_case(u: str) -> str:
    from cohortlens.functions.hashing import poisson_thresholds
    th = poisson_thresholds()
    parts = " ".join(f"WHEN {u} < {c!r} THEN {k}" for k, c in enumerate(th))
    return f"(CASE {parts} ELSE {len(th)} END)"


# ---------------------------------------------------------------- adapters
A_SCANS = """
scans AS (
  SELECT CAST(o_custkey AS VARCHAR) AS pid,
         o_orderkey AS rid,
         CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS scandate,
         CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INTEGER) AS scanorder,
         CAST(40 + o_custkey % 40 AS DOUBLE) AS age,
         CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 18 + o_totalprice / 25000 END AS bmi,
         CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 30 AS DOUBLE) END AS quit_time,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(10 + o_custkey % 35 AS DOUBLE) END AS smo_duration,
         CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice / 5000 END AS smo_intensity,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice / 10000 END AS pkyr,
         CAST(1 + o_custkey % 2 AS INTEGER) AS gender,
         CAST(o_custkey % 7 AS INTEGER) AS race,
         CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderkey % 2 AS INTEGER) END AS copd,
         CASE WHEN o_orderkey % 3 = 1 THEN 1 ELSE 0 END AS emphysema,
         CASE WHEN o_custkey % 5 = 0 THEN 1 ELSE 0 END AS phist,
         CASE WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END AS fhist,
         CASE WHEN o_orderkey % 4 = 1 THEN 1 ELSE 0 END AS smo_status,
         CAST(o_orderkey % 365 AS INTEGER) AS duration,
         CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST((o_orderkey * 7) % 2000 - 300 AS INTEGER) END AS scan_fup_days,
         CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS lung_cancer,
         CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS cancer_year1,
         CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 'adenocarcinoma'
              WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 1 THEN 'squamous cell carcinoma' END AS lc_subtype,
         CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST((o_orderkey * 7) % 2000 - 300 AS INTEGER) END AS fup_days,
         CAST(1 + (o_orderkey % 9) * 0.5 AS DOUBLE) AS slice_thickness,
         CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 23 AS DOUBLE) * 1.5 END AS nodule_size,
         CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 7 AS DOUBLE) END AS nodule_count
  FROM orders)"""

A_TEST_LIST = f"""
chosen AS (SELECT c_custkey FROM customer WHERE {U("concat_ws('|', 'test', CAST(c_custkey AS VARCHAR), '1105')")} < 0.2),
test_list AS (
  SELECT CAST(c_custkey AS VARCHAR) AS patient_id, CAST(c_custkey % 3 AS INTEGER) AS study_yr FROM chosen
  UNION ALL
  SELECT CAST(c_custkey AS VARCHAR), CAST(c_custkey % 3 AS INTEGER) FROM chosen WHERE c_custkey % 4 = 0
  UNION ALL
  SELECT CAST(c_custkey + 100000000 AS VARCHAR), 0 FROM customer WHERE c_custkey % 50 = 0)"""

A_VEC = """
vpos AS (SELECT *, CASE WHEN vec_id % 15 IN (0) THEN 0 WHEN vec_id % 15 IN (1, 2) THEN 1 WHEN vec_id % 15 IN (3, 4, 5) THEN 2
                   WHEN vec_id % 15 IN (6, 7, 8, 9) THEN 3 ELSE 4 END AS j FROM embeddings),
vbase AS (SELECT vec_id, vec_id // 15 * 5 + j AS k, CAST(vec_id % 15 - [0, 1, 3, 6, 10][j + 1] AS INTEGER) AS slot, embedding AS vec, label FROM vpos),
vec_scans AS (
  SELECT 'p' || CAST(k AS VARCHAR) AS pid, vec_id AS rid, slot AS scanorder,
         DATE '2000-01-01' + CAST(slot * 200 + k % 50 AS INTEGER) AS scandate,
         DATE '2000-01-01' + CAST(slot * 200 + k % 50 AS INTEGER) - CAST(vec_id % 3 AS INTEGER) AS shifted_scandate,
         CAST(label % 2 AS INTEGER) AS lung_cancer,
         CAST(40 + k % 40 AS DOUBLE) AS age,
         CASE WHEN vec_id % 6 = 1 THEN NULL ELSE CAST(20 + (vec_id % 13) * 0.5 AS DOUBLE) END AS bmi,
         CAST(k % 2 AS INTEGER) AS gender,
         CAST((k + 1) % 2 AS INTEGER) AS smo_status
  FROM vbase),
scan_vectors AS (
  SELECT s.pid, strftime(s.scandate, '%Y%m%d') AS scan_key, b.vec
  FROM vec_scans s JOIN vbase b ON s.rid = b.vec_id),
text_vectors AS (SELECT 'p' || CAST(k AS VARCHAR) AS pid, 'plain' AS variant, vec FROM vbase WHERE slot = 0),
class_vectors AS (SELECT 'p' || CAST(vec_id // 2 AS VARCHAR) AS pid, CAST(vec_id % 2 AS INTEGER) AS class, embedding AS vec FROM embeddings)"""

A_PRED = """
pred AS (
  SELECT concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS rowkey,
         l_returnflag, l_linestatus,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
         CASE WHEN l_discount = 0 THEN 0.0 ELSE l_discount END AS prob,
         l_extendedprice / 105000.0 AS score
  FROM lineitem)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


ORACLE: dict[str, str] = {}


def register(name: str, sql: str) -> None:
    ORACLE[name] = sql


def all_sql() -> dict[str, str]:
    from cohortlens.plans.oracle import metrics, cohort, text, vectors, models  # noqa: F401  (register)
    return dict(ORACLE)
