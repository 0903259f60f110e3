"""Oracle SQL: cohort curation."""

from cohortlens.plans.oracle import A_SCANS, A_TEST_LIST, ORACLE, register, with_

# columns of the scans adapter, in order
SCAN_COLS = ("pid rid scandate scanorder age bmi quit_time smo_duration smo_intensity pkyr gender race copd "
             "emphysema phist fhist smo_status duration scan_fup_days lung_cancer cancer_year1 lc_subtype "
             "fup_days slice_thickness nodule_size nodule_count").split()
DOUBLES = {"age", "bmi", "quit_time", "smo_duration", "smo_intensity", "pkyr", "slice_thickness", "nodule_size",
           "nodule_count"}
INTS = {"rid", "scanorder", "gender", "race", "copd", "emphysema", "phist", "fhist", "smo_status", "duration",
        "scan_fup_days", "lung_cancer", "cancer_year1", "fup_days"}


def out(c: str, alias: str | None = None, src: str | None = None) -> str:
    """Presentation: round doubles, bigint ints, ISO dates."""
    e = src or c
    a = alias or c
    if c in DOUBLES:
        return f"round({e}, 6) AS {a}"
    if c in INTS or c in ("study_yr", "nodule_rid", "n", "n_scans", "n_subjects", "label"):
        return f"CAST({e} AS BIGINT) AS {a}"
    return f"{e} AS {a}"


_MAXES = ", ".join(f"max({c}) AS {c}" for c in SCAN_COLS if c not in ("pid", "scandate"))

COHORT = f"""
sc0 AS (SELECT pid, scandate, {_MAXES} FROM scans WHERE scandate IS NOT NULL GROUP BY pid, scandate),
sc1 AS (SELECT s.*, m.maxdate FROM sc0 s LEFT JOIN (SELECT pid, max(scandate) AS maxdate FROM sc0 GROUP BY pid) m ON s.pid = m.pid),
cohort AS (
  SELECT * REPLACE (strftime(scandate, '%Y') AS scandate, gender - 1 AS gender),
         strftime(maxdate - duration, '%Y%m%d') AS shifted_scandate,
         scan_fup_days AS lc_fup_days
  FROM sc1)"""

COHORT_COLS = [c for c in SCAN_COLS] + ["maxdate", "shifted_scandate", "lc_fup_days"]


def _present_cohort(cols=COHORT_COLS, prefix="") -> str:
    parts = []
    for c in cols:
        if c == "maxdate":
            parts.append(f"strftime({prefix}maxdate, '%Y-%m-%d') AS maxdate")
        elif c == "lc_fup_days":
            parts.append(f"CAST({prefix}lc_fup_days AS BIGINT) AS lc_fup_days")
        else:
            parts.append(out(c, c, prefix + c))
    return ", ".join(parts)


register("cohort_dedupe_max", with_(A_SCANS, COHORT) + f"""
SELECT {", ".join(out(c) if c != "scandate" else "strftime(scandate, '%Y-%m-%d') AS scandate" for c in SCAN_COLS)}
FROM sc0""")

_FIRSTS = ", ".join(
    ("min(rid) AS rid" if c == "rid" else f"arg_min({c}, rid) FILTER (WHERE {c} IS NOT NULL) AS {c}")
    for c in COHORT_COLS if c not in ("pid", "scandate"))

FIRST = f"""
firsts AS (SELECT pid, scandate, {_FIRSTS} FROM cohort GROUP BY pid, scandate)"""

register("cohort_first_non_null", with_(A_SCANS, COHORT, FIRST) + f"""
SELECT {_present_cohort()} FROM firsts""")

register("latest_scan", with_(A_SCANS, COHORT) + f"""
SELECT {_present_cohort()} FROM cohort WHERE scanorder IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY pid ORDER BY scanorder DESC, rid ASC) = 1""")

register("shifted_dates", with_(A_SCANS, COHORT) + f"""
SELECT {_present_cohort(["pid", "scandate", "rid", "scanorder", "maxdate", "duration", "shifted_scandate", "gender", "lc_fup_days"])}
FROM cohort""")

STUDY = """
yrs AS (SELECT *, dense_rank() OVER (PARTITION BY pid ORDER BY scandate) - 1 AS study_yr FROM firsts)"""

register("study_year", with_(A_SCANS, COHORT, FIRST, STUDY) + """
SELECT pid, scandate, CAST(rid AS BIGINT) AS rid, CAST(study_yr AS BIGINT) AS study_yr FROM yrs""")

_TEST_COLS = COHORT_COLS + ["study_yr", "patient_id"]
_TMAX = ", ".join(f"max({c}) AS {c}" for c in _TEST_COLS if c not in ("pid", "study_yr"))
TEST = f"""
tj AS (SELECT y.*, t.patient_id FROM yrs y JOIN test_list t ON y.pid = t.patient_id AND y.study_yr = t.study_yr),
test AS (SELECT pid, study_yr, {_TMAX} FROM tj GROUP BY pid, study_yr)"""

register("test_split_join", with_(A_SCANS, A_TEST_LIST, COHORT, FIRST, STUDY, TEST) + f"""
SELECT {_present_cohort()}, CAST(study_yr AS BIGINT) AS study_yr, patient_id FROM test""")

register("train_anti", with_(A_SCANS, A_TEST_LIST, COHORT, FIRST, STUDY, TEST) + f"""
SELECT {_present_cohort()} FROM firsts WHERE pid NOT IN (SELECT pid FROM test)""")

register("thin_slice", with_(A_SCANS) + """
SELECT pid, CAST(rid AS BIGINT) AS rid, strftime(scandate, '%Y-%m-%d') AS scandate, round(slice_thickness, 6) AS slice_thickness
FROM scans WHERE slice_thickness < 5 AND scandate IS NOT NULL""")

register("nodule_patients", with_(A_SCANS, A_TEST_LIST, COHORT, FIRST, STUDY, TEST) + """
SELECT pid, CAST(study_yr AS BIGINT) AS study_yr, CAST(scanorder AS BIGINT) AS scanorder, CAST(rid AS BIGINT) AS rid,
       round(nodule_count, 6) AS nodule_count
FROM test t
WHERE EXISTS (
  SELECT 1 FROM (SELECT pid, nodule_count FROM test WHERE scanorder IS NOT NULL
                 QUALIFY row_number() OVER (PARTITION BY pid ORDER BY scanorder DESC, rid) = 1) l
  WHERE l.pid = t.pid AND l.nodule_count IS NOT NULL)""")

register("nodule_join_fanout", with_(A_SCANS, A_TEST_LIST, COHORT, FIRST, STUDY, TEST) + """,
ids AS (SELECT pid, scandate, scanorder, rid FROM cohort WHERE pid IN (SELECT pid FROM test)),
fan AS (SELECT i.*, c.nodule_count, c.rid AS nodule_rid FROM ids i JOIN cohort c ON i.pid = c.pid AND i.scandate = c.scandate),
lat AS (SELECT pid, nodule_count FROM fan WHERE scanorder IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY pid ORDER BY scanorder DESC, rid, nodule_rid) = 1)
SELECT pid, scandate, CAST(scanorder AS BIGINT) AS scanorder, CAST(rid AS BIGINT) AS rid, CAST(nodule_rid AS BIGINT) AS nodule_rid,
       round(nodule_count, 6) AS nodule_count
FROM fan WHERE pid IN (SELECT pid FROM lat WHERE nodule_count IS NOT NULL)""")

register("cohort_profile", with_(A_SCANS, COHORT) + """
SELECT CAST(lung_cancer AS BIGINT) AS label, CAST(count(*) AS BIGINT) AS n,
       (SELECT CAST(count(*) AS BIGINT) FROM cohort) AS n_scans,
       (SELECT CAST(count(DISTINCT pid) AS BIGINT) FROM cohort) AS n_subjects
FROM cohort WHERE lung_cancer IS NOT NULL GROUP BY lung_cancer""")

register("profile_no_label", with_(A_SCANS, COHORT) + """
SELECT CAST(NULL AS BIGINT) AS label, CAST(0 AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS n_scans,
       CAST(count(DISTINCT pid) AS BIGINT) AS n_subjects FROM cohort""")

_DATE_SRC = """
src AS (
  SELECT o_orderkey AS rid,
         CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y%m%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d')
              WHEN 2 THEN strftime(o_orderdate, '%Y')
              WHEN 3 THEN CASE o_orderkey // 5 % 6 WHEN 0 THEN 'n/a' WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT10:00:00')
                WHEN 2 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 3 THEN strftime(o_orderdate, '%-d %b %Y')
                WHEN 4 THEN strftime(o_orderdate, '%Y-%m-%d 10:00:00.5') ELSE strftime(o_orderdate, '%Y-%m') END END AS raw_text,
         CASE WHEN o_orderkey % 5 IN (0, 1) THEN CAST(o_orderdate AS DATE) WHEN o_orderkey % 5 = 2 THEN date_trunc('year', o_orderdate)::DATE
              WHEN o_orderkey % 5 = 3 AND o_orderkey // 5 % 6 IN (1, 2, 3, 4) THEN CAST(o_orderdate AS DATE)
              WHEN o_orderkey % 5 = 3 AND o_orderkey // 5 % 6 = 5 THEN date_trunc('month', o_orderdate)::DATE END AS d,
         CASE WHEN o_orderkey % 5 = 4 THEN CAST(strftime(o_orderdate, '%Y%m%d') AS BIGINT) END AS raw_num
  FROM orders),
p AS (
  SELECT *, CAST(try_strptime(CAST(raw_num AS VARCHAR), '%Y%m%d') AS DATE) AS dn
  FROM src)"""

register("parse_dates", with_(_DATE_SRC) + """
SELECT CAST(rid AS BIGINT) AS rid, raw_text, CAST(raw_num AS BIGINT) AS raw_num, strftime(d, '%Y-%m-%d') AS parsed,
       strftime(d, '%Y%m%d') AS ymd, strftime(d, '%Y') AS year, strftime(dn, '%Y%m%d') AS num_ymd
FROM p""")

register("vector_key", with_(A_SCANS, COHORT) + """
SELECT pid, CAST(rid AS BIGINT) AS rid, pid || 'time' || shifted_scandate AS vkey, pid AS pid_back, shifted_scandate AS date_back
FROM cohort""")

from cohortlens.plans.oracle import U  # noqa: E402

register("row_sample", with_(A_SCANS, COHORT) + f""",
r AS (SELECT pid, rid, scandate, row_number() OVER (ORDER BY {U("concat_ws('|', CAST(rid AS VARCHAR), '1105')")}, rid) AS pos,
             count(*) OVER () AS n FROM cohort)
SELECT pid, CAST(rid AS BIGINT) AS rid, scandate FROM r WHERE pos <= round_even(0.3 * n, 0)""")

register("stratified_split", with_(A_SCANS, COHORT) + f""",
cs AS (SELECT pid, max(lung_cancer) AS lab FROM cohort GROUP BY pid HAVING max(lung_cancer) IS NOT NULL),
r AS (SELECT pid, row_number() OVER (PARTITION BY lab ORDER BY {U("concat_ws('|', pid, '1105')")}, pid) AS pos,
             count(*) OVER (PARTITION BY lab) AS n FROM cs),
val AS (SELECT pid FROM r WHERE pos <= round_even(0.2 * n, 0))
SELECT pid, CAST(rid AS BIGINT) AS rid, CASE WHEN pid IN (SELECT pid FROM val) THEN 'val' ELSE 'train' END AS split
FROM cohort""")

register("profile_of_parts", with_(A_SCANS, COHORT, """
yc AS (SELECT pid, dense_rank() OVER (PARTITION BY pid ORDER BY scandate) - 1 AS yr FROM cohort)""") + """
SELECT CAST(yr AS BIGINT) AS study_yr, count(*) AS n_scans, count(DISTINCT pid) AS n_subjects, CAST(1 AS BIGINT) AS near FROM yc GROUP BY yr
UNION ALL SELECT NULL, count(*), count(DISTINCT pid), 1 FROM yc""")

register("impute_two_col", with_(A_SCANS) + """
SELECT pid, CAST(rid AS BIGINT) AS rid, round(age, 6) AS age,
       round(coalesce(bmi, (SELECT regr_intercept(bmi, age) FROM scans) + (SELECT regr_slope(bmi, age) FROM scans) * age), 6) AS bmi
FROM scans""")

from cohortlens.plans.oracle import A_TEST_LIST  # noqa: E402

_IMPUTED = """
imputed AS (
  SELECT pid, rid, scanorder, nodule_count, age,
         coalesce(bmi, (SELECT regr_intercept(bmi, age) FROM scans) + (SELECT regr_slope(bmi, age) FROM scans) * age) AS bmi
  FROM scans)"""

register("imputed_two_col_test_patients", with_(A_SCANS, A_TEST_LIST, COHORT, FIRST, STUDY, TEST, _IMPUTED) + """
SELECT pid, CAST(rid AS BIGINT) AS rid, round(age, 6) AS age, round(bmi, 6) AS bmi
FROM imputed WHERE pid IN (SELECT pid FROM test)""")

register("imputed_nodule_patients", with_(A_SCANS, _IMPUTED, """
lat AS (SELECT pid, nodule_count FROM imputed WHERE scanorder IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY pid ORDER BY scanorder DESC, rid) = 1)""") + """
SELECT pid, CAST(rid AS BIGINT) AS rid, nodule_count, round(age, 6) AS age, round(bmi, 6) AS bmi
FROM imputed WHERE pid IN (SELECT pid FROM lat WHERE nodule_count IS NOT NULL)""")

register("cohort_with_patients", with_(A_SCANS) + """
SELECT s.pid, CAST(s.rid AS BIGINT) AS rid, strftime(s.scandate, '%Y-%m-%d') AS scandate,
       CAST(s.lung_cancer AS BIGINT) AS lung_cancer, c.c_mktsegment AS site, CAST(c.c_nationkey AS BIGINT) AS nation
FROM scans s LEFT JOIN customer c ON s.pid = CAST(c.c_custkey AS VARCHAR)""")

register("impute_by_rows", ORACLE["impute_two_col"])
