"""Oracle SQL: clinical text rendering."""

from cohortlens.functions.text import JSON_KEYS, RACE_LABELS, TEMPLATES
from cohortlens.plans.oracle import A_SCANS, register, with_
from cohortlens.plans.oracle.cohort import COHORT

LATEST = """
latest AS (SELECT * FROM cohort WHERE scanorder IS NOT NULL
           QUALIFY row_number() OVER (PARTITION BY pid ORDER BY scanorder DESC, rid) = 1)"""

VARS = ["age", "bmi", "quit_time", "smo_duration", "smo_intensity", "pkyr",
        "gender", "race", "copd", "emphysema", "phist", "fhist", "smo_status"]


def _sentence(v: str) -> str:
    t = TEMPLATES[v]
    head, rest = t.split("{", 1)
    slot, tail = rest.split("}", 1)
    h, tl = head.replace("'", "''"), tail.replace("'", "''")
    if slot == "int":
        val = f"CAST(CAST(trunc({v}) AS BIGINT) AS VARCHAR)"
    elif slot == "2dp":
        val = f"printf('%.2f', {v})"
    elif slot == "race":
        cases = " ".join(f"WHEN {k} THEN '{lab}'" for k, lab in RACE_LABELS.items())
        val = f"(CASE CAST(trunc({v}) AS INTEGER) {cases} END)"
    else:
        yes, no = slot.split("|")
        val = f"(CASE WHEN {v} = 1 THEN '{yes}' ELSE '{no}' END)"
    return f"CASE WHEN {v} IS NOT NULL THEN '{h}' || {val} || '{tl}' END"


BASE = "concat_ws(' ', " + ", ".join(_sentence(v) for v in VARS) + ")"
YMD = "strftime(strptime(scandate, '%Y'), '%Y%m%d')"

OUTCOME = """CASE WHEN lung_cancer IS NULL THEN NULL
  WHEN lc_fup_days IS NOT NULL THEN
    CASE WHEN lung_cancer = 1 AND lc_fup_days >= 0 THEN 'The subject was diagnosed with lung cancer within ' || CAST(lc_fup_days AS VARCHAR) || ' days.'
         WHEN lung_cancer = 1 THEN 'The subject was diagnosed with lung cancer ' || CAST(abs(lc_fup_days) AS VARCHAR) || ' days ago.'
         WHEN lung_cancer = 0 THEN 'The subject was not diagnosed with lung cancer.' END
  ELSE CASE WHEN lung_cancer = 1 THEN 'The subject was diagnosed with lung cancer.' ELSE 'The subject was not diagnosed with lung cancer.' END
END"""
SUB = "CASE WHEN lung_cancer IS NOT NULL AND lc_subtype IS NOT NULL THEN 'The histological subtype of the lung cancer is ' || lc_subtype || '.' END"

register("clinical_sentences", with_(A_SCANS, COHORT, LATEST) + f"""
SELECT pid, {YMD} AS scandate, {BASE} AS text FROM latest""")

register("clinical_sentences_scan_level", with_(A_SCANS, COHORT) + f"""
SELECT pid, {YMD} AS scandate, {BASE} AS text FROM cohort""")

register("outcome_sentences", with_(A_SCANS, COHORT, LATEST) + f"""
SELECT pid, {YMD} AS scandate,
       CASE WHEN {BASE} = '' THEN concat_ws(' ', {OUTCOME}, {SUB}) ELSE concat_ws(' ', {BASE}, {OUTCOME}, {SUB}) END AS text
FROM latest""")

register("class_prompts", with_(A_SCANS, COHORT, LATEST) + f"""
SELECT pid, {YMD} AS scandate, CAST(c.class AS BIGINT) AS class,
       concat_ws(' ', CASE WHEN {BASE} <> '' THEN {BASE} END,
                 CASE WHEN c.class = 1 THEN 'The subject was diagnosed with lung cancer.'
                      ELSE 'The subject was not diagnosed with lung cancer.' END) AS text
FROM latest CROSS JOIN (VALUES (0), (1)) c(class)""")

_JSON_DOUBLES = {"age", "bmi", "quit_time", "smo_duration", "smo_intensity", "pkyr"}
_JSON_FIELDS = VARS + ["lung_cancer", "fup_days", "lc_subtype"]


def _json_obj(fields=None) -> str:
    parts = []
    for v in fields or _JSON_FIELDS:
        key = JSON_KEYS.get(v, v).replace("'", "''")
        val = f"round({v}, 10)" if v in _JSON_DOUBLES else v
        parts.append(f"'{key}', {val}")
    return "json_object(" + ", ".join(parts) + ")"


register("clinical_json", with_(A_SCANS, COHORT, LATEST) + f"""
SELECT pid, {YMD} AS scandate, CAST({_json_obj()} AS VARCHAR) AS text FROM latest""")
