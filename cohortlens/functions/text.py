"""Clinical row -> text, as Catalyst expressions.

Every template is a ``Column -> Column`` formatter that yields NULL when its
input is NULL, so ``concat_ws(' ', ...)`` skips missing variables exactly as
the per-row Python loop of the modelled workflow does.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Formatter = Callable[[Column], Column]

# ---------------------------------------------------------------------------
# fixed values: sentence templates, code labels and JSON keys of the modelled
# workflow (wording and spelling must stay as they are)
# ---------------------------------------------------------------------------
RACE_LABELS = {
    1: "White",
    2: "Black",
    3: "Hispanic",
    4: "Asian",
    5: "American Indian or Alaskan Native",
    6: "Native Hawaiian or Other Pacific Islander",
    0: "Mixed, other, missing, unkown, or declined to answer",
}

TEMPLATES = {
    "age": "The age of the subject is {int}.",
    "bmi": "The BMI of the subject is {2dp}.",
    "quit_time": "The subject quit smoking {int} years ago.",
    "smo_duration": "The subject has been smoking for {int} years.",
    "smo_intensity": "The subject smokes {2dp} cigarettes per day.",
    "pkyr": "The subject has {2dp} smoking pack years.",
    "gender": "The sex of the subject is {male|female}.",
    "race": "The race of the subject is {race}.",
    "copd": "The subject {has|does not have} a history of Chronic Obstructive Pulmonary Disease.",
    "emphysema": "The subject {has|does not have} Emphysema.",
    "phist": "The subject {has|does not have} a history of any cancer.",
    "fhist": "The subject {has|does not have} a family history of lung cancer.",
    "smo_status": "The subject {is|is not} a current smoker.",
    "cyfra": "The subject's serum concentration of hs-CYFRA 21-1 is {2dp} (in natural log of ng/mL).",
}

OUTCOME_WITHIN = "The subject was diagnosed with lung cancer within {int} days."
OUTCOME_AGO = "The subject was diagnosed with lung cancer {int} days ago."
OUTCOME_NOT = "The subject was not diagnosed with lung cancer."
OUTCOME_PLAIN = "The subject {was|was not} diagnosed with lung cancer."
SUBTYPE = "The histological subtype of the lung cancer is {value}."

JSON_KEYS = {
    "gender": "Gender (1=M, 0=F)",
    "bmi": "Body Mass Index (kg/m^2)",
    "race": "Race (1=White, 2=Black, 3=Hispanic, 4=Asian, 5=American Indian or Alaskan Native, 6=Native Hawaiian or Other Pacific Islander, 0=Mixed, other, missing, unkown, or declined to answer)",
    "copd": "Chronic Obstructive Pulmonary Disease",
    "emphysema": "Emphysema (1=present, 0=absent)",
    "phist": "History of any cancer",
    "fhist": "Family history of lung cancer",
    "smo_status": "Smoking status (1=current, 0=former)",
    "smo_duration": "Smoking duration (years)",
    "smo_intensity": "Smoking intensity (cigarettes/day)",
    "quit_time": "Time since quitting smoking (years)",
    "pkyr": "Smoking pack years",
    "cyfra": "Serum concentration of hs-CYFRA 21-1 (in natural log of ng/mL)",
    "lc_subtype": "Lung cancer histological subtype",
    "fup_days": "Follow-up days",
}
# ---------------------------------------------------------------------------


def int_text(x: Column) -> Column:
    """``int(x)``: truncation toward zero, as text."""
    return x.cast("double").cast("bigint").cast("string")


def dp2_text(x: Column) -> Column:
    """``f'{x:.2f}'``: two decimals, rounding the binary value, no grouping."""
    return F.call_function("format_number", x.cast("double"), F.lit("0.00"))


def _fill(template: str, value: Column) -> Column:
    head, rest = template.split("{", 1)
    _, tail = rest.split("}", 1)
    return F.concat(F.lit(head), value, F.lit(tail))


def _choice(template: str, x: Column) -> Column:
    """'{yes|no}' template: first word when x == 1, else the second."""
    inner = template[template.index("{") + 1:template.index("}")]
    yes, no = inner.split("|")
    return _fill(template, F.when(x == 1, F.lit(yes)).otherwise(F.lit(no)))


def race_label(x: Column, strict: bool = False) -> Column:
    """Code -> label; an unknown code gives NULL (the sentence is skipped), or fails the job where ``strict``."""
    m = F.create_map(*[F.lit(v) for kv in RACE_LABELS.items() for v in kv])
    label = F.try_element_at(m, x.cast("double").cast("int"))
    if not strict:
        return label
    return F.when(x.isNotNull() & label.isNull(), F.raise_error(F.concat(F.lit("unknown race code "), x.cast("string")))).otherwise(label)


def strict_race(x: Column) -> Column:
    """T6 strict, as a formatter (U2): ``formatters={'race': strict_race}``."""
    return F.when(x.isNotNull(), _fill(TEMPLATES["race"], race_label(x, strict=True)))


def _formatter(name: str) -> Formatter:
    t = TEMPLATES[name]
    if "{int}" in t:
        return lambda x: F.when(x.isNotNull(), _fill(t, int_text(x)))
    if "{2dp}" in t:
        return lambda x: F.when(x.isNotNull(), _fill(t, dp2_text(x)))
    if "{race}" in t:
        return lambda x: F.when(x.isNotNull(), _fill(t, race_label(x)))
    return lambda x: F.when(x.isNotNull(), _choice(t, x))


# Per-variable formatter found by column name
FORMATTERS: dict[str, Formatter] = {name: _formatter(name) for name in TEMPLATES}


def clinical_text(variables, formatters: dict[str, Formatter] | None = None) -> Column:
    """Sentences of the non-NULL variables (in the given order) joined by one space.

    Variables without a formatter (e.g. scan-level ones) are skipped.
    """
    fm = {**FORMATTERS, **(formatters or {})}
    parts = [fm[v](F.col(v)) for v in variables if v in fm]
    return F.concat_ws(" ", *parts)


def outcome_text(label: Column, fup_days: Column | None = None, subtype: Column | None = None) -> Column:
    """Outcome sentence (follow-up form when days are known) plus subtype; NULL label -> NULL."""
    plain = _choice(OUTCOME_PLAIN, label)
    if fup_days is not None:
        fup = (F.when(label == 1, F.when(fup_days >= 0, _fill(OUTCOME_WITHIN, int_text(fup_days)))
                                   .otherwise(_fill(OUTCOME_AGO, int_text(F.abs(fup_days)))))
                .when(label == 0, F.lit(OUTCOME_NOT)))
        sentence = F.when(fup_days.isNotNull(), fup).otherwise(plain)
    else:
        sentence = plain
    sub = F.when(subtype.isNotNull(), _fill(SUBTYPE, subtype.cast("string"))) if subtype is not None else None
    parts = [sentence] + ([sub] if sub is not None else [])
    return F.when(label.isNotNull(), F.concat_ws(" ", *parts))


def class_sentence(cls: Column) -> Column:
    """T4: outcome sentence of a hypothetical class (1 -> 'was', anything else -> 'was not')."""
    return _choice(OUTCOME_PLAIN, cls)


def json_text(columns, keys: dict[str, str] | None = None, digits: int = 10) -> Column:
    """T5: row as JSON with readable keys, NULLs kept, doubles rounded to ``digits``."""
    keys = {**JSON_KEYS, **(keys or {})}
    fields = []
    for name, dtype in columns:
        c = F.col(name)
        if dtype in ("double", "float"):
            c = F.round(c.cast("double"), digits)
        fields.append(c.alias(keys.get(name, name)))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
