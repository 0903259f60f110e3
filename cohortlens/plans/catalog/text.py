"""Queries: clinical text rendering."""

from cohortlens.operators import cohort as C
from cohortlens.operators import text as X
from cohortlens.plans.catalog import register
from cohortlens.sources import testdata as td


def _cohort(spark, sf_dir):
    return C.scan_cohort(td.scans(spark, sf_dir))


@register("clinical_sentences")
def clinical_sentences(spark, sf_dir):
    """Latest-scan variables of each patient as sentences."""
    return X.clinical_items(_cohort(spark, sf_dir))


@register("outcome_sentences")
def outcome_sentences(spark, sf_dir):
    """T2 + T3: sentences plus the outcome (follow-up days, subtype)."""
    return X.clinical_items(_cohort(spark, sf_dir), include_label=True, label="lung_cancer")


@register("class_prompts")
def class_prompts(spark, sf_dir):
    """T4: one prompt per patient and class (0, 1)."""
    return X.class_items(_cohort(spark, sf_dir))


@register("clinical_json")
def clinical_json(spark, sf_dir):
    """T5: variables and labels as JSON with readable keys, NULLs kept."""
    return X.json_items(_cohort(spark, sf_dir), include_label=True)


@register("clinical_sentences_scan_level")
def clinical_sentences_scan_level(spark, sf_dir):
    """P11 scan level: the sentences of every scan."""
    return X.clinical_items(_cohort(spark, sf_dir), scan_level=True)
