"""Queries: cohort curation."""

from pyspark.sql import functions as F

from cohortlens.functions.dates import format_date, parse_date, year_text
from cohortlens.operators import cohort as C
from cohortlens.plans.catalog import register
from cohortlens.sources import testdata as td


def _cohort(spark, sf_dir):
    return C.scan_cohort(td.scans(spark, sf_dir))


def _test(spark, sf_dir):
    return C.test_split(_cohort(spark, sf_dir), td.test_list(spark, sf_dir))


@register("cohort_dedupe_max")
def cohort_dedupe_max(spark, sf_dir):
    """A1 + P1: column-wise max per (pid, scandate) of the raw scans."""
    raw = td.scans(spark, sf_dir)
    return C.dedupe_max(raw.where(F.col("scandate").isNotNull()), ["pid", "scandate"])


@register("cohort_first_non_null")
def cohort_first_non_null(spark, sf_dir):
    """A2: first non-NULL value per column (rid order) per (pid, scan year)."""
    return C.dedupe_first(_cohort(spark, sf_dir), ["pid", "scandate"])


@register("latest_scan")
def latest_scan(spark, sf_dir):
    """A3: arg-max scanorder row per patient (ties -> smallest rid)."""
    return C.argmax_rows(_cohort(spark, sf_dir), "pid", "scanorder")


@register("shifted_dates")
def shifted_dates(spark, sf_dir):
    """Latest date, shifted date text, year text, recodes."""
    return _cohort(spark, sf_dir).select(
        "pid", "scandate", "rid", "scanorder", "maxdate", "duration", "shifted_scandate", "gender", "lc_fup_days")


@register("study_year")
def study_year(spark, sf_dir):
    """W1 on the A2-deduplicated (pid, year) rows."""
    return C.study_year(C.dedupe_first(_cohort(spark, sf_dir), ["pid", "scandate"])).select(
        "pid", "scandate", "rid", "study_yr")


@register("test_split_join")
def test_split_join(spark, sf_dir):
    """Held-out patients by external (patient_id, study_yr) list, deduplicated."""
    return _test(spark, sf_dir)


@register("train_anti")
def train_anti(spark, sf_dir):
    """Training rows = patients not in the held-out set."""
    cohort = _cohort(spark, sf_dir)
    return C.train_split(cohort, C.test_split(cohort, td.test_list(spark, sf_dir)))


@register("thin_slice")
def thin_slice(spark, sf_dir):
    """Base wrapper filters (slice_thickness < 5, scandate not NULL)."""
    return C.curate_scans(td.scans(spark, sf_dir), 5).select("pid", "rid", "scandate", "slice_thickness")


@register("nodule_patients")
def nodule_patients(spark, sf_dir):
    """Held-out rows of patients whose latest scan has a nodule count."""
    return C.with_nodules(_test(spark, sf_dir)).select("pid", "study_yr", "scanorder", "rid", "nodule_count")


@register("nodule_join_fanout")
def nodule_join_fanout(spark, sf_dir):
    """J5 + J4 (fan-out on year-level dates) + I3."""
    cohort = _cohort(spark, sf_dir)
    test = C.test_split(cohort, td.test_list(spark, sf_dir))
    ids = C.restrict_to(cohort.select("pid", "scandate", "scanorder", "rid"), test)
    fanned = C.attach_nodule_count(ids, cohort)
    return C.with_nodules(fanned, tiebreak=("rid", "nodule_rid")).select(
        "pid", "scandate", "scanorder", "rid", "nodule_rid", "nodule_count")


@register("cohort_profile")
def cohort_profile(spark, sf_dir):
    """Scans, subjects, label frequency."""
    return C.profile(_cohort(spark, sf_dir), "lung_cancer")


@register("profile_no_label")
def profile_no_label(spark, sf_dir):
    """A4/S11 with every label NULL: the totals stay."""
    return C.profile(_cohort(spark, sf_dir).withColumn("lung_cancer", F.lit(None).cast("int")), "lung_cancer")


@register("parse_dates")
def parse_dates(spark, sf_dir):
    """Lenient parsing of mixed date text (ten layouts) and numbers."""
    o = td.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    text = (F.when(k % 5 == 0, F.date_format(d, "yyyyMMdd")).when(k % 5 == 1, F.date_format(d, "yyyy-MM-dd"))
            .when(k % 5 == 2, F.date_format(d, "yyyy"))
            .when(k % 5 == 3, F.element_at(F.array(
                F.lit("n/a"), F.date_format(d, "yyyy-MM-dd'T'10:00:00"), F.date_format(d, "MM/dd/yyyy"), F.date_format(d, "d MMM yyyy"),
                F.date_format(d, "yyyy-MM-dd 10:00:00.5"), F.date_format(d, "yyyy-MM")), (F.expr("o_orderkey div 5") % 6 + 1).cast("int"))))
    num = F.when(k % 5 == 4, F.date_format(d, "yyyyMMdd").cast("bigint"))
    src = o.select(k.alias("rid"), text.alias("raw_text"), num.alias("raw_num"))
    return src.select("rid", "raw_text", "raw_num",
                      parse_date("raw_text").alias("parsed"),
                      format_date("raw_text", "%Y%m%d").alias("ymd"),
                      year_text("raw_text").alias("year"),
                      format_date("raw_num", "%Y%m%d").alias("num_ymd"))


@register("vector_key")
def vector_key(spark, sf_dir):
    """Vector key text and its parse back."""
    s = _cohort(spark, sf_dir).select("pid", "rid", "shifted_scandate")
    s = s.withColumn("vkey", C.vector_key("pid", "shifted_scandate"))
    pid_back, date_back = C.parse_vector_key("vkey")
    return s.select("pid", "rid", "vkey", pid_back.alias("pid_back"), date_back.alias("date_back"))


@register("row_sample")
def row_sample(spark, sf_dir):
    """Exact 30% row sample by hash order (repeatable)."""
    from cohortlens.operators.split import row_sample as rs
    return rs(_cohort(spark, sf_dir), 0.3, key="rid").select("pid", "rid", "scandate")


@register("stratified_split")
def stratified_split(spark, sf_dir):
    """R2: 20% of patients per max-label stratum to validation; every scan tagged."""
    from cohortlens.operators.split import split_column
    return split_column(_cohort(spark, sf_dir), "lung_cancer", 0.2).select("pid", "rid", "split")


@register("impute_chained")
def impute_chained(spark, sf_dir):
    """Chained equations (Bayesian ridge, 10 rounds, exact early stop) over 6 scalar + 7 categorical columns."""
    from cohortlens.operators.impute import chained_impute
    cohort = _cohort(spark, sf_dir)
    return chained_impute(cohort, C.NLST.variables, keep=["pid", "rid", "scandate", "scanorder"])


@register("impute_two_col")
def impute_two_col(spark, sf_dir):
    """I1 special case: bmi regressed on age by least squares (age complete)."""
    from cohortlens.operators.impute import chained_impute
    return chained_impute(td.scans(spark, sf_dir), ["age", "bmi"], keep=["pid", "rid"], estimator="least_squares")


@register("impute_by_rows")
def impute_by_rows(spark, sf_dir):
    """I1 with rounds over the rows, no state per missing pattern: bmi regressed on age by least squares."""
    from cohortlens.operators.impute import chained_impute
    return chained_impute(td.scans(spark, sf_dir), ["age", "bmi"], keep=["pid", "rid"], estimator="least_squares", by_rows=True)


@register("profile_of_parts")
def profile_of_parts(spark, sf_dir):
    """Sketches of subjects kept per study year and united: per year and over all, within the sketch's error."""
    cohort = C.study_year(_cohort(spark, sf_dir))
    parts = C.subject_sketches(cohort, "study_yr")
    exact = cohort.groupBy("study_yr").agg(F.count_distinct("pid").alias("n_subjects")).union(
        cohort.agg(F.lit(None).cast("int"), F.count_distinct("pid")))
    got = C.united_subjects(parts, "study_yr").union(C.united_subjects(parts).select(F.lit(None).cast("int"), "n_scans", "n_subjects"))
    both = got.withColumnRenamed("n_subjects", "estimate").join(exact.withColumnRenamed("study_yr", "yr"), F.col("study_yr").eqNullSafe(F.col("yr")))
    return both.select("study_yr", "n_scans", "n_subjects", (F.abs(F.col("estimate") - F.col("n_subjects")) <= 0.05 * F.col("n_subjects") + 1).alias("near"))


@register("imputed_test_patients")
def imputed_test_patients(spark, sf_dir):
    """Imputed rows restricted to the held-out patients (left semi join)."""
    from cohortlens.operators.impute import chained_impute
    cohort = _cohort(spark, sf_dir)
    imputed = chained_impute(cohort, ["age", "bmi", "pkyr", "smo_intensity"], keep=["pid", "rid"],
                             estimator="least_squares")
    return C.restrict_to(imputed, C.test_split(cohort, td.test_list(spark, sf_dir)))


@register("cohort_with_patients")
def cohort_with_patients(spark, sf_dir):
    """Scans joined with patient-level attributes on pid (left join)."""
    from cohortlens.sources.io import attach_patients
    s = td.scans(spark, sf_dir).select("pid", "rid", "scandate", "lung_cancer")
    return attach_patients(s, td.patients(spark, sf_dir))


@register("imputed_two_col_test_patients")
def imputed_two_col_test_patients(spark, sf_dir):
    """I2 on the two-column least-squares imputation: imputed rows of the held-out patients."""
    from cohortlens.operators.impute import chained_impute
    raw = td.scans(spark, sf_dir)
    imputed = chained_impute(raw, ["age", "bmi"], keep=["pid", "rid"], estimator="least_squares")
    return C.restrict_to(imputed, C.test_split(C.scan_cohort(raw), td.test_list(spark, sf_dir)))


@register("imputed_nodule_patients")
def imputed_nodule_patients(spark, sf_dir):
    """I3 imputed form: imputed rows of patients whose latest scan has a nodule count."""
    from cohortlens.operators.impute import chained_impute
    imputed = chained_impute(td.scans(spark, sf_dir), ["age", "bmi"], keep=["pid", "rid", "scanorder", "nodule_count"],
                             estimator="least_squares")
    return C.with_nodules(imputed).select("pid", "rid", "nodule_count", "age", "bmi")
