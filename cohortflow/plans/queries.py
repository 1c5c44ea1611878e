"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each query reads the TPC-H-like tables under ``sf_dir`` and derives the
cohort from them, so its work grows with the tables. Doubles are rounded to
6 places in the registered output only (library functions keep full
precision) so results compare across engines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortflow.plans import study as S
from cohortflow.session import held_table, tables_folder
from cohortflow.sources.fixture import cohort_wide_text
from cohortflow.sources.wide import read_wide_csv, type_wide, write_wide_csv
from cohortflow.spec import ADMISSION_LABELS, CAUSE_LABELS, DEMO_LABELS, StudySpec

SPEC = StudySpec()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def round_doubles(df: DataFrame, places: int = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        cols.append(F.round(c, places).alias(f.name) if isinstance(f.dataType, T.DoubleType) else c)
    return df.select(*cols)


def query(name: str):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn
    return deco


COHORT_TABLES = ("customer", "nation", "orders")


def _inputs(sf_dir: str) -> list[str]:
    return [f"{sf_dir}/{t}.parquet" for t in COHORT_TABLES]


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed wide cohort, derived once per session and state of its input files, written as parquet.

    Like cleaning the raw file once before every analysis: the derivation
    (scan, slot pivot, typing) runs one time and every later
    query scans the written table, with column pruning and pushdown, instead
    of re-deriving it in each branch of its plan. The table lives in the
    session's shared checkpoint folder, so it survives executor loss.
    """
    return held_table(spark, "cohort-wide", _inputs(sf_dir),
                      lambda: type_wide(cohort_wide_text(spark, sf_dir, SPEC.n_slots)))


def demo(spark, sf_dir):
    return S.demographics(wide(spark, sf_dir), SPEC)


def analysis(spark, sf_dir):
    w = wide(spark, sf_dir)
    return S.admissions_by_presence(w, SPEC, S.demographics(w, SPEC))


def paired(spark, sf_dir):
    w = wide(spark, sf_dir)
    d = S.demographics(w, SPEC)
    return S.paired_event_counts(S.admissions_by_presence(w, SPEC, d), d, SPEC)


def paired_wide(spark, sf_dir):
    return S.period_wide(paired(spark, sf_dir), SPEC)


def unpaired(spark, sf_dir):
    w = wide(spark, sf_dir)
    d = S.demographics(w, SPEC)
    return S.unpaired_event_flags(S.admissions_by_presence(w, SPEC, d), d, SPEC)


# ---------------------------------------------------------------- phase 0 - 2

@query("cohort_wide")
def q_cohort_wide(spark, sf_dir):
    """Raw-text wide cohort (58 columns) derived from customer/nation/orders."""
    return cohort_wide_text(spark, sf_dir, SPEC.n_slots)


@query("wide_ingest")
def q_wide_ingest(spark, sf_dir):
    """Typed wide cohort: dates, decimal-comma numbers, factor labels, diabetes flag."""
    return type_wide(cohort_wide_text(spark, sf_dir, SPEC.n_slots))


@query("csv_ingest")
def q_csv_ingest(spark, sf_dir):
    """The cohort as CSV files in the shared folder (decimal commas quoted), scanned back and typed."""
    path = f"{tables_folder(spark)}/cohort-csv-{uuid.uuid4().hex}"
    write_wide_csv(cohort_wide_text(spark, sf_dir, SPEC.n_slots), path)
    return type_wide(read_wide_csv(spark, path, SPEC.n_slots))


@query("csv_records")
def q_csv_records(spark, sf_dir):
    """The documents, whose texts hold line breaks and quotes, as CSV files and scanned back record by record."""
    from cohortflow.sources.records import scan_records
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = f"{tables_folder(spark)}/documents-csv-{uuid.uuid4().hex}"
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    (docs.select(*columns).write.option("header", "true").option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
     .option("lineSep", "\n").csv(path))
    back = scan_records(spark, path, columns, trim=False)
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2("text", 256).alias("text_sha256"),
                       F.length("text").cast("long").alias("n_text"), "lang", "source",
                       F.col("n_chars").cast("long").alias("n_chars"), F.col("corrupt_record").isNotNull().alias("corrupt"))


@query("csv_rejects")
def q_csv_rejects(spark, sf_dir):
    """Orders as delimited lines, some cut short or too long by rule, scanned back: kept and rejected records by priority."""
    from cohortflow.sources.records import CORRUPT, scan_records
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = F.col("o_orderkey")
    cells = F.concat_ws(",", key.cast("string"), F.col("o_custkey").cast("string"))
    line = (F.when(key % 101 == 0, cells)
            .when(key % 103 == 0, F.concat(cells, F.lit(","), F.col("o_orderpriority"), F.lit(",extra")))
            .when(key % 7 == 0, F.concat(cells, F.lit(',"'), F.col("o_orderpriority"), F.lit('\n""urgent"""')))
            .otherwise(F.concat(cells, F.lit(","), F.col("o_orderpriority"))))
    path = f"{tables_folder(spark)}/orders-csv-{uuid.uuid4().hex}"
    o.select(line.alias("line")).write.option("lineSep", "\n").text(path)
    back = scan_records(spark, path, ["key", "customer", "priority"], header=False)
    return back.groupBy("priority").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col(CORRUPT).isNotNull()).alias("rejects"),
        F.sum(F.col("key").cast("long")).alias("key_sum"))


@query("period_long")
def q_period_long(spark, sf_dir):
    return S.period_long(wide(spark, sf_dir), SPEC)


@query("demographics")
def q_demographics(spark, sf_dir):
    return demo(spark, sf_dir)


@query("age_at_anchor")
def q_age_at_anchor(spark, sf_dir):
    return S.age_at_anchor(wide(spark, sf_dir), SPEC)


@query("age_band")
def q_age_band(spark, sf_dir):
    return demo(spark, sf_dir).select("id", "period", "age", "age_group")


@query("admission_long")
def q_admission_long(spark, sf_dir):
    return S.admission_long(wide(spark, sf_dir), SPEC)


@query("period_classify")
def q_period_classify(spark, sf_dir):
    from cohortflow.operators.classify import classify_periods
    return classify_periods(S.admission_long(wide(spark, sf_dir), SPEC), SPEC.periods,
                            bounds=SPEC.bounds)


@query("recode_vocabulary")
def q_recode_vocabulary(spark, sf_dir):
    from cohortflow.operators.classify import recode_causes
    return recode_causes(S.admission_long(wide(spark, sf_dir), SPEC), SPEC.vocabulary)


@query("recode_taxonomy")
def q_recode_taxonomy(spark, sf_dir):
    """Every admission's label and cause group under each taxonomy of the dimension."""
    from cohortflow.operators.classify import classify_causes, taxonomy_table
    rows = S.admission_long(wide(spark, sf_dir), SPEC, id_cols=("id",))
    return classify_causes(rows, taxonomy_table(spark)).select(
        "id", "adm_number", "hosp_start", "hosp_cause", "taxonomy", "label", "cause_group", "group_order")


@query("length_of_stay")
def q_length_of_stay(spark, sf_dir):
    return S.length_of_stay(wide(spark, sf_dir), SPEC)


@query("cause_ratio")
def q_cause_ratio(spark, sf_dir):
    """Admissions per present subject by period and cause group, complete grid."""
    return S.cause_ratio(wide(spark, sf_dir), SPEC)


@query("cause_period_summary")
def q_cause_period_summary(spark, sf_dir):
    return S.cause_period_summary(wide(spark, sf_dir), SPEC)


@query("subject_periods")
def q_subject_periods(spark, sf_dir):
    return S.subject_periods(demo(spark, sf_dir))


@query("first_row_per_key")
def q_first_row_per_key(spark, sf_dir):
    return S.first_demographics(demo(spark, sf_dir))


@query("admissions_by_presence")
def q_admissions_by_presence(spark, sf_dir):
    return analysis(spark, sf_dir)


@query("both_period_subjects")
def q_both_period_subjects(spark, sf_dir):
    return S.both_period_subjects(analysis(spark, sf_dir))


@query("subject_period_grid")
def q_subject_period_grid(spark, sf_dir):
    w = wide(spark, sf_dir)
    d = S.demographics(w, SPEC)
    return S.subject_period_grid(S.admissions_by_presence(w, SPEC, d), d, SPEC)


@query("paired_event_counts")
def q_paired_event_counts(spark, sf_dir):
    return paired(spark, sf_dir)


@query("paired_event_counts_any_cause")
def q_paired_event_counts_any_cause(spark, sf_dir):
    """As paired_event_counts, with the admissions of unmapped causes."""
    w = wide(spark, sf_dir)
    d = S.demographics(w, SPEC)
    return S.paired_event_counts(S.admissions_by_presence(w, SPEC, d), d, SPEC, require_group=False)


@query("ungrouped_admissions")
def q_ungrouped_admissions(spark, sf_dir):
    """What the paired counts leave out, per period."""
    return S.ungrouped_admissions(analysis(spark, sf_dir))


@query("period_wide")
def q_period_wide(spark, sf_dir):
    return paired_wide(spark, sf_dir)


@query("unpaired_event_flags")
def q_unpaired_event_flags(spark, sf_dir):
    return unpaired(spark, sf_dir)


@query("unpaired_event_flags_strict")
def q_unpaired_event_flags_strict(spark, sf_dir):
    """As unpaired_event_flags, an unmapped cause making its subject-period's infection figures missing."""
    w = wide(spark, sf_dir)
    d = S.demographics(w, SPEC)
    return S.unpaired_event_flags(S.admissions_by_presence(w, SPEC, d), d, SPEC, strict=True)


@query("exposure_days")
def q_exposure_days(spark, sf_dir):
    return S.with_exposure(unpaired(spark, sf_dir), SPEC).select(
        "id", "period", "exposure_time", "log_exposure")


# --------------------------------------------------------------- phase 3 - 5

def _post_pre(measures):
    post, pre = SPEC.period_labels[1], SPEC.period_labels[0]
    return {m: (f"{m}_count_{post}", f"{m}_count_{pre}") for m in measures}


def _pre_post_any(measures):
    post, pre = SPEC.period_labels[1], SPEC.period_labels[0]
    return {m: (f"{m}_any_{pre}", f"{m}_any_{post}") for m in measures}


MEASURES = ["hosp", "infection", "cardio"]
DEMO_CATEGORICAL = ["age_group", "diabetes_type", "karnofsky", "va", "gender", "htn", "diabetes"]


def _demo_long_categorical(spark, sf_dir, variables=DEMO_CATEGORICAL):
    from cohortflow.operators.reshape import stack_columns
    d = demo(spark, sf_dir)
    return stack_columns(d, ["period"], {v: F.col(v) for v in variables}, "variable", "level")


def _paired_record(spark, sf_dir):
    """Moments and cells of the paired table, from one scan of it; written once, as five tests read it."""
    from cohortflow.operators.stats import paired_record
    return held_table(spark, "paired-record", _inputs(sf_dir), lambda: paired_record(
        paired_wide(spark, sf_dir), _post_pre(MEASURES), _pre_post_any(MEASURES)))


@query("paired_tests")
def q_paired_tests(spark, sf_dir):
    """Paired t, Cohen's d and McNemar of every measure, from the one record."""
    from cohortflow.operators.stats import paired_tests
    return paired_tests(_paired_record(spark, sf_dir))


@query("paired_diff_t")
def q_paired_diff_t(spark, sf_dir):
    """Paired t test of post - pre admission counts (all, infection, cardiovascular)."""
    from cohortflow.operators.stats import t_from_record
    return t_from_record(_paired_record(spark, sf_dir))


@query("contingency")
def q_contingency(spark, sf_dir):
    """2x2 pre x post any-event tables with fixed 0/1 levels."""
    from cohortflow.operators.stats import contingency_from_record
    return contingency_from_record(_paired_record(spark, sf_dir))


@query("mcnemar")
def q_mcnemar(spark, sf_dir):
    from cohortflow.operators.stats import mcnemar_from_record
    return mcnemar_from_record(_paired_record(spark, sf_dir))


@query("mcnemar_labels")
def q_mcnemar_labels(spark, sf_dir):
    """McNemar on the labels table: quality (rows) vs toxic (columns) per document."""
    from cohortflow.operators.stats import mcnemar_from_record, paired_record
    lab = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mcnemar_from_record(paired_record(lab, flags={"quality_vs_toxic": ("quality", "toxic")}))


@query("cohen_d_paired")
def q_cohen_d_paired(spark, sf_dir):
    from cohortflow.operators.stats import d_from_record
    return d_from_record(_paired_record(spark, sf_dir))


@query("chi_square")
def q_chi_square(spark, sf_dir):
    """Pearson chi-square of each categorical demographic vs period."""
    from cohortflow.operators.stats import cell_counts, chi_square
    long = _demo_long_categorical(spark, sf_dir)
    return chi_square(cell_counts(long, ["variable"], "level", "period"), ["variable"])


@query("chi_square_labels")
def q_chi_square_labels(spark, sf_dir):
    from cohortflow.operators.stats import cell_counts, chi_square
    lab = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumn("table", F.lit("quality_x_toxic"))
    return chi_square(cell_counts(lab, ["table"], "quality", "toxic"), ["table"])


@query("fisher_2x2")
def q_fisher_2x2(spark, sf_dir):
    """Fisher exact p for the 2x2 tables: labels quality x toxic, and two-level
    demographics (gender, htn, diabetes, diabetes type) x period."""
    from cohortflow.operators.stats import cell_counts, fisher_2x2
    lab = (spark.read.parquet(f"{sf_dir}/labels.parquet")
           .select(F.lit("quality_x_toxic").alias("variable"), F.col("quality").cast("string").alias("level"),
                   F.col("toxic").cast("string").alias("period")))
    long = _demo_long_categorical(spark, sf_dir, ["gender", "htn", "diabetes", "diabetes_type"])
    both = long.select("variable", "level", "period").unionByName(lab)
    return fisher_2x2(cell_counts(both, ["variable"], "level", "period"), ["variable"])


@query("rank_sum")
def q_rank_sum(spark, sf_dir):
    """Wilcoxon rank-sum of age and Charlson index between the two periods."""
    from cohortflow.operators.reshape import stack_columns
    from cohortflow.operators.stats import rank_sum
    long = stack_columns(demo(spark, sf_dir), ["period"], {"age": F.col("age"), "charlson": F.col("charlson")},
                         "variable", "value", "double")
    return rank_sum(long, ["variable"], "value", "period", first_level=SPEC.period_labels[0])


@query("kruskal_wallis")
def q_kruskal_wallis(spark, sf_dir):
    """Kruskal-Wallis of event value across the five event types."""
    from cohortflow.operators.stats import kruskal_wallis
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "value")
    return kruskal_wallis(ev, [], "value", "event_type")


@query("monte_carlo_independence")
def q_monte_carlo(spark, sf_dir):
    """Simulated p (2000 tables, margins fixed) for karnofsky and age band vs period."""
    from cohortflow.operators.stats import cell_counts, monte_carlo_independence
    long = _demo_long_categorical(spark, sf_dir, ["karnofsky", "age_group"])
    return monte_carlo_independence(cell_counts(long, ["variable"], "level", "period"), ["variable"])


# ------------------------------------------------------------------ summaries

DEMO_VARIABLES = ["age", "age_group", "gender", "htn", "diabetes", "diabetes_type", "charlson",
                  "karnofsky", "va"]
DICHOTOMOUS = {"gender": "Mujer", "htn": "Si", "diabetes": "Si"}


@query("summary_continuous")
def q_summary_continuous(spark, sf_dir):
    """Age and Charlson index by period: n, mean, sd, exact quartiles."""
    from cohortflow.operators.summary import summary_continuous
    return summary_continuous(demo(spark, sf_dir), ["age", "charlson"], "period")


@query("summary_documents")
def q_summary_documents(spark, sf_dir):
    """Document length by language: n, mean, sd, exact quartiles (high-cardinality values)."""
    from cohortflow.operators.summary import summary_continuous
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "n_chars")
    return summary_continuous(docs, ["n_chars"], "lang")


@query("summary_categorical")
def q_summary_categorical(spark, sf_dir):
    from cohortflow.operators.summary import summary_categorical
    return summary_categorical(demo(spark, sf_dir), ["age_group", "diabetes_type", "karnofsky", "va"], "period")


@query("summary_dichotomous")
def q_summary_dichotomous(spark, sf_dir):
    from cohortflow.operators.summary import summary_categorical
    return summary_categorical(demo(spark, sf_dir), [], "period", dichotomous=DICHOTOMOUS)


@query("summary_missing")
def q_summary_missing(spark, sf_dir):
    from cohortflow.operators.summary import summary_missing
    return summary_missing(demo(spark, sf_dir), DEMO_VARIABLES, "period")


@query("summary_kind_profile")
def q_summary_kind_profile(spark, sf_dir):
    from cohortflow.operators.summary import summary_kind_profile
    return summary_kind_profile(demo(spark, sf_dir), DEMO_VARIABLES, every=True)


@query("stratified_summary")
def q_stratified_summary(spark, sf_dir):
    """Analysis table by cause group, stratified by period (admission grain)."""
    from cohortflow.operators.summary import summary_table
    return summary_table(analysis(spark, sf_dir), "hosp_cause_groups", ["period"],
                         continuous=["charlson"], categorical=["age_group", "gender"],
                         dichotomous={"htn": "Si", "diabetes": "Si"})


@query("summary_with_tests")
def q_summary_with_tests(spark, sf_dir):
    """Test per demographic variable between periods, selected by kind and expected counts."""
    from cohortflow.operators.summary import summary_tests
    return summary_tests(demo(spark, sf_dir), "period", DEMO_VARIABLES,
                         first_level=SPEC.period_labels[0])


@query("summary_with_tests_simulated")
def q_summary_with_tests_simulated(spark, sf_dir):
    """As summary_with_tests, with the Karnofsky p value simulated (2000 tables)."""
    from cohortflow.operators.summary import summary_tests
    return summary_tests(demo(spark, sf_dir), "period", DEMO_VARIABLES, simulate=("karnofsky",),
                         first_level=SPEC.period_labels[0])


@query("stratified_tests")
def q_stratified_tests(spark, sf_dir):
    """Tests across cause groups within each period; age band p value simulated."""
    from cohortflow.operators.summary import summary_tests
    return summary_tests(analysis(spark, sf_dir), "hosp_cause_groups",
                         ["age_group", "gender", "htn", "diabetes", "charlson"], strata=["period"],
                         simulate=("age_group",))


# A query ``<name>_exact`` is the same table without its random draws: simulated p values are NULL there, so that SQL
# can tell all its columns. The tables themselves hold all p values.
DECLARED = {"age_group": list(SPEC.age_bands.labels), "gender": ["Mujer", "Hombre"],
            "diabetes_type": ["Tipo 1", "Tipo 2"],
            "va": ["Fistula AV Nativa", "Fistula Protésica", "Catéter Tunelizado"],
            "period": SPEC.period_labels}


def _declared(*variables):
    return {v: DECLARED[v] for v in variables}


@query("demographics_table")
def q_demographics_table(spark, sf_dir):
    """Demographics by period: statistics, text, missing counts, declared levels and tests."""
    from cohortflow.operators.summary import described_table
    return described_table(demo(spark, sf_dir), "period", continuous=["age", "charlson"],
                           categorical=["age_group", "diabetes_type", "karnofsky", "va"], dichotomous=DICHOTOMOUS,
                           declared=_declared("age_group", "diabetes_type", "va"), labels=DEMO_LABELS,
                           text={"age": ("mean", " años")}, simulate=("karnofsky",),
                           first_level=SPEC.period_labels[0])


@query("overall_table")
def q_overall_table(spark, sf_dir):
    """Covariates of the analysis table by cause group, per period, with tests across the groups."""
    from cohortflow.operators.summary import described_table
    return described_table(analysis(spark, sf_dir), "hosp_cause_groups", ["period"], continuous=["charlson"],
                           categorical=["age_group", "gender"], dichotomous={"htn": "Si", "diabetes": "Si"},
                           declared=_declared("age_group", "gender"), labels=CAUSE_LABELS, simulate=("age_group",))


@query("admission_table")
def q_admission_table(spark, sf_dir):
    """Admissions by six cause groups: period, days (mean and sd), readmission, with tests."""
    from cohortflow.operators.summary import described_table
    return described_table(S.admissions_in_periods(wide(spark, sf_dir), SPEC), "hosp_cause_groups",
                           continuous=["hosp_length"], categorical=["period"], dichotomous={"hosp_re": "Si"},
                           declared=_declared("period"), labels=ADMISSION_LABELS,
                           text={"hosp_length": ("mean", "")}, simulate=("period",))


@query("admission_tests")
def q_admission_tests(spark, sf_dir):
    """Tests of the admission table, the period's p value simulated (2000 tables)."""
    from cohortflow.operators.summary import summary_tests
    return summary_tests(S.admissions_in_periods(wide(spark, sf_dir), SPEC), "hosp_cause_groups",
                         ["period", "hosp_length", "hosp_re"], simulate=("period",))


@query("patient_table")
def q_patient_table(spark, sf_dir):
    """The overall table at the grain of patients: each counts once per period and cause group."""
    from cohortflow.operators.summary import summary_table
    return summary_table(S.cause_group_subjects(analysis(spark, sf_dir)), "hosp_cause_groups", ["period"],
                         continuous=["charlson"], categorical=["age_group", "gender"],
                         dichotomous={"htn": "Si", "diabetes": "Si"})


@query("demographics_by_htn")
def q_demographics_by_htn(spark, sf_dir):
    """Demographics by period within hypertension, whose missing values are a stratum of their own."""
    from cohortflow.operators.summary import described_table
    return described_table(demo(spark, sf_dir), "period", ["htn"], continuous=["age", "charlson"],
                           categorical=["age_group"], dichotomous={"gender": "Mujer"}, declared=_declared("age_group"),
                           labels=DEMO_LABELS, text={"age": ("mean", " años")}, first_level=SPEC.period_labels[0])


def _exact(name, drop=()):
    from cohortflow.operators.summary import without_simulated

    @query(f"{name}_exact")
    def run(spark, sf_dir):
        return without_simulated(QUERIES[name](spark, sf_dir)).drop(*drop)
    QUERIES[f"{name}_exact"].__doc__ = f"{name} without its random draws."


for _name in ("demographics_table", "overall_table", "admission_table", "demographics_by_htn"):
    _exact(_name)
for _name in ("summary_with_tests_simulated", "stratified_tests", "admission_tests"):
    _exact(_name, ("kind",))


@query("monte_carlo_independence_exact")
def q_monte_carlo_exact(spark, sf_dir):
    """The observed statistics of the Monte-Carlo test."""
    return q_monte_carlo(spark, sf_dir).drop("chisq_p_value", "fisher_p_value")


# --------------------------------------------------------------------- models

MODEL_FACTORS = {"period": SPEC.period_labels, "age_group": list(SPEC.age_bands.labels),
                 "gender": ["Mujer", "Hombre"], "htn": ["No", "Si"], "diabetes": ["No", "Si"]}
MODEL_NUMERIC = ["charlson"]
MODEL_KEEP = ["id", "was_hospitalized", "any_infection", "hosp_count", "log_exposure"]


def _design(spark, sf_dir, keep, factors=None, numeric=None):
    """The design of one model: only rows that lack a column in ``keep`` or a term are left out."""
    from cohortflow.operators.models import design_matrix
    data = S.with_exposure(unpaired(spark, sf_dir), SPEC)
    return design_matrix(data, factors or MODEL_FACTORS, MODEL_NUMERIC if numeric is None else numeric, keep)


def _terms(factors=None, numeric=None):
    from cohortflow.operators.models import design_terms
    return [t.name for t in design_terms(factors or MODEL_FACTORS,
                                         MODEL_NUMERIC if numeric is None else numeric)]


@query("design_matrix")
def q_design_matrix(spark, sf_dir):
    """Complete-case design: treatment contrasts vs first levels, plus Charlson."""
    return _design(spark, sf_dir, MODEL_KEEP)


@query("logit_risk")
def q_logit_risk(spark, sf_dir):
    """Logistic model of any admission on period, age band, sex, HTN, diabetes, Charlson."""
    from cohortflow.operators.models import fit_logistic
    return fit_logistic(_design(spark, sf_dir, ["was_hospitalized"]), "was_hospitalized", _terms())


@query("logit_specific_event")
def q_logit_specific_event(spark, sf_dir):
    from cohortflow.operators.models import fit_logistic
    return fit_logistic(_design(spark, sf_dir, ["any_infection"]), "any_infection", _terms())


@query("nb_count_model")
def q_nb_count_model(spark, sf_dir):
    """Negative-binomial admission count model with log exposure offset."""
    from cohortflow.operators.models import fit_negative_binomial
    return fit_negative_binomial(_design(spark, sf_dir, ["hosp_count", "log_exposure"]), "hosp_count", _terms(),
                                 offset="log_exposure")


PERIOD_ONLY = {"period": SPEC.period_labels}


@query("logit_period_only")
def q_logit_period_only(spark, sf_dir):
    """Saturated logistic model (period only): closed form ln odds ratio."""
    from cohortflow.operators.models import fit_logistic
    fit = fit_logistic(_design(spark, sf_dir, ["was_hospitalized"], PERIOD_ONLY, []), "was_hospitalized",
                       _terms(PERIOD_ONLY, []))
    return fit.select("term", "estimate", "std_error", "statistic", "p_value", "exp_estimate", "n_obs", "deviance")


@query("nb_period_only")
def q_nb_period_only(spark, sf_dir):
    """Saturated negative-binomial model (period + offset): ln ratio of mean rates."""
    from cohortflow.operators.models import fit_negative_binomial
    return fit_negative_binomial(_design(spark, sf_dir, ["hosp_count", "log_exposure"], PERIOD_ONLY, []), "hosp_count",
                                 _terms(PERIOD_ONLY, []), offset="log_exposure")
