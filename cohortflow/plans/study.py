"""The study's tables as lazy plans over the typed wide frame.

Grain of each function's output is given in its docstring. Nothing here
collects: every function returns a DataFrame whose work is Spark scans,
generators, aggregations and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.functions.dates import age_years, days_between, floored_log
from cohortflow.functions.recode import (band, n_distinct, strict_count_if, strict_sum,
                                         value_map)
from cohortflow.operators.classify import classify_periods, recode_causes
from cohortflow.operators.cohort import first_row_per_key, membership_flag, null_safe_join
from cohortflow.operators.reshape import (columns_containing, columns_matching, complete, expand_keys, level_grid,
                                          unpivot_repeated)
from cohortflow.spec import DIABETES_TYPE_MAP, GROUP4_LEVELS, VASCULAR_ACCESS_MAP, RepeatedGroup, StudySpec

PRESENCE_COLUMNS = ["id", "clinic", "gender", "age", "age_group", "htn", "diabetes",
                    "charlson", "va", "period"]
CARDIO, INFECTION = GROUP4_LEVELS[:2]


def _period_value(spec: StudySpec, fn) -> Column:
    """CASE over the period label with one value per period."""
    expr = None
    for p in spec.periods:
        cond = F.col("period") == F.lit(p.label)
        expr = F.when(cond, fn(p)) if expr is None else expr.when(cond, fn(p))
    return expr


# --------------------------------------------------------------- subject-period

PERIOD_IDS = ("id", "gender", "birth_date", "htn", "diabetes", "diabetes_type")


def period_long(wide: DataFrame, spec: StudySpec, id_cols=PERIOD_IDS, measures=None) -> DataFrame:
    """Subject x period rows where the subject was present (clinic and access known).

    ``measures`` names the period measures to read (clinic and access always
    are); the scan cannot prune them through the generator by itself.
    """
    group = RepeatedGroup.from_columns(columns_matching(wide, "_p[0-9]+$"), spec.period_pattern)
    if measures is not None:
        measures = list(dict.fromkeys(["clinic", "va", *measures]))
    long = unpivot_repeated(wide, list(id_cols), group, "period",
                            key_values=spec.suffix_to_label(), measures=measures)
    return long.where(F.col("clinic").isNotNull() & F.col("va").isNotNull())


def demographics(wide: DataFrame, spec: StudySpec) -> DataFrame:
    """Subject x period demographics: recoded labels, age at period start, age band."""
    d = period_long(wide, spec)
    anchor = _period_value(spec, lambda p: F.lit(p.start))
    return d.withColumns({
        "diabetes_type": value_map(F.col("diabetes_type"), DIABETES_TYPE_MAP),
        "va": value_map(F.col("va"), VASCULAR_ACCESS_MAP),
        "age": age_years(F.col("birth_date"), anchor),
    }).withColumn("age_group", band(F.col("age"), spec.age_bands))


def age_at_anchor(wide: DataFrame, spec: StudySpec) -> DataFrame:
    d = period_long(wide, spec, id_cols=("id", "birth_date"), measures=())
    anchor = _period_value(spec, lambda p: F.lit(p.start))
    return d.select("id", "period", "birth_date", anchor.alias("anchor_date"),
                    age_years(F.col("birth_date"), anchor).alias("age"))


def subject_periods(demo: DataFrame) -> DataFrame:
    """Distinct presence rows with the covariates used downstream."""
    return demo.select(*PRESENCE_COLUMNS).distinct()


def first_demographics(demo: DataFrame) -> DataFrame:
    """One demographics row per (id, period); tiebreak on all remaining columns, so rows that tie are equal."""
    lead = ["clinic", "status_date", "charlson", "va", "age"]
    others = [c for c in demo.columns if c not in ("id", "period", *lead)]
    order = [F.col(c).asc_nulls_last() for c in [*lead, *others]]
    return first_row_per_key(demo, ["id", "period"], order)


# ------------------------------------------------------------------- admissions

def admission_long(wide: DataFrame, spec: StudySpec, id_cols=("id", "gender", "htn", "diabetes"),
                   drop: str | None = "all", measures=None) -> DataFrame:
    """Admission-slot rows; ``adm_number`` is the slot within the file row. ``drop``: ``all`` = drop slots whose four measures
    are all NULL; ``start`` = drop slots without a start date; None = keep all.
    """
    group = RepeatedGroup.from_columns(columns_containing(wide, "hosp"), spec.slot_pattern)
    long = unpivot_repeated(wide, list(id_cols), group, "adm_number",
                            drop_all_null=(drop == "all"), key_type="int", measures=measures)
    if drop == "start":
        long = long.where(F.col("hosp_start").isNotNull())
    return long


def classified_admissions(wide: DataFrame, spec: StudySpec) -> DataFrame:
    """Admissions of the analysis table: period, cause label and 4-group, stay length.

    Stays outside both periods are dropped.
    """
    a = classify_periods(admission_long(wide, spec), spec.periods, bounds=spec.bounds)
    a = recode_causes(a, spec.vocabulary, outputs={"hosp_cause_groups": "group4",
                                                   "hosp_cause_label": "label"})
    a = a.withColumn("person_time", days_between(F.col("hosp_start"), F.col("hosp_end")))
    a = a.withColumn("log_person_time", floored_log(F.col("person_time")))
    a = a.where(F.col("period").isNotNull())
    return a.select("id", "gender", "htn", "diabetes", "adm_number", "hosp_start", "hosp_end",
                    "hosp_re", F.col("hosp_cause_label").alias("hosp_cause"), "period",
                    "hosp_cause_groups", "person_time", "log_person_time")


def admissions_by_presence(wide: DataFrame, spec: StudySpec, demo: DataFrame | None = None) -> DataFrame:
    """Analysis table: admissions right-joined to presence on five null-safe keys.

    Every present subject-period survives (with NULL admission columns when it
    had none); admissions of subject-periods not present are dropped.
    """
    demo = demo if demo is not None else demographics(wide, spec)
    events = classified_admissions(wide, spec)
    return null_safe_join(events, subject_periods(demo),
                          ["id", "period", "gender", "htn", "diabetes"], "right")


def length_of_stay(wide: DataFrame, spec: StudySpec) -> DataFrame:
    a = admission_long(wide, spec)
    pt = days_between(F.col("hosp_start"), F.col("hosp_end"))
    return a.select("id", "adm_number", "hosp_start", "hosp_end", pt.alias("person_time"),
                    floored_log(pt).alias("log_person_time"))


# ----------------------------------------------------------------- ratio chart

def ratio_events(wide: DataFrame, spec: StudySpec) -> DataFrame:
    """All slots classified, right-joined to distinct present (id, period).

    Slots outside every period can never meet a presence key (whose period
    is never NULL), so they are dropped before the shuffle.
    """
    slots = admission_long(wide, spec, id_cols=("id",), drop=None,
                           measures=("hosp_start", "hosp_end", "hosp_cause"))
    slots = classify_periods(slots, spec.periods, bounds=spec.bounds).where(F.col("period").isNotNull())
    presence = period_long(wide, spec, id_cols=("id",), measures=()).select("id", "period").distinct()
    j = null_safe_join(slots, presence, ["id", "period"], "right")
    j = j.withColumn("adm_number", F.coalesce(F.col("adm_number"), F.lit(0)))
    return recode_causes(j, spec.vocabulary, outputs={"hosp_cause": "group6"})


def cause_ratio(wide: DataFrame, spec: StudySpec) -> DataFrame:
    """Admissions per present subject, by period and 6-group cause, on the full grid."""
    ev = ratio_events(wide, spec)
    counts = ev.groupBy("period", "hosp_cause").agg(F.count(F.lit(1)).alias("hosp_count"))
    uniq = ev.groupBy("period").agg(n_distinct(F.col("id")).alias("unique_patients"))
    r = counts.join(uniq, "period", "left")
    ratio = F.col("hosp_count") / F.col("unique_patients")
    r = r.select("period", "hosp_cause", "hosp_count", ratio.alias("ratio"),
                 F.format_string("%.1f%%", F.round(ratio * 100, 1)).alias("ratio_label"))
    grid = level_grid(wide.sparkSession, [("period", spec.period_labels),
                                          ("hosp_cause", list(spec.group6_levels))])
    done = complete(r, grid, ["period", "hosp_cause"],
                    {"hosp_count": 0, "ratio": 0.0, "ratio_label": "0.0%"})
    return done.where(F.col("hosp_cause").isNotNull()).select(
        F.col("period").alias("Period"), F.col("hosp_cause").alias("Cause"),
        F.col("hosp_count").alias("Hospitalizations"), F.col("ratio").alias("Ratio"),
        F.col("ratio_label").alias("Ratio (%)"))


def admissions_in_periods(wide: DataFrame, spec: StudySpec) -> DataFrame:
    """Admissions with a start date inside a period: 6-group cause, days, readmission."""
    a = admission_long(wide, spec, id_cols=("id",), drop="start")
    a = classify_periods(a, spec.periods, bounds=spec.bounds)
    a = recode_causes(a, spec.vocabulary, outputs={"hosp_cause_groups": "group6"})
    a = a.withColumn("hosp_length", days_between(F.col("hosp_start"), F.col("hosp_end")))
    return a.where(F.col("period").isNotNull())


def cause_period_summary(wide: DataFrame, spec: StudySpec) -> DataFrame:
    """Admissions in the periods, per period and 6-group cause: count, days, readmissions."""
    return admissions_in_periods(wide, spec).groupBy("period", "hosp_cause_groups").agg(
        F.count(F.lit(1)).alias("hosp_count"),
        strict_sum(F.col("hosp_length")).cast("long").alias("hosp_length"),
        strict_count_if(F.col("hosp_re") == F.lit("Si")).alias("hosp_readmission"))


# --------------------------------------------------------------------- paired

def both_period_subjects(analysis: DataFrame, n_periods: int = 2) -> DataFrame:
    """Subjects seen in every period of the analysis table."""
    return (analysis.groupBy("id").agg(n_distinct(F.col("period")).alias("unique_periods"))
            .where(F.col("unique_periods") == n_periods).select("id"))


def subject_period_grid(analysis: DataFrame, demo: DataFrame, spec: StudySpec) -> DataFrame:
    """Paired subjects x every period, with that period's covariates (left join)."""
    grid = expand_keys(both_period_subjects(analysis, len(spec.periods)), "period", spec.period_labels)
    cov = first_demographics(demo).select("id", "period", "gender", "age", "age_group", "htn",
                                          "diabetes", "charlson", "va", "clinic")
    return null_safe_join(grid, cov, ["id", "period"], "left")


def event_counts(analysis: DataFrame, require_group: bool = True) -> DataFrame:
    """Per (id, period): admissions and flags by group.

    ``require_group`` counts admissions with a known cause group only (``ungrouped_admissions`` tells
    how many that leaves out); without it every admission counts.
    """
    g = F.col("hosp_cause_groups")
    return (analysis.where(g.isNotNull() if require_group else F.col("adm_number").isNotNull())
            .groupBy("id", "period").agg(
        F.count(F.lit(1)).alias("hosp_count"),
        (F.count_if(g == INFECTION) > 0).alias("infection_any"),
        F.count_if(g == INFECTION).alias("infection_count"),
        (F.count_if(g == CARDIO) > 0).alias("cardio_any"),
        F.count_if(g == CARDIO).alias("cardio_count")))


def ungrouped_admissions(analysis: DataFrame) -> DataFrame:
    """Per period: admissions, those without a cause group, and the subject-periods all of whose admissions lack one."""
    lacks = F.col("hosp_cause_groups").isNull()
    per = analysis.where(F.col("adm_number").isNotNull()).groupBy("id", "period").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(lacks).alias("dropped"))
    return per.groupBy("period").agg(
        F.sum("n").alias("admissions"), F.sum("dropped").alias("dropped_admissions"),
        F.count_if(F.col("n") == F.col("dropped")).alias("emptied_subject_periods"))


def cause_group_subjects(analysis: DataFrame) -> DataFrame:
    """One row per subject, period and cause group of its admissions (the patient grain of the cause tables)."""
    return analysis.where(F.col("hosp_cause_groups").isNotNull()).select(
        "id", "period", "hosp_cause_groups", "charlson", "age_group", "gender", "htn", "diabetes").distinct()


def paired_event_counts(analysis: DataFrame, demo: DataFrame, spec: StudySpec,
                        require_group: bool = True) -> DataFrame:
    grid = subject_period_grid(analysis, demo, spec)
    j = null_safe_join(grid, event_counts(analysis, require_group), ["id", "period"], "left")
    return j.select(
        *grid.columns,
        F.when(F.col("hosp_count").isNull(), 0).otherwise(1).alias("hosp_any"),
        F.coalesce(F.col("hosp_count"), F.lit(0)).alias("hosp_count"),
        F.coalesce(F.col("infection_any").cast("int"), F.lit(0)).alias("infection_any"),
        F.coalesce(F.col("infection_count"), F.lit(0)).alias("infection_count"),
        F.coalesce(F.col("cardio_any").cast("int"), F.lit(0)).alias("cardio_any"),
        F.coalesce(F.col("cardio_count"), F.lit(0)).alias("cardio_count"))


PAIRED_MEASURES = ["charlson", "age_group", "hosp_any", "hosp_count", "infection_any",
                   "infection_count", "cardio_any", "cardio_count"]


def period_wide(paired: DataFrame, spec: StudySpec) -> DataFrame:
    from cohortflow.operators.reshape import pivot_measures
    return pivot_measures(paired, ["id", "gender", "htn", "diabetes"], "period",
                          spec.period_labels, PAIRED_MEASURES)


# -------------------------------------------------------------------- unpaired

def unpaired_event_flags(analysis: DataFrame, demo: DataFrame, spec: StudySpec, strict: bool = False) -> DataFrame:
    """Per observed (id, period): covariates of that period, event flags, pairing flag.

    Covariates come from the subject-period table and are joined on (id,
    period). Only rows with an admission count as events; unmapped causes are
    skipped in the infection counts, or with ``strict`` make the counts of their
    subject-period missing, which the zero fill turns into 0.
    """
    observed = analysis.select("id", "period").distinct()
    cov = first_demographics(demo).select("id", "period", "gender", "htn", "diabetes",
                                          "charlson", "age_group")
    g = F.col("hosp_cause_groups")
    infections = strict_count_if(g == INFECTION) if strict else F.count_if(g == INFECTION)
    ev = (analysis.where(F.col("adm_number").isNotNull()).groupBy("id", "period").agg(
        F.count(F.lit(1)).alias("hosp_count"),
        (infections > 0).cast("int").alias("any_infection"),
        infections.alias("infection_count")))
    j = null_safe_join(null_safe_join(observed, cov, ["id", "period"], "left"),
                       ev, ["id", "period"], "left")
    j = j.select("id", "period", "gender", "htn", "diabetes", "charlson", "age_group",
                 F.when(F.col("hosp_count").isNull(), 0).otherwise(1).alias("was_hospitalized"),
                 F.coalesce(F.col("hosp_count"), F.lit(0)).alias("hosp_count"),
                 F.coalesce(F.col("any_infection"), F.lit(0)).alias("any_infection"),
                 F.coalesce(F.col("infection_count"), F.lit(0)).alias("infection_count"))
    return membership_flag(j, both_period_subjects(analysis, len(spec.periods)), "id",
                           "in_both_periods")


def with_exposure(df: DataFrame, spec: StudySpec) -> DataFrame:
    """Window length in days of the row's period, and its log (model offset)."""
    days = _period_value(spec, lambda p: F.lit(float(p.days)))
    return df.withColumn("exposure_time", days).withColumn("log_exposure", F.ln(F.col("exposure_time")))

