"""Hand fixtures for the missing-value, calendar and band rules."""

import datetime as dt

from pyspark.sql import functions as F

from cohortflow.functions.dates import age_years, days_between, floored_log
from cohortflow.functions.parse import parse_decimal_comma, parse_dmy
from cohortflow.functions.recode import band, if_else, strict_sum
from cohortflow.operators.classify import period_of_stay
from cohortflow.operators.cohort import null_safe_join
from cohortflow.spec import AGE_BANDS, FIXTURE_PERIODS


def test_band_edges(spark):
    df = spark.createDataFrame([(18.0,), (50.0,), (50.01,), (76.0,), (None,)], "x double")
    got = [r[0] for r in df.select(band(F.col("x"), AGE_BANDS)).collect()]
    assert got == [None, "18-49", "50-64", "≥ 75", None]


def test_age_calendar_years(spark):
    df = spark.createDataFrame([(dt.date(1960, 5, 1), dt.date(2023, 10, 28))], "b date, r date")
    age = df.select(age_years(F.col("b"), F.col("r"))).first()[0]
    assert abs(age - 63.49180327868852) < 1e-12


def test_age_leap_day_birth(spark):
    df = spark.createDataFrame([(dt.date(2000, 2, 29), dt.date(2001, 2, 28)),
                                (dt.date(2000, 2, 29), dt.date(2001, 3, 1))], "b date, r date")
    got = [r[0] for r in df.select(age_years(F.col("b"), F.col("r"))).collect()]
    assert got[0] < 1.0 and abs(got[1] - 1.0) < 1e-12


def test_date_parse(spark):
    df = spark.createDataFrame([("28/10/2023",), ("8/1/2023",), ("31/02/2024",), ("NA",), (" ",)], "s string")
    got = [r[0] for r in df.select(parse_dmy(F.col("s"))).collect()]
    assert got == [dt.date(2023, 10, 28), dt.date(2023, 1, 8), None, None, None]


def test_number_parse(spark):
    df = spark.createDataFrame([("3,5",), ("1.234,5",), ("NA",), ("",), ("NaN",), ("7",)], "s string")
    got = [r[0] for r in df.select(parse_decimal_comma(F.col("s"))).collect()]
    assert got == [3.5, None, None, None, None, 7.0]


def test_period_bounds_are_strict(spark):
    p = FIXTURE_PERIODS[0]
    rows = [(p.start, p.start + dt.timedelta(days=3)), (p.start + dt.timedelta(days=1), p.end),
            (p.start + dt.timedelta(days=1), None), (p.start + dt.timedelta(days=1), p.end - dt.timedelta(days=1))]
    df = spark.createDataFrame(rows, "s date, e date")
    got = [r[0] for r in df.select(period_of_stay(F.col("s"), F.col("e"), FIXTURE_PERIODS)).collect()]
    assert got == [None, None, None, p.label]


def test_strict_and_skip_sum(spark):
    df = spark.createDataFrame([(2,), (None,)], "x int")
    r = df.agg(strict_sum(F.col("x")).alias("s"), F.sum("x").alias("k")).first()
    assert r["s"] is None and r["k"] == 2


def test_zero_stay_log_floor(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 1), dt.date(2020, 1, 1))], "s date, e date")
    r = df.select(days_between(F.col("s"), F.col("e")).alias("d"),
                  floored_log(days_between(F.col("s"), F.col("e"))).alias("l")).first()
    assert r["d"] == 0 and abs(r["l"] - (-2.302585092994046)) < 1e-12


def test_if_else_null_condition(spark):
    df = spark.createDataFrame([(None,), (1,), (0,)], "x int")
    got = [r[0] for r in df.select(if_else(F.col("x") == 1, F.lit("a"), F.lit("b"))).collect()]
    assert got == [None, "a", "b"]


def test_null_safe_join_matches_null_keys(spark):
    left = spark.createDataFrame([("1", None, 10)], "id string, g string, v int")
    right = spark.createDataFrame([("1", None, "x"), ("2", "F", "y")], "id string, g string, w string")
    out = null_safe_join(left, right, ["id", "g"], "right").orderBy("id").collect()
    assert [(r.id, r.g, r.v, r.w) for r in out] == [("1", None, 10, "x"), ("2", "F", None, "y")]


def test_csv_scan_and_typing(spark, tmp_path):
    from cohortflow.sources.wide import read_wide_csv, type_wide
    from cohortflow.spec import wide_columns
    cols = wide_columns()
    row = {c: "" for c in cols}
    row.update({"id": "7", "birth_date": "1/5/1960", "gender": "F", "htn": "Y", "charlson_p1": '"3,5"',
                "charlson_p2": "NA", "hosp_start_1": "2/11/2023", "hosp_end_1": "31/02/2024",
                "hosp_re_1": "Yes", "hosp_cause_1": '"Injury/Accident"', "clinic_p1": " Valencia "})
    path = tmp_path / "wide.csv"
    path.write_text(",".join(f"c{i}" for i in range(len(cols))) + "\n"
                    + ",".join(row[c] for c in cols) + "\n\n")
    w = type_wide(read_wide_csv(spark, str(path))).first()
    assert w["id"] == "7" and w["gender"] == "Mujer" and w["htn"] == "Si"
    assert w["charlson_p1"] == 3.5 and w["charlson_p2"] is None
    assert w["hosp_start_1"] == dt.date(2023, 11, 2) and w["hosp_end_1"] is None
    assert w["hosp_re_1"] == "Si" and w["hosp_cause_1"] == "Injury/Accident"
    assert w["clinic_p1"] == "Valencia" and w["diabetes"] == "No"
