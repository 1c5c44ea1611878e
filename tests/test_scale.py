"""Exactness that must not rest on the optimizer, completeness of the admissions, and model edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.operators.models import design_matrix, fit_logistic, fit_negative_binomial
from cohortflow.operators.ranks import cumulative_before
from cohortflow.operators.reshape import complete
from cohortflow.plans import queries as Q
from cohortflow.plans import study as S

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("reuse", ["true", "false"])
@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_running_counts_of_many_values(spark, reuse, adaptive):
    conf = {"spark.sql.exchange.reuse": reuse, "spark.sql.adaptive.enabled": adaptive}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        n = 1_200_000
        hist = spark.range(n).select(((F.col("id") * 7919) % n).alias("value"), F.lit(1).cast("long").alias("n"),
                                     F.lit("k").alias("k"))
        wrong = cumulative_before(hist, ["k"], "value", "n").filter("before <> value").count()
        assert wrong == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_every_order_of_a_customer_is_an_admission(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    known = orders.join(spark.read.parquet(f"{sf}/customer.parquet"), F.col("o_custkey") == F.col("c_custkey"))
    wide = Q.wide(spark, sf)
    assert S.admission_long(wide, Q.SPEC).count() == known.count()
    long = S.period_long(wide, Q.SPEC)
    assert long.count() == long.select("id", "period").distinct().count()


def test_presence_reads_only_its_columns(spark):
    plan = S.period_long(Q.wide(spark, SF), Q.SPEC, id_cols=("id",), measures=()).select("id", "period")
    scan = plan._jdf.queryExecution().executedPlan().toString()
    assert "clinic_p1" in scan and "karnofsky_p1" not in scan and "hosp_start_1" not in scan


def test_complete_keeps_keys_outside_the_grid(spark):
    seen = spark.createDataFrame([("a", 1), (None, 2)], "k string, n long")
    grid = spark.createDataFrame([("a",), ("b",)], "k string")
    assert sorted(map(tuple, complete(seen, grid, ["k"], {"n": 0}).collect()), key=repr) == [
        ("a", 1), ("b", 0), (None, 2)]


def model_rows(spark, seed=1, n=800):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        period, sex, x = ("Pre", "Post")[rng.integers(2)], ("F", "M")[rng.integers(2)], float(rng.normal())
        eta = 0.3 * (period == "Post") - 0.4 * (sex == "M") + 0.5 * x
        rows.append((period, sex, round(x, 1), int(rng.random() < 1 / (1 + math.exp(-eta))),
                     int(rng.negative_binomial(2, 2 / (2 + math.exp(eta)))), 0.0))
    return spark.createDataFrame(rows, "period string, sex string, x double, y int, c int, off double")


def scores(df, fit, y, mean, weight):
    """Score equations of the fitted model, by numpy on the collected rows."""
    beta = {r.term: r.estimate or 0.0 for r in fit}
    pdf = df.toPandas()
    design = np.column_stack([np.ones(len(pdf)), pdf.period == "Post", pdf.sex == "M", pdf.x]).astype(float)
    mu = mean(design @ np.array([beta[t] for t in ("(Intercept)", "periodPost", "sexM", "x")]))
    return design.T @ ((pdf[y].to_numpy() - mu) * weight(mu)), pdf, mu


FACTORS = {"period": ["Pre", "Post"], "sex": ["F", "M"]}
TERMS = ["periodPost", "sexM", "x"]


def test_logistic_solves_its_score_equations_and_reports_row_deviance(spark):
    df = model_rows(spark)
    fit = fit_logistic(design_matrix(df, FACTORS, ["x"], ["y"]), "y", TERMS).collect()
    score, pdf, mu = scores(df, fit, "y", lambda e: 1 / (1 + np.exp(-e)), lambda m: 1.0)
    assert np.abs(score).max() < 1e-6 and all(r.converged for r in fit)
    y = pdf.y.to_numpy()
    assert abs(fit[0].deviance + 2 * np.sum(y * np.log(mu) + (1 - y) * np.log(1 - mu))) < 1e-6


def test_negative_binomial_solves_its_score_equations(spark):
    df = model_rows(spark, seed=2)
    fit = fit_negative_binomial(design_matrix(df, FACTORS, ["x"], ["c", "off"]), "c", TERMS, offset="off").collect()
    theta = fit[0].theta
    score, pdf, mu = scores(df, fit, "c", np.exp, lambda m: 1 / (1 + m / theta))
    assert np.abs(score).max() < 1e-5 and fit[0].converged
    c = pdf.c.to_numpy()
    steps = np.array([sum(1 / (theta + k) for k in range(v)) for v in c])
    slope = np.sum(steps + math.log(theta) + 1 - np.log(theta + mu) - (c + theta) / (mu + theta))
    assert abs(slope) < 1e-2


def test_a_level_without_rows_is_null(spark):
    df = model_rows(spark).filter("sex = 'F'")
    fit = {r.term: r for r in fit_logistic(design_matrix(df, FACTORS, ["x"], ["y"]), "y", TERMS).collect()}
    assert fit["sexM"].estimate is None and fit["x"].estimate is not None and fit["x"].converged


def test_counts_without_dispersion_are_the_poisson_limit(spark):
    df = spark.createDataFrame([("Pre", v, 0.0) for v in (1, 2, 2, 3) * 20]
                               + [("Post", v, 0.0) for v in (2, 3, 3, 4) * 20], "period string, c int, off double")
    fit = {r.term: r for r in fit_negative_binomial(
        design_matrix(df, {"period": ["Pre", "Post"]}, [], ["c", "off"]), "c", ["periodPost"], "off").collect()}
    assert fit["periodPost"].theta is None and fit["periodPost"].converged
    assert abs(fit["periodPost"].estimate - math.log(3 / 2)) < 1e-7


def test_separation_is_reported(spark):
    df = spark.createDataFrame([("Pre", 0)] * 20 + [("Post", 1)] * 20, "period string, y int")
    fit = fit_logistic(design_matrix(df, {"period": ["Pre", "Post"]}, [], ["y"]), "y", ["periodPost"], max_iter=10)
    assert not fit.first().converged
