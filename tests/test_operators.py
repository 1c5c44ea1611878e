"""Invariants and brute-force checks of reshapes, ranks, tests and models."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortflow.functions.tails import chi2_sf, fisher_2x2, t_two_sided
from cohortflow.operators.models import design_matrix, fit_logistic, fit_negative_binomial
from cohortflow.operators.ranks import cumulative_before, exact_quantiles, midranks
from cohortflow.operators.reshape import pivot_measures, unpivot_repeated
from cohortflow.operators.stats import (_hypergeometric, cell_counts, chi_square, mcnemar,
                                        monte_carlo_independence)
from cohortflow.spec import RepeatedGroup


def test_unpivot_then_pivot_is_identity(spark):
    wide = spark.createDataFrame([("a", 1, "x", 2, "y"), ("b", None, None, 4, "z")],
                                 "id string, n_p1 int, s_p1 string, n_p2 int, s_p2 string")
    g = RepeatedGroup.from_columns(wide.columns, r"(.+?)_(p[12])")
    assert g.measures == ("n", "s") and g.suffixes == ("p1", "p2")
    long = unpivot_repeated(wide, ["id"], g, "k")
    assert long.count() == 4
    back = pivot_measures(long, ["id"], "k", ["p1", "p2"], ["n", "s"])
    assert sorted(map(tuple, back.select(*wide.columns).collect()), key=str) == \
        sorted(map(tuple, wide.collect()), key=str)
    dropped = unpivot_repeated(wide, ["id"], g, "k", drop_all_null=True)
    assert dropped.count() == 3


def test_cumulative_counts_match_brute_force(spark):
    rng = random.Random(7)
    rows = [(rng.choice("ab"), float(rng.randint(0, 40))) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, v double")
    hist = df.groupBy("k", "v").count()
    got = {(r.k, r.v): r.before for r in cumulative_before(hist, ["k"], "v", "count", buckets=7).collect()}
    pdf = pd.DataFrame(rows, columns=["k", "v"])
    for (k, v), b in got.items():
        assert b == int(((pdf.k == k) & (pdf.v < v)).sum())


def test_midranks_match_pandas(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["g1", "g2", "g3"]), float(rng.randint(0, 25))) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("k", F.lit(1))
    mr = {r.v: r.midrank for r in midranks(df, ["k"], "v", "g").collect()}
    pdf = pd.DataFrame(rows, columns=["g", "v"])
    ranks = pdf.v.rank(method="average")
    for v, r in zip(pdf.v, ranks):
        assert abs(mr[v] - r) < 1e-9


@pytest.mark.parametrize("qtype,expected", [(7, 1.75), (2, 1.5)])
def test_quantile_types(spark, qtype, expected):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double")
    r = exact_quantiles(df, [], "v", {"q": 0.25}, qtype).first()
    assert abs(r["q"] - expected) < 1e-12


def test_chi_square_known_table(spark):
    rows = [("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 15 + [("b", "y")] * 9
    df = spark.createDataFrame(rows, "r string, c string").withColumn("t", F.lit("t"))
    out = chi_square(cell_counts(df, ["t"], "r", "c"), ["t"]).first()
    assert abs(out["statistic"] - 4.5621) < 1e-4 and abs(out["p_value"] - 0.0327) < 1e-4


@pytest.mark.parametrize("b,c,stat", [(86, 150, 3969 / 236), (5, 5, 0.0), (0, 0, None)])
def test_mcnemar_cases(spark, b, c, stat):
    t = spark.createDataFrame([("m", 0, 0, 7), ("m", 0, 1, b), ("m", 1, 0, c), ("m", 1, 1, 3)],
                              "measure string, row_level int, col_level int, n long")
    r = mcnemar(t).first()
    if stat is None:
        assert r["statistic"] is None
    else:
        assert abs(r["statistic"] - stat) < 1e-9


def test_tails():
    assert abs(chi2_sf(4.5621, 1) - 0.0327) < 1e-4
    assert abs(t_two_sided(2.0, 10) - 0.07338803477) < 1e-9
    assert abs(fisher_2x2(3, 1, 1, 3) - 0.4857142857) < 1e-9


def test_monte_carlo_is_reproducible(spark):
    rows = [("k", "a", "x", 10), ("k", "a", "y", 20), ("k", "b", "x", 15), ("k", "b", "y", 9)]
    counts = spark.createDataFrame(rows, "key string, row_level string, col_level string, n long")
    r1 = monte_carlo_independence(counts, ["key"], replicates=400).first()
    r2 = monte_carlo_independence(counts.repartition(3), ["key"], replicates=400).first()
    assert r1["chisq_p_value"] == r2["chisq_p_value"]
    assert 0.01 < r1["chisq_p_value"] < 0.15


def test_monte_carlo_is_near_the_exact_p(spark):
    counts = spark.createDataFrame([("k", "a", "x", 3), ("k", "a", "y", 9), ("k", "b", "x", 8), ("k", "b", "y", 4)],
                                   "key string, row_level string, col_level string, n long")
    p = monte_carlo_independence(counts, ["key"], replicates=4000).first()["fisher_p_value"]
    assert abs(p - fisher_2x2(3, 9, 8, 4)) < 0.03


def test_monte_carlo_in_blocks(spark):
    rng = random.Random(11)
    rows = [(k, f"r{i}", c, rng.randint(1, 9)) for k in ("k", None) for i in range(12) for c in "xyz"]
    counts = spark.createDataFrame(rows, "key string, row_level string, col_level string, n long")
    whole = {r["key"]: r for r in monte_carlo_independence(counts, ["key"], 1050).collect()}
    cut = {r["key"]: r for r in monte_carlo_independence(counts, ["key"], 1050, block_levels=4).collect()}
    assert set(whole) == set(cut) == {"k", None}
    for k, r in whole.items():
        assert r["replicates"] == cut[k]["replicates"] == 1050
        assert abs(r["chisq_statistic"] - cut[k]["chisq_statistic"]) < 1e-9
        assert abs(r["chisq_p_value"] - cut[k]["chisq_p_value"]) < 0.08
        assert abs(r["fisher_p_value"] - cut[k]["fisher_p_value"]) < 0.08


def test_hypergeometric_of_a_large_population():
    good, bad, draw = 3 * 10 ** 9, 2 * 10 ** 9, 1000
    got = _hypergeometric(np.random.default_rng(1), *(np.full(400, v) for v in (good, bad, draw)))
    assert abs(got.mean() - 600) < 4 and 10 < got.std() < 22


def test_logistic_rejects_constant_outcome(spark):
    df = spark.createDataFrame([("Pre", 1), ("Post", 1)], "period string, y int")
    d = design_matrix(df, {"period": ["Pre", "Post"]}, [], ["y"])
    with pytest.raises(ValueError):
        fit_logistic(d, "y", ["periodPost"])


def test_saturated_models_closed_form(spark):
    rows = ([("Pre", 1, 3)] * 30 + [("Pre", 0, 0)] * 70 + [("Post", 1, 5)] * 45 + [("Post", 0, 1)] * 55)
    df = spark.createDataFrame(rows, "period string, y int, c int").withColumn("off", F.lit(0.0))
    d = design_matrix(df, {"period": ["Pre", "Post"]}, [], ["y", "c", "off"])
    lg = {r.term: r for r in fit_logistic(d, "y", ["periodPost"]).collect()}
    assert abs(lg["periodPost"].estimate - math.log((45 / 55) / (30 / 70))) < 1e-8
    assert abs(lg["periodPost"].std_error - math.sqrt(1 / 30 + 1 / 70 + 1 / 45 + 1 / 55)) < 1e-6
    nb = {r.term: r for r in fit_negative_binomial(d, "c", ["periodPost"], offset="off").collect()}
    m_pre, m_post = 0.9, (45 * 5 + 55) / 100
    assert abs(nb["(Intercept)"].estimate - math.log(m_pre)) < 1e-7
    assert abs(nb["periodPost"].estimate - math.log(m_post / m_pre)) < 1e-7
