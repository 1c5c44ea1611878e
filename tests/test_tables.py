"""Described tables, test statistics on awkward inputs, and p-value tails at large sizes."""

import math
from itertools import product

import pytest
from pyspark.sql import functions as F

from cohortflow.functions.tails import fisher_2x2, t_two_sided
from cohortflow.operators.stats import cell_counts, chi_square
from cohortflow.operators.summary import described_table


@pytest.fixture(scope="module")
def table(spark):
    rows = [("a", float(i), "low" if i % 3 else None, "No", None) for i in range(12)]
    rows += [("b", float(i) + 0.5, "high", "No", "x") for i in range(12)] + [(None, 99.0, "low", "Si", "x")]
    df = spark.createDataFrame(rows, "arm string, age double, band string, flag string, code string")
    return described_table(df, "arm", continuous=["age"], categorical=["band", "code"], dichotomous={"flag": "Si"},
                           declared={"band": ["low", "middle", "high"]}, labels={"age": "Age"},
                           text={"age": ("mean", " y")}, replicates=0, first_level="a").collect()


def test_declared_and_shown_levels_appear_unobserved(table):
    band = {(r["level"], r["grp"]): (r["n"], r["denom"], r["level_no"], r["n_missing"])
            for r in table if r["variable"] == "band"}
    assert band == {("low", "a"): (8, 8, 1, 4), ("middle", "a"): (0, 8, 2, 4), ("high", "a"): (0, 8, 3, 4),
                    ("low", "b"): (0, 12, 1, 0), ("middle", "b"): (0, 12, 2, 0), ("high", "b"): (12, 12, 3, 0)}
    assert {(r["level"], r["grp"], r["stat_label"]) for r in table if r["variable"] == "flag"} == {
        ("Si", "a", "0 (0.0%)"), ("Si", "b", "0 (0.0%)")}


def test_labels_text_and_tests_are_joined(table):
    age = {r["grp"]: r for r in table if r["variable"] == "age"}
    assert age["a"]["label"] == "Age" and age["a"]["stat_label"] == "5.5 (±3.6) y"
    assert age["a"]["test"] == "wilcox.test" and 0 < age["a"]["p_value"] <= 1
    assert {r["test"] for r in table if r["variable"] == "band"} == {"fisher.test"}
    assert not [r for r in table if r["grp"] is None]
    assert [r["grp"] for r in table if r["variable"] == "code"] == ["b"]       # all missing in the other group


def test_chi_square_of_a_null_stratum_and_a_single_level(spark):
    rows = [(None, r, c) for r, c in product("xy", "pq") for _ in range(5)] + [("k", "x", "p"), ("k", "x", "q")]
    got = {r["s"]: r for r in chi_square(cell_counts(spark.createDataFrame(rows, "s string, r string, c string"),
                                                     ["s"], "r", "c"), ["s"]).collect()}
    assert got[None]["n_total"] == 20 and abs(got[None]["statistic"]) < 1e-12
    assert got["k"]["statistic"] is None and got["k"]["p_value"] is None


@pytest.mark.parametrize("a,b,c,d", [(0, 0, 0, 0), (3, 0, 0, 3), (1, 9, 11, 3), (8, 2, 1, 5), (0, 7, 5, 0),
                                     (40, 60, 55, 45)])
def test_fisher_equals_the_sum_over_its_whole_support(a, b, c, d):
    r1, c1, n = a + b, a + c, a + b + c + d
    p = {x: math.comb(r1, x) * math.comb(n - r1, c1 - x) for x in range(max(0, r1 + c1 - n), min(r1, c1) + 1)}
    want = sum(v for v in p.values() if v <= p[a] * (1 + 1e-7)) / math.comb(n, c1)
    assert math.isclose(fisher_2x2(a, b, c, d), want, rel_tol=1e-9)


def test_tails_at_large_sizes():
    big = 2_500_000_000
    assert math.isclose(fisher_2x2(big, big, big, big), 1.0, rel_tol=1e-6)
    assert fisher_2x2(big, 1000, 1000, big) == 0.0
    assert math.isclose(t_two_sided(2.0, 1e12), math.erfc(2 / math.sqrt(2)), rel_tol=1e-9)
    assert math.isclose(t_two_sided(2.0, 1.0001e6), t_two_sided(2.0, 0.9999e6), rel_tol=1e-7)


def test_first_row_of_tied_subject_periods_is_determined(spark):
    from cohortflow.plans import queries as Q
    from cohortflow.plans import study as S
    demo = Q.demo(spark, "/root/testdata/sf0.001")
    twins = demo.unionByName(demo.withColumn("status", F.lit("zz"))).repartition(7)
    want = sorted(map(tuple, S.first_demographics(demo).collect()), key=repr)
    got = sorted(map(tuple, S.first_demographics(twins).select(*demo.columns).collect()), key=repr)
    assert got == want
