"""The shared mechanisms: cells and order index under NULL strata, paired record, tails, model rounds, dimensions."""

import math
import statistics
from decimal import Decimal, getcontext

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow import session
from cohortflow.functions.tails import chi2_sf, t_two_sided
from cohortflow.operators import models, summary
from cohortflow.operators.classify import classify_causes, taxonomy_table
from cohortflow.operators.cohort import join_dimension
from cohortflow.operators.stats import paired_record, paired_tests, rank_sum
from cohortflow.plans import queries as Q
from cohortflow.plans import study as S
from cohortflow.spec import CAUSE_VOCABULARY, CHART_LABELS

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------ NULL strata

@pytest.fixture(scope="module")
def stratified(spark):
    rng = np.random.default_rng(4)
    rows = []
    for s in (None, "k"):           # both strata hold the same rows
        for i, (v, c, d) in enumerate(zip(rng.permutation(60).tolist(), [0, 1, 2] * 20, [0] * 55 + [1] * 5)):
            rows.append((s, "ab"[i % 2], float(v), "xyz"[c], "no" if d == 0 else "yes"))
        rng = np.random.default_rng(4)
    return spark.createDataFrame(rows, "s string, arm string, v double, c string, d string")


def test_a_null_stratum_keeps_every_statistic(stratified):
    got = summary.summary_table(stratified, "arm", ["s"], continuous=["v"], categorical=["c"],
                                dichotomous={"d": "yes"}).collect()
    strata = {s: sorted((tuple(r)[1:] for r in got if r["s"] == s), key=repr) for s in (None, "k")}
    assert strata[None] == strata["k"] and len(strata["k"]) == 2 + 6 + 2
    assert all(r["median"] is not None for r in got if r["variable"] == "v")


def test_a_null_stratum_keeps_every_test(stratified):
    got = summary.summary_tests(stratified, "arm", ["v", "c", "d"], ["s"], simulate=("c",), replicates=200).collect()
    for v in ("v", "c", "d"):
        one, other = [r for r in got if r["variable"] == v]
        assert {one["s"], other["s"]} == {None, "k"} and one["test"] == other["test"]
        assert one["p_value"] is not None and other["p_value"] is not None
        if v != "c":            # both simulate c, each with its own draws
            assert tuple(one)[1:] == tuple(other)[1:]


def test_rank_sum_with_a_null_key(spark, stratified):
    got = {r["s"]: r["p_value"] for r in rank_sum(stratified, ["s"], "v", "arm").collect()}
    assert got[None] is not None and got[None] == got["k"]


def test_moments_and_quartiles_of_the_index(spark):
    rng = np.random.default_rng(8)
    data = [("ab"[i % 2], 1e9 + float(x)) for i, x in enumerate(rng.normal(size=501))] + [("a", None), ("b", math.nan)]
    got = {r["grp"]: r for r in summary.summary_continuous(
        spark.createDataFrame(data, "g string, v double"), ["v"], "g").collect()}
    for g in "ab":
        x = [v for k, v in data if k == g and v is not None and v == v]
        assert got[g]["n"] == len(x) and got[g]["n_missing"] == 1
        assert math.isclose(got[g]["sd"], statistics.stdev(x), rel_tol=1e-6)    # large mean, small spread
        assert math.isclose(got[g]["median"], statistics.median(x), rel_tol=1e-15)


def test_a_summary_scans_its_input_once(spark, stratified, tmp_path):
    stratified.write.parquet(str(tmp_path / "t"))
    counts = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: counts.add(1) or x, "string").asNondeterministic()
    df = spark.read.parquet(str(tmp_path / "t")).withColumn("s", seen("s"))
    summary.summary_table(df, "arm", ["s"], continuous=["v"], categorical=["c"]).collect()
    assert counts.value == 120


def test_kinds_are_told_without_a_distinct_exchange(spark):
    df = spark.range(20000).select((F.col("id") % 9).cast("double").alias("few"), F.col("id").cast("double").alias("many"),
                                   (F.col("id") % 10).alias("ten"), F.col("id").cast("string").alias("text"),
                                   F.lit(None).cast("int").alias("none"))
    prof = summary.summary_kind_profile(df, df.columns)
    plan = prof._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning" not in plan
    assert {r["variable"]: (r["n_distinct"], r["kind"]) for r in prof.collect()} == {
        "few": (9, "categorical"), "many": (10, "continuous"), "ten": (10, "continuous"), "text": (10, "categorical"),
        "none": (0, "categorical")}


def test_the_kind_profile_query_counts_every_value(spark, monkeypatch):
    from cohortflow.plans import queries

    names = queries.DEMO_VARIABLES
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, F.col("id") + 2 ** 60).alias(names[0]), (F.col("id") % 25).cast("string").alias(names[1]),
        (F.col("id") % 9).cast("int").alias(names[2]), F.date_add(F.lit("2020-01-01"), (F.col("id") % 40).cast("int"))
        .alias(names[3]), *[F.lit(None).cast("string").alias(v) for v in names[4:]])
    monkeypatch.setattr(queries, "demo", lambda spark, sf_dir: df)
    got = {r["variable"]: (r["n_distinct"], r["n_missing"], r["is_numeric"], r["kind"])
           for r in queries.QUERIES["summary_kind_profile"](spark, "").collect()}
    assert got == {names[0]: (2000, 1000, True, "continuous"), names[1]: (25, 0, False, "categorical"),
                   names[2]: (9, 0, True, "categorical"), names[3]: (40, 0, False, "categorical"),
                   **{v: (0, 3000, False, "categorical") for v in names[4:]}}


# ----------------------------------------------------------- paired record

def test_paired_record_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(float(a), float(b) if i % 9 else None, int(a > 2), int(b > 2)) for i, (a, b) in
            enumerate(rng.poisson(2.5, (200, 2)).tolist())]
    df = spark.createDataFrame(rows, "post double, pre double, r int, c int")
    record = paired_record(df, {"m": ("post", "pre")}, {"m": ("r", "c"), "flag": ("r", "c")})
    assert record._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {x["measure"]: x for x in paired_tests(record).collect()}
    x = np.array([(a, b) for a, b, *_ in rows if b is not None])
    d = x[:, 0] - x[:, 1]
    t = d.mean() / (d.std(ddof=1) / math.sqrt(len(d)))
    m = got["m"]
    assert m["n_pairs"] == len(d) and math.isclose(m["t"], t) and math.isclose(m["t_p_value"], t_two_sided(t, len(d) - 1))
    corr = np.corrcoef(x.T)[0, 1]
    assert math.isclose(m["r"], corr) and math.isclose(m["d"], d.mean() / (d.std(ddof=1) / math.sqrt(2 * (1 - corr))))
    cells = [sum(1 for *_, r, c in rows if (r, c) == rc) for rc in ((0, 0), (0, 1), (1, 0), (1, 1))]
    assert [got["flag"][f"n_{k}"] for k in ("00", "01", "10", "11")] == cells == [m[f"n_{k}"] for k in ("00", "01", "10", "11")]
    assert got["flag"]["t"] is None and got["flag"]["mcnemar"] == m["mcnemar"]


# ------------------------------------------------------------------ tails

def chi2_even(x, df):
    getcontext().prec = 60
    y = Decimal(x) / 2
    term = total = Decimal(1)
    for j in range(1, df // 2):
        term *= y / j
        total += term
    return float((-y).exp() * total)


@pytest.mark.parametrize("df", [2, 40, 200, 202, 1000, 10_000])
@pytest.mark.parametrize("z", [-6, -1, 0, 0.5, 3, 12])
def test_chi_square_tail_against_exact_sums(df, z):
    x = max(df + z * math.sqrt(2 * df), 0.01)
    want = chi2_even(x, df)
    assert abs(chi2_sf(x, df) - want) < 1e-12 and math.isclose(chi2_sf(x, df), want, rel_tol=1e-9)


@pytest.mark.parametrize("df", [1e8, 1e10, 1e11, 1e12, 1e14])
@pytest.mark.parametrize("z", [0.0, 1.0, -2.0, 3.5])
def test_chi_square_tail_at_huge_degrees_of_freedom(df, z):
    x = df + math.floor(z * math.sqrt(2 * df))
    z = (x - df) / math.sqrt(2 * df)
    edge = math.exp(-z * z / 2) / math.sqrt(2 * math.pi) * (z * z - 1) / 3 / math.sqrt(df / 2)    # then terms in 1 / df
    assert abs(chi2_sf(x, df) - (0.5 * math.erfc(z / math.sqrt(2)) + edge)) < max(1e-10, 10 / df)


def test_odd_degrees_of_freedom_join_up():
    for x in (0.5, 3.0, 150.0, 260.0):      # the sum up to 200, the integral beyond, by the recurrence
        for df in (1, 3, 199, 201):
            step = math.exp(df / 2 * math.log(x / 2) - x / 2 - math.lgamma(df / 2 + 1))
            assert math.isclose(chi2_sf(x, df + 2), chi2_sf(x, df) + step, rel_tol=1e-10, abs_tol=1e-15)


def test_t_tail_in_closed_form():
    for t in (0.0, 0.3, 1.0, 4.0, 60.0):
        assert math.isclose(t_two_sided(t, 1), 1 - 2 / math.pi * math.atan(t), rel_tol=1e-10)
        assert math.isclose(t_two_sided(t, 2), 1 - t / math.sqrt(2 + t * t), rel_tol=1e-10, abs_tol=1e-14)
    assert math.isclose(t_two_sided(1.5, 400), t_two_sided(1.5, 400.0001), rel_tol=1e-6)


# ----------------------------------------------------------------- models

def test_tail_sums_equal_direct_sums():
    y, m = np.array([0, 1, 3, 3, 700, 90_000]), np.array([5, 2, 1, 2, 1, 3.0])
    for theta in (0.3, 7.0, 4000.0):
        one, two = models.TailCounts(y, m).sums(theta)
        k = [np.arange(v) for v in y.tolist()]
        assert math.isclose(one, sum(w * (1 / (theta + i)).sum() for w, i in zip(m, k)), rel_tol=1e-11)
        assert math.isclose(two, sum(w * (1 / (theta + i) ** 2).sum() for w, i in zip(m, k)), rel_tol=1e-11)
    assert models.TailCounts(np.zeros(4), np.ones(4)).sums(2.0) == (0.0, 0.0)


@pytest.fixture(scope="module")
def counts(spark):
    rng = np.random.default_rng(11)
    rows = []
    for _ in range(600):
        period, x = ("Pre", "Post")[rng.integers(2)], round(float(rng.normal()), 1)
        mu = math.exp(0.4 * (period == "Post") + 0.3 * x)
        rows.append((period, x, int(rng.negative_binomial(1.5, 1.5 / (1.5 + mu))), int(rng.random() < mu / (1 + mu)), 0.1))
    df = spark.createDataFrame(rows, "period string, x double, c int, y int, off double")
    return models.design_matrix(df, {"period": ["Pre", "Post"]}, ["x"], ["c", "y", "off"])


@pytest.mark.parametrize("tail_rows", [models.TAIL_ROWS, 0])
def test_rounds_by_spark_equal_rounds_in_one_task(spark, counts, monkeypatch, tail_rows):
    monkeypatch.setattr(models, "TAIL_ROWS", tail_rows)
    terms = ["periodPost", "x"]
    for fit in (lambda k: models.fit_negative_binomial(counts, "c", terms, "off", in_task=k),
                lambda k: models.fit_logistic(counts, "y", terms, in_task=k)):
        one, spread = fit(10_000).toPandas(), fit(10).toPandas()
        assert (one["iterations"] == spread["iterations"]).all() and one["converged"].all()
        for c in ("estimate", "std_error", "ci_lower", "deviance", "theta", "theta_std_error"):
            assert np.allclose(one[c].astype(float), spread[c].astype(float), rtol=1e-7, equal_nan=True)


def test_theta_error_is_the_second_derivative(spark, counts):
    fit = models.fit_negative_binomial(counts, "c", ["periodPost", "x"], "off").collect()
    pdf = counts.toPandas()
    beta = np.array([r["estimate"] for r in fit])
    mu = np.exp(np.column_stack([np.ones(len(pdf)), pdf["periodPost"], pdf["x"]]) @ beta + pdf["off"])
    lg = np.vectorize(math.lgamma)

    def loglik(t):
        y = pdf["c"].to_numpy()
        return float((lg(y + t) - math.lgamma(t) + t * math.log(t) + y * np.log(mu) - (y + t) * np.log(t + mu)).sum())
    t, h = fit[0]["theta"], 1e-3
    bend = (loglik(t + h) - 2 * loglik(t) + loglik(t - h)) / h ** 2
    assert math.isclose(fit[0]["theta_std_error"], 1 / math.sqrt(-bend), rel_tol=1e-4)
    assert abs(loglik(t + h) - loglik(t - h)) / (2 * h) < 1e-4
    assert all(math.isclose(r["ci_upper"] - r["ci_lower"], 2 * 1.959963984540054 * r["std_error"]) for r in fit)


def test_a_row_is_left_out_of_the_models_whose_columns_it_lacks(spark):
    df = spark.createDataFrame([("Pre", 1, None), ("Post", None, 2)], "period string, y int, c int")
    for keep in (["y"], ["c"]):
        assert models.design_matrix(df, {"period": ["Pre", "Post"]}, [], keep).count() == 1


# ------------------------------------------------- dimensions, rows, tables

def test_both_label_sets(spark):
    rows = spark.createDataFrame([(c,) for c, *_ in CAUSE_VOCABULARY] + [("unheard of",), (None,)], "hosp_cause string")
    four = {r["hosp_cause"]: r for r in classify_causes(rows, taxonomy_table(spark), "four").collect()}
    six = {r["hosp_cause"]: r for r in classify_causes(rows, taxonomy_table(spark), "six").collect()}
    assert len(four) == len(six) == 40 and four["unheard of"]["label"] is None and six[None]["cause_group"] is None
    assert {c for c in four if four[c]["label"] != six[c]["label"]} == set(CHART_LABELS)
    assert {c for c in four if four[c]["cause_group"] != six[c]["cause_group"]} == {"Genitourinary Disorder", "Unknown"}


def test_a_large_dimension_is_not_broadcast(spark):
    df = spark.range(100).select(F.col("id").alias("k"))
    dim = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plans = [join_dimension(df, dim, ["k"], most)._jdf.queryExecution().executedPlan().toString() for most in (50, 49)]
    assert "BroadcastHashJoin" in plans[0] and "BroadcastHashJoin" not in plans[1] and "SortMergeJoin" in plans[1]


def test_repeated_presence_rows_become_one(spark):
    demo = Q.demo(spark, SF)
    twice = demo.unionByName(demo).unionByName(demo.limit(7))
    assert twice.count() > demo.count() and S.subject_periods(twice).count() == S.subject_periods(demo).count()


def test_layout_follows_the_column_names(spark):
    wide = Q.wide(spark, SF)
    fewer = wide.drop(*[c for c in wide.columns if c.endswith("_9")])
    assert S.admission_long(fewer, Q.SPEC).agg(F.max("adm_number")).first()[0] < 9 or "hosp_start_9" not in fewer.columns
    assert S.period_long(wide.drop("karnofsky_p1"), Q.SPEC).where("period = 'Pre' AND karnofsky IS NOT NULL").count() == 0


def test_tables_follow_their_input_and_can_be_removed(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(3).write.parquet(path)
    make = lambda: spark.read.parquet(path)     # noqa: E731
    assert session.held_table(spark, "t", [path], make).count() == 3
    assert session.held_table(spark, "t", [path], lambda: 1 / 0).count() == 3       # held
    spark.range(5).write.mode("overwrite").parquet(path)
    assert session.held_table(spark, "t", [path], make).count() == 5
    folder = session.tables_folder(spark)
    session.clear_tables(spark)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    assert not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
