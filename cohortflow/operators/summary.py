"""Summary tables as long DataFrames, one aggregation of the input for all variables and strata.

``cells`` counts the input once: rows per (stratum, variable, group, level or value),
written once. Everything else is read from that table and not from the input:
levels, denominators and missing counts by GROUPING SETS over it, quantiles, moments and
midranks from one order index, the contingency tests from its margins. The
stratum is part of every key and a NULL stratum is a stratum, so there is no loop over
variables or strata on the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortflow.operators.cohort import null_safe_join, null_safe_semi
from cohortflow.operators.ranks import distribution, order_index, with_midranks
from cohortflow.operators.reshape import stack_columns
from cohortflow.session import write_once
from cohortflow.spec import literal_map

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
QUARTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75}
STATISTICS = ("mean", "sd", "p25", "median", "p75")


def numeric_columns(df: DataFrame, variables) -> list[str]:
    return [f.name for f in df.schema.fields if f.name in variables and isinstance(f.dataType, NUMERIC)]


def cells(df: DataFrame, by: str, strata=(), numbers=(), texts=()) -> DataFrame:
    """Rows ``n`` per (strata, variable, group, level, value), from one scan of ``df``, written once.

    ``numbers`` are counted by ``value`` (double; NaN is missing), ``texts`` by ``level``; a
    variable may be both. A missing one has neither. Rows without a group are left out.
    """
    parts = []
    for v in dict.fromkeys([*numbers, *texts]):
        value = F.col(v).cast("double") if v in numbers else F.lit(None).cast("double")
        level = F.col(v).cast("string") if v in texts else F.lit(None).cast("string")
        known = ~F.isnan(value) if v in numbers else F.lit(True)
        parts.append(F.struct(F.lit(v).alias("variable"), F.when(known, level).alias("level"),
                              F.when(known, value).alias("value")))
    long = df.where(F.col(by).isNotNull()).select(*strata, by, F.inline(F.array(*parts)))
    return write_once(long.groupBy(*strata, "variable", by, "level", "value").agg(F.count(F.lit(1)).alias("n")), "cells")


def value_index(counted: DataFrame, by: str, strata, variables, keep: bool = False) -> DataFrame:
    """The order index of the numeric ``variables`` of ``cells``; ``keep`` writes it for several readers."""
    hist = counted.where(F.col("value").isNotNull() & F.col("variable").isin(list(variables))).select(
        *strata, "variable", by, "value", "n")
    return order_index(hist, [*strata, "variable"], "value", by, keep=keep)


def _continuous(counted: DataFrame, index: DataFrame, by: str, strata, variables, qtype: int) -> DataFrame:
    own = [*strata, "variable", by]
    known = F.col("value").isNotNull()
    rows = counted.where(F.col("variable").isin(list(variables))).groupBy(*own).agg(
        F.sum(F.when(known, F.col("n")).otherwise(0)).alias("n"),
        F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("n_missing"))
    found = distribution(index, own, "value", QUARTILES, qtype).drop("size")
    return null_safe_join(rows, found, own, "left").select(
        *strata, "variable", F.col(by).alias("grp"), "n", "n_missing", *STATISTICS)


def _categorical(counted: DataFrame, by: str, strata, variables, shown: dict[str, str],
                 declared: dict[str, list[str]]) -> DataFrame:
    keys = [*strata, "variable"]
    all_keys = [F.col(k) for k in keys]
    level, group = F.col("level"), F.col(by)
    known = F.when(level.isNotNull(), F.col("n")).otherwise(0)
    cube = write_once(
        counted.where(F.col("variable").isin(list(variables)))
        .groupingSets([[*all_keys, level, group], [*all_keys, group], [*all_keys, level]], *all_keys, level, group)
        .agg(F.sum("n").alias("rows"), F.sum(known).alias("known"), F.grouping("level").alias("over_levels"),
             F.grouping(by).alias("over_groups")), "cube")
    one_level = F.col("level").isNotNull() & (F.col("over_levels") == 0)
    counts = cube.where(one_level & (F.col("over_groups") == 0)).select(*keys, "level", by, F.col("rows").alias("n"))
    levels = cube.where(one_level & (F.col("over_groups") == 1)).select(*keys, "level")
    groups = cube.where("over_levels = 1 AND known > 0").select(
        *keys, by, F.col("known").alias("denom"), (F.col("rows") - F.col("known")).alias("n_missing"))
    if declared:
        listed = F.try_element_at(F.create_map(*[x for v, ls in declared.items() for x in (
            F.lit(v), F.array(*map(F.lit, ls)))]), F.col("variable"))
        levels = levels.unionByName(groups.select(*keys, F.explode(listed).alias("level"))).distinct()
    grid = null_safe_join(levels, groups, keys, "inner")
    out = null_safe_join(grid, counts, [*keys, "level", by], "left").select(
        *keys, "level", F.col(by).alias("grp"), F.coalesce(F.col("n"), F.lit(0)).alias("n"), "denom", "n_missing")
    out = out.withColumn("pct", F.col("n") / F.col("denom"))
    if shown:
        one = F.try_element_at(literal_map(shown), F.col("variable"))
        out = out.where(one.isNull() | (F.col("level") == one))
    return out


def summary_continuous(df: DataFrame, variables: list[str], by: str, strata=(),
                       qtype: int = 7) -> DataFrame:
    """Per (strata, variable, group): n, missing, mean, sd and exact quartiles.

    Rows with a missing group are dropped. Quartiles are exact (type 7 by
    default, type 2 on request) and computed without collecting any group.
    """
    counted = cells(df, by, strata, numbers=variables)
    return _continuous(counted, value_index(counted, by, strata, variables), by, strata, variables, qtype)


def summary_categorical(df: DataFrame, variables: list[str], by: str, strata=(),
                        dichotomous: dict[str, str] | None = None,
                        declared: dict[str, list[str]] | None = None) -> DataFrame:
    """Per (strata, variable, level, group): n, non-missing denominator, share.

    Every observed or ``declared`` level of a variable is shown in every group
    (0 when absent). ``dichotomous`` shows only the named level of those
    variables, observed or not.
    """
    shown = dichotomous or {}
    declared = {**(declared or {}), **{v: [level] for v, level in shown.items()}}
    variables = list(dict.fromkeys([*variables, *shown]))
    counted = cells(df, by, strata, texts=variables)
    return _categorical(counted, by, strata, variables, shown, declared).drop("n_missing")


def summary_missing(df: DataFrame, variables: list[str], by: str, strata=()) -> DataFrame:
    """Per (strata, variable, group): rows and rows with the variable missing."""
    keep = [*strata, by]
    long = stack_columns(df.where(F.col(by).isNotNull()), keep, {v: F.col(v) for v in variables},
                         "variable", "value", "string")
    return long.groupBy(*strata, "variable", F.col(by).alias("grp")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").isNull()).alias("n_missing"))


def _levels_up_to(column, most: int):
    """Distinct values of a column, told exactly as long as there are fewer than ``most``.

    The partial aggregate is a sketch of at most 4,096 hashes (or twice ``most``) and exact below that,
    so no row-sized set of values is built or shuffled, however many there are.
    """
    size = max(12, math.ceil(math.log2(max(most, 2))) + 1)
    return F.least(F.theta_sketch_estimate(F.theta_sketch_agg(column, size)), F.lit(most).cast("long"))


def summary_kind_profile(df: DataFrame, variables: list[str], max_levels: int = 10, every: bool = False) -> DataFrame:
    """Kind of each variable: numeric with >= ``max_levels`` distinct values is
    continuous, everything else categorical. ``n_distinct`` stops at ``max_levels``, the number
    that decides the kind; with ``every`` all distinct values are counted, in two levels."""
    numeric = set(numeric_columns(df, variables))
    plain = {f.name: isinstance(f.dataType, (*NUMERIC, T.StringType)) for f in df.schema.fields}
    own = lambda v: F.col(v) if plain[v] else F.col(v).cast("string")
    held = lambda v: F.col(v).cast("double") if v in numeric else own(v)
    counted = lambda v: F.count_distinct(own(v)) if every else _levels_up_to(held(v), max_levels)
    one = df.agg(*[x for i, v in enumerate(variables) for x in (
        counted(v).alias(f"d{i}"), F.count_if(F.col(v).isNull()).alias(f"m{i}"))])
    long = one.select(F.inline(F.array(*[F.struct(
        F.lit(v).alias("variable"), F.coalesce(F.col(f"d{i}"), F.lit(0)).alias("n_distinct"),
        F.col(f"m{i}").alias("n_missing"), F.lit(v in numeric).alias("is_numeric")) for i, v in enumerate(variables)])))
    many = F.col("is_numeric") & (F.col("n_distinct") >= max_levels)
    return long.withColumn("kind", F.when(many, "continuous").otherwise("categorical"))


def _parts(counted: DataFrame, index: DataFrame | None, by: str, strata, continuous, categorical, shown, declared,
           qtype: int) -> DataFrame:
    """Continuous and categorical parts in one long schema, with the missing count of each group."""
    parts, null_d, null_l = [], F.lit(None).cast("double"), F.lit(None).cast("long")
    if continuous:
        c = _continuous(counted, index, by, strata, continuous, qtype)
        parts.append(c.select(*strata, "variable", F.lit("continuous").alias("kind"),
                              F.lit(None).cast("string").alias("level"), "grp", "n", null_l.alias("denom"),
                              null_d.alias("pct"), *STATISTICS, "n_missing"))
    if categorical or shown:
        variables = list(dict.fromkeys([*categorical, *shown]))
        k = _categorical(counted, by, strata, variables, shown, declared)
        kind = F.when(F.col("variable").isin(list(shown) or [""]), "dichotomous").otherwise("categorical")
        parts.append(k.select(*strata, "variable", kind.alias("kind"), "level", "grp", "n", "denom", "pct",
                              *[null_d.alias(c) for c in STATISTICS], "n_missing"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def summary_table(df: DataFrame, by: str, strata=(), continuous=(), categorical=(),
                  dichotomous: dict[str, str] | None = None, qtype: int = 7) -> DataFrame:
    """Continuous and categorical parts in one long schema.

    Columns: strata, variable, kind, level, grp, n, denom, pct, mean, sd,
    p25, median, p75 (statistics not applicable to a row are NULL).
    """
    shown = dichotomous or {}
    counted = cells(df, by, strata, numbers=continuous, texts=[*categorical, *shown])
    index = value_index(counted, by, strata, continuous) if continuous else None
    declared = {v: [level] for v, level in shown.items()}
    return _parts(counted, index, by, strata, continuous, categorical, shown, declared, qtype).drop("n_missing")


def summary_tests(df: DataFrame, by: str, variables: list[str], strata=(),
                  simulate: tuple[str, ...] = (), max_levels: int = 10,
                  replicates: int = 2000, seed: int = 20240101,
                  first_level: str | None = None) -> DataFrame:
    """One test per (strata, variable) comparing the ``by`` groups.

    ``first_level`` names the group whose rank sum is W (default: smallest).
    Selection: continuous (numeric with >= ``max_levels`` distinct values) ->
    Wilcoxon rank-sum for two groups, Kruskal-Wallis for more; categorical ->
    Pearson chi-square when every expected count is >= 5, else Fisher exact
    (2x2) or simulated Fisher (larger tables). Variables in ``simulate`` take
    the Monte-Carlo p of the statistic their rule selects. The kind of a variable is
    judged on rows with a known group.
    """
    numeric = numeric_columns(df, variables)
    counted = cells(df, by, strata, numbers=numeric, texts=[v for v in variables if v not in numeric])
    many = _many_valued(counted, numeric, max_levels)
    index = value_index(counted, by, strata, many) if many else None
    return _tests(counted, index, many, by, strata, simulate, replicates, seed, first_level)


def _many_valued(counted: DataFrame, numeric: list[str], max_levels: int) -> list[str]:
    """The variables among ``numeric`` with at least ``max_levels`` values: a row per variable reaches the driver."""
    if not numeric:
        return []
    found = counted.where(F.col("variable").isin(numeric)).groupBy("variable").agg(
        _levels_up_to(F.col("value"), max_levels).alias("d"))
    return [r.variable for r in found.collect() if r.d is not None and r.d >= max_levels]


def _tests(counted: DataFrame, index: DataFrame | None, many: list[str], by: str, strata, simulate, replicates: int,
           seed: int, first_level: str | None) -> DataFrame:
    from cohortflow.functions.tails import chi2_p, norm_p
    from cohortflow.operators.stats import chi_square, fisher_2x2, monte_carlo_independence, ranked_groups

    keys = [*strata, "variable"]
    parts, null = [], F.lit(None).cast("double")
    if many:
        ranked = with_midranks(index.where(F.col("variable").isin(many)))
        rs = ranked_groups(ranked, keys, by, first_level)
        n1, N = F.col("n1").cast("double"), F.col("n_total").cast("double")
        W = F.col("R1") - n1 * (n1 + 1) / 2
        mu = n1 * (N - n1) / 2
        sigma = F.sqrt(n1 * (N - n1) / 12 * ((N + 1) - F.col("ties") / (N * (N - 1))))
        z = (W - mu - 0.5 * F.signum(W - mu)) / sigma
        H = (12 / (N * (N + 1)) * F.col("r2_over_n") - 3 * (N + 1)) / (1 - F.col("ties") / (N * N * N - N))
        two, more = F.col("k") == 2, F.col("k") > 2
        parts.append(rs.select(
            *keys, F.lit("continuous").alias("kind"), F.when(two, "wilcox.test").when(more, "kruskal.test").alias("test"),
            F.when(two, W).when(more, H).alias("statistic"),
            F.when(more, (F.col("k") - 1).cast("double")).alias("df"),
            F.when(two, norm_p(z)).when(more, chi2_p(H, (F.col("k") - 1))).alias("p_value")))
    row = F.coalesce("level", F.col("value").cast("string"))
    cats = counted.where(row.isNotNull() & ~F.col("variable").isin(many or [""])).select(
        *keys, row.alias("row_level"), F.col(by).cast("string").alias("col_level"), "n")
    chi = write_once(chi_square(cats, keys), "chi")
    small = F.col("min_expected") < 5
    is_2x2 = (F.col("n_rows") == 2) & (F.col("n_cols") == 2)
    sim_var = F.col("variable").isin(list(simulate) or [""])
    exact, simulated = small & is_2x2 & ~sim_var, (small & ~is_2x2) | sim_var
    n_exact, n_simulated, n_all = chi.agg(F.count_if(exact), F.count_if(simulated), F.count(F.lit(1))).first()
    j = chi.withColumns({c: null for c in ("p_exact", "chisq_p_value", "fisher_statistic", "fisher_p_value")})
    if n_exact:
        found = fisher_2x2(null_safe_semi(cats, chi.where(exact), keys), keys).select(
            *keys, F.col("p_value").alias("p_exact"))
        j = null_safe_join(j.drop("p_exact"), found, keys, "left")
    if n_simulated and replicates:
        found = monte_carlo_independence(null_safe_semi(cats, chi.where(simulated), keys), keys, replicates, seed)
        j = null_safe_join(j.drop("chisq_p_value", "fisher_statistic", "fisher_p_value"), found, keys, "left")
    if n_all:
        test = (F.when(sim_var & ~small, "chisq.test (simulated)").when(sim_var, "fisher.test (simulated)")
                .when(~small, "chisq.test.no.correct").when(is_2x2, "fisher.test")
                .otherwise("fisher.test (simulated)"))
        stat = F.when(~small, F.col("statistic")).when(~is_2x2 | sim_var, F.col("fisher_statistic"))
        pval = (F.when(sim_var & ~small, F.col("chisq_p_value")).when(sim_var, F.col("fisher_p_value"))
                .when(~small, F.col("p_value")).when(is_2x2, F.col("p_exact"))
                .otherwise(F.col("fisher_p_value")))
        parts.append(j.select(*keys, F.lit("categorical").alias("kind"), test.alias("test"), stat.alias("statistic"),
                              F.when(~small, F.col("df")).alias("df"), pval.alias("p_value")))
    if not parts:       # no variable has a value
        parts.append(chi.select(*keys, *[F.lit(None).cast("string").alias(c) for c in ("kind", "test")],
                                *[null.alias(c) for c in ("statistic", "df", "p_value")]))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def without_simulated(tests: DataFrame) -> DataFrame:
    """The columns of tests or described tables that involve no random draw: simulated p values are NULL."""
    drawn = F.col("test").contains("simulated")
    return tests.withColumn("p_value", F.when(~F.coalesce(drawn, F.lit(False)), F.col("p_value")))


def _one_decimal(x):
    """Text with one decimal; NULL stays NULL."""
    return F.round(x, 1).cast("decimal(20,1)").cast("string")


def described_table(df: DataFrame, by: str, strata=(), continuous=(), categorical=(),
                    dichotomous: dict[str, str] | None = None, declared: dict[str, list[str]] | None = None,
                    labels: dict[str, str] | None = None, text: dict[str, tuple[str, str]] | None = None,
                    simulate: tuple[str, ...] = (), replicates: int = 2000, seed: int = 20240101,
                    first_level: str | None = None, qtype: int = 7) -> DataFrame:
    """``summary_table`` with display columns and each variable's test, in one long schema.

    Adds ``label`` (``labels``, else the name), ``level_no`` (place among the
    ``declared`` levels, from 1; NULL for others), ``n_missing`` of the group,
    ``stat_label`` and the columns of ``summary_tests`` (equal on all rows of a
    stratum's variable). ``text`` gives a continuous variable's form,
    ``("mean", unit)`` for mean (+-sd) or ``("median", unit)`` for median [p25, p75], the default.
    All parts and tests are read from one table of ``cells``.
    """
    shown = dichotomous or {}
    declared = {**(declared or {}), **{v: [level] for v, level in shown.items()}}
    variables = list(dict.fromkeys([*continuous, *categorical, *shown]))
    numeric = numeric_columns(df, variables)
    counted = cells(df, by, strata, numbers=[*continuous, *numeric],
                    texts=[v for v in variables if v in (*categorical, *shown) or v not in numeric])
    many = _many_valued(counted, numeric, 10)
    index = value_index(counted, by, strata, {*many, *continuous}, True) if many or continuous else None
    keys = [*strata, "variable"]
    numbers = STATISTICS
    out = _parts(counted, index, by, strata, continuous, categorical, shown, declared, qtype)
    tests = _tests(counted, index, many, by, strata, simulate, replicates, seed, first_level).drop("kind")
    out = null_safe_join(out, tests, keys, "left")
    form = text or {}
    unit = F.try_element_at(literal_map({v: form.get(v, ("median", ""))[1] for v in variables}), F.col("variable"))
    as_mean = F.col("variable").isin([v for v, (f, _) in form.items() if f == "mean"] or [""])
    stat = (F.when(F.col("kind") != "continuous", F.concat(
                F.col("n").cast("string"), F.lit(" ("), _one_decimal(F.col("n") * 100.0 / F.col("denom")), F.lit("%)")))
            .when(as_mean, F.concat(_one_decimal(F.col("mean")), F.lit(" (±"), _one_decimal(F.col("sd")),
                                    F.lit(")"), unit))
            .otherwise(F.concat(_one_decimal(F.col("median")), F.lit(" ["), _one_decimal(F.col("p25")), F.lit(", "),
                                _one_decimal(F.col("p75")), F.lit("]"), unit)))
    place = F.lit(None).cast("int")
    for v, levels in declared.items():
        here = F.array_position(F.array(*map(F.lit, levels)), F.col("level")).cast("int")
        place = F.when((F.col("variable") == v) & (here > 0), here).otherwise(place)
    label = F.try_element_at(literal_map({v: (labels or {}).get(v, v) for v in variables}), F.col("variable"))
    return out.select(*keys, label.alias("label"), "kind", "level", place.alias("level_no"), "grp", "n", "denom",
                      "n_missing", "pct", *numbers, stat.alias("stat_label"), "test", "statistic", "df", "p_value")
