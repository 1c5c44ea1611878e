"""Hypothesis tests and effect sizes as Spark aggregations.

Each test computes its sufficient statistics with one distributed
aggregation (partial aggregation map-side, so a hot group costs one partial
row per task), forms the statistic with column arithmetic, and adds a p
value through the tails helper on the few aggregated rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortflow.functions.tails import chi2_p, fisher_p, norm_p, t_p
from cohortflow.operators.cohort import null_safe_join
from cohortflow.operators.ranks import midranks
from cohortflow.session import ship_code

Z_975 = 1.959963984540054


#: Cells of a 2x2 table by name, (row, column).
CELLS = {f"n_{r}{c}": (r, c) for r in (0, 1) for c in (0, 1)}


def paired_record(df: DataFrame, counts: dict[str, tuple[str, str]] | None = None,
                  flags: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """One row per measure with all that the paired tests need, from ONE aggregation of ``df``.

    ``counts`` name (post, pre) columns: complete pairs, both means, both variances, covariance, and
    mean and sd of the difference. ``flags`` name 0/1 (row, column) columns: the four cells.
    A measure may be in both; what it lacks is NULL. No row is copied per measure.
    """
    counts, flags = counts or {}, flags or {}
    aggs, rows, null_d, null_l = [], [], F.lit(None).cast("double"), F.lit(None).cast("long")
    moments = ("mean_post", "mean_pre", "var_post", "var_pre", "covariance", "mean_diff", "sd_diff")
    for i, m in enumerate(dict.fromkeys([*counts, *flags])):
        held = [F.lit(m).alias("measure")]
        if m in counts:
            post, pre = (F.col(c).cast("double") for c in counts[m])
            both = post.isNotNull() & pre.isNotNull()
            aggs += [F.count_if(both).alias(f"n{i}")]
            for name, e in zip(moments, (F.avg(F.when(both, post)), F.avg(F.when(both, pre)),
                                         F.var_samp(F.when(both, post)), F.var_samp(F.when(both, pre)),
                                         F.covar_samp(post, pre), F.avg(post - pre), F.stddev_samp(post - pre))):
                aggs.append(e.alias(f"{name}{i}"))
        held.append((F.col(f"n{i}") if m in counts else null_l).alias("n_pairs"))
        held += [(F.col(f"{name}{i}") if m in counts else null_d).alias(name) for name in moments]
        for name, (r, c) in CELLS.items():
            if m in flags:
                row, col = (F.col(x).cast("double") for x in flags[m])
                aggs.append(F.count_if((row == r) & (col == c)).alias(f"{name}{i}"))
            held.append((F.col(f"{name}{i}") if m in flags else null_l).alias(name))
        rows.append(F.struct(*held))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def t_from_record(record: DataFrame) -> DataFrame:
    """Paired t test of ``post - pre`` per measure (complete pairs only), two-sided."""
    t = F.when(F.col("sd_diff") > 0, F.col("mean_diff") / (F.col("sd_diff") / F.sqrt(F.col("n_pairs"))))
    g = record.where("n_pairs IS NOT NULL").select(
        "measure", "n_pairs", "mean_diff", "sd_diff", t.alias("statistic"),
        (F.col("n_pairs") - 1).cast("double").alias("df"))
    return g.withColumn("p_value", t_p(F.col("statistic"), F.col("df")))


def mcnemar_from_record(record: DataFrame) -> DataFrame:
    """McNemar with continuity correction per measure.

    Correction only when the off-diagonal cells differ; ``b = c`` gives 0 and
    ``b + c = 0`` gives a NULL statistic.
    """
    b, c = F.col("n_01"), F.col("n_10")
    stat = (F.when(b + c == 0, F.lit(None).cast("double"))
            .when(b == c, F.lit(0.0))
            .otherwise(F.pow(F.abs(b - c) - 1, 2) / (b + c)))
    g = record.where("n_00 IS NOT NULL").select("measure", *CELLS, stat.alias("statistic"), F.lit(1.0).alias("df"))
    return g.withColumn("p_value", chi2_p(F.col("statistic"), F.col("df")))


def contingency_from_record(record: DataFrame) -> DataFrame:
    """The four cells as rows (measure, row_level, col_level, n); absent cells count 0."""
    cells = [F.struct(F.lit(r).alias("row_level"), F.lit(c).alias("col_level"), F.col(name).alias("n"))
             for name, (r, c) in CELLS.items()]
    return record.where("n_00 IS NOT NULL").select("measure", F.inline(F.array(*cells)))


def d_from_record(record: DataFrame, within: bool = True) -> DataFrame:
    """Paired Cohen's d per measure with a magnitude label and a normal CI.

    ``within``: d = mean(diff) / (sd(diff) / sqrt(2 (1 - r))), r the
    correlation of the pair; otherwise d = mean(diff) / sd(diff). CI from
    the matched-groups variance (1/n + d^2 / (2n)) * 2 (1 - r) (within) or
    1/n + d^2 / (2n) (otherwise).
    """
    spread = F.sqrt(F.col("var_post") * F.col("var_pre"))
    g = record.where("n_pairs IS NOT NULL").withColumn("r", F.when(spread > 0, F.col("covariance") / spread))
    n, m, s, r = F.col("n_pairs"), F.col("mean_diff"), F.col("sd_diff"), F.col("r")
    if within:
        est = m / (s / F.sqrt(2 * (1 - r)))
        var = (1 / n + F.col("d") * F.col("d") / (2 * n)) * 2 * (1 - r)
    else:
        est = m / s
        var = 1 / n + F.col("d") * F.col("d") / (2 * n)
    g = g.withColumn("d", F.when(s > 0, est))
    ad = F.abs(F.col("d"))
    mag = (F.when(ad < 0.2, "negligible").when(ad < 0.5, "small").when(ad < 0.8, "medium")
           .when(ad >= 0.8, "large"))
    return g.withColumn("magnitude", mag).withColumn("se", F.sqrt(var)).select(
        "measure", "n_pairs", "mean_diff", "sd_diff", "r", "d", "magnitude",
        (F.col("d") - Z_975 * F.col("se")).alias("ci_lower"),
        (F.col("d") + Z_975 * F.col("se")).alias("ci_upper"))


def paired_tests(record: DataFrame) -> DataFrame:
    """The paired t test, Cohen's d and McNemar's test of every measure of a record, a row per measure."""
    t = t_from_record(record).select("measure", F.col("statistic").alias("t"), F.col("df").alias("t_df"),
                                     F.col("p_value").alias("t_p_value"))
    d = d_from_record(record).select("measure", "r", "d", "magnitude", "ci_lower", "ci_upper")
    m = mcnemar_from_record(record).select("measure", F.col("statistic").alias("mcnemar"),
                                           F.col("p_value").alias("mcnemar_p_value"))
    base = record.select("measure", "n_pairs", "mean_post", "mean_pre", "mean_diff", "sd_diff", *CELLS)
    return base.join(t, "measure", "left").join(d, "measure", "left").join(m, "measure", "left")


def paired_t(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    return t_from_record(paired_record(df, counts=pairs))


def contingency(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    return contingency_from_record(paired_record(df, flags=pairs))


def mcnemar(table: DataFrame) -> DataFrame:
    """``mcnemar_from_record`` of counts in rows (measure, row_level, col_level, n)."""
    here = lambda r, c: (F.col("row_level") == r) & (F.col("col_level") == c)     # noqa: E731
    return mcnemar_from_record(table.groupBy("measure").agg(*[
        F.sum(F.when(here(r, c), F.col("n")).otherwise(0)).alias(name) for name, (r, c) in CELLS.items()]))


def cohen_d_paired(df: DataFrame, pairs: dict[str, tuple[str, str]], within: bool = True) -> DataFrame:
    return d_from_record(paired_record(df, counts=pairs), within)


# ------------------------------------------------------------- two-way tables

def cell_counts(df: DataFrame, keys: list[str], row: str, col: str) -> DataFrame:
    """Observed (row, col) counts per key; rows with a missing value are dropped."""
    return (df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
            .groupBy(*keys, F.col(row).cast("string").alias("row_level"),
                     F.col(col).cast("string").alias("col_level"))
            .agg(F.count(F.lit(1)).alias("n")))


def chi_square(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Pearson chi-square (no correction) per key from observed cell counts.

    Margins are aggregated and joined back on (keys, level), so a variable
    with many levels is spread over tasks. Uses N sum(O^2 / (R C)) - N over
    the non-empty cells only, so empty cells never have to be materialised;
    df = (rows - 1)(cols - 1) over non-empty margins. Also reports the
    smallest expected count.
    """
    if not keys:
        raise ValueError("chi_square needs at least one key column")
    rows = counts.groupBy(*keys, "row_level").agg(F.sum("n").alias("r_tot"))
    cols = counts.groupBy(*keys, "col_level").agg(F.sum("n").alias("c_tot"))
    c = null_safe_join(counts, rows, [*keys, "row_level"], "inner")
    c = null_safe_join(c, cols, [*keys, "col_level"], "inner")
    n = F.col("n").cast("double")
    g = c.groupBy(*keys).agg(
        F.sum(n * n / (F.col("r_tot").cast("double") * F.col("c_tot"))).alias("__s"), F.sum("n").alias("n_total"),
        F.count_distinct("row_level").alias("n_rows"), F.count_distinct("col_level").alias("n_cols"),
        F.min("r_tot").alias("r_min"), F.min("c_tot").alias("c_min"))
    stat = F.col("n_total") * F.col("__s") - F.col("n_total")
    dfree = ((F.col("n_rows") - 1) * (F.col("n_cols") - 1)).cast("double")
    g = g.select(*keys, "n_total", "n_rows", "n_cols",
                 (F.col("r_min").cast("double") * F.col("c_min") / F.col("n_total")).alias("min_expected"),
                 F.when(dfree > 0, stat).alias("statistic"), F.when(dfree > 0, dfree).alias("df"))
    return g.withColumn("p_value", chi2_p(F.col("statistic"), F.col("df")))


def fisher_2x2(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Two-sided Fisher exact test per key for 2x2 tables (levels in sorted order)."""
    levels = counts.groupBy(*keys).agg(
        F.min("row_level").alias("__r0"), F.min("col_level").alias("__c0"),
        F.count_distinct("row_level").alias("__nr"), F.count_distinct("col_level").alias("__nc"))
    j = null_safe_join(counts, levels.where("__nr = 2 and __nc = 2"), keys, "inner")
    first_r = F.col("row_level") == F.col("__r0")
    first_c = F.col("col_level") == F.col("__c0")

    def cell(rc, cc, name):
        return F.sum(F.when(rc & cc, F.col("n")).otherwise(0)).alias(name)
    g = j.groupBy(*keys).agg(cell(first_r, first_c, "a"), cell(first_r, ~first_c, "b"),
                             cell(~first_r, first_c, "c"), cell(~first_r, ~first_c, "d"))
    return g.withColumn("p_value", fisher_p(F.col("a"), F.col("b"), F.col("c"), F.col("d")))


# --------------------------------------------------------------- rank tests

def rank_statistics(df: DataFrame, keys: list[str], value: str, group: str,
                    first_level: str | None = None, weight: str | None = None) -> DataFrame:
    """Per key: groups ``k``, size ``n_total``, tie term, first-group rank sum and
    size, and sum of R_g^2 / n_g -- everything both rank tests need, from one
    midrank pass over the value histogram.
    """
    return ranked_groups(midranks(df, keys, value, group, weight), keys, group, first_level)


def ranked_groups(mr: DataFrame, keys: list[str], group: str, first_level: str | None = None) -> DataFrame:
    """``rank_statistics`` from rows (keys, group, n, t, midrank)."""
    # Each value's tie term t^3 - t is spread over its groups in proportion
    # n / t, so summing per group and then per key needs no second grouping.
    per_g = mr.groupBy(*keys, group).agg(
        F.sum(F.col("n") * F.col("midrank")).alias("R"), F.sum("n").alias("ng"),
        F.sum((F.pow(F.col("t"), 3) - F.col("t")) * F.col("n") / F.col("t")).alias("tie_part"))
    if first_level is None:
        r1, n1 = F.min_by("R", group), F.min_by("ng", group)
    else:
        r1 = F.max(F.when(F.col(group) == F.lit(first_level), F.col("R")))
        n1 = F.max(F.when(F.col(group) == F.lit(first_level), F.col("ng")))
    return per_g.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("k"), F.sum("ng").alias("n_total"), r1.alias("R1"), n1.alias("n1"),
        F.sum(F.col("R") * F.col("R") / F.col("ng")).alias("r2_over_n"),
        F.round(F.sum("tie_part")).alias("ties"))


def _keyed(fn, df, keys, *args):
    if keys:
        return fn(df, keys, *args)
    return fn(df.withColumn("__all", F.lit(1)), ["__all"], *args).drop("__all")


def rank_sum(df: DataFrame, keys: list[str], value: str, group: str, first_level: str | None = None) -> DataFrame:
    """Wilcoxon rank-sum (normal approximation, continuity and tie corrections).

    ``W = R_1 - n_1 (n_1 + 1) / 2`` for the first group (``first_level`` or
    the smallest label). Keys with other than two groups give NULL.
    """
    if not keys:
        return _keyed(rank_sum, df, keys, value, group, first_level)
    g = rank_statistics(df, keys, value, group, first_level)
    n1, N = F.col("n1").cast("double"), F.col("n_total").cast("double")
    n2 = N - n1
    W = F.col("R1") - n1 * (n1 + 1) / 2
    mu = n1 * n2 / 2
    sigma = F.sqrt(n1 * n2 / 12 * ((N + 1) - F.col("ties") / (N * (N - 1))))
    z = (W - mu - 0.5 * F.signum(W - mu)) / sigma
    ok = F.col("k") == 2
    g = g.select(*keys, "n_total", "n1", F.when(ok, W).alias("statistic"),
                 F.when(ok & (sigma > 0), z).alias("z"))
    return g.withColumn("p_value", norm_p(F.col("z")))


def kruskal_wallis(df: DataFrame, keys: list[str], value: str, group: str) -> DataFrame:
    """Kruskal-Wallis H with tie correction; df = groups - 1."""
    if not keys:
        return _keyed(kruskal_wallis, df, keys, value, group)
    g = rank_statistics(df, keys, value, group)
    N = F.col("n_total").cast("double")
    h = (12 / (N * (N + 1)) * F.col("r2_over_n") - 3 * (N + 1)) / (1 - F.col("ties") / (N * N * N - N))
    g = g.select(*keys, "n_total", "k", F.when(F.col("k") > 1, h).alias("statistic"),
                 F.when(F.col("k") > 1, (F.col("k") - 1).cast("double")).alias("df"))
    return g.withColumn("p_value", chi2_p(F.col("statistic"), F.col("df")))


# ------------------------------------------------------------- Monte Carlo

ALMOST_ONE = 1 - 64 * 2.220446049250313e-16
CHUNK = 100                     # replicates drawn together


def _hypergeometric(rng, good, bad, draw):
    """Hypergeometric numbers for arrays of the three counts.

    Populations beyond numpy's limit are drawn by inversion: probabilities
    around the mode from the ratios of neighbours, 12 standard deviations far.
    """
    if max(good.max(initial=0), bad.max(initial=0)) < 10 ** 9:
        return rng.hypergeometric(good, bad, draw)
    out = np.empty(len(good), dtype=np.int64)
    for i, (g, b, d) in enumerate(zip(good.tolist(), bad.tolist(), draw.tolist())):
        total = g + b
        mode = (d + 1) * (g + 1) // (total + 2)
        spread = 12 * math.isqrt(d * g * b * (total - d) // max(total ** 2 * (total - 1), 1)) + 40
        low, high = max(0, d - b, mode - spread), min(g, d, mode + spread)
        k = np.arange(low, high, dtype=float)
        p = np.concatenate([[0.0], np.cumsum(np.log((g - k) * (d - k) / ((k + 1) * (b - d + k + 1))))])
        p = np.cumsum(np.exp(p - p.max()))
        out[i] = low + min(int(np.searchsorted(p, rng.random() * p[-1], side="right")), len(p) - 1)
    return out


def _random_tables(rng, row_tot, col_tot):
    """Uniform random tables with these margins, one per line of ``col_tot``, cell after cell."""
    left = np.array(col_tot, dtype=np.int64)
    out = np.zeros((len(left), len(row_tot), left.shape[1]), dtype=np.int64)
    for i, r in enumerate(row_tot):
        need, rest = np.full(len(left), r, dtype=np.int64), left.sum(axis=1)
        for j in range(left.shape[1] - 1):
            rest = rest - left[:, j]
            out[:, i, j] = _hypergeometric(rng, left[:, j], rest, need)
            need = need - out[:, i, j]
        out[:, i, -1] = need
        left -= out[:, i]
    return out


def _table_statistics(tables, row_tot, col_tot):
    """Per table (of a block of rows): its parts of chi-square and of -sum log n!."""
    row_tot, col_tot = np.asarray(row_tot, dtype=float), np.asarray(col_tot, dtype=float)
    e = row_tot[:, None] * col_tot[None, :] / col_tot.sum()
    values, at = np.unique(tables, return_inverse=True)
    logs = np.array([math.lgamma(v + 1) for v in values.tolist()])[at.reshape(tables.shape)]
    return ((tables - e) ** 2 / e).sum(axis=(1, 2)), -logs.sum(axis=(1, 2))


def _monte_carlo_whole(counts: DataFrame, keys: list[str], replicates: int, seed: int) -> DataFrame:
    """``monte_carlo_independence`` of tables whose cells fit a row; each chunk of replicates is a row of its own."""
    chunks = -(-replicates // CHUNK)
    whole = (counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("row_level", "col_level", "n"))).alias("cells"))
             .select(*keys, F.xxhash64(*keys).alias("mc_key"), F.col("cells.row_level").alias("r"),
                     F.col("cells.col_level").alias("c"), F.col("cells.n").alias("n"),
                     F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
             .repartition(min(chunks, 64), "mc_key", "chunk"))
    long, double = T.LongType(), T.DoubleType()
    schema = T.StructType([*[counts.schema[k] for k in keys], *[T.StructField(n, long) for n in ("size", "over", "under")],
                           *[T.StructField(n, double) for n in ("chisq", "fisher")]])

    def simulate(it):
        for pdf in it:
            out = []
            for rec in pdf.to_dict("records"):
                _, i = np.unique(np.asarray(rec["r"], dtype=object).astype(str), return_inverse=True)
                _, j = np.unique(np.asarray(rec["c"], dtype=object).astype(str), return_inverse=True)
                seen = np.zeros((i.max() + 1, j.max() + 1), dtype=np.int64)
                np.add.at(seen, (i, j), np.asarray(rec["n"], dtype=np.int64))
                row_tot, col_tot = seen.sum(axis=1), seen.sum(axis=0)
                size = min(CHUNK, replicates - CHUNK * rec["chunk"])
                rng = np.random.default_rng([seed, int(rec["mc_key"]) & 0x7FFFFFFFFFFFFFFF, int(rec["chunk"])])
                drawn = _random_tables(rng, row_tot, np.tile(col_tot, (size, 1)))
                chisq, fisher = _table_statistics(np.concatenate([seen[None], drawn]), row_tot, col_tot)
                out.append([*[rec[k] for k in keys], size, int((chisq[1:] >= chisq[0] * ALMOST_ONE).sum()),
                            int((fisher[1:] <= fisher[0] * ALMOST_ONE).sum()), chisq[0], fisher[0]])
            yield pd.DataFrame(out, columns=schema.fieldNames())

    g = whole.mapInPandas(simulate, schema).groupBy(*keys).agg(
        F.sum("size").alias("replicates"), F.sum("over").alias("__hc"), F.sum("under").alias("__hf"),
        F.first("chisq").alias("chisq_statistic"), F.first("fisher").alias("fisher_statistic"))
    return _simulated(g, keys)


def _simulated(g: DataFrame, keys: list[str]) -> DataFrame:
    return g.select(*keys, "replicates", "chisq_statistic",
                    ((F.col("__hc") + 1) / (F.col("replicates") + 1)).alias("chisq_p_value"),
                    "fisher_statistic",
                    ((F.col("__hf") + 1) / (F.col("replicates") + 1)).alias("fisher_p_value"))


def monte_carlo_independence(counts: DataFrame, keys: list[str], replicates: int = 2000,
                             seed: int = 20240101, block_levels: int = 1000) -> DataFrame:
    """Monte-Carlo p for independence in r x c tables, margins fixed.

    ``counts``: one row per cell of each key. A table's row levels are dealt
    to blocks of about ``block_levels``. A replicate first draws how the
    column totals fall to the blocks (a random table of block by column), then
    every block draws its own rows, so no task holds more of a table than a
    block, or one number per block. Only the column levels, the groups that
    are compared, stay together. ``CHUNK`` replicates are drawn at a time,
    from a generator seeded by (seed, key hash, chunk, block): the result
    does not depend on partitioning.

    Both statistics come from the same draws: Pearson chi-square (larger is
    more extreme) and the Fisher table probability, -sum log n! (smaller is
    more extreme). Ties count, within rounding; the second statistic is
    negative, so its bound is widened by the same factor below one. If no table has
    more than ``block_levels`` row levels, a chunk draws its table in one go.
    """
    if not keys:
        return _keyed(monte_carlo_independence, counts, keys, replicates, seed, block_levels)
    ship_code(counts.sparkSession)
    most = counts.groupBy(*keys).agg(F.count_distinct("row_level").alias("k")).agg(F.max("k")).first()[0] or 0
    if most <= block_levels:
        return _monte_carlo_whole(counts, keys, replicates, seed)
    rows = counts.groupBy(*keys, "row_level").agg(
        F.sum("n").alias("r_tot"), F.map_from_entries(F.collect_list(F.struct("col_level", "n"))).alias("by_col"))
    cols = (counts.groupBy(*keys, "col_level").agg(F.sum("n").alias("c_tot"))
            .groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("col_level", "c_tot"))).alias("cols")))
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block_levels).alias("blocks"))
    tables = null_safe_join(cols, sizes, keys, "inner")
    cells = F.transform("cols.col_level", lambda c: F.coalesce(F.try_element_at("by_col", c), F.lit(0)).cast("long"))
    placed = null_safe_join(rows, tables, keys, "inner").select(
        *keys, F.pmod(F.xxhash64("row_level"), "blocks").alias("block"), F.col("cols.c_tot").alias("c_tot"),
        F.struct("row_level", "r_tot", cells.alias("cells")).alias("row"))
    blocks = placed.groupBy(*keys, "block").agg(
        F.first("c_tot").alias("c_tot"), F.sum("row.r_tot").alias("held"),
        F.array_sort(F.collect_list("row")).alias("rows"))
    chunks = -(-replicates // CHUNK)
    top = (blocks.groupBy(*keys).agg(F.first("c_tot").alias("c_tot"),
                                     F.array_sort(F.collect_list(F.struct("block", "held"))).alias("parts"))
           .select(*keys, "c_tot", F.col("parts.block").alias("block"), F.col("parts.held").alias("held"),
                   F.xxhash64(*keys).alias("mc_key"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
           .repartition(chunks, "chunk"))
    key_fields = [counts.schema[k] for k in keys]

    def generator(rec, *more):
        return np.random.default_rng([seed, int(rec["mc_key"]) & 0x7FFFFFFFFFFFFFFF, int(rec["chunk"]), *more])

    def split(it):
        for pdf in it:
            for rec in pdf.to_dict("records"):
                size = min(CHUNK, replicates - CHUNK * rec["chunk"])
                drawn = _random_tables(generator(rec), rec["held"], np.tile(rec["c_tot"], (size, 1)))
                yield pd.DataFrame([[*[rec[k] for k in keys], block, rec["mc_key"], rec["chunk"], drawn[:, i].ravel()]
                                    for i, block in enumerate(rec["block"])], columns=[f.name for f in split_schema])

    def simulate(it):
        for pdf in it:
            for rec in pdf.to_dict("records"):
                own = np.asarray(rec["own"]).reshape(-1, len(rec["c_tot"]))
                drawn = _random_tables(generator(rec, int(rec["block"]) + 1), rec["r_tot"], own)
                chisq, fisher = _table_statistics(drawn, rec["r_tot"], rec["c_tot"])
                out = pd.DataFrame({"rep": CHUNK * rec["chunk"] + np.arange(len(own)), "chisq": chisq, "fisher": fisher})
                for k in keys:
                    out[k] = rec[k]
                yield out[[f.name for f in part_schema]]

    def observe(it):
        for pdf in it:
            for rec in pdf.to_dict("records"):
                table = np.stack([np.asarray(c) for c in rec["cells"]])[None]
                chisq, fisher = _table_statistics(table, rec["r_tot"], rec["c_tot"])
                yield pd.DataFrame([[*[rec[k] for k in keys], -1, chisq[0], fisher[0]]],
                                   columns=[f.name for f in part_schema])

    long, double = T.LongType(), T.DoubleType()
    split_schema = T.StructType([*key_fields, T.StructField("block", long), T.StructField("mc_key", long),
                                 T.StructField("chunk", T.IntegerType()), T.StructField("own", T.ArrayType(long))])
    part_schema = T.StructType([*key_fields, T.StructField("rep", long), T.StructField("chisq", double),
                                T.StructField("fisher", double)])
    shown = blocks.select(*keys, "block", "c_tot", F.col("rows.r_tot").alias("r_tot"))
    dealt = (null_safe_join(top.mapInPandas(split, split_schema), shown, [*keys, "block"], "inner")
             .repartition(F.hash("mc_key", "block", "chunk")))
    sims = (dealt.mapInPandas(simulate, part_schema).groupBy(*keys, "rep")
            .agg(F.sum("chisq").alias("sim_chisq"), F.sum("fisher").alias("sim_fisher")))
    observed = (blocks.select(*keys, "c_tot", F.col("rows.r_tot").alias("r_tot"), F.col("rows.cells").alias("cells"))
                .mapInPandas(observe, part_schema).groupBy(*keys)
                .agg(F.sum("chisq").alias("chisq_statistic"), F.sum("fisher").alias("fisher_statistic")))
    g = null_safe_join(sims, observed, keys, "inner").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("replicates"), F.first("chisq_statistic").alias("chisq_statistic"),
        F.count_if(F.col("sim_chisq") >= F.col("chisq_statistic") * ALMOST_ONE).alias("__hc"),
        F.first("fisher_statistic").alias("fisher_statistic"),
        F.count_if(F.col("sim_fisher") <= F.col("fisher_statistic") * ALMOST_ONE).alias("__hf"))
    return _simulated(g, keys)
