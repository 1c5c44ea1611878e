"""Mixing sources to target weights by hierarchical budgeting (DataFrame functions only).

A token budget flows down a tree of levels (domain, language, source). At
each node the children share the node's budget by weight; a child cannot take
more than its tokens times ``max_epochs``. What a child cannot take is shared
among its siblings by weight first; only when all siblings are full does the
shortage show one level up, because a node's own capacity is the sum of its
children's. Each leaf then takes its target as whole epochs plus a prefix of
one more epoch in that epoch's own seeded order. What the prefixes of a node's
leaves lack, because whole documents do not fit, buys the next document of some
of its leaves; the remainder goes to the node above, up to the root. So a leaf is
off its target by less than one document either way, and the whole mix, never
above its budget, lacks less than one of the documents left out next.

Sharing is closed form, without a loop: with children ordered by capacity per
weight, the level that fills them is the largest of
``(budget - capacity before) / weight from here on``; a child gets the
smaller of its capacity and level x weight, rounded down.

Scale: documents are reduced to (levels, tokens) with partial sums before the
only shuffles. The prefix of a leaf is found through 65,536 ranges of the
order key: totals of 256 wide ranges, then of the 256 ranges inside one of
them, locate the range where the prefix ends, and only that range's rows are
sorted, so no task sorts a whole leaf. The result is a
cut-off per leaf; documents are filtered against it row by row.

Defined results: a null level value is the branch ``(none)``; a null or empty
text has no tokens and comes with every whole epoch of its leaf; rows sharing
a doc_id fall on the same side of the cut; a leaf without tokens or with
weight 0 gives no rows; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.llm.common import materialize

WORD = r"[^\x20\x09-\x0D]+"
NO_VALUE = "(none)"
RANGE_BITS = 16
RANGE_SHIFT = 52 - RANGE_BITS       # of the 52-bit order keys


@dataclass(frozen=True)
class MixSpec:
    """Weights are by path, e.g. ``("web",)`` or ``("web", "en")``; others weigh 1."""
    levels: Sequence[str] = ("domain", "lang", "source")
    weights: Mapping[tuple, int] = field(default_factory=dict)
    budget_share: float = 0.5          # of all tokens
    max_epochs: int = 4
    seed: int = 42


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """52-bit position of a row in the seeded order of an epoch."""
    name = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"),
                       F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long")


def _weight(spec: MixSpec, depth: int) -> Column:
    known = {p: w for p, w in spec.weights.items() if len(p) == depth}
    out = F.lit(1)
    for path, w in sorted(known.items(), reverse=True):
        cond = F.lit(True)
        for level, value in zip(spec.levels, path):
            cond = cond & (F.col(level) == value)
        out = F.when(cond, F.lit(w)).otherwise(out)
    return out.cast("long")


def _share(children: DataFrame, parents: DataFrame, on: list[str], spec: MixSpec, depth: int) -> DataFrame:
    """Give each child its part of its parent's ``target``."""
    rows = (children.join(parents.select(*on, "target"), on).withColumn("weight", _weight(spec, depth))
            .withColumn("reach", F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight"))))
    order = Window.partitionBy(*on).orderBy(F.col("reach").asc_nulls_last(), F.col(spec.levels[depth - 1]))
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    fill = F.when(onward > 0, (F.col("target") - before) / onward)
    rows = rows.withColumn("fill", fill)
    level = F.max("fill").over(Window.partitionBy(*on))
    given = F.least(F.col("capacity"), F.floor(F.coalesce(level, F.lit(0.0)) * F.col("weight")))
    return (rows.withColumn("given", F.greatest(given, F.lit(0)).cast("long"))
            .select(*[c for c in children.columns], F.col("given").alias("target")))


def leaf_targets(leaves: DataFrame, spec: MixSpec) -> DataFrame:
    """``leaves``: levels, tokens. Adds ``target`` (tokens to take from the leaf)."""
    levels = list(spec.levels)
    leaves = leaves.withColumn("capacity", F.col("tokens") * spec.max_epochs)
    root = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(spec.budget_share))
                      .cast("long").alias("target")).withColumn("root", F.lit(0))
    parents, on = root, ["root"]
    for depth in range(1, len(levels) + 1):
        if depth < len(levels):
            nodes = leaves.groupBy(*levels[:depth]).agg(F.sum("capacity").alias("capacity"))
        else:
            nodes = leaves
        if depth == 1:
            nodes = nodes.withColumn("root", F.lit(0))
        parents = _share(nodes, parents, on, spec, depth)
        if depth == 1:
            parents = parents.drop("root")
        on = levels[:depth]
    return parents.drop("capacity")


def _end(parts: DataFrame, levels: list[str], part: str) -> DataFrame:
    """Per leaf, the part where the running tokens, from ``before`` on, pass ``rest``; ``before``: tokens ahead of it."""
    along = Window.partitionBy(*levels).orderBy(part)
    return (parts.withColumn("after", F.col("before") + F.sum("tokens").over(along))
            .filter(F.col("after") > F.col("rest"))
            .groupBy(*levels).agg(F.min(F.struct(part, (F.col("after") - F.col("tokens")).alias("before"))).alias("end"))
            .select(*levels, f"end.{part}", "end.before"))


def _cut(keyed: DataFrame, on: list[str]) -> DataFrame:
    """Per group ``on``: the last (key, id) up to which its tokens stay within ``rest``, and the next one.

    ``keyed``: on, rest, key (52 bits), id, n_tokens. ``short`` is what the
    prefix leaves of ``rest``, ``next_tokens`` (more than that) what the next (key, id) holds.
    """
    keyed = keyed.withColumn("range", F.shiftright("key", RANGE_SHIFT))
    # 256 wide ranges of a group first, then the 256 ranges of the one where the prefix ends
    wide = F.shiftright("range", RANGE_BITS // 2).alias("wide")
    ranges = keyed.groupBy(*on, "rest", wide, "range").agg(F.sum("n_tokens").alias("tokens"))
    sums = ranges.groupBy(*on, "rest", "wide").agg(F.sum("tokens").alias("tokens")).withColumn("before", F.lit(0))
    near = _end(sums, on, "wide")
    ends = _end(ranges.join(near, [*on, "wide"]), on, "range")
    # met on the range too: only rows of the cut's range gather by group
    along = Window.partitionBy(*on).orderBy("key", "id")
    here = F.struct("key", "id", "sum")
    return (keyed.join(ends, [*on, "range"])
            .withColumn("sum", F.col("before") + F.sum("n_tokens").over(along))
            .groupBy(*on, "rest", F.col("range").alias("cut_range"), "before")
            .agg(F.max(F.when(F.col("sum") <= F.col("rest"), here)).alias("last"),
                 F.min(F.when(F.col("sum") > F.col("rest"), here)).alias("next"))
            .withColumn("taken", F.coalesce("last.sum", "before"))
            .select(*on, "cut_range", F.col("last.key").alias("cut_key"), F.col("last.id").alias("cut_id"),
                    (F.col("rest") - F.col("taken")).alias("short"), F.col("next.key").alias("next_key"),
                    F.col("next.id").alias("next_id"), (F.col("next.sum") - F.col("taken")).alias("next_tokens")))


def _filled(cut: DataFrame, spec: MixSpec) -> DataFrame:
    """``cut`` with the next document added to the leaves that their node's shortage pays for.

    What the leaves of a node lack together buys next documents of its leaves,
    those first of which the leaf lacks the largest part; what is left goes to
    the node above. The root takes the smallest of the others last.
    """
    levels = list(spec.levels)
    name = F.conv(F.substring(F.md5(F.concat_ws("\x1f", *levels)), 1, 13), 16, 10).cast("long")
    wanted = 255 - F.floor(F.col("short") * 255 / F.col("next_tokens"))
    small = F.least(F.floor(F.sqrt(F.col("next_tokens"))), F.lit(255))
    now = cut.withColumns({"root": F.lit(0), "added": F.lit(False)})
    passes = [(levels[:d] or ["root"], wanted) for d in range(len(levels) - 1, -1, -1)] + [(["root"], small)]
    for on, first in passes:
        own = F.col("next_tokens") * F.col("added").cast("long")
        pools = now.groupBy(*on).agg((F.sum("short") - F.sum(own)).alias("rest"))
        # 8 bits of the rank, then a hash of the leaf: equal ranks spread over many ranges
        key = F.shiftleft(first.cast("long"), 44).bitwiseOR(F.shiftright(name, 8))
        open_ = (now.filter("not added").join(pools, on)
                 .select(*on, "rest", key.alias("key"), name.alias("id"), F.col("next_tokens").alias("n_tokens")))
        ends = _cut(open_, on).select(*on, F.col("cut_range").alias("r"), F.col("cut_key").alias("k"),
                                      F.col("cut_id").alias("i"))
        low = F.shiftright(key, RANGE_SHIFT)
        paid = (low < F.col("r")) | ((low == F.col("r")) & F.coalesce(
            (key < F.col("k")) | ((key == F.col("k")) & (name <= F.col("i"))), F.lit(False)))
        now = materialize(now.join(ends, on, "left").withColumn(
            "added", F.col("added") | F.coalesce(paid, F.lit(False))).select(*now.columns), "mix-fill")
    return now.withColumns({"cut_key": F.when(F.col("added"), F.col("next_key")).otherwise(F.col("cut_key")),
                            "cut_id": F.when(F.col("added"), F.col("next_id")).otherwise(F.col("cut_id"))})


def leaf_plan(light: DataFrame, spec: MixSpec) -> DataFrame:
    """Per leaf: whole epochs and the cut-off of the partial epoch.

    ``light``: levels, doc_id, n_tokens. A leaf ends before the first document that does
    not fit; what leaves lack is handed on (``_filled``).
    """
    levels = list(spec.levels)
    leaves = light.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"))
    plan = (leaf_targets(leaves, spec).filter((F.col("tokens") > 0) & (F.col("target") > 0))
            .withColumn("epochs", F.floor(F.col("target") / F.col("tokens")).cast("long"))
            .withColumn("rest", F.col("target") - F.col("epochs") * F.col("tokens")))
    plan = materialize(plan, "mix-plan")
    keyed = (_meet_plan(light, plan.filter("rest > 0").select(*levels, "epochs", "rest"), levels)
             .withColumn("key", order_key(spec.seed, F.col("epochs"), F.col("doc_id")))
             .withColumn("id", F.coalesce("doc_id", F.lit(-2 ** 63))))
    cut = _filled(materialize(_cut(keyed, levels), "mix-cut"), spec)
    return materialize(plan.select(*levels, "target", "epochs").join(
        cut.select(*levels, "cut_range", "cut_key", "cut_id"), levels, "left"), "mix-cuts")


#: A plan of at most this many leaves (about 100 bytes each) is broadcast; a larger one is met by a shuffle, whose hot
#: leaves adaptive execution splits, as the plan is read from files.
BROADCAST_LEAVES = 200_000


def _meet_plan(rows: DataFrame, plan: DataFrame, levels: list[str]) -> DataFrame:
    small = plan.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES
    return rows.join(F.broadcast(plan) if small else plan.hint("merge"), levels)


def take(rows: DataFrame, plan: DataFrame, spec: MixSpec) -> DataFrame:
    """Rows (levels, doc_id, ...) once per epoch in which the plan takes them."""
    levels = list(spec.levels)
    key = order_key(spec.seed, F.col("epochs"), F.col("doc_id"))
    low = F.shiftright(F.col("key"), RANGE_SHIFT)
    here = F.coalesce("doc_id", F.lit(-2 ** 63))
    partial = F.col("cut_range").isNotNull() & (
        (low < F.col("cut_range")) | ((low == F.col("cut_range")) & F.coalesce(
            (F.col("key") < F.col("cut_key")) | ((F.col("key") == F.col("cut_key")) & (here <= F.col("cut_id"))),
            F.lit(False))))
    return (_meet_plan(rows, plan, levels).withColumn("key", key)
            .withColumn("copies", F.col("epochs") + F.when(partial, 1).otherwise(0))
            .filter("copies > 0")
            .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
            .drop("key", "copies", "epochs", "target", "cut_range", "cut_key", "cut_id"))


def level_value(c: Column) -> Column:
    return F.coalesce(c, F.lit(NO_VALUE))


def mix(docs: DataFrame, spec: MixSpec, levels: Mapping[str, Column], doc_id: str = "doc_id",
        tokens: Column | None = None) -> DataFrame:
    """Chosen rows: doc_id, levels, n_tokens, epoch."""
    tokens = n_words(F.col("text")) if tokens is None else tokens
    light = docs.select(F.col(doc_id).alias("doc_id"),
                        *[level_value(c).alias(n) for n, c in levels.items()],
                        F.coalesce(tokens, F.lit(0)).cast("long").alias("n_tokens"))
    light = materialize(light, "mix-light")
    return take(light, leaf_plan(light, spec), spec)


def mix_documents(docs: DataFrame, spec: MixSpec, levels: Mapping[str, Column]) -> DataFrame:
    """``docs`` with its own columns, one row per chosen (row, epoch); texts are not shuffled."""
    light = docs.select("doc_id", *[level_value(c).alias(n) for n, c in levels.items()],
                        n_words(F.col("text")).alias("n_tokens"))
    plan = leaf_plan(materialize(light, "mix-light"), spec)
    rows = docs.select(F.struct("*").alias("own_row"), "doc_id",
                       *[level_value(c).alias(n) for n, c in levels.items()])
    return take(rows, plan, spec).select("own_row.*")


# ------------------------------------------------------------- the query's mix

#: ``documents`` has no domain column: the query takes four domains from the source number.
#: The budget is the default half of all tokens, a chosen size: the mix samples the corpus down by that half.
DOMAINS = ("web", "books", "code", "news")
CORPUS_SPEC = MixSpec(weights={
    ("web",): 4, ("books",): 3, ("code",): 2, ("news",): 1,
    ("web", "en"): 6, ("web", "de"): 2, ("books", "en"): 3, ("books", "fr"): 2,
    ("web", "en", "src0"): 2, ("books", "en", "src1"): 5})
#: The pipeline mixes to the size of what comes in.
PIPELINE_SPEC = replace(CORPUS_SPEC, budget_share=1.0)


def source_domain(source: Column) -> Column:
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]{1,9})$", 1)
    return F.when(number == "", F.lit("other")).otherwise(
        F.element_at(F.array(*map(F.lit, DOMAINS)),
                     (F.when(number == "", 0).otherwise(number).cast("long") % 4 + 1).cast("int")))


def corpus_levels() -> dict[str, Column]:
    return {"domain": source_domain(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}


def _oracle(spec: MixSpec) -> str:
    def weight(depth: int) -> str:
        whens = " ".join(
            "WHEN " + " AND ".join(f"{lv} = '{v}'" for lv, v in zip(spec.levels, path)) + f" THEN {w}"
            for path, w in spec.weights.items() if len(path) == depth)
        return f"CASE {whens} ELSE 1 END" if whens else "1"

    def share(name: str, children: str, parent: str, on: list[str], own: str, depth: int, cols: str) -> str:
        part = f"PARTITION BY {', '.join(on)}" if on else ""
        join = f"{parent} USING ({', '.join(on)})" if on else f"{parent} ON true"
        return f"""
{name}_r AS (SELECT c.*, p.target, {weight(depth)} AS weight FROM {children} c JOIN (SELECT {', '.join([*on, 'target'])} FROM {parent}) p
  {'USING (' + ', '.join(on) + ')' if on else 'ON true'}),
{name}_f AS (SELECT *, (target - coalesce(sum(capacity) OVER ({part} ORDER BY capacity / weight, {own}
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER ({part} ORDER BY capacity / weight, {own} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS fill
  FROM {name}_r),
{name} AS (SELECT {cols}, CAST(greatest(least(capacity, floor(max(fill) OVER ({part}) * weight)), 0) AS BIGINT) AS target
  FROM {name}_f)"""
    a, b, c = spec.levels
    # what leaves lack, handed on: to siblings, then by each ancestor, at last to the smallest next documents
    groups = [f"PARTITION BY {a}, {b}", f"PARTITION BY {a}", "", ""]

    def handed(k: int) -> str:
        on = groups[k - 1]
        first = ("least(CAST(floor(sqrt(next_tokens)) AS BIGINT), 255)" if k == len(groups)
                 else "255 - CAST(floor(short * 255 / next_tokens) AS BIGINT)")
        apart = f"{on}, added" if on else "PARTITION BY added"
        return f"""f{k} AS (SELECT * EXCLUDE (pool, upto) REPLACE (added OR upto <= pool AS added) FROM (
  SELECT *, sum(short - CASE WHEN added THEN next_tokens ELSE 0 END) OVER ({on}) AS pool,
    sum(next_tokens) OVER ({apart} ORDER BY {first} * 17592186044416 + name // 256, name) AS upto
  FROM f{k - 1}) q)"""

    passes = ",\n".join(handed(k) for k in range(1, len(groups) + 1))
    return f"""
WITH light AS (
  SELECT doc_id, CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) = '' THEN 'other'
      ELSE ['web', 'books', 'code', 'news'][CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS BIGINT) % 4 + 1] END AS domain,
    coalesce(lang, '{NO_VALUE}') AS lang, coalesce(source, '{NO_VALUE}') AS source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens
  FROM documents),
leaves AS (SELECT {a}, {b}, {c}, CAST(sum(n_tokens) AS BIGINT) AS tokens,
    CAST(sum(n_tokens) * {spec.max_epochs} AS BIGINT) AS capacity FROM light GROUP BY ALL),
root AS (SELECT CAST(floor(sum(tokens) * {spec.budget_share}) AS BIGINT) AS target FROM leaves),
n1 AS (SELECT {a}, CAST(sum(capacity) AS BIGINT) AS capacity FROM leaves GROUP BY ALL),
n2 AS (SELECT {a}, {b}, CAST(sum(capacity) AS BIGINT) AS capacity FROM leaves GROUP BY ALL),
{share('t1', 'n1', 'root', [], a, 1, a)},
{share('t2', 'n2', 't1', [a], b, 2, f'{a}, {b}')},
{share('t3', 'leaves', 't2', [a, b], c, 3, f'{a}, {b}, {c}, tokens')},
plan AS (SELECT *, target // tokens AS epochs, target % tokens AS rest FROM t3 WHERE tokens > 0 AND target > 0),
keyed AS (SELECT light.*, epochs, rest, CAST('0x' || substr(md5('{spec.seed}:' || epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS key
  FROM light JOIN plan USING ({a}, {b}, {c})),
run AS (SELECT *, sum(n_tokens) OVER (PARTITION BY {a}, {b}, {c} ORDER BY key, doc_id NULLS FIRST) AS upto FROM keyed),
cut AS (SELECT {a}, {b}, {c}, any_value(rest) AS rest, coalesce(max(upto) FILTER (upto <= rest), 0) AS taken,
    min(upto) FILTER (upto > rest) AS next_sum FROM run WHERE rest > 0 GROUP BY ALL),
f0 AS (SELECT {a}, {b}, {c}, next_sum, rest - taken AS short, next_sum - taken AS next_tokens, FALSE AS added,
    CAST('0x' || substr(md5({a} || chr(31) || {b} || chr(31) || {c}), 1, 13) AS BIGINT) AS name FROM cut),
{passes},
copies AS (SELECT run.*, epochs + CASE WHEN rest > 0 AND (upto <= rest OR (added AND upto = next_sum)) THEN 1 ELSE 0 END AS copies
  FROM run LEFT JOIN f{len(groups)} USING ({a}, {b}, {c}))
SELECT doc_id, {a}, {b}, {c}, n_tokens, unnest(range(copies)) AS epoch FROM copies
"""


ORACLE = _oracle(CORPUS_SPEC)
