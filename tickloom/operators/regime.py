"""Regime search: metrics of groups of returns, stability over time bins, splits and trees."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.pieces import quantiles, ranges

EPS = 1e-12
#: Gains that differ by no more are equal: sums depend on the order of rows in their last digits.
TIED = 1e-12


def mean(x: Column) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def sharpe(x: Column) -> Column:
    """Mean over deviation (one value: over epsilon)."""
    return mean(x) / (F.coalesce(F.stddev_samp(x), F.lit(0.0)) + EPS)


def sortino(x: Column, mode: str = "good") -> Column:
    """Mean over the root mean square of the losing (good) or winning (bad) tail."""
    tail = F.when(x < 0, x) if mode == "good" else F.when(x > 0, x)
    return mean(x) / (F.coalesce(F.sqrt(F.avg(tail * tail)), F.lit(0.0)) + EPS)


def edge(x: Column) -> Column:
    """Share of wins times the mean win, less the rest times the mean size of a loss."""
    p = F.avg((x > 0).cast("double"))
    return p * F.coalesce(F.avg(F.when(x > 0, x)), F.lit(0.0)) - (1 - p) * F.coalesce(F.avg(F.when(x < 0, -x)), F.lit(0.0))


def kelly(x: Column) -> Column:
    return mean(x) - 0.5 * F.coalesce(F.var_samp(x), F.lit(0.0))


METRICS = {"sharpe": sharpe, "sortino_good": sortino, "sortino_bad": lambda x: sortino(x, "bad"), "edge": edge, "kelly": kelly}


def metrics(rows: DataFrame, by: str, value: str = "ret") -> DataFrame:
    """All metrics by group, with n, mean and deviation."""
    x = F.col(value)
    return rows.groupBy(by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std"), *[m(x).alias(k) for k, m in METRICS.items()])


#: Ranges of the first order column that a group's rows are numbered in.
CHUNKS = 64


def _even_bin(at: Column, n: Column, bins: int) -> Column:
    """The bin, from 1, of row ``at`` (from 0) of ``n``: equal counts, the first bins larger by the remainder."""
    size, rest = F.floor(n / bins), n % bins
    large = rest * (size + 1)
    return (F.when(at < large, F.floor(at / (size + 1))).otherwise(rest + F.floor((at - large) / F.greatest(size, F.lit(1)))) + 1).cast("int")


def even_bins(rows: DataFrame, by: list[str], order: list[str], bins: int) -> DataFrame:
    """Rows with ``bin``: consecutive bins of equal counts, the first ones larger by the remainder.

    The same as a tile window, but numbered in ranges of the first order column, so that
    one large group is many tasks; only counts of ranges are added up.
    """
    first = order[0]
    cuts = rows.agg(F.percentile_approx(F.col(first).cast("double"), F.array(*[F.lit((i + 1) / CHUNKS) for i in range(CHUNKS - 1)])).alias("q")).first()["q"]
    chunk = F.size(F.filter(F.array(*[F.lit(float(x)) for x in sorted(set(cuts or []))]).cast("array<double>"), lambda x: x < F.col(first).cast("double")))
    own = rows.withColumn("_chunk", chunk)
    counts = own.groupBy(*by, "_chunk").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*by, "_chunk", before.alias("_before"), F.sum("_n").over(Window.partitionBy(*by)).alias("_all"))
    row = F.row_number().over(Window.partitionBy(*by, "_chunk").orderBy(*order)) + F.col("_before") - 1
    numbered = own.join(counts, [*by, "_chunk"]).withColumn("_row", row)
    return numbered.withColumn("bin", _even_bin(F.col("_row"), F.col("_all"), bins)).drop("_chunk", "_before", "_all", "_row")


def stability(rows: DataFrame, by: list[str], order: list[str], value: str = "ret", bins: int = 5, least: int = 3, gamma: float = 1.0, tau: float = 0.5, eps: float = 1e-9) -> DataFrame:
    """How evenly losses spread over consecutive bins of equal counts, times how many bins are filled.

    exp(-gamma * V / (f * (1 - f) + eps)) * (tau + filled) / (bins + 2 * tau): f is the
    weighted mean share of losses of the bins, V its weighted variance, weights are bin
    sizes, and a bin is filled with at least ``least`` rows.
    """
    dealt = even_bins(rows.select(*by, *[c for c in order if c not in by], value), by, order, bins).withColumnRenamed("bin", "_bin")
    each = dealt.groupBy(*by, "_bin").agg(F.count("*").alias("size"), F.avg((F.col(value) < 0).cast("double")).alias("f"))
    return _evenness(each, by, bins, least, gamma, tau, eps)


def _evenness(each: DataFrame, by: list[str], bins: int, least: int, gamma: float = 1.0, tau: float = 0.5, eps: float = 1e-9) -> DataFrame:
    """``stability`` from the size and the share of losses (f) of each bin."""
    sums = each.groupBy(*by).agg(
        F.sum("size").alias("n"), F.sum(F.col("size") * F.col("f")).alias("sf"), F.sum(F.col("size") * F.col("f") * F.col("f")).alias("sff"), F.count_if(F.col("size") >= least).alias("filled")
    )
    f = F.col("sf") / F.col("n")
    v = F.greatest(F.col("sff") / F.col("n") - f * f, F.lit(0.0))
    return sums.select(*by, "n", (F.exp(-gamma * v / (f * (1 - f) + eps)) * (tau + F.col("filled")) / (bins + 2 * tau)).alias("stability"))


def thresholds(rows: DataFrame, feature: str, most: int = 19) -> list[float]:
    """Distinct quantiles from 0.05 to 0.95 of the finite values of a feature."""
    levels = [0.05 + 0.9 * i / max(1, most - 1) for i in range(most)] if most > 1 else [0.05]
    return sorted(set(quantiles(rows, feature, levels)))


#: A feature with a threshold, or with the categories that go left.
Split = tuple[str, "float | tuple[str, ...]"]
#: A feature, a side ("<=" and ">", or "in" and "not in") and what it is compared with.
Clause = tuple[str, str, "float | tuple[str, ...]"]


def goes_left(split: Split) -> Column:
    """Whether a row goes left; a missing value goes right."""
    feature, at = split
    return F.coalesce(F.col(feature).isin(*at) if isinstance(at, tuple) else F.col(feature) <= at, F.lit(False))


def clauses(split: Split) -> tuple[Clause, Clause]:
    """The clauses of both sides of a split."""
    feature, at = split
    left, right = ("in", "not in") if isinstance(at, tuple) else ("<=", ">")
    return (feature, left, at), (feature, right, at)


@dataclass
class Node:
    """A node of a regime tree; leaves have no split."""

    node_id: int
    depth: int
    rule: list[Clause] = field(default_factory=list)
    split: Split | None = None
    gain: float = 0.0
    left: "Node | None" = None
    right: "Node | None" = None


def condition(rule: list[Clause]) -> Column:
    """A rule as a column; a missing value goes right."""
    out = F.lit(True)
    for feature, side, at in rule:
        left = goes_left((feature, at))
        out = out & (left if side in ("<=", "in") else ~left)
    return out


Metric = "str | Callable[[Column], Column]"


def performance(metric: Metric) -> Callable[[Column], Column]:
    """A metric by its name, or one given as an aggregate expression of a column."""
    return METRICS[metric] if isinstance(metric, str) else metric


def score_splits(rows: DataFrame, candidates: list[Split], order: list[str], value: str = "ret", metric: Metric = "sharpe", bins: int = 5, least: int = 3) -> DataFrame:
    """Score (metric times stability) and size of both sides of every candidate split.

    One pass for all candidates (a bounded list made from quantiles or categories): rows are dealt once,
    in ranges of the order, and a table of how many rows of each range go left gives every row its place on its
    side of each candidate. What meets the candidates is aggregated by candidate, side and bin before
    it is shuffled.
    """
    count = len(candidates)
    own = rows.select(*order, value, *[goes_left(c).cast("long").alias(f"_left{i}") for i, c in enumerate(candidates)]).withColumn("_range", ranges(rows, order[0]))
    tally = own.groupBy("_range").agg(F.count("*").alias("_n"), F.array(*[F.sum(f"_left{i}") for i in range(count)]).alias("_lefts"))
    # one row for each range
    earlier, whole = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    lefts = [F.col("_lefts")[i] for i in range(count)]
    before = lambda x: F.coalesce(F.sum(x).over(earlier), F.lit(0))
    offsets = tally.select("_range", before(F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias("_all"), F.array(*[before(x) for x in lefts]).alias("_before_left"), F.array(*[F.sum(x).over(whole) for x in lefts]).alias("_all_left"))
    upto = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = own.withColumns({"_row": F.row_number().over(Window.partitionBy("_range").orderBy(*order)), **{f"_upto{i}": F.sum(f"_left{i}").over(upto) for i in range(count)}}).join(offsets, "_range")

    listed = lambda name: F.array(*[F.col(f"{name}{i}") for i in range(count)]).alias(name)
    both = F.arrays_zip(listed("_left"), listed("_upto"), "_before_left", "_all_left")
    each = placed.select(value, "_row", "_before", "_all", F.posexplode(both).alias("cand", "c")).select(value, "_row", "_before", "_all", "cand", (F.col("c._left") == 1).alias("left"), (F.col("c._before_left") + F.col("c._upto")).alias("_passed"), F.col("c._all_left").alias("_all_left"))
    at = F.when(F.col("left"), F.col("_passed")).otherwise(F.col("_before") + F.col("_row") - F.col("_passed")) - 1
    each = each.withColumn("_bin", _even_bin(at, F.when(F.col("left"), F.col("_all_left")).otherwise(F.col("_all") - F.col("_all_left")), bins))
    binned = each.groupBy("cand", "left", "_bin").agg(F.count("*").alias("size"), F.avg((F.col(value) < 0).cast("double")).alias("f"))
    even = _evenness(binned, ["cand", "left"], bins, least)
    sides = rows.select(value, F.explode(F.array(*[F.struct(F.lit(i).alias("cand"), goes_left(c).alias("left")) for i, c in enumerate(candidates)])).alias("c")).select(value, "c.*")
    perf = sides.groupBy("cand", "left").agg(performance(metric)(F.col(value)).alias("perf"))
    return perf.join(even, ["cand", "left"]).select("cand", "left", "n", (F.col("perf") * F.col("stability")).alias("score"))


@dataclass(frozen=True)
class Search:
    """How splits are searched. Gain: parent's score less the smaller child's (mode bad), or
    the larger child's less the parent's (good); that child is the target."""

    metric: Metric = "sharpe"
    mode: str = "good"
    min_leaf: int = 20
    bins: int = 5
    most: int = 19
    delta_min: float = 0.0
    w_target_min: float = 0.0


def _gains(rows: DataFrame, candidates: list[Split], order: list[str], value: str, how: Search, parent: float) -> dict[int, float]:
    """Gain of each candidate that the limits allow."""
    scored: dict[int, list[tuple[float, int]]] = {}
    for r in score_splits(rows, candidates, order, value, how.metric, how.bins).collect():  # two rows per candidate
        scored.setdefault(r["cand"], []).append((r["score"], r["n"]))
    out = {}
    for cand, sides in scored.items():
        if len(sides) < 2 or min(n for _, n in sides) < how.min_leaf:
            continue
        score, n = min(sides) if how.mode == "bad" else max(sides)
        gain = parent - score if how.mode == "bad" else score - parent
        if gain >= how.delta_min and n / sum(k for _, k in sides) >= how.w_target_min or (how.delta_min <= 0 and how.w_target_min <= 0):
            out[cand] = gain
    return out


def _grown(rows: DataFrame, feature: str, order: list[str], value: str, how: Search, parent: float) -> tuple[Split, float] | None:
    """The subset of categories that grows by the best one while the gain grows: one job per step."""
    left = [r[0] for r in rows.where(F.col(feature).isNotNull()).select(F.col(feature).cast("string")).distinct().orderBy(feature).collect()]
    if len(left) < 2:
        return None
    subset: tuple[str, ...] = ()
    best: tuple[Split, float] | None = None
    while left:
        trials = [(feature, (*subset, c)) for c in left]
        gains = _gains(rows, trials, order, value, how, parent)
        step = None
        for i in sorted(gains):
            if gains[i] > (best[1] if best else -float("inf")) + TIED:
                best, step = (trials[i], gains[i]), i
        if step is None:
            break
        subset = trials[step][1]
        left.pop(step)
    return ((feature, tuple(sorted(best[0][1]))), best[1]) if best else None


def best_split(rows: DataFrame, features: list[str], order: list[str], value: str = "ret", metric: Metric = "sharpe", mode: str = "good", min_leaf: int = 20, bins: int = 5, categories: list[str] = (), delta_min: float = 0.0, w_target_min: float = 0.0, most: int = 19) -> tuple[Split, float] | None:
    """The split of the largest gain over the parent; of equal ones the first. None without gain.

    ``categories``: features whose values are grouped; thresholds are made for the others.
    ``delta_min``: least gain; ``w_target_min``: least share of rows in the target child.
    """
    # read for thresholds, ranges, counts and scores; what does not fit in memory goes to disk
    rows = rows.select(*dict.fromkeys([*features, *order, value])).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _best_split(rows, features, order, value, Search(metric, mode, min_leaf, bins, most, delta_min, w_target_min), categories)
    finally:
        rows.unpersist()


def _best_split(rows: DataFrame, features: list[str], order: list[str], value: str, how: Search, categories: list[str]) -> tuple[Split, float] | None:
    whole = rows.select(*order, value).withColumn("all", F.lit(1))
    score = whole.groupBy("all").agg(performance(how.metric)(F.col(value)).alias("perf")).join(stability(whole, ["all"], order, value, how.bins), "all").first()
    parent = score["perf"] * score["stability"]
    numeric = [(f, at) for f in features if f not in categories for at in thresholds(rows, f, how.most)]
    gains = _gains(rows, numeric, order, value, how, parent) if numeric else {}
    found: dict[str, tuple[Split, float]] = {}
    for i in sorted(gains):
        f = numeric[i][0]
        if f not in found or gains[i] > found[f][1] + TIED:
            found[f] = (numeric[i], gains[i])
    found |= {f: got for f in features if f in categories for got in [_grown(rows, f, order, value, how, parent)] if got}
    best = None
    for f in features:
        if f in found and found[f][1] > (best[1] + TIED if best else 0.0):
            best = found[f]
    return best


def fit_tree(rows: DataFrame, features: list[str], order: list[str], value: str = "ret", metric: Metric = "sharpe", mode: str = "good", max_depth: int = 2, min_leaf: int = 20, bins: int = 5, categories: list[str] = (), delta_min: float = 0.0, w_target_min: float = 0.0, most: int = 19) -> Node:
    """A tree of splits, numbered in pre-order. The driver holds rules, never rows."""
    count = 0

    def grow(node: Node) -> Node:
        nonlocal count
        count += 1
        own = rows.where(condition(node.rule))
        if node.depth >= max_depth or own.count() < 2 * min_leaf:
            return node
        found = _best_split(own, features, order, value, Search(metric, mode, min_leaf, bins, most, delta_min, w_target_min), categories)
        if found:
            node.split, node.gain = found
            left, right = clauses(node.split)
            node.left = grow(Node(count, node.depth + 1, [*node.rule, left]))
            node.right = grow(Node(count, node.depth + 1, [*node.rule, right]))
        return node

    # every split reads the rows again; what does not fit in memory goes to disk
    rows = rows.select(*dict.fromkeys([*features, *order, value])).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return grow(Node(0, 0))
    finally:
        rows.unpersist()


def leaves(node: Node) -> list[Node]:
    return [node] if node.split is None else leaves(node.left) + leaves(node.right)


def assign(rows: DataFrame, tree: Node) -> DataFrame:
    """Rows with the id of their leaf: the rules as one CASE expression."""
    found = leaves(tree)
    out = F.lit(found[-1].node_id)
    for leaf in found[:-1][::-1]:
        out = F.when(condition(leaf.rule), leaf.node_id).otherwise(out)
    return rows.withColumn("leaf_id", out)


def rule_text(rule: list[Clause]) -> str:
    show = lambda at: "{" + ", ".join(at) + "}" if isinstance(at, tuple) else f"{at:g}"
    return " AND ".join(f"{f} {side} {show(at)}" for f, side, at in rule) or "all"


def leaf_report(rows: DataFrame, tree: Node, value: str = "ret", order: list[str] | None = None, metric: Metric = "sharpe", mode: str = "good", bins: int = 5) -> DataFrame:
    """Metrics of each leaf with its depth, rule, score and stability (if ``order`` is given).

    Sorted by score, falling (good) or rising (bad), larger leaves first among equals.
    """
    found = {n.node_id: n for n in leaves(tree)}
    named = lambda f: F.create_map(*[F.lit(x) for i, n in found.items() for x in (i, f(n))])[F.col("leaf_id")]
    own = assign(rows, tree)
    out = metrics(own, "leaf_id", value).withColumns({"rule": named(lambda n: rule_text(n.rule)), "depth": named(lambda n: n.depth)})
    if order is None:
        return out
    perf = own.groupBy("leaf_id").agg(performance(metric)(F.col(value)).alias("perf_value"))
    even = stability(own, ["leaf_id"], order, value, bins).select("leaf_id", "stability")
    out = out.join(perf, "leaf_id").join(even, "leaf_id").withColumn("leaf_score", F.col("perf_value") * F.col("stability"))
    return out.orderBy(F.asc("leaf_score") if mode == "bad" else F.desc("leaf_score"), F.desc("n"))


def rules_json(report: DataFrame, tree: Node) -> DataFrame:
    """Each leaf of a report as a JSON document with the clauses of its rule: leaf_id, json."""
    found = {n.node_id: [{"feature": f, "op": side, "value": list(at) if isinstance(at, tuple) else at} for f, side, at in n.rule] for n in leaves(tree)}
    text = F.create_map(*[F.lit(x) for i, r in found.items() for x in (i, json.dumps(r))])[F.col("leaf_id")]
    rest = [c for c in report.columns if c not in ("rule", "leaf_id")]
    return report.select("leaf_id", F.to_json(F.struct("leaf_id", *rest, F.col("rule").alias("rule_text"), text.alias("rule_clauses"))).alias("json"))


def rules_text(report: DataFrame) -> DataFrame:
    """One line per leaf of a report with scores: leaf_id, line."""
    return report.select("leaf_id", F.format_string("[leaf %d | depth %d | n=%d] score=%.4g | perf=%.4g | stability=%.4g :: %s", "leaf_id", "depth", "n", "leaf_score", "perf_value", "stability", "rule").alias("line"))


def members(rows: DataFrame, tree: Node, ids: list[str]) -> DataFrame:
    """Leaf of each row by its id columns."""
    return assign(rows, tree).select(*ids, "leaf_id")


def walk(tree: Node) -> list[Node]:
    """All nodes in pre-order."""
    return [tree] if tree.split is None else [tree, *walk(tree.left), *walk(tree.right)]


def feature_importances(tree: Node, depth_weighted: bool = True, normalize: bool = True) -> dict[str, float]:
    """Gains by feature, falling; weighted by 1/(1 + depth), and scaled to sum to 1."""
    total: dict[str, float] = {}
    for n in walk(tree):
        if n.split:
            total[n.split[0]] = total.get(n.split[0], 0.0) + n.gain / (1 + n.depth if depth_weighted else 1)
    s = sum(total.values())
    return {k: v / s if normalize and s > 0 else v for k, v in sorted(total.items(), key=lambda x: -x[1])}


def split_counts(tree: Node) -> dict[str, int]:
    """How many splits use each feature, most first."""
    return dict(Counter(n.split[0] for n in walk(tree) if n.split).most_common())
