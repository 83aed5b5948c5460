"""Recurrences along a symbol whose rows are dealt to many tasks.

``recur``: y = a*y + b. Within a piece all prefixes of such maps are composed; a table with
one map per piece gives each piece the value it starts from, and y = A*start + B. So a
symbol's rows are never in one task, and nothing runs twice.

``handed_over``: any recurrence with a small state. P pieces of a symbol are about sqrt(P)
blocks of as many pieces. All blocks run from rest at once; those whose predecessor leaves
another state than they were run with run again. Filters and bars that reset forget the
state they began with, the sooner within a longer block, so few rounds remain. While due
blocks halve, all run at once; else only the first of each symbol does. So work stays linear
and rounds are at most about 2 * sqrt(P), even where a state is never forgotten. Where the state
that a block leaves is a step function of the state before it, the steps of all blocks are made at
once and give the states that the first round begins with.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, NumericType, StructField, StructType

from tickloom.functions.pieces import ROWS, piece, written

_KINDS = {"double": DoubleType(), "long": LongType(), "boolean": BooleanType()}


def prefixes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the map from the value before the first row to the value there, by blocks side by side."""
    n = len(a)
    if not n:
        return np.zeros(0), np.zeros(0)
    wide = max(1, int(np.sqrt(n)))
    deep = -(-n // wide)
    x, y = np.ones(deep * wide), np.zeros(deep * wide)
    x[:n], y[:n] = a, b
    x, y = x.reshape(deep, wide), y.reshape(deep, wide)
    for j in range(1, wide):
        y[:, j] += x[:, j] * y[:, j - 1]
        x[:, j] *= x[:, j - 1]
    for i in range(1, deep):
        y[i] += x[i] * y[i - 1, -1]
        x[i] *= x[i - 1, -1]
    return x.ravel()[:n], y.ravel()[:n]


class Affine:
    """y = a*y + b from ``start`` on; ``coefs`` gives a and b from a column's values and their number
    since its first value (negative before, where nothing changes). Null before number ``shown``."""

    def __init__(self, coefs: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], start: float = 0.0, shown: int = 0) -> None:
        self.coefs, self.start, self.shown = coefs, start, shown

    def local(self, x: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Prefix maps of a piece, the row from which they hold, and rows after the last value."""
        a, b = self.coefs(x, i)
        a, b = np.where(i < 0, 1.0, a), np.where(i < 0, 0.0, b)
        return *prefixes(a, b), 0, 0

    def entered(self, y: float, gap: int, lead: int, x: float) -> float:
        """The value that the maps of a piece start from."""
        return y


class Ewm:
    """e0 = x0, e = alpha*x + (1-alpha)*e; nulls before the first value stay, inner ones decay the weights."""

    start, shown = None, 0

    def __init__(self, alpha: float) -> None:
        self.alpha = alpha

    def _weight(self, rows: np.ndarray | int) -> np.ndarray:
        old = (1 - self.alpha) ** rows
        return old / (old + self.alpha), self.alpha / (old + self.alpha)

    def local(self, x: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
        good = np.flatnonzero(~np.isnan(x))
        a, b = np.ones(len(x)), np.zeros(len(x))
        if not len(good):
            return a, b, len(x), 0
        old, new = self._weight(np.diff(good))
        a[good[1:]], b[good[1:]] = old, new * x[good[1:]]
        return *prefixes(a, b), int(good[0]), int(len(x) - 1 - good[-1])

    def entered(self, y: float | None, gap: int, lead: int, x: float) -> float:
        if y is None:
            return x
        old, new = self._weight(gap + lead + 1)
        return old * y + new * x


def wilder(n: int) -> Affine:
    """Mean of the first n values, then (prev*(n-1) + x)/n."""
    return Affine(lambda x, i: (np.where(i < n - 1, 1.0, np.where(i == n - 1, 1 / n, (n - 1) / n)), np.where(i < n - 1, x, x / n)), shown=n - 1)


def seeded(n: int, at: int | None = None) -> Affine:
    """Exponential mean (alpha 2/(n+1)) from the mean of the n values up to number ``at`` (n - 1) on."""
    at, alpha = n - 1 if at is None else at, 2 / (n + 1)

    def coefs(x: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = np.where(i < at, 1.0, np.where(i == at, 1 / n, 1 - alpha))
        return a, np.where(i <= at - n, 0.0, np.where(i < at, x, np.where(i == at, x / n, alpha * x)))

    return Affine(coefs, shown=at)


def recur(df: DataFrame, specs: dict[str, tuple[str, Affine | Ewm]], rows: int | None = None, by: tuple[str, ...] = ("symbol",), number: str = "bar_id") -> DataFrame:
    """Add columns of recurrences: output name to (column, recurrence). NaN results are null."""
    rows = ROWS if rows is None else rows
    columns = sorted({c for c, _ in specs.values()})
    firsts = df.groupBy(*by).agg(*[F.min(F.when(F.col(c).isNotNull(), F.col(number))).alias(f"_first_{c}") for c in columns])
    keyed = df.withColumn("_piece", piece(number, rows)).join(firsts, list(by))

    def solved(g: pd.DataFrame, o: str):
        c, rule = specs[o]
        x, first = g[c].to_numpy(float), g[f"_first_{c}"].iloc[0]
        i = np.full(len(g), -1) if pd.isna(first) else g[number].to_numpy() - int(first)
        return rule, x, i, rule.local(x, i)

    def each(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(number).reset_index(drop=True)
        for o in specs:
            rule, x, i, (a, b, lead, gap) = solved(g, o)
            g[f"_a_{o}"], g[f"_b_{o}"], g[f"_before_{o}"], g[f"_hidden_{o}"] = a, b, np.arange(len(g)) < lead, i < rule.shown
            g[f"_lead_{o}"], g[f"_gap_{o}"], g[f"_x_{o}"] = lead, gap, x[lead] if lead < len(x) else np.nan
        return g.drop(columns=[f"_first_{c}" for c in columns])

    def starts(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_piece").reset_index(drop=True)
        for o, (_, rule) in specs.items():
            y, gap, before, at = rule.start, 0, [], []
            for row in g[["_n", f"_ends_{o}"]].itertuples(index=False):
                n, end = row[0], row[1]
                before.append(np.nan if y is None else y)
                if end["lead"] == n:
                    at.append(np.nan)
                    gap += n
                    continue
                y = rule.entered(y, gap, end["lead"], np.nan if end["x"] is None else end["x"])
                at.append(y)
                y, gap = end["a"] * y + end["b"], end["gap"]
            g[f"_in_{o}"], g[f"_at_{o}"] = before, at
        return g[[*by, "_piece", *[f"_{k}_{o}" for o in specs for k in ("in", "at")]]]

    key = [keyed.schema[c] for c in (*by, "_piece")]
    made = [StructField(f"_{k}_{o}", _KINDS[t]) for o in specs for k, t in (("a", "double"), ("b", "double"), ("before", "boolean"), ("hidden", "boolean"), ("lead", "long"), ("gap", "long"), ("x", "double"))]
    # written, so that chains of recurrences do not multiply what they are made from
    local = written(keyed.groupBy(*by, "_piece").applyInPandas(each, StructType([*df.schema.fields, key[-1], *made])), "maps")
    ends = {o: F.struct(*[F.col(f"_{k}_{o}").alias(k) for k in ("a", "b", "lead", "gap", "x")]) for o in specs}
    # a symbol's pieces: one row for each ``rows`` of its rows
    summary = local.groupBy(*by, "_piece").agg(F.count("*").alias("_n"), *[F.max_by(e, number).alias(f"_ends_{o}") for o, e in ends.items()])
    begun = summary.groupBy(*by).applyInPandas(starts, StructType([*key, *[StructField(f"_{k}_{o}", DoubleType()) for o in specs for k in ("in", "at")]]))
    met = local.join(begun, [*by, "_piece"])
    value = {o: F.when(F.col(f"_hidden_{o}"), None).when(F.col(f"_before_{o}"), F.col(f"_in_{o}")).otherwise(F.col(f"_a_{o}") * F.col(f"_at_{o}") + F.col(f"_b_{o}")) for o in specs}
    return met.select(*df.columns, *[F.nanvl(v, F.lit(None).cast("double")).alias(o) for o, v in value.items()])


def ewm_mean(df: DataFrame, specs: dict[str, tuple[str, float]], rows: int | None = None, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Exponential means: output name to (input column, alpha)."""
    return recur(df, {o: (c, Ewm(a)) for o, (c, a) in specs.items()}, rows, by)


def ewm_std(df: DataFrame, column: str, output: str, span: float, adjust: bool = False, rows: int | None = None) -> DataFrame:
    """Exponentially weighted sample deviation, corrected for bias, from decaying sums of weights, of their
    squares, and of values and squares about the symbol's first value; null before the second value."""
    alpha = 2 / (span + 1)
    first = df.groupBy("symbol").agg(F.min_by(column, F.when(F.col(column).isNotNull(), F.col("bar_id"))).alias("_base"))
    out = df.join(first, "symbol").withColumn("_x", F.col(column) - F.col("_base")).drop("_base")

    def decaying(power: int, square: bool) -> Affine:
        def coefs(x: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            new = np.where(i == 0, 1.0, 1.0 if adjust else alpha)
            old = (1 - alpha) ** 2 if square else 1 - alpha
            return np.full(len(x), old), np.where(np.isnan(x), 0.0, (new**2 if square else new) * np.where(np.isnan(x), 0.0, x) ** power)

        return Affine(coefs)

    count = Affine(lambda x, i: (np.ones(len(x)), (~np.isnan(x)).astype(float)))
    out = recur(out, {"_w": ("_x", decaying(0, False)), "_ww": ("_x", decaying(0, True)), "_wx": ("_x", decaying(1, False)), "_wxx": ("_x", decaying(2, False)), "_n": ("_x", count)}, rows)
    mean = F.col("_wx") / F.col("_w")
    var = F.greatest(F.col("_wxx") / F.col("_w") - mean * mean, F.lit(0.0)) * F.col("_w") * F.col("_w") / (F.col("_w") * F.col("_w") - F.col("_ww"))
    return out.withColumn(output, F.when(F.col("_n") >= 2, F.sqrt(var))).drop("_x", "_w", "_ww", "_wx", "_wxx", "_n")


def _met(left: DataFrame, right: DataFrame, key: Sequence[str], how: str = "inner") -> DataFrame:
    """A join by columns in which a null equals a null."""
    right = right.withColumnsRenamed({c: f"_key_{c}" for c in key})
    same = [left[c].eqNullSafe(right[f"_key_{c}"]) for c in key]
    return left.join(right, same, how).drop(*[f"_key_{c}" for c in key])


def handed_over(df: DataFrame, outputs: dict[str, str], kernel: Callable[[pd.DataFrame, tuple], tuple[dict[str, np.ndarray], tuple]], start: tuple[float, ...], rows: int | None = None, by: tuple[str, ...] = ("symbol",), number: str = "bar_id", steps: Callable | None = None, fed: tuple[str, ...] = ()) -> DataFrame:
    """Add columns that ``kernel`` makes from some ordered rows and the state before them.

    ``kernel`` gives columns and the state after the rows (numbers); it reads columns of numbers only.
    ``outputs``: name to "double" or "long". ``steps`` makes a map like ``kernels.VolumeMap``, which takes
    the columns ``fed``; rounds then begin with the states that the maps of all blocks give. The result
    is that of the kernel in any case, since blocks run until each begins with what the one before left.
    """
    rows = ROWS if rows is None else rows
    state = [f"_s{k}" for k in range(len(start))]
    at_rest = [F.lit(float(v)).alias(c) for c, v in zip(state, start)]
    block = [*by, "_block"]
    columns, reads = df.columns, [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    kinds = {"double": pa.float64(), "long": pa.int64()}

    def in_order(entered: DataFrame) -> DataFrame:
        return entered.repartition(*block).sortWithinPartitions(*block, number)

    def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, tuple, bool]]:
        """Rows of one block at a time, its key, and whether a block begins."""
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            edge = np.zeros(batch.num_rows - 1, bool)
            for c in block:
                own = batch.column(c)
                same = pc.equal(own[1:], own[:-1])
                both = pc.and_(pc.is_null(own[1:]), pc.is_null(own[:-1]))
                edge |= ~pc.or_(pc.fill_null(same, False), both).to_numpy(zero_copy_only=False)
            at = [0, *(np.flatnonzero(edge) + 1).tolist(), batch.num_rows]
            for a, b in zip(at[:-1], at[1:]):
                part = batch.slice(a, b - a)
                key = tuple(part.column(c)[0].as_py() for c in block)
                yield part, key, key != held
                held = key

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict, tuple, bool]]:
        """Rows of one block at a time, what the kernel makes of them, the state after them, and whether a block begins."""
        after = ()
        for part, _, begins in blocks_of(batches):
            if begins:
                after = tuple(part.column(c)[0].as_py() for c in state)
            made, after = kernel(part.select(reads).to_pandas(), after)
            yield part, made, after, begins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, made, _, _ in parts(batches):
            new = [pa.array(np.asarray(made[c]), kinds[k], from_pandas=True) for c, k in outputs.items()]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], *new], names=[*columns, *outputs])

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for part, _, after, begins in parts(batches):
            row = (*[part.column(c)[:1] for c in block], *[pa.array([float(v)], pa.float64()) for v in after])
            found = [*found, row] if begins else [*found[:-1], row]
            if len(found) > 1000:
                yield from (pa.RecordBatch.from_arrays(list(r), names=left_names) for r in found[:-1])
                found = found[-1:]
        yield from (pa.RecordBatch.from_arrays(list(r), names=left_names) for r in found)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The steps of each block."""
        own, key = None, []

        def made() -> pa.RecordBatch:
            need, left = own.steps()
            keys = [pa.array(np.zeros(len(need), np.int32)) for _ in key]
            return pa.RecordBatch.from_arrays([*[k.take(z) for k, z in zip(key, keys)], pa.array(need), *[pa.array(left[:, k]) for k in range(len(state))]], names=[*block, "_need", *state])

        for part, _, begins in blocks_of(batches):
            if begins:
                if own is not None:
                    yield made()
                own, key = steps(), [part.column(c)[:1] for c in block]
            own.add(*[part.column(c).to_numpy(zero_copy_only=False) for c in fed])
        if own is not None:
            yield made()

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The state before each block, from the steps of the blocks of its symbol."""
        own, symbol, now, held = steps(), None, tuple(map(float, start)), []

        def passed() -> tuple[float, ...]:
            need = np.concatenate([h.column("_need").to_numpy() for h in held])
            left = np.concatenate([np.stack([h.column(c).to_numpy() for c in state], 1) for h in held])
            return own.leaves(now, need, left)

        for part, key, begins in blocks_of(batches):
            if begins:
                now = passed() if held and key[:-1] == symbol else tuple(map(float, start))
                symbol, held = key[:-1], []
                yield pa.RecordBatch.from_arrays([*[part.column(c)[:1] for c in block], *[pa.array([v], pa.float64()) for v in now]], names=[*block, *state])
            held.append(part)

    # a block is as many pieces as there are blocks, about; it runs through a task in batches
    longest = df.groupBy(*by).agg(F.max(piece(number, rows)).alias("_wide")).select(*by, F.greatest(F.lit(1), F.floor(F.sqrt(F.col("_wide") + 1))).cast("long").alias("_wide"))
    keyed = _met(df, longest, by).withColumn("_block", F.floor(piece(number, rows) / F.col("_wide"))).drop("_wide")
    keyed = written(keyed, "dealt")
    key = [keyed.schema[c] for c in block]
    left_names = [*block, *[f"{c}_now" for c in state]]
    leaving = StructType([*key, *[StructField(f"{c}_now", DoubleType()) for c in state]])
    closing = StructType([*df.schema.fields, *[StructField(c, _KINDS[k]) for c, k in outputs.items()]])
    along = Window.partitionBy(*by).orderBy("_block")
    # the last block of a symbol hands nothing over
    blocks = keyed.select(*block).distinct().withColumn("_next", F.lead("_block").over(along))
    if steps is None:
        blocks = blocks.select("*", *at_rest)
    else:
        numbers = [StructField(c, DoubleType()) for c in state]
        maps = keyed.select(*dict.fromkeys([*block, number, *fed])).repartition(*block).sortWithinPartitions(*block, number).mapInArrow(mapped, StructType([*key, StructField("_need", DoubleType()), *numbers]))
        begun = maps.repartition(*by).sortWithinPartitions(*block, "_need").mapInArrow(entered, StructType([*key, *numbers]))
        blocks = _met(blocks, begun, block)
    table = written(blocks.select("*", *[F.lit(None).cast("double").alias(f"{c}_out") for c in state], F.col("_next").isNotNull().alias("_due")), "states")
    due, all_at_once = table.where("_due").count(), None
    while due:
        asked = table.where("_due")
        if all_at_once is None or 2 * due <= all_at_once:
            all_at_once = due
        else:
            asked = asked.withColumn("_least", F.min("_block").over(Window.partitionBy(*by))).where(F.col("_block") == F.col("_least"))
        rows_of = in_order(_met(keyed.select(*dict.fromkeys([*block, number, *reads])), asked.select(*block, *state), block))
        met = _met(table, rows_of.mapInArrow(leave, leaving).withColumn("_ran", F.lit(True)), block, "left")
        met = met.withColumns({f"{c}_out": F.when(F.col("_ran"), F.col(f"{c}_now")).otherwise(F.col(f"{c}_out")) for c in state} | {"_due": F.col("_due") & F.col("_ran").isNull()})
        first = F.lag("_block").over(along).isNull()
        entry = {c: F.when(first, F.lit(float(v))).otherwise(F.lag(f"{c}_out").over(along)) for c, v in zip(state, start)}
        moved = F.lit(False)
        for c in state:
            moved = moved | ~F.col(c).eqNullSafe(F.col(f"{c}_was"))
        met = met.select(*block, "_next", "_due", *[F.col(c).alias(f"{c}_was") for c in state], *[e.alias(c) for c, e in entry.items()], *[f"{c}_out" for c in state])
        table = written(met.withColumn("_due", (moved | F.col("_due")) & F.col("_next").isNotNull()).drop(*[f"{c}_was" for c in state]), "states")
        due = table.where("_due").count()
    return in_order(_met(keyed, table.select(*block, *state), block)).mapInArrow(run, closing)
