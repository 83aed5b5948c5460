"""Trainers over several samples, feature importances and orthogonal features.

Models are Spark ML pipelines of ``ml.forest``; the driver loops over samples, folds
and features, never over rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel, TaskContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.pieces import written
from tickloom.operators import ml

Fit = Callable[[list[str]], Pipeline]


def train_single(rows: DataFrame, features: list[str], samples: list[str], fit: Fit = ml.forest) -> dict[str, PipelineModel]:
    """A model for each sample, from its rows (column sample_id)."""
    return {s: fit(features).fit(rows.where(F.col("sample_id") == s)) for s in samples}


def train_universal(rows: DataFrame, features: list[str], samples: list[str] | None = None, fit: Fit = ml.forest) -> PipelineModel:
    """One model from the rows of all samples."""
    return fit(features).fit(rows if samples is None else rows.where(F.col("sample_id").isin(samples)))


def train_bagging(rows: DataFrame, features: list[str], n_models: int = 5, seed: int = 42, fit: Fit = ml.forest) -> dict[str, PipelineModel]:
    """Models from bootstrap samples (drawn with replacement) of all rows."""
    return {f"bagging_model_{i}": fit(features).fit(rows.sample(withReplacement=True, fraction=1.0, seed=seed + i)) for i in range(n_models)}


def train_ensemble(rows: DataFrame, features: list[str], samples: list[str], method: str = "voting", **kwargs) -> dict[str, PipelineModel]:
    """Models of an ensemble: voting (one per sample) or bagging."""
    if method in ("voting", "bagging"):
        held = rows.where(F.col("sample_id").isin(samples)).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return train_single(held, features, samples, **kwargs) if method == "voting" else train_bagging(held, features, **kwargs)
        finally:
            held.unpersist()
    raise ValueError(f"unknown ensemble {method!r}; voting or bagging")


def predict_single(models: dict[str, PipelineModel], rows: DataFrame) -> DataFrame:
    """Rows with ``predicted`` (a number) by the model of their own sample; one pass per model."""
    present = [r[0] for r in rows.select("sample_id").distinct().collect()]  # one row per sample
    missing = sorted(set(present) - set(models))
    if missing:
        raise ValueError(f"no model for samples {missing}")
    out = None
    for s in sorted(present):
        one = ml.predict(models[s], rows.where(F.col("sample_id") == s)).withColumn("predicted", F.col("predicted").cast("double"))
        out = one if out is None else out.unionByName(one)
    return rows.withColumns({"predicted": F.lit(0.0), "confidence": F.lit(0.0)}) if out is None else out


def predict_voting(models: dict[str, PipelineModel], rows: DataFrame) -> DataFrame:
    """Rows with ``predicted``: the mean prediction of the models whose name holds the row's
    sample or is of a bag. Rows that no model is for are left out; one pass over the rows."""
    votes = []
    for i, (name, model) in enumerate(sorted(models.items())):
        rows = ml.predict(model, rows).withColumnRenamed("predicted", f"_vote{i}").drop("confidence", "label_index")
        heard = F.lit("bagging" in name) | F.lit(name).contains(F.col("sample_id"))
        votes.append(F.when(heard, F.col(f"_vote{i}").cast("double")))
    held = F.filter(F.array(*votes), lambda v: v.isNotNull())
    mean = F.try_divide(F.aggregate(held, F.lit(0.0), lambda a, b: a + b), F.size(held))
    return rows.withColumn("predicted", mean).drop(*[f"_vote{i}" for i in range(len(votes))]).where("predicted IS NOT NULL")


def sample_summary(rows: DataFrame) -> DataFrame:
    """Rows and columns of each sample."""
    return rows.groupBy("sample_id").agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(rows.columns)))


@dataclass(frozen=True)
class Orthogonal:
    """Features standardised by the mean and sample deviation of the rows it was made from,
    and an orthonormal basis of them (``basis``: coefficients of each new column)."""

    features: list[str]
    mean: list[float]
    std: list[float]
    basis: np.ndarray

    def standardized(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({f: (F.col(f) - m) / s if s else F.lit(0.0) for f, m, s in zip(self.features, self.mean, self.std)})

    def transform(self, rows: DataFrame, prefix: str = "orth_") -> DataFrame:
        """Rows with columns of the basis, as sums of standardised features."""
        z = self.standardized(rows)
        sums = {f"{prefix}{k}": sum((F.col(f) * float(c) for f, c in zip(self.features, self.basis[:, k])), F.lit(0.0)) for k in range(len(self.features))}
        mixed = z.select(*rows.columns, *[c.alias(n) for n, c in sums.items()])
        return mixed.select(*[c for c in rows.columns if c not in self.features], *[f"{prefix}{k}" for k in range(len(self.features))])


def orthogonal(rows: DataFrame, features: list[str], method: str = "qr") -> Orthogonal:
    """The basis that orthogonalises features over rows without nulls in them.

    Each task folds its batches into one triangular factor, and factors are stacked and factored
    again by groups of ``FACTORS`` until one is left, so nearly dependent columns keep the digits that a
    product matrix would lose; only means, deviations and the last factor reach the driver. qr
    orders the basis by the features (a column that depends on those before it within rounding adds
    nothing), svd by singular values.
    """
    if method not in ("qr", "svd"):
        raise ValueError("method is 'qr' or 'svd'")
    good = rows.dropna(subset=features)
    first = good.agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)], *[F.stddev_samp(f).alias(f"s{i}") for i, f in enumerate(features)]).first()
    k = len(features)
    mean, std = [float(first[f"m{i}"] or 0.0) for i in range(k)], [float(first[f"s{i}"] or 0.0) for i in range(k)]
    factor = _factor(good.select(*[((F.col(f) - m) / s if s else F.lit(0.0)).alias(f"z{i}") for i, (f, m, s) in enumerate(zip(features, mean, std))]), k)
    left, size, right = np.linalg.svd(factor)
    kept = size > size.max(initial=0.0) * k * np.finfo(float).eps
    if method == "svd":
        basis = right.T * np.divide(1.0, size, out=np.zeros(k), where=kept)
    elif kept.all() and k:
        factor = factor * np.where(np.diag(factor) < 0, -1.0, 1.0)[:, None]
        basis = np.linalg.solve(factor, np.eye(k))
    else:
        basis = np.linalg.pinv(factor * np.where(np.diag(factor) < 0, -1.0, 1.0)[:, None])
    return Orthogonal(features, mean, std, basis)


#: Triangular factors that are stacked in one task.
FACTORS = 64


def _factor(z: DataFrame, k: int) -> np.ndarray:
    """The triangular factor of all rows of ``z`` (k columns)."""
    kind = "part long, row long, line array<double>"

    def lines(r: np.ndarray, part: int) -> pd.DataFrame:
        return pd.DataFrame({"part": part, "row": range(len(r)), "line": list(r)})

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = np.zeros((0, k))
        for batch in batches:
            r = np.linalg.qr(np.vstack([r, batch.to_numpy(float)]), "r")
        if len(r):
            yield lines(r, TaskContext.get().partitionId())

    def stack(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        held = np.vstack(g.sort_values(["part", "row"])["line"].tolist())
        return lines(np.linalg.qr(held, "r"), int(key[0]))

    table = written(z.mapInPandas(fold, kind), "factors")
    while (most := table.agg(F.max("part")).first()[0]) is not None and most > 0:
        table = written(table.groupBy(F.floor(F.col("part") / FACTORS)).applyInPandas(stack, kind), "factors")
    found = np.zeros((k, k))
    for r in table.collect():  # at most k rows
        found[r["row"]] = r["line"]
    return found


def permuted(rows: DataFrame, feature: str, key: list[str], seed: int = 7, block: int = 100_000, n: int | None = None) -> DataFrame:
    """Rows with one feature exchanged among them at random.

    Rows are dealt at random into blocks of about ``block`` rows, and values move inside
    a block, so that no task sees all rows.
    """
    n = rows.count() if n is None else n
    dealt = rows.withColumn("_block", F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(max(1, n // block))))
    place = lambda salt: F.row_number().over(Window.partitionBy("_block").orderBy(F.xxhash64(*key, F.lit(seed + salt)), *key))
    values = dealt.select("_block", place(1).alias("_place"), F.col(feature).alias("_moved"))
    return dealt.withColumn("_place", place(2)).join(values, ["_block", "_place"]).drop("_block", "_place", feature).withColumnRenamed("_moved", feature)


def _accuracy(model: PipelineModel, rows: DataFrame, label: str) -> float:
    hit = (F.col("predicted").cast("double") == F.col(label).cast("double")).cast("double")
    return float(ml.predict(model, rows).agg(F.avg(hit)).first()[0] or 0.0)


METHODS = ("mdi", "mda", "sfi", "ofi")


def feature_importance(rows: DataFrame, features: list[str], label: str = "bin", methods: tuple[str, ...] = ("mdi", "mda"), folds: int = 5, embargo: float = 0.01, key: tuple[str, ...] = ("symbol", "bar_id"), by: str = "all_rows", order: str = "bar_id", fit: Fit = ml.forest) -> DataFrame:
    """Importance of each feature by each method, the mean over purged folds.

    mdi: mean decrease of impurity; mda: loss of accuracy when the feature is permuted;
    sfi: accuracy with the feature alone; ofi: that with the standardised feature alone.
    Columns: feature, method, importance.
    """
    unknown = set(methods) - set(METHODS)
    if unknown:
        raise ValueError(f"unknown methods {sorted(unknown)}; some of {METHODS}")
    good = rows.dropna(subset=[*features, label])
    if by == "all_rows":
        good = good.withColumn("all_rows", F.lit(0))
    found: dict[tuple[str, str], list[float]] = {}
    roles = ml.purged_folds(good, folds, embargo, by, order, tie=[k for k in key if k != order])
    for fold in range(folds):
        role = roles.where((F.col("fold") == fold) & F.col("role").isNotNull()).select(*key, "role")
        # each fit reads the fold several times; what does not fit in memory goes to disk
        both = good.select(*key, *features, label).join(role, list(key)).persist(StorageLevel.MEMORY_AND_DISK)
        train, test = both.where("role = 'train'").drop("role"), both.where("role = 'test'").drop("role")
        model = fit(features).fit(train) if {"mdi", "mda"} & set(methods) else None
        if "mdi" in methods:
            for f, x in ml.importances(model).items():
                found.setdefault((f, "mdi"), []).append(x)
        if "mda" in methods:
            base, n = _accuracy(model, test, label), test.count()
            for f in features:
                found.setdefault((f, "mda"), []).append(base - _accuracy(model, permuted(test, f, list(key), n=n), label))
        for method in [m for m in ("sfi", "ofi") if m in methods]:
            basis = orthogonal(train, features) if method == "ofi" else None
            a, b = (basis.standardized(train), basis.standardized(test)) if basis else (train, test)
            for f in features:
                found.setdefault((f, method), []).append(_accuracy(fit([f]).fit(a), b, label))
        both.unpersist()
    return rows.sparkSession.createDataFrame([(f, m, float(np.mean(x))) for (f, m), x in sorted(found.items())], "feature string, method string, importance double")


def mean_importance(table: DataFrame) -> DataFrame:
    """Mean importance of each feature over methods or folds."""
    return table.groupBy("feature").agg(F.avg("importance").alias("importance"))


def top_features(table: DataFrame, n: int = 10, method: str = "mean") -> DataFrame:
    """The n features of largest importance by one method, or by the mean of all; ties by name."""
    own = mean_importance(table) if method == "mean" else table.where(F.col("method") == method).select("feature", "importance")
    return own.orderBy(F.desc("importance"), "feature").limit(n)


def important(table: DataFrame, threshold: float = 0.01, method: str = "mean") -> DataFrame:
    """Features whose importance exceeds the threshold."""
    own = mean_importance(table) if method == "mean" else table.where(F.col("method") == method).select("feature", "importance")
    return own.where(F.col("importance") > threshold)


def compare_methods(table: DataFrame) -> DataFrame:
    """Rank of each feature by each method (1: most important), and its mean rank."""
    rank = F.rank().over(Window.partitionBy("method").orderBy(F.desc("importance")))
    ranked = table.withColumn("rank", rank)
    mean = F.avg("rank").over(Window.partitionBy("feature"))
    return ranked.withColumn("mean_rank", mean)


def keep_columns(rows: DataFrame, features: DataFrame, always: list[str]) -> DataFrame:
    """Rows with only the columns of a table of features (column ``feature``) and some more."""
    kept = {r["feature"] for r in features.select("feature").collect()}  # one row per column
    return rows.select(*[c for c in rows.columns if c in kept or c in always])
