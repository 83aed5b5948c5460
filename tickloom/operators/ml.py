"""Evaluation, cross-validation, sample sets and models over trades and features."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.pieces import numbered, ranges, written

def features_at_entry(trades: DataFrame, features: DataFrame) -> DataFrame:
    """Trades with the features of their entry bar; columns that trades have are left out."""
    new = [c for c in features.columns if c not in trades.columns]
    return trades.join(features.select("symbol", "bar_id", *new), ["symbol", "bar_id"], "left")


def feature_names(df: DataFrame, exclude: list[str]) -> list[str]:
    """Numeric columns but those excluded, whatever their case."""
    out = {c.lower() for c in exclude}
    return [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint") and c.lower() not in out]


def decide(p: Column, threshold: float = 0.0, least: float = 0.0) -> Column:
    """+1 or -1 beyond the threshold; 0 between, and below the least confidence."""
    return F.when(F.abs(p) < least, 0).when(p > threshold, 1).when(p < -threshold, -1).otherwise(0)


def classification(df: DataFrame, by: str, truth: str = "truth", guess: str = "guess") -> DataFrame:
    """Accuracy, and precision, recall and F1 of +1 and -1; 0 where nothing is there to divide by."""
    t, g = F.col(truth), F.col(guess)
    cols = [F.avg((t == g).cast("double")).alias("accuracy")]
    for value, name in ((1, "long"), (-1, "short")):
        hit, said, real = F.count_if((t == value) & (g == value)), F.count_if(g == value), F.count_if(t == value)
        ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
        cols += [ratio(hit, said).alias(f"precision_{name}"), ratio(hit, real).alias(f"recall_{name}"), ratio(2 * hit, said + real).alias(f"f1_{name}")]
    return df.groupBy(by).agg(*cols)


def aggregate_metrics(table: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean, population deviation, extremes and median of each metric over samples."""
    long = table.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics])).alias("m")).select("m.*")
    return long.groupBy("metric").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"), F.median("x").alias("median"))


def stability_scores(summary: DataFrame) -> DataFrame:
    """Deviation over absolute mean of each metric, and 1/(1 + that)."""
    cv = F.when(F.abs("mean") > 0, F.col("std") / F.abs("mean"))
    return summary.select("metric", cv.alias("cv"), (1 / (1 + cv)).alias("stability"))


def purged_folds(events: DataFrame, folds: int = 5, embargo: float = 0.01, by: str = "symbol", order: str = "bar_id", tie: list[str] = ()) -> DataFrame:
    """One row per event and fold: role train, test or null (purged).

    Test blocks are consecutive, the last takes the remainder; training rows are farther
    than the embargo (a share of all rows) from the block on both sides. ``tie``: columns
    that order rows of equal ``order``; they are kept.
    """
    kept = [by, order, *[t for t in tie if t != by]]
    own = written(events.select(*kept), "folds")  # read for ranges, counts and numbers
    # numbered in ranges of the order, so that a group of all rows is many tasks
    rows = numbered(own, (order, *tie), ranges(own, order), "i", (by,), 0).join(own.groupBy(by).agg(F.count("*").alias("n")), by)
    size, gap = F.floor(F.col("n") / folds), F.floor(F.col("n") * embargo)
    each = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumns({"start": F.col("fold") * size, "stop": F.when(F.col("fold") == folds - 1, F.col("n")).otherwise((F.col("fold") + 1) * size)})
    test = (F.col("i") >= F.col("start")) & (F.col("i") < F.col("stop"))
    train = (F.col("i") < F.col("start") - gap) | (F.col("i") >= F.col("stop") + gap)
    return each.select(*kept, "fold", F.when(test, "test").when(train, "train").alias("role"))


def split_samples(samples: DataFrame, method: str = "time", train: float = 0.6, val: float = 0.2, seed: int = 42, group: str = "symbol") -> DataFrame:
    """Samples dealt into train, val and test by name order (time), by hash (random), or by hash within
    each symbol (symbol), so that every symbol has its share of each part.

    A sample of several symbols goes by the smallest one.
    """
    if method == "symbol":
        ids = samples.groupBy("sample_id").agg(F.min(group).alias("_group"))
        own = Window.partitionBy("_group")
        rank = F.row_number().over(own.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("sample_id").cast("string"))), "sample_id"))
        at = ids.withColumn("at", (rank - 1) / F.count("*").over(own))
        return at.select("sample_id", F.when(F.col("at") < train, "train").when(F.col("at") < train + val, "val").otherwise("test").alias("split"))
    if method not in ("time", "random"):
        raise ValueError(f"unknown split {method!r}")
    order = F.col("sample_id") if method == "time" else F.xxhash64("sample_id", F.lit(seed))
    ids = samples.select("sample_id").distinct()
    rank = F.row_number().over(Window.orderBy(order, "sample_id"))  # one row per sample
    n = F.count("*").over(Window.partitionBy())
    at = ids.withColumn("at", (rank - 1) / n)
    return at.select("sample_id", F.when(F.col("at") < train, "train").when(F.col("at") < train + val, "val").otherwise("test").alias("split"))


def combine(samples: dict[str, DataFrame]) -> DataFrame:
    """All samples under one another with their id."""
    out = None
    for name, df in samples.items():
        one = df.withColumn("sample_id", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def forest(features: list[str], label: str = "bin", weight: str | None = None, trees: int = 100, depth: int = 10, seed: int = 42) -> Pipeline:
    """Assembled features and a random forest; labels keep their values in ``predicted``."""
    rf = RandomForestClassifier(featuresCol="features", labelCol="label_index", numTrees=trees, maxDepth=depth, seed=seed)
    if weight:
        rf = rf.setWeightCol(weight)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc"), rf])


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Rows with the predicted label and its probability; both are null where a feature is."""
    assembler, indexer, rf = model.stages
    out = rf.transform(assembler.copy({assembler.handleInvalid: "keep"}).transform(rows))
    named = IndexToString(inputCol="prediction", outputCol="predicted", labels=indexer.labels).transform(out)
    whole = F.lit(True)
    for c in assembler.getInputCols():
        whole = whole & F.col(c).isNotNull()
    named = named.withColumns({"predicted": F.when(whole, F.col("predicted")), "confidence": F.when(whole, F.array_max(vector_to_array("probability")))})
    return named.drop("features", "rawPrediction", "probability", "prediction")


def save(model: PipelineModel, path: str, **about: str) -> None:
    """Write a fitted model with its features, its target and what else is said about it to a new folder."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    assembler, indexer = model.stages[:2]
    state = {"features": assembler.getInputCols(), "target": indexer.getInputCol(), "about": about}
    model.write().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.text(f"{path}/state")


def load(path: str) -> tuple[PipelineModel, dict]:
    """A model that ``save`` wrote, and its features, target and description."""
    from pyspark.sql import SparkSession

    state = json.loads(SparkSession.active().read.text(f"{path}/state").first()["value"])
    model = PipelineModel.load(f"{path}/model")
    if model.stages[0].getInputCols() != state["features"]:
        raise ValueError(f"features of {path} do not fit its model")
    return model, state


def importances(model: PipelineModel) -> dict[str, float]:
    """Mean decrease of impurity by feature."""
    return dict(zip(model.stages[0].getInputCols(), map(float, model.stages[-1].featureImportances.toArray())))
