"""One symbol in many tasks: pieces of its numbered rows, with halos and offsets.

Rows that carry a dense number along their symbol (``bar_id``) fall into pieces of
``rows`` numbers, so a piece has a bounded size whatever the symbol's length. What needs a
bounded number of neighbours gets them as a halo; what runs from the first row on gets the
sum of the pieces before as an offset from a table with one row per piece.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tickloom.functions.windows import keyed_by

#: Rows of a piece.
ROWS = 1 << 16


def piece(number: str = "bar_id", rows: int = ROWS) -> Column:
    return F.floor(F.col(number) / rows).alias("_piece")


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the folder in ``spark.checkpoint.dir`` and read it back, which cuts its lineage.

    Where all runs in one process and none is named, as in tests, a temporary folder serves.
    """
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{_shared(spark)}/{tag}-{uuid.uuid4().hex}"


def _shared(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        import tempfile

        found = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def numbered(df: DataFrame, order: tuple[str, ...], bucket: Column, name: str = "bar_id", by: tuple[str, ...] = ("symbol",), start: int = 1) -> DataFrame:
    """Number the rows of each symbol in ``order``, by buckets that follow the order (such as hours of a
    time): rows are counted per bucket, and only the counts of a symbol come together."""
    df = df.withColumn("_bucket", bucket)
    counts = df.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*by, "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    own = Window.partitionBy(*by, "_bucket").orderBy(*order)
    out = df.withColumn("_own", F.row_number().over(own)).join(offsets, [*by, "_bucket"])
    return out.withColumn(name, (F.col("_own") + F.col("_before") + (start - 1)).cast("long")).select(*[c for c in df.columns if c not in ("_bucket", name)], name)


#: Ranges that a column without buckets of its own is cut into.
RANGES = 256


def ranges(df: DataFrame, column: str, n: int = RANGES) -> Column:
    """A number of the range of ``column`` that a row falls in, for ``numbered``: at most ``n`` ranges of about
    equal counts, between approximate quantiles. Rows with equal values share a range; a null is in the first."""
    kind = df.schema[column].dataType
    cuts = df.agg(F.percentile_approx(column, F.array(*[F.lit((i + 1) / n) for i in range(n - 1)])).alias("q")).first()["q"]
    return F.size(F.filter(F.array(*[F.lit(x).cast(kind) for x in sorted(set(cuts or []))]).cast(ArrayType(kind)), lambda x: x < F.col(column)))


def quantiles(df: DataFrame, column: str, levels: list[float]) -> list[float]:
    """Exact quantiles of the finite values of a column, linear between values; none of no values.

    Values are numbered in ranges, and only those at the wanted numbers reach the driver.
    """
    x = F.col(column).cast("double")
    own = df.select(x.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    n = own.count()
    if not n:
        return []
    places = [q * (n - 1) for q in levels]
    wanted = sorted({k for at in places for k in (int(at), min(int(at) + 1, n - 1))})
    found = {r["_at"]: r["_x"] for r in numbered(own, ("_x",), ranges(own, "_x"), "_at", (), 0).where(F.col("_at").isin(wanted)).collect()}
    return [found[int(at)] + (found[min(int(at) + 1, n - 1)] - found[int(at)]) * (at - int(at)) for at in places]


def medians(df: DataFrame, column: str, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The exact median of the values of each group: columns ``by`` and median. A group without a value has no row.

    Values are numbered in ranges, so no task holds a group; ``df`` is read more than once.
    """
    own = df.select(*by, F.col(column).cast("double").alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    sizes = own.groupBy(*by).agg(F.count("*").alias("_all"))
    placed = numbered(own, ("_x",), ranges(own, "_x"), "_at", by, 0).join(sizes, list(by))
    middle = (F.col("_at") == F.floor((F.col("_all") - 1) / 2)) | (F.col("_at") == F.floor(F.col("_all") / 2))
    return placed.where(middle).groupBy(*by).agg(F.avg("_x").alias("median"))


def split(bars: DataFrame, f: Callable[[DataFrame], DataFrame], back: int = 0, ahead: int = 0, rows: int = ROWS) -> DataFrame:
    """``f`` over bars, where it uses windows along the bars that reach ``back`` rows before and
    ``ahead`` rows after a row at most, piece by piece.

    Numbers must be dense. A row near an edge is copied into the pieces whose rows see it, so the
    copies are ``back + ahead`` rows a piece. Windows over whole symbols or from the first row on have no
    bounded reach and give wrong results here; see ``running``.
    """
    own = F.col("bar_id")
    seen_by = F.sequence(F.floor((own - ahead) / rows), F.floor((own + back) / rows))
    spread = bars.withColumn("_piece", F.explode(seen_by))
    with keyed_by("symbol", "_piece"):
        out = f(spread)
    return out.where(F.col("_piece") == F.floor(own / rows)).drop("_piece")


_JOINED = {"sum": (F.sum, lambda own, before: own + F.coalesce(before, F.lit(0))), "max": (F.max, lambda own, before: F.greatest(own, before)), "min": (F.min, lambda own, before: F.least(own, before)), "last": (lambda x: F.last(x, True), lambda own, before: F.coalesce(own, before))}


def running(df: DataFrame, outputs: dict[str, tuple[str, str]], rows: int = ROWS, by: tuple[str, ...] = ("symbol",), number: str = "bar_id") -> DataFrame:
    """Running sums, maxima, minima or last values that are not null, from a symbol's first row to each row.

    ``outputs``: name to (sum, max, min or last; column). Each piece runs by itself and is joined with
    what the pieces before it come to. A null is passed over; null until there is a value (sum: too).
    """
    df = df.withColumn("_piece", piece(number, rows))
    within = Window.partitionBy(*by, "_piece").orderBy(number)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumns({f"_own_{o}": _JOINED[kind][0](F.col(c)).over(upto) for o, (kind, c) in outputs.items()})
    total = {o: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(number))) if kind == "last" else _JOINED[kind][0](F.col(c)) for o, (kind, c) in outputs.items()}
    totals = df.groupBy(*by, "_piece").agg(*[t.alias(f"_all_{o}") for o, t in total.items()])
    earlier = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_piece", *[_JOINED[kind][0](F.col(f"_all_{o}")).over(earlier).alias(f"_before_{o}") for o, (kind, _) in outputs.items()])
    met = local.join(offsets, [*by, "_piece"])

    def value(o: str, kind: str) -> Column:
        own, before = F.col(f"_own_{o}"), F.col(f"_before_{o}")
        return F.coalesce(_JOINED[kind][1](own, before), before)

    return met.select(*[c for c in df.columns if c != "_piece"], *[value(o, kind).alias(o) for o, (kind, _) in outputs.items()])
