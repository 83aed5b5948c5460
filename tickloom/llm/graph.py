"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import forget, written


def components(edges: DataFrame) -> DataFrame:
    """The component of every node that has an edge.

    ``edges`` has long columns a and b; loops, nulls and repeats are ignored.
    Returns node and component (the smallest node reachable). Each round links the
    larger neighbours of a node, then the smaller ones, to the least of them, and is
    written to the shared folder; rounds grow with the logarithm of a component's size.
    """
    spark = edges.sparkSession
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    sign = _signature(now)
    while sign[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.least("u", "m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down).distinct()
        then = written(small, "edges")
        forget(spark, now)
        now, before, sign = then, sign, _signature(then)
        if sign == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _signature(edges: DataFrame) -> tuple[int, int | None]:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1]
