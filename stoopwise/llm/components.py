"""Connected components of a graph in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoopwise.session import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """Every node ``node`` that has an edge, with the smallest node of its component, ``root``.

    ``edges`` has two columns of long. Rounds of large-star and small-star turn each
    component into a star around its smallest node; a round costs a few shuffles of the
    edges left, and their number of rounds grows with the logarithm of the longest path.
    Every round is written, so a lost executor costs a round at most.
    """
    first, second = edges.columns
    ends = edges.select(F.greatest(first, second).alias("a"), F.least(first, second).alias("b"))
    now = written(ends.where("a <> b").distinct(), "edges")
    mark = _mark(now)
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            now.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.withColumnRenamed("m", "b"))
            .distinct()
        )
        last, now = now, written(small, "edges")
        before, mark = mark, _mark(now)
        dropped(last)
        if mark == before:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges."""
    hashes = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), hashes).first())
