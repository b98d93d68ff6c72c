"""Row numbers within groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stoopwise.params import ROWS_PER_TASK
from stoopwise.session import new_path


def number_within(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str = "n",
    rows_per_task: int = ROWS_PER_TASK,
    largest: int | None = None,
) -> DataFrame:
    """Add a 1-based row number per group; ``order`` must be total within a group.

    While the largest group fits one task this is a plain window. Beyond that the
    rows are range-partitioned by group and order, numbered inside each partition,
    and moved on by what the same group has in earlier partitions. With no keys the
    whole table is one group. The rows of the largest group are counted unless the
    caller knows a bound and passes it as ``largest``.
    """
    if largest is None:
        largest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest <= rows_per_task:
        window = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, F.row_number().over(window).cast("long"))
    return _number_across_partitions(df, list(keys), list(order), name, rows_per_task)


def _number_across_partitions(
    df: DataFrame, keys: list[str], order: list[Column], name: str, rows_per_task: int
) -> DataFrame:
    spark = df.sparkSession
    parts = max(2, -(-df.count() // rows_per_task))
    # The ranges come from a sample, so the split rows are written once: both uses
    # below, and any task that runs again, then see the same ranges.
    path = new_path(spark, "ranges")
    (
        df.repartitionByRange(parts, *[F.col(k) for k in keys], *order)
        .withColumn("_part", F.spark_partition_id())
        .write.parquet(path)
    )
    split = spark.read.parquet(path)
    local = Window.partitionBy(*keys, "_part")
    numbered = split.withColumn("_local", F.row_number().over(local.orderBy(*order)))
    # A group reaches over a partition border at most once per border, so the groups
    # that need an offset are fewer than the partitions.
    sizes = split.groupBy(*keys, "_part").agg(F.count("*").alias("_size"))
    running = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.sum("_size").over(running)).where("_before > 0")
    condition = F.col("a._part") == F.col("b._part")
    for key in keys:
        condition &= F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}"))
    return (
        numbered.alias("a")
        .join(offsets.alias("b"), condition, "left")
        .select(
            *[F.col(f"a.{c}") for c in df.columns],
            (F.col("a._local") + F.coalesce(F.col("b._before"), F.lit(0))).cast("long").alias(name),
        )
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key.

    Spark limits every map task to the first row per key before the shuffle, so a key
    with a large share of the rows reaches its task as a handful of rows.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(window)).where("_nth = 1").drop("_nth")


def total_order(df: DataFrame, first: Sequence[str] = ()) -> list[Column]:
    """All columns as an ordering, ``first`` ones ahead, nulls first."""
    rest = [c for c in df.columns if c not in first]
    return [F.col(c).asc_nulls_first() for c in [*first, *rest]]
