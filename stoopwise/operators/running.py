"""Running values within groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stoopwise.params import ROWS_PER_TASK
from stoopwise.session import written


def _reduced(kind: str, value: Column) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True)
    return F.max(value) if kind == "max" else F.sum(value)


def _joined(kind: str, earlier: Column, later: Column) -> Column:
    """The value over two stretches of rows that follow each other; null is nothing."""
    if kind == "last":
        return F.coalesce(later, earlier)
    if kind == "max":
        return F.greatest(earlier, later)
    return F.when(earlier.isNull(), later).when(later.isNull(), earlier).otherwise(earlier + later)


def running_before(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, tuple[str, Column]],
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add to each row what the rows before it in its group come to.

    ``values`` names columns with a kind and an expression: the ``last`` value that is
    not null, the ``max`` or the ``sum``; each is null where there is nothing before.
    ``order`` must be total within a group; null keys are groups like others.

    Each kind is associative, so a group needs no single task: rows are range-partitioned
    by group and order, every stretch of a group in a partition is reduced to one row,
    the stretches of a group, at most one per partition, are run through, and what comes
    out is carried into the rows of the next stretch.
    """
    rows = written(df.select("*", *[v.alias(f"_v_{n}") for n, (_, v) in values.items()]), "running-rows")
    parts = max(1, -(-rows.count() // rows_per_task))
    by = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    # The ranges come from a sample, so the split rows are written once and both uses,
    # and any task that runs again, see the same ranges.
    split = written(rows.repartitionByRange(parts, *by).withColumn("_part", F.spark_partition_id()), "running-split")
    inside = Window.partitionBy("_part", *keys).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = split.select(
        *df.columns, "_part", *[_reduced(k, F.col(f"_v_{n}")).over(earlier).alias(f"_l_{n}") for n, (k, _) in values.items()]
    )
    # In a stretch the last value is that of the greatest place.
    place = F.struct(*order)

    def whole(name: str, kind: str) -> Column:
        value = F.col(f"_v_{name}")
        if kind != "last":
            return _reduced(kind, value)
        return F.max_by(value, F.when(value.isNotNull(), place))

    stretches = split.groupBy("_part", *keys).agg(*[whole(n, k).alias(f"_s_{n}") for n, (k, _) in values.items()])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = stretches.select(
        F.col("_part").alias("_to"),
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.count("*").over(before).alias("_ahead"),
        *[_reduced(k, F.col(f"_s_{n}")).over(before).alias(f"_c_{n}") for n, (k, _) in values.items()],
    ).where("_ahead > 0")
    # A group has a second stretch at a border of partitions only, so these are few.
    same = F.col("_part") == F.col("_to")
    for key in keys:
        same &= F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    return local.join(carried, same, "left").select(
        *df.columns, *[_joined(k, F.col(f"_c_{n}"), F.col(f"_l_{n}")).alias(n) for n, (k, _) in values.items()]
    )
