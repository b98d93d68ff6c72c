"""Mergeable sketches of distinct values: a batch is read once, any set of batches adds up."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 2 to this power registers: 4,096, 2 to 4 kB a sketch, a standard error of 1.6 %.
PRECISION = 12


def standard_error(precision: int = PRECISION) -> float:
    """Relative standard error of an estimate."""
    return 1.04 / (1 << precision) ** 0.5


def sketched(df: DataFrame, keys: Sequence[str], column: str, precision: int = PRECISION) -> DataFrame:
    """Rows and a sketch of the distinct values of a column per key; nulls are no values.

    The map tasks build the sketches, so a key with very many rows is a few kilobytes per
    task when it reaches the shuffle.
    """
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.hll_sketch_agg(column, precision).alias("sketch")
    )


def merged(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sketches of coarser keys, or of several batches, as one per key."""
    return sketches.groupBy(*keys).agg(F.sum("n_rows").alias("n_rows"), F.hll_union_agg("sketch").alias("sketch"))


def estimated(sketches: DataFrame, name: str) -> DataFrame:
    """The estimate in place of the sketch."""
    kept = [c for c in sketches.columns if c != "sketch"]
    return sketches.select(*kept, F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)).alias(name))


def daily_steps(
    df: DataFrame, steps: Mapping[str, Column], date: str, column: str, precision: int = PRECISION
) -> DataFrame:
    """Per day and filter step the rows left and a sketch of the column's values.

    ``steps`` are conditions in the order they are applied, each after those before it. Days
    are additive: ``merged`` over any of them by step gives the step counts of a period
    without another look at the rows. A row that fails a step is not counted from there on.
    """
    passed, levels = F.lit(True), F.lit(0)
    for condition in steps.values():
        passed = passed & F.coalesce(condition, F.lit(False))
        levels = levels + passed.cast("int")
    names = F.array(*[F.lit(n) for n in steps])
    # One row per day, value and number of steps passed before the steps are spread out.
    cells = df.groupBy(F.col(date).alias("day"), F.col(column).alias("_value"), levels.alias("_passed")).agg(
        F.count("*").alias("_n")
    )
    spread = cells.where("_passed > 0").select(
        "day", "_value", "_n", F.explode(F.sequence(F.lit(1), "_passed")).alias("step_no")
    )
    return spread.groupBy("day", "step_no", F.element_at(names, F.col("step_no")).alias("step")).agg(
        F.sum("_n").alias("n_rows"), F.hll_sketch_agg("_value", precision).alias("sketch")
    )
