"""Counts and rankings that profile a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first; rows without a value are left out."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), column)
    )


def distinct_per_key(df: DataFrame, key: str, other: str, name: str) -> DataFrame:
    """Distinct values of one column per value of another.

    Distinct pairs come first, so a frequent key is thinned out before it is counted.
    """
    pairs = df.select(key, other).distinct()
    return pairs.groupBy(key).agg(F.count(other).alias(name))


def ambiguous_keys(df: DataFrame, key: str, other: str) -> DataFrame:
    """Keys that go with more than one value of the other column."""
    return distinct_per_key(df, key, other, "n").where("n > 1").select(key)


def days_and_months(df: DataFrame, key: str, date: str) -> DataFrame:
    """Keys spread over more than one month, with their days and months."""
    days = df.select(key, date).distinct()
    months = days.groupBy(key, F.date_format(date, "yyyy-MM").alias("_month")).agg(
        F.count(date).alias("_days")
    )
    return (
        months.groupBy(key)
        .agg(F.sum("_days").alias("n_days"), F.count("_month").alias("n_months"))
        .where("n_months > 1")
    )


def distinct_count(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(count(column).alias("n"))


def code_catalogue(
    df: DataFrame,
    description: str = "violation_description",
    code: str = "violation_code",
) -> DataFrame:
    """Every description and code with codes per description, rows, and group priority.

    The window counts of the raw rows depend only on the pair, so everything is
    computed from the grouped pairs. The rank runs over the distinct largest counts
    alone: d different counts need at least d * (d + 1) / 2 rows, so even a trillion
    rows leave about a million values for its single task.
    """
    return catalogue_of(df.groupBy(description, code).agg(F.count("*").alias("n_violations")), description, code)


def catalogue_of(pairs: DataFrame, description: str, code: str) -> DataFrame:
    """The catalogue from rows per description and code, ``n_violations``."""
    groups = pairs.groupBy(description).agg(
        F.count(code).alias("n_code_per_desc"), F.max("n_violations").alias("_largest")
    )
    ranks = (
        groups.select("_largest")
        .distinct()
        .withColumn(
            "group_priority", F.dense_rank().over(Window.orderBy(F.desc("_largest"))).cast("long")
        )
    )
    # Most groups share the smallest counts; the planner broadcasts the ranks if they are few.
    ranked = groups.join(ranks, "_largest").alias("g")
    return (
        pairs.alias("p")
        .join(ranked, F.col(f"p.{description}").eqNullSafe(F.col(f"g.{description}")))
        .select(
            F.col("group_priority"),
            F.col(f"p.{description}"),
            F.col(f"p.{code}"),
            F.col("n_code_per_desc"),
            F.col("n_violations"),
        )
        .orderBy("group_priority", description, F.desc("n_violations"), code)
    )


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table with its row count."""
    counted = [
        df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        for name, df in tables.items()
    ]
    out = counted[0]
    for one in counted[1:]:
        out = out.unionByName(one)
    return out


def preview(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows in key order."""
    return df.orderBy(*order).limit(n)
