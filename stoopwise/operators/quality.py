"""Step counts and rule checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def observed(df: DataFrame, step: str, address: str = "address") -> tuple[DataFrame, Observation]:
    """Attach row and (approximate) address counts to a step without a second pass."""
    seen = Observation(step)
    return df.observe(
        seen,
        F.count("*").alias("n_rows"),
        F.approx_count_distinct(address).alias("n_addresses"),
    ), seen


def step_counts(
    df: DataFrame, steps: dict[str, Column], address: str = "address"
) -> DataFrame:
    """Rows and exact distinct addresses left after each step of a filter chain.

    ``steps`` maps a name to the condition that step adds. All steps are counted in
    one pass: rows per address first, then the addresses with any row left.
    """
    passed, kept = F.lit(True), {}
    for name, condition in steps.items():
        passed = passed & F.coalesce(condition, F.lit(False))
        kept[name] = passed
    per_address = df.groupBy(address).agg(
        *[F.count_if(condition).alias(name) for name, condition in kept.items()]
    )
    totals = per_address.agg(
        *[F.sum(name).alias(f"{name}_rows") for name in kept],
        *[
            F.count_if((F.col(name) > 0) & F.col(address).isNotNull()).alias(f"{name}_addresses")
            for name in kept
        ],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("step_no"),
                F.lit(name).alias("step"),
                F.col(f"{name}_rows").alias("n_rows"),
                F.col(f"{name}_addresses").alias("n_addresses"),
            )
            for i, name in enumerate(kept, 1)
        ]
    )
    return totals.select(F.explode(rows).alias("r")).select("r.*")


def not_null(column: str) -> Column:
    return F.col(column).isNotNull()


def fits(column: str, length: int) -> Column:
    return F.coalesce(F.length(column) <= length, F.lit(True))


def allowed(column: str, values: Iterable[str]) -> Column:
    return F.coalesce(F.col(column).isin(*values), F.lit(False))


def broken_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows breaking each rule, all rules in one aggregate."""
    counts = df.agg(*[F.count_if(~rule).alias(name) for name, rule in rules.items()])
    rows = F.array(
        *[F.struct(F.lit(r).alias("rule"), F.col(r).alias("bad_rows")) for r in rules]
    )
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def compare_counts(source: DataFrame, target: DataFrame) -> DataFrame:
    """Row counts of two tables side by side, one row."""
    both = source.select(F.lit("source").alias("side")).unionByName(
        target.select(F.lit("target").alias("side"))
    )
    return both.agg(
        F.count_if(F.col("side") == "source").alias("source_rows"),
        F.count_if(F.col("side") == "target").alias("target_rows"),
    ).withColumn("equal", F.col("source_rows") == F.col("target_rows"))
