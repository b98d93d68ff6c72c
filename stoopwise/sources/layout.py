"""Violations in a layout from which filters read few row groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of a file at most, and bytes of a row group.
ROWS_PER_FILE = 4_000_000
# Rows that a task sorts at most, so that it need not spill; a task writes a file.
ROWS_PER_SORT = 1_000_000
ROW_GROUP_BYTES = 16 * 1024 * 1024
# Side of a cell in degrees.
CELL = 0.01


def write_violations(
    df: DataFrame,
    path: str,
    looked_up: Sequence[str] = ("violation_id", "address"),
    rows_per_file: int = ROWS_PER_FILE,
    row_group_bytes: int = ROW_GROUP_BYTES,
) -> None:
    """Write violations in ranges of month and cell, with bloom filters on looked-up columns.

    Files and row groups then hold a short stretch of days and places, whose least and
    greatest values let a scan pass over the others; a lookup by id or address asks the
    bloom filters. Rows are dealt by date, place and id, so that a month or a cell with a
    large share of the rows is cut into many files. Null dates and places come first.
    """
    files = max(1, -(-df.count() // min(rows_per_file, ROWS_PER_SORT)))
    by = [
        F.trunc("violation_date", "month"),
        F.floor(F.col("latitude") / CELL),
        F.floor(F.col("longitude") / CELL),
        F.col("violation_date"),
        F.col("violation_id"),
    ]
    options = {"parquet.block.size": str(row_group_bytes), "maxRecordsPerFile": str(2 * rows_per_file)}
    for name in looked_up:
        options[f"parquet.bloom.filter.enabled#{name}"] = "true"
        options[f"parquet.bloom.filter.expected.ndv#{name}"] = str(min(rows_per_file, row_group_bytes // 16))
    df.repartitionByRange(files, *by).sortWithinPartitions(*by).write.options(**options).parquet(path)


def with_values(spark: SparkSession, path: str, column: str, values: Sequence[str]) -> DataFrame:
    """Rows whose column is one of the values; the condition reaches the bloom filters."""
    return spark.read.parquet(path).where(F.col(column).isin(*values))
