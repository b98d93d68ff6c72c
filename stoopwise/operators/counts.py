"""Counts that are kept up to date by adding batches, and what is read from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stoopwise.session import dropped, written
from stoopwise.streaming.violations import read_if_there

# So many batches are read beside the last full copy.
BATCHES_PER_COPY = 16


class CountStore:
    """Rows per combination of columns, one small table per batch and a full copy now and then.

    ``tables`` names the counts and the columns each is grouped by; a null is a value.
    Counts add up, so a batch is reduced on its own, in the map tasks first, and what is
    stored is never read for it. A batch has a folder of its number: one that runs again
    overwrites itself. ``weight`` of a row is 1 unless it is told; -1 takes a row back, and
    combinations whose count is 0 are not read. Every ``batches_per_copy`` batches the sums
    so far are written together, so reading takes a bounded number of folders.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        tables: Mapping[str, Sequence[str]],
        batches_per_copy: int = BATCHES_PER_COPY,
    ):
        self.spark, self.root = spark, root.rstrip("/")
        self.tables = {name: list(columns) for name, columns in tables.items()}
        self.batches_per_copy = batches_per_copy

    def add(self, batch: DataFrame, batch_id: int, weight: Column | None = None) -> None:
        """Take in one batch; batches come in the order of their numbers."""
        used = sorted({c for columns in self.tables.values() for c in columns})
        worth = F.lit(1) if weight is None else weight
        # Grouped by all columns once, so that the tables read few rows.
        rows = batch.groupBy(*used).agg(F.sum(worth.cast("long")).alias("n"))
        rows = written(rows, "count-batch")
        for name, columns in self.tables.items():
            part = rows.groupBy(*columns).agg(F.sum("n").alias("n"))
            part.write.mode("overwrite").parquet(f"{self.root}/{name}/parts/batch={batch_id}")
        dropped(rows)
        if batch_id % self.batches_per_copy == self.batches_per_copy - 1:
            for name in self.tables:
                whole = self._sums(name, before=batch_id + 1)
                whole.write.mode("overwrite").parquet(f"{self.root}/{name}/copy/batch={batch_id}")

    def _sums(self, name: str, before: int) -> DataFrame | None:
        parts = read_if_there(self.spark, f"{self.root}/{name}/parts")
        if parts is None:
            return None
        parts = parts.where(F.col("batch") < before)
        copies = read_if_there(self.spark, f"{self.root}/{name}/copy")
        if copies is not None:
            # A copy of the batch that is just taken in is about to be written anew.
            copies = copies.where(F.col("batch") < before - 1)
            last = copies.agg(F.max("batch")).first()[0]
            if last is not None:
                parts = parts.where(F.col("batch") > last).unionByName(copies.where(F.col("batch") == last))
        sums = parts.groupBy(*self.tables[name]).agg(F.sum("n").alias("n"))
        return sums.where("n <> 0")

    def read(self, name: str) -> DataFrame | None:
        """Columns and ``n`` over all batches; None before the first one."""
        return self._sums(name, before=1 << 40)


def distinct_from(counts: DataFrame, key: str, other: str, name: str) -> DataFrame:
    """Distinct values of one column per value of another; nulls are not counted."""
    return counts.groupBy(key).agg(F.count_distinct(other).alias(name))
