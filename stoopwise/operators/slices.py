"""A stored table in slices, so that only one slice's shuffle files lie on disk at a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A table of fewer rows is one slice. Each slice reads the whole table, so they are few.
SLICE_ROWS = 1_000_000
SLICES = 4


def slices(table: DataFrame, keys: Sequence[str]) -> list[DataFrame]:
    """All rows of a table at rest, those of a key in one slice; nulls are a key."""
    n = max(1, min(SLICES, table.count() // SLICE_ROWS))
    if n == 1:
        return [table]
    return [table.where(F.pmod(F.xxhash64(*keys), F.lit(n)) == k) for k in range(n)]
