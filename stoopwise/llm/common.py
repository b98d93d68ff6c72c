"""Small helpers that several operators share."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space that the contracts name, and what is between it.
WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

# A side of a join is broadcast only when its counted rows stay within this bound;
# at some 50 bytes a row that is at most 100 MB in an executor.
BROADCAST_ROWS = 2_000_000


def text_of(column: str | Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def crc_remainder(column: str, divisor: int) -> Column:
    """crc32 of a value written as text, modulo ``divisor``; a null value counts as empty."""
    written = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(written.cast("binary")) % divisor


def bounded(table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written narrow table, to be broadcast if its counted rows are within the bound.

    Beyond it the table comes back as it is, and the join shuffles.
    """
    return F.broadcast(table) if table.count() <= most else table


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or it with underscores in front if the table has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


# Rows that Python operators take from a record batch at once.
ROWS_AT_ONCE = 512


def few_at_a_time(batches, most: int = ROWS_AT_ONCE):
    """Record batches of few rows; memory that is free at the end goes back to the machine.

    Python workers are used again by later stages, which would find it taken.
    """
    for batch in batches:
        for start in range(0, batch.num_rows, most):
            yield batch.slice(start, most)
    give_back()


def give_back() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this library's code to the executors, once per application.

    Spark serves the archive from the driver and sends it to executors that join later.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    above = os.path.dirname(package)
    path = os.path.join(tempfile.mkdtemp(prefix="stoopwise-code-"), "stoopwise_code.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, above))
    context.addPyFile(path)
