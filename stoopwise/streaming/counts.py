"""Profiles of the violations, kept up to date from a stream of new ones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from stoopwise.operators.counts import BATCHES_PER_COPY, CountStore

PROFILES = {
    "codes": ["violation_description", "violation_code"],
    "categories": ["inspection_category"],
    "statuses": ["inspection_number", "violation_status"],
    "days": ["inspection_number", "violation_date"],
}


def count_stream(
    violations: DataFrame,
    root: str,
    checkpoint: str,
    tables: Mapping[str, Sequence[str]] = PROFILES,
    batches_per_copy: int = BATCHES_PER_COPY,
) -> StreamingQuery:
    """Add all violations that arrived since the last run to the counts, then stop.

    ``violations`` is a streaming DataFrame of new rows, each given once. Nothing that was
    counted before is scanned again.
    """
    store = CountStore(violations.sparkSession, root, tables, batches_per_copy)
    return (
        violations.writeStream.foreachBatch(store.add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
