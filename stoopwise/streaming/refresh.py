"""Periodic refresh of the grocery amenities from landed feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stoopwise import schemas
from stoopwise.operators.merge import changes, snapshot
from stoopwise.plans.amenities import grocery_sync, stage_groceries
from stoopwise.streaming.violations import read_if_there

COLUMNS = ["address", "type", "name", "lon", "lat"]


def refresh_groceries_stream(
    spark: SparkSession, source: str, first: str, table: str, checkpoint: str
) -> StreamingQuery:
    """Stage each listing that landed since the last run, synchronise, then stop.

    A file in ``source`` is a full listing, with one feature per line; or it names, as
    ``folder``, a folder with the listing's part files, which many tasks read. Listings
    are taken in one by one in the order their files landed, so that a store missing in
    the last one is gone. ``first`` is the table before the first refresh; each refresh
    writes its own snapshot and change log below ``table`` and builds on the one before it.
    """
    feature = schemas.GROCERY_FEED.replace(": struct", " struct")
    feed = (
        spark.readStream.schema(f"type string, {feature}, folder string")
        .option("maxFilesPerTrigger", 1)
        .json(source)
        .select(F.struct("geometry", "properties").alias("feature"), "folder")
    )

    def listed(batch: DataFrame) -> DataFrame:
        rows = batch.where("folder IS NULL").select("feature")
        folders = [row["folder"] for row in batch.where("folder IS NOT NULL").select("folder").distinct().collect()]
        if not folders:
            return rows
        parts = spark.read.schema(f"type string, {feature}").json(folders)
        return rows.unionAll(parts.select(F.struct("geometry", "properties").alias("feature")))

    def take_in(batch: DataFrame, batch_id: int) -> None:
        before = latest_snapshot(spark, first, table, before=batch_id)
        merged = grocery_sync(before, stage_groceries(listed(batch)))
        # Both outputs come from the same join: it is written once and read twice.
        path = f"{table}/merged/batch={batch_id}"
        merged.write.mode("overwrite").parquet(path)
        written = spark.read.parquet(path)
        changes(written).write.mode("overwrite").parquet(f"{table}/changes/batch={batch_id}")
        snapshot(written).write.mode("overwrite").parquet(f"{table}/snapshot/batch={batch_id}")

    return (
        feed.writeStream.foreachBatch(take_in)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_snapshot(
    spark: SparkSession, first: str, table: str, before: int | None = None
) -> DataFrame:
    """The amenities after the last refresh, or after the last one before a batch."""
    rows = read_if_there(spark, f"{table}/snapshot")
    if rows is not None and before is not None:
        rows = rows.where(F.col("batch") < before)
    last = rows.agg(F.max("batch")).first()[0] if rows is not None else None
    if last is None:
        return spark.read.parquet(first).select(*COLUMNS)
    return rows.where(F.col("batch") == last).select(*COLUMNS)
