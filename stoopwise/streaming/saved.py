"""Incremental upkeep of the saved listings from an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stoopwise.plans.saved import KEY, as_events, key_facts, known_log, state_of
from stoopwise.session import dropped, written
from stoopwise.streaming.violations import read_if_there

# Divisions of the log by key. A batch reads those in which events came late.
DIVISIONS = 1024
# So many batches are read beside the last full copy of the facts.
BATCHES_PER_COPY = 16


def saved_state_stream(
    events: DataFrame,
    properties: DataFrame,
    log: str,
    state: str,
    checkpoint: str,
    divisions: int = DIVISIONS,
    batches_per_copy: int = BATCHES_PER_COPY,
) -> StreamingQuery:
    """Keep ``log`` (all events) and ``state`` (facts per key and batch) up to date, then stop.

    ``events`` is a streaming DataFrame. What decides the state of a key are a few of its
    events, its facts, as long as new events are later than all before them: so a
    micro-batch joins its events to the facts of the keys it touches and writes new ones.
    Only keys with an event that came late are replayed from the log, of which just their
    divisions are read. Facts are copied together now and then, so a batch reads a bounded
    number of folders. Every batch writes its own folders, so one that runs again
    overwrites itself.
    """
    spark = events.sparkSession
    division = F.pmod(F.xxhash64(*KEY), F.lit(divisions)).cast("int")

    def take_in(batch: DataFrame, batch_id: int) -> None:
        new = written(known_log(batch, properties), "new-events")
        new.withColumn("division", division).write.mode("overwrite").partitionBy("division").parquet(
            f"{log}/batch={batch_id}"
        )
        touched = new.groupBy(*KEY).agg(F.min("_at").alias("_first"))
        stored = latest_facts(spark, state, before=batch_id)
        if stored is None:
            key_facts(new).write.mode("overwrite").parquet(f"{state}/facts/batch={batch_id}")
            dropped(new)
            return
        known = written(stored.join(touched, KEY), "touched-facts")
        late = known.where(F.col("_first") <= F.col("_seen")).select(*KEY)
        # At most ``divisions`` numbers, so that the scan skips all other folders.
        found = [r["division"] for r in late.select(division.alias("division")).distinct().collect()]
        timely = as_events(known.where(F.col("_first") > F.col("_seen")))
        concerned = new.unionByName(timely)
        if found:
            history = spark.read.parquet(log).where(
                (F.col("batch") < batch_id) & F.col("division").isin(found)
            )
            old = history.join(late, KEY, "left_semi").select(*new.columns)
            concerned = concerned.unionByName(old)
        facts = key_facts(concerned)
        facts.write.mode("overwrite").parquet(f"{state}/facts/batch={batch_id}")
        if batch_id % batches_per_copy == batches_per_copy - 1:
            whole = latest_facts(spark, state, before=batch_id + 1)
            whole.write.mode("overwrite").parquet(f"{state}/copy/batch={batch_id}")
        dropped(new, known)

    return (
        events.writeStream.foreachBatch(take_in)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_facts(spark: SparkSession, state: str, before: int) -> DataFrame | None:
    """The facts of every key after the last batch before ``before``; None if there is none."""
    rows = read_if_there(spark, f"{state}/facts")
    if rows is None:
        return None
    rows = rows.where(F.col("batch") < before)
    copies = read_if_there(spark, f"{state}/copy")
    if copies is not None:
        copies = copies.where(F.col("batch") < before)
        last = copies.agg(F.max("batch")).first()[0]
        if last is not None:
            rows = rows.where(F.col("batch") > last).unionByName(copies.where(F.col("batch") == last))
    if rows.isEmpty():
        return None
    latest = rows.groupBy(*KEY).agg(F.max("batch").alias("batch"))
    return rows.join(latest, [*KEY, "batch"], "left_semi").drop("batch")


def current_state(spark: SparkSession, state: str) -> DataFrame | None:
    """The saved row of every key; None before the first batch."""
    facts = latest_facts(spark, state, before=1 << 31)
    return None if facts is None else state_of(facts)
