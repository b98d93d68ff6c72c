"""Streaming queries: landed files are taken in and the outcome is read back."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoopwise.catalog import amenities as amenity_queries
from stoopwise.catalog import profiles
from stoopwise.catalog.feeds import VIOLATION_FIELDS
from stoopwise.catalog.registry import Given, query
from stoopwise.catalog.saved import STATE
from stoopwise.catalog.violations import UNIQUE, as_raw
from stoopwise.session import drop_path, dropped, new_path, shuffles_go, written
from stoopwise.operators import profile
from stoopwise.operators.counts import CountStore, distinct_from
from stoopwise.operators.slices import slices
from stoopwise.sources import writers
from stoopwise.streaming.counts import PROFILES, count_stream
from stoopwise.streaming.listings import DELAY, keep_listings, listings_now
from stoopwise.streaming.refresh import latest_snapshot, refresh_groceries_stream
from stoopwise.streaming.seen import ingest_unseen
from stoopwise.streaming.saved import current_state, saved_state_stream
from stoopwise.streaming.violations import ingest_violations_stream


# Rows of one landed file; files are read whole, one per task.
LANDED_ROWS = 250_000


def _land(t: Given, path: str) -> int:
    """Violations as files of a bounded number of rows, four at least; returns how many files.

    Rows of one id land in one file, so that which of them is first does not depend on the
    order of the files. Text with so many repeats and empty fields lands compressed; a file
    is read whole either way.
    """
    # The ranges are sampled from the written rows, not from their join once more.
    rows = written(t.v_violations, "violations", compression="zstd")
    parts = slices(rows, ["violation_id"])
    files = max(4, -(-rows.count() // LANDED_ROWS))
    each = -(-files // len(parts))
    for part in parts:
        # Typed rows are shuffled, not their text.
        dealt = part.repartitionByRange(each, "violation_id")
        with shuffles_go(t.spark):
            writers.write_csv(as_raw(dealt), path, mode="append", compression="gzip")
    dropped(rows)
    return each * len(parts)


# Rows of one landed table file; three batches take them in.
FILE_ROWS = 1_000_000


def _landed(rows: DataFrame, path: str, *by: str) -> int:
    """Rows as files of a bounded number of rows, three at least; returns the files of a third."""
    files = 3 * max(1, -(-rows.count() // (3 * FILE_ROWS)))
    rows.repartition(files, *by).write.parquet(path)
    return files // 3


@query("T1 U3 S1 S13", sql=f"SELECT {', '.join(VIOLATION_FIELDS)} FROM ({UNIQUE}) u")
def violations_stream(t: Given) -> DataFrame:
    base = new_path(t.spark, "violations-stream")
    files = _land(t, f"{base}/in")
    ingest_violations_stream(
        t.spark, f"{base}/in", f"{base}/out", f"{base}/dead", f"{base}/progress",
        max_files=-(-files // 2), divisions=files,
    ).awaitTermination()
    for done in ("in", "progress"):
        drop_path(t.spark, f"{base}/{done}")
    return t.spark.read.parquet(f"{base}/out").select(VIOLATION_FIELDS)


STORED = "SELECT violation_id FROM {v_violations} WHERE inspection_category = 'PERIODIC'"


@query(
    "T1 U3 seen ids in a state store",
    sql=f"SELECT {', '.join(VIOLATION_FIELDS)} FROM ({UNIQUE}) u WHERE violation_id NOT IN ({STORED})",
)
def violations_unseen(t: Given) -> DataFrame:
    base = new_path(t.spark, "violations-unseen")
    files = _land(t, f"{base}/in")
    begun = ingest_unseen(
        t.spark, f"{base}/in", t.sql(STORED), f"{base}/out", f"{base}/dead", f"{base}/progress", max_files=-(-files // 2)
    )
    # The first query alone reads the landed files.
    next(begun).awaitTermination()
    drop_path(t.spark, f"{base}/in")
    for rest in begun:
        rest.awaitTermination()
    drop_path(t.spark, f"{base}/progress")
    return t.spark.read.parquet(f"{base}/out").select(VIOLATION_FIELDS)


@query("T3", sql=f"WITH {STATE} SELECT * FROM state")
def saved_state_streamed(t: Given) -> DataFrame:
    base = new_path(t.spark, "saved-stream")
    events = t.v_saved_events
    # Three batches, so that the keys are touched by several.
    files = _landed(events, f"{base}/in", "event_id")
    stream = (
        t.spark.readStream.schema(events.schema)
        .option("maxFilesPerTrigger", files)
        .parquet(f"{base}/in")
    )
    saved_state_stream(
        stream, t.v_properties, f"{base}/log", f"{base}/state", f"{base}/progress", divisions=8, batches_per_copy=2
    ).awaitTermination()
    return current_state(t.spark, f"{base}/state")


@query("T3 state store", sql=f"WITH {STATE} SELECT * FROM state")
def saved_state_stored(t: Given) -> DataFrame:
    base = new_path(t.spark, "saved-store")
    events = t.v_saved_events
    # Three spans of time land one after the other, events up to two days late, and each is a
    # start of its own.
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    if first is None:
        first = last = datetime.datetime(2000, 1, 1)
    second, third = first + (last - first) / 3, first + (last - first) / 3 * 2
    landed = F.col("ts") + F.make_dt_interval(days=F.pmod(F.hash("event_id"), F.lit(3)))
    span = F.coalesce((landed >= second).cast("int") + (landed >= third).cast("int"), F.lit(0))
    for i in range(3):
        events.where(span == i).write.mode("append").parquet(f"{base}/in")
        stream = t.spark.readStream.schema(events.schema).parquet(f"{base}/in")
        keep_listings(stream, t.v_properties, f"{base}/out", f"{base}/progress", DELAY).awaitTermination()
    return listings_now(t.spark, f"{base}/out")


@query(
    "T2 Q9 U5",
    sql=f"WITH {amenity_queries.SYNC} SELECT * EXCLUDE (action) FROM merged WHERE action <> 'delete'",
)
def grocery_refresh(t: Given) -> DataFrame:
    base = new_path(t.spark, "grocery-refresh")
    writers.replace_table(t.sql(amenity_queries.STORED), f"{base}/first")
    writers.write_listing(amenity_queries.features(t), f"{base}/listing", f"{base}/in", F.col("feature"))
    refresh_groceries_stream(
        t.spark, f"{base}/in", f"{base}/first", f"{base}/table", f"{base}/progress"
    ).awaitTermination()
    return latest_snapshot(t.spark, f"{base}/first", f"{base}/table")


def _kept_counts(t: Given) -> CountStore:
    """The counts after three batches of violations."""
    base = new_path(t.spark, "counts-stream")
    rows = t.v_violations.select(*sorted({c for columns in PROFILES.values() for c in columns}))
    files = _landed(rows, f"{base}/in")
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{base}/in")
    count_stream(stream, f"{base}/counts", f"{base}/progress", batches_per_copy=2).awaitTermination()
    return CountStore(t.spark, f"{base}/counts", PROFILES, batches_per_copy=2)


@query("Q6 W2 W3 W4 W5 W6 kept up to date", sql=f"{profiles.CATALOGUE} SELECT * FROM catalogue")
def code_catalogue_kept_up(t: Given) -> DataFrame:
    pairs = _kept_counts(t).read("codes").withColumnRenamed("n", "n_violations")
    return profile.catalogue_of(pairs, *PROFILES["codes"])


@query("A4 Q16 kept up to date", sql="""SELECT inspection_number, count(DISTINCT violation_status) AS n_status
FROM {v_violations} GROUP BY inspection_number""")
def statuses_kept_up(t: Given) -> DataFrame:
    return distinct_from(_kept_counts(t).read("statuses"), "inspection_number", "violation_status", "n_status")


@query("A5 Q16 kept up to date", sql="""SELECT inspection_number, count(DISTINCT violation_date) AS n_days,
  count(DISTINCT strftime(violation_date, '%Y-%m')) AS n_months
FROM {v_violations} GROUP BY inspection_number HAVING n_months > 1""")
def months_kept_up(t: Given) -> DataFrame:
    return profile.days_and_months(_kept_counts(t).read("days"), "inspection_number", "violation_date")
