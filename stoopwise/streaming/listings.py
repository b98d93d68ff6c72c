"""Saved listings kept in a state store: per user and address what decides the row, no log.

Each group of a stateful processor asks for its state over a socket and answers with an Arrow
batch of its own, so groups are buckets of listings, whose state is read and written together.
"""

from __future__ import annotations

import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from stoopwise.functions import text
from stoopwise.plans.saved import KEY
from stoopwise.streaming.seen import ROCKS, STORE

# How far an event may lag behind the latest one of its listing.
DELAY = datetime.timedelta(days=3)

# Listings are dealt over so many buckets by their hash. A checkpoint goes with this number.
BUCKETS = 2048

# Stands for a null time or id: before all others, as nulls are in a sort.
NOWHERE = -(2**63)

DETAILS = ["custom_name", "remarks", "rent"]


def _fields(kinds: dict[T.DataType, str]) -> list[T.StructField]:
    return [T.StructField(name, kind) for kind, names in kinds.items() for name in names.split()]


FACTS = T.StructType(
    _fields(
        {
            T.BooleanType(): "is_settled is_saved is_deleted is_updated",
            T.LongType(): "version settled_at settled_id first_at first_id saved_at deleted_at updated_at updated_id",
            T.StringType(): " ".join(DETAILS),
        }
    )
)
# ``listing`` is the listing's position among those of its bucket.
PLACE = T.StructType(_fields({T.IntegerType(): "listing", T.LongType(): "at id", T.BooleanType(): "is_save"}))
EMPTY = dict.fromkeys(FACTS.names) | {"version": 0} | dict.fromkeys(["is_settled", "is_saved", "is_deleted", "is_updated"], False)

# What is kept per bucket. Keys are texts, so that pandas leaves them as they are.
KEPT = T.StructType([T.StructField("listings", T.ArrayType(T.StructType([*_fields({T.StringType(): " ".join(KEY)}), *FACTS])))])

# What the processor gives: a listing as it is now, or a late event.
TOLD = T.StructType(
    [
        *_fields({T.StringType(): " ".join(KEY)}),
        T.StructField("version", T.LongType()),
        T.StructField("late", T.BooleanType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("saved_at", T.LongType()),
        T.StructField("is_deleted", T.BooleanType()),
        T.StructField("deleted_at", T.LongType()),
        *_fields({T.StringType(): " ".join(DETAILS)}),
    ]
)
# What it gets of an event: nulls in texts only, no name that begins with an underscore, which
# the frames would not keep. The mark is 1 for a save and 0 for a delete.
COMING = [*KEY, "at", "id", "mark", *DETAILS]
UPDATE = 2


def _moved(facts: dict, at: int, number: int, is_save: bool) -> None:
    """What a save or a delete makes of the listing."""
    if is_save and not facts["is_saved"]:
        facts.update(is_saved=True, first_at=at, first_id=number, saved_at=at)
    elif is_save and facts["is_deleted"]:
        facts.update(is_deleted=False, deleted_at=None, saved_at=at)
    elif not is_save and facts["is_saved"] and not facts["is_deleted"]:
        facts.update(is_deleted=True, deleted_at=at)


class Listings(StatefulProcessor):
    """A bucket of listings: of each the outcome of what is settled, and the places of what is not yet.

    Of updates only the last counts, in whatever order they come, so one is held. Saves
    and deletes depend on their order: those within the delay before the listing's latest
    one are held as places (a time, an id, a mark), older ones are run through and
    forgotten. Rows pass in frames of a bounded number; what a batch holds of a listing is
    a place per save or delete, never its texts. A listing stays at its position.
    """

    def __init__(self, delay: datetime.timedelta):
        self.delay = delay // datetime.timedelta(microseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.facts = handle.getValueState("facts", KEPT)
        self.places = handle.getListState("places", PLACE)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803 - names of the interface
        stored = self.facts.get()
        listings = [tuple(r) for r in stored[0]] if stored else []
        width = len(KEY)
        position = {r[:width]: i for i, r in enumerate(listings)}
        places = {}
        for i, *place in self.places.get() if stored else ():
            places.setdefault(i, set()).add(tuple(place))
        touched, told = {}, []
        for row in (r for frame in rows for r in frame[COMING].itertuples(index=False, name=None)):
            listing, place, mark = row[:width], row[width : width + 2], row[width + 2]
            i = position.setdefault(listing, len(listings))
            if i == len(listings):
                listings.append((*listing, *EMPTY.values()))
            if i not in touched:
                touched[i] = dict(zip(FACTS.names, listings[i][width:], strict=True))
            facts = touched[i]
            if mark == UPDATE:
                if not facts["is_updated"] or place > (facts["updated_at"], facts["updated_id"]):
                    facts.update(is_updated=True, updated_at=place[0], updated_id=place[1])
                    facts.update(zip(DETAILS, row[width + 3 :], strict=True))
            elif facts["is_settled"] and place <= (facts["settled_at"], facts["settled_id"]):
                told.append((*listing, None, True, place[1], *[None] * 6))
            else:
                places.setdefault(i, set()).add((*place, bool(mark)))
        for i, facts in touched.items():
            ordered = sorted(places.get(i, ()))
            horizon = ordered[-1][0] - self.delay if ordered else NOWHERE
            held = [p for p in ordered if p[0] >= horizon]
            for at, number, is_save in ordered[: len(ordered) - len(held)]:
                _moved(facts, at, number, is_save)
                facts.update(is_settled=True, settled_at=at, settled_id=number)
            facts["version"] += 1
            listing = listings[i][:width]
            listings[i] = (*listing, *[facts[n] for n in FACTS.names])
            places[i] = held
            now = dict(facts)
            for place in held:
                _moved(now, *place)
            if now["is_saved"]:
                counts = now["is_updated"] and (now["updated_at"], now["updated_id"]) > (now["first_at"], now["first_id"])
                details = [now[n] if counts else None for n in DETAILS]
                told.append((*listing, now["version"], False, None, now["saved_at"], now["is_deleted"], now["deleted_at"], *details))
        self.facts.update((listings,))
        unsettled = [(i, *place) for i, held in places.items() for place in held]
        if unsettled:
            self.places.put(unsettled)
        if told:
            # As objects, for whole numbers beside nulls would become inexact.
            yield pd.DataFrame(told, columns=TOLD.names, dtype=object)

    def close(self) -> None:
        pass


def keep_listings(
    events: DataFrame, properties: DataFrame, target: str, checkpoint: str, delay: datetime.timedelta = DELAY
) -> StreamingQuery:
    """Take in the events that landed since the last run, then stop.

    ``events`` is a streaming DataFrame with the columns of ``plans.saved.saved_state``;
    ``event_id`` is a whole number, no two events of a listing share time and id, and ``ts``
    is a timestamp. Nulls in both come first. A repeated event changes nothing.

    Events may come in any order as long as a save or delete lags behind the latest one of
    its own listing by at most ``delay``. One that comes later still, and is not after all
    that is settled, is not guessed at: it leaves the listing as it is and becomes a row of
    ``late_events``. Updates are right however late they come. No batch reads
    a log or the target: state is a row of facts and the places within the delay, per
    listing, in RocksDB, and ``target`` gets a row for each listing a batch touched.
    State is read and written by bucket of listings, the buckets that a batch touches: a
    batch of few events writes the other listings of their buckets again.
    Batches that run again add nothing twice, for the sink records the files of those that
    ended. A busy listing passes through one task, as much of it as a batch takes in, so
    bound batches at the source (``maxFilesPerTrigger``); ``saved_state_stream`` has no such key.
    The number of shuffle partitions at the first start stays.
    """
    spark = events.sparkSession
    if spark.conf.get(STORE, None) != ROCKS:
        spark.conf.set(STORE, ROCKS)
    time = events.schema["ts"].dataType
    known = properties.select(F.upper("address").alias("address")).distinct()
    asked = events.where(F.col("action").isin("save", "delete", "update")).withColumn("address", F.upper("address"))
    updates = F.col("action") == "update"
    rows = asked.join(known, "address", "left_semi").select(
        F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS)).cast("int").alias("bucket"),
        *[F.col(c).cast("string").alias(c) for c in KEY],
        F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(NOWHERE)).alias("at"),
        F.coalesce(F.col("event_id").cast("long"), F.lit(NOWHERE)).alias("id"),
        F.when(updates, UPDATE).otherwise((F.col("action") == "save").cast("int")).alias("mark"),
        *[F.when(updates, F.col(c).cast("string")).alias(c) for c in DETAILS],
    )
    kept = rows.groupBy("bucket").transformWithStateInPandas(Listings(delay), TOLD, outputMode="Append", timeMode="None")

    def somewhere(name: str) -> Column:
        return F.when(F.col(name) != NOWHERE, F.col(name))

    shown = kept.select(
        *[F.col(c).cast(asked.schema[c].dataType).alias(c) for c in KEY],
        "version",
        "late",
        somewhere("event_id").alias("event_id"),
        F.timestamp_micros(somewhere("saved_at")).cast(time).alias("date_saved"),
        "is_deleted",
        F.timestamp_micros(somewhere("deleted_at")).cast(time).alias("deleted_at"),
        "custom_name",
        "remarks",
        text.blank_to_null(F.col("rent")).try_cast("int").alias("rent_price"),
    )
    sink = shown.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    return sink.trigger(availableNow=True).start()


def listings_now(spark: SparkSession, target: str) -> DataFrame:
    """The saved row of every listing: the one its last batch wrote."""
    rows = spark.read.parquet(target).where("NOT late").drop("late", "event_id")
    shown = [c for c in rows.columns if c not in (*KEY, "version")]
    last = rows.groupBy(*KEY).agg(F.max_by(F.struct(*shown), "version").alias("_last"))
    return last.select(*KEY, "_last.*")


def late_events(spark: SparkSession, target: str) -> DataFrame:
    """Key and event_id of the saves and deletes that came too late to be put in their place."""
    return spark.read.parquet(target).where("late").select(*KEY, "event_id")
