"""Saved listings: current state from the event log, and the cards shown for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stoopwise.functions import features as ft
from stoopwise.functions import text
from stoopwise.operators.skew import salted_join
from stoopwise.params import ROWS_PER_TASK
from stoopwise.plans.walk import grocery_rollups, transit_rollups
from stoopwise.session import written

KEY = ["user_id", "address"]


def saved_state(
    events: DataFrame, properties: DataFrame, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Current row of every (user, address) from its save, delete and update events.

    ``events`` has event_id, ts, user_id, address, action, custom_name, remarks, rent.
    Replaying the events in order of (ts, event_id) works like this: the first save of
    a known property creates the row, a save of a deleted row restores it, a delete of
    an active row hides it, an update sets the details of any existing row, everything
    else does nothing. So, with all times taken per key:

    * the row exists if there is a save, and is deleted if the last delete is later
      than the last save;
    * ``deleted_at`` is then the first delete after the last save;
    * ``date_saved`` is the first save after the last delete that precedes the last
      save, or the first save at all;
    * the details are those of the last update, if it follows the first save.

    Each is a minimum or maximum, which map tasks reduce before the shuffle, and the
    later ones meet the earlier ones in a salted join: one busy key never has to be
    sorted, or replayed, by a single task.
    """
    # Read several times below, mostly without the details.
    log = written(known_log(events, properties, rows_per_task), "saved-log")
    return state_of(key_facts(log, rows_per_task))


def known_log(
    events: DataFrame, properties: DataFrame, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """The events of known properties, with upper-case addresses and their place ``_at``."""
    known = properties.select(F.upper("address").alias("address")).distinct()
    log = events.withColumn("address", F.upper("address")).withColumn(
        "_at", F.struct("ts", "event_id")
    )
    log = salted_join(
        log, known, ["address"], salt_by=["event_id"], how="left_semi", rows_per_task=rows_per_task
    )
    return log.select(*KEY, "event_id", "_at", "action", "custom_name", "remarks", "rent")


def key_facts(log: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Per key the places of the few events that decide its state, and the last place seen.

    ``log`` has the columns of ``known_log``. A key without a save has no ``_first_save``.
    """
    at, is_save, is_delete = F.col("_at"), F.col("action") == "save", F.col("action") == "delete"
    ends = (
        log.groupBy(*KEY)
        .agg(
            F.min(F.when(is_save, at)).alias("_first_save"),
            F.max(F.when(is_save, at)).alias("_last_save"),
            F.max(F.when(is_delete, at)).alias("_last_delete"),
            F.max(F.when(F.col("action") == "update", at)).alias("_last_update"),
            F.max_by(
                F.struct("custom_name", "remarks", "rent"), F.when(F.col("action") == "update", at)
            ).alias("_details"),
            F.max(at).alias("_seen"),
        )
    )

    def rejoin(action: str, stats: DataFrame) -> DataFrame:
        rows = log.where(F.col("action") == action).select(*KEY, "_at", "event_id")
        return salted_join(rows, stats, KEY, salt_by=["event_id"], rows_per_task=rows_per_task)

    around = (
        rejoin("delete", ends.select(*KEY, "_last_save"))
        .groupBy(*KEY)
        .agg(
            F.min(F.when(at > F.col("_last_save"), at)).alias("_deleted"),
            F.max(F.when(at < F.col("_last_save"), at)).alias("_delete_before"),
        )
    )
    marked = ends.join(around, KEY, "left")
    begun = (
        rejoin("save", marked.select(*KEY, "_delete_before"))
        .where(F.col("_delete_before").isNull() | (at > F.col("_delete_before")))
        .groupBy(*KEY)
        .agg(F.min("_at").alias("_saved"))
    )
    return marked.join(begun, KEY, "left")


def as_events(facts: DataFrame) -> DataFrame:
    """The deciding events of each key, as rows like those of ``known_log``.

    Together with later events they lead to the facts that all events lead to.
    """
    none = F.lit(None).cast("string")

    def event(place: str, action: str, *details) -> Column:
        names = ("custom_name", "remarks", "rent")
        values = [v.alias(n) for n, v in zip(names, details or (none,) * 3, strict=True)]
        return F.struct(F.col(place).alias("_at"), F.lit(action).alias("action"), *values)

    places = F.array(
        *[event(p, "save") for p in ("_first_save", "_saved", "_last_save")],
        *[event(p, "delete") for p in ("_delete_before", "_deleted", "_last_delete")],
        event("_last_update", "update", *[F.col(f"_details.{n}") for n in ("custom_name", "remarks", "rent")]),
    )
    rows = facts.select(*KEY, F.explode(places).alias("_e")).select(*KEY, "_e.*")
    return rows.where("_at IS NOT NULL").select(
        *KEY, F.col("_at.event_id").alias("event_id"), "_at", "action", "custom_name", "remarks", "rent"
    )


def state_of(facts: DataFrame) -> DataFrame:
    """Current rows from the facts; a key that was never saved has none."""
    updated = F.coalesce(F.col("_last_update") > F.col("_first_save"), F.lit(False))
    rent = text.blank_to_null(F.col("_details.rent")).try_cast("int")
    return facts.where("_first_save IS NOT NULL").select(
        *KEY,
        F.col("_saved.ts").alias("date_saved"),
        F.col("_deleted").isNotNull().alias("is_deleted"),
        F.col("_deleted.ts").alias("deleted_at"),
        *[F.when(updated, F.col(f"_details.{c}")).alias(c) for c in ("custom_name", "remarks")],
        F.when(updated, rent).alias("rent_price"),
    )


def known_saves(events: DataFrame, properties: DataFrame) -> DataFrame:
    """Save events of known properties; addresses agree in any case."""
    saves = events.where(F.col("action") == "save").withColumn("address", F.upper("address"))
    known = properties.select(F.upper("address").alias("address")).distinct()
    return salted_join(saves, known, ["address"], salt_by=["event_id"], how="left_semi")


def home_of(saved: DataFrame, properties: DataFrame) -> DataFrame:
    """Saved rows with the id of their property: of equal addresses the lowest id.

    An address that very many users saved is left to the adaptive join.
    """
    lowest = properties.groupBy(F.upper("address").alias("address")).agg(
        F.min("property_id").alias("property_id")
    )
    return saved.join(lowest, "address")


def with_property(saved: DataFrame, properties: DataFrame) -> DataFrame:
    """Saved rows with all columns of their property."""
    return home_of(saved, properties).join(properties.drop("address"), "property_id")


def active(saved: DataFrame) -> DataFrame:
    return saved.where(~F.col("is_deleted"))


def status_checks(
    requests: DataFrame, saved: DataFrame, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Add ``is_saved`` to requests (request_id, user_id, address).

    One (user, address) pair may be asked for very often, so it is spread by request.
    """
    pairs = active(saved).select(*KEY, F.lit(True).alias("_saved"))
    asked = requests.withColumn("_asked", F.col("address")).withColumn(
        "address", F.upper("address")
    )
    joined = salted_join(
        asked, pairs, KEY, salt_by=["request_id"], how="left", rows_per_task=rows_per_task
    )
    error = F.when(F.coalesce("_asked", F.lit("")) == "", "Address required")
    return joined.select(
        "request_id",
        "user_id",
        F.col("_asked").alias("address"),
        F.when(error.isNull(), F.coalesce("_saved", F.lit(False))).alias("is_saved"),
        error.alias("error"),
    )


def saved_cards(listed: DataFrame, stored: DataFrame) -> DataFrame:
    """One card per row of ``listed``, active saved rows as ``home_of`` gives them.

    ``stored`` has a row per property with the stored JSON texts ``bus_stops`` and
    ``groceries``, each parsed once, before the saved rows meet them.
    """
    bus = ft.stored_features(F.col("bus_stops"), "bus_stops_geojson", ft.STOP_FEATURE)
    food = ft.stored_features(F.col("groceries"), "grocery_geojson", ft.GROCERY_FEATURE)
    rolled = stored.select("property_id", bus.alias("_bus"), food.alias("_food")).select(
        "property_id",
        *[c.alias(n) for n, c in transit_rollups(F.col("_bus")).items()],
        *[c.alias(n) for n, c in grocery_rollups(F.col("_food")).items()],
    )
    cards = listed.join(rolled, "property_id")
    return cards.select(
        "user_id",
        "property_id",
        F.col("address").alias("title"),
        text.blank_to_null(F.col("custom_name")).alias("subtitle"),
        text.display_name(F.col("custom_name"), F.col("address")).alias("display_name"),
        F.when(
            F.col("rent_price") != 0, F.concat(F.col("rent_price").cast("string"), F.lit("/month"))
        ).alias("rent"),
        text.blank_to_null(F.col("remarks")).alias("notes"),
        "best_transit",
        "best_grocery",
        "stops_within_5",
        "stops_within_10",
        "stops_within_15",
        "total_stops",
        "routes_count",
        F.concat(F.lit("Saved on "), text.card_date(F.col("date_saved"))).alias("saved_on"),
    )
