"""What each request to save, delete or update a listing came to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoopwise.operators.running import running_before
from stoopwise.operators.skew import salted_join
from stoopwise.params import ROWS_PER_TASK

ABSENT, ACTIVE, DELETED = "absent", "active", "deleted"


def event_outcomes(events: DataFrame, properties: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """One row per event: state of its listing before and after, outcome and status.

    ``events`` has event_id, ts, user_id, address, action; a listing is a user and an
    address in any case, and its events follow each other by (ts, event_id).

    An event is a function on the states absent, active and deleted. A save makes any of
    them active, a delete makes active deleted, an update changes none. Composed, any
    number of events comes to two facts: whether there was a save, and which of save and
    delete was last. So the state before an event is a running value, and a listing with
    a third of all events is cut over partitions like any other.

    A save of an address that is no property, a request without an address or a user, and
    a delete or update of a listing that is not there are refused and change nothing.
    """
    known = properties.select(F.upper("address").alias("_address")).distinct().withColumn("_known", F.lit(True))
    asked = events.select(
        "event_id", "ts", "user_id", F.upper("address").alias("_address"), "action",
    )
    found = salted_join(asked, known, ["_address"], salt_by=["event_id"], how="left", rows_per_task=rows_per_task)
    named = F.coalesce(F.col("_address"), F.lit("")) != ""
    valid = F.col("user_id").isNotNull() & named & F.coalesce("_known", F.lit(False))
    rows = found.select("event_id", "ts", "user_id", F.col("_address").alias("address"), "action", valid.alias("_valid"))
    change = F.when(F.col("_valid") & F.col("action").isin("save", "delete"), F.col("action"))
    saves = F.when(F.col("_valid") & (F.col("action") == "save"), 1)
    ran = running_before(
        rows, ["user_id", "address"], ["ts", "event_id"],
        {"_change": ("last", change), "_saves": ("max", saves)}, rows_per_task,
    )
    before = F.when(F.col("_saves").isNull(), ABSENT).when(F.col("_change") == "save", ACTIVE).otherwise(DELETED)
    state, action = F.col("state_before"), F.col("action")
    refused = (
        F.when(F.col("user_id").isNull(), "sign-in required")
        .when((action == "delete") & (F.coalesce("address", F.lit("")) == ""), "address required")
        .when((action == "save") & ~F.col("_valid"), "unknown property")
        .when((action == "delete") & (state != ACTIVE), "not saved")
        .when((action == "update") & (state == ABSENT), "not saved")
        .when(~F.coalesce(action.isin("save", "delete", "update"), F.lit(False)), "unknown action")
    )
    done = (
        F.when(action == "update", "updated")
        .when(action == "delete", "deleted")
        .when(state == ABSENT, "saved")
        .when(state == DELETED, "restored")
        .otherwise("nothing to do")
    )
    after = (
        F.when(F.col("outcome").isin("saved", "restored"), ACTIVE).when(F.col("outcome") == "deleted", DELETED).otherwise(state)
    )
    status = (
        F.when(F.col("outcome") == "sign-in required", 401)
        .when(F.col("outcome") == "not saved", 404)
        .when(F.col("outcome").isin("unknown property", "address required", "unknown action"), 400)
        .otherwise(200)
    )
    return (
        ran.withColumn("state_before", before)
        .withColumn("outcome", F.coalesce(refused, done))
        .select("event_id", "user_id", "address", "action", "state_before", after.alias("state_after"), "outcome", status.alias("status"))
    )
