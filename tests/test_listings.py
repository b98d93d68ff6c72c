"""Saved listings in a state store, against a replay of all events in order."""

import datetime
import random

from test_saved import START, replay

from stoopwise.session import new_path
from stoopwise.streaming import listings
from stoopwise.streaming.listings import keep_listings, late_events, listings_now

COLUMNS = (
    "event_id int, ts timestamp, user_id int, address string, action string, custom_name string, remarks string, rent string"
)
SHOWN = ["date_saved", "is_deleted", "deleted_at", "custom_name", "rent_price"]


class Store:
    def __init__(self, spark, delay):
        self.spark, self.delay, self.base = spark, delay, new_path(spark, "listings")

    def run(self, rows, files=1):
        """Each call is a start of its own, on what the last one left."""
        frame = self.spark.createDataFrame([(i, t, u, "1 Elm", a, n, None, r) for u, t, i, a, n, r in rows], COLUMNS)
        frame.coalesce(files).write.mode("append").parquet(f"{self.base}/in")
        known = self.spark.createDataFrame([("1 ELM",), ("1 elm",)], "address string")
        stream = self.spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.base}/in")
        keep_listings(stream, known, f"{self.base}/out", f"{self.base}/progress", self.delay).awaitTermination()

    def now(self):
        rows = listings_now(self.spark, f"{self.base}/out").collect()
        return {r["user_id"]: {c: r[c] for c in SHOWN} for r in rows}

    def held(self):
        return self.spark.read.format("statestore").option("stateVarName", "places").load(f"{self.base}/progress").count()


def hour(n):
    return START + datetime.timedelta(hours=n)


def test_batches_out_of_order_equal_the_replay(spark):
    rng = random.Random(5)
    store = Store(spark, datetime.timedelta(hours=14))
    events, batches = {}, [[], [], []]
    for user in range(60):
        # The first has a third of all events.
        for i in range(120 if user == 0 else rng.randint(1, 7)):
            at, action = rng.randint(0, 29), rng.choice(["save", "delete", "update"])
            event = (hour(at), user * 1000 + i, action, rng.choice([None, "", f"n{i}"]), rng.choice(["", None, str(i)]))
            events.setdefault(user, []).append(event)
            # Each batch comes in two files; up to 14 hours late, updates any time.
            batch = rng.randrange(3) if action == "update" else min(2, (at + rng.randint(0, 5)) // 10)
            batches[batch].append((user, *event))
    for i, batch in enumerate(batches):
        rng.shuffle(batch)
        store.run(batch + batches[0][:40] * (i == 0), files=2)
    assert store.now() == {u: replay(es) for u, es in events.items() if replay(es)}
    assert late_events(spark, f"{store.base}/out").count() == 0


def test_what_is_settled_is_forgotten_and_stays(spark):
    store = Store(spark, datetime.timedelta(hours=2))
    store.run([(1, hour(h), h, "delete" if h % 2 else "save", None, None) for h in range(100)])
    # Places of the last two hours: three of a hundred.
    assert store.held() == 3
    before = store.now()
    assert before[1]["date_saved"] == hour(98) and before[1]["deleted_at"] == hour(99)
    store.run([(1, hour(10), 1000, "save", None, None), (1, hour(5), 1001, "update", "late", "7")])
    assert [r["event_id"] for r in late_events(spark, f"{store.base}/out").collect()] == [1000]
    assert store.now() == {1: before[1] | {"custom_name": "late", "rent_price": 7}}
    # Within the delay order is restored: the delete at 99 no longer follows the last save.
    store.run([(1, hour(99) + datetime.timedelta(minutes=1), 1002, "save", None, None)])
    assert store.now()[1] | {"custom_name": None, "rent_price": None} == {
        "date_saved": hour(99) + datetime.timedelta(minutes=1), "is_deleted": False, "deleted_at": None,
        "custom_name": None, "rent_price": None,
    }


def test_nulls_and_other_actions(spark):
    store = Store(spark, datetime.timedelta(hours=2))
    store.run([(1, None, 1, "save", None, None), (None, hour(1), None, "save", "x", None), (2, hour(1), 3, "view", None, None), (3, hour(1), 4, None, None, None), (4, hour(1), 5, "delete", None, None)])
    none = {"is_deleted": False, "deleted_at": None, "custom_name": None, "rent_price": None}
    assert store.now() == {1: none | {"date_saved": None}, None: none | {"date_saved": hour(1)}}


def test_listings_share_the_groups_of_the_state_store(spark, monkeypatch):
    monkeypatch.setattr(listings, "BUCKETS", 3, raising=False)
    rng = random.Random(7)
    store = Store(spark, datetime.timedelta(hours=9))
    events, batches = {}, [[], []]
    for user in [None, *range(40)]:
        for i in range(rng.randint(1, 6)):
            at, action = rng.randint(0, 19), rng.choice(["save", "delete", "update"])
            event = (hour(at), (user or 0) * 100 + i + (user is None) * 50, action, rng.choice([None, f"n{i}"]), None)
            events.setdefault(user, []).append(event)
            # Some listings are touched by one batch only.
            batches[min(1, at // 10)].append((user, *event))
    for batch in batches:
        rng.shuffle(batch)
        store.run(batch)
    # One no later than the latest delay of a listing that shares its bucket with others.
    store.run([(100, hour(h), 9000 + h, "save", None, None) for h in (0, 30)])
    store.run([(100, hour(0), 8999, "delete", None, None)])
    assert [r["event_id"] for r in late_events(spark, f"{store.base}/out").collect()] == [8999]
    now = store.now()
    assert now.pop(100)["date_saved"] == hour(0)
    assert now == {u: replay(es) for u, es in events.items() if replay(es)}
    # Three groups at most are asked for their state and answer, not one per listing.
    groups = spark.read.format("statestore").option("stateVarName", "facts").load(f"{store.base}/progress").count()
    assert groups <= 3
