"""Outcomes of requests, published versions, bucketed tables and stored answers."""

import random

import pytest
from pyspark.sql import functions as F

from stoopwise.operators.running import running_before
from stoopwise.plans.answers import Answers
from stoopwise.plans.outcomes import event_outcomes
from stoopwise.session import new_path
from stoopwise.sources import layout
from stoopwise.sources.bucketed import BucketedTable
from stoopwise.sources.versions import Versions


def replayed(events, known):
    """Every event in turn."""
    states, out = {}, {}
    for event_id, ts, user, address, action in sorted(events, key=lambda e: (e[1], e[0])):
        address = None if address is None else address.upper()
        key, state = (user, address), states.get((user, address), "absent")
        after = state
        if user is None:
            outcome = "sign-in required"
        elif action == "delete":
            outcome = "address required" if not address else "deleted" if state == "active" else "not saved"
            after = "deleted" if outcome == "deleted" else state
        elif action == "update":
            outcome = "not saved" if state == "absent" else "updated"
        elif address not in known:
            outcome = "unknown property"
        else:
            outcome = {"absent": "saved", "deleted": "restored", "active": "nothing to do"}[state]
            after = "active"
        states[key] = after
        out[event_id] = (state, after, outcome)
    return out


@pytest.mark.parametrize("seed,rows_per_task", [(1, 10), (2, 37), (3, 10_000)])
def test_outcomes_of_a_busy_listing(spark, seed, rows_per_task):
    rng = random.Random(seed)
    events = []
    for i in range(400):
        # One listing has a third of all events.
        user, address = (1, "a st") if rng.random() < 0.33 else (rng.choice([1, 2, 3, None]), rng.choice(["A St", "B St", "Nowhere", "", None]))
        events.append((i, rng.randint(0, 150), user, address, rng.choice(["save", "delete", "update"])))
    rng.shuffle(events)
    frame = spark.createDataFrame(events, "event_id long, ts long, user_id long, address string, action string")
    properties = spark.createDataFrame([("a st",), ("b st",)], "address string")
    found = event_outcomes(frame, properties, rows_per_task).collect()
    assert {r.event_id: (r.state_before, r.state_after, r.outcome) for r in found} == replayed(events, {"A ST", "B ST"})
    statuses = {(r.outcome, r.status) for r in found}
    assert statuses <= {("saved", 200), ("restored", 200), ("nothing to do", 200), ("deleted", 200), ("updated", 200),
                        ("not saved", 404), ("unknown property", 400), ("address required", 400), ("sign-in required", 401)}


def test_running_values_over_partitions(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([None, 1, 2, 5])) for i in range(200)]
    frame = spark.createDataFrame(rows, "k string, at long, v long").repartition(5)
    values = {"before": ("last", F.col("v")), "most": ("max", F.col("v")), "total": ("sum", F.col("v"))}
    found = {(r.k, r.at): (r.before, r.most, r.total) for r in running_before(frame, ["k"], ["at"], values, 9).collect()}
    seen = {}
    for k, at, v in sorted(rows, key=lambda r: r[1]):
        earlier = [x for x in seen.get(k, []) if x is not None]
        want = (earlier[-1], max(earlier), sum(earlier)) if earlier else (None, None, None)
        assert found[k, at] == want
        seen.setdefault(k, []).append(v)
    assert running_before(frame.limit(0), ["k"], ["at"], values, 9).count() == 0


def test_readers_see_one_load(spark):
    shelf = Versions(spark, new_path(spark, "shelf"))
    assert shelf.latest() is None
    with pytest.raises(FileNotFoundError):
        shelf.read("stops")
    table = spark.range(3).toDF("id")
    shelf.publish({"stops": table, "routes": table})
    early = shelf.read("stops", "routes")

    broken = table.select(F.raise_error(F.lit("no such feed")).alias("id"))
    with pytest.raises(Exception, match="no such feed"):
        shelf.publish({"stops": table.union(table), "routes": broken})
    assert [t.count() for t in shelf.read("stops", "routes").values()] == [3, 3]
    assert shelf.publish({"stops": table.union(table), "routes": table.limit(1)}) == 2
    assert [t.count() for t in early.values()] == [3, 3]
    assert [t.count() for t in shelf.read("stops", "routes").values()] == [6, 1]
    # A load that was made from an older version must begin anew.
    with pytest.raises(RuntimeError):
        shelf.publish({"stops": table}, after=1)
    shelf.publish({"stops": table}, after=2)
    shelf.drop_older(keep=1)
    assert shelf.numbers() == [3]
    assert shelf.read("stops")["stops"].count() == 3


def paths_of(table):
    return {r.bucket: r.path for r in table.versions.read("manifest")["manifest"].collect()}


def test_a_sync_touches_the_buckets_that_change(spark):
    schema = "k string, kind string, v long"
    rows = [(f"k{i}", "x", i) for i in range(200)] + [("other", "y", 1), (None, "x", 7), (None, None, 8)]
    table = BucketedTable(spark, new_path(spark, "buckets"), ["k"], ["kind", "v"], F.col("kind") == "x", buckets=16)
    table.create(spark.createDataFrame(rows, schema))
    before = paths_of(table)

    # Nothing new: nothing is read or written, although a key is null and one is out of scope.
    staging = [r for r in rows if r[0] is not None and r[1] == "x"]
    assert table.sync(spark.createDataFrame(staging, schema)).count() == 0
    assert paths_of(table) == before

    staging = [r for r in staging if r[0] != "k5"]
    staging = [(k, kind, 1000 if k == "k7" else v) for k, kind, v in staging] + [("new", "x", 3)]
    log = table.sync(spark.createDataFrame(staging, schema))
    assert {(r.k, r.v, r.action) for r in log.collect()} == {("k5", 5, "delete"), ("k7", 1000, "update"), ("new", 3, "insert")}
    want = staging + [("other", "y", 1), (None, "x", 7), (None, None, 8)]
    assert sorted(map(str, map(tuple, table.read().collect()))) == sorted(map(str, want))
    after = paths_of(table)
    assert sum(before.get(b) != p for b, p in after.items()) <= 3
    # The state before is still there for readers that began with it.
    assert table.read(number=2).count() == len(rows)

    # Without deletes rows that are not listed stay.
    table.sync(spark.createDataFrame([("k1", "x", -1)], schema), delete=False)
    assert table.read().count() == len(want)
    # All rows in scope go.
    table.sync(spark.createDataFrame([], schema))
    assert {r.k for r in table.read().collect()} == {"other", None}


def test_a_value_turned_null_is_a_change(spark):
    table = BucketedTable(spark, new_path(spark, "buckets"), ["k"], ["v", "w"], buckets=4)
    table.create(spark.createDataFrame([("a", 1, None)], "k string, v long, w long"))
    log = table.sync(spark.createDataFrame([("a", None, 1)], "k string, v long, w long"))
    assert [tuple(r) for r in log.collect()] == [("a", None, 1, "update")]
    assert [tuple(r) for r in table.read().collect()] == [("a", None, 1)]


def test_answers_are_worked_out_once(spark):
    worked = []

    def work_out(properties, minutes):
        worked.append(sorted(r.property_id for r in properties.collect()))
        response = F.struct(F.lit(minutes).alias("walking_time"), (F.col("property_id") * 0).alias("n"))
        return properties.select("property_id", response.alias("response"))

    def ids(*numbers):
        return spark.createDataFrame([(n,) for n in numbers], "property_id long")

    answers = Answers(spark, new_path(spark, "answers"))
    assert answers.ask(ids().limit(0), 5, work_out).count() == 0 and worked == []
    assert {(r.property_id, r.fresh) for r in answers.ask(ids(1, 2), 5, work_out).collect()} == {(1, True), (2, True)}
    assert {(r.property_id, r.fresh) for r in answers.ask(ids(2, 3), 5, work_out).collect()} == {(2, False), (3, True)}
    assert {(r.property_id, r.fresh) for r in answers.ask(ids(1, 2, 3), 5, work_out).collect()} == {(1, False), (2, False), (3, False)}
    answers.ask(ids(1), 15, work_out)
    assert worked == [[1, 2], [3], [1]]
    answers.merge_fills()
    assert len(answers.fills.numbers()) == 1
    found = answers.ask(ids(1, 3), 5, work_out).collect()
    assert {(r.property_id, r.response) for r in found} == {(1, '{"walking_time":5,"n":0}'), (3, '{"walking_time":5,"n":0}')}
    assert len(worked) == 3

    def fails(properties, minutes):
        raise ValueError("no answer")

    with pytest.raises(ValueError):
        answers.ask(ids(9), 5, fails)
    assert len(answers.fills.numbers()) == 1


def test_layout_sorts_no_more_rows_in_a_task_than_it_holds(spark, monkeypatch):
    monkeypatch.setattr(layout, "ROWS_PER_SORT", 100)
    rows = spark.range(1000).selectExpr(
        "CAST(id AS STRING) AS violation_id", "date_add(DATE '2020-01-01', CAST(id % 300 AS INT)) AS violation_date",
        "'a' AS address", "41.78 + id % 7 / 100 AS latitude", "-87.6 AS longitude",
    )
    path = new_path(spark, "sorted-layout")
    layout.write_violations(rows, path)
    parts = [n for n in spark.read.parquet(path).groupBy("_metadata.file_name").count().collect()]
    assert len(parts) >= 8 and sum(p["count"] for p in parts) == 1000
