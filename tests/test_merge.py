from pyspark.sql import functions as F

from stoopwise.operators import merge
from stoopwise.plans import amenities

AMENITY = "address string, type string, name string, lon double, lat double"


def test_sync_actions(spark):
    stored = spark.createDataFrame(
        [
            ("1 A", "grocery", "Same", 1.0, 1.0),
            ("2 B", "grocery", "Old", 1.0, 1.0),
            ("3 C", "grocery", "Gone", 1.0, 1.0),
            ("4 D", "grocery", None, 1.0, 1.0),
            (None, "grocery", "No address", 1.0, 1.0),
            ("3 C", "cafe", "Untouched", 1.0, 1.0),
        ],
        AMENITY,
    )
    staging = spark.createDataFrame(
        [
            ("a", "Same", "1 A", 1.0, 1.0, "2025-01-01"),
            ("b", "New", "2 B", 1.0, 1.0, "2025-01-01"),
            ("d", "Named", "4 D", 1.0, 1.0, None),
            ("e", "First", "5 E", 2.0, 2.0, None),
            ("f", "Later", "5 E", 3.0, 3.0, "2025-01-01"),
        ],
        "id string, store_name string, address string, longitude double, latitude double, last_updated string",
    ).withColumn("last_updated", F.col("last_updated").cast("timestamp"))
    merged = amenities.grocery_sync(stored, staging)
    actions = {(r["address"], r["type"]): (r["action"], r["name"]) for r in merged.collect()}
    assert actions == {
        ("1 A", "grocery"): ("unchanged", "Same"),
        ("2 B", "grocery"): ("update", "New"),
        ("3 C", "grocery"): ("delete", "Gone"),
        ("4 D", "grocery"): ("update", "Named"),
        ("5 E", "grocery"): ("insert", "Later"),
        (None, "grocery"): ("unchanged", "No address"),
        ("3 C", "cafe"): ("unchanged", "Untouched"),
    }
    assert merge.snapshot(merged).count() == 6 and merge.changes(merged).count() == 4


def test_staging_predicate(spark):
    kind = (
        "feature struct<geometry: struct<type: string, coordinates: array<double>>, properties: "
        "struct<store_name: string, address: string, zip: string, new_status: string, last_updated: string>>"
    )
    point = ("Point", [1.5, 2.5])
    rows = [
        ((point, ("ok", "1 A", "6", "Open", "")),),
        ((point, ("closed", "2 B", "6", "CLOSED", "")),),
        ((None, ("no point", "3 C", "6", "OPEN", "")),),
        ((("Point", [1.0, 2.0, 3.0]), ("three", "4 D", "6", "OPEN", "")),),
        ((point, ("no address", None, "6", "OPEN", "")),),
        ((point, ("no status", "5 E", "6", None, "")),),
    ]
    staged = amenities.stage_groceries(spark.createDataFrame(rows, kind)).collect()
    assert [(r["id"], r["store_name"], r["last_updated"]) for r in staged] == [("1 A|1.5|2.5", "ok", None)]


def test_existing_rows_win(spark):
    existing = spark.createDataFrame([("1", "stored")], "id string, v string")
    rows = spark.createDataFrame([("1", "new"), ("2", "b"), ("2", "a"), ("3", None)], "id string, v string")
    got = sorted(map(tuple, merge.insert_new(rows, existing, ["id"]).collect()))
    assert got == [("1", "stored"), ("2", "a"), ("3", None)]


def test_upsert_replaces(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int")
    b = spark.createDataFrame([("y", 1), ("z", 3)], "k string, v int")
    assert sorted(map(tuple, merge.upsert_latest(a, b, ["k"]).collect())) == [("x", 1), ("y", 1), ("z", 3)]


def test_delete_missing_compares_values(spark):
    target = spark.createDataFrame([("a", 1.0), ("b", 1.0), (None, 1.0)], "k string, x double")
    staging = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, x double")
    got = {r["k"] for r in merge.delete_missing(target, staging, ["k", "x"]).collect()}
    assert got == {"a", None}


def test_new_ids_follow_the_highest(spark):
    existing = spark.createDataFrame([(7, "a"), (3, "b")], "id long, address string")
    wanted = spark.createDataFrame([(x,) for x in "zxaywv"], "address string")
    for rows_per_task in (1000, 2):
        made = merge.get_or_create(wanted, existing, "address", "id", rows_per_task)
        assert sorted((r["id"], r["address"]) for r in made.collect()) == [
            (8, "v"), (9, "w"), (10, "x"), (11, "y"), (12, "z"),
        ]
    none = existing.limit(0)
    assert {r["id"] for r in merge.get_or_create(wanted, none, "address", "id").collect()} == set(range(1, 7))


def test_write_once_and_shallow_merge(spark):
    df = spark.createDataFrame([([1], [2]), ([], [2]), (None, [2])], "a array<int>, b array<int>")
    got = [r[0] for r in df.select(merge.write_once(F.col("a"), F.col("b"))).collect()]
    # An empty answer that is stored stays.
    assert got == [[1], [], [2]]
    left = spark.createDataFrame([(1, "content", "kept")], "k int, a string, b string")
    right = spark.createDataFrame([(1, "summary", "extra")], "k int, a string, c string")
    row = merge.shallow_merge(left, right, ["k"]).first()
    assert row.asDict() == {"k": 1, "a": "summary", "b": "kept", "c": "extra"}
