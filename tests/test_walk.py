import json
import random

import pytest
from pyspark.sql import functions as F

from stoopwise.functions import features as ft
from stoopwise.plans import walk


def fold(stops):
    """Walk outwards and keep a stop when it brings a route."""
    seen, kept = set(), []
    for distance, stop, routes in sorted(stops):
        if set(routes) - seen:
            kept.append(stop)
            seen |= set(routes)
    return sorted(kept)


def test_new_route_stops_equal_the_walk(spark):
    rng = random.Random(11)
    cases = {
        p: [
            (float(rng.randint(0, 6)), s, rng.sample("ABCDEF", rng.randint(0, 3)))
            for s in range(rng.randint(0, 12))
        ]
        for p in range(200)
    }
    rows = [(p, s, d, r) for p, stops in cases.items() for d, s, r in stops]
    near = spark.createDataFrame(rows, "property_id int, stop_id int, distance_m double, routes array<string>")
    got = {}
    for r in walk.new_route_stops(near).collect():
        got.setdefault(r["property_id"], []).append(r["stop_id"])
    assert {p: sorted(s) for p, s in got.items()} == {p: fold(s) for p, s in cases.items() if fold(s)}


@pytest.fixture(scope="module")
def town(spark):
    properties = spark.createDataFrame(
        [(1, "1 Elm", 41.79, -87.6), (2, "Zero", 0.0, 0.0), (3, "Far", 99.9999, 99.9999)],
        "property_id int, address string, lat double, lon double",
    )
    stops = spark.createDataFrame(
        [(10, "near", 41.7901, -87.6), (11, "next", 41.791, -87.6), (12, "bare", 41.79, -87.6), (13, "away", 41.9, -87.6)],
        "stop_id int, stop_name string, lat double, lon double",
    )
    bridge = spark.createDataFrame(
        [(10, "55"), (10, "6"), (10, "6"), (11, "6"), (11, "X28"), (13, "1")], "stop_id int, route_id string"
    )
    groceries = spark.createDataFrame(
        [(1, "Fresh", "1 Oak", "grocery", 41.7911, -87.6), (2, "Cafe", "2 Oak", "cafe", 41.79, -87.6)],
        "amenity_id int, name string, address string, type string, lat double, lon double",
    )
    return properties, stops, bridge, groceries


def test_walk_stops(town):
    properties, stops, bridge, _ = town
    kept = walk.walk_stops(properties, stops, bridge, minutes=5)
    rows = {(r["property_id"], r["stop_id"]): r for r in kept.collect()}
    assert set(rows) == {(1, 10), (1, 11)}
    assert rows[1, 10]["routes"] == ["55", "6"] and rows[1, 11]["distance_min"] == 2
    every = walk.stops_all(properties, stops, bridge, minutes=5)
    assert sorted(r["stop_id"] for r in every.collect()) == [10, 11, 12]


def test_responses_cover_every_property(town):
    properties, stops, bridge, groceries = town
    kept = walk.walk_stops(properties, stops, bridge, minutes=5)
    answers = {r["property_id"]: r for r in walk.stop_responses(kept, properties, 5).collect()}
    assert answers[2]["status"] == "empty" and answers[1]["status"] == "found"
    features = answers[1]["response"]["bus_stops_geojson"]["features"]
    assert [f["properties"]["stop_id"] for f in features] == ["10", "11"]
    assert features[0]["geometry"]["coordinates"] == [-87.6, 41.7901]
    none = walk.walk_groceries(properties, groceries, minutes=0)
    assert none.count() == 0
    some = walk.walk_groceries(properties, groceries, minutes=15)
    assert [(r["name"], r["distance_min"]) for r in some.collect()] == [("Fresh", 1.7)]


def test_a_response_holds_everything_in_order(spark, town):
    """Also of a property with very many features there is one response."""
    near = spark.range(7000).select(
        F.lit(1).alias("property_id"),
        F.col("id").cast("int").alias("amenity_id"),
        F.concat(F.lit("n"), F.col("id")).alias("name"),
        F.lit("a").alias("address"),
        (7000 - F.col("id")).cast("double").alias("distance_m"),
        F.lit(-87.0).alias("target_lon"),
        F.lit(41.0).alias("target_lat"),
        F.lit(1.0).alias("distance_min"),
    )
    answers = walk.grocery_responses(near, town[0], 15).where("property_id = 1").collect()
    names = [f["properties"]["name"] for f in answers[0]["response"]["grocery_geojson"]["features"]]
    assert len(answers) == 1 and names == [f"n{i}" for i in reversed(range(7000))]


def feature(minutes=None, routes=(), **more):
    properties = {"routes": list(routes), **more}
    if minutes is not None:
        properties["distance_min"] = minutes
    return {"type": "Feature", "properties": properties}


def test_rollups_read_all_shapes(spark):
    features = [
        feature(3, ["55", "6"]),
        feature(8, ["6", "X28"]),
        feature(20, ["1"]),
        feature(None, ["2"]),
        {"type": "Feature"},
    ]
    shapes = [
        {"address": "a", "bus_stops_geojson": {"type": "FeatureCollection", "features": features}},
        {"features": features},
        features,
    ]
    texts = [json.dumps(s) for s in shapes] + [None, "{}", "[]", '{"bus_stops_geojson": {}, "features": [1]}', "broken"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    found = ft.stored_features(F.col("x"), "bus_stops_geojson", ft.STOP_FEATURE)
    columns = [c.alias(n) for n, c in walk.transit_rollups(F.col("f")).items()]
    rows = df.select("i", found.alias("f")).select("i", *columns).orderBy("i").collect()
    for row in rows[:3]:
        assert (row["stops_within_5"], row["stops_within_10"], row["stops_within_15"], row["total_stops"]) == (1, 2, 2, 4)
        assert row["unique_routes"] == ["1", "2", "55", "6", "X28"] and row["routes_count"] == 5
        assert row["routes_within_10"] == ["55", "6", "X28"]
        assert row["best_transit"] == "2 transit (5min): 55, 6"
    for row in rows[3:]:
        assert row["total_stops"] == 0 and row["best_transit"] is None


def test_grocery_rollups_name_unknown_stores(spark):
    stored = json.dumps([feature(7.5, name="B"), feature(9), feature(7.5, name="B"), feature(16, name="C")])
    found = ft.stored_features(F.col("x"), "grocery_geojson", ft.GROCERY_FEATURE)
    df = spark.createDataFrame([(stored,)], "x string").select(found.alias("f"))
    row = df.select(*[c.alias(n) for n, c in walk.grocery_rollups(F.col("f")).items()]).first()
    assert row["groceries_within_5"] == [] and row["groceries_within_10"] == ["B", "Unknown Store"]
    assert row["best_grocery"] == "2 grocery (10min): B, Unknown Store"


def test_routes_in_feature_order(spark):
    stored = json.dumps([feature(3, ["9", "1"]), feature(16, ["5"]), feature(4, ["1", "2"])])
    found = ft.stored_features(F.col("x"), "bus_stops_geojson", ft.STOP_FEATURE)
    df = spark.createDataFrame([(stored,)], "x string").select(found.alias("f"))
    assert df.select(ft.routes_first_seen(F.col("f"), 15)).first()[0] == ["9", "1", "2"]


def test_requests(spark, town):
    properties, stops, bridge, _ = town
    requests = spark.createDataFrame(
        [
            (1, 1, "41.79,-87.6", 5),
            (2, None, "41.79,-87.6", 5),
            (3, 1, "", 5),
            (4, 1, "41.79,-87.6", 0),
            (5, 1, "41.79,-87.6", -1),
            (6, 1, "here", 5),
            (7, 99, "41.79,-87.6", 5),
            (8, 1, "-87.6,41.79", 5),
            (9, 1, "41.79,-87.6", 1),
        ],
        "request_id int, property_id int, geocode string, walking_time int",
    )
    rows = walk.requested_stops(requests, properties, stops, bridge).collect()
    found = sorted((r["request_id"], r["stop_id"]) for r in rows if r["error"] is None)
    assert found == [(1, 10), (1, 11), (9, 10)]
    errors = {r["request_id"]: r["error"] for r in rows if r["error"]}
    assert errors == {
        2: "property_id is required",
        3: "geocode is required",
        4: "walking_time is required",
        5: "walking_time must be greater than 0",
        6: "Failure in parsing request",
        7: "Invalid property_id",
        8: "No bus stops found within the walking distance",
    }


def test_routes_are_not_sorted_to_find_the_stops_that_bring_them(spark):
    near = spark.createDataFrame(
        [(1, 12, 5.0, ["a", "b"]), (1, 11, 5.0, ["b"]), (1, 13, 9.0, ["a"]), (1, 14, 9.5, ["c"]), (1, 15, 1.0, []), (2, 13, 0.0, ["a", "d"])],
        "property_id long, stop_id long, distance_m double, routes array<string>",
    )
    kept = walk.new_route_stops(near)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in kept.collect()) == [(1, 11, 5.0), (1, 12, 5.0), (1, 14, 9.5), (2, 13, 0.0)]
    assert "SortAggregate" not in plan and plan.count("Sort [") == 1
