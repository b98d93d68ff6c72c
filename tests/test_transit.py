from pyspark.sql import functions as F
from stoopwise.params import EXCLUDED_ROUTES
from stoopwise.plans import transit

STOPS = "stop_id string, route_id string, stop_name string, latitude string, longitude string"


def test_build(spark):
    cta = transit.cta_stops(
        spark.createDataFrame(
            [
                ("1", "55", "a", "41.8", "-87.6"),
                ("1", "6", "a", "41.8", "-87.6"),
                ("2", "Blue", "rail", "41.8", "-87.6"),
                ("3", "77", "no such route", "41.8", "-87.6"),
                ("4", "55", "no place", "x", "-87.6"),
                ("5", None, "no route", "41.8", "-87.6"),
            ],
            STOPS,
        )
    )
    assert "Blue" in EXCLUDED_ROUTES and cta.where("stop_id = '2'").count() == 0
    shuttle = transit.shuttle_stops(
        spark.createDataFrame(
            [("1", "s", "Downtown Campus Connector", -87.6, 41.8), ("2", "t", "MED Medical Shuttle", 0.0, 0.0), ("3", "u", "Night", 0.0, 0.0)],
            "stop_id string, stop_name string, route_name string, x double, y double",
        )
    )
    assert [(r["stop_id"], r["route_id"]) for r in shuttle.collect()] == [("1000", "Downtown Connector")]
    routes = transit.cta_routes(
        spark.createDataFrame(
            [("55", "Garfield", "LINESTRING (1 2, 3 4)"), ("6", "Jackson", "MULTILINESTRING ((1 2, 3 4), (5 6, 7 8))"), ("9", "Bad", "POINT (1 2)")],
            "route_id string, route_name string, geometry string",
        )
    )
    lines = transit.shuttle_routes(
        spark.createDataFrame(
            [("Downtown Connector", 1, 2, 3.0, 4.0), ("Downtown Connector", 1, 1, 1.0, 2.0), ("Downtown Connector", 0, 1, 9.0, 9.0)],
            "route string, line_no int, seq int, lon double, lat double",
        )
    )
    geometry = lines.first()["geometry"]
    assert [[tuple(p) for p in line] for line in geometry] == [[(9.0, 9.0)], [(1.0, 2.0), (3.0, 4.0)]]
    stop_rows = cta.unionByName(shuttle.selectExpr("* except (latitude, longitude)", "string(latitude) latitude", "string(longitude) longitude"))
    built = transit.transit_build(stop_rows, routes.unionByName(lines))
    assert sorted(r["stop_id"] for r in built.stops.collect()) == ["1", "1000", "3", "5"]
    assert {r["route_id"] for r in built.routes.collect()} == {"55", "6", "Downtown Connector"}
    assert sorted((r["route_id"], r["stop_id"]) for r in built.route_stops.collect()) == [
        ("55", "1"), ("6", "1"), ("Downtown Connector", "1000"),
    ]
    rejects = {(r["route_id"], r["stop_id"], r["reason"]) for r in built.rejects.collect()}
    assert rejects == {
        ("77", "3", "unknown route"),
        (None, "5", "unknown route"),
        ("55", "4", "unknown stop"),
        (None, "4", "no valid point"),
        ("9", None, "no line geometry"),
    }


def test_long_routes_stay_whole(spark):
    """One row per route, however many lines and points it has."""
    rows = [("r", line, i, float(i), float(line)) for line in range(150) for i in range(3)]
    rows += [("s", 0, i, float(i), 0.0) for i in range(12_000)]
    points = spark.createDataFrame(rows, "route string, line_no int, seq int, lon double, lat double")
    routes = {r["route_id"]: r["geometry"] for r in transit.shuttle_routes(points.repartition(7)).collect()}
    assert [len(line) for line in routes["r"]] == [3] * 150
    assert [p["lon"] for p in routes["s"][0]] == [float(i) for i in range(12_000)]


def test_one_feed_wins_a_route(spark):
    other = spark.createDataFrame([("r", "other", "LINESTRING (9 9, 8 8)")], "route_id string, route_name string, geometry string")
    rows = [("r", line, i, float(i), float(line)) for line in range(150) for i in range(2)]
    points = spark.createDataFrame(rows, "route string, line_no int, seq int, lon double, lat double")
    both = transit.cta_routes(other).unionByName(transit.shuttle_routes(points))
    kept = transit.transit_routes(both).collect()
    assert len(kept) == 1 and len(kept[0]["geometry"]) == (1 if kept[0]["type"] == "cta" else 150)


def test_route_map_colours(spark):
    requests = spark.createDataFrame([(1, "171, 172 ,55,171"), (2, " "), (3, "nope"), (4, None)], "request_id int, routes string")
    routes = spark.createDataFrame([("171", "A", "cta"), ("55", "B", "cta")], "route_id string, name string, type string")
    found = transit.route_map(requests, routes)
    colors = {(r["request_id"], r["route_id"]): r["color"] for r in found.collect()}
    # Of the repeated route the last of four positions counts.
    assert colors == {(1, "171"): "hsl(270, 100%, 45%)", (1, "55"): "hsl(180, 100%, 45%)"}
    errors = {r["request_id"]: r["error"] for r in transit.request_errors(requests, found).collect()}
    assert errors == {2: "No valid input", 3: "This route is not available in our database", 4: "No valid input"}


def test_name_filter_keeps_missing_names(spark):
    rows = spark.createDataFrame([("CTA 171",), ("Drexel",), (None,)], "name string")
    assert [r[0] for r in transit.without_name(rows, "name", "CTA").collect()] == ["Drexel", None]


def test_answers_are_one_collection_per_request(spark):
    routes = spark.createDataFrame([("171", "A", "cta"), ("55", "B", "cta")], "route_id string, name string, type string")
    line = F.expr("array(array(named_struct('lon', 1d, 'lat', 2d), named_struct('lon', 3d, 'lat', 4d)))")
    requests = spark.createDataFrame([(1, "55,171"), (2, "55")], "request_id int, routes string")
    answers = transit.route_collections(transit.route_map(requests, routes.withColumn("geometry", line)))
    found = {r["request_id"]: r["response"] for r in answers.collect()}
    assert [f["properties"]["route_id"] for f in found[1]["features"]] == ["171", "55"]
    assert found[2]["type"] == "FeatureCollection"
    assert found[2]["features"][0]["geometry"]["coordinates"] == [[[1.0, 2.0], [3.0, 4.0]]]
