"""Walkability queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoopwise.catalog.registry import Given, query
from stoopwise.functions import features as ft
from stoopwise.operators.stored_grid import StoredGrid
from stoopwise.params import METRES_PER_MINUTE
from stoopwise.plans import walk
from stoopwise.plans.answers import Answers
from stoopwise.session import new_path

METRES = """2 * CAST(6371008.8 AS DOUBLE) * asin(least(CAST(1 AS DOUBLE), sqrt(
  pow(sin(radians(b.lat - a.lat) / 2), 2)
  + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"""


def near_sql(targets: str, minutes: str, columns: str, points: str = "{v_properties}") -> str:
    """Pairs in walking distance, by comparing each point with the targets in its band of
    latitude and the next ones; within it a box that is wider the farther north it lies."""
    return f"""
SELECT * FROM (
  SELECT a.property_id, {columns}, {METRES} AS distance_m
  FROM (SELECT *, floor(lat / 0.012) + unnest([-1, 0, 1]) AS band FROM {points}) a
  JOIN (SELECT *, floor(lat / 0.012) AS band FROM {targets}) b ON a.band = b.band
  WHERE b.lon BETWEEN a.lon - 0.0105 / cos(radians(a.lat)) AND a.lon + 0.0105 / cos(radians(a.lat)))
WHERE distance_m <= {minutes} * 70"""


def kept_sql(minutes: int) -> str:
    """Stops that bring a new route, from all near stops and their routes."""
    return f"""
near AS ({near_sql("{v_stops}", str(minutes), "b.stop_id, b.stop_name, b.lat, b.lon")}),
first AS (
  SELECT property_id, near.stop_id, row_number() OVER (
    PARTITION BY property_id, route_id ORDER BY distance_m, near.stop_id) AS nth
  FROM near JOIN {{v_route_stops}} r ON near.stop_id = r.stop_id
  WHERE route_id IS NOT NULL),
served AS (SELECT stop_id, string_agg(route_id, ',' ORDER BY route_id) AS routes
  FROM {{v_route_stops}} GROUP BY stop_id),
kept AS (
  SELECT near.*, routes, CAST(round_even(distance_m / 70, 0) AS INT) AS distance_min
  FROM near JOIN (SELECT DISTINCT property_id, stop_id FROM first WHERE nth = 1) f
    ON near.property_id = f.property_id AND near.stop_id = f.stop_id
  JOIN served ON near.stop_id = served.stop_id)"""


def _stop_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        "property_id",
        "stop_id",
        "stop_name",
        F.array_join("routes", ",").alias("routes"),
        "distance_min",
        F.round("distance_m", 3).alias("distance_m"),
    )


STOP_COLUMNS = """property_id, stop_id, stop_name, routes, distance_min,
  round(distance_m, 3) AS distance_m"""


@query(
    "Q1 J1 J2 W1 X1 X2 X4 O3",
    sql=f"WITH {kept_sql(5)} SELECT {STOP_COLUMNS} FROM kept",
)
def walk_stops(t: Given) -> DataFrame:
    return _stop_rows(walk.walk_stops(t.v_properties, t.v_stops, t.v_route_stops, minutes=5))


@query("Q1 J1 J2 stored grid", sql=f"WITH {kept_sql(5)} SELECT {STOP_COLUMNS} FROM kept")
def walk_stops_stored(t: Given) -> DataFrame:
    served = walk.stops_with_routes(t.v_stops, t.v_route_stops)
    buckets = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    grid = StoredGrid.write(served, new_path(t.spark, "stop-grid"), 15 * METRES_PER_MINUTE, buckets)
    return _stop_rows(walk.walk_stops_stored(grid, t.v_properties, minutes=5))


@query(
    "Q1 at the longer walking time",
    sql=f"WITH {kept_sql(15)} SELECT {STOP_COLUMNS} FROM kept",
)
def walk_stops_15_min(t: Given) -> DataFrame:
    return _stop_rows(walk.walk_stops(t.v_properties, t.v_stops, t.v_route_stops, minutes=15))


@query(
    "Q3 J1 J2 X4",
    sql=f"""WITH near AS ({near_sql("{v_stops}", "5", "b.stop_id, b.stop_name")}),
served AS (SELECT stop_id, string_agg(route_id, ',' ORDER BY route_id) AS routes
  FROM {{v_route_stops}} GROUP BY stop_id)
SELECT property_id, near.stop_id AS stop_id, stop_name, coalesce(routes, '') AS routes,
  CAST(round_even(distance_m / 70, 0) AS INT) AS distance_min,
  round(distance_m, 3) AS distance_m
FROM near LEFT JOIN served ON near.stop_id = served.stop_id""",
)
def stops_all(t: Given) -> DataFrame:
    return _stop_rows(walk.stops_all(t.v_properties, t.v_stops, t.v_route_stops, minutes=5))


GROCERIES = near_sql(
    "(SELECT * FROM {v_amenities} WHERE type = 'grocery')", "15",
    "b.amenity_id, b.name, b.address, b.lat, b.lon",
)


@query(
    "Q2 J1 X3 O3",
    sql=f"""WITH near AS ({GROCERIES})
SELECT property_id, amenity_id, name, address, round_even(distance_m / 70, 1) AS distance_min,
  round(distance_m, 3) AS distance_m,
  row_number() OVER (PARTITION BY property_id ORDER BY distance_m, amenity_id) AS nearest
FROM near""",
)
def walk_groceries(t: Given) -> DataFrame:
    near = walk.walk_groceries(t.v_properties, t.v_amenities, minutes=15, keep_cells=True)
    return walk.nearest_first(near, "amenity_id").select(
        "property_id",
        "amenity_id",
        "name",
        "address",
        "distance_min",
        F.round("distance_m", 3).alias("distance_m"),
        F.col("nearest").cast("long").alias("nearest"),
    )


def _feature_text(features: F.Column, *fields: str) -> F.Column:
    """Features as text that does not depend on how an engine prints JSON."""
    return F.array_join(
        F.transform(
            features,
            lambda f: F.concat_ws(
                "|",
                f["geometry"]["type"],
                F.array_join(
                    F.transform(f["geometry"]["coordinates"], lambda x: F.format_number(x, 5)), " "
                ),
                *[f["properties"][name].cast("string") for name in fields],
            ),
        ),
        "; ",
    )


@query(
    "S14 Q1 stop response per property, X5",
    sql=f"""WITH {kept_sql(5)},
texts AS (SELECT property_id, string_agg('Point|' || printf('%.5f', lon) || ' '
    || printf('%.5f', lat) || '|' || stop_name || '|' || CAST(distance_min AS STRING)
    || '.0|' || CAST(stop_id AS STRING), '; ' ORDER BY distance_m, stop_id) AS features
  FROM kept GROUP BY property_id)
SELECT p.property_id, CASE WHEN features IS NULL THEN 'empty' ELSE 'found' END AS status,
  address, 5 AS walking_time, coalesce(features, '') AS features
FROM {{v_properties}} p LEFT JOIN texts ON p.property_id = texts.property_id""",
)
def walk_stops_geojson(t: Given) -> DataFrame:
    kept = walk.walk_stops(t.v_properties, t.v_stops, t.v_route_stops, minutes=5)
    answers = walk.stop_responses(kept, t.v_properties, 5)
    found = F.col("response.bus_stops_geojson.features")
    return answers.select(
        "property_id",
        "status",
        "response.address",
        "response.walking_time",
        _feature_text(found, "stop_name", "distance_min", "stop_id").alias("features"),
    )


@query(
    "S14 Q2 grocery response per property",
    sql=f"""WITH near AS ({GROCERIES}),
texts AS (SELECT property_id, string_agg('Point|' || printf('%.5f', lon) || ' '
    || printf('%.5f', lat) || '|' || name || '|' || printf('%.1f', round_even(distance_m / 70, 1))
    || '|' || address, '; ' ORDER BY distance_m, amenity_id) AS features
  FROM near GROUP BY property_id)
SELECT p.property_id, CASE WHEN features IS NULL THEN 'empty' ELSE 'found' END AS status,
  p.address, 15 AS walking_time, coalesce(features, '') AS features
FROM {{v_properties}} p LEFT JOIN texts ON p.property_id = texts.property_id""",
)
def walk_groceries_geojson(t: Given) -> DataFrame:
    near = walk.walk_groceries(t.v_properties, t.v_amenities, minutes=15, keep_cells=True)
    answers = walk.grocery_responses(near, t.v_properties, 15)
    found = F.col("response.grocery_geojson.features")
    return answers.select(
        "property_id",
        "status",
        "response.address",
        "response.walking_time",
        _feature_text(found, "name", "distance_min", "address").alias("features"),
    )


def _stored(responses: DataFrame, key: str, name: str) -> DataFrame:
    """Responses as stored JSON text, in all three shapes that occur."""
    shape = F.col("property_id") % 3
    text = (
        F.when(shape == 0, F.to_json("response"))
        .when(shape == 1, F.to_json(f"response.{key}"))
        .otherwise(F.to_json(f"response.{key}.features"))
    )
    return responses.select("property_id", text.alias(name))


def stored_stops(t: Given, properties: DataFrame) -> DataFrame:
    """property_id and the stored stop response ``bus_stops`` of each of the properties."""
    kept = walk.walk_stops(properties, t.v_stops, t.v_route_stops, minutes=15)
    return _stored(walk.stop_responses(kept, properties, 15), "bus_stops_geojson", "bus_stops")


def stored_groceries(t: Given, properties: DataFrame) -> DataFrame:
    """property_id and the stored grocery response ``groceries`` of each of the properties."""
    near = walk.walk_groceries(properties, t.v_amenities, minutes=15, keep_cells=True)
    return _stored(walk.grocery_responses(near, properties, 15), "grocery_geojson", "groceries")


@query(
    "U8 Q2 stored answers",
    sql=f"""WITH near AS ({GROCERIES}),
counts AS (SELECT property_id, count(*) AS n FROM near GROUP BY property_id)
SELECT p.property_id, 15 AS walking_time, address, coalesce(n, 0) AS n_stores,
  p.property_id % 3 = 0 AS fresh
FROM {{v_properties}} p LEFT JOIN counts c ON p.property_id = c.property_id""",
)
def stored_answers(t: Given) -> DataFrame:
    """Answers of two visits, the second of which finds those of the first."""

    def work_out(properties: DataFrame, minutes: int) -> DataFrame:
        near = walk.walk_groceries(properties, t.v_amenities, minutes=minutes, keep_cells=True)
        return walk.grocery_responses(near, properties, minutes)

    answers = Answers(t.spark, new_path(t.spark, "answers"))
    answers.ask(t.v_properties.where("property_id % 3 <> 0"), 15, work_out)
    found = answers.ask(t.v_properties, 15, work_out)
    features = ft.stored_features(F.col("response"), "grocery_geojson", ft.GROCERY_FEATURE)
    return found.select(
        "property_id",
        "walking_time",
        F.get_json_object("response", "$.address").alias("address"),
        F.size(features).cast("long").alias("n_stores"),
        "fresh",
    )


def _routes_sql(limit: int) -> str:
    return f"""SELECT k.property_id, count(DISTINCT route_id) AS n,
  string_agg(DISTINCT route_id, ', ' ORDER BY route_id) AS routes
FROM kept k JOIN {{v_route_stops}} r ON k.stop_id = r.stop_id
WHERE distance_min <= {limit} GROUP BY k.property_id"""


ROLLUPS = f"""{kept_sql(15)},
counts AS (SELECT property_id, count(*) AS total_stops,
  count(*) FILTER (WHERE distance_min <= 5) AS n5,
  count(*) FILTER (WHERE distance_min <= 10) AS n10,
  count(*) FILTER (WHERE distance_min <= 15) AS n15 FROM kept GROUP BY property_id),
r5 AS ({_routes_sql(5)}), r10 AS ({_routes_sql(10)}), r15 AS ({_routes_sql(15)}),
r999 AS ({_routes_sql(999)}),
best_transit AS (SELECT p.property_id,
  CAST(coalesce(n5, 0) AS INT) AS stops_within_5,
  CAST(coalesce(n10, 0) AS INT) AS stops_within_10,
  CAST(coalesce(n15, 0) AS INT) AS stops_within_15,
  CAST(coalesce(total_stops, 0) AS INT) AS total_stops,
  CAST(coalesce(r999.n, 0) AS INT) AS routes_count,
  coalesce(r999.routes, '') AS unique_routes,
  coalesce(r5.routes, '') AS routes_within_5,
  coalesce(r10.routes, '') AS routes_within_10,
  coalesce(r15.routes, '') AS routes_within_15,
  CASE WHEN r5.n > 0 THEN CAST(r5.n AS STRING) || ' transit (5min): ' || r5.routes
    WHEN r10.n > 0 THEN CAST(r10.n AS STRING) || ' transit (10min): ' || r10.routes
    WHEN r15.n > 0 THEN CAST(r15.n AS STRING) || ' transit (15min): ' || r15.routes END AS best_transit
FROM {{v_properties}} p LEFT JOIN counts ON p.property_id = counts.property_id
LEFT JOIN r5 ON p.property_id = r5.property_id LEFT JOIN r10 ON p.property_id = r10.property_id
LEFT JOIN r15 ON p.property_id = r15.property_id LEFT JOIN r999 ON p.property_id = r999.property_id)"""


@query(
    "A7 A8 A9 A11 P12",
    sql=f"WITH {ROLLUPS} SELECT * FROM best_transit",
)
def transit_rollups(t: Given) -> DataFrame:
    found = ft.stored_features(F.col("bus_stops"), "bus_stops_geojson", ft.STOP_FEATURE)
    stored = stored_stops(t, t.v_properties).select("property_id", found.alias("f"))
    columns = walk.transit_rollups(F.col("f"))
    lists = ("unique_routes", "routes_within_5", "routes_within_10", "routes_within_15")
    return stored.select(
        "property_id",
        *[
            (F.array_join(c, ", ") if n in lists else c).alias(n)
            for n, c in columns.items()
        ],
    )


def _names_sql(limit: int) -> str:
    return f"""SELECT property_id, count(DISTINCT name) AS n,
  string_agg(DISTINCT name, ', ' ORDER BY name) AS names
FROM groceries WHERE round_even(distance_m / 70, 1) <= {limit} GROUP BY property_id"""


GROCERY_ROLLUPS = f"""groceries AS ({GROCERIES}),
g5 AS ({_names_sql(5)}), g10 AS ({_names_sql(10)}), g15 AS ({_names_sql(15)}),
best_grocery AS (SELECT p.property_id,
  coalesce(g5.names, '') AS groceries_within_5,
  coalesce(g10.names, '') AS groceries_within_10,
  coalesce(g15.names, '') AS groceries_within_15,
  CASE WHEN g5.n > 0 THEN CAST(g5.n AS STRING) || ' grocery (5min): ' || g5.names
    WHEN g10.n > 0 THEN CAST(g10.n AS STRING) || ' grocery (10min): ' || g10.names
    WHEN g15.n > 0 THEN CAST(g15.n AS STRING) || ' grocery (15min): ' || g15.names END AS best_grocery
FROM {{v_properties}} p LEFT JOIN g5 ON p.property_id = g5.property_id
LEFT JOIN g10 ON p.property_id = g10.property_id LEFT JOIN g15 ON p.property_id = g15.property_id)"""


@query("A10 A11 P12", sql=f"WITH {GROCERY_ROLLUPS} SELECT * FROM best_grocery")
def grocery_rollups(t: Given) -> DataFrame:
    found = ft.stored_features(F.col("groceries"), "grocery_geojson", ft.GROCERY_FEATURE)
    stored = stored_groceries(t, t.v_properties).select("property_id", found.alias("f"))
    columns = walk.grocery_rollups(F.col("f"))
    return stored.select(
        "property_id",
        *[
            (c if n == "best_grocery" else F.array_join(c, ", ")).alias(n)
            for n, c in columns.items()
        ],
    )


@query(
    "P13 A12",
    sql=f"""WITH {kept_sql(15)},
firsts AS (SELECT property_id, route_id, nth FROM (
  SELECT k.property_id, r.route_id, row_number() OVER (PARTITION BY k.property_id, r.route_id
    ORDER BY distance_m, k.stop_id) AS pick,
    row_number() OVER (PARTITION BY k.property_id ORDER BY distance_m, k.stop_id, r.route_id) AS nth
  FROM kept k JOIN {{v_route_stops}} r ON k.stop_id = r.stop_id WHERE distance_min <= 10)
  WHERE pick = 1),
texts AS (SELECT property_id, string_agg(route_id, ',' ORDER BY nth) AS routes FROM firsts
  GROUP BY property_id),
counts AS (SELECT property_id, count(*) AS n FROM kept WHERE distance_min <= 10
  GROUP BY property_id)
SELECT p.property_id, CAST(coalesce(n, 0) AS INT) AS shown_stops, coalesce(routes, '') AS routes
FROM {{v_properties}} p LEFT JOIN texts ON p.property_id = texts.property_id
LEFT JOIN counts ON p.property_id = counts.property_id""",
)
def shown_stops_and_routes(t: Given) -> DataFrame:
    found = ft.stored_features(F.col("bus_stops"), "bus_stops_geojson", ft.STOP_FEATURE)
    stored = stored_stops(t, t.v_properties).select("property_id", found.alias("f"))
    return stored.select(
        "property_id",
        F.size(ft.within(F.col("f"), 10)).alias("shown_stops"),
        F.array_join(ft.routes_first_seen(F.col("f"), 10), ",").alias("routes"),
    )
