"""Readers and writers: the given tables leave as feeds and come back.

Everything is written below the session's shared folder, each run in its own place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoopwise import schemas
from stoopwise.catalog import amenities as amenity_queries
from stoopwise.catalog import transit as transit_queries
from stoopwise.catalog.registry import Given, query
from stoopwise.catalog.violations import raw_rows
from stoopwise.functions import features as ft
from stoopwise.operators.filters import with_categories
from stoopwise.operators.quality import observed
from stoopwise.params import CATEGORIES
from stoopwise.plans import amenities, transit
from stoopwise.session import new_path, written
from stoopwise.sources import readers, writers
from stoopwise.sources.versions import Versions

VIOLATION_FIELDS = [
    "violation_id", "violation_date", "violation_code", "violation_status",
    "violation_status_date", "violation_description", "violation_inspector_comments",
    "violation_ordinance", "inspection_number", "inspection_status", "inspection_category",
    "address", "latitude", "longitude",
]


@query("S1 S12 X10", sql=f"SELECT {', '.join(VIOLATION_FIELDS)} FROM {{v_violations}}")
def violations_file(t: Given) -> DataFrame:
    path = new_path(t.spark, "violations-csv")
    writers.write_csv(raw_rows(t), path)
    return readers.violations(t.spark, path).select(VIOLATION_FIELDS)


@query(
    "S1 point, longitude first",
    sql="""SELECT violation_id, longitude AS lon, latitude AS lat, count(*) AS n
FROM {v_violations} GROUP BY ALL""",
)
def violation_points(t: Given) -> DataFrame:
    path = new_path(t.spark, "violations-csv")
    writers.write_csv(raw_rows(t), path)
    points = readers.violations(t.spark, path).select("violation_id", "location.*")
    return points.groupBy("violation_id", "lon", "lat").agg(F.count("*").alias("n"))


@query("S2", sql=transit_queries.STOP_ROWS)
def stops_file(t: Given) -> DataFrame:
    path = new_path(t.spark, "stops-csv")
    rows = t.sql(transit_queries.STOP_ROWS).withColumns(
        {f"var_{i}": F.lit(f"v{i}") for i in (1, 2, 3)}
    )
    positions = [field.split()[0] for field in schemas.STOPS_CSV.split(", ")]
    rows.select(positions).write.option("header", "false").csv(path)
    return readers.stop_rows(t.spark, path)


@query(
    "S3",
    sql=f"SELECT route_id, route_name, geometry FROM ({transit_queries.ROUTE_ROWS}) r",
)
def routes_file(t: Given) -> DataFrame:
    path = new_path(t.spark, "routes-csv")
    rows = t.sql(transit_queries.ROUTE_ROWS).select(
        F.col("geometry").alias("the_geom"),
        F.col("route_id").alias("ROUTE"),
        F.col("route_name").alias("NAME"),
        *[F.lit(1).alias(day) for day in ("WKDAY", "SAT", "SUN")],
    )
    writers.write_csv(rows, path)
    return readers.route_rows(t.spark, path)


@query("S4 S14", sql=transit_queries.SHUTTLE_POINTS)
def shuttle_stops_file(t: Given) -> DataFrame:
    path = new_path(t.spark, "shuttle-geojson")
    writers.write_features(
        t.sql(transit_queries.SHUTTLE_POINTS), path, writers.shuttle_stop_feature()
    )
    return readers.shuttle_points(t.spark, path)


@query("S4 S14 as documents", sql=transit_queries.SHUTTLE_POINTS)
def shuttle_stops_documents(t: Given) -> DataFrame:
    path = new_path(t.spark, "shuttle-documents")
    writers.write_collection(
        t.sql(transit_queries.SHUTTLE_POINTS), path, writers.shuttle_stop_feature()
    )
    return readers.shuttle_points(t.spark, path, lines=False)


@query("S5 as documents", sql=f"WITH {amenity_queries.STAGED} SELECT * EXCLUDE (last_updated) FROM staged")
def grocery_feed_documents(t: Given) -> DataFrame:
    path = new_path(t.spark, "grocery-documents")
    writers.write_collection(amenity_queries.features(t), path, F.col("feature"))
    found = readers.grocery_features(t.spark, path, lines=False)
    return amenities.stage_groceries(found).drop("last_updated")


@query("S5 P11 S11", sql=f"WITH {amenity_queries.STAGED} SELECT * EXCLUDE (last_updated) FROM staged")
def grocery_feed_file(t: Given) -> DataFrame:
    path = new_path(t.spark, "grocery-geojson")
    writers.write_features(amenity_queries.features(t), path, F.col("feature"))
    staged = new_path(t.spark, "grocery-staging")
    # A second load replaces the first.
    for _ in range(2):
        found = readers.grocery_features(t.spark, path)
        writers.replace_table(amenities.stage_groceries(found), staged)
    return t.spark.read.parquet(staged).drop("last_updated")


@query(
    "S6",
    sql="""SELECT address, 'first' AS summary, count(*) AS n_rows, count(*) AS n_issues
FROM {v_summaries} GROUP BY address""",
)
def summaries_file(t: Given) -> DataFrame:
    path = new_path(t.spark, "summaries-json")
    issues = F.array(
        F.struct(
            F.lit("Jan 04, 2025").alias("date"),
            F.array(F.struct(F.lit("x").alias("emoji"), F.lit("cold").alias("description"))).alias(
                "issues"
            ),
        )
    )
    body = F.struct(F.lit("first").alias("summary"), issues.alias("summarized_issues"))
    t.v_summaries.select(F.to_json(F.create_map("address", body)).alias("value")).write.text(path)
    rows = readers.address_summaries(t.spark, path)
    return rows.groupBy("address", F.col("summary.summary").alias("summary")).agg(
        F.count("*").alias("n_rows"),
        F.sum(F.size("summary.summarized_issues")).alias("n_issues"),
    )


@query(
    "S7 S12",
    sql=f"""SELECT type, name, address, TRY_CAST(lat AS DOUBLE) AS lat, TRY_CAST(lng AS DOUBLE) AS lng,
  4.5 AS rating, 7 AS user_ratings_total FROM ({amenity_queries.PLACES}) p""".replace(
        "4.5 AS rating", "CAST(4.5 AS DOUBLE) AS rating"
    ).replace("7 AS user", "CAST(7 AS BIGINT) AS user"),
)
def places_file(t: Given) -> DataFrame:
    path, table = new_path(t.spark, "places-json"), new_path(t.spark, "places-csv")
    place = F.struct(
        "name",
        F.col("address").alias("vicinity"),
        F.struct(
            F.struct(
                F.col("lat").try_cast("double").alias("lat"),
                F.col("lng").try_cast("double").alias("lng"),
            ).alias("location")
        ).alias("geometry"),
        F.lit(4.5).alias("rating"),
        F.lit(7).alias("user_ratings_total"),
    )
    # Result pages of a single place each; the reader takes pages of any length.
    pages = t.sql(amenity_queries.PLACES).select("type", F.array(place).alias("results"))
    writers.write_json(pages, path)
    writers.write_csv(readers.places(t.spark, path), table)
    return (
        t.spark.read.schema(
            "type string, name string, address string, lat double, lng double, "
            "rating double, user_ratings_total bigint"
        )
        .option("header", "true")
        .csv(table)
    )


# Shuttle routes with their stops: a supplier's nation as the route.
SYSTEM = """SELECT n_name AS name, 'S' || CAST(n_nationkey AS STRING) AS short_name,
  CAST(n_nationkey AS STRING) AS id, n_regionkey AS region, s_suppkey, s_name, s_acctbal
FROM {nation} JOIN {supplier} ON n_nationkey = s_nationkey"""


def _system(t: Given) -> DataFrame:
    stop = F.struct(
        F.col("s_suppkey").cast("string").alias("id"),
        F.col("s_name").alias("name"),
        F.col("s_acctbal").alias("latitude"),
        F.lit(-87.5).alias("longitude"),
    )
    return t.sql(SYSTEM).select(
        "name",
        F.col("short_name").alias("shortName"),
        "id",
        F.lit("#800000").alias("groupColor"),
        F.concat("name", F.lit(" line")).alias("fullname"),
        F.col("region").cast("double").alias("distance"),
        F.lit(41.5).alias("latitude"),
        F.lit(-87.5).alias("longitude"),
        F.array(stop).alias("stops"),
    )


@query(
    "S8 P10",
    sql=f"""SELECT CAST(s_suppkey AS STRING) AS stop_id, s_name AS stop_name, name AS route_name,
  CAST(-87.5 AS DOUBLE) AS x, s_acctbal AS y FROM ({SYSTEM}) s WHERE NOT contains(name, '_24')""",
)
def shuttle_system_file(t: Given) -> DataFrame:
    path, out = new_path(t.spark, "shuttle-system"), new_path(t.spark, "shuttle-geojson")
    writers.write_json(_system(t), path)
    routes = transit.without_name(readers.shuttle_system(t.spark, path), "name", "_24")
    writers.write_features(
        readers.shuttle_system_stops(routes), out, writers.shuttle_stop_feature()
    )
    return readers.shuttle_points(t.spark, out)


@query(
    "S12 shuttle routes",
    sql=f"""SELECT name AS "Route Name", short_name AS "Short Name", id AS "Route ID",
  '#800000' AS "Color", name || ' line' AS "Full Name", CAST(region AS DOUBLE) AS "Distance (m)",
  CAST(41.5 AS DOUBLE) AS "Latitude", CAST(-87.5 AS DOUBLE) AS "Longitude" FROM ({SYSTEM}) s""",
)
def shuttle_routes_file(t: Given) -> DataFrame:
    path = new_path(t.spark, "shuttle-routes-csv")
    writers.write_csv(writers.shuttle_routes_csv(_system(t)), path)
    kinds = {"Distance (m)": "double", "Latitude": "double", "Longitude": "double"}
    header = writers.schemas.SHUTTLE_ROUTE_HEADER
    schema = ", ".join(f"`{name}` {kinds.get(name, 'string')}" for name in header)
    return t.spark.read.schema(schema).option("header", "true").csv(path)


@query(
    "S9",
    sql="SELECT o_orderkey, o_custkey FROM {orders} WHERE o_orderpriority = '1-URGENT'",
)
def filtered_scan(t: Given) -> DataFrame:
    return readers.table(
        t.spark,
        f"{t.sf_dir}/orders.parquet",
        columns=["o_orderkey", "o_custkey"],
        where="o_orderpriority = '1-URGENT'",
    )


@query("S10", sql="SELECT stop_id, stop_name, lat, lon FROM {v_stops}")
def replaced_table(t: Given) -> DataFrame:
    path = new_path(t.spark, "stops")
    writers.replace_table(t.v_stops.select("stop_id"), path)
    writers.replace_table(t.v_stops, path)
    return t.spark.read.parquet(path)


@query(
    "S13 S1 tolerant",
    sql="""SELECT violation_id AS key, 'unreadable: violation_date, latitude' AS error
FROM {v_violations} WHERE inspection_category = 'PERMIT'""",
)
def violation_dead_letters(t: Given) -> DataFrame:
    path = new_path(t.spark, "dead-letters")
    broken = F.col("`INSPECTION CATEGORY`") == "PERMIT"
    raw = raw_rows(t).withColumns(
        {
            "VIOLATION DATE": F.when(broken, "31/31/1999").otherwise(F.col("`VIOLATION DATE`")),
            "LATITUDE": F.when(broken, "north").otherwise(F.col("LATITUDE")),
        }
    )
    _, bad = writers.split_dead_letters(readers.typed_violations(raw, strict=False))
    writers.append_dead_letters(bad, path, key="violation_id")
    return t.spark.read.schema("key string, error string").option("header", "true").csv(path)


@query(
    "U9 S10 Q10",
    sql=f"""WITH {transit_queries.BUILD}
SELECT 'stops' AS table_name, count(*) AS n FROM stops
UNION ALL SELECT 'routes', count(*) FROM all_routes WHERE n_lines IS NOT NULL
UNION ALL SELECT 'route_stops', count(*) FROM pairs WHERE route_id IN (SELECT route_id FROM known)
  AND stop_id IN (SELECT stop_id FROM stops)""",
)
def transit_reload(t: Given) -> DataFrame:
    base = new_path(t.spark, "transit")
    transit.transit_reload(*transit_queries.feed_rows(t), base)
    out = None
    for name in ("stops", "routes", "route_stops"):
        one = t.spark.read.parquet(f"{base}/{name}").agg(F.count("*").alias("n"))
        one = one.select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "U9 S10 S11 tables published together",
    sql=f"""WITH {transit_queries.BUILD}, loads AS (SELECT unnest(['before', 'during', 'after']) AS reader)
SELECT reader, 'stops' AS table_name, (SELECT count(*) FROM stops) AS n FROM loads WHERE reader <> 'before'
UNION ALL SELECT reader, 'routes', (SELECT count(*) FROM all_routes WHERE n_lines IS NOT NULL) FROM loads
  WHERE reader <> 'before'
UNION ALL SELECT reader, 'route_stops', (SELECT count(*) FROM pairs
    WHERE route_id IN (SELECT route_id FROM known) AND stop_id IN (SELECT stop_id FROM stops)) FROM loads
  WHERE reader <> 'before'
UNION ALL SELECT 'before', t, 0 FROM (SELECT unnest(['stops', 'routes', 'route_stops']) AS t)""",
)
def transit_published(t: Given) -> DataFrame:
    """What readers see before a load, while the next one is under way, and after it."""
    base = new_path(t.spark, "transit-versions")
    # Every load reads the feeds as they landed, and does not join their tables anew.
    stops, routes = (written(rows, "feed-rows") for rows in transit_queries.feed_rows(t))
    shelf = Versions(t.spark, base)
    transit.transit_publish(stops.limit(0), routes.limit(0), shelf)
    before = shelf.read(*transit.TABLES)
    transit.transit_publish(stops, routes, shelf)
    # A third load has written one of its tables, and is not published.
    stops.limit(5).write.parquet(f"{base}/versions/unfinished/stops")
    during = shelf.read(*transit.TABLES)
    transit.transit_publish(stops, routes, shelf)
    readers_of = {"before": before, "during": during, "after": shelf.read(*transit.TABLES)}
    out = None
    for reader, tables in readers_of.items():
        for name, table in tables.items():
            one = table.agg(F.count("*").alias("n")).select(
                F.lit(reader).alias("reader"), F.lit(name).alias("table_name"), "n"
            )
            out = one if out is None else out.unionByName(one)
    return out


@query(
    "S14 feature lines",
    sql="""SELECT 'Feature' AS type, 'Point' AS geometry_type, lon, lat, stop_name FROM {v_stops}""",
)
def stop_features_file(t: Given) -> DataFrame:
    path = new_path(t.spark, "stops-geojson")
    feature = ft.point_feature(F.col("lon"), F.col("lat"), F.struct("stop_name"))
    writers.write_features(t.v_stops, path, feature)
    read = t.spark.read.schema(
        "type string, geometry struct<type: string, coordinates: array<double>>, "
        "properties struct<stop_name: string>"
    ).json(path)
    return read.select(
        "type",
        F.col("geometry.type").alias("geometry_type"),
        F.get("geometry.coordinates", 0).alias("lon"),
        F.get("geometry.coordinates", 1).alias("lat"),
        "properties.stop_name",
    )


@query(
    "D1 observed",
    sql="""SELECT count(*) AS n_rows, true AS addresses_near FROM {v_violations}
WHERE inspection_category IN ('COMPLAINT', 'PERIODIC')""",
)
def observed_rows(t: Given) -> DataFrame:
    kept, seen = observed(with_categories(t.v_violations, CATEGORIES), "category")
    path = new_path(t.spark, "observed")
    writers.replace_table(kept.select("violation_id", "address"), path)
    stored = t.spark.read.parquet(path)
    # The observed count of addresses is an estimate, within a tenth of the exact one.
    near = F.abs(F.count_distinct("address") - seen.get["n_addresses"]) <= F.count_distinct("address") / 10 + 1
    return stored.agg(F.lit(seen.get["n_rows"]).cast("long").alias("n_rows"), near.alias("addresses_near"))
