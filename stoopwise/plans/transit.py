"""Transit stops and routes: building the tables and drawing routes."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoopwise.functions import features as ft
from stoopwise.functions import geo, text
from stoopwise.operators import merge
from stoopwise.operators.filters import mentions, one_of
from stoopwise.params import (
    EXCLUDED_ROUTES,
    SHUTTLE_RENAMES,
    SHUTTLES_DROPPED,
    SHUTTLES_KEPT,
)
from stoopwise.sources.versions import Versions
from stoopwise.sources.writers import replace_table


class Transit(NamedTuple):
    stops: DataFrame
    routes: DataFrame
    route_stops: DataFrame
    rejects: DataFrame


def cta_stops(rows: DataFrame) -> DataFrame:
    """Stop rows (one per stop and route) without rail lines and unknown routes."""
    return rows.where(~one_of(F.col("route_id").cast("string"), EXCLUDED_ROUTES)).select(
        F.col("stop_id").cast("string"),
        F.col("route_id").cast("string"),
        "stop_name",
        "latitude",
        "longitude",
        F.lit("cta").alias("type"),
    )


def shuttle_stops(points: DataFrame) -> DataFrame:
    """Shuttle stops of the daytime routes.

    Ids are multiplied by 1000 so that they do not meet the ids of the other feed.
    ``points`` has stop_id, stop_name, route_name, x, y.
    """
    renamed = points.replace(SHUTTLE_RENAMES, subset=["route_name"])
    kept = renamed.where(
        ~one_of(F.col("route_name"), SHUTTLES_DROPPED) & F.col("route_name").isin(*SHUTTLES_KEPT)
    )
    return kept.select(
        (F.col("stop_id").cast("long") * 1000).cast("string").alias("stop_id"),
        F.col("route_name").alias("route_id"),
        "stop_name",
        F.col("y").alias("latitude"),
        F.col("x").alias("longitude"),
        F.lit("shuttle").alias("type"),
    )


def cta_routes(rows: DataFrame) -> DataFrame:
    """Route rows with WKT geometry to arrays of lines."""
    return rows.select(
        F.col("route_id").cast("string"),
        F.col("route_name").alias("name"),
        F.lit("cta").alias("type"),
        geo.lines_from_wkt(F.col("geometry")).alias("geometry"),
    )


def shuttle_routes(points: DataFrame) -> DataFrame:
    """Line points (route, line_no, seq, lon, lat) to one multi-line per route.

    ``seq`` counts the points of a line. Points become lines and lines become routes in
    two steps, so no task sorts the points of more than a line.
    """
    lines = (
        points.select(F.col("route").alias("route_id"), "line_no", "seq", "lon", "lat")
        .distinct()
        .groupBy("route_id", "line_no")
        .agg(F.sort_array(F.collect_list(F.struct("seq", "lon", "lat"))).alias("_points"))
    )
    line = F.transform("_points", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    ordered = F.sort_array(F.collect_list(F.struct("line_no", "_line")))
    return (
        lines.withColumn("_line", line)
        .groupBy("route_id")
        .agg(F.transform(ordered, lambda x: x["_line"]).alias("geometry"))
        .select("route_id", F.upper("route_id").alias("name"), F.lit("shuttle").alias("type"), "geometry")
    )


def _placed(stop_rows: DataFrame) -> DataFrame:
    return stop_rows.withColumn("_point", geo.point_of(F.col("latitude"), F.col("longitude")))


def transit_stops(stop_rows: DataFrame) -> DataFrame:
    """Stops with a valid point; the first row of an id wins."""
    good = _placed(stop_rows).where("_point IS NOT NULL").select(
        "stop_id",
        F.coalesce("stop_name", F.lit("")).alias("stop_name"),
        "type",
        F.col("_point.lon").alias("lon"),
        F.col("_point.lat").alias("lat"),
    )
    return merge.insert_ignore(good, ["stop_id"])


def transit_routes(route_rows: DataFrame) -> DataFrame:
    """Routes with a line geometry; the first row of an id wins."""
    return merge.insert_ignore(route_rows.where("geometry IS NOT NULL"), ["route_id"])


def link(
    stop_rows: DataFrame, route_rows: DataFrame, stops: DataFrame, routes: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Pairs of a known route and a known stop, and the rejected rows with a reason.

    When both are unknown the route is the reason given.
    """
    pairs = stop_rows.select("route_id", "stop_id").distinct()
    known_routes = routes.select("route_id").distinct()
    known_stops = stops.select("stop_id")
    on_route = pairs.join(known_routes, "route_id", "left_semi")
    route_stops = on_route.join(known_stops, "stop_id", "left_semi")
    nothing = F.lit(None).cast("string")
    rejects = (
        pairs.join(known_routes, "route_id", "left_anti")
        .select("route_id", "stop_id", F.lit("unknown route").alias("reason"))
        .unionByName(
            on_route.join(known_stops, "stop_id", "left_anti").select(
                "route_id", "stop_id", F.lit("unknown stop").alias("reason")
            )
        )
        .unionByName(
            _placed(stop_rows)
            .where("_point IS NULL")
            .select(nothing.alias("route_id"), "stop_id", F.lit("no valid point").alias("reason"))
        )
        .unionByName(
            route_rows.where("geometry IS NULL").select(
                "route_id", nothing.alias("stop_id"), F.lit("no line geometry").alias("reason")
            )
        )
    )
    return route_stops.select("route_id", "stop_id"), rejects


def transit_build(stop_rows: DataFrame, route_rows: DataFrame) -> Transit:
    """Stop rows and route rows of all feeds to stops, routes, their pairs and rejects."""
    stops, routes = transit_stops(stop_rows), transit_routes(route_rows)
    return Transit(stops, routes, *link(stop_rows, route_rows, stops, routes))


TABLES = ("stops", "routes", "route_stops")


def transit_publish(stop_rows: DataFrame, route_rows: DataFrame, shelf: Versions) -> int:
    """Build the three tables anew and publish them as one version.

    Unlike ``transit_reload`` a reader never meets tables of two loads, and a load that
    fails changes nothing.
    """
    built = transit_build(stop_rows, route_rows)
    return shelf.publish({name: getattr(built, name) for name in TABLES}, after=shelf.latest())


def transit_reload(stop_rows: DataFrame, route_rows: DataFrame, base: str) -> None:
    """Replace the stored tables: routes, then stops, then the pairs of what was stored."""
    spark = stop_rows.sparkSession
    replace_table(transit_routes(route_rows), f"{base}/routes")
    replace_table(transit_stops(stop_rows), f"{base}/stops")
    stops, routes = (spark.read.parquet(f"{base}/{name}") for name in ("stops", "routes"))
    route_stops, rejects = link(stop_rows, route_rows, stops, routes)
    replace_table(route_stops, f"{base}/route_stops")
    replace_table(rejects, f"{base}/rejects")


def pair_problems(pairs: DataFrame, routes: DataFrame, stops: DataFrame) -> DataFrame:
    """Pairs whose route, else whose stop, is unknown."""
    distinct = pairs.select("route_id", "stop_id").distinct()
    known = routes.select("route_id").distinct()
    return (
        distinct.join(known, "route_id", "left_anti")
        .select("route_id", "stop_id", F.lit("route").alias("unknown"))
        .unionByName(
            distinct.join(known, "route_id", "left_semi")
            .join(stops.select("stop_id").distinct(), "stop_id", "left_anti")
            .select("route_id", "stop_id", F.lit("stop").alias("unknown"))
        )
    )


def without_name(rows: DataFrame, name: str, word: str) -> DataFrame:
    """Rows whose name does not contain the word; a missing name stays."""
    return rows.where(~mentions(F.col(name), word))


def requested_routes(requests: DataFrame) -> DataFrame:
    """Requests (request_id, routes as comma list) to one row per route with its colour.

    The colour depends on the position and the number of all listed tokens, also of
    repeated and unknown ones; of a repeated route the last position counts.
    """
    # Blank text lists nothing and so asks for nothing.
    listed = requests.withColumn("_ids", text.comma_list(F.col("routes")))
    places = listed.select(
        "request_id", F.size("_ids").alias("_n"), F.posexplode("_ids").alias("_at", "route_id")
    )
    last = places.groupBy("request_id", "route_id").agg(
        F.max("_at").alias("_at"), F.first("_n").alias("_n")
    )
    hue = F.floor(360 * F.col("_at") / F.col("_n")).cast("int")
    color = F.concat(F.lit("hsl("), hue.cast("string"), F.lit(", 100%, 45%)"))
    return last.select("request_id", "route_id", color.alias("color"))


def route_map(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """Coloured routes of each request, one row per request and route.

    A route that most requests ask for is left to the adaptive join.
    """
    return requested_routes(requests).join(routes, "route_id")


def routes_of_stops(near: DataFrame, routes: DataFrame) -> DataFrame:
    """The known routes that serve the stops near each property, each once.

    ``near`` are rows of ``walk_stops``, whose ``routes`` need no look-up of their own.
    """
    served = near.select("property_id", F.explode("routes").alias("route_id")).distinct()
    return served.join(routes, "route_id")


def request_errors(requests: DataFrame, found: DataFrame) -> DataFrame:
    """Requests that list nothing, or nothing that is known."""
    answered = found.select("request_id").distinct()
    missing = requests.join(answered, "request_id", "left_anti")
    blank = F.size(text.comma_list(F.col("routes"))) == 0
    return missing.select(
        "request_id",
        F.when(F.coalesce(blank, F.lit(True)), "No valid input")
        .otherwise("This route is not available in our database")
        .alias("error"),
    )


def route_features(found: DataFrame) -> DataFrame:
    """GeoJSON feature per row of ``route_map``."""
    feature = ft.multiline_feature(
        F.col("geometry"), F.struct("route_id", "name", "type", "color")
    )
    return found.select("request_id", "route_id", feature.alias("feature"))


def route_collections(found: DataFrame) -> DataFrame:
    """The answer to each request: its routes as one feature collection, by route id."""
    entry = F.struct("route_id", "feature")
    grouped = route_features(found).groupBy("request_id").agg(F.sort_array(F.collect_list(entry)).alias("_all"))
    features = F.transform("_all", lambda x: x["feature"])
    return grouped.select("request_id", ft.collection(features).alias("response"))
