"""What is within walking distance of each property."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stoopwise.functions import features as ft
from stoopwise.functions import geo
from stoopwise.operators.radius import CELL, cell_columns, radius_join
from stoopwise.operators.skew import salted_join
from stoopwise.operators.stored_grid import StoredGrid
from stoopwise.params import METRES_PER_MINUTE, ROWS_PER_TASK, TIME_BUCKETS
from stoopwise.session import written


def stops_with_routes(stops: DataFrame, route_stops: DataFrame) -> DataFrame:
    """Each stop with the sorted array of its routes; a stop without any gets an empty one."""
    routes = (
        route_stops.select("stop_id", "route_id")
        .distinct()
        .groupBy("stop_id")
        .agg(F.array_sort(F.collect_list("route_id")).alias("routes"))
    )
    empty = F.array().cast("array<string>")
    return stops.join(routes, "stop_id", "left").withColumn("routes", F.coalesce("routes", empty))


def _near_stops(points: DataFrame, served: DataFrame, radius_m: float | str) -> DataFrame:
    """Every stop in reach of every point; the routes travel with the stop.

    So the pairs need no join of their own to find them, which would shuffle by far
    the largest table of the job. ``served`` are rows of ``stops_with_routes``, written,
    for they are read to weigh the cells and to join them.
    """
    pairs = radius_join(
        points,
        served.select("stop_id", "routes", "lat", "lon"),
        radius_m,
        point_id="property_id",
        target_id="stop_id",
    )
    return pairs.select(
        *cell_columns(pairs), "property_id", "stop_id", "routes", "distance_m"
    )


def new_route_stops(near: DataFrame) -> DataFrame:
    """Walking outwards from a property, the stops that bring a route not seen before.

    A stop passed over adds no route, so the routes seen before a stop are those of
    all nearer stops: a stop is kept exactly when it is the first one, by distance and
    id, for some route. A stop without routes is never first for any. Rows of
    ``radius_join`` are grouped where they are, by their cells.

    Stops are numbered outwards before their routes are laid out: least numbers are hashed
    together, while least pairs of distance and id would have every route sorted.
    """
    place = cell_columns(near)
    outwards = Window.partitionBy(*place, "property_id").orderBy("distance_m", "stop_id")
    first = (
        near.withColumn("_nth", F.row_number().over(outwards))
        .withColumn("_route", F.explode("routes"))
        .groupBy("property_id", "_route", *place)
        .agg(F.min_by("stop_id", "_nth").alias("stop_id"), F.min_by("distance_m", "_nth").alias("distance_m"))
    )
    return first.groupBy("property_id", "stop_id", *place).agg(F.min("distance_m").alias("distance_m")).drop(*place)


def _described(rows: DataFrame, served: DataFrame, m_per_min: float) -> DataFrame:
    """Add name, place, routes and walking minutes to (property_id, stop_id, distance_m).

    A stop next to very many properties makes a skewed partition, which the adaptive
    join splits; counting the stops first would compute all the pairs twice.
    """
    facts = served.select(
        "stop_id",
        "stop_name",
        "routes",
        F.col("lat").alias("target_lat"),
        F.col("lon").alias("target_lon"),
    )
    joined = rows.join(facts, "stop_id")
    return joined.withColumn("distance_min", geo.stop_minutes(F.col("distance_m"), m_per_min))


def stops_all(
    points: DataFrame,
    stops: DataFrame,
    route_stops: DataFrame,
    minutes: float,
    m_per_min: float = METRES_PER_MINUTE,
) -> DataFrame:
    """Every stop in walking distance of every point, with its routes.

    ``points`` has property_id, lat, lon.
    """
    served = written(stops_with_routes(stops, route_stops), "served-stops")
    pairs = radius_join(
        points.select("property_id", "lat", "lon"),
        served.select("stop_id", "stop_name", "routes", "lat", "lon"),
        minutes * m_per_min,
        point_id="property_id",
        target_id="stop_id",
    )
    return pairs.withColumn("distance_min", geo.stop_minutes(F.col("distance_m"), m_per_min)).drop(
        "lat", "lon", *CELL
    )


def walk_stops(
    properties: DataFrame,
    stops: DataFrame,
    route_stops: DataFrame,
    minutes: float = 5,
    m_per_min: float = METRES_PER_MINUTE,
) -> DataFrame:
    """Per property the stops within ``minutes`` that bring a new route."""
    served = written(stops_with_routes(stops, route_stops), "served-stops")
    near = _near_stops(properties.select("property_id", "lat", "lon"), served, minutes * m_per_min)
    return _described(new_route_stops(near), served, m_per_min)


def walk_stops_stored(
    grid: StoredGrid, properties: DataFrame, minutes: float = 5, m_per_min: float = METRES_PER_MINUTE
) -> DataFrame:
    """``walk_stops`` on stored rows of ``stops_with_routes``: only properties are shuffled to meet them."""
    near = grid.near(properties.select("property_id", "lat", "lon"), minutes * m_per_min, "property_id")
    return _described(new_route_stops(near), grid.targets, m_per_min)


def walk_groceries(
    properties: DataFrame,
    amenities: DataFrame,
    minutes: float = 15,
    m_per_min: float = METRES_PER_MINUTE,
    keep_cells: bool = False,
) -> DataFrame:
    """Per property the grocery stores within ``minutes``.

    With ``keep_cells`` the rows can be ranked or listed without another shuffle.
    """
    groceries = amenities.where(F.col("type") == "grocery").select(
        "amenity_id", "name", "address", "lat", "lon"
    )
    pairs = radius_join(
        properties.select("property_id", "lat", "lon"),
        groceries,
        minutes * m_per_min,
        point_id="property_id",
        target_id="amenity_id",
    )
    return pairs.withColumn(
        "distance_min", geo.grocery_minutes(F.col("distance_m"), m_per_min)
    ).drop("lat", "lon", *([] if keep_cells else CELL))


def nearest_first(rows: DataFrame, id_name: str) -> DataFrame:
    """Rank the rows of each property by distance."""
    place = cell_columns(rows)
    window = Window.partitionBy(*place, "property_id").orderBy("distance_m", id_name)
    return rows.withColumn("nearest", F.row_number().over(window))


def _listed(rows: DataFrame, id_name: str, feature: Column) -> DataFrame:
    """The features of each property in one array, nearest first.

    A response is one value by nature; rows of any number of properties spread over the
    tasks, and the pairs of a property are in one place already.
    """
    place = cell_columns(rows)
    entry = F.struct("distance_m", id_name, feature.alias("feature"))
    grouped = rows.groupBy(*place, "property_id").agg(F.sort_array(F.collect_list(entry)).alias("_all"))
    return grouped.select("property_id", F.transform("_all", lambda x: x["feature"]).alias("features"))


def _envelope(
    listed: DataFrame, properties: DataFrame, minutes: float, key: str, feature: str
) -> DataFrame:
    """One response per property; a property without features gets an empty one."""
    empty = F.array().cast(f"array<{feature}>")
    return (
        properties.select("property_id", "address")
        .join(listed, "property_id", "left")
        .select(
            "property_id",
            F.when(F.col("features").isNull(), "empty").otherwise("found").alias("status"),
            F.struct(
                F.col("address"),
                F.lit(minutes).alias("walking_time"),
                ft.collection(F.coalesce("features", empty)).alias(key),
            ).alias("response"),
        )
    )


def stop_responses(kept: DataFrame, properties: DataFrame, minutes: float) -> DataFrame:
    """GeoJSON responses from the rows of ``walk_stops``."""
    feature = ft.point_feature(
        F.col("target_lon"),
        F.col("target_lat"),
        F.struct(
            "stop_name",
            F.col("distance_min").cast("double").alias("distance_min"),
            "routes",
            F.col("stop_id").cast("string").alias("stop_id"),
        ),
    )
    return _envelope(_listed(kept, "stop_id", feature), properties, minutes, "bus_stops_geojson", ft.STOP_FEATURE)


def grocery_responses(near: DataFrame, properties: DataFrame, minutes: float) -> DataFrame:
    """GeoJSON responses from the rows of ``walk_groceries``."""
    feature = ft.point_feature(
        F.col("target_lon"), F.col("target_lat"), F.struct("name", "distance_min", "address")
    )
    return _envelope(_listed(near, "amenity_id", feature), properties, minutes, "grocery_geojson", ft.GROCERY_FEATURE)


def transit_rollups(features: Column) -> dict[str, Column]:
    """Columns that summarise the stop features of one property."""
    out = {f"stops_within_{t}": ft.count_within(features, t) for t in TIME_BUCKETS}
    out["total_stops"] = ft.count_all(features)
    out["unique_routes"] = ft.unique_routes(features)
    out["routes_count"] = F.size(ft.unique_routes(features))
    out |= {f"routes_within_{t}": ft.routes_within(features, t) for t in TIME_BUCKETS}
    out["best_transit"] = ft.shortest_bucket(
        {t: ft.routes_within(features, t) for t in TIME_BUCKETS}, "transit"
    )
    return out


def grocery_rollups(features: Column) -> dict[str, Column]:
    """Columns that summarise the grocery features of one property."""
    out = {f"groceries_within_{t}": ft.names_within(features, t) for t in TIME_BUCKETS}
    out["best_grocery"] = ft.shortest_bucket(
        {t: ft.names_within(features, t) for t in TIME_BUCKETS}, "grocery"
    )
    return out


def check_requests(requests: DataFrame, zero_minutes_allowed: bool) -> DataFrame:
    """Add ``error`` (null for a good request) and the coordinates of the geocode.

    ``requests`` has property_id, geocode and walking_time. A stop request of zero
    minutes is an error, a grocery request is not; its time is not checked at all.
    """
    point = geo.geocode(F.col("geocode"))
    error = (
        F.when(F.coalesce(F.col("property_id").cast("string"), F.lit("")) == "",
               "property_id is required")
        .when(F.coalesce("geocode", F.lit("")) == "", "geocode is required")
    )
    if not zero_minutes_allowed:
        error = error.when(
            F.coalesce("walking_time", F.lit(0)) == 0, "walking_time is required"
        ).when(F.col("walking_time") < 0, "walking_time must be greater than 0")
    error = error.when(point.isNull(), "Failure in parsing request")
    return requests.withColumn("error", error).withColumns(
        {"lat": point["lat"], "lon": point["lon"]}
    )


def requested_stops(
    requests: DataFrame,
    properties: DataFrame,
    stops: DataFrame,
    route_stops: DataFrame,
    m_per_min: float = METRES_PER_MINUTE,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Answer many stop requests, each with its own walking time, in one join.

    ``requests`` has request_id, property_id, geocode, walking_time. Rows come out per
    kept stop; a request that fails has a single row with its error.
    """
    # Read four times below; the parsed coordinates are kept rather than parsed again.
    checked = written(check_requests(requests, zero_minutes_allowed=False), "requests")
    points = checked.where("error IS NULL").select(
        F.col("request_id").alias("property_id"),
        "lat",
        "lon",
        (F.col("walking_time") * F.lit(float(m_per_min))).alias("_radius"),
    )
    served = written(stops_with_routes(stops, route_stops), "served-stops")
    near = _near_stops(points, served, "_radius")
    kept = new_route_stops(near).select(
        F.col("property_id").alias("request_id"),
        "stop_id",
        geo.stop_minutes(F.col("distance_m"), m_per_min).alias("distance_min"),
    )
    known = properties.select("property_id", F.lit(True).alias("_known"))
    # Many requests can be about one property, so it is looked up before they multiply.
    asked = salted_join(
        checked,
        known,
        ["property_id"],
        salt_by=["request_id"],
        how="left",
        rows_per_task=rows_per_task,
    )
    answers = asked.join(kept, "request_id", "left")
    # The order of the tests is the order in which a request can fail.
    error = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("stop_id").isNull(), "No bus stops found within the walking distance")
        .when(F.col("_known").isNull(), "Invalid property_id")
    )
    return (
        answers.withColumn("error", error)
        .select(
            "request_id",
            "property_id",
            "walking_time",
            F.when(error.isNull(), F.col("stop_id")).alias("stop_id"),
            F.when(error.isNull(), F.col("distance_min")).alias("distance_min"),
            "error",
        )
        .dropDuplicates(["request_id", "stop_id"])
    )
