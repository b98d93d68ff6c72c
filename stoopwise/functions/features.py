"""GeoJSON features: building them, reading stored ones, rolling them up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stoopwise.params import MISSING_MINUTES

GEOMETRY = "type string, coordinates array<double>"
STOP_PROPERTIES = "stop_name string, distance_min double, routes array<string>, stop_id string"
GROCERY_PROPERTIES = "name string, distance_min double, address string"


def _feature(properties: str) -> str:
    return f"struct<type: string, geometry: struct<{GEOMETRY}>, properties: struct<{properties}>>"


STOP_FEATURE = _feature(STOP_PROPERTIES)
GROCERY_FEATURE = _feature(GROCERY_PROPERTIES)


def point_feature(lon: Column, lat: Column, properties: Column) -> Column:
    return F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias(
            "geometry"
        ),
        properties.alias("properties"),
    )


def multiline_feature(lines: Column, properties: Column) -> Column:
    """``lines`` is an array of arrays of ``struct<lon,lat>``."""
    coordinates = F.transform(
        lines, lambda line: F.transform(line, lambda p: F.array(p["lon"], p["lat"]))
    )
    return F.struct(
        F.lit("Feature").alias("type"),
        F.struct(
            F.lit("MultiLineString").alias("type"), coordinates.alias("coordinates")
        ).alias("geometry"),
        properties.alias("properties"),
    )


def collection(features: Column) -> Column:
    return F.struct(F.lit("FeatureCollection").alias("type"), features.alias("features"))


def stored_features(text: Column, envelope_key: str, feature: str) -> Column:
    """Features of a stored JSON text, whichever of its three shapes it has.

    Either ``{envelope_key: {features: [...]}}`` or ``{features: [...]}`` or the bare
    list; anything else gives an empty array.
    """
    shape = f"struct<{envelope_key}: struct<features: array<{feature}>>, features: array<{feature}>>"
    is_list = F.trim(text).startswith("[")
    wrapped = F.from_json(F.when(~is_list, text), shape)
    bare = F.from_json(F.when(is_list, text), f"array<{feature}>")
    # The envelope key decides as soon as it is there, even around an empty object.
    has_envelope = F.coalesce(F.get_json_object(text, f"$.{envelope_key}").isNotNull(), F.lit(False))
    found = (
        F.when(is_list, bare)
        .when(has_envelope, wrapped[envelope_key]["features"])
        .otherwise(wrapped["features"])
    )
    return F.coalesce(found, F.array().cast(f"array<{feature}>"))


def _valid(features: Column) -> Column:
    """Features with a properties object."""
    return F.filter(features, lambda f: f["properties"].isNotNull())


def minutes(feature: Column) -> Column:
    return F.coalesce(feature["properties"]["distance_min"], F.lit(float(MISSING_MINUTES)))


def within(features: Column, limit: int) -> Column:
    """Features with properties and at most ``limit`` walking minutes."""
    return F.filter(_valid(features), lambda f: minutes(f) <= limit)


def count_within(features: Column, limit: int) -> Column:
    return F.size(within(features, limit))


def count_all(features: Column) -> Column:
    return F.size(_valid(features))


def _routes(features: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.flatten(
        F.transform(features, lambda f: F.coalesce(f["properties"]["routes"], empty))
    )


def unique_routes(features: Column) -> Column:
    return F.array_sort(F.array_distinct(_routes(_valid(features))))


def routes_within(features: Column, limit: int) -> Column:
    return F.array_sort(F.array_distinct(_routes(within(features, limit))))


def routes_first_seen(features: Column, limit: int) -> Column:
    """Unique routes in the order of the features that carry them."""
    return F.array_distinct(_routes(within(features, limit)))


def names_within(features: Column, limit: int) -> Column:
    name = F.transform(
        within(features, limit),
        lambda f: F.coalesce(f["properties"]["name"], F.lit("Unknown Store")),
    )
    return F.array_sort(F.array_distinct(name))


def shortest_bucket(buckets: dict[int, Column], what: str) -> Column:
    """``"3 transit (5min): 55, 6, X28"`` for the first bucket that is not empty."""
    text = F.lit(None).cast("string")
    for limit, values in sorted(buckets.items(), reverse=True):
        line = F.concat(
            F.size(values).cast("string"),
            F.lit(f" {what} ({limit}min): "),
            F.array_join(values, ", "),
        )
        text = F.when(F.size(values) > 0, line).otherwise(text)
    return text
