"""Grocery feed staging and synchronisation, and import of place results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stoopwise.functions import geo, text
from stoopwise.operators import merge
from stoopwise.operators.numbering import first_per_key, total_order
from stoopwise.params import PLACE_TO_AMENITY

GROCERY = "grocery"


def is_open_store(feature: Column) -> Column:
    """Whether a feed feature is an open store with an address and two coordinates."""
    point = feature["geometry"]
    return F.coalesce(
        feature["properties"]["address"].isNotNull()
        & (F.upper(feature["properties"]["new_status"]) == "OPEN")
        & point.isNotNull()
        & (F.size(point["coordinates"]) == 2),
        F.lit(False),
    )


def stage_groceries(features: DataFrame) -> DataFrame:
    """Feed features (one per row, column ``feature``) to staging rows."""
    feature = F.col("feature")
    properties, xy = feature["properties"], feature["geometry"]["coordinates"]
    lon, lat = F.element_at(xy, 1), F.element_at(xy, 2)
    return features.where(is_open_store(feature)).select(
        text.piped_id(properties["address"], lon, lat).alias("id"),
        properties["store_name"].alias("store_name"),
        properties["address"].alias("address"),
        properties["zip"].alias("zip"),
        lon.alias("longitude"),
        lat.alias("latitude"),
        properties["new_status"].alias("status"),
        text.parse_timestamp(properties["last_updated"]).alias("last_updated"),
    )


def as_amenities(staging: DataFrame) -> DataFrame:
    """One grocery per address: the row updated last, ties by id."""
    latest = first_per_key(
        staging, ["address"], [F.col("last_updated").desc_nulls_last(), F.col("id")]
    )
    return latest.select(
        "address",
        F.lit(GROCERY).alias("type"),
        F.col("store_name").alias("name"),
        F.col("longitude").alias("lon"),
        F.col("latitude").alias("lat"),
    )


def grocery_sync(amenities: DataFrame, staging: DataFrame) -> DataFrame:
    """Merge the staged groceries into the amenity table.

    The result has every amenity with an ``action``; amenities of other types are
    carried over untouched and never reach the join.
    """
    columns = ["address", "type", "name", "lon", "lat"]
    current = amenities.select(*columns)
    others = current.where(~F.col("type").eqNullSafe(F.lit(GROCERY)))
    merged = merge.sync(
        current.where(F.col("type") == GROCERY),
        as_amenities(staging),
        keys=["address", "type"],
        values=["name", "lon", "lat"],
    )
    return merged.unionByName(others.withColumn("action", F.lit("unchanged")))


def amenity_import(
    places: DataFrame, type_map: dict[str, str] = PLACE_TO_AMENITY
) -> tuple[DataFrame, DataFrame]:
    """Place rows of the mapped types to amenities; rows without a point are rejected.

    Of the rows of one address and type the first by all columns enters.
    """
    mapping = F.create_map(*[F.lit(x) for pair in type_map.items() for x in pair])
    wanted = places.where(F.col("type").isin(*type_map)).withColumn(
        "_point", geo.point_of(F.col("lat"), F.col("lng"))
    )
    imported = wanted.where("_point IS NOT NULL").select(
        F.coalesce("name", F.lit("")).alias("name"),
        F.try_element_at(mapping, F.col("type")).alias("type"),
        F.coalesce("address", F.lit("")).alias("address"),
        F.col("_point.lon").alias("lon"),
        F.col("_point.lat").alias("lat"),
    )
    rejected = wanted.where("_point IS NULL").select(
        *places.columns, F.lit("Invalid latitude/longitude values").alias("error")
    )
    return first_per_key(imported, ["address", "type"], total_order(imported)), rejected
