"""Intake of searched addresses: match, box test, get or create the property."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stoopwise.functions import geo, text
from stoopwise.operators import merge
from stoopwise.operators.numbering import first_per_key
from stoopwise.operators.skew import salted_join
from stoopwise.params import NEIGHBOURHOOD, ROWS_PER_TASK, URBAN_AREA, Box
from stoopwise.session import written

# Texts of the answers.
NO_ADDRESS = "Address is required."
NO_MATCH = "No matched address found in Chicago."
OTHER_AREA = "Address is not inside Chicago, the area defined for the project."
INSIDE = "Address is inside the perimeter of the neighbourhood"
OUTSIDE = "Address is not inside the perimeter of the neighbourhood"


def _references(address_ref: DataFrame) -> DataFrame:
    """Lookup keys of the reference addresses: the full form, and the one without suffix.

    The first address by text wins a key, a full form before a shortened one.
    """
    full = text.normal_address(F.col("matched_address"))
    keyed = address_ref.withColumn(
        "_keys",
        F.array_distinct(F.array(full, text.without_suffix(full))),
    ).select("*", F.posexplode("_keys").alias("_rank", "_key"))
    return first_per_key(
        keyed.drop("_keys"),
        ["_key"],
        [F.col(c) for c in ("_rank", "matched_address", "lon", "lat", "urban_area")],
    ).drop("_rank")


def match_addresses(
    requests: DataFrame, address_ref: DataFrame, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Match typed addresses (request_id, address) with a table of known ones.

    ``address_ref`` has matched_address, lon, lat, urban_area. Both sides are
    normalised the same way and joined on the result; typed text without a street
    suffix finds the address through its shortened key. Popular searches are spread.
    """
    asked = requests.withColumn("_key", text.normal_address(F.col("address")))
    joined = salted_join(
        asked,
        _references(address_ref),
        ["_key"],
        salt_by=["request_id"],
        how="left",
        rows_per_task=rows_per_task,
    )
    error = (
        F.when(F.coalesce("address", F.lit("")) == "", NO_ADDRESS)
        .when(F.col("matched_address").isNull(), NO_MATCH)
        .when(~F.col("urban_area").eqNullSafe(F.lit(URBAN_AREA)), OTHER_AREA)
    )
    return joined.select(
        "request_id", "address", "matched_address", "lon", "lat", error.alias("error")
    )


def _stored(properties: DataFrame) -> Column:
    return F.col("stored") if "stored" in properties.columns else F.lit(True)


def new_properties(
    matched: DataFrame, properties: DataFrame, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Properties for matched addresses that are not there yet, with new ids.

    Where ``properties`` has a flag ``stored``, rows without it have a number that is
    taken, but are not there yet.
    """
    wanted = first_per_key(
        matched.where("error IS NULL").select(
            F.col("matched_address").alias("address"), "lon", "lat"
        ),
        ["address"],
        [F.col("lon"), F.col("lat")],
    )
    return merge.get_or_create(
        wanted, properties, "address", "property_id", rows_per_task, there=_stored(properties)
    ).select(
        "property_id", "address", "lon", "lat"
    )


def property_intake(
    requests: DataFrame,
    address_ref: DataFrame,
    properties: DataFrame,
    box: Box = NEIGHBOURHOOD,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Answer each search with its matched address, property id and box flag."""
    # The ids of new properties and the answers both need the matches.
    matched = written(match_addresses(requests, address_ref, rows_per_task), "matched")
    lowest = properties.where(_stored(properties)).groupBy("address").agg(F.min("property_id").alias("property_id"))
    created = new_properties(matched, properties, rows_per_task).select("address", "property_id")
    ids = lowest.unionByName(created).withColumnRenamed("address", "matched_address")
    located = matched.join(ids, "matched_address", "left")
    good = F.col("error").isNull()
    inside = geo.in_box(F.col("lat"), F.col("lon"), box)
    return located.select(
        "request_id",
        F.when(good, F.col("matched_address")).alias("cleaned_address"),
        F.when(good, F.col("property_id")).alias("property_id"),
        F.when(good, inside).alias("inside_box"),
        F.when(good, F.when(inside, INSIDE).otherwise(OUTSIDE)).alias("notes"),
        F.when(good, F.col("lon")).alias("lon"),
        F.when(good, F.col("lat")).alias("lat"),
        F.col("address").alias("label"),
        "error",
    )
