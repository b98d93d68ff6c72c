"""Readers of the feeds. Every file format is read with a fixed schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stoopwise import schemas
from stoopwise.functions import text
from stoopwise.plans.summaries import from_address_map

# Quoted fields may hold line breaks, so a file is read as a whole: land many files.
CSV = {"header": "true", "multiLine": "true", "escape": '"'}


VIOLATION_RECORD = f"{schemas.VIOLATIONS_CSV}, {schemas.BROKEN} string"
VIOLATION_OPTIONS = CSV | {"columnNameOfCorruptRecord": schemas.BROKEN}


def raw_violations(spark: SparkSession, path: str) -> DataFrame:
    """The violations file as it is: spaced upper-case names, all text.

    Records with too few or too many fields stand in the column ``BROKEN``.
    """
    return spark.read.schema(VIOLATION_RECORD).options(**VIOLATION_OPTIONS).csv(path)


def _violation_field(name: str, kind: str, strict: bool) -> Column:
    raw = F.col(f"`{name}`")
    if kind == "date":
        return text.parse_date(raw, strict)
    if kind == "string":
        return raw
    filled = F.nullif(F.trim(raw), F.lit(""))
    return filled.cast(kind) if strict else filled.try_cast(kind)


def typed_violations(raw: DataFrame, strict: bool = True) -> DataFrame:
    """Typed violation columns plus ``location``; broken text and records raise.

    Not ``strict`` they give null, and ``error`` names the broken fields.
    """
    whole = F.col(schemas.BROKEN).isNull() if schemas.BROKEN in raw.columns else F.lit(True)
    if strict and schemas.BROKEN in raw.columns:
        message = F.concat(F.lit("broken record: "), F.col(schemas.BROKEN))
        raw = raw.withColumn("ID", F.when(whole, F.col("ID")).otherwise(F.raise_error(message)))
    fields = {
        new: _violation_field(old, kind, strict)
        for old, (new, kind) in schemas.VIOLATION_COLUMNS.items()
    }
    errors = []
    if not strict:
        # The one element of an array that is exploded: what reads the names, such as a
        # condition on the error, then does not parse every field once more.
        raw = raw.select("*", F.explode(F.array(_broken_fields(fields))).alias("_names"))
        named = F.when(F.col("_names") != "", F.concat(F.lit("unreadable: "), F.col("_names")))
        errors = [F.when(whole, named).otherwise(F.lit("unreadable: record")).alias("error")]
    typed = raw.select(*[c.alias(n) for n, c in fields.items()], *errors)
    point = F.when(
        F.col("latitude").isNotNull() & F.col("longitude").isNotNull(),
        F.struct(F.col("longitude").alias("lon"), F.col("latitude").alias("lat")),
    )
    return typed.withColumn("location", point)


def _broken_fields(fields: dict[str, Column]) -> Column:
    """Names of the fields whose text could not be read; empty if there is none.

    Joined as text, not filtered as an array: functions on lambdas are evaluated tree by
    tree, and with them every field.
    """
    broken = [F.when(F.nullif(F.trim(F.col("`ID`")), F.lit("")).isNull(), F.lit("violation_id"))]
    for old, (new, kind) in schemas.VIOLATION_COLUMNS.items():
        if kind != "string":
            filled = F.trim(F.col(f"`{old}`")) != ""
            broken.append(F.when(filled & fields[new].isNull(), F.lit(new)))
    return F.concat_ws(", ", *broken)


def violations(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return typed_violations(raw_violations(spark, path), strict)


def stop_rows(spark: SparkSession, path: str) -> DataFrame:
    """Stop file without a header; five of its eight positional columns are kept."""
    rows = spark.read.schema(schemas.STOPS_CSV).option("header", "false").csv(path)
    return rows.select("stop_id", "route_id", "stop_name", "latitude", "longitude")


def route_rows(spark: SparkSession, path: str) -> DataFrame:
    """Route file whose own header is replaced by position."""
    as_text = ", ".join(f"c{i} string" for i in range(len(schemas.ROUTE_NAMES)))
    rows = (
        spark.read.schema(as_text).options(**CSV).option("enforceSchema", "true").csv(path)
    )
    return rows.toDF(*schemas.ROUTE_NAMES).select("route_id", "route_name", "geometry")


def geojson_features(
    spark: SparkSession, path: str, feature: str, lines: bool = True
) -> DataFrame:
    """Features of GeoJSON files, one per row in column ``feature``.

    A feature collection is one JSON document, so each file is read by one task; big
    feeds should be landed with one feature per line (``lines``), which Spark splits.
    """
    if lines:
        schema = feature.replace(": struct", " struct")
        rows = spark.read.schema(f"type string, {schema}").json(path)
        return rows.select(F.struct(*[F.col(c) for c in rows.columns if c != "type"]).alias("feature"))
    rows = spark.read.schema(f"features array<struct<{feature}>>").option(
        "multiLine", "true"
    ).json(path)
    return rows.select(F.explode("features").alias("feature"))


def shuttle_points(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Shuttle stop features as stop_id, stop_name, route_name, x, y."""
    found = geojson_features(spark, path, schemas.SHUTTLE_STOPS, lines)
    xy = F.col("feature.geometry.coordinates")
    return found.select("feature.properties.*", F.get(xy, 0).alias("x"), F.get(xy, 1).alias("y"))


def grocery_features(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    return geojson_features(spark, path, schemas.GROCERY_FEED, lines)


def address_summaries(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Files that hold ``{address: summary}`` objects, one per file or one per line."""
    return from_address_map(spark.read.text(path, wholetext=not lines))


def places(spark: SparkSession, path: str) -> DataFrame:
    """Landed result pages (type, results) to one row per place."""
    pages = spark.read.schema(schemas.PLACES).json(path)
    return pages.select("type", F.explode("results").alias("p")).select(
        "type",
        "p.name",
        F.col("p.vicinity").alias("address"),
        F.col("p.geometry.location.lat").alias("lat"),
        F.col("p.geometry.location.lng").alias("lng"),
        "p.rating",
        "p.user_ratings_total",
    )


def shuttle_system(spark: SparkSession, path: str) -> DataFrame:
    """Landed shuttle routes with their stops, one route per line."""
    return spark.read.schema(schemas.SHUTTLE_SYSTEM).json(path)


def shuttle_system_stops(routes: DataFrame) -> DataFrame:
    """Stops of each route, tagged with the route's name."""
    return routes.select(F.explode("stops").alias("s"), F.col("name").alias("route_name")).select(
        F.col("s.id").alias("stop_id"),
        F.col("s.name").alias("stop_name"),
        "route_name",
        F.col("s.longitude").alias("x"),
        F.col("s.latitude").alias("y"),
    )


def table(
    spark: SparkSession, path: str, columns: Sequence[str] = ("*",), where: str | None = None
) -> DataFrame:
    """A stored table; columns and condition reach the scan."""
    rows = spark.read.parquet(path)
    return (rows.where(where) if where else rows).select(*columns)
