"""Writers of tables, feeds and dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stoopwise import schemas
from stoopwise.functions import features as ft

# Features of one document at most; a document is a single value.
DOCUMENT_FEATURES = 8192


def replace_table(df: DataFrame, path: str) -> None:
    """Write the table anew.

    Spark deletes the old files before it commits the new ones: a reader in between, or
    after a failure, finds none. Give tables that are read meanwhile a new path instead.
    """
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", **options: str) -> None:
    df.write.mode(mode).options(header="true", escape='"', **options).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def split_dead_letters(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Good rows without the error column, and bad rows with it."""
    return df.where(F.col(error).isNull()).drop(error), df.where(F.col(error).isNotNull())


def append_dead_letters(df: DataFrame, path: str, key: str = "address") -> None:
    """Append (key, error) rows to the dead-letter file."""
    df.select(key, "error").write.mode("append").option("header", "true").csv(path)


def write_features(df: DataFrame, path: str, feature: Column) -> None:
    """Features one per line, the splittable form of a feature collection."""
    df.select(feature.alias("f")).select("f.*").write.mode("overwrite").json(path)


def write_listing(df: DataFrame, folder: str, source: str, feature: Column) -> None:
    """A listing of the refresh: features in part files of a folder, then one file in ``source`` that names it."""
    write_features(df, folder, feature)
    df.sparkSession.range(0, 1, 1, 1).select(F.lit(folder).alias("folder")).write.mode("append").json(source)


def write_collection(df: DataFrame, path: str, feature: Column, most: int = DOCUMENT_FEATURES) -> None:
    """Feature collections, one document per file, of up to ``most`` features of one partition each.

    Features are sorted in their partition, so that a task that runs again deals them alike.
    """
    made = df.select(feature.alias("f"))
    sorted_ = made.withColumn("_json", F.to_json("f")).sortWithinPartitions("_json").drop("_json")
    at = F.col("_at")
    place = at.bitwiseAND(F.lit((1 << 33) - 1))
    dealt = sorted_.withColumn("_at", F.monotonically_increasing_id()).select(
        "f", (at - place + F.floor(place / most)).alias("_file")
    )
    document = F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list("f").alias("features"))
    whole = dealt.groupBy("_file").agg(F.to_json(document).alias("value"))
    whole.write.mode("overwrite").partitionBy("_file").text(path)


def shuttle_stop_feature() -> Column:
    """Feature of the rows of ``shuttle_system_stops``."""
    return ft.point_feature(
        F.col("x"), F.col("y"), F.struct("stop_id", "stop_name", "route_name")
    )


def shuttle_routes_csv(routes: DataFrame) -> DataFrame:
    """The eight columns of the shuttle route file."""
    return routes.select(
        *[F.col(field).alias(name) for name, field in schemas.SHUTTLE_ROUTE_HEADER.items()]
    )
