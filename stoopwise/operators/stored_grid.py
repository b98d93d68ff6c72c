"""Targets of radius joins, stored by grid cell, so that each join moves its points only."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stoopwise.functions.geo import EARTH_RADIUS_M, haversine, is_place
from stoopwise.operators.radius import PAIRS_PER_TASK, SLACK, _Bounds, _Grid
from stoopwise.operators.skew import BROADCAST_KEYS
from stoopwise.session import written

CELL = ["_band", "_column"]


class StoredGrid:
    """Targets copied to the cells a circle of ``radius_m`` around them touches, bucketed by cell.

    ``path/cells`` holds the copies, ``path/weights`` their number per cell, ``path/targets``
    the targets themselves. The buckets are files of ``path/cells``; a session knows them by
    a table of its own catalog, which ``open`` makes again for stored files.
    """

    def __init__(self, spark: SparkSession, path: str, table: str, radius_m: float, buckets: int):
        self.spark, self.path, self.table, self.radius_m, self.buckets = spark, path, table, radius_m, buckets
        self.targets = spark.read.parquet(f"{path}/targets")

    @classmethod
    def write(cls, targets: DataFrame, path: str, radius_m: float, buckets: int) -> StoredGrid:
        """Store ``targets`` (lat, lon and more) for joins of up to ``radius_m``, in ``buckets`` buckets.

        Targets without a place are kept in ``path/targets`` alone. Take as many buckets as
        the largest join should have tasks.
        """
        spark = targets.sparkSession
        targets.write.parquet(f"{path}/targets")
        grid = _Grid(*_Bounds.of(radius_m))
        rows = (
            spark.read.parquet(f"{path}/targets")
            .where(is_place(F.col("lat"), F.col("lon")))
            .withColumnsRenamed({"lat": "target_lat", "lon": "target_lon"})
            .withColumn("_target_cos", F.cos(F.radians("target_lat")))
            .withColumn("_band", F.explode(grid.reached_bands(F.col("target_lat"))))
            .withColumn("_columns", grid.columns(F.col("_band")))
        )
        first, last = grid.reached_columns(F.col("target_lat"), F.col("target_lon"), F.col("_columns"))
        # A circle that reaches all around takes every column once.
        reached = F.sequence(first, F.least(last, first + F.col("_columns") - 1))
        cells = rows.withColumn("_column", F.explode(reached)).withColumn("_column", F.pmod("_column", "_columns")).drop("_columns")
        table = f"grid_{uuid.uuid4().hex}"
        by_bucket = cells.repartition(buckets, *CELL).write.format("parquet").option("path", f"{path}/cells")
        by_bucket.bucketBy(buckets, *CELL).sortBy(*CELL).saveAsTable(table)
        spark.table(table).groupBy(*CELL).agg(F.count("*").alias("_targets")).write.parquet(f"{path}/weights")
        return cls(spark, path, table, radius_m, buckets)

    @classmethod
    def open(cls, spark: SparkSession, path: str, radius_m: float, buckets: int) -> StoredGrid:
        """A grid that ``write`` stored with this radius and number of buckets, in another session too."""
        table = f"grid_{uuid.uuid4().hex}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/cells").schema)
        spark.sql(
            f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({', '.join(CELL)}) "
            f"SORTED BY ({', '.join(CELL)}) INTO {buckets} BUCKETS LOCATION '{path}/cells'"
        )
        return cls(spark, path, table, radius_m, buckets)

    def near(
        self, points: DataFrame, radius_m: float, point_id: str, pairs_per_task: int = PAIRS_PER_TASK
    ) -> DataFrame:
        """The pairs of ``radius_join`` with these targets, with ``_band``, ``_column``, ``_salt``.

        Targets are read where they lie. Points of cells in which a task would compare more
        than ``pairs_per_task`` pairs, by the stored weights, take another way: they are
        spread over salts, and the targets of these cells alone are copied to each.
        """
        if radius_m > self.radius_m:
            raise ValueError(f"stored for {self.radius_m} m, asked for {radius_m} m")
        grid = _Grid(*_Bounds.of(self.radius_m))
        placed = (
            points.where(is_place(F.col("lat"), F.col("lon")) & F.lit(radius_m >= 0))
            .withColumns({"_band": grid.band(F.col("lat")), "_cos": F.cos(F.radians("lat"))})
            .withColumn("_columns", grid.columns(F.col("_band")))
            .withColumn("_column", F.pmod(grid.column(F.col("lon"), F.col("_columns")), "_columns"))
            .drop("_columns")
        )
        weights = self.spark.read.parquet(f"{self.path}/weights")
        pairs = F.col("_points").cast("double") * F.col("_targets")
        splits = F.least(F.ceil(pairs / pairs_per_task), F.col("_points")).cast("int")
        # At most all pairs / pairs_per_task cells.
        hot = written(
            placed.groupBy(*CELL).agg(F.count("*").alias("_points")).join(weights, CELL)
            .select(*CELL, splits.alias("_splits")).where("_splits > 1"),
            "hot-cells",
        )
        number = hot.count()
        stored = self.spark.table(self.table)
        if not number:
            return self._pairs(placed.withColumn("_salt", F.lit(0)), stored, CELL, radius_m)
        hot = F.broadcast(hot) if number <= BROADCAST_KEYS else hot
        cool = placed.join(hot, CELL, "left_anti").withColumn("_salt", F.lit(0))
        salt = F.pmod(F.xxhash64(point_id), F.col("_splits")).cast("int")
        spread = placed.join(hot, CELL).withColumn("_salt", salt).drop("_splits")
        every = F.explode(F.sequence(F.lit(0), F.col("_splits") - 1))
        copies = stored.join(hot, CELL).withColumn("_salt", every).drop("_splits")
        return self._pairs(cool, stored, CELL, radius_m).unionByName(
            self._pairs(spread, copies, [*CELL, "_salt"], radius_m)
        )

    def _pairs(self, points: DataFrame, targets: DataFrame, keys: list[str], radius_m: float) -> DataFrame:
        if keys == CELL:
            points = points.repartition(self.buckets, *CELL)
        distance = haversine(
            F.col("lat"), F.col("lon"), F.col("_cos"),
            F.col("target_lat"), F.col("target_lon"), F.col("_target_cos"),
        )
        close = F.abs(F.col("lat") - F.col("target_lat")) <= F.degrees(F.lit(radius_m / EARTH_RADIUS_M)) * SLACK
        met = points.join(targets, keys).where(close).withColumn("distance_m", distance)
        return met.where(F.col("distance_m") <= radius_m).drop("_cos", "_target_cos")
