"""Radius join: all targets within a distance of each point."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from stoopwise.functions.geo import EARTH_RADIUS_M, haversine, is_place
from stoopwise.operators.skew import BROADCAST_KEYS
from stoopwise.session import dropped, written

# Cells never get smaller than this, so a radius of zero still has cells.
SMALLEST_CELL_DEG = 0.0005
# Room for rounding in the trigonometry; cells only preselect, the distance decides.
SLACK = 1.0001

# Work of one task, in compared pairs and in targets held for one cell.
PAIRS_PER_TASK = 200_000_000
TARGETS_PER_TASK = 1_000_000

# The columns the pairs are partitioned by, the first only where radii differ. All pairs of
# a point share their values, so an aggregate or window per point that also names these
# needs no further shuffle, unless targets had to be divided.
CELL = ["_reach", "_band", "_column", "_salt"]


def cell_columns(df: DataFrame) -> list[str]:
    """The cell columns a table of pairs carries."""
    return [c for c in CELL if c in df.columns]


class _Bounds(NamedTuple):
    """What a grid needs to know about its radius, in degrees where not said otherwise."""

    reach: float
    sine: float
    height: float
    last_band: int

    @classmethod
    def of(cls, radius_m: float) -> _Bounds:
        angle = min(radius_m / EARTH_RADIUS_M, math.pi / 2)
        reach = math.degrees(angle) * SLACK
        height = max(reach, SMALLEST_CELL_DEG)
        return cls(reach, math.sin(angle) * SLACK, height, math.ceil(180 / height) - 1)


def _column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


class _Grid:
    """Latitude bands cut into columns, each at least one radius wide.

    The number of columns shrinks with the band's latitude, so no cell is narrower
    than the reach of a circle, and columns are counted modulo that number, so the
    date line needs no special case. Around the poles a band is a single column.
    """

    def __init__(self, reach, sine, height, last_band):
        """Plain numbers for one radius, columns for a radius per row."""
        self.reach = reach
        self.sine = sine
        self.height = height
        self.last_band = last_band

    def band(self, lat: Column) -> Column:
        raw = F.floor((lat + 90) / self.height)
        return F.least(F.greatest(raw, F.lit(0)), _column(self.last_band)).cast("int")

    def _width(self, top: Column) -> Column:
        """Degrees of longitude a circle can reach to each side, at most at ``top``.

        Where the circle touches the pole the sine is at least the cosine: all around.
        """
        ratio = _column(self.sine) / F.cos(F.radians(top))
        bent = F.degrees(F.asin(ratio)) * SLACK
        return F.when(
            ratio < 1, F.greatest(bent, F.lit(SMALLEST_CELL_DEG))
        ).otherwise(F.lit(360.0))

    def columns(self, band: Column) -> Column:
        low, high = band * self.height - 90, (band + 1) * self.height - 90
        top = F.least(F.greatest(F.abs(low), F.abs(high)), F.lit(90.0))
        return F.greatest(F.floor(F.lit(360.0) / self._width(top)), F.lit(1))

    def column(self, lon: Column, columns: Column) -> Column:
        return F.floor((lon + 180) / 360 * columns)

    def reached_bands(self, lat: Column) -> Column:
        return F.sequence(self.band(lat - self.reach), self.band(lat + self.reach))

    def reached_columns(self, lat: Column, lon: Column, columns: Column) -> tuple[Column, Column]:
        """First and last column reached, not yet taken modulo the number of columns."""
        width = self._width(F.abs(lat))
        return self.column(lon - width, columns), self.column(lon + width, columns)


def _crowded_cells(
    left: DataFrame, right: DataFrame, cell: list[str], pairs_per_task: int, targets_per_task: int
) -> tuple[DataFrame, float]:
    """Cells too large for one task with the splits they need, and the pairs of all cells.

    ``_splits`` divides the points of a cell, ``_sides`` its targets. The cells come as a
    written table: there are at most pairs / pairs_per_task and targets /
    targets_per_task of them.
    """
    work = (
        left.groupBy(*cell)
        .agg(F.count("*").alias("_points"))
        .join(right.groupBy(*cell).agg(F.count("*").alias("_targets")), cell)
        .withColumn("_pairs", F.col("_points").cast("double") * F.col("_targets"))
    )
    held = F.least(F.col("_targets"), F.lit(targets_per_task))
    splits = F.least(F.ceil(F.col("_points").cast("double") * held / pairs_per_task), F.col("_points"))
    sides = F.ceil(F.col("_targets") / targets_per_task)
    seen = Observation()
    crowded = written(
        work.observe(seen, F.sum("_pairs").alias("pairs"))
        .withColumns({"_splits": splits.cast("int"), "_sides": sides.cast("int")})
        .where("_splits > 1 OR _sides > 1")
        .select(*cell, "_splits", "_sides"),
        "crowded-cells",
    )
    return crowded, seen.get["pairs"] or 0.0


def radius_join(
    points: DataFrame,
    targets: DataFrame,
    radius_m: float | str,
    point_id: str,
    target_id: str,
    pairs_per_task: int = PAIRS_PER_TASK,
    targets_per_task: int = TARGETS_PER_TASK,
) -> DataFrame:
    """Pairs of a point and a target within a radius, with ``distance_m``.

    Both sides need ``lat`` and ``lon``; the target's come out as ``target_lat`` and
    ``target_lon``. The remaining column names must differ. ``radius_m`` is a number,
    or the name of a column of ``points``; the border belongs to the circle.

    The distance test runs only inside equal grid cells: every point has one cell,
    every target is copied to the few cells its circle touches, so each pair meets
    exactly once and the plan is an equi-join. With a column of radii each point uses
    the grid of the next power of two, so one far-reaching point does not widen the
    cells of all others; targets enter each grid in use, of which there are at most 26
    around the globe.

    Cells are weighed first by the pairs they will compare. A crowded one is divided
    by its points, which see copies of its targets, and when it has too many targets
    for one task, by those as well. A partition of cells turns into far more pairs than
    its size tells, so the number of partitions follows the pairs, is at least the
    session's, and is not merged by size. The result carries the ``CELL`` columns.
    """
    placed = points.where(is_place(F.col("lat"), F.col("lon")))
    reached = targets.where(is_place(F.col("lat"), F.col("lon")))
    if isinstance(radius_m, str):
        radius = F.col(radius_m).cast("double")
        power = F.ceil(F.log2(F.least(F.greatest(radius, F.lit(1.0)), F.lit(2.0**25))))
        placed = placed.where(radius >= 0).withColumn("_reach", power.cast("int"))
        # At most 26 small numbers.
        powers = [row["_reach"] for row in placed.select("_reach").distinct().collect()]
        bounds = {
            p: F.struct(*[F.lit(v).alias(n) for n, v in _Bounds.of(2.0**p)._asdict().items()])
            for p in powers or [0]
        }
        lookup = F.create_map(*[x for p, b in bounds.items() for x in (F.lit(p), b)])
        placed = placed.withColumn("_grid", F.element_at(lookup, F.col("_reach")))
        reached = reached.select("*", F.explode(lookup).alias("_reach", "_grid"))
        grid = _Grid(*[F.col(f"_grid.{name}") for name in _Bounds._fields])
    else:
        radius = F.lit(float(radius_m))
        placed = placed.where(radius >= 0)
        grid = _Grid(*_Bounds.of(max(float(radius_m), 0.0)))

    def with_columns_of_band(df: DataFrame) -> DataFrame:
        return df.withColumn("_columns", grid.columns(F.col("_band")))

    left = (
        with_columns_of_band(
            placed.withColumns(
                {"_band": grid.band(F.col("lat")), "_cos": F.cos(F.radians("lat"))}
            )
        )
        .withColumn("_column", F.pmod(grid.column(F.col("lon"), F.col("_columns")), "_columns"))
        .drop("_grid", "_columns")
    )
    right = with_columns_of_band(
        reached.withColumnsRenamed({"lat": "target_lat", "lon": "target_lon"})
        .withColumn("_target_cos", F.cos(F.radians("target_lat")))
        .withColumn("_band", F.explode(grid.reached_bands(F.col("target_lat"))))
    )
    first, last = grid.reached_columns(
        F.col("target_lat"), F.col("target_lon"), F.col("_columns")
    )
    # A circle that reaches all around takes every column once.
    right = (
        right.withColumns({"_first": first, "_last": last})
        .withColumn("_last", F.least("_last", F.col("_first") + F.col("_columns") - 1))
        .withColumn("_column", F.explode(F.sequence("_first", "_last")))
        .withColumn("_column", F.pmod("_column", "_columns"))
        .drop("_grid", "_columns", "_first", "_last")
    )
    cell = cell_columns(left)
    crowded, compared = _crowded_cells(left, right, cell, pairs_per_task, targets_per_task)
    keys = list(cell)
    number = crowded.count()
    if number:
        hot = F.broadcast(crowded) if number <= BROADCAST_KEYS else crowded
        keys += ["_salt", "_side"]

        def pick(name: str, count: str) -> Column:
            return F.coalesce(F.pmod(F.xxhash64(name), F.col(count)).cast("int"), F.lit(0))

        def every(count: str) -> Column:
            return F.explode(F.sequence(F.lit(0), F.coalesce(F.col(count), F.lit(1)) - 1))

        left = (
            left.join(hot, cell, "left")
            .withColumn("_salt", pick(point_id, "_splits"))
            .withColumn("_side", every("_sides"))
            .drop("_splits", "_sides")
        )
        right = (
            right.join(hot, cell, "left")
            .withColumn("_salt", every("_splits"))
            .withColumn("_side", pick(target_id, "_sides"))
            .drop("_splits", "_sides")
        )
    else:
        dropped(crowded)
        left = left.withColumn("_salt", F.lit(0))
    session = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(session, math.ceil(compared / pairs_per_task))
    left, right = (side.repartition(partitions, *keys) for side in (left, right))
    distance = haversine(
        F.col("lat"), F.col("lon"), F.col("_cos"),
        F.col("target_lat"), F.col("target_lon"), F.col("_target_cos"),
    )
    # Comparing latitudes is cheap and spares a third of the distances.
    near = F.abs(F.col("lat") - F.col("target_lat")) <= F.degrees(radius / EARTH_RADIUS_M) * SLACK
    pairs = (
        left.join(right, keys)
        .where(near)
        .withColumn("distance_m", distance)
        .where(F.col("distance_m") <= radius)
        .drop("_cos", "_target_cos", "_side")
    )
    place = cell_columns(pairs)
    return pairs.select(*place, *[c for c in pairs.columns if c not in place])
