import math
import random

import pytest
from pyspark.sql import functions as F

from stoopwise.operators.radius import radius_join

R = 6_371_008.8


def metres(a, b):
    (lat1, lon1), (lat2, lon2) = ([math.radians(x) for x in p] for p in (a, b))
    h = math.sin((lat2 - lat1) / 2) ** 2
    h += math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
    return 2 * R * math.asin(min(1, math.sqrt(h)))


def around(rng, lat, lon, radius, n):
    """Places within about three radii of a centre."""
    reach = math.degrees(3 * radius / R)
    out = []
    for _ in range(n):
        y = min(90, max(-90, lat + rng.uniform(-reach, reach)))
        x = lon + rng.uniform(-reach, reach) / max(math.cos(math.radians(y)), 0.01)
        out.append((float(y), float((x + 540) % 360 - 180)))
    return out


def frames(spark, points, targets):
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(points)], "p int, lat double, lon double")
    t = spark.createDataFrame([(i, *x) for i, x in enumerate(targets)], "t int, lat double, lon double")
    return p, t


def pairs(df):
    return sorted((r["p"], r["t"]) for r in df.select("p", "t").collect())


@pytest.mark.parametrize("lat, lon", [(0, 0), (41.8, -87.6), (80, 20), (89.99, 10), (-90, 0), (10, 180), (-60, -180)])
@pytest.mark.parametrize("radius", [140, 5000, 300_000])
def test_same_as_comparing_everything(spark, lat, lon, radius):
    rng = random.Random(f"{lat} {lon} {radius}")
    points, targets = (around(rng, lat, lon, radius, 60) for _ in range(2))
    p, t = frames(spark, points, targets)
    expected = sorted(
        (i, j)
        for i, a in enumerate(points)
        for j, b in enumerate(targets)
        if metres(a, b) <= radius
    )
    assert pairs(radius_join(p, t, radius, point_id="p", target_id="t")) == expected
    # The same rows when crowded cells are divided by their points, and by their targets.
    split = radius_join(p, t, radius, point_id="p", target_id="t", pairs_per_task=40, targets_per_task=4)
    assert pairs(split) == expected
    assert pairs(radius_join(p, t, radius, point_id="p", target_id="t", pairs_per_task=40)) == expected


def test_radius_per_point(spark):
    rng = random.Random(5)
    points, targets = (around(rng, 41.8, -87.6, 900, 80) for _ in range(2))
    radii = [rng.choice([0, 70, 350, 700, 1050, 25_000_000]) for _ in points]
    p, t = frames(spark, points, targets)
    p = p.withColumn("r", F.get(F.array(*[F.lit(float(r)) for r in radii]), F.col("p")))
    expected = sorted(
        (i, j)
        for i, a in enumerate(points)
        for j, b in enumerate(targets)
        if metres(a, b) <= radii[i]
    )
    assert pairs(radius_join(p, t, "r", point_id="p", target_id="t")) == expected


def test_zero_and_negative_radius_and_bad_places(spark):
    p, t = frames(spark, [(1.0, 2.0), (99.9999, 99.9999), (float("nan"), 2.0)], [(1.0, 2.0), (1.001, 2.0), (99.9999, 99.9999)])
    assert pairs(radius_join(p, t, 0, point_id="p", target_id="t")) == [(0, 0)]
    assert pairs(radius_join(p, t, -1, point_id="p", target_id="t")) == []


def test_whole_globe(spark):
    rng = random.Random(9)
    points = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(30)]
    p, t = frames(spark, points, points)
    assert len(pairs(radius_join(p, t, 21_000_000, point_id="p", target_id="t"))) == 900


def test_the_same_columns_however_cells_are_divided(spark):
    p, t = frames(spark, [(1.0, 2.0)] * 20, [(1.0, 2.0)] * 20)
    by_points = radius_join(p, t, 500, point_id="p", target_id="t", pairs_per_task=100)
    assert {"_band", "_column", "_salt"} <= set(by_points.columns)
    places = by_points.groupBy("p").agg(F.count_distinct("_salt").alias("n")).collect()
    assert {r["n"] for r in places} == {1}
    assert by_points.select("_salt").distinct().count() > 1 and by_points.count() == 400
    by_both = radius_join(p, t, 500, point_id="p", target_id="t", pairs_per_task=100, targets_per_task=5)
    plain = radius_join(p, t, 500, point_id="p", target_id="t")
    assert by_both.columns == by_points.columns == plain.columns
    for divided in (plain, by_points, by_both):
        counts = divided.groupBy("_band", "_column", "_salt", "p").count().collect()
        assert sorted(r["count"] for r in counts) == [20] * 20


def test_more_crowded_cells_than_any_cap(spark):
    places = [(float(lat), float(lon)) for lat in range(-39, 39, 3) for lon in range(-120, 120, 6)]
    p, t = frames(spark, places * 2, places * 2)
    near = radius_join(p, t, 500, point_id="p", target_id="t", pairs_per_task=3)
    assert near.count() == 4 * len(places) and len(places) > 1024


def test_plan_is_an_equi_join(spark):
    p, t = frames(spark, [(1.0, 2.0)], [(1.0, 2.0)])
    plan = radius_join(p, t, 500, point_id="p", target_id="t")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
