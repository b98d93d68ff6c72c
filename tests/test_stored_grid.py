"""Radius joins against stored targets."""

import random

import pytest

from stoopwise.operators.radius import radius_join
from stoopwise.operators.stored_grid import StoredGrid
from stoopwise.session import new_path


def places(spark, n, name, seed):
    rng = random.Random(seed)
    # A third in one spot; the others around the date line, near a pole and nowhere.
    rows = [(i, 41.8, -87.6) for i in range(n // 3)]
    rows += [(i, rng.uniform(41.7, 41.9), rng.choice([-1, 1]) * rng.uniform(179.95, 180)) for i in range(n // 3, 2 * n // 3)]
    rows += [(i, rng.uniform(89.9, 90), rng.uniform(-180, 180)) for i in range(2 * n // 3, n)] + [(n, None, 1.0), (n + 1, 99.0, 1.0)]
    return spark.createDataFrame(rows, f"{name} int, lat double, lon double")


def pairs(df):
    return sorted((r["p"], r["t"], round(r["distance_m"], 6)) for r in df.collect())


@pytest.mark.parametrize("pairs_per_task", [200_000_000, 300])
def test_equal_to_the_radius_join(spark, pairs_per_task):
    points, targets = places(spark, 150, "p", 1), places(spark, 120, "t", 2)
    path = new_path(spark, "grid")
    StoredGrid.write(targets, path, 3000.0, 3)
    grid = StoredGrid.open(spark, path, 3000.0, 3)
    for radius in (0.0, 800.0, 3000.0):
        found = pairs(grid.near(points, radius, "p", pairs_per_task))
        assert found == pairs(radius_join(points, targets, radius, "p", "t")) and found
    assert grid.near(points, -1.0, "p").isEmpty() and grid.near(points.limit(0), 5.0, "p").isEmpty()
    with pytest.raises(ValueError):
        grid.near(points, 3001.0, "p")


def test_targets_are_not_shuffled(spark):
    points, targets = places(spark, 150, "p", 1), places(spark, 120, "t", 2)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        grid = StoredGrid.write(targets, new_path(spark, "grid"), 800.0, 3)
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (grid.near(points, 800.0, "p"), radius_join(points, targets, 800.0, "p", "t"))]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert [plan.count("Exchange hashpartitioning") for plan in plans] == [1, 2]
