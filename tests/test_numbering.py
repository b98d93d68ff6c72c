import random

import pytest
from pyspark.sql import functions as F

from stoopwise.operators.numbering import first_per_key, number_within, total_order
from stoopwise.operators.prefix import prefix_join
from stoopwise.operators.skew import hot_keys, salted_join


@pytest.fixture(scope="module")
def lopsided(spark):
    """A third of the rows in one group, and one group without a key."""
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "a", "b", "c", None, "hot"]), i, rng.randint(0, 9)) for i in range(400)]
    return spark.createDataFrame(rows, "k string, id int, v int")


@pytest.mark.parametrize("keys", [["k"], []])
def test_split_numbers_equal_the_plain_ones(lopsided, keys):
    order = [F.desc("v"), F.col("id")]
    plain = number_within(lopsided, keys, order)
    split = number_within(lopsided, keys, order, rows_per_task=20)
    assert sorted(plain.collect(), key=str) == sorted(split.collect(), key=str)


def test_first_per_key_is_limited_before_the_shuffle(lopsided):
    first = first_per_key(lopsided, ["k"], total_order(lopsided, ["v"]))
    assert first.count() == lopsided.select("k").distinct().count()
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_salted_join_equals_the_join(spark, lopsided):
    small = spark.createDataFrame([("hot", 1), ("a", 2), ("a", 3), ("z", 4)], "k string, w int")
    assert {r["k"] for r in hot_keys(lopsided, ["k"], 50).collect()} >= {"hot"}
    for how in ("inner", "left"):
        expected = lopsided.join(small, "k", how).select("k", "id", "v", "w")
        got = salted_join(lopsided, small, ["k"], ["id"], how, rows_per_task=10).select(
            "k", "id", "v", "w"
        )
        assert sorted(got.collect(), key=str) == sorted(expected.collect(), key=str)
    for how in ("left_semi", "left_anti"):
        expected = lopsided.join(small, "k", how).collect()
        got = salted_join(lopsided, small, ["k"], ["id"], how, rows_per_task=10)
        assert sorted(got.select(lopsided.columns).collect(), key=str) == sorted(expected, key=str)


def test_salts_spread_the_hot_key(spark, lopsided):
    from stoopwise.operators.skew import SALT, salted

    small = spark.createDataFrame([("hot", 1)], "k string, w int")
    left, right = salted(lopsided, small, ["k"], ["id"], rows_per_task=20)
    hot = left.where("k = 'hot'").groupBy(SALT).count().collect()
    assert len(hot) > 3 and max(r["count"] for r in hot) < 60
    assert right.where("k = 'hot'").count() >= len(hot)


def test_more_hot_keys_than_any_cap(spark):
    big = spark.range(6000).selectExpr("id % 1500 AS k", "id")
    assert hot_keys(big, ["k"], 3).count() == 1500
    small = spark.range(1500).selectExpr("id AS k", "id * 2 AS w")
    got = salted_join(big, small, ["k"], ["id"], rows_per_task=3)
    assert got.count() == 6000 and got.where("w <> 2 * k").count() == 0


def test_prefix_join(spark):
    heads = spark.createDataFrame([("5 elm",), ("5 ELM ST",), ("7",), ("",), (None,), ("5%",)], "h string")
    texts = spark.createDataFrame(
        [("5 Elm St",), ("5 ELM ST APT 2",), ("55 ELM ST",), ("71 OAK",), (None,), ("",)], "t string"
    )
    got = sorted(tuple(r) for r in prefix_join(heads, texts, "h", "t").collect())
    assert got == [
        ("5 ELM", "5 ELM ST"),
        ("5 ELM", "5 ELM ST APT 2"),
        ("5 ELM ST", "5 ELM ST"),
        ("5 ELM ST", "5 ELM ST APT 2"),
        ("7", "71 OAK"),
    ]
    plan = prefix_join(heads, texts, "h", "t")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
