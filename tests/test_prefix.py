"""The prefix join by a sorted walk, against a comparison of everything with everything."""

import random

import pytest

from stoopwise.operators.prefix import prefix_join, prefix_merge


def values(spark, rows, name):
    return spark.createDataFrame([(r, 0) for r in rows], f"{name} string, value int")


def expected(heads, texts):
    heads, texts = ({x.upper() for x in xs if x} for xs in (heads, texts))
    return sorted((h, t) for h in heads for t in texts if t.startswith(h))


@pytest.mark.parametrize("rows_per_task", [1_000_000, 7])
def test_merge_equals_all_comparisons(spark, rows_per_task):
    rng = random.Random(11)

    def word(longest):
        return "".join(rng.choice("aB é\U0001f600") for _ in range(rng.randint(0, longest)))

    # "a" starts a third of all texts, and its range covers many tasks.
    heads = ["a", "A", None, "", *[word(5) for _ in range(60)]]
    texts = [None, "", "a", *["a" + word(6) for _ in range(60)], *[word(7) for _ in range(120)]]
    pairs = prefix_merge(values(spark, heads, "h"), values(spark, texts, "t"), "h", "t", rows_per_task)
    assert pairs.columns == ["h", "t"]
    got = sorted(tuple(r) for r in pairs.collect())
    assert got == expected(heads, texts)
    assert got == sorted(tuple(r) for r in prefix_join(values(spark, heads, "h"), values(spark, texts, "t"), "h", "t").collect())


def test_prefixes_inside_each_other_are_carried_over_borders(spark):
    heads = ["x", "xx", "xxx", "y"]
    texts = [f"xxx{i:03}" for i in range(40)] + ["x" * 5000]
    pairs = prefix_merge(values(spark, heads, "h"), values(spark, texts, "t"), "h", "t", rows_per_task=5)
    assert sorted(tuple(r) for r in pairs.collect()) == expected(heads, texts)


def test_empty_sides(spark):
    none, some = values(spark, [], "h"), values(spark, ["a"], "t")
    assert prefix_merge(none, some, "h", "t").collect() == []
    assert prefix_merge(values(spark, ["a"], "h"), some.limit(0), "h", "t").collect() == []
    assert prefix_merge(none, some.limit(0), "h", "t").collect() == []
