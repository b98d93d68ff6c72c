"""Joins and counts that survive one key holding a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoopwise.params import ROWS_PER_TASK
from stoopwise.session import dropped, written

# The list of hot keys is broadcast up to this counted length; a longer one is joined.
BROADCAST_KEYS = 1_000_000

SALT = "_salt"


def hot_keys(
    df: DataFrame, keys: Sequence[str], rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Keys with more than ``rows_per_task`` rows and the number of salts each needs.

    There are at most rows / rows_per_task of them, and they are not capped.
    """
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("_rows"))
        .where(F.col("_rows") > rows_per_task)
        .select(*keys, F.ceil(F.col("_rows") / rows_per_task).cast("int").alias("_salts"))
    )


def salted(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    salt_by: Sequence[str],
    rows_per_task: int = ROWS_PER_TASK,
) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join, with a ``_salt`` column where ``big`` has hot keys.

    Without any the sides come back as they are. A row of ``big`` gets one salt, taken from its ``salt_by`` columns so that a
    re-run task computes the same one; the rows of ``small`` are copied to every
    salt of their key. Keys that are not hot keep a single salt and are not copied.

    The keys of ``big`` are counted first, so ``big`` should be cheap to read, such as
    a table; after an expensive step leave skew to the adaptive join instead.
    """
    hot = written(hot_keys(big, keys, rows_per_task), "hot-keys")
    number = hot.count()
    if not number:
        dropped(hot)
        return big, small
    hot = F.broadcast(hot) if number <= BROADCAST_KEYS else hot
    salt = F.coalesce(F.pmod(F.xxhash64(*salt_by), F.col("_salts")).cast("int"), F.lit(0))
    copies = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
    # A null key joins nothing, but in a left join its rows need spreading all the same.
    left = _with_salts(big, hot, keys).withColumn(SALT, salt)
    right = _with_salts(small, hot, keys).withColumn(SALT, F.explode(copies))
    return left.drop("_salts"), right.drop("_salts")


def _with_salts(df: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    same = F.lit(True)
    for key in keys:
        same &= F.col(f"d.{key}").eqNullSafe(F.col(f"h.{key}"))
    joined = df.alias("d").join(hot.alias("h"), same, "left")
    return joined.select("d.*", "h._salts")


def salted_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    salt_by: Sequence[str],
    how: str = "inner",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Join ``big`` to ``small``, spreading the hot keys of ``big``.

    Any join that asks each row of ``big`` for its partners will do: inner, left,
    left_semi or left_anti.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a {how} join cannot be salted on its left side")
    left, right = salted(big, small, keys, salt_by, rows_per_task)
    salt = [SALT] if SALT in left.columns else []
    return left.join(right, [*keys, *salt], how).drop(*salt)
