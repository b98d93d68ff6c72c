"""Deduplicating inserts, upserts and full synchronisation of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stoopwise.operators.numbering import first_per_key, number_within, total_order
from stoopwise.params import ROWS_PER_TASK


def insert_ignore(rows: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key: the first by ``order``, ties by all other columns."""
    return first_per_key(rows, keys, total_order(rows, order))


def insert_new(
    rows: DataFrame, existing: DataFrame, keys: Sequence[str], order: Sequence[str] = ()
) -> DataFrame:
    """The existing table plus the rows with new keys; existing rows always win."""
    fresh = insert_ignore(rows, keys, order).join(existing.select(*keys), list(keys), "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def upsert_latest(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Create or replace by key; an incoming row replaces the existing one."""
    both = existing.withColumn("_incoming", F.lit(0)).unionByName(
        incoming.withColumn("_incoming", F.lit(1))
    )
    order = [F.desc("_incoming"), *total_order(existing)]
    return first_per_key(both, keys, order).drop("_incoming")


def sync(
    target: DataFrame,
    staging: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    delete: bool = True,
) -> DataFrame:
    """Compare a target with its new state, both unique by ``keys``.

    One full outer join gives every row of either side with its new values and an
    ``action``: insert, update, unchanged or delete. ``snapshot`` and ``changes`` cut
    it into the new table and the change log. Without ``delete`` missing rows stay.
    """
    old, new = target.alias("old"), staging.alias("new")
    match: Column | None = None
    for key in keys:
        same = F.col(f"old.{key}") == F.col(f"new.{key}")
        match = same if match is None else match & same
    # Marks tell an absent side from one whose columns are all null.
    joined = old.withColumn("_old", F.lit(True)).alias("old").join(
        new.withColumn("_new", F.lit(True)).alias("new"), match, "full_outer"
    )
    changed = F.lit(False)
    for value in values:
        changed = changed | ~F.col(f"old.{value}").eqNullSafe(F.col(f"new.{value}"))
    keyless = F.lit(False)
    for key in keys:
        keyless = keyless | F.col(f"old.{key}").isNull()
    stays = F.lit(not delete) | keyless
    action = (
        F.when(F.col("_old").isNull(), "insert")
        .when(F.col("_new").isNull(), F.when(stays, "unchanged").otherwise("delete"))
        .when(changed, "update")
        .otherwise("unchanged")
    )

    def current(name: str) -> Column:
        return (
            F.when(F.col("_new").isNull(), F.col(f"old.{name}"))
            .otherwise(F.col(f"new.{name}"))
            .alias(name)
        )

    return joined.select(*[current(c) for c in [*keys, *values]], action.alias("action"))


def snapshot(merged: DataFrame) -> DataFrame:
    return merged.where("action <> 'delete'").drop("action")


def changes(merged: DataFrame) -> DataFrame:
    return merged.where("action <> 'unchanged'")


def delete_missing(target: DataFrame, staging: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target rows whose keys occur in staging; a null in a key keeps the row."""
    keyless = F.lit(False)
    for key in keys:
        keyless = keyless | F.col(key).isNull()
    known = staging.select(*keys).distinct()
    kept = target.where(~keyless).join(known, list(keys), "left_semi")
    return kept.unionByName(target.where(keyless))


def get_or_create(
    wanted: DataFrame,
    existing: DataFrame,
    key: str,
    id_name: str,
    rows_per_task: int = ROWS_PER_TASK,
    there: Column | None = None,
) -> DataFrame:
    """Rows for the wanted keys that are not there yet, with ids after the highest one.

    ``wanted`` must be unique by ``key``; ids follow the order of the key. Rows of
    ``existing`` for which ``there`` does not hold only take up an id.
    """
    keys = existing.select(key) if there is None else existing.where(there).select(key)
    fresh = wanted.join(keys, key, "left_anti")
    highest = existing.agg(F.max(id_name)).first()[0] or 0
    numbered = number_within(fresh, [], [F.col(key)], name="_n", rows_per_task=rows_per_task)
    return numbered.withColumn(id_name, F.lit(highest) + F.col("_n")).drop("_n")


def write_once(old: Column, new: Column) -> Column:
    """What is stored stays, also an empty answer; only where nothing is stored the new one enters."""
    return F.when(old.isNotNull(), old).otherwise(new)


def shallow_merge(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join where a field of the right side replaces the left's field of its name."""
    shared = [c for c in right.columns if c not in on]
    joined = left.alias("l").join(right.alias("r"), list(on), "left")
    columns = [F.col(f"l.{c}") if c not in shared else
               F.coalesce(F.col(f"r.{c}"), F.col(f"l.{c}")).alias(c)
               for c in left.columns if c not in on]
    extra = [F.col(f"r.{c}") for c in shared if c not in left.columns]
    return joined.select(*on, *columns, *extra)
