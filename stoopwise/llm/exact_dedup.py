"""Exact duplicates by progressive refinement: length, prefix hash, full hash.

Native: DataFrame functions only. One scan gives every row its length and the hash of
its first characters, as two numbers. Rows are grouped by length; only lengths that
several rows share are grouped by prefix hash; only rows of shared prefixes are hashed
in full, in a second scan that no text leaves through a shuffle.

Texts are equal when they are identical after each run of white space has become one
space; a null text counts as empty. Of equal texts the row with the smallest id stays; a
null id comes after all others, and among rows that repeat an id one stays. Equality of
texts is equality of length and SHA-256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stoopwise.llm.common import BROADCAST_ROWS, WHITE, text_of
from stoopwise.session import dropped, written

PREFIX = 256


def normal(text: str | Column) -> Column:
    return F.regexp_replace(text_of(text), WHITE, " ")


def _shaped(docs: DataFrame, text: str, prefix: int, *more: Column) -> DataFrame:
    body = docs.select(*more, normal(text).alias("_body"))
    head = F.xxhash64(F.substring("_body", 1, prefix))
    return body.select("*", F.length("_body").alias("_length"), head.alias("_head"))


def shared_heads(docs: DataFrame, text: str = "text", prefix: int = PREFIX) -> DataFrame:
    """Length and prefix hash of every group that may hold equal texts, as a written table."""
    shapes = written(_shaped(docs, text, prefix).select("_length", "_head"), "shapes")
    lengths = shapes.groupBy("_length").count().where("count > 1").select("_length")
    heads = (
        shapes.join(lengths, "_length", "left_semi")
        .groupBy("_length", "_head")
        .count()
        .where("count > 1")
        .select("_length", "_head")
    )
    heads = written(heads, "heads")
    dropped(shapes)
    return heads


def exact_groups(
    docs: DataFrame,
    id: str = "doc_id",  # noqa: A002
    text: str = "text",
    prefix: int = PREFIX,
    digest_all: bool = False,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    ``text_sha256`` is there for rows whose length and prefix others share, and for all
    rows with ``digest_all``; grouping hashes never looks at the others.

    Shared prefixes are broadcast while their counted number stays within
    ``broadcast_rows``. Beyond that every row is hashed where it is read, and the narrow
    rows are shuffled: the same result by another way.
    """
    heads = shared_heads(docs, text, prefix)
    few = heads.count() <= broadcast_rows
    rows = _shaped(docs, text, prefix, F.col(id).alias("_id"))
    digest = F.sha2(F.col("_body"), 256)
    if not few:
        rows = rows.withColumn("_digest", digest).drop("_body")
        digest = F.col("_digest")
    marked = heads.withColumn("_shared", F.lit(True))
    rows = rows.join(F.broadcast(marked) if few else marked, ["_length", "_head"], "left")
    full = digest if digest_all else F.when(F.col("_shared"), digest)
    # The table fixes a number for every row, which tells rows with one id apart.
    hashed = written(
        rows.select(
            "_id",
            "_length",
            F.monotonically_increasing_id().alias("_row"),
            full.alias("_sha"),
            F.coalesce("_shared", F.lit(False)).alias("_shared"),
        ),
        "hashed",
    )
    dropped(heads)
    first = F.min(F.struct(F.col("_id").isNull().alias("no_id"), "_id", "_row"))
    groups = written(
        hashed.where("_shared")
        .groupBy("_length", "_sha")
        .agg(F.count("*").alias("_size"), first.alias("_first"))
        .where("_size > 1"),
        "groups",
    )
    # The rows of a large group meet its single group row; the adaptive join splits them.
    found = hashed.where("_shared").join(groups, ["_length", "_sha"], "left")
    return found.select(
        F.col("_id").alias(id),
        F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_first._id")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("_first._row") == F.col("_row"), F.lit(True)).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    ).unionByName(
        hashed.where("not _shared").select(
            F.col("_id").alias(id),
            F.col("_id").alias("keep_id"),
            F.lit(1).cast("long").alias("group_size"),
            F.lit(True).alias("kept"),
            F.col("_sha").alias("text_sha256"),
        )
    )


def without_copies(
    docs: DataFrame,
    id: str = "doc_id",  # noqa: A002
    text: str = "text",
    prefix: int = PREFIX,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows whose prefix nobody shares pass where they are read; the others are limited to
    the first of each text in the map tasks before the shuffle.
    """
    heads = shared_heads(docs, text, prefix)
    marked = heads.withColumn("_shared", F.lit(True))
    marked = F.broadcast(marked) if heads.count() <= broadcast_rows else marked
    columns = [F.col(f"`{c}`") for c in docs.columns]
    whole = F.struct(*columns).alias("_doc")
    rows = _shaped(docs, text, prefix, whole).join(marked, ["_length", "_head"], "left")
    alone = rows.where("_shared is null").select("_doc.*")
    order = [F.col(f"_doc.`{id}`").asc_nulls_last(), F.xxhash64(F.col("_doc").cast("string"))]
    window = Window.partitionBy("_length", "_sha").orderBy(*order)
    first = (
        rows.where("_shared")
        .select("_doc", "_length", F.sha2("_body", 256).alias("_sha"))
        .withColumn("_nth", F.row_number().over(window))
        .where("_nth = 1")
        .select("_doc.*")
    )
    return alone.unionByName(first)
