"""Prefix join: every text that starts with each prefix."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoopwise.params import ROWS_PER_TASK
from stoopwise.session import written

# Pairs of one record batch.
PAIRS_AT_ONCE = 10_000


def prefix_join(prefixes: DataFrame, texts: DataFrame, prefix: str, text: str) -> DataFrame:
    """Pairs ``(prefix, text)`` where the text starts with the prefix, case ignored.

    Both sides are reduced to their distinct upper-case values first; join the rows
    back on them. Each text is cut at every length some prefix has, and the cut is
    matched by equality, so only true matches meet and nothing is compared twice.
    """
    heads = prefixes.select(F.upper(prefix).alias(prefix)).where(F.col(prefix) != "").distinct()
    lengths = heads.select(F.length(prefix).alias("_length")).distinct()
    cuts = (
        texts.select(F.upper(text).alias(text))
        .where(F.col(text) != "")
        .distinct()
        .withColumn("_length", F.explode(F.sequence(F.lit(1), F.length(text))))
        .join(lengths, "_length", "left_semi")
        .select(text, F.substring(F.col(text), F.lit(1), F.col("_length")).alias(prefix))
    )
    return heads.join(cuts, prefix).select(prefix, text)


def prefix_merge(
    prefixes: DataFrame, texts: DataFrame, prefix: str, text: str, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """The pairs of ``prefix_join``, by one walk over both sides in their order.

    Sorted by their bytes, all texts that start with a prefix follow it without a gap, so a
    walk needs the prefixes that are open, each the start of the next, and nothing else.
    Values are shuffled as they are, never cut at every length: this is the form for long
    texts and prefixes of many lengths.

    Both sides are reduced to their distinct upper-case values and split into ranges of
    ``rows_per_task``. A prefix that reaches into a later range starts that range's first
    value too: so the first values, one per range, are looked up among the prefixes, and
    those found are carried into their ranges, at most as many as the value is long. Nulls
    and empty texts match nothing.
    """

    def values(df: DataFrame, name: str, is_head: bool) -> DataFrame:
        value = F.upper(name).alias("value")
        return df.select(value, F.lit(is_head).alias("head"), F.lit(not is_head).alias("text")).where("value <> ''")

    both = values(prefixes, prefix, True).unionByName(values(texts, text, False))
    rows = written(both.groupBy("value").agg(F.max("head").alias("head"), F.max("text").alias("text")), "prefix-values")
    parts = max(1, -(-rows.count() // rows_per_task))
    # The ranges come from a sample; written, they are the same for both uses below.
    split = written(
        rows.repartitionByRange(parts, "value").withColumn("part", F.spark_partition_id()), "prefix-ranges"
    )
    cuts = (
        split.groupBy("part")
        .agg(F.min("value").alias("first"))
        .where("part > 0 AND length(first) > 1")
        .select("part", F.explode(F.transform(F.sequence(F.lit(1), F.length("first") - 1), lambda n: F.left("first", n))).alias("value"))
    )
    carried = cuts.join(split.where("head").select("value"), "value").select(
        "value", F.lit(True).alias("head"), F.lit(False).alias("text"), "part"
    )
    ranges = split.unionByName(carried).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "value")
    return ranges.select("value", "head", "text").mapInArrow(_walk, "prefix string, text string").toDF(prefix, text)


def _walk(batches: Iterator) -> Iterator:
    """Sorted (value, head, text) in, pairs of an open prefix and a text out."""
    import pyarrow as pa

    opened, heads, texts = [], [], []

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(heads, pa.string()), pa.array(texts, pa.string())], ["prefix", "text"])
        heads.clear()
        texts.clear()
        return made

    for rows in batches:
        for value, is_head, is_text in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            while opened and not value.startswith(opened[-1]):
                opened.pop()
            if is_head and (not opened or opened[-1] != value):
                opened.append(value)
            if is_text:
                heads.extend(opened)
                texts.extend([value] * len(opened))
                if len(heads) >= PAIRS_AT_ONCE:
                    yield batch()
    yield batch()
