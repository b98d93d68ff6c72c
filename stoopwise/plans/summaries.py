"""Inspection summaries: from response texts and from address-keyed files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoopwise.functions import text
from stoopwise.operators import merge
from stoopwise.operators.numbering import first_per_key

ISSUES = "array<struct<date: string, issues: array<struct<emoji: string, description: string>>>>"
SUMMARY = f"struct<summary: string, summarized_issues: {ISSUES}>"


def stored(summaries: DataFrame) -> DataFrame:
    """The rows that hold a summary; a row without one only says that none is stored yet."""
    return summaries.where("summary IS NOT NULL")


def parse_summaries(responses: DataFrame) -> DataFrame:
    """Add ``summary`` to responses (address, response) and ``error`` where it is no JSON.

    A broken response gets an empty summary.
    """
    body = text.unfence_json(F.col("response"))
    parsed = F.from_json(body, f"{SUMMARY.removesuffix('>')}, _broken: string>",
                         {"columnNameOfCorruptRecord": "_broken"})
    bad = parsed.isNull() | parsed["_broken"].isNotNull() | ~body.startswith("{")
    empty = F.struct(
        F.lit(None).cast("string").alias("summary"),
        F.lit(None).cast(ISSUES).alias("summarized_issues"),
    )
    good = F.struct(
        parsed["summary"].alias("summary"), parsed["summarized_issues"].alias("summarized_issues")
    )
    is_bad = F.coalesce(bad, F.lit(True))
    return responses.select(
        "address",
        "response",
        F.when(is_bad, empty).otherwise(good).alias("summary"),
        F.when(is_bad, "response is no JSON object").alias("error"),
    )


def summary_ingest(
    responses: DataFrame, existing: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Upsert the parsed responses by address; returns the new table and the dead letters.

    ``existing`` has address and summary. Of several responses for an address the one
    with the highest ``response_id`` counts.
    """
    parsed = parse_summaries(
        first_per_key(responses, ["address"], [F.desc("response_id")])
    )
    good = parsed.where("error IS NULL").select("address", "summary")
    dead = parsed.where("error IS NOT NULL").select("address", "error")
    return merge.upsert_latest(existing.select("address", "summary"), good, ["address"]), dead


def from_address_map(objects: DataFrame, column: str = "value") -> DataFrame:
    """Text rows that hold ``{address: summary}`` objects to one row per address."""
    parsed = F.from_json(column, f"map<string, {SUMMARY}>")
    return objects.select(F.explode(parsed).alias("address", "summary"))
