"""Building-code violations: recasting, screening and status per property."""

from __future__ import annotations

import datetime
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stoopwise.functions import geo, text
from stoopwise.operators import filters
from stoopwise.operators.numbering import first_per_key, total_order
from stoopwise.operators.prefix import prefix_join
from stoopwise.operators.quality import step_counts
from stoopwise.operators.skew import salted_join
from stoopwise.plans.summaries import stored
from stoopwise.params import (
    CATEGORIES,
    ROWS_PER_TASK,
    START_DATE,
    SURVEYED_BOX,
    TRIVIAL_CODES,
    Box,
)

# The columns of the recast table and the raw columns they come from.
RECAST = {
    "address": "ADDRESS",
    "violation_id": "ID",
    "violation_date": "VIOLATION DATE",
    "department_bureau": "DEPARTMENT BUREAU",
    "inspection_id": "INSPECTION NUMBER",
    "inspection_category": "INSPECTION CATEGORY",
    "inspection_status": "INSPECTION STATUS",
    "inspector_id": "INSPECTOR ID",
    "violation_ordinance": "VIOLATION ORDINANCE",
    "violation_code": "VIOLATION CODE",
    "violation_description": "VIOLATION DESCRIPTION",
    "violation_location": "VIOLATION LOCATION",
    "violation_inspector_comments": "VIOLATION INSPECTOR COMMENTS",
    "violation_status": "VIOLATION STATUS",
    "violation_status_date": "VIOLATION STATUS DATE",
}


def recast(raw: DataFrame) -> DataFrame:
    """The fifteen wanted columns of the raw table, date parsed, in report order."""
    columns = [
        (text.parse_date(F.col(f"`{old}`")) if new == "violation_date" else F.col(f"`{old}`")).alias(
            new
        )
        for new, old in RECAST.items()
    ]
    return raw.select(*columns).orderBy(
        "address", F.desc("violation_date"), "inspection_category", "violation_id"
    )


def is_trivial(codes: Iterable[str] = TRIVIAL_CODES) -> Column:
    return filters.one_of(F.col("violation_code"), codes)


def screening_steps(
    box: Box = SURVEYED_BOX,
    start: datetime.date | str = START_DATE,
    categories: Iterable[str] = CATEGORIES,
) -> dict[str, Column]:
    """Conditions of the screening chain, in the order they are applied."""
    return {
        "all": F.lit(True),
        "in_box": geo.in_box(F.col("latitude"), F.col("longitude"), box),
        "recent": F.col("violation_date") >= F.lit(start).cast("date"),
        "category": F.col("inspection_category").isin(*[c.upper() for c in categories]),
    }


def screened(df: DataFrame, **settings) -> DataFrame:
    """Violations in the box, recent and of the wanted categories."""
    for condition in screening_steps(**settings).values():
        df = df.where(condition)
    return df


def screening_counts(df: DataFrame, **settings) -> DataFrame:
    """Rows and addresses left after each screening step."""
    return step_counts(df, screening_steps(**settings))


def addresses_to_summarise(
    df: DataFrame, codes: Iterable[str] = TRIVIAL_CODES
) -> DataFrame:
    """Addresses by number of violations, most first, without those with only trivial ones.

    The prefix rule applies: an address also counts as non-trivial when a longer
    address that starts with it has a non-trivial violation.
    """
    per_address = df.where("address IS NOT NULL").groupBy("address").agg(
        F.count("*").alias("n"), F.count_if(~is_trivial(codes)).alias("_serious")
    )
    serious = per_address.where("_serious > 0").select(F.col("address").alias("_text"))
    matched = prefix_join(per_address.select("address"), serious, "address", "_text")
    heads = matched.select(F.col("address").alias("_head")).distinct()
    return (
        per_address.join(heads, F.upper("address") == F.col("_head"), "left_semi")
        .select("address", "n")
        .orderBy(F.desc("n"), "address")
    )


def counts_per_head(
    heads: DataFrame, violations: DataFrame, codes: Iterable[str] = TRIVIAL_CODES
) -> DataFrame:
    """Violations and occasions (different dates) per address head, all and trivial.

    The violations shrink to one row per address and day before anything is joined,
    so an address with very many rows takes no more room than its number of days.
    """
    days = violations.groupBy(F.upper("address").alias("_text"), "violation_date").agg(
        F.count("*").alias("_n"), F.count_if(is_trivial(codes)).alias("_trivial")
    )
    pairs = prefix_join(heads, days, "head", "_text")
    per_day = (
        pairs.join(days, "_text")
        .groupBy("head", "violation_date")
        .agg(F.sum("_n").alias("_n"), F.sum("_trivial").alias("_trivial"))
    )
    return per_day.groupBy("head").agg(
        F.sum("_n").alias("total_violations_count"),
        F.count("violation_date").alias("total_inspections_count"),
        F.sum("_trivial").alias("_trivial_violations"),
        F.count_if((F.col("_trivial") > 0) & F.col("violation_date").isNotNull()).alias(
            "_trivial_occasions"
        ),
    )


def first_summary(heads: DataFrame, summaries: DataFrame) -> DataFrame:
    """The summary with the lowest id among those whose address starts with the head.

    Rows whose summary is null hold none.
    """
    if "summary" in summaries.columns:
        summaries = stored(summaries)
    lowest = summaries.groupBy(F.upper("address").alias("_text")).agg(F.min("id").alias("id"))
    chosen = (
        prefix_join(heads, lowest, "head", "_text")
        .join(lowest, "_text")
        .groupBy("head")
        .agg(F.min("id").alias("id"))
    )
    return chosen.join(summaries.drop("address"), "id").drop("id")


def _trivial_note(violations: Column, occasions: Column) -> Column:
    return F.concat(
        violations.cast("string"),
        F.lit(" trivial violations about inspector having no entry were reported on "),
        occasions.cast("string"),
        F.lit(" occasions and omitted here for brevity."),
    )


def violation_status(
    properties: DataFrame,
    violations: DataFrame,
    summaries: DataFrame,
    start: datetime.date | str = START_DATE,
    categories: Iterable[str] = CATEGORIES,
    codes: Iterable[str] = TRIVIAL_CODES,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Status per property: no_violations, trivial_only or available.

    ``trivial_only`` means that no summary is stored; the counts include trivial
    violations. ``summaries`` has id, address, summary and any further columns, which
    are added to an available status.
    """
    recent = filters.with_categories(
        filters.since(violations, start, inclusive=False), categories
    )
    located = properties.select("property_id", "address").withColumn(
        "head", text.address_head(F.col("address"))
    )
    heads = located.select("head").distinct()
    counts = counts_per_head(heads, recent, codes)
    first = first_summary(heads, stored(summaries).withColumnRenamed("summary", "_stored"))
    # Joined per head first, so that the properties meet a single table of one row per
    # head; many properties may share an address.
    per_head = counts.join(
        first.withColumn("_has_summary", F.lit(True)), "head", "left"
    )
    joined = salted_join(
        located, per_head, ["head"], salt_by=["property_id"], how="left",
        rows_per_task=rows_per_task,
    )
    n, occasions = F.col("total_violations_count"), F.col("total_inspections_count")
    error = F.when(
        F.coalesce("address", F.lit("")) == "", "Address is required"
    ).when(F.col("head") == "", "Invalid address format")
    status = (
        F.when(error.isNotNull(), F.lit(None))
        .when(n.isNull(), "no_violations")
        .when(F.col("_has_summary").isNull(), "trivial_only")
        .otherwise("available")
    )
    available = F.col("data_status") == "available"
    summary = (
        F.when(F.col("data_status") == "no_violations",
               "No violation record found for this address")
        .when(F.col("data_status") == "trivial_only", _trivial_note(n, occasions))
        .when(available, F.col("_stored"))
    )
    note = F.when(
        available, _trivial_note(F.col("_trivial_violations"), F.col("_trivial_occasions"))
    )
    more = [c for c in summaries.columns if c not in ("id", "address", "summary")]
    return joined.withColumn("error", error).withColumn("data_status", status).select(
        "property_id",
        F.col("head").alias("address"),
        F.lit(start).cast("date").alias("start_date"),
        "data_status",
        "total_violations_count",
        "total_inspections_count",
        summary.alias("summary"),
        note.alias("note"),
        *[F.when(available, F.col(c)).alias(c) for c in more],
        "error",
    )


def unique_violations(violations: DataFrame) -> DataFrame:
    """One row per violation id, the first by all other columns."""
    return first_per_key(
        violations, ["violation_id"], total_order(violations, ["violation_id"])
    )
