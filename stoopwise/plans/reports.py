"""Concatenated violation reports per address and the prompts made from them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stoopwise.functions import text
from stoopwise.operators import filters
from stoopwise.operators.numbering import number_within
from stoopwise.operators.prefix import prefix_join
from stoopwise.operators.skew import salted_join
from stoopwise.params import ROWS_PER_TASK, TRIVIAL_CODES
from stoopwise.session import written

# Fixed value: the opening of every report.
OPENING = "This building was cited on the following occasions: "

# Columns of the violations that decide on a report.
SHOWN = [
    "violation_id", "violation_date", "violation_code", "inspection_number", "inspection_category",
    "violation_inspector_comments", "violation_ordinance", "address",
]

# Lines of one task, which sorts them by head.
LINES_PER_TASK = 1_000_000


def _order() -> list[Column]:
    """Order of the lines of a day."""
    return [F.desc("inspection_number"), F.asc("inspection_category"), F.asc("violation_id")]


def _occasion_opening(day: Column, n: Column) -> Column:
    return F.concat(
        F.lit("On "),
        text.report_date(day),
        F.lit(", it was cited for the following "),
        n.cast("string"),
        F.lit(" violations: "),
    )


def _line(number: Column, comment: Column, ordinance: Column) -> Column:
    return F.concat(
        number.cast("string"),
        F.lit(") Inspector noted issue(s) with '"),
        F.coalesce(comment, F.lit("")),
        F.lit("' -- which allegedly violated city ordinance '"),
        ordinance,
        F.lit("'; "),
    )


def report_lines(
    violations: DataFrame,
    codes: Iterable[str] = TRIVIAL_CODES,
    rows_per_task: int = ROWS_PER_TASK,
    heads: DataFrame | None = None,
    stored: bool = False,
) -> DataFrame:
    """One row per report line, of all addresses or of those in ``heads`` (head).

    ``stored`` says that ``violations`` are a table at rest, or rows filtered from one:
    they are read where they lie and not written once more.

    ``head`` is the address of the report, ``line_no`` counts within an occasion (a
    day) of ``n_violations`` lines, ``place`` within the whole report, latest occasion
    first. ``violations`` must be unique by violation_id. Every address gets a report,
    and by the prefix rule it also covers longer addresses that start with its own.

    What belongs to which head is settled on a table of one row per address. The
    violations then look up their heads and are sorted once per head, which numbers and
    counts their lines; a report made from them needs no further shuffle. Where a head
    has more lines than one task should handle, days are placed by tables of one row per
    address and day, and lines numbered across tasks.
    """
    columns = ["violation_id", "violation_date", "inspection_number", "inspection_category", "violation_inspector_comments"]
    kept = violations.select(
        F.upper("address").alias("_text"),
        *columns,
        "violation_ordinance",
        filters.one_of(F.col("violation_code"), codes).alias("_trivial"),
    )
    # Read several times below, and usually the outcome of a deduplication.
    kept = kept if stored else written(kept, "report-rows")
    serious = ~F.col("_trivial") & F.col("violation_date").isNotNull()
    # A citation is dropped once per violation that is shown, which may have lines in many reports.
    rows = kept.where(serious).select(
        "_text", *columns, text.strip_citation(F.col("violation_ordinance")).alias("_ordinance")
    )
    addresses = written(kept.groupBy("_text").agg(F.count_if(serious).alias("_n")), "report-addresses")
    # Every listed address is a head, also one that has trivial violations only: it gets
    # a report when a longer address that starts with it has a serious one.
    wanted = addresses.select(F.col("_text").alias("head")) if heads is None else heads
    texts = addresses.where("_n > 0")
    pairs = written(prefix_join(wanted, texts, "head", "_text").join(texts, "_text"), "report-pairs")
    # The busiest address may be under none of the given heads.
    busiest = addresses.agg(F.max("_n")).first()[0] or 0
    total, largest = pairs.groupBy("head").agg(F.sum("_n").alias("_n")).agg(F.sum("_n"), F.max("_n")).first()
    if max(busiest, largest or 0) > rows_per_task:
        numbered = _numbered_by_days(rows, pairs.drop("_n"), rows_per_task)
    else:
        numbered = _numbered_by_heads(rows, pairs.drop("_n"), total or 0)
    return numbered.select(
        "head",
        "violation_date",
        "line_no",
        "n_violations",
        "place",
        _line(F.col("line_no"), F.col("violation_inspector_comments"), F.col("_ordinance")).alias("line"),
    )


def _numbered_by_heads(rows: DataFrame, pairs: DataFrame, lines: int) -> DataFrame:
    """The rows of each head with their numbers; one task holds all rows of a head."""
    joined = rows.join(pairs, "_text").drop("_text")
    parts = -(-lines // LINES_PER_TASK)
    if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        joined = joined.repartition(parts, "head")
    day = Window.partitionBy("head").orderBy(F.desc("violation_date"))
    # The order of the days begins that of the lines, so one sort does for all three.
    numbers = {
        "place": F.row_number().over(Window.partitionBy("head").orderBy(F.desc("violation_date"), *_order())).cast("long"),
        "_first": F.rank().over(day),
        "n_violations": F.count("*").over(day.rangeBetween(Window.currentRow, Window.currentRow)),
    }
    return joined.withColumns(numbers).withColumn("line_no", F.col("place") - F.col("_first") + 1)


def _numbered_by_days(rows: DataFrame, pairs: DataFrame, rows_per_task: int) -> DataFrame:
    """The same numbers where a head, or even a day of it, is too large for one task."""
    days = pairs.join(
        rows.groupBy("_text", "violation_date").agg(F.count("*").alias("_n")), "_text"
    )
    occasions = days.groupBy("head", "violation_date").agg(F.sum("_n").alias("n_violations"))
    # The days of an address are few, so they can be added up in one window.
    later = (
        Window.partitionBy("head")
        .orderBy(F.desc("violation_date"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = occasions.withColumn("_before", F.coalesce(F.sum("n_violations").over(later), F.lit(0)))
    plan = written(
        days.drop("_n").join(placed, ["head", "violation_date"]), "report-days"
    )
    largest = plan.agg(F.max("n_violations")).first()[0] or 0
    joined = salted_join(
        rows,
        plan,
        ["_text", "violation_date"],
        salt_by=["violation_id"],
        rows_per_task=rows_per_task,
    )
    numbered = number_within(
        joined,
        ["head", "violation_date"],
        _order(),
        name="line_no",
        rows_per_task=rows_per_task,
        largest=largest,
    )
    return numbered.withColumn("place", F.col("_before") + F.col("line_no"))


def report_text(lines: DataFrame) -> DataFrame:
    """Whole report per address, from the rows of ``report_lines``, latest occasion first.

    The first line of a day is opened by its date. A report is one value; one beyond what
    a row can hold fails and is not cut.
    """
    # Days back from a fixed one sort the latest first.
    back = -F.unix_date("violation_date")
    ordered = F.sort_array(F.collect_list(F.struct(back.alias("back"), "line_no", "line", "n_violations")))

    def opened(x: Column) -> Column:
        opening = F.concat(
            F.lit("\n\n"), _occasion_opening(F.date_from_unix_date(-x["back"]), x["n_violations"])
        )
        return F.when(x["line_no"] == 1, F.concat(opening, x["line"])).otherwise(x["line"])

    body = F.array_join(F.transform(ordered, opened), "")
    return lines.groupBy(F.col("head").alias("address")).agg(F.concat(F.lit(OPENING), body).alias("report"))


def touched_heads(violations: DataFrame, changed: DataFrame) -> DataFrame:
    """Heads whose report a change reaches: addresses that changed addresses start with, or are.

    ``violations`` are all rows after the change, ``changed`` the rows added, changed or gone.
    """
    addresses = changed.select(F.upper("address").alias("_text")).distinct()
    listed = violations.select(F.upper("address").alias("head")).distinct().unionByName(
        addresses.withColumnRenamed("_text", "head")
    )
    return prefix_join(listed, addresses, "head", "_text").select("head").distinct()


def updated_reports(
    reports: DataFrame,
    violations: DataFrame,
    changed: DataFrame,
    codes: Iterable[str] = TRIVIAL_CODES,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """``reports`` (address, report) after a change, with only the reports it reaches built again.

    ``violations`` are all rows after the change, unique by id, and best a stored table, for
    they are read where they lie; ``changed`` has the address of every row that was added, changed or taken away. Only rows of addresses under a
    touched head become lines. A touched address that has no line any more loses its report.
    """
    touched = written(touched_heads(violations, changed), "touched-heads")
    rebuilt = report_text(report_lines(violations, codes, rows_per_task, heads=touched, stored=True))
    gone = touched.select(F.col("head").alias("address"))
    return reports.select("address", "report").join(gone, "address", "left_anti").unionByName(rebuilt)


def prompt_table(reports: DataFrame, base_prompt: str) -> DataFrame:
    """The base prompt, a line break and the report, per address."""
    return reports.select("address", F.concat(F.lit(base_prompt + "\n"), "report").alias("prompt"))
