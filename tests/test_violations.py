import re
import datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from stoopwise.catalog import violations as queries
from stoopwise.operators import filters, profile, quality
from stoopwise.operators import slices as slicing
from stoopwise.plans import reports
from stoopwise.plans import violations as v

DAY = datetime.date(2024, 1, 5)
OLD = datetime.date(2019, 12, 31)
SCHEMA = (
    "violation_id string, violation_date date, violation_code string, inspection_category string, "
    "address string, inspection_number int, violation_inspector_comments string, violation_ordinance string"
)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [
            ("1", DAY, "CN1", "COMPLAINT", "5 S ELM ST", 7, "no heat", "Heat it.  (14-1(b), 14-2)"),
            ("2", DAY, "CN190019", "COMPLAINT", "5 S ELM ST", 7, "no entry", "Arrange."),
            ("3", DAY, None, "PERIODIC", "5 s elm st apt 2", 8, None, None),
            ("4", datetime.date(2023, 1, 1), "CN2", "PERIODIC", "5 S ELM ST", 3, "dark", "Light it (1-2"),
            ("5", DAY, "CN190029", "COMPLAINT", "6 S OAK", 9, "x", "y"),
            ("6", OLD, "CN1", "COMPLAINT", "7 S OAK", 9, "x", "y"),
            ("7", DAY, "CN1", "PERMIT", "7 S OAK", 9, "x", "y"),
        ],
        SCHEMA,
    )


@pytest.fixture(scope="module")
def answers(spark, rows):
    properties = spark.createDataFrame(
        [(1, "5 S Elm St, Chicago, IL"), (2, "6 S Oak"), (3, "7 S Oak"), (4, ""), (5, None), (6, ", Chicago"), (7, "5 S ELM ST")],
        "property_id int, address string",
    )
    summaries = spark.createDataFrame(
        [(9, "5 S Elm St", "later"), (4, "5 S ELM ST APT 2", "first"), (1, "55 S ELM", "other")],
        "id int, address string, summary string",
    )
    out = {}
    for rows_per_task in (1000, 1):
        found = v.violation_status(properties, rows, summaries, rows_per_task=rows_per_task).collect()
        out[rows_per_task] = {r["property_id"]: r for r in found}
    assert out[1000] == out[1]
    return out[1000]


def test_available(answers):
    row = answers[1]
    assert row["data_status"] == "available" and row["address"] == "5 S ELM ST"
    assert row["summary"] == "first"
    assert (row["total_violations_count"], row["total_inspections_count"]) == (4, 2)
    assert row["note"] == (
        "1 trivial violations about inspector having no entry were reported on 1 occasions "
        "and omitted here for brevity."
    )
    assert answers[7]["total_violations_count"] == 4


def test_trivial_and_none(answers):
    assert answers[2]["data_status"] == "trivial_only"
    assert answers[2]["summary"].startswith("1 trivial violations about inspector")
    assert answers[3]["data_status"] == "no_violations"
    assert answers[3]["summary"] == "No violation record found for this address"
    assert answers[3]["total_violations_count"] is None


def test_errors(answers):
    assert answers[4]["error"] == answers[5]["error"] == "Address is required"
    assert answers[6]["error"] == "Invalid address format" and answers[6]["data_status"] is None


def test_filters(rows):
    ids = lambda df: sorted(r["violation_id"] for r in df.collect())
    assert ids(filters.drop_codes(rows)) == ["1", "3", "4", "6", "7"]
    assert ids(filters.since(rows, DAY)) == ["1", "2", "3", "5", "7"]
    assert ids(filters.since(rows, DAY, inclusive=False)) == []
    assert ids(filters.between_dates(rows, "2019-12-31", "2023-01-01")) == ["4", "6"]
    assert ids(filters.with_categories(rows, ["permit"])) == ["7"]
    assert ids(filters.with_address_prefix(rows, "5 s elm")) == ["1", "2", "3", "4"]
    assert ids(filters.with_address_prefix(rows, "5%")) == []


@pytest.mark.parametrize("rows_per_task", [1000, 1])
def test_report(rows, rows_per_task):
    lines = reports.report_lines(rows.where("address LIKE '5%'"), rows_per_task=rows_per_task)
    texts = {r["address"]: r["report"] for r in reports.report_text(lines).collect()}
    assert texts["5 S ELM ST"] == (
        "This building was cited on the following occasions: "
        "\n\nOn 2024-01-05, it was cited for the following 2 violations: "
        "1) Inspector noted issue(s) with '' -- which allegedly violated city ordinance ''; "
        "2) Inspector noted issue(s) with 'no heat' -- which allegedly violated city ordinance 'Heat it.'; "
        "\n\nOn 2023-01-01, it was cited for the following 1 violations: "
        "1) Inspector noted issue(s) with 'dark' -- which allegedly violated city ordinance 'Light it'; "
    )
    assert texts["5 S ELM ST APT 2"].count("cited for the following 1 violations") == 1
    prompts = reports.prompt_table(reports.report_text(lines), "Do it.").collect()
    assert all(r["prompt"].startswith("Do it.\nThis building") for r in prompts)


def test_a_long_report_is_one_text(spark):
    lines = spark.range(25_000).select(
        F.lit("A").alias("head"),
        F.expr("date_add(date'2020-01-01', int(id div 10000))").alias("violation_date"),
        (F.col("id") % 10_000 + 1).alias("line_no"),
        F.lit(10_000).alias("n_violations"),
        F.concat(F.lit("<"), F.col("id"), F.lit(">")).alias("line"),
    )
    found = reports.prompt_table(reports.report_text(lines.repartition(5)), "Base").collect()
    assert len(found) == 1 and found[0]["prompt"].startswith("Base\nThis building")
    days = [range(20_000, 25_000), range(10_000, 20_000), range(10_000)]
    assert [int(x) for x in re.findall("<([0-9]+)>", found[0]["prompt"])] == [i for d in days for i in d]


def test_addresses_to_summarise(rows):
    got = [tuple(r) for r in v.addresses_to_summarise(rows).collect()]
    assert got[0] == ("5 S ELM ST", 3) and ("6 S OAK", 1) not in got


def test_profiles(spark):
    df = spark.createDataFrame(
        [("A", "c1"), ("A", "c2"), ("A", "c2"), ("B", "c3"), ("B", None), (None, "c3")],
        "violation_description string, violation_code string",
    )
    counts = [tuple(r) for r in profile.value_counts(df, "violation_code").collect()]
    assert counts == [("c2", 2), ("c3", 2), ("c1", 1)]
    catalogue = [tuple(r) for r in profile.code_catalogue(df).collect()]
    assert catalogue[0] == (1, "A", "c2", 2, 2) and (2, "B", None, 1, 1) in catalogue
    assert [r[0] for r in profile.ambiguous_keys(df, "violation_description", "violation_code").collect()] == ["A"]


def test_quality(spark):
    df = spark.createDataFrame([("a", "x"), ("bb", None), (None, "y")], "address string, kind string")
    rules = {
        "short": quality.fits("address", 1),
        "given": quality.not_null("kind"),
        "known": quality.allowed("kind", ["x"]),
    }
    assert {r["rule"]: r["bad_rows"] for r in quality.broken_rules(df, rules).collect()} == {
        "short": 1, "given": 1, "known": 2,
    }
    steps = {"all": F.lit(True), "named": F.col("address").isNotNull(), "x": F.col("kind") == "x"}
    got = [tuple(r) for r in quality.step_counts(df, steps).collect()]
    assert got == [(1, "all", 3, 2), (2, "named", 2, 2), (3, "x", 1, 1)]


def test_a_busy_address_is_counted_by_day_before_the_join(spark, rows):
    heads = spark.createDataFrame([("5 S ELM ST",)], "head string")
    plan = v.counts_per_head(heads, rows)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_a_report_is_sorted_once_per_head(spark, rows):
    more = rows.unionByName(
        rows.withColumns({"violation_id": F.concat("violation_id", F.lit("x")), "violation_date": F.lit(DAY).cast("date")})
    )
    by_heads, by_days = (reports.report_lines(more, rows_per_task=n) for n in (1000, 1))
    assert sorted(map(str, by_heads.collect())) == sorted(map(str, by_days.collect()))
    plan = reports.report_text(by_heads)._jdf.queryExecution().executedPlan().toString()
    # The violations and their heads meet, and then lie by head until the report is whole.
    assert plan.count("Exchange hashpartitioning(head") == 1 and "hashpartitioning(head#" in plan
    assert "report-days" not in plan


def test_changed_reports_look_prefixes_up_twice(spark, rows, monkeypatch):
    stored = reports.report_text(reports.report_lines(rows.where("violation_id <> '6'")))
    join, calls = reports.prefix_join, []
    monkeypatch.setattr(reports, "prefix_join", lambda *a: calls.append(a) or join(*a))
    # Only 7 S OAK is touched; with one row a task, 5 S ELM ST is a busy address under no touched head.
    found = [reports.updated_reports(stored, rows, rows.where("violation_id = '6'"), rows_per_task=n).collect() for n in (1000, 1)]
    assert len(calls) == 4
    whole = sorted(map(str, reports.report_text(reports.report_lines(rows)).collect()))
    assert [sorted(map(str, f)) for f in found] == [whole, whole]


def test_changed_reports_read_the_stored_violations_where_they_lie(spark, rows, monkeypatch):
    stored = reports.report_text(reports.report_lines(rows.where("violation_id <> '6'")))
    keep, names = reports.written, []
    monkeypatch.setattr(reports, "written", lambda df, name: names.append(name) or keep(df, name))
    found = reports.updated_reports(stored, rows, rows.where("violation_id = '6'"))
    assert "report-rows" not in names
    whole = sorted(map(str, reports.report_text(reports.report_lines(rows)).collect()))
    assert sorted(map(str, found.collect())) == whole and "report-rows" in names
    # A citation is looked for once per violation that is shown.
    plan = reports.report_lines(rows, stored=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_") == 1


def test_lines_are_made_from_unique_violations_at_rest(spark, rows, monkeypatch):
    monkeypatch.setattr(slicing, "SLICE_ROWS", 4)
    parts = []
    monkeypatch.setattr(queries, "slices", lambda *a: parts.append(slicing.slices(*a)) or parts[-1])
    # Ids that come twice, once with a later code, and an id that is null.
    later = rows.withColumn("violation_code", F.lit("ZZ"))
    more = rows.unionByName(later).unionByName(rows.limit(2).withColumn("violation_id", F.lit(None).cast("string")))
    found = queries.report_lines(SimpleNamespace(spark=spark, v_violations=more))
    assert len(parts[0]) > 1
    assert sorted(map(str, found.collect())) == sorted(map(str, reports.report_lines(v.unique_violations(more)).collect()))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_nth" not in plan and any("unique-violations" in f for f in found.inputFiles())
