"""Counts, sketches, reports and layouts that are kept up to date or read in part."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from stoopwise.catalog import streams
from stoopwise.operators import profile, sketches
from stoopwise.operators.counts import CountStore, distinct_from
from stoopwise.plans import reports
from stoopwise.session import new_path
from stoopwise.sources import layout
from stoopwise.streaming.counts import PROFILES, count_stream

SHAPE = "violation_description string, violation_code string, inspection_category string, inspection_number long, violation_status string, violation_date date"


def some_rows(seed, n):
    rng = random.Random(seed)
    # One description has about a third of the rows.
    return [
        (
            "d0" if rng.random() < 0.33 else rng.choice(["d1", "d2", "d3", None]),
            rng.choice(["c1", "c2", None]),
            rng.choice(["COMPLAINT", None]),
            rng.randint(1, 20),
            rng.choice(["OPEN", "CLOSED", None]),
            datetime.date(2020, rng.randint(1, 3), rng.randint(1, 28)),
        )
        for _ in range(n)
    ]


def as_set(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_counts_follow_a_stream_that_stops_and_goes_on(spark):
    base = new_path(spark, "counts-test")
    whole = None
    for i in range(3):
        rows = spark.createDataFrame(some_rows(i, 60), SHAPE).coalesce(1)
        rows.write.mode("append").parquet(f"{base}/in")
        whole = rows if whole is None else whole.unionByName(rows)
        stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        count_stream(stream, f"{base}/counts", f"{base}/progress", batches_per_copy=2).awaitTermination()
    store = CountStore(spark, f"{base}/counts", PROFILES, batches_per_copy=2)
    pairs = store.read("codes").withColumnRenamed("n", "n_violations")
    assert as_set(profile.catalogue_of(pairs, *PROFILES["codes"])) == as_set(profile.code_catalogue(whole))
    assert as_set(distinct_from(store.read("statuses"), "inspection_number", "violation_status", "n")) == as_set(
        profile.distinct_per_key(whole, "inspection_number", "violation_status", "n")
    )
    days = profile.days_and_months(store.read("days"), "inspection_number", "violation_date")
    assert as_set(days) == as_set(profile.days_and_months(whole, "inspection_number", "violation_date"))


def test_a_batch_again_and_rows_taken_back(spark):
    store = CountStore(spark, new_path(spark, "counts"), {"by": ["a", "b"]}, batches_per_copy=2)
    assert store.read("by") is None
    frame = lambda rows: spark.createDataFrame(rows, "a string, b string, w int")
    store.add(frame([("x", None, 1), ("x", None, 1), (None, "y", 1)]), 0)
    for _ in range(2):
        store.add(frame([("x", None, -1), (None, "y", -1), ("z", "z", 1)]), 1, weight=F.col("w"))
    assert as_set(store.read("by")) == as_set(frame([("x", None, 1), ("z", "z", 1)]).withColumn("w", F.col("w").cast("long")))
    store.add(frame([]), 2)
    assert store.read("by").count() == 2


def test_sketches_of_batches_add_up(spark):
    rng = random.Random(9)
    n = 30_000
    values = [(i % 3, rng.randint(0, 12_000)) for i in range(n)] + [(0, None)]
    rows = spark.createDataFrame(values, "batch int, v int")
    parts = sketches.sketched(rows, ["batch"], "v")
    one = sketches.estimated(sketches.merged(parts, []), "n").first()
    exact = len({v for _, v in values if v is not None})
    assert one.n_rows == n + 1
    assert abs(one.n - exact) <= 6 * sketches.standard_error() * exact
    twice = sketches.estimated(sketches.merged(parts.unionByName(parts), []), "n").first()
    assert twice.n == one.n
    assert sketches.estimated(sketches.sketched(rows.limit(0), ["batch"], "v"), "n").count() == 0


def test_steps_of_a_period_from_its_days(spark):
    day = lambda d: datetime.date(2020, 1, d)
    rows = spark.createDataFrame(
        [(day(d), f"a{i % 5}", i) for d in range(1, 6) for i in range(20)] + [(day(3), None, None)], "d date, a string, x int"
    )
    steps = {"all": F.lit(True), "small": F.col("x") < 12, "even": F.col("x") % 2 == 0}
    daily = sketches.daily_steps(rows, steps, "d", "a").where(F.col("day").between("2020-01-02", "2020-01-04"))
    found = sketches.estimated(sketches.merged(daily, ["step_no", "step"]), "n").orderBy("step_no").collect()
    assert [tuple(r) for r in found] == [(1, "all", 61, 5), (2, "small", 36, 5), (3, "even", 18, 5)]


VIOLATION = (
    "violation_id string, violation_date date, violation_code string, inspection_number int, inspection_category string, "
    "violation_inspector_comments string, violation_ordinance string, address string"
)


def test_only_touched_reports_are_built_again(spark):
    def row(i, address, code="C"):
        return (str(i), datetime.date(2021, 1, 1 + i % 5), code, i, "COMPLAINT", f"note {i}", f"rule {i}", address)

    before = [row(i, a) for i, a in enumerate(["1 A ST", "1 A ST APT 2", "2 B ST", "3 C ST", "4 d st", None] * 3)]
    added = [row(100, "1 a st apt 2"), row(101, "5 E ST"), row(102, "6 F ST", "CN190019")]
    # All rows of one address turn trivial.
    after = [r if r[7] != "3 C ST" else (*r[:2], "CN190019", *r[3:]) for r in before] + added
    changed = [r for r in after if r not in before]
    old, new, delta = (spark.createDataFrame(rows, VIOLATION) for rows in (before, after, changed))
    stored = reports.report_text(reports.report_lines(old))
    # A mark on what is stored shows what is not built again.
    marked = stored.withColumn("report", F.concat(F.lit("stored "), "report"))
    found = {r.address: r.report for r in reports.updated_reports(marked, new, delta).collect()}
    whole = {r.address: r.report for r in reports.report_text(reports.report_lines(new)).collect()}
    kept = {a for a, text in found.items() if text.startswith("stored ")}
    assert kept == {"2 B ST", "4 D ST"}
    assert {a: text.removeprefix("stored ") for a, text in found.items()} == whole
    assert "3 C ST" not in whole and "5 E ST" in whole


def rows_scanned(df):
    """Rows that the scan of a plan without a shuffle hands on."""
    execution = df._jdf.queryExecution()
    plan = execution.executedPlan()
    plan.executeCollect()
    return plan.collectLeaves().head().metrics().apply("numOutputRows").value()


def test_a_scan_of_the_layout_passes_row_groups_over(spark):
    n = 40_000
    ids = spark.range(n)
    rows = ids.select(
        F.xxhash64("id").cast("string").alias("violation_id"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 700).cast("int")).alias("violation_date"),
        F.concat(F.xxhash64(F.col("id") * 7).cast("string"), F.lit(" S ST")).alias("address"),
        (41.7 + F.col("id") % 300 / 1000).alias("latitude"),
        F.when(F.col("id") % 10 > 0, -87.6 + F.col("id") % 77 / 1000).alias("longitude"),
    )
    path = new_path(spark, "layout")
    layout.write_violations(rows, path, rows_per_file=4_000, row_group_bytes=64 * 1024)
    table = spark.read.parquet(path)
    assert as_set(table.agg(F.count("*"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")))) == as_set(
        rows.agg(F.count("*"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")))
    )
    week = table.where("violation_date BETWEEN DATE '2020-05-04' AND DATE '2020-05-10'")
    assert 0 < rows_scanned(week.select("violation_id")) <= n / 4
    wanted = [r.address for r in rows.orderBy("violation_id").limit(2).collect()]
    one = layout.with_values(spark, path, "address", wanted)
    assert one.count() == 2
    assert rows_scanned(one.select("violation_id")) <= n / 2
    assert rows_scanned(layout.with_values(spark, path, "violation_id", ["no such id"]).select("address")) <= n / 4


def test_an_empty_table_has_a_layout(spark):
    path = new_path(spark, "layout")
    layout.write_violations(spark.createDataFrame([], VIOLATION + ", latitude double, longitude double"), path)
    assert spark.read.parquet(path).count() == 0


def test_landed_tables_come_in_files_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(streams, "FILE_ROWS", 10)
    path = new_path(spark, "landed-table")
    assert streams._landed(spark.range(301), path) == 11
    parts = spark.read.parquet(path).groupBy("_metadata.file_name").count().collect()
    assert len(parts) == 33 and sum(p["count"] for p in parts) == 301
    assert max(p["count"] for p in parts) <= 15
    assert streams._landed(spark.range(0), new_path(spark, "landed-table")) == 1
