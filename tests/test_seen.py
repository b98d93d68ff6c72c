"""Ingest with the seen ids in a state store."""

import datetime
import glob
import time
from types import SimpleNamespace

import pytest

from stoopwise import schemas
from stoopwise.catalog import streams
from stoopwise.catalog.registry import Given
from stoopwise.operators import slices as slicing
from stoopwise.session import new_path, written
from stoopwise.streaming.seen import ingest_unseen


def land(spark, path, rows):
    names = list(schemas.VIOLATION_COLUMNS)
    frame = spark.createDataFrame(
        [tuple({"ID": i, "VIOLATION DATE": day, "ADDRESS": address}.get(n) for n in names) for i, day, address in rows],
        ", ".join(f"`{n}` string" for n in names),
    )
    frame.coalesce(1).write.mode("append").option("header", "true").option("escape", '"').csv(path)


def test_an_id_is_taken_in_once_over_restarts(spark):
    base = new_path(spark, "seen")
    existing = spark.createDataFrame([("1",), ("2",), ("2",)], "violation_id string")

    def run(rows):
        land(spark, f"{base}/in", rows)
        # After the first start the stored ids come from the state alone.
        for query in ingest_unseen(spark, f"{base}/in", existing, f"{base}/out", f"{base}/dead", f"{base}/progress"):
            query.awaitTermination()
        return sorted((r.violation_id, r.address) for r in spark.read.parquet(f"{base}/out").collect())

    # A third of the rows and more have one id.
    first = [("1", "1/2/2020", "stored"), ("3", "1/2/2020", "b"), ("3", "1/2/2020", "a")] + [("4", "1/3/2020", f"x{i}") for i in range(9, -1, -1)]
    assert run([*first, ("5", "no day", "bad"), (None, "1/2/2020", "no id")]) == [("3", "a"), ("4", "x0")]
    existing = existing.limit(0)
    found = run([("2", "1/2/2020", "stored"), ("3", "1/1/2019", "0"), ("6", "", None), ("5", "1/4/2020", "now good")])
    assert found == [("3", "a"), ("4", "x0"), ("5", "now good"), ("6", None)]
    assert run([("6", "1/2/2020", "again")]) == found
    errors = sorted((r.violation_id or "", r.error) for r in spark.read.parquet(f"{base}/dead").collect())
    assert errors == [("", "unreadable: violation_id"), ("5", "unreadable: violation_date")]


def test_rows_of_one_text_order_differ_in_type_only_once(spark):
    """Many ids in one batch, each with two rows, pass without a call per id; of equal texts one stays."""
    base = new_path(spark, "seen")
    existing = spark.createDataFrame([(str(i),) for i in range(0, 3000, 3)], "violation_id string")
    land(spark, f"{base}/in", [(str(i), "1/2/2020", a) for i in range(3000) for a in ("b", "a!", "a")])
    for query in ingest_unseen(spark, f"{base}/in", existing, f"{base}/out", f"{base}/dead", f"{base}/progress"):
        query.awaitTermination()
    found = spark.read.parquet(f"{base}/out").collect()
    assert sorted(int(r.violation_id) for r in found) == [i for i in range(3000) if i % 3]
    assert {r.address for r in found} == {"a!"}  # as texts the quote comes after the exclamation mark


def test_landed_files_grow_in_number(spark, monkeypatch):
    monkeypatch.setattr(streams, "LANDED_ROWS", 1000)
    base = new_path(spark, "landed")
    given = Given(spark, "/root/testdata/sf0.001")
    files = streams._land(given, f"{base}/in")
    rows = given.v_violations.count()
    assert files == -(-rows // 1000) > 4
    parts = [len(p) for p in spark.read.option("header", "true").csv(f"{base}/in").rdd.glom().collect()]
    assert sum(parts) == rows


def test_the_state_store_holds_ids_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(slicing, "SLICE_ROWS", 100)  # each table in several slices
    base = new_path(spark, "seen")
    existing = spark.createDataFrame([("0",), ("1",)], "violation_id string")
    parts = []

    def run(rows):
        land(spark, f"{base}/in", rows)
        for query in ingest_unseen(spark, f"{base}/in", existing, f"{base}/out", f"{base}/dead", f"{base}/progress"):
            parts.append(query)
            query.awaitTermination()
        return {r.violation_id: r.address for r in spark.read.parquet(f"{base}/out").collect()}

    found = run([(str(i), "1/2/2020", a) for i in range(500) for a in ("b", "a")])
    assert found == {str(i): "a" for i in range(2, 500)}
    # A later batch adds its new ids alone, and the rows on their way are gone.
    assert run([(str(i), "1/2/2020", "later") for i in range(400, 700)]) == found | {str(i): "later" for i in range(500, 700)}
    assert not glob.glob(f"{base}/progress/landed/*/*")
    state = spark.read.format("statestore").load(f"{base}/progress/ids")
    assert {f.dataType.simpleString() for f in state.schema["value"].dataType} <= {"timestamp", "bigint"}
    assert state.count() == 700 and len(parts) == 4


@pytest.mark.parametrize("rows", [10, 1000])
def test_slices_hold_every_row_once_and_keys_whole(spark, monkeypatch, rows):
    monkeypatch.setattr(slicing, "SLICE_ROWS", 100)
    table = written(spark.range(rows).selectExpr("nullif(id % 50, 7) AS k", "id"), "table")
    found = [part.collect() for part in slicing.slices(table, ["k"])]
    assert len(found) == (4 if rows == 1000 else 1)
    assert sorted(r.id for part in found for r in part) == list(range(rows))
    assert sum(len({r.k for r in part}) for part in found) == len({r.k for part in found for r in part})


def test_a_written_table_leaves_no_shuffle_files(spark):
    disk = spark._jsc.sc().env().blockManager().diskBlockManager()
    names = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllFiles())}
    shuffles = lambda: {n for n in names() if n.startswith("shuffle_")}
    before, until = shuffles(), time.time() + 20
    table = written(spark.range(1000).repartition(5, "id"), "table")
    while not shuffles() <= before and time.time() < until:  # they are deleted in the background
        time.sleep(0.1)
    assert shuffles() <= before
    assert table.count() == 1000
    # Jobs other than writes of the code keep theirs.
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_violations_land_compressed(spark):
    base = new_path(spark, "landed")
    rows = spark.createDataFrame([("1", datetime.date(2020, 1, 2)), ("2", None)], "violation_id string, violation_date date")
    assert streams._land(SimpleNamespace(spark=spark, v_violations=rows), f"{base}/in") == 4
    assert glob.glob(f"{base}/in/*.csv.gz") and not glob.glob(f"{base}/in/*.csv")
    found = spark.read.option("header", "true").csv(f"{base}/in").select("ID", "VIOLATION DATE").collect()
    assert sorted(map(tuple, found)) == [("1", "1/2/2020"), ("2", None)]
