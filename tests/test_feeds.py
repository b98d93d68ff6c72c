import json
import time

import pytest
from pyspark.sql import functions as F

from stoopwise import schemas
from stoopwise.operators import slices as slicing
from stoopwise.sources import readers, writers
from stoopwise.streaming.refresh import latest_snapshot, refresh_groceries_stream
from stoopwise.streaming.saved import current_state, saved_state_stream
from stoopwise.streaming import violations
from stoopwise.streaming.violations import ingest_violations_stream
from stoopwise.plans.saved import saved_state

HEADER = ",".join(schemas.VIOLATION_COLUMNS)


def violation(number, day="1/2/2025", lat="41.8", **more):
    values = {"ID": number, "VIOLATION DATE": day, "ADDRESS": '"5 ELM, REAR"', "LATITUDE": lat, "LONGITUDE": "-87.6", "INSPECTION NUMBER": "7", **more}
    return ",".join(str(values.get(name, "")) for name in schemas.VIOLATION_COLUMNS)


def test_violations_csv(spark, tmp_path):
    path = tmp_path / "v.csv"
    path.write_text("\n".join([HEADER, violation(1), violation(2, lat="")]) + "\n")
    rows = readers.violations(spark, str(path)).orderBy("violation_id").collect()
    assert rows[0]["address"] == "5 ELM, REAR" and str(rows[0]["violation_date"]) == "2025-01-02"
    assert tuple(rows[0]["location"]) == (-87.6, 41.8) and rows[1]["location"] is None
    path.write_text("\n".join([HEADER, violation(1, day="13/13/2025")]) + "\n")
    with pytest.raises(Exception, match="CANNOT_PARSE|DateTime"):
        readers.violations(spark, str(path)).collect()


def test_records_with_line_breaks_and_short_records(spark, tmp_path):
    path = tmp_path / "v.csv"
    note = '"first line\nsecond ""line"", with a comma"'
    rows = [violation(1, **{"VIOLATION INSPECTOR COMMENTS": note}), "2,1/2/2025,too short", violation(3)]
    path.write_text("\n".join([HEADER, *rows]) + "\n")
    found = {r["violation_id"]: r for r in readers.violations(spark, str(path), strict=False).collect()}
    assert found["1"]["violation_inspector_comments"] == 'first line\nsecond "line", with a comma'
    assert found["1"]["error"] is None and found["3"]["error"] is None
    assert found["2"]["error"] == "unreadable: record" and len(found) == 3
    with pytest.raises(Exception, match="broken record"):
        readers.violations(spark, str(path)).collect()


def test_whole_documents(spark, tmp_path):
    stops = tmp_path / "stops.geojson"
    stops.write_text(json.dumps({"type": "FeatureCollection", "features": [
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [-87.6, 41.8]},
         "properties": {"stop_id": "1", "stop_name": "a", "route_name": "Drexel"}},
        {"type": "Feature", "geometry": None, "properties": {"stop_id": "2"}},
    ]}, indent=1))
    rows = readers.shuttle_points(spark, str(stops), lines=False).orderBy("stop_id").collect()
    assert tuple(rows[0]) == ("1", "a", "Drexel", -87.6, 41.8) and rows[1]["x"] is None
    notes = tmp_path / "summaries.json"
    notes.write_text(json.dumps({"1 A": {"summary": "x", "summarized_issues": []}, "2 B": {"summary": "y"}}, indent=1))
    found = {r["address"]: r["summary"]["summary"] for r in readers.address_summaries(spark, str(notes), lines=False).collect()}
    assert found == {"1 A": "x", "2 B": "y"}


def test_scan_pushes_down(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "id * 2 AS twice", "string(id) AS text").write.parquet(path)
    found = readers.table(spark, path, ["id"], "twice > 150")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(twice,150)" in plan and "text" not in plan.split("ReadSchema")[1]
    assert found.count() == 24


def test_dead_letters_are_appended(spark, tmp_path):
    path = str(tmp_path / "dead")
    df = spark.createDataFrame([("a", None), ("b", "broken")], "address string, error string")
    good, bad = writers.split_dead_letters(df)
    assert good.columns == ["address"] and good.count() == 1
    for _ in range(2):
        writers.append_dead_letters(bad, path)
    assert spark.read.option("header", True).csv(path).count() == 2


def test_violation_stream_carries_on(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    out, dead, progress = (str(tmp_path / n) for n in ("out", "dead", "progress"))

    def run():
        ingest_violations_stream(spark, str(source), out, dead, progress).awaitTermination()
        return sorted((r["violation_id"], r["violation_code"]) for r in spark.read.parquet(out).collect())

    (source / "a.csv").write_text("\n".join([HEADER, violation(1, **{"VIOLATION CODE": "A"}), violation(2, day="soon"), violation("")]) + "\n")
    assert run() == [("1", "A")]
    # A known id is skipped, a new one added, a repeated one added once.
    (source / "b.csv").write_text("\n".join([HEADER, violation(1, **{"VIOLATION CODE": "B"}), violation(3), violation(3)]) + "\n")
    assert run() == [("1", "A"), ("3", None)]
    assert run() == [("1", "A"), ("3", None)]
    errors = sorted(r["error"] for r in spark.read.parquet(dead).collect())
    assert errors == ["unreadable: violation_date", "unreadable: violation_id"]


def test_a_large_batch_is_taken_in_by_slices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(slicing, "SLICE_ROWS", 50)
    source = tmp_path / "in"
    source.mkdir()
    out, dead, progress = (str(tmp_path / n) for n in ("out", "dead", "progress"))

    def run(name, ids, code):
        rows = [violation(i, **{"VIOLATION CODE": c}) for i in ids for c in (code, "Z")]
        (source / name).write_text("\n".join([HEADER, *rows, violation(name, day="soon")]) + "\n")
        parts = []
        monkeypatch.setattr(violations, "slices", lambda *a: parts.append(slicing.slices(*a)) or parts[-1])
        ingest_violations_stream(spark, str(source), out, dead, progress, divisions=7).awaitTermination()
        assert [len(p) for p in parts] == [4]
        return {r["violation_id"]: r["violation_code"] for r in spark.read.parquet(out).collect()}

    assert run("a", range(300), "A") == {str(i): "A" for i in range(300)}
    found = run("b", range(200, 500), "B")
    assert found == {str(i): "A" if i < 300 else "B" for i in range(500)}
    stored = spark.read.parquet(out)
    assert stored.count() == 500 and sorted(r["violation_id"] for r in spark.read.parquet(dead).collect()) == ["a", "b"]
    # A division of a batch is one file.
    assert stored.select(F.input_file_name()).distinct().count() == stored.select("batch", "division").distinct().count()


def test_groceries_take_in_one_listing_after_the_other(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()

    def listing(name, stores):
        lines = [
            {"type": "Feature", "geometry": {"type": "Point", "coordinates": [-87.6, 41.8]},
             "properties": {"store_name": s, "address": f"{s} Road", "zip": "1", "new_status": "OPEN",
                            "last_updated": "2025-01-01T00:00:00.000"}}
            for s in stores
        ]
        (source / name).write_text("\n".join(map(json.dumps, lines)) + "\n")

    first = str(tmp_path / "first")
    none = "address string, type string, name string, lon double, lat double"
    spark.createDataFrame([], none).write.parquet(first)
    listing("a.json", ["One", "Two"])
    time.sleep(1.1)  # files are taken in by their time
    listing("b.json", ["Two", "Three"])
    table, progress = str(tmp_path / "t"), str(tmp_path / "p")
    refresh_groceries_stream(spark, str(source), first, table, progress).awaitTermination()
    names = {r["name"] for r in latest_snapshot(spark, first, table).collect()}
    assert names == {"Two", "Three"}


def test_documents_hold_a_bounded_number_of_features(spark, tmp_path):
    # Equal rows as well: no part of a feature may decide on its document alone.
    rows = spark.range(0, 50_000, 1, 2).select(
        F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).cast("string").alias("stop_id"),
        F.lit("a").alias("stop_name"), F.lit("Drexel").alias("route_name"), F.lit(-87.6).alias("x"), F.lit(41.8).alias("y"),
    )
    path = str(tmp_path / "documents")
    writers.write_collection(rows, path, writers.shuttle_stop_feature())
    sizes = [len(json.loads(r["value"])["features"]) for r in spark.read.text(path, wholetext=True).collect()]
    assert sum(sizes) == 50_000 and max(sizes) <= 8192
    found = readers.shuttle_points(spark, path, lines=False)
    assert found.exceptAll(rows).count() == rows.exceptAll(found).count() == 0


def test_a_listing_may_be_a_folder_of_many_files(spark, tmp_path):
    def listing(numbers, folder):
        store = F.col("id").cast("string")
        properties = F.struct(
            store.alias("store_name"), F.concat(store, F.lit(" Road")).alias("address"), F.lit("1").alias("zip"),
            F.lit("OPEN").alias("new_status"), F.lit("2025-01-01T00:00:00.000").alias("last_updated"),
        )
        geometry = F.struct(F.lit("Point").alias("type"), F.array(F.lit(-87.6), F.lit(41.8)).alias("coordinates"))
        feature = F.struct(geometry.alias("geometry"), properties.alias("properties"))
        writers.write_listing(numbers.select(feature.alias("f")), str(tmp_path / folder), source, F.col("f"))

    source, first = str(tmp_path / "in"), str(tmp_path / "first")
    none = "address string, type string, name string, lon double, lat double"
    spark.createDataFrame([], none).write.parquet(first)
    listing(spark.range(0, 30, 1, 5), "one")
    time.sleep(1.1)  # files are taken in by their time
    listing(spark.range(20, 50, 1, 5), "two")
    assert len(list((tmp_path / "two").glob("part-*"))) == 5
    table = str(tmp_path / "t")
    refresh_groceries_stream(spark, source, first, table, str(tmp_path / "p")).awaitTermination()
    names = {r["name"] for r in latest_snapshot(spark, first, table).collect()}
    assert names == {str(n) for n in range(20, 50)}
    assert spark.read.parquet(f"{table}/snapshot").select("batch").distinct().count() == 2


def test_saved_stream_equals_batch(spark, tmp_path):
    schema = "event_id int, ts timestamp_ntz, user_id int, address string, action string, custom_name string, remarks string, rent string"
    actions = ["save", "update", "delete", "save", "delete", "update"]
    events = spark.sql("SELECT explode(sequence(0, 59)) AS i").selectExpr(
        "i AS event_id",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, i) AS ts",
        "i % 3 AS user_id",
        "if(i % 2 = 0, '1 Elm', '1 ELM') AS address",
        "element_at(array(" + ", ".join(f"'{a}'" for a in actions) + "), pmod(i * 7, 6) + 1) AS action",
        "string(i) AS custom_name",
        "string(NULL) AS remarks",
        "string(i) AS rent",
    )
    properties = spark.createDataFrame([(1, "1 ELM")], "property_id int, address string")
    source = str(tmp_path / "in")
    log, state, progress = (str(tmp_path / n) for n in ("log", "state", "progress"))
    # The files mix early and late events, so later batches bring earlier ones.
    for part in range(3):
        events.where(f"event_id % 3 = {part} OR (event_id DIV 3) % 3 = {part}").dropDuplicates(["event_id"]).where(
            " AND ".join(f"NOT (event_id % 3 = {p} OR (event_id DIV 3) % 3 = {p})" for p in range(part)) or "true"
        ).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        saved_state_stream(
            stream, properties, log, state, progress, divisions=4, batches_per_copy=2
        ).awaitTermination()
    expected = sorted(map(str, saved_state(events, properties).collect()))
    assert sorted(map(str, current_state(spark, state).select(saved_state(events, properties).columns).collect())) == expected


def test_loads_of_a_publication_read_landed_feeds(spark, monkeypatch):
    from types import SimpleNamespace

    from stoopwise.catalog import feeds

    stops = spark.createDataFrame(
        [("1", "R1", "a", "41.8", "-87.6", "cta"), ("2", "R9", "b", "41.8", "-87.6", "cta")],
        "stop_id string, route_id string, stop_name string, latitude string, longitude string, type string",
    )
    routes = spark.createDataFrame(
        [("R1", "one", "cta", [[(-87.6, 41.8), (-87.5, 41.9)]])],
        "route_id string, name string, type string, geometry array<array<struct<lon: double, lat: double>>>",
    )
    publish, loads = feeds.transit.transit_publish, []
    monkeypatch.setattr(feeds.transit_queries, "feed_rows", lambda t: (stops, routes))
    monkeypatch.setattr(feeds.transit, "transit_publish", lambda s, r, shelf: loads.append((s, r)) or publish(s, r, shelf))
    found = {(r.reader, r.table_name): r.n for r in feeds.transit_published(SimpleNamespace(spark=spark)).collect()}
    counts = {"stops": 2, "routes": 1, "route_stops": 1}
    assert found == {(w, t): n * (w != "before") for w in ("before", "during", "after") for t, n in counts.items()}
    # The two full loads read files, and not the joins that made the feeds.
    assert len(loads) == 3 and all(df.inputFiles() for load in loads[1:] for df in load)


def test_broken_fields_are_looked_for_once_per_record(spark):
    fields = {name: "x" for name in schemas.VIOLATION_COLUMNS}
    good = fields | dict.fromkeys([n for n, (_, kind) in schemas.VIOLATION_COLUMNS.items() if kind != "string"], " ")
    bad = good | {"ID": None, "VIOLATION DATE": "31/31/1999", "LATITUDE": "north"}
    raw = spark.createDataFrame([tuple(r.values()) for r in (good, bad)], schemas.VIOLATIONS_CSV)
    kept, dead = writers.split_dead_letters(readers.typed_violations(raw, strict=False))
    assert [r["violation_id"] for r in kept.collect()] == ["x"]
    assert [r["error"] for r in dead.collect()] == ["unreadable: violation_id, violation_date, latitude"]
    plan = dead.select("violation_id", "error")._jdf.queryExecution().optimizedPlan().toString()
    # Once for each of the three dates, and never as a condition or inside of a lambda.
    assert plan.count("gettimestamp") == 3 and "lambda" not in plan
