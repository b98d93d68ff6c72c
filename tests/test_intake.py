from stoopwise.params import URBAN_AREA
from stoopwise.plans import intake, summaries

KNOWN = ["31 W QUARRY LN, CHICAGO, IL, 60700", "208 N ORCHARD CT, CHICAGO, IL, 60711"]
SPELLINGS = {
    typed: i
    for i, (number, direction, name, suffix) in enumerate(
        [("31", ("W", "West"), "Quarry", ("Ln", "Lane")), ("208", ("N", "North"), "Orchard", ("Ct", "Court"))]
    )
    for way in direction
    for end in ("", *suffix)
    for tail in ("", ", Chicago", " , chicago, il")
    for typed in (f"{number} {way} {name} {end}".strip() + tail, f" {number}  {way} {name} {end}".upper() + tail)
}


def reference(spark):
    return spark.createDataFrame(
        [
            (KNOWN[0], -87.585, 41.798, URBAN_AREA),
            (KNOWN[1], -87.59, 41.82, URBAN_AREA),
            ("1 MAIN ST, GARY, IN, 46402", -87.3, 41.6, "Elsewhere"),
        ],
        "matched_address string, lon double, lat double, urban_area string",
    )


def test_spellings_match(spark):
    requests = spark.createDataFrame(list(enumerate(SPELLINGS)), "request_id int, address string")
    for rows_per_task in (100, 1):
        matched = intake.match_addresses(requests, reference(spark), rows_per_task)
        got = {r["address"]: r["matched_address"] for r in matched.collect()}
        assert got == {typed: KNOWN[i] for typed, i in SPELLINGS.items()}


def test_intake(spark):
    requests = spark.createDataFrame(
        [(1, "208 N Orchard"), (2, "31 W Quarry Ln"), (3, "1 Main St"), (4, "nowhere"), (5, ""), (6, None), (7, "208 N Orchard Ct")],
        "request_id int, address string",
    )
    properties = spark.createDataFrame([(41, KNOWN[0]), (40, KNOWN[0])], "property_id int, address string")
    rows = {r["request_id"]: r for r in intake.property_intake(requests, reference(spark), properties).collect()}
    assert rows[2]["property_id"] == 40 and rows[2]["inside_box"] and rows[2]["notes"] == intake.INSIDE
    assert rows[1]["property_id"] == rows[7]["property_id"] == 42
    assert rows[1]["inside_box"] is False and rows[1]["notes"] == intake.OUTSIDE
    assert [rows[i]["error"] for i in (3, 4, 5, 6)] == [
        intake.OTHER_AREA, intake.NO_MATCH, intake.NO_ADDRESS, intake.NO_ADDRESS,
    ]


def test_summary_ingest(spark):
    responses = spark.createDataFrame(
        [
            (1, "a", "nonsense"),
            (2, "a", '```json\n{"summary": "A", "summarized_issues": [{"date": "d", "issues": []}]}\n```'),
            (3, "b", "sorry"),
            (4, "c", '{"summary": "cut'),
            (5, "d", '{"summary": "D"}'),
            (6, "e", None),
            (7, "f", "[1]"),
        ],
        "response_id int, address string, response string",
    )
    existing = spark.createDataFrame(
        [("d", ("old", None)), ("z", ("kept", None))], f"address string, summary {summaries.SUMMARY}"
    )
    table, dead = summaries.summary_ingest(responses, existing)
    assert {r["address"]: r["summary"]["summary"] for r in table.collect()} == {"a": "A", "d": "D", "z": "kept"}
    assert sorted(r["address"] for r in dead.collect()) == ["b", "c", "e", "f"]
