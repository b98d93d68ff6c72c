import datetime

import pytest
from pyspark.sql import functions as F

from stoopwise.functions import geo, text


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[1] for r in df.select("i", column(F.col("x"))).orderBy("i").collect()]


def test_address_head_is_what_stands_before_the_first_comma(spark):
    cases = {
        "12 w Lake View Ter": "12 W LAKE VIEW TER",
        "\t12 w lake view ter\u00a0": None,
        "12 W Lake View Ter ,Unit 3, Rear": "12 W LAKE VIEW TER",
        ", Springfield": "",
        "": "",
        None: None,
    }
    heads = values(spark, text.address_head, list(cases))
    assert [h for h, want in zip(heads, cases.values()) if want is not None or h is None] == [
        w for k, w in cases.items() if w is not None or k is None
    ]


@pytest.mark.parametrize("word, short", sorted(text.STREET_WORDS.items()))
def test_every_street_word_is_shortened(spark, word, short):
    typed = [f"31 {word.title()} Quarry", f"31  {short.lower()} QUARRY, Upstairs", f"31 {word}S Quarry"]
    assert values(spark, text.normal_address, typed) == [
        f"31 {short} QUARRY", f"31 {short} QUARRY", f"31 {word}S QUARRY",
    ]


@pytest.mark.parametrize("suffix", text.STREET_SUFFIXES)
def test_a_suffix_goes_only_at_the_end(spark, suffix):
    typed = [f"31 N QUARRY {suffix}", f"31 {suffix} QUARRY", f"31 QUARRY{suffix}"]
    assert values(spark, text.without_suffix, typed) == ["31 N QUARRY", f"31 {suffix} QUARRY", f"31 QUARRY{suffix}"]


def test_strip_citation(spark):
    cases = {
        "Paint the railing. (11-4-20)": "Paint the railing.",
        "Mend gutters   (9-1-2(c), 9-1-7)  ": "Mend gutters",
        "Fit a lamp (at least 60 watts) on each floor.": "Fit a lamp (at least 60 watts) on each floor.",
        "(11-4-20) Sweep the yard": "(11-4-20) Sweep the yard",
        "Close (a) both (b) doors (1-2 (c) (d": "Close (a) both (b) doors (1-2 (c)",
        "Close the gate (1-2 (c) ": "Close the gate",
        "Keep (a (b (c)))": "Keep (a (b (c)))",
        "": "",
        None: "",
    }
    assert values(spark, text.strip_citation, list(cases)) == list(cases.values())


def test_strip_citation_of_very_long_texts(spark):
    long = ["Intro (" + "(b) " * 250_000, "a" * 1_000_000, "(" * 500_000, " " * 1_000_000 + "x"]
    assert [len(v) for v in values(spark, text.strip_citation, long)] == [5, 1_000_000, 499_999, 1_000_001]


def test_unfence_json(spark):
    two = '```json\n[1]\n```\nand\n```json\n[2]\n```'
    cases = [
        (two, "[1]"),
        ('Here you are:\n```json\n{"rooms": {"kitchen": ["damp", "cold"]}}\n```\nBye', '{"rooms": {"kitchen": ["damp", "cold"]}}'),
        ("\n\t[true]\u2003", None),
        ("```\nno name\n```", "```\nno name\n```"),
        ("", ""),
    ]
    got = values(spark, text.unfence_json, [c[0] for c in cases])
    assert [g for g, c in zip(got, cases) if c[1] is not None] == [c[1] for c in cases if c[1] is not None]
    assert got[2].startswith("[true]")


def test_comma_list(spark):
    got = values(spark, text.comma_list, ["N5", "a b ,c", ",", "\t", "", "x,,y ", None])
    assert got == [["N5"], ["a b", "c"], ["", ""], [], [], ["x", "", "y"], None]


def test_title_cases(spark):
    assert values(spark, text.py_title_case, ["1001 E 55TH ST, o'HARE"]) == ["1001 E 55Th St, O'Hare"]
    assert values(spark, text.js_title_case, ["1001 E 55TH ST-WEST"]) == ["1001 E 55th St-West"]
    assert values(spark, text.proper_address, ["5 S ELM, CHICAGO, IL, 60615"]) == [
        "5 S Elm, Chicago, IL, 60615"
    ]


def test_title_and_subtitle_split_at_the_first_comma(spark):
    assert values(spark, text.address_title, ["5 S ELM, CHICAGO, IL", "5 ELM"]) == ["5 S Elm", "5 Elm"]
    assert values(spark, text.address_subtitle, ["5 S ELM, CHICAGO, IL", "5 ELM"]) == [" Chicago, Il", None]


def test_parse_date(spark):
    day = datetime.date(2025, 1, 2)
    assert values(spark, text.parse_date, ["1/2/2025", "01/02/2025", " ", "", None]) == [day, day, None, None, None]
    tolerant = values(spark, lambda c: text.parse_date(c, strict=False), ["31/31/2025", "1/2/2025"])
    assert tolerant == [None, day]
    with pytest.raises(Exception, match="CANNOT_PARSE|DateTime"):
        values(spark, text.parse_date, ["31/31/2025"])


def test_geocode(spark):
    got = values(spark, geo.geocode, ["41.5, -87.25", "41.5", "a,b", "1,2,3", "", None])
    assert got[0] == (41.5, -87.25)
    assert got[1:] == [None] * 5


def test_minutes_round_half_to_even(spark):
    assert values(spark, geo.stop_minutes, [175.0, 105.0, 0.0], "double") == [2, 2, 0]
    assert values(spark, geo.grocery_minutes, [70.0, 77.0], "double") == [1.0, 1.1]


def test_wkt(spark):
    lines = values(
        spark,
        geo.lines_from_wkt,
        ["LINESTRING (1 2, 3 4)", "MULTILINESTRING ((1 2, 3 4), (5 6, 7 8))", "POINT (1 2)", None],
    )
    assert [[tuple(p) for p in line] for line in lines[0]] == [[(1.0, 2.0), (3.0, 4.0)]]
    assert len(lines[1]) == 2 and lines[2] is None and lines[3] is None


def test_points_need_two_numbers(spark):
    df = spark.createDataFrame([("41.5", "-87"), ("n/a", "1"), (None, "1")], "lat string, lon string")
    got = [r[0] for r in df.select(geo.point_of(F.col("lat"), F.col("lon"))).collect()]
    assert got == [(-87.0, 41.5), None, None]
