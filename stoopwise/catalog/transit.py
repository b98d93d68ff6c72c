"""Transit queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoopwise import schemas
from stoopwise.catalog.expressions import LISTS
from stoopwise.catalog.registry import Given, query
from stoopwise.catalog.views import _shuttle
from stoopwise.catalog.walk import kept_sql
from stoopwise.operators import quality
from stoopwise.params import EXCLUDED_ROUTES, SHUTTLES_KEPT, TRANSIT_TYPES
from stoopwise.plans import transit, walk

QUOTED = ", ".join(f"'{r}'" for r in EXCLUDED_ROUTES)
KEPT = ", ".join(f"'{r}'" for r in SHUTTLES_KEPT)

# Rows of the stop file: one per stop and route; the smallest parts run on a rail line
# and one brand has no usable latitude.
STOP_ROWS = """SELECT CAST(s.stop_id AS STRING) AS stop_id,
  CASE WHEN p_size = 5 THEN 'Blue' ELSE route_id END AS route_id, stop_name,
  CASE WHEN p_brand = 'Brand#3' THEN 'north' ELSE CAST(lat AS STRING) END AS latitude,
  CAST(lon AS STRING) AS longitude
FROM {v_stops} s JOIN {v_route_stops} r ON s.stop_id = r.stop_id
JOIN {part} ON p_partkey = s.stop_id"""

SHUTTLE_POINTS = f"""SELECT CAST(s_suppkey AS STRING) AS stop_id, s_name AS stop_name,
  {_shuttle("s_suppkey")} AS route_name, s_acctbal AS x, CAST(s_nationkey AS DOUBLE) AS y
FROM {{supplier}}"""

ROUTE_ROWS = """SELECT 'R' || CAST(s_suppkey AS STRING) AS route_id, s_name AS route_name,
  CASE WHEN s_nationkey = 1 THEN 'POINT (1 2)' WHEN s_nationkey < 12
    THEN 'LINESTRING (' || CAST(s_suppkey AS STRING) || ' 1, 2 ' || CAST(s_nationkey AS STRING) || ')'
    ELSE 'MULTILINESTRING ((1 2, 3 ' || CAST(s_suppkey AS STRING) || '), (5 6, 7 8))' END AS geometry
FROM {supplier}"""

# Points of shuttle lines: up to three lines per route.
LINE_POINTS = f"""SELECT {_shuttle("p_partkey")} AS route,
  CAST(floor(p_partkey / 11) AS BIGINT) % 3 AS line_no,
  CAST(floor(p_partkey / 33) AS BIGINT) AS seq, CAST(p_size AS DOUBLE) AS lon, p_retailprice AS lat
FROM {{part}}"""

SHUTTLE_ROWS = f"""SELECT CAST(CAST(stop_id AS BIGINT) * 1000 AS STRING) AS stop_id,
  CASE WHEN route_name = 'Downtown Campus Connector' THEN 'Downtown Connector' ELSE route_name END
    AS route_id, stop_name, y AS latitude, x AS longitude, 'shuttle' AS type
FROM ({SHUTTLE_POINTS}) p WHERE CASE WHEN route_name = 'Downtown Campus Connector'
  THEN 'Downtown Connector' ELSE route_name END IN ({KEPT})"""

CTA_ROWS = f"""SELECT *, 'cta' AS type FROM ({STOP_ROWS}) r 
  WHERE route_id IS NULL OR route_id NOT IN ({QUOTED})"""

BUILD = f"""cta AS ({CTA_ROWS}), shuttle AS ({SHUTTLE_ROWS}),
stop_rows AS (SELECT stop_id, route_id, stop_name, TRY_CAST(latitude AS DOUBLE) AS lat,
    TRY_CAST(longitude AS DOUBLE) AS lon, type FROM cta
  UNION ALL SELECT stop_id, route_id, stop_name, latitude, longitude, type FROM shuttle),
stops AS (SELECT * EXCLUDE (nth) FROM (SELECT stop_id, stop_name, type, lon, lat,
    row_number() OVER (PARTITION BY stop_id ORDER BY stop_name, type, lon, lat) AS nth
  FROM stop_rows WHERE lat IS NOT NULL AND lon IS NOT NULL) s WHERE nth = 1),
all_routes AS (SELECT route_id, route_name AS name, 'cta' AS type,
    CASE WHEN starts_with(geometry, 'LINE') THEN 1 WHEN starts_with(geometry, 'MULTI') THEN 2 END
      AS n_lines FROM ({ROUTE_ROWS}) r
  UNION ALL SELECT route, upper(route), 'shuttle', count(DISTINCT line_no) FROM ({LINE_POINTS}) p
    GROUP BY route),
pairs AS (SELECT DISTINCT route_id, stop_id FROM stop_rows),
known AS (SELECT DISTINCT route_id FROM all_routes WHERE n_lines IS NOT NULL)"""


def feed_rows(t: Given) -> tuple[DataFrame, DataFrame]:
    """Stop rows and route rows of both feeds."""
    stops = transit.cta_stops(t.sql(STOP_ROWS)).unionByName(
        transit.shuttle_stops(t.sql(SHUTTLE_POINTS)).withColumns(
            {"latitude": F.col("latitude").cast("string"), "longitude": F.col("longitude").cast("string")}
        )
    )
    routes = transit.cta_routes(t.sql(ROUTE_ROWS)).unionByName(
        transit.shuttle_routes(t.sql(LINE_POINTS))
    )
    return stops, routes


def build(t: Given) -> transit.Transit:
    return transit.transit_build(*feed_rows(t))


@query("P9 P17 S2", sql=CTA_ROWS)
def cta_stop_rows(t: Given) -> DataFrame:
    return transit.cta_stops(t.sql(STOP_ROWS))


@query("P9 P17 X17", sql=SHUTTLE_ROWS)
def shuttle_stop_rows(t: Given) -> DataFrame:
    return transit.shuttle_stops(t.sql(SHUTTLE_POINTS))


@query(
    "P10",
    sql=f"""SELECT * FROM (SELECT stop_id, CASE WHEN y = 0 THEN NULL ELSE route_name END AS route_name
  FROM ({SHUTTLE_POINTS}) p) q WHERE route_name IS NULL OR NOT contains(route_name, 'CTA')""",
)
def shuttles_without_cta(t: Given) -> DataFrame:
    named = t.sql(SHUTTLE_POINTS).select(
        "stop_id", F.when(F.col("y") != 0, F.col("route_name")).alias("route_name")
    )
    return transit.without_name(named, "route_name", "CTA")


@query("Q10 U1 U2 P18", sql=f"WITH {BUILD} SELECT * FROM stops")
def transit_stops(t: Given) -> DataFrame:
    return build(t).stops


@query(
    "Q10 U1 U2 A13 X18",
    sql=f"WITH {BUILD} SELECT route_id, name, type, n_lines FROM all_routes WHERE n_lines IS NOT NULL",
)
def transit_routes(t: Given) -> DataFrame:
    return build(t).routes.select(
        "route_id",
        "name",
        "type",
        F.size("geometry").cast("long").alias("n_lines"),
    )


@query(
    "Q10 J3 U2",
    sql=f"""WITH {BUILD} SELECT route_id, stop_id FROM pairs
WHERE route_id IN (SELECT route_id FROM known) AND stop_id IN (SELECT stop_id FROM stops)""",
)
def transit_route_stops(t: Given) -> DataFrame:
    return build(t).route_stops.select("route_id", "stop_id")


@query(
    "Q10 J4 S13",
    sql=f"""WITH {BUILD} SELECT route_id, stop_id, 'unknown route' AS reason FROM pairs
WHERE (route_id IS NULL OR route_id NOT IN (SELECT route_id FROM known))
UNION ALL SELECT route_id, stop_id, 'unknown stop' FROM pairs
WHERE route_id IN (SELECT route_id FROM known) AND stop_id NOT IN (SELECT stop_id FROM stops)
UNION ALL SELECT NULL, stop_id, 'no valid point' FROM stop_rows WHERE lat IS NULL OR lon IS NULL
UNION ALL SELECT route_id, NULL, 'no line geometry' FROM all_routes WHERE n_lines IS NULL""",
)
def transit_rejects(t: Given) -> DataFrame:
    return build(t).rejects


@query(
    "J4",
    sql=f"""WITH {BUILD} SELECT route_id, stop_id, CASE WHEN (route_id IS NULL OR route_id NOT IN (SELECT route_id FROM known))
  THEN 'route' ELSE 'stop' END AS unknown FROM pairs
WHERE (route_id IS NULL OR route_id NOT IN (SELECT route_id FROM known)) OR stop_id NOT IN (SELECT stop_id FROM stops)""",
)
def pair_problems(t: Given) -> DataFrame:
    rows, _ = feed_rows(t)
    built = build(t)
    return transit.pair_problems(rows, built.routes, built.stops)


@query(
    "D2 stops and routes",
    sql=f"""WITH {BUILD}, bad AS (
  SELECT 'stop type known' AS rule, count(*) FILTER (WHERE type NOT IN ('cta', 'metra', 'shuttle',
    'divvy', 'other')) AS bad_rows FROM stops
  UNION ALL SELECT 'route id fits', count(*) FILTER (WHERE length(route_id) > 20) FROM all_routes
    WHERE n_lines IS NOT NULL
  UNION ALL SELECT 'route name fits', count(*) FILTER (WHERE length(name) > 255) FROM all_routes
    WHERE n_lines IS NOT NULL)
SELECT * FROM bad""",
)
def transit_rules(t: Given) -> DataFrame:
    built = build(t)
    stops = quality.broken_rules(built.stops, {"stop type known": quality.allowed("type", TRANSIT_TYPES)})
    fits = {
        "route id fits": quality.fits("route_id", schemas.ROUTE_LENGTHS["route_id"]),
        "route name fits": quality.fits("name", schemas.ROUTE_LENGTHS["name"]),
    }
    return stops.unionByName(quality.broken_rules(built.routes, fits))


@query(
    "A13",
    sql=f"""WITH points AS ({LINE_POINTS}),
lines AS (SELECT route, line_no, '(' || string_agg(printf('%.1f %.1f', lon, lat), ', '
    ORDER BY seq, lon, lat) || ')' AS line FROM points GROUP BY route, line_no)
SELECT route AS route_id, upper(route) AS name, 'shuttle' AS type,
  'MULTILINESTRING (' || string_agg(line, ', ' ORDER BY line_no) || ')' AS wkt
FROM lines GROUP BY route""",
)
def shuttle_lines(t: Given) -> DataFrame:
    # One decimal is exact here, and prints alike everywhere.
    one = F.transform(
        "geometry",
        lambda line: F.concat(
            F.lit("("),
            F.array_join(
                F.transform(line, lambda p: F.format_string("%.1f %.1f", p["lon"], p["lat"])), ", "
            ),
            F.lit(")"),
        ),
    )
    wkt = F.concat(F.lit("MULTILINESTRING ("), F.array_join(one, ", "), F.lit(")"))
    return transit.shuttle_routes(t.sql(LINE_POINTS)).select(
        "route_id", "name", "type", wkt.alias("wkt")
    )


ASKED = f"""requests AS ({LISTS}),
tokens AS (SELECT request_id, unnest(list_transform(string_split(routes, ','), lambda s: trim(s)))
    AS route_id, generate_subscripts(string_split(routes, ','), 1) - 1 AS place,
    len(string_split(routes, ',')) AS n FROM requests WHERE trim(routes) <> ''),
colored AS (SELECT request_id, route_id, 'hsl(' || CAST(CAST(floor(360 * max(place) / max(n)) AS INT)
    AS STRING) || ', 100%, 45%)' AS color FROM tokens GROUP BY request_id, route_id),
found AS (SELECT request_id, c.route_id, name, type, color FROM colored c
  JOIN {{v_routes}} r ON c.route_id = r.route_id)"""


@query("X16 W9", sql=f"WITH {ASKED} SELECT * FROM colored")
def requested_routes(t: Given) -> DataFrame:
    return transit.requested_routes(t.sql(LISTS))


@query("Q12 X16 P14 W9", sql=f"WITH {ASKED} SELECT * FROM found")
def route_map(t: Given) -> DataFrame:
    return transit.route_map(t.sql(LISTS), t.v_routes).select(
        "request_id", "route_id", "name", "type", "color"
    )


DRAWN = f"""WITH {ASKED}, rows AS ({ROUTE_ROWS}),
lines AS (SELECT DISTINCT route_id, route_name AS name, CASE WHEN starts_with(geometry, 'LINE')
    THEN replace(geometry, 'LINESTRING ', '') WHEN starts_with(geometry, 'MULTI')
    THEN regexp_replace(geometry, '^MULTILINESTRING [(](.*)[)]$', '\\1') END AS lines
  FROM rows WHERE geometry NOT LIKE 'POINT%'),
drawn AS (SELECT request_id, c.route_id, 'MultiLineString|' || lines || '|' || l.name || '|cta|' || color
    AS feature FROM colored c JOIN lines l ON c.route_id = l.route_id)"""


def _drawn_text(feature: F.Column) -> F.Column:
    """A route feature as text: every coordinate, and its properties."""
    line = F.transform(
        feature["geometry"]["coordinates"],
        lambda points: F.concat(
            F.lit("("),
            F.array_join(F.transform(points, lambda p: F.format_string("%.0f %.0f", p[0], p[1])), ", "),
            F.lit(")"),
        ),
    )
    shown = [feature["properties"][name] for name in ("name", "type", "color")]
    return F.concat_ws("|", feature["geometry"]["type"], F.array_join(line, ", "), *shown)


@query("Q12 S14 route feature", sql=f"{DRAWN} SELECT * FROM drawn")
def route_features(t: Given) -> DataFrame:
    routes = transit.cta_routes(t.sql(ROUTE_ROWS)).where("geometry IS NOT NULL")
    drawn = transit.route_features(transit.route_map(t.sql(LISTS), routes))
    return drawn.select("request_id", "route_id", _drawn_text(F.col("feature")).alias("feature"))


@query(
    "Q12 S14 route answer per request",
    sql=f"""{DRAWN} SELECT request_id, 'FeatureCollection' AS kind,
  string_agg(feature, '; ' ORDER BY route_id) AS features FROM drawn GROUP BY request_id""",
)
def route_answers(t: Given) -> DataFrame:
    routes = transit.cta_routes(t.sql(ROUTE_ROWS)).where("geometry IS NOT NULL")
    answers = transit.route_collections(transit.route_map(t.sql(LISTS), routes))
    texts = F.transform("response.features", _drawn_text)
    return answers.select(
        "request_id", F.col("response.type").alias("kind"), F.array_join(texts, "; ").alias("features")
    )


@query(
    "Q12 errors",
    sql=f"""WITH {ASKED} SELECT request_id, CASE WHEN trim(routes) = '' THEN 'No valid input'
  ELSE 'This route is not available in our database' END AS error
FROM requests WHERE request_id NOT IN (SELECT request_id FROM found)""",
)
def route_request_errors(t: Given) -> DataFrame:
    requests = t.sql(LISTS)
    return transit.request_errors(requests, transit.route_map(requests, t.v_routes))


@query(
    "J10 P14",
    sql=f"""WITH {kept_sql(5)}
SELECT DISTINCT k.property_id, r.route_id, r.name FROM kept k
JOIN {{v_route_stops}} s ON k.stop_id = s.stop_id JOIN {{v_routes}} r ON s.route_id = r.route_id""",
)
def routes_near(t: Given) -> DataFrame:
    near = walk.walk_stops(t.v_properties, t.v_stops, t.v_route_stops, minutes=5)
    return transit.routes_of_stops(near, t.v_routes).select("property_id", "route_id", "name")
