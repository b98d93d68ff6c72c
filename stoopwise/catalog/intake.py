"""Intake, request and summary queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoopwise.catalog.registry import Given, query
from stoopwise.catalog.views import _street
from stoopwise.catalog.walk import METRES
from stoopwise.operators import merge
from stoopwise.operators.numbering import first_per_key
from stoopwise.params import NEIGHBOURHOOD, URBAN_AREA
from stoopwise.plans import intake, summaries, walk

_HOME = "CAST(floor(event_id / 4) AS BIGINT)"

# What people type: long forms, lower case, no suffix, blanks; some of it matches nothing.
SEARCHES = f"""SELECT event_id AS request_id, CASE event_type
    WHEN 'view' THEN replace(replace({_street(_HOME)}, ' S ', ' South '), ' AVE', ' Avenue')
      || ', Chicago'
    WHEN 'click' THEN lower({_street(_HOME)})
    WHEN 'signup' THEN replace({_street(_HOME)}, ' AVE', '')
    WHEN 'purchase' THEN '  ' || {_street(_HOME)} || ' , Chicago, IL, 60637'
    ELSE CASE WHEN value < 20 THEN '' ELSE NULL END END AS address
FROM {{events}}"""

REFERENCE = f"""SELECT address AS matched_address, lon, lat,
  CASE WHEN lat > 41.815 THEN 'Elsewhere' ELSE '{URBAN_AREA}' END AS urban_area
FROM {{v_properties}}"""

# Some properties have a number but are not stored yet.
EXISTING = """SELECT property_id, address, lon, lat, c_mktsegment <> 'BUILDING' AS stored
FROM {v_properties} JOIN {customer} ON property_id = c_custkey"""

NORMAL = """regexp_replace(regexp_replace(regexp_replace(
  trim(split_part(upper({0}), ',', 1)), '\\s+', ' ', 'g'), '\\bSOUTH\\b', 'S', 'g'),
  '\\bAVENUE\\b', 'AVE', 'g')"""

MATCHED = f"""searches AS ({SEARCHES}), reference AS ({REFERENCE}),
forms AS (SELECT *, {NORMAL.format("matched_address")} AS form FROM reference),
keyed AS (SELECT 0 AS rank, form AS key, * FROM forms
  UNION ALL SELECT 1, regexp_replace(form, ' AVE$', ''), * FROM forms WHERE form LIKE '% AVE'),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key
  ORDER BY rank, matched_address, lon, lat, urban_area) AS nth FROM keyed) k WHERE nth = 1),
matched AS (SELECT request_id, address, matched_address, lon, lat,
  CASE WHEN coalesce(address, '') = '' THEN 'Address is required.'
    WHEN matched_address IS NULL THEN 'No matched address found in Chicago.'
    WHEN urban_area <> '{URBAN_AREA}'
      THEN 'Address is not inside Chicago, the area defined for the project.' END AS error
  FROM searches LEFT JOIN chosen ON {NORMAL.format("address")} = key),
existing AS ({EXISTING}),
wanted AS (SELECT matched_address AS address, lon, lat FROM (SELECT *, row_number() OVER (
    PARTITION BY matched_address ORDER BY lon, lat) AS nth FROM matched WHERE error IS NULL) m
  WHERE nth = 1),
created AS (SELECT (SELECT max(property_id) FROM existing) + row_number() OVER (ORDER BY address)
    AS property_id, address, lon, lat
  FROM wanted WHERE address NOT IN (SELECT address FROM existing WHERE stored))"""


@query("J9 X9", sql=f"WITH {MATCHED} SELECT * FROM matched")
def address_matches(t: Given) -> DataFrame:
    return intake.match_addresses(t.sql(SEARCHES), t.sql(REFERENCE))


@query("U7", sql=f"WITH {MATCHED} SELECT * FROM created")
def new_properties(t: Given) -> DataFrame:
    matched = intake.match_addresses(t.sql(SEARCHES), t.sql(REFERENCE))
    return intake.new_properties(matched, t.sql(EXISTING))


INSIDE = (
    f"lat BETWEEN {NEIGHBOURHOOD.south} AND {NEIGHBOURHOOD.north} "
    f"AND lon BETWEEN {NEIGHBOURHOOD.west} AND {NEIGHBOURHOOD.east}"
)


@query(
    "Q13 J9 P4 U7",
    sql=f"""WITH {MATCHED},
ids AS (SELECT address, min(property_id) AS property_id FROM existing WHERE stored GROUP BY address
  UNION ALL SELECT address, property_id FROM created)
SELECT request_id, CASE WHEN error IS NULL THEN matched_address END AS cleaned_address,
  CASE WHEN error IS NULL THEN property_id END AS property_id,
  CASE WHEN error IS NULL THEN {INSIDE} END AS inside_box,
  CASE WHEN error IS NOT NULL THEN NULL WHEN {INSIDE} THEN '{intake.INSIDE}'
    ELSE '{intake.OUTSIDE}' END AS notes,
  CASE WHEN error IS NULL THEN lon END AS lon, CASE WHEN error IS NULL THEN lat END AS lat,
  m.address AS label, error
FROM matched m LEFT JOIN ids ON matched_address = ids.address""",
)
def property_intake(t: Given) -> DataFrame:
    return intake.property_intake(t.sql(SEARCHES), t.sql(REFERENCE), t.sql(EXISTING))


# One request per customer; some lack a field, some have a broken geocode or no property.
REQUESTS = """SELECT c_custkey AS request_id,
  CASE WHEN c_nationkey = 1 THEN NULL WHEN c_nationkey = 2 THEN c_custkey + 1000000000000
    ELSE c_custkey END AS property_id,
  CASE WHEN c_nationkey = 3 THEN '' WHEN c_nationkey = 4 THEN 'here' WHEN c_nationkey = 5
    THEN CAST(lat AS STRING) ELSE CAST(lat AS STRING) || ', ' || CAST(lon AS STRING) END AS geocode,
  CASE WHEN c_nationkey = 6 THEN 0 WHEN c_nationkey = 7 THEN -5 WHEN c_nationkey = 8 THEN NULL
    ELSE c_nationkey - 8 END AS walking_time
FROM {customer} JOIN {v_properties} ON property_id = c_custkey"""

CHECKED = f"""requests AS ({REQUESTS}),
checked AS (SELECT *, CASE WHEN property_id IS NULL THEN 'property_id is required'
    WHEN geocode = '' THEN 'geocode is required'
    WHEN coalesce(walking_time, 0) = 0 THEN 'walking_time is required'
    WHEN walking_time < 0 THEN 'walking_time must be greater than 0'
    WHEN lat IS NULL OR lon IS NULL THEN 'Failure in parsing request' END AS error
  FROM (SELECT *, TRY_CAST(split_part(geocode, ',', 1) AS DOUBLE) AS lat,
    TRY_CAST(trim(split_part(geocode, ',', 2)) AS DOUBLE) AS lon FROM requests) r)"""


@query(
    "P20 X5 Q1 per request",
    sql=f"""WITH {CHECKED},
near AS (SELECT * FROM (SELECT request_id, walking_time, stop_id, {METRES} AS m
    FROM (SELECT * FROM checked WHERE error IS NULL) a JOIN {{v_stops}} b
      ON b.lat BETWEEN a.lat - 0.1 AND a.lat + 0.1 AND b.lon BETWEEN a.lon - 0.2 AND a.lon + 0.2) d
  WHERE m <= walking_time * 70),
firsts AS (SELECT request_id, n.stop_id, m, row_number() OVER (PARTITION BY request_id, route_id
    ORDER BY m, n.stop_id) AS nth FROM near n JOIN {{v_route_stops}} r ON n.stop_id = r.stop_id
  WHERE route_id IS NOT NULL),
kept AS (SELECT DISTINCT request_id, stop_id, CAST(round_even(m / 70, 0) AS INT) AS distance_min
  FROM firsts WHERE nth = 1),
answers AS (SELECT c.request_id, c.property_id, walking_time, stop_id, distance_min,
    CASE WHEN error IS NOT NULL THEN error
      WHEN stop_id IS NULL THEN 'No bus stops found within the walking distance'
      WHEN p.property_id IS NULL THEN 'Invalid property_id' END AS error
  FROM checked c LEFT JOIN kept k ON c.request_id = k.request_id
  LEFT JOIN {{v_properties}} p ON c.property_id = p.property_id)
SELECT DISTINCT request_id, property_id, walking_time,
  CASE WHEN error IS NULL THEN stop_id END AS stop_id,
  CASE WHEN error IS NULL THEN distance_min END AS distance_min, error FROM answers""",
)
def requested_stops(t: Given) -> DataFrame:
    return walk.requested_stops(t.sql(REQUESTS), t.v_properties, t.v_stops, t.v_route_stops)


@query(
    "P20 grocery requests",
    sql=f"""WITH {CHECKED} SELECT request_id, CASE WHEN error LIKE 'walking_time%'
  THEN CASE WHEN lat IS NULL OR lon IS NULL THEN 'Failure in parsing request' END
  ELSE error END AS error FROM checked""",
)
def grocery_request_errors(t: Given) -> DataFrame:
    return walk.check_requests(t.sql(REQUESTS), zero_minutes_allowed=True).select(
        "request_id", "error"
    )


# Answers of a text service: fenced, plain, refused and cut off.
RESPONSES = f"""SELECT c_custkey AS response_id, {_street("c_custkey")} AS address,
  CASE c_mktsegment
    WHEN 'BUILDING' THEN 'Here: ```json' || chr(10) || '{{{{"summary": "Heat ' || c_name
      || '", "summarized_issues": [{{{{"date": "Jan 04, 2025", "issues": [{{{{"emoji": "x", "description": "cold"}}}}]}}}}]}}}}'
      || chr(10) || '```'
    WHEN 'MACHINERY' THEN '{{{{"summary": "Plain ' || c_name || '"}}}}'
    WHEN 'FURNITURE' THEN 'I cannot answer that.'
    ELSE '{{{{"summary": "Cut off' END AS response
FROM {{customer}}"""

LATEST = f"""WITH responses AS ({RESPONSES}),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY address
  ORDER BY response_id DESC) AS nth FROM responses) r WHERE nth = 1),
parsed AS (SELECT address, response, CASE
    WHEN starts_with(response, 'Here') THEN regexp_extract(response, '"summary": "([^"]*)"', 1)
    WHEN response LIKE '%Plain%' THEN regexp_extract(response, '"summary": "([^"]*)"', 1) END AS summary,
  CASE WHEN starts_with(response, 'Here') THEN 1 END AS n_issues FROM latest)"""


def _existing(t: Given) -> DataFrame:
    """Stored summaries, one per address."""
    first = first_per_key(summaries.stored(t.v_summaries), ["address"], [F.col("id")])
    empty = F.lit(None).cast(summaries.ISSUES)
    return first.select(
        "address", F.struct("summary", empty.alias("summarized_issues")).alias("summary")
    )


@query(
    "Q15 X13 X14 U6",
    sql=f"""{LATEST},
existing AS (SELECT address, arg_min(summary, id) AS summary FROM {{v_summaries}}
  WHERE summary IS NOT NULL GROUP BY address)
SELECT address, summary, n_issues FROM parsed WHERE summary IS NOT NULL
UNION ALL SELECT address, summary, NULL FROM existing
WHERE address NOT IN (SELECT address FROM parsed WHERE summary IS NOT NULL)""",
)
def summary_ingest(t: Given) -> DataFrame:
    table, _ = summaries.summary_ingest(t.sql(RESPONSES), _existing(t))
    issues = F.col("summary.summarized_issues")
    return table.select(
        "address",
        F.col("summary.summary").alias("summary"),
        F.when(issues.isNotNull(), F.size(issues)).alias("n_issues"),
    )


@query(
    "Q15 X14 S13",
    sql=f"{LATEST} SELECT address, 'response is no JSON object' AS error FROM parsed WHERE summary IS NULL",
)
def summary_dead_letters(t: Given) -> DataFrame:
    return summaries.summary_ingest(t.sql(RESPONSES), _existing(t))[1]


@query(
    "U6",
    sql="""SELECT coalesce(b.address, a.address) AS address, coalesce(b.summary, a.summary) AS summary
FROM (SELECT address, arg_min(summary, id) AS summary FROM {v_summaries}
  WHERE summary IS NOT NULL GROUP BY address) a
FULL OUTER JOIN (SELECT address, 'seen ' || CAST(count(*) AS STRING) AS summary
  FROM {v_violations} GROUP BY address) b ON a.address = b.address""",
)
def summaries_upserted(t: Given) -> DataFrame:
    existing = first_per_key(summaries.stored(t.v_summaries), ["address"], [F.col("id")]).select(
        "address", "summary"
    )
    incoming = t.v_violations.groupBy("address").agg(
        F.concat(F.lit("seen "), F.count("*").cast("string")).alias("summary")
    )
    return merge.upsert_latest(existing, incoming, ["address"])
