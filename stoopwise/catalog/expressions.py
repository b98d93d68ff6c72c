"""Column expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoopwise.catalog.registry import Given, query
from stoopwise.catalog.walk import METRES
from stoopwise.functions import geo, text
from stoopwise.operators.filters import one_of
from stoopwise.params import TRIVIAL_CODES


@query(
    "X6 X7",
    sql="""SELECT property_id, trim(split_part(upper(address), ',', 1)) AS head,
  array_to_string(list_transform(regexp_extract_all(split_part(address, ',', 1), '[^-\\s]+|[-\\s]+'),
    lambda s: upper(s[1]) || lower(s[2:])), '') AS title,
  array_to_string(list_transform(regexp_extract_all(
    regexp_replace(address, '^[^,]*,', ''), '[^-\\s]+|[-\\s]+'),
    lambda s: upper(s[1]) || lower(s[2:])), '') AS subtitle
FROM {v_properties}""",
)
def address_parts(t: Given) -> DataFrame:
    address = F.col("address")
    return t.v_properties.select(
        "property_id",
        text.address_head(address).alias("head"),
        text.address_title(address).alias("title"),
        text.address_subtitle(address).alias("subtitle"),
    )


@query(
    "X8",
    sql="""SELECT doc_id, array_to_string(list_transform(
    regexp_extract_all(text, '\\pL+|\\PL+'),
    lambda s: CASE s[1] WHEN 'ß' THEN 'Ss' ELSE upper(s[1]) END || lower(s[2:])), '') AS title
FROM {documents}""",
)
def title_case(t: Given) -> DataFrame:
    return t.documents.select("doc_id", text.py_title_case(F.col("text")).alias("title"))


@query(
    "X8",
    sql="""SELECT property_id, regexp_replace(array_to_string(list_transform(
    regexp_extract_all(address, '[A-Za-z]+|[^A-Za-z]+'), lambda s: upper(s[1]) || lower(s[2:])), ''),
  '\\bIl\\b', 'IL', 'g') AS proper_address
FROM {v_properties}""",
)
def proper_addresses(t: Given) -> DataFrame:
    return t.v_properties.select(
        "property_id", text.proper_address(F.col("address")).alias("proper_address")
    )


# Typed spellings of the known addresses.
TYPED = """SELECT property_id, CASE property_id % 4
    WHEN 0 THEN replace(replace(address, ' S ', ' South '), ' AVE', ' Avenue')
    WHEN 1 THEN lower(address)
    WHEN 2 THEN replace(split_part(address, ',', 1), ' AVE', '')
    ELSE '  ' || replace(address, ' ', '  ') END AS typed
FROM {v_properties}"""


@query(
    "X9",
    sql=f"""WITH typed AS ({TYPED})
SELECT property_id, regexp_replace(regexp_replace(regexp_replace(
    trim(split_part(upper(typed), ',', 1)), '\\s+', ' ', 'g'), '\\bSOUTH\\b', 'S', 'g'),
    '\\bAVENUE\\b', 'AVE', 'g') AS normal
FROM typed""",
)
def normal_addresses(t: Given) -> DataFrame:
    typed = t.sql(TYPED.replace("split_part(address, ',', 1)", "split(address, ',')[0]"))
    return typed.select("property_id", text.normal_address(F.col("typed")).alias("normal"))


DAYS = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, CASE l_returnflag
    WHEN 'A' THEN '' WHEN 'N' THEN NULL
    ELSE CAST(month(l_shipdate) AS STRING) || '/' || CAST(day(l_shipdate) AS STRING) || '/'
      || CAST(year(l_shipdate) AS STRING) END AS day_text,
  CASE l_linestatus WHEN 'F' THEN '' ELSE CAST(CAST(l_shipdate AS DATE) AS STRING)
    || ' 10:30:00' END AS time_text
FROM {lineitem}"""


@query(
    "X10 X11",
    sql=f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN day_text = '' THEN NULL ELSE strptime(day_text, '%m/%d/%Y')::DATE END AS day,
  TRY_CAST(nullif(time_text, '') AS TIMESTAMP) AS at
FROM ({DAYS}) d""",
)
def parsed_dates(t: Given) -> DataFrame:
    return t.sql(DAYS).select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        text.parse_date(F.col("day_text")).alias("day"),
        text.parse_timestamp(F.col("time_text")).cast("timestamp_ntz").alias("at"),
    )


@query(
    "X23",
    sql="""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS report_day,
  strftime(o_orderdate, '%b %-d, %Y') AS card_day FROM {orders}""",
)
def formatted_dates(t: Given) -> DataFrame:
    return t.orders.select(
        "o_orderkey",
        text.report_date(F.col("o_orderdate")).alias("report_day"),
        text.card_date(F.col("o_orderdate")).alias("card_day"),
    )


@query(
    "X12",
    sql="""SELECT doc_id, regexp_replace(regexp_replace(coalesce(body, ''),
  '\\s*\\([^()]*(?:\\([^()]*\\)[^()]*)*\\)?\\s*$', ''), '\\s+$', '') AS ordinance
FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text || '  (13-196-530(b), 13-196-641)'
  WHEN 1 THEN text || ' (7-28-260' WHEN 2 THEN text ELSE NULL END AS body FROM {documents}) d""",
)
def stripped_citations(t: Given) -> DataFrame:
    body = t.sql("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text || '  (13-196-530(b), 13-196-641)'
  WHEN 1 THEN text || ' (7-28-260' WHEN 2 THEN text ELSE NULL END AS body FROM {documents}""")
    return body.select("doc_id", text.strip_citation(F.col("body")).alias("ordinance"))


FENCED = """SELECT conv_id, turn, CASE turn % 3
  WHEN 0 THEN 'Sure: ```json' || chr(10) || text || chr(10) || '``` and more ```json x```'
  WHEN 1 THEN '```JSON ' || text || ' ```' ELSE '  ' || text || chr(10) END AS reply
FROM {conversations}"""


@query(
    "X13",
    sql=f"""SELECT conv_id, turn, regexp_replace(CASE
    WHEN regexp_matches(reply, '(?is)```json\\s*(.*?)\\s*```')
    THEN regexp_extract(reply, '(?is)```json\\s*(.*?)\\s*```', 1) ELSE reply END,
  '^\\s+|\\s+$', '', 'g') AS body
FROM ({FENCED}) f""",
)
def unfenced_replies(t: Given) -> DataFrame:
    return t.sql(FENCED).select("conv_id", "turn", text.unfence_json(F.col("reply")).alias("body"))


LISTS = """SELECT o_orderkey AS request_id, CASE WHEN o_orderpriority = '5-LOW' THEN '  '
    ELSE 'R' || CAST(o_orderkey % 23 AS STRING) || ' ,R' || CAST(o_custkey % 40 AS STRING)
      || CASE WHEN o_orderstatus = 'P' THEN ',,  R' || CAST(o_orderkey % 5 AS STRING)
        ELSE ',NOWHERE' END END AS routes
FROM {orders}"""


@query(
    "X16",
    sql=f"""SELECT request_id, CASE WHEN trim(routes) = '' THEN 0
    ELSE len(string_split(routes, ',')) END AS n,
  CASE WHEN trim(routes) = '' THEN '' ELSE array_to_string(
    list_transform(string_split(routes, ','), lambda s: trim(s)), '|') END AS tokens
FROM ({LISTS}) l""",
)
def comma_lists(t: Given) -> DataFrame:
    tokens = text.comma_list(F.col("routes"))
    return t.sql(LISTS).select(
        "request_id", F.size(tokens).cast("long").alias("n"), F.array_join(tokens, "|").alias("tokens")
    )


@query("X17", sql="SELECT stop_id, CAST(stop_id * 1000 AS STRING) AS shuttle_stop_id FROM {v_stops}")
def shuttle_stop_ids(t: Given) -> DataFrame:
    return t.v_stops.select(
        "stop_id", (F.col("stop_id").cast("long") * 1000).cast("string").alias("shuttle_stop_id")
    )


GEOCODES = """SELECT o_orderkey AS request_id, CASE o_orderstatus
    WHEN 'P' THEN CAST(o_custkey AS STRING) WHEN 'F' THEN CAST(o_custkey % 90 AS STRING)
      || '.5, -' || CAST(o_orderkey % 180 AS STRING) || '.25' ELSE 'north,' || o_orderpriority END
    AS geocode FROM {orders}"""


@query(
    "X5",
    sql=f"""SELECT request_id, CASE WHEN ok THEN lat END AS lat, CASE WHEN ok THEN lon END AS lon
FROM (SELECT *, len(string_split(geocode, ',')) = 2 AND lat IS NOT NULL AND lon IS NOT NULL AS ok
  FROM (SELECT *, TRY_CAST(trim(split_part(geocode, ',', 1)) AS DOUBLE) AS lat,
    TRY_CAST(trim(split_part(geocode, ',', 2)) AS DOUBLE) AS lon FROM ({GEOCODES}) g) p) q""",
)
def geocodes(t: Given) -> DataFrame:
    point = geo.geocode(F.col("geocode"))
    return t.sql(GEOCODES).select(
        "request_id", point["lat"].alias("lat"), point["lon"].alias("lon")
    )


@query(
    "X1 X2 X3 X4",
    sql=f"""SELECT property_id, stop_id, round(m, 3) AS metres,
  CAST(round_even(m / 70, 0) AS INT) AS stop_minutes, round_even(m / 70, 1) AS grocery_minutes,
  m <= 15 * 70 AS within_15
FROM (SELECT property_id, stop_id, {METRES} AS m
  FROM {{v_properties}} a JOIN {{v_stops}} b ON property_id = stop_id) d""",
)
def walking_minutes(t: Given) -> DataFrame:
    stops = t.v_stops.select("stop_id", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    joined = t.v_properties.join(stops, F.col("property_id") == F.col("stop_id"))
    m = geo.metres(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    return joined.select("property_id", "stop_id", m.alias("m")).select(
        "property_id",
        "stop_id",
        F.round("m", 3).alias("metres"),
        geo.stop_minutes(F.col("m")).alias("stop_minutes"),
        geo.grocery_minutes(F.col("m")).alias("grocery_minutes"),
        (F.col("m") <= geo.walk_radius(F.lit(15))).alias("within_15"),
    )


WKT = """SELECT p_partkey, CASE p_size % 3
    WHEN 0 THEN 'LINESTRING (' || CAST(p_size AS STRING) || ' 41.5, -87.25 '
      || CAST(p_partkey AS STRING) || ')'
    WHEN 1 THEN 'MULTILINESTRING ((' || CAST(p_partkey AS STRING) || '.5 1, 2 3), (4 5, 6 '
      || CAST(p_size AS STRING) || '))'
    ELSE 'POINT (1 2)' END AS wkt
FROM {part}"""


@query(
    "X18 X19",
    sql=f"""SELECT p_partkey, CASE WHEN starts_with(wkt, 'LINE') THEN 1 WHEN starts_with(wkt, 'MULTI')
    THEN 2 END AS n_lines,
  CASE WHEN starts_with(wkt, 'LINE') THEN TRY_CAST(regexp_extract(wkt, '\\(([^ ]+) ', 1) AS DOUBLE)
    WHEN starts_with(wkt, 'MULTI') THEN TRY_CAST(regexp_extract(wkt, '\\(\\(([^ ]+) ', 1) AS DOUBLE)
  END AS first_lon,
  CASE WHEN NOT starts_with(wkt, 'POINT')
    THEN TRY_CAST(regexp_extract(wkt, ' ([^ )]+)\\)+$', 1) AS DOUBLE) END AS last_lat
FROM ({WKT}) w""",
)
def wkt_lines(t: Given) -> DataFrame:
    parsed = t.sql(WKT).select("p_partkey", geo.lines_from_wkt(F.col("wkt")).alias("lines"))
    # Through text and back, so that both directions are exercised.
    again = geo.lines_from_wkt(geo.wkt_from_lines(F.col("lines")))
    last = F.element_at(again, -1)
    return parsed.select(
        "p_partkey",
        F.when(again.isNotNull(), F.size(again)).alias("n_lines"),
        F.get(F.get(again, 0), 0)["lon"].alias("first_lon"),
        F.element_at(last, -1)["lat"].alias("last_lat"),
    )


@query(
    "X15 X20 X21",
    sql="""SELECT event_id, address || '|' || CAST(event_id AS STRING) AS key_text,
  nullif(rent, '') AS rent, coalesce(nullif(custom_name, ''), address) AS display_name
FROM {v_saved_events}""",
)
def event_texts(t: Given) -> DataFrame:
    return t.v_saved_events.select(
        "event_id",
        text.piped_id(F.col("address"), F.col("event_id")).alias("key_text"),
        text.blank_to_null(F.col("rent")).alias("rent"),
        text.display_name(F.col("custom_name"), F.col("address")).alias("display_name"),
    )


@query(
    "P6 null code kept",
    sql="""SELECT violation_code IS NULL OR violation_code NOT IN ('CN190019', 'CN193305', 'CN190029')
  AS kept, count(*) AS n FROM {v_violations} GROUP BY 1""",
)
def kept_by_code(t: Given) -> DataFrame:
    kept = ~one_of(F.col("violation_code"), TRIVIAL_CODES)
    return t.v_violations.groupBy(kept.alias("kept")).agg(F.count("*").alias("n"))
