"""Views that give the tables the shape of the jobs' inputs.

Each is one SELECT that Spark and other engines read alike, over all rows of its
tables. Places repeat per town: a town is 1500 customers, 2000 parts and 100
suppliers, so more data means more towns and not denser ones.
"""

from __future__ import annotations

from stoopwise.params import SHUTTLE_RENAMES, SHUTTLES_DROPPED, SHUTTLES_KEPT


def _place(key: str, town: str, lat_step: int, lon_step: int) -> str:
    return f"""
  CAST(41.78 AS DOUBLE) + CAST({town} % 300 AS DOUBLE) * CAST(0.08 AS DOUBLE)
    + CAST({key} * {lat_step} % 4000 AS DOUBLE) / CAST(100000 AS DOUBLE) AS lat,
  CAST(-87.63 AS DOUBLE) + floor({town} / 300) * CAST(0.12 AS DOUBLE)
    + CAST({key} * {lon_step} % 5000 AS DOUBLE) / CAST(100000 AS DOUBLE) AS lon"""


def _town(key: str, size: int) -> str:
    return f"CAST(floor({key} / {size}) AS BIGINT)"


def _street(key: str) -> str:
    return (
        f"CAST(5000 + {key} % 450 AS STRING) || ' S STREET'"
        f" || CAST(CAST(floor({key} / 900) AS BIGINT) AS STRING) || ' AVE'"
    )


# The names in the shuttle feed, by number: kept ones as they are before renaming, dropped
# ones, and one of another company.
_BEFORE = {new: old for old, new in SHUTTLE_RENAMES.items()}
SHUTTLE_NAMES = (
    *(_BEFORE.get(name, name) for name in SHUTTLES_KEPT), *SHUTTLES_DROPPED, "North CTA 171",
)


def _shuttle(number: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(SHUTTLE_NAMES))
    return f"CASE {number} % {len(SHUTTLE_NAMES)} {cases} END"


VIEWS = {
    # Two properties per address.
    "v_properties": f"""
SELECT c_custkey AS property_id, {_street("c_custkey")} || ', CHICAGO, IL, 60615' AS address,
{_place("c_custkey", _town("c_custkey", 1500), 7919, 104729)}
FROM {{customer}}""",
    "v_stops": f"""
SELECT p_partkey AS stop_id, p_name AS stop_name,
{_place("p_partkey", _town("p_partkey", 2000), 6151, 3571)}
FROM {{part}}""",
    # Small parts are stops without a route; the largest go with routes nobody knows.
    "v_route_stops": f"""
SELECT p_partkey AS stop_id,
  CASE WHEN p_size <= 4 THEN NULL WHEN p_size = 50 THEN '992' WHEN p_size = 49 THEN 'X' || CAST(p_partkey AS STRING)
    ELSE 'R' || CAST({_town("p_partkey", 2000)} * 100 + p_size % 23 AS STRING) END AS route_id
FROM {{part}}
UNION
SELECT p_partkey AS stop_id, CASE WHEN p_size > 4
    THEN 'R' || CAST({_town("p_partkey", 2000)} * 100 + p_partkey % 17 AS STRING) END AS route_id
FROM {{part}}""",
    "v_routes": """
SELECT 'R' || CAST(s_suppkey AS STRING) AS route_id, s_name AS name, 'cta' AS type
FROM {supplier}""",
    "v_amenities": f"""
SELECT s_suppkey AS amenity_id, s_name AS name, s_name || ' ST' AS address,
  CASE WHEN s_nationkey = 0 THEN 'cafe' ELSE 'grocery' END AS type,
{_place("s_suppkey", _town("s_suppkey", 100), 5003, 2741)}
FROM {{supplier}}""",
    # The same id can occur several times; some codes, texts and days are missing.
    "v_violations": f"""
SELECT CAST(l_orderkey * 10 + l_linenumber AS STRING) AS violation_id,
  CAST(l_shipdate AS DATE) AS violation_date,
  CASE WHEN l_suppkey % 10 = 0 THEN 'CN190019' WHEN l_suppkey % 10 = 1 THEN 'CN190029'
    WHEN l_suppkey % 10 = 2 THEN NULL
    ELSE 'CN' || CAST(100000 + l_suppkey % 50 AS STRING) END AS violation_code,
  l_linestatus AS violation_status,
  CASE WHEN l_returnflag = 'N' THEN NULL ELSE CAST(o_orderdate AS DATE) END
    AS violation_status_date,
  CASE WHEN l_suppkey % 10 = 1 THEN 'ARRANGE FOR REINSPECTION'
    ELSE 'DESC ' || CAST(l_suppkey % 25 AS STRING) END AS violation_description,
  CASE WHEN l_returnflag = 'N' THEN NULL
    ELSE l_returnflag || ' unit ' || CAST(l_partkey % 40 AS STRING) END
    AS violation_inspector_comments,
  'Failed to maintain part ' || CAST(l_partkey % 100 AS STRING) || '.  (13-196-'
    || CAST(l_partkey % 700 AS STRING) || '(b), 13-196-641'
    || CASE WHEN l_returnflag = 'A' THEN '' ELSE ')' END AS violation_ordinance,
  CAST(o_orderkey AS INT) AS inspection_number,
  o_orderstatus AS inspection_status,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'COMPLAINT' WHEN '2-HIGH' THEN 'PERIODIC'
    WHEN '3-MEDIUM' THEN 'PERMIT' ELSE 'REGISTRATION' END AS inspection_category,
  {_street("o_custkey")}
    || CASE WHEN l_linestatus = 'F' THEN ' APT ' || CAST(l_linenumber AS STRING) ELSE '' END
    AS address,
  lat AS latitude, lon AS longitude
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
JOIN (SELECT property_id, lat, lon FROM {{v_properties}}) p ON o_custkey = property_id""",
    # Of most places no summary is stored yet.
    "v_summaries": f"""
SELECT c_custkey AS id, {_street("c_custkey")} AS address,
  CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY')
    THEN 'Summary ' || CAST(c_custkey AS STRING) END AS summary
FROM {{customer}}""",
    # Each user deals with the addresses of three customers. They are typed in lower case at
    # times; one in twenty is of no property.
    "v_saved_events": f"""
SELECT event_id, ts, user_id,
  CASE WHEN event_id % 20 = 19 THEN 'UNKNOWN PLACE'
    WHEN event_type = 'view' THEN lower({_street("(user_id + event_id % 3)")} || ', CHICAGO, IL, 60615')
    ELSE {_street("(user_id + event_id % 3)")} || ', CHICAGO, IL, 60615' END AS address,
  CASE event_type WHEN 'signup' THEN 'save' WHEN 'purchase' THEN 'save'
    WHEN 'error' THEN 'delete' ELSE 'update' END AS action,
  CASE WHEN value < 10 THEN '' ELSE 'Home ' || CAST(event_id AS STRING) END AS custom_name,
  props AS remarks,
  CASE WHEN value < 25 THEN CAST(CAST(floor(value * 100) AS BIGINT) AS STRING) ELSE '' END AS rent
FROM {{events}}""",
}
