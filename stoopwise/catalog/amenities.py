"""Grocery feed and place import queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoopwise.catalog.registry import Given, query
from stoopwise.operators import merge
from stoopwise.params import PLACE_TYPES
from stoopwise.plans import amenities
from stoopwise.session import new_path
from stoopwise.sources.bucketed import BucketedTable

# Customers as the stores of the feed: some closed, some without a point or an address,
# some listed twice at one address.
FEED = """SELECT c_custkey AS store, c_name AS store_name,
  CASE WHEN c_mktsegment = 'MACHINERY' AND c_acctbal < 0 THEN NULL
    ELSE CAST(CAST(floor(c_custkey / 2) AS BIGINT) * 2 AS STRING) || ' FEED ST' END AS address,
  CASE WHEN c_nationkey < 15 THEN 'Open' WHEN c_nationkey < 20 THEN 'OPEN' ELSE 'CLOSED' END
    AS new_status,
  CASE WHEN c_nationkey = 3 THEN 0 WHEN c_nationkey = 4 THEN 3 ELSE 2 END AS n_coordinates,
  CAST(c_custkey AS DOUBLE) / 8 AS lon, c_acctbal AS lat,
  CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE '2025-01-' ||
    CASE WHEN c_nationkey < 9 THEN '0' ELSE '' END || CAST(c_nationkey + 1 AS STRING)
    || ' 08:00:00' END AS last_updated
FROM {customer}"""

STAGED = f"""staged AS (SELECT address || '|' || CAST(lon AS STRING) || '|' || CAST(lat AS STRING) AS id,
    store_name, address, '60615' AS zip, lon AS longitude, lat AS latitude, new_status AS status,
    TRY_CAST(nullif(last_updated, '') AS TIMESTAMP) AS last_updated
  FROM ({FEED}) f WHERE address IS NOT NULL AND upper(new_status) = 'OPEN' AND n_coordinates = 2)"""

# The stored table: last month's names, some stores that are gone, some other amenities.
STORED = """SELECT CAST(c_custkey AS STRING) || ' FEED ST' AS address,
  CASE WHEN c_nationkey IN (7, 8) THEN 'cafe' ELSE 'grocery' END AS type,
  CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Old ' || c_name ELSE c_name END AS name,
  CAST(c_custkey AS DOUBLE) / 8 AS lon, c_acctbal AS lat
FROM {customer}"""

SYNC = f"""{STAGED}, stored AS ({STORED}),
latest AS (SELECT address, store_name AS name, longitude AS lon, latitude AS lat FROM (
  SELECT *, row_number() OVER (PARTITION BY address ORDER BY last_updated DESC NULLS LAST, id) AS nth
  FROM staged) s WHERE nth = 1),
groceries AS (SELECT * FROM stored WHERE type = 'grocery'),
merged AS (
  SELECT coalesce(n.address, o.address) AS address, 'grocery' AS type,
    CASE WHEN n.address IS NULL THEN o.name ELSE n.name END AS name,
    CASE WHEN n.address IS NULL THEN o.lon ELSE n.lon END AS lon,
    CASE WHEN n.address IS NULL THEN o.lat ELSE n.lat END AS lat,
    CASE WHEN o.address IS NULL THEN 'insert' WHEN n.address IS NULL THEN 'delete'
      WHEN o.name IS DISTINCT FROM n.name OR o.lon IS DISTINCT FROM n.lon
        OR o.lat IS DISTINCT FROM n.lat THEN 'update' ELSE 'unchanged' END AS action
  FROM groceries o FULL OUTER JOIN latest n ON o.address = n.address
  UNION ALL SELECT address, type, name, lon, lat, 'unchanged' FROM stored WHERE type <> 'grocery')"""


def features(t: Given) -> DataFrame:
    """The feed, one feature per row."""
    coordinates = (
        F.when(F.col("n_coordinates") == 2, F.array("lon", "lat"))
        .when(F.col("n_coordinates") == 3, F.array("lon", "lat", F.lit(0.0)))
    )
    geometry = F.when(
        coordinates.isNotNull(),
        F.struct(F.lit("Point").alias("type"), coordinates.alias("coordinates")),
    )
    properties = F.struct(
        "store_name", "address", F.lit("60615").alias("zip"), "new_status", "last_updated"
    )
    return t.sql(FEED).select(
        F.struct(geometry.alias("geometry"), properties.alias("properties")).alias("feature")
    )


def staging(t: Given) -> DataFrame:
    return amenities.stage_groceries(features(t))


@query("P11 X11 X15 S11", sql=f"WITH {STAGED} SELECT * FROM staged")
def grocery_staging(t: Given) -> DataFrame:
    return staging(t).withColumn("last_updated", F.col("last_updated").cast("timestamp_ntz"))


@query("Q9 U4 U5", sql=f"WITH {SYNC} SELECT * FROM merged")
def grocery_sync(t: Given) -> DataFrame:
    return amenities.grocery_sync(t.sql(STORED), staging(t))


@query("U5 new table", sql=f"WITH {SYNC} SELECT * EXCLUDE (action) FROM merged WHERE action <> 'delete'")
def grocery_snapshot(t: Given) -> DataFrame:
    return merge.snapshot(amenities.grocery_sync(t.sql(STORED), staging(t)))


@query("U5 change log", sql=f"WITH {SYNC} SELECT * FROM merged WHERE action <> 'unchanged'")
def grocery_changes(t: Given) -> DataFrame:
    return merge.changes(amenities.grocery_sync(t.sql(STORED), staging(t)))


@query(
    "U4 upsert alone",
    sql=f"""WITH {SYNC} SELECT * EXCLUDE (action),
  CASE WHEN action = 'delete' THEN 'unchanged' ELSE action END AS action
FROM merged WHERE type = 'grocery'""",
)
def grocery_upsert(t: Given) -> DataFrame:
    return merge.sync(
        t.sql(STORED).where("type = 'grocery'"),
        amenities.as_amenities(staging(t)),
        keys=["address", "type"],
        values=["name", "lon", "lat"],
        delete=False,
    )


def bucketed(t: Given, root: str, buckets: int = 64) -> BucketedTable:
    table = BucketedTable(
        t.spark, root, ["address", "type"], ["name", "lon", "lat"], F.col("type") == "grocery", buckets
    )
    table.create(t.sql(STORED).select("address", "type", "name", "lon", "lat"))
    return table


@query(
    "U4 U5 T2 only the buckets that change",
    sql=f"WITH {SYNC} SELECT * EXCLUDE (action) FROM merged WHERE action <> 'delete'",
)
def grocery_sync_buckets(t: Given) -> DataFrame:
    table = bucketed(t, new_path(t.spark, "grocery-buckets"))
    table.sync(amenities.as_amenities(staging(t)))
    return table.read()


@query("U5 change log of the buckets", sql=f"WITH {SYNC} SELECT * FROM merged WHERE action <> 'unchanged'")
def grocery_bucket_changes(t: Given) -> DataFrame:
    return bucketed(t, new_path(t.spark, "grocery-buckets")).sync(amenities.as_amenities(staging(t)))


@query(
    "J7",
    sql=f"""WITH {STAGED}, stored AS ({STORED})
SELECT * FROM stored WHERE type = 'grocery' AND EXISTS (SELECT 1 FROM staged s
  WHERE s.address = stored.address AND s.longitude = lon AND s.latitude = lat)""",
)
def groceries_still_listed(t: Given) -> DataFrame:
    listed = staging(t).select(
        "address", F.col("longitude").alias("lon"), F.col("latitude").alias("lat")
    )
    kept = merge.delete_missing(
        t.sql(STORED).where("type = 'grocery'"), listed, ["address", "lon", "lat"]
    )
    return kept.select("address", "type", "name", "lon", "lat")


_TYPES = " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(PLACE_TYPES))
PLACES = f"""SELECT CASE p_size % 21 {_TYPES} END AS type,
  CASE WHEN p_type = 'SMALL' THEN NULL ELSE p_name END AS name,
  CASE WHEN p_type = 'LARGE' THEN NULL ELSE p_brand || ' place ' || CAST(p_partkey AS STRING) END
    AS address,
  CASE WHEN p_brand = 'Brand#1' THEN 'n/a' ELSE CAST(p_retailprice / 64 AS STRING) END AS lat,
  CASE WHEN p_brand = 'Brand#2' THEN NULL ELSE CAST(p_size AS STRING) END AS lng
FROM {{part}}"""


@query(
    "Q14 P16 P18",
    sql=f"""SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY address, type
    ORDER BY name, lon, lat) AS nth FROM (
  SELECT coalesce(name, '') AS name, 'grocery' AS type, coalesce(address, '') AS address,
    TRY_CAST(lng AS DOUBLE) AS lon, TRY_CAST(lat AS DOUBLE) AS lat FROM ({PLACES}) p
  WHERE type = 'grocery_or_supermarket' AND TRY_CAST(lat AS DOUBLE) IS NOT NULL
    AND TRY_CAST(lng AS DOUBLE) IS NOT NULL) i) n WHERE nth = 1""",
)
def amenity_import(t: Given) -> DataFrame:
    return amenities.amenity_import(t.sql(PLACES))[0]


@query(
    "P18 Q14 rejected rows",
    sql=f"""SELECT *, 'Invalid latitude/longitude values' AS error FROM ({PLACES}) p
WHERE type = 'grocery_or_supermarket' AND (TRY_CAST(lat AS DOUBLE) IS NULL
  OR TRY_CAST(lng AS DOUBLE) IS NULL)""",
)
def amenity_rejects(t: Given) -> DataFrame:
    return amenities.amenity_import(t.sql(PLACES))[1]
