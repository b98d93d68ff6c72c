"""Profiles and quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoopwise import schemas
from stoopwise.catalog.registry import TABLES, Given, query
from stoopwise.operators import profile, quality, sketches
from stoopwise.operators.filters import mentions
from stoopwise.params import AMENITY_TYPES


def _counts_sql(column: str) -> str:
    return f"""SELECT {column}, count(*) AS n FROM {{v_violations}}
WHERE {column} IS NOT NULL GROUP BY {column}"""


@query("A2 Q16", sql=_counts_sql("inspection_category"))
def category_counts(t: Given) -> DataFrame:
    return profile.value_counts(t.v_violations, "inspection_category")


@query("A2 Q16", sql=_counts_sql("violation_code"))
def code_counts(t: Given) -> DataFrame:
    return profile.value_counts(t.v_violations, "violation_code")


@query("A2 Q16", sql=_counts_sql("violation_description"))
def description_counts(t: Given) -> DataFrame:
    return profile.value_counts(t.v_violations, "violation_description")


@query("A2 Q16", sql=_counts_sql("address"))
def address_counts(t: Given) -> DataFrame:
    return profile.value_counts(t.v_violations, "address")


def _ambiguous_sql(key: str, other: str) -> str:
    return f"SELECT {key} FROM {{v_violations}} GROUP BY {key} HAVING count(DISTINCT {other}) > 1"


@query("A3 Q16", sql=_ambiguous_sql("violation_code", "violation_description"))
def codes_with_many_descriptions(t: Given) -> DataFrame:
    return profile.ambiguous_keys(t.v_violations, "violation_code", "violation_description")


@query("A3 Q16", sql=_ambiguous_sql("violation_description", "violation_code"))
def descriptions_with_many_codes(t: Given) -> DataFrame:
    return profile.ambiguous_keys(t.v_violations, "violation_description", "violation_code")


@query(
    "A4 Q16",
    sql="""SELECT inspection_number, count(DISTINCT violation_status) AS n_status
FROM {v_violations} GROUP BY inspection_number""",
)
def statuses_per_inspection(t: Given) -> DataFrame:
    counts = profile.distinct_per_key(
        t.v_violations, "inspection_number", "violation_status", "n_status"
    )
    return counts.orderBy(F.desc("n_status"), "inspection_number")


@query(
    "A5 Q16",
    sql="""SELECT inspection_number, count(DISTINCT violation_date) AS n_days,
  count(DISTINCT strftime(violation_date, '%Y-%m')) AS n_months
FROM {v_violations} GROUP BY inspection_number HAVING n_months > 1""",
)
def inspections_over_months(t: Given) -> DataFrame:
    return profile.days_and_months(t.v_violations, "inspection_number", "violation_date")


@query("A6 Q16", sql="SELECT count(DISTINCT inspection_number) AS n FROM {v_violations}")
def distinct_inspections(t: Given) -> DataFrame:
    return profile.distinct_count(t.v_violations, "inspection_number")


CATALOGUE = """WITH violation_counts AS (SELECT violation_description, violation_code,
    count(*) OVER (PARTITION BY violation_description, violation_code) AS n_violations
  FROM {v_violations}),
codes AS (SELECT violation_description, count(DISTINCT violation_code) AS n_code_per_desc
  FROM {v_violations} GROUP BY violation_description),
prioritized AS (SELECT *, max(n_violations) OVER (PARTITION BY violation_description) AS most
  FROM violation_counts),
ranked AS (SELECT *, dense_rank() OVER (ORDER BY most DESC) AS group_priority FROM prioritized),
catalogue AS (SELECT DISTINCT group_priority, r.violation_description, violation_code,
    n_code_per_desc, n_violations
  FROM ranked r JOIN codes c ON r.violation_description = c.violation_description)"""


@query("Q6 W2 W3 W4 W5 W6 O5 U11", sql=f"{CATALOGUE} SELECT * FROM catalogue")
def code_catalogue(t: Given) -> DataFrame:
    return profile.code_catalogue(t.v_violations)


@query(
    "P19 W6",
    sql=f"""{CATALOGUE} SELECT violation_description, violation_code, n_violations FROM catalogue
WHERE contains(violation_description, 'REINSPECT')""",
)
def reinspection_codes(t: Given) -> DataFrame:
    return (
        profile.code_catalogue(t.v_violations)
        .where(mentions(F.col("violation_description"), "REINSPECT"))
        .select("violation_description", "violation_code", "n_violations")
    )


@query(
    "U11",
    sql="""SELECT DISTINCT address, inspection_category FROM {v_violations}""",
)
def distinct_address_categories(t: Given) -> DataFrame:
    return t.v_violations.select("address", "inspection_category").distinct()


@query(
    "A14 S9",
    sql="\nUNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS n FROM {{{name}}}" for name in TABLES
    ),
)
def table_counts(t: Given) -> DataFrame:
    return profile.table_counts({name: getattr(t, name) for name in TABLES})


@query(
    "A14 O4",
    sql="SELECT stop_id, stop_name FROM {v_stops} ORDER BY stop_id LIMIT 5",
)
def stops_preview(t: Given) -> DataFrame:
    return profile.preview(t.v_stops.select("stop_id", "stop_name"), ["stop_id"], 5)


@query(
    "D2",
    sql="""SELECT 'violation_id fits' AS rule, count(*) FILTER (WHERE length(violation_id) > 10) AS bad_rows
FROM {v_violations}
UNION ALL SELECT 'address fits', count(*) FILTER (WHERE length(address) > 100) FROM {v_violations}
UNION ALL SELECT 'inspection_category fits', count(*) FILTER (WHERE length(inspection_category) > 20)
FROM {v_violations}
UNION ALL SELECT 'violation_code given', count(*) FILTER (WHERE violation_code IS NULL)
FROM {v_violations}
UNION ALL SELECT 'violation_date given', count(*) FILTER (WHERE violation_date IS NULL)
FROM {v_violations}""",
)
def violation_rules(t: Given) -> DataFrame:
    fitting = ("violation_id", "address", "inspection_category")
    rules = {
        f"{name} fits": quality.fits(name, schemas.VIOLATION_LENGTHS[name]) for name in fitting
    }
    rules |= {f"{name} given": quality.not_null(name) for name in ("violation_code", "violation_date")}
    return quality.broken_rules(t.v_violations, rules)


@query(
    "D2 enumerations",
    sql="""SELECT 'known type' AS rule, count(*) FILTER (WHERE type NOT IN ('grocery', 'pharmacy',
  'restaurant', 'cafe', 'bar', 'hospital', 'other')) AS bad_rows FROM {v_amenities}
UNION ALL SELECT 'address fits', count(*) FILTER (WHERE length(address) > 255) FROM {v_amenities}""",
)
def amenity_rules(t: Given) -> DataFrame:
    return quality.broken_rules(
        t.v_amenities,
        {
            "known type": quality.allowed("type", AMENITY_TYPES),
            "address fits": quality.fits("address", schemas.AMENITY_LENGTHS["address"]),
        },
    )


@query(
    "D3",
    sql="""SELECT (SELECT count(*) FROM {v_violations}) AS source_rows,
  (SELECT count(DISTINCT violation_id) FROM {v_violations}) AS target_rows,
  (SELECT count(*) FROM {v_violations}) = (SELECT count(DISTINCT violation_id) FROM {v_violations})
    AS equal""",
)
def source_and_target_counts(t: Given) -> DataFrame:
    target = t.v_violations.select("violation_id").distinct()
    return quality.compare_counts(t.v_violations, target)


@query(
    "A6 D1 mergeable sketches",
    sql="""SELECT date_trunc('month', violation_date)::DATE AS month, count(*) AS n_rows,
  count(DISTINCT address) AS n_exact, TRUE AS within_bound
FROM {v_violations} GROUP BY 1""",
)
def addresses_sketched_by_month(t: Given) -> DataFrame:
    """Sketches per day, merged by month, beside the exact counts."""
    month = F.trunc(F.col("day"), "month").alias("month")
    days = sketches.sketched(t.v_violations.withColumnRenamed("violation_date", "day"), ["day"], "address")
    by_month = sketches.merged(days.select(month, "n_rows", "sketch"), ["month"])
    exact = t.v_violations.groupBy(F.trunc("violation_date", "month").alias("_month")).agg(
        F.count_distinct("address").alias("n_exact")
    )
    # Six standard errors: one month in half a billion is outside by chance.
    slack = 1 + 6 * sketches.standard_error() * F.col("n_exact")
    return (
        sketches.estimated(by_month, "_estimate")
        .join(exact, F.col("month").eqNullSafe(F.col("_month")))
        .select("month", "n_rows", "n_exact", (F.abs(F.col("_estimate") - F.col("n_exact")) <= slack).alias("within_bound"))
    )
