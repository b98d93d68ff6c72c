"""Violation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoopwise import schemas
from stoopwise.catalog.registry import Given, query
from stoopwise.functions import text
from stoopwise.operators import filters, merge
from stoopwise.operators.prefix import prefix_join, prefix_merge
from stoopwise.operators.slices import slices
from stoopwise.params import NEIGHBOURHOOD, TRIVIAL_CODES
from stoopwise.plans import reports, summaries
from stoopwise.plans import violations as v
from stoopwise.session import dropped, new_path, shuffles_go, written
from stoopwise.sources import layout

# The given data spans 1995 to 2001.
START = "2000-06-01"

COLUMNS = ["violation_id", "violation_date", "violation_code", "inspection_category", "address"]
SELECTED = "SELECT " + ", ".join(COLUMNS) + " FROM {v_violations}"
TRIVIAL = "(" + ", ".join(f"'{c}'" for c in TRIVIAL_CODES) + ")"
HEAD = "trim(split_part(upper(address), ',', 1))"


def raw_rows(t: Given) -> DataFrame:
    """The violations as their file has them: its header, US dates, all text."""
    return as_raw(t.v_violations)


def as_raw(rows: DataFrame) -> DataFrame:
    """Rows of ``v_violations`` as ``raw_rows`` has them."""
    columns = []
    for name, (field, kind) in schemas.VIOLATION_COLUMNS.items():
        if field == "violation_last_modified_date":
            value = F.date_format("violation_date", "MM/dd/yyyy")
        elif field not in rows.columns:
            value = F.lit(None).cast("string")
        elif kind == "date":
            value = F.coalesce(F.date_format(field, "M/d/yyyy"), F.lit(" "))
        else:
            value = F.col(field).cast("string")
        columns.append(value.alias(name))
    return rows.select(*columns)


@query(
    "P1 O1 X10",
    sql="""SELECT address, violation_id, violation_date, NULL AS department_bureau,
  CAST(inspection_number AS STRING) AS inspection_id, inspection_category, inspection_status,
  NULL AS inspector_id, violation_ordinance, violation_code, violation_description,
  NULL AS violation_location, violation_inspector_comments, violation_status,
  coalesce(CAST(month(violation_status_date) AS STRING) || '/'
    || CAST(day(violation_status_date) AS STRING) || '/'
    || CAST(year(violation_status_date) AS STRING), ' ') AS violation_status_date
FROM {v_violations}""",
)
def violations_recast(t: Given) -> DataFrame:
    return v.recast(raw_rows(t))


@query("P2", sql=f"{SELECTED} WHERE violation_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'")
def violations_between_dates(t: Given) -> DataFrame:
    return filters.between_dates(t.v_violations, "1997-01-01", "1998-12-31").select(COLUMNS)


@query("P3 inclusive", sql=f"{SELECTED} WHERE violation_date >= DATE '{START}'")
def violations_since(t: Given) -> DataFrame:
    return filters.since(t.v_violations, START).select(COLUMNS)


@query("P3 strict", sql=f"{SELECTED} WHERE violation_date > DATE '{START}'")
def violations_after(t: Given) -> DataFrame:
    return filters.since(t.v_violations, START, inclusive=False).select(COLUMNS)


BOX = "latitude BETWEEN 41.780 AND 41.810 AND longitude BETWEEN -87.630 AND -87.580"


@query("P4", sql=f"{SELECTED} WHERE {BOX}")
def violations_in_box(t: Given) -> DataFrame:
    return filters.in_box(t.v_violations, NEIGHBOURHOOD).select(COLUMNS)


@query("P5", sql=f"{SELECTED} WHERE inspection_category IN ('COMPLAINT', 'PERIODIC')")
def violations_of_categories(t: Given) -> DataFrame:
    return filters.with_categories(t.v_violations, ["complaint", "Periodic"]).select(COLUMNS)


@query("P6", sql=f"{SELECTED} WHERE violation_code IS NULL OR violation_code NOT IN {TRIVIAL}")
def violations_not_trivial(t: Given) -> DataFrame:
    return filters.drop_codes(t.v_violations).select(COLUMNS)


@query("P7", sql=f"{SELECTED} WHERE violation_code = 'CN190019'")
def violations_with_code(t: Given) -> DataFrame:
    return filters.with_code(t.v_violations, "CN190019").select(COLUMNS)


@query("P8", sql=f"{SELECTED} WHERE starts_with(upper(address), '5012 S STREET')")
def violations_at_address_prefix(t: Given) -> DataFrame:
    return filters.with_address_prefix(t.v_violations, "5012 s street").select(COLUMNS)


@query(
    "P19",
    sql="""SELECT violation_id, violation_description FROM {v_violations}
WHERE contains(violation_description, 'REINSPECT')""",
)
def violations_mentioning_reinspection(t: Given) -> DataFrame:
    return t.v_violations.where(
        filters.mentions(F.col("violation_description"), "REINSPECT")
    ).select("violation_id", "violation_description")


PREFIX_PAIRS = f"""WITH heads AS (SELECT DISTINCT {HEAD} AS head FROM {{v_properties}}),
texts AS (SELECT DISTINCT upper(address) AS address FROM {{v_violations}})
SELECT head, address FROM heads JOIN texts
  ON starts_with(address, head)
  AND split_part(address, ' ', 1) = split_part(head, ' ', 1)
WHERE head <> ''"""


@query("J5 P8", sql=PREFIX_PAIRS)
def address_prefix_pairs(t: Given) -> DataFrame:
    heads = t.v_properties.select(text.address_head(F.col("address")).alias("head"))
    return prefix_join(heads, t.v_violations, "head", "address")


@query("J5 P8 sorted merge", sql=PREFIX_PAIRS)
def address_prefix_pairs_merged(t: Given) -> DataFrame:
    heads = t.v_properties.select(text.address_head(F.col("address")).alias("head"))
    return prefix_merge(heads, t.v_violations, "head", "address")


STATUS_VIOLATIONS = f"""SELECT * FROM {{v_violations}}
  WHERE violation_date > DATE '{START}' AND inspection_category IN ('COMPLAINT', 'PERIODIC')"""

STATUS = f"""WITH located AS (SELECT property_id, {HEAD} AS head FROM {{v_properties}}),
heads AS (SELECT DISTINCT head, split_part(head, ' ', 1) AS token FROM located),
recent AS ({STATUS_VIOLATIONS}),
counts AS (SELECT head, count(*) AS n, count(DISTINCT violation_date) AS occasions,
    count(*) FILTER (WHERE violation_code IN {TRIVIAL}) AS trivial,
    count(DISTINCT violation_date) FILTER (WHERE violation_code IN {TRIVIAL}) AS trivial_occasions
  FROM heads JOIN recent ON split_part(upper(address), ' ', 1) = token
    AND starts_with(upper(address), head) GROUP BY head),
stored AS (SELECT head, arg_min(summary, id) AS stored FROM heads JOIN {{v_summaries}} s
    ON summary IS NOT NULL AND split_part(upper(s.address), ' ', 1) = token AND starts_with(upper(s.address), head)
  GROUP BY head)
SELECT property_id, l.head AS address, DATE '{START}' AS start_date,
  CASE WHEN n IS NULL THEN 'no_violations' WHEN stored IS NULL THEN 'trivial_only'
    ELSE 'available' END AS data_status,
  n AS total_violations_count, occasions AS total_inspections_count,
  CASE WHEN n IS NULL THEN 'No violation record found for this address'
    WHEN stored IS NULL THEN CAST(n AS STRING)
      || ' trivial violations about inspector having no entry were reported on '
      || CAST(occasions AS STRING) || ' occasions and omitted here for brevity.'
    ELSE stored END AS summary,
  CASE WHEN n IS NOT NULL AND stored IS NOT NULL THEN CAST(trivial AS STRING)
      || ' trivial violations about inspector having no entry were reported on '
      || CAST(trivial_occasions AS STRING) || ' occasions and omitted here for brevity.'
    END AS note,
  CAST(NULL AS STRING) AS error
FROM located l LEFT JOIN counts ON l.head = counts.head LEFT JOIN stored ON l.head = stored.head"""


@query("Q4 J5 A1 W8 U10 X6 X22 P3 P5", sql=STATUS)
def violation_status(t: Given) -> DataFrame:
    return v.violation_status(t.v_properties, t.v_violations, t.v_summaries, start=START)


@query(
    "W8 J5",
    sql=f"""WITH heads AS (SELECT DISTINCT {HEAD} AS head FROM {{v_properties}})
SELECT head, arg_min(summary, id) AS summary FROM heads JOIN {{v_summaries}} s
  ON summary IS NOT NULL AND split_part(upper(s.address), ' ', 1) = split_part(head, ' ', 1)
  AND starts_with(upper(s.address), head) GROUP BY head""",
)
def first_summary_per_address(t: Given) -> DataFrame:
    heads = t.v_properties.select(text.address_head(F.col("address")).alias("head")).distinct()
    return v.first_summary(heads, t.v_summaries)


@query(
    "A1",
    sql=f"""SELECT upper(address) AS address, count(*) AS n_violations,
  count(DISTINCT violation_date) AS n_occasions,
  count(*) FILTER (WHERE violation_code IN {TRIVIAL}) AS n_trivial,
  count(DISTINCT violation_date) FILTER (WHERE violation_code IN {TRIVIAL}) AS n_trivial_occasions
FROM {{v_violations}} GROUP BY upper(address)""",
)
def violations_per_address(t: Given) -> DataFrame:
    days = t.v_violations.groupBy(F.upper("address").alias("address"), "violation_date").agg(
        F.count("*").alias("n"), F.count_if(v.is_trivial()).alias("trivial")
    )
    return days.groupBy("address").agg(
        F.sum("n").alias("n_violations"),
        F.count("violation_date").alias("n_occasions"),
        F.sum("trivial").alias("n_trivial"),
        F.count_if(F.col("trivial") > 0).alias("n_trivial_occasions"),
    )


SCREENED = f"{BOX} AND violation_date >= DATE '{START}' AND inspection_category IN ('COMPLAINT', 'PERIODIC')"
SCREEN = {"box": NEIGHBOURHOOD, "start": START}


@query("Q7 P1 P3 P4 P5", sql=f"{SELECTED} WHERE {SCREENED}")
def violations_screened(t: Given) -> DataFrame:
    return v.screened(t.v_violations, **SCREEN).select(COLUMNS)


@query(
    "Q7 D1",
    sql=f"""WITH flags AS (SELECT address, {BOX} AS s1, violation_date >= DATE '{START}' AS s2,
  inspection_category IN ('COMPLAINT', 'PERIODIC') AS s3 FROM {{v_violations}})
SELECT 1 AS step_no, 'all' AS step, count(*) AS n_rows, count(DISTINCT address) AS n_addresses FROM flags
UNION ALL SELECT 2, 'in_box', count(*), count(DISTINCT address) FROM flags WHERE s1
UNION ALL SELECT 3, 'recent', count(*), count(DISTINCT address) FROM flags WHERE s1 AND s2
UNION ALL SELECT 4, 'category', count(*), count(DISTINCT address) FROM flags WHERE s1 AND s2 AND s3""",
)
def screening_counts(t: Given) -> DataFrame:
    return v.screening_counts(t.v_violations, **SCREEN)


@query(
    "Q8 A2 P6",
    sql=f"""WITH counts AS (SELECT address, count(*) AS n FROM {{v_violations}} GROUP BY address),
serious AS (SELECT DISTINCT upper(address) AS address FROM {{v_violations}}
  WHERE violation_code IS NULL OR violation_code NOT IN {TRIVIAL})
SELECT address, n FROM counts c WHERE EXISTS (SELECT 1 FROM serious s
  WHERE split_part(s.address, ' ', 1) = split_part(upper(c.address), ' ', 1)
    AND starts_with(s.address, upper(c.address)))""",
)
def addresses_to_summarise(t: Given) -> DataFrame:
    return v.addresses_to_summarise(t.v_violations)


UNIQUE_ORDER = [
    "violation_id", "violation_date", "violation_code", "violation_status",
    "violation_status_date", "violation_description", "violation_inspector_comments",
    "violation_ordinance", "inspection_number", "inspection_status", "inspection_category",
    "address", "latitude", "longitude",
]
UNIQUE = f"""SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY violation_id
  ORDER BY {", ".join(f"{c} NULLS FIRST" for c in UNIQUE_ORDER)}) AS nth FROM {{v_violations}})
WHERE nth = 1"""


@query("U2 W8", sql=UNIQUE)
def violations_unique(t: Given) -> DataFrame:
    return v.unique_violations(t.v_violations)


LINES = f"""uniq AS ({UNIQUE}),
heads AS (SELECT DISTINCT upper(address) AS head FROM uniq),
lines AS (SELECT head, violation_date, row_number() OVER (PARTITION BY head, violation_date
    ORDER BY inspection_number DESC, inspection_category, violation_id) AS line_no,
    count(*) OVER (PARTITION BY head, violation_date) AS n_violations,
    row_number() OVER (PARTITION BY head ORDER BY violation_date DESC, inspection_number DESC,
      inspection_category, violation_id) AS place,
    violation_inspector_comments AS comment,
    regexp_replace(regexp_replace(violation_ordinance,
      '\\s*\\([^()]*(?:\\([^()]*\\)[^()]*)*\\)?\\s*$', ''), '\\s+$', '') AS ordinance
  FROM heads JOIN uniq ON split_part(upper(address), ' ', 1) = split_part(head, ' ', 1)
    AND starts_with(upper(address), head)
  WHERE violation_code IS NULL OR violation_code NOT IN {TRIVIAL}),
texts AS (SELECT head, violation_date, line_no, n_violations, place, CAST(line_no AS STRING)
    || ') Inspector noted issue(s) with ''' || coalesce(comment, '')
    || ''' -- which allegedly violated city ordinance ''' || ordinance || '''; ' AS line FROM lines)"""
REPORTS = f"""{LINES},
occasions AS (SELECT head, violation_date, 'On ' || strftime(violation_date, '%Y-%m-%d')
    || ', it was cited for the following ' || CAST(count(*) AS STRING) || ' violations: '
    || string_agg(line, '' ORDER BY line_no) AS occasion FROM texts GROUP BY head, violation_date),
whole AS (SELECT head AS address,
  'This building was cited on the following occasions: '
  || string_agg(chr(10) || chr(10) || occasion, '' ORDER BY violation_date DESC) AS report
FROM occasions GROUP BY head)"""


def _lines(t: Given) -> DataFrame:
    # The join is at rest before its rows are shuffled again, one slice after the other.
    rows = written(t.v_violations, "violations", compression="zstd")
    path = new_path(t.spark, "unique-violations")
    for part in slices(rows, ["violation_id"]):
        unique = v.unique_violations(part).select(reports.SHOWN)
        with shuffles_go(t.spark):
            unique.write.mode("append").parquet(path, compression="zstd")
    dropped(rows)
    return reports.report_lines(t.spark.read.schema(unique.schema).parquet(path), stored=True)


@query("W7 O2 P6 X12 A15 per line", sql=f"WITH {LINES} SELECT * FROM texts")
def report_lines(t: Given) -> DataFrame:
    return _lines(t)


@query("Q5 A15 X12 X23", sql=f"WITH {REPORTS} SELECT * FROM whole")
def report_text(t: Given) -> DataFrame:
    return reports.report_text(_lines(t))


@query("Q5 A15 reports of changed addresses only", sql=f"WITH {REPORTS} SELECT * FROM whole")
def reports_kept_up(t: Given) -> DataFrame:
    whole = written(v.unique_violations(t.v_violations), "unique-violations")
    day = F.lit("2001-06-01").cast("date")
    added = F.coalesce(F.col("violation_date") >= day, F.lit(True))
    stored = written(reports.report_text(reports.report_lines(whole.where(~added), stored=True)), "stored-reports")
    return reports.updated_reports(stored, whole, whole.where(added))


@query("P1 P3 P4 P5 Q7 S9 stored layout", sql=f"{SELECTED} WHERE {SCREENED}")
def violations_screened_from_layout(t: Given) -> DataFrame:
    path = new_path(t.spark, "violations-layout")
    layout.write_violations(t.v_violations, path)
    return v.screened(t.spark.read.parquet(path), **SCREEN).select(COLUMNS)


BASE_PROMPT = "Summarise the violations of this building."


@query(
    "Q5 A16",
    sql=f"""WITH {REPORTS} SELECT address,
  '{BASE_PROMPT}' || chr(10) || report AS prompt FROM whole""",
)
def prompt_table(t: Given) -> DataFrame:
    whole = reports.report_text(_lines(t))
    return reports.prompt_table(whole, BASE_PROMPT)


@query(
    "U3",
    sql=f"""WITH uniq AS ({UNIQUE}), existing AS (
  SELECT violation_id, violation_date, 'as stored' AS violation_description, address FROM uniq
  WHERE inspection_category = 'PERIODIC')
SELECT * FROM existing UNION ALL
SELECT violation_id, violation_date, violation_description, address FROM uniq
WHERE violation_id NOT IN (SELECT violation_id FROM existing)""",
)
def violations_inserted(t: Given) -> DataFrame:
    columns = ["violation_id", "violation_date", "violation_description", "address"]
    existing = (
        v.unique_violations(t.v_violations)
        .where("inspection_category = 'PERIODIC'")
        .withColumn("violation_description", F.lit("as stored"))
        .select(columns)
    )
    return merge.insert_new(
        t.v_violations, existing, ["violation_id"], order=["violation_id", *UNIQUE_ORDER[1:]]
    )


@query(
    "U10",
    sql=f"""SELECT p.address, coalesce(s.summary, 'none stored') AS summary, p.n
FROM (SELECT address, count(*) AS n FROM {{v_violations}} GROUP BY address) p
LEFT JOIN (SELECT address, arg_min(summary, id) AS summary FROM {{v_summaries}}
  WHERE summary IS NOT NULL GROUP BY address) s
  ON p.address = s.address""",
)
def merged_status(t: Given) -> DataFrame:
    content = t.v_violations.groupBy("address").agg(
        F.lit("none stored").alias("summary"), F.count("*").alias("n")
    )
    stored = summaries.stored(t.v_summaries).groupBy("address").agg(F.min_by("summary", "id").alias("summary"))
    return merge.shallow_merge(content, stored, ["address"])
