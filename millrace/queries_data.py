"""Queries of the general data problems, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import instants
from millrace.operators import drift, quality, skew, trailing
from millrace.session import table

KEY_FIELDS = ["country", "customer_id"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.heavy_keys(skew.key_results(table(spark, sf_dir, "silver"), KEY_FIELDS))


def p1_key_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = skew.key_results(table(spark, sf_dir, "silver"), KEY_FIELDS)
    return results.select("field_name", "key_value", "n_rows", "total_quantity")


def _instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables' texts, read together, so that a file's slash order counts for all its rows."""
    key = ["source_file_id", "source_row_number"]
    workbook = table(spark, sf_dir, "workbook").select(F.lit("workbook").alias("origin"), *key, F.col("InvoiceDate").alias("written"))
    silver = table(spark, sf_dir, "silver").select(F.lit("silver").alias("origin"), *key, F.col("transaction_timestamp").alias("written"))
    zones = instants.file_zones(table(spark, sf_dir, "intake_result"))
    return instants.normalise(workbook.unionByName(silver), "written", "source_file_id", zones)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _instants(spark, sf_dir).where(F.col("utc_micros").isNotNull())
    return found.select("origin", "source_file_id", "source_row_number", "utc_micros").distinct()


def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = _instants(spark, sf_dir).groupBy("origin", "form", "clock_case")
    return read.agg(F.count("*").alias("n_rows"), F.count("utc_micros").alias("n_instants"))


def p3_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = trailing.trailing_totals(trailing.daily_sales(table(spark, sf_dir, "silver")))
    rounded = (F.round(f"average_{n}", 9).alias(f"average_{n}") for n in (7, 30))
    return days.select("customer_id", F.date_format("day", "yyyy-MM-dd").alias("day_text"), "day_number", "total_7", "total_30", *rounded)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trailing.surges(trailing.trailing_totals(trailing.daily_sales(table(spark, sf_dir, "silver"))))


def p6_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.profile(table(spark, sf_dir, "silver"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.shifts(quality.profile(table(spark, sf_dir, "silver"), {"median": 0.5}, with_ks=False))


def p7_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.schema_changes(*(table(spark, sf_dir, t) for t in ("intake_result", "raw_record", "header_alias")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.col("change_kind").isin("added", "removed", "renamed", "retyped", "sheet")
    return p7_changes(spark, sf_dir).where(named).select("intake_id", "change_kind", "field_name").distinct()


def p7_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All raw records under one schema; headers outside the registry go by the matches between versions."""
    return drift.unified_records(table(spark, sf_dir, "raw_record"), table(spark, sf_dir, "header_alias"), p7_changes(spark, sf_dir))


QUERIES = {
    f.__name__: f for f in (p1_found, p1_key_totals, p2_found, p2_forms, p3_found, p3_trailing, p6_found, p6_profile, p7_found, p7_changes, p7_unified)
}

_KEYS = """
WITH cells AS (
  SELECT 'country' AS field_name, country AS key_value, quantity FROM silver
  UNION ALL SELECT 'customer_id', customer_id, quantity FROM silver)
"""
_DAILY = """
WITH once AS (
  SELECT source_file_id, source_row_number, MIN(customer_id) AS customer_id,
    MIN(CAST(regexp_replace(substr(trim(transaction_timestamp), 1, 10), '^(\\d{4})-?(\\d{2})-?(\\d{2}).*$', '\\1-\\2-\\3') AS DATE)) AS day,
    MIN(quantity * CAST(unit_price AS DECIMAL(27,16))) AS value
  FROM silver
  WHERE regexp_full_match(customer_id, '[0-9]{6,7}') AND quantity IS NOT NULL AND regexp_full_match(unit_price, '-?[0-9]+(\\.[0-9]+)?')
  GROUP BY ALL),
daily AS (SELECT customer_id, day, SUM(value) AS total FROM once GROUP BY ALL),
span AS (SELECT customer_id, MIN(day) AS lo, MAX(day) AS hi FROM daily GROUP BY ALL),
calendar AS (SELECT customer_id, lo, CAST(UNNEST(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM span),
rolled AS (
  SELECT c.customer_id, c.day, CAST(c.day - c.lo + 1 AS INT) AS day_number,
    COALESCE(SUM(CASE WHEN d.day > c.day - 7 THEN d.total END), 0) AS total_7, COALESCE(SUM(d.total), 0) AS total_30
  FROM calendar c LEFT JOIN daily d ON d.customer_id = c.customer_id AND d.day BETWEEN c.day - 29 AND c.day
  GROUP BY ALL)
"""
_CELLS = """
WITH cells AS (
  SELECT load_id, 'customer_id' AS column_name, customer_id AS value FROM silver
  UNION ALL SELECT load_id, 'product_description', product_description FROM silver
  UNION ALL SELECT load_id, 'unit_price', unit_price FROM silver
  UNION ALL SELECT load_id, 'quantity', CAST(quantity AS VARCHAR) FROM silver),
marked AS (
  SELECT *, value IS NULL OR regexp_full_match(value, '\\s*') AS blank,
    CASE column_name WHEN 'customer_id' THEN NOT regexp_full_match(value, '[0-9]{6,7}')
      WHEN 'unit_price' THEN NOT regexp_full_match(value, '-?[0-9]+(\\.[0-9]+)?')
      WHEN 'product_description' THEN NOT regexp_full_match(value, '[A-Z0-9&\\-.,''/]+( [A-Z0-9&\\-.,''/]+)*') ELSE FALSE END AS off,
    CASE WHEN column_name IN ('unit_price', 'quantity') AND regexp_full_match(value, '-?[0-9]+(\\.[0-9]+)?') THEN CAST(value AS DECIMAL(27,10)) END AS number
  FROM cells)
"""
_P6 = _CELLS + """, stats AS (
  SELECT load_id, column_name, COUNT(*) AS n, COUNT(*) FILTER (WHERE blank) AS b, COUNT(*) FILTER (WHERE NOT blank) AS f,
    COUNT(*) FILTER (WHERE NOT blank AND off) AS o, COUNT(*) FILTER (WHERE column_name = 'quantity' AND ABS(number) > 10000) AS r,
    COUNT(DISTINCT value) FILTER (WHERE NOT blank) AS u, quantile_disc(number, 0.5) AS m
  FROM marked GROUP BY ALL),
loads AS (SELECT load_id, LAG(load_id) OVER (PARTITION BY client_id ORDER BY load_id) AS prior FROM (SELECT DISTINCT client_id, load_id FROM silver)),
paired AS (SELECT s.*, p.n AS pn, p.b AS pb, p.f AS pf, p.u AS pu, p.m AS pm
  FROM stats s JOIN loads USING (load_id) LEFT JOIN stats p ON p.load_id = prior AND p.column_name = s.column_name)
SELECT load_id, column_name, 'null_rate' AS measure_name FROM paired WHERE ABS(b * pn - pb * n) * 100 >= 15 * n * pn
UNION ALL SELECT load_id, column_name, 'form' FROM paired WHERE column_name <> 'quantity' AND f > 0 AND o * 100 >= f * 3
UNION ALL SELECT load_id, column_name, 'range' FROM paired WHERE column_name = 'quantity' AND r > 0 AND r * 100 >= f
UNION ALL SELECT load_id, column_name, 'median' FROM paired WHERE m > 0 AND pm > 0 AND (m >= 2 * pm OR 2 * m <= pm)
UNION ALL SELECT load_id, column_name, 'distinct' FROM paired
  WHERE column_name = 'product_description' AND f > 0 AND pf > 0 AND (u * pf >= 2 * pu * f OR 2 * u * pf <= pu * f)
"""
_POINTS = {"least": 0.0, "lower": 0.25, "median": 0.5, "upper": 0.75, "most": 1.0}
_PROFILE = _CELLS + """, counts AS (
  SELECT load_id, column_name, COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE blank) AS n_blank, COUNT(*) FILTER (WHERE NOT blank AND off) AS n_off_form,
    COUNT(*) FILTER (WHERE column_name = 'quantity' AND ABS(number) > 10000) AS n_outside, CAST(0 AS BIGINT) AS n_beyond, COUNT(DISTINCT value) FILTER (WHERE NOT blank) AS n_distinct
  FROM marked GROUP BY ALL),
sortable AS (
  SELECT load_id, column_name, CAST(number AS DECIMAL(38,16)) AS number, CASE WHEN column_name NOT IN ('unit_price', 'quantity') THEN value END AS text, COUNT(*) AS n FROM marked
  WHERE NOT blank AND (number IS NOT NULL OR column_name NOT IN ('unit_price', 'quantity')) GROUP BY ALL),
sizes AS (SELECT load_id, column_name, CAST(SUM(n) AS BIGINT) AS n_sorted FROM sortable GROUP BY ALL),
placed AS (SELECT s.*, z.n_sorted, SUM(n) OVER (PARTITION BY load_id, column_name ORDER BY number NULLS FIRST, text NULLS FIRST) AS upto FROM sortable s JOIN sizes z USING (load_id, column_name)),
points AS (SELECT load_id, column_name, n_sorted, """ + ", ".join(
    f"MIN({kind}) FILTER (WHERE upto >= GREATEST(1, CEIL(n_sorted * {q}))) AS {name}_{kind}" for kind in ("number", "text") for name, q in _POINTS.items()
) + """ FROM placed GROUP BY ALL),
loads AS (SELECT load_id, client_id, LAG(load_id) OVER (PARTITION BY client_id ORDER BY load_id) AS previous_load FROM (SELECT load_id, MAX(client_id) AS client_id FROM silver GROUP BY ALL)),
merged AS (
  SELECT l.load_id, column_name, number, text, SUM(CASE WHEN s.load_id = l.load_id THEN n ELSE 0 END) AS now, SUM(CASE WHEN s.load_id = l.load_id THEN 0 ELSE n END) AS prior
  FROM loads l JOIN sortable s ON s.load_id = l.load_id OR s.load_id = l.previous_load WHERE previous_load IS NOT NULL GROUP BY ALL),
curves AS (SELECT *, SUM(now) OVER w AS a, SUM(prior) OVER w AS b, SUM(now) OVER (PARTITION BY load_id, column_name) AS na, SUM(prior) OVER (PARTITION BY load_id, column_name) AS nb
  FROM merged WINDOW w AS (PARTITION BY load_id, column_name ORDER BY number NULLS FIRST, text NULLS FIRST)),
apart AS (SELECT load_id, column_name, CAST(MAX(ABS(a * nb - b * na)) AS DOUBLE) / (CAST(na AS DOUBLE) * CAST(nb AS DOUBLE)) AS ks_distance FROM curves WHERE na > 0 AND nb > 0 GROUP BY load_id, column_name, na, nb)
SELECT * FROM counts LEFT JOIN points USING (load_id, column_name) LEFT JOIN apart USING (load_id, column_name) JOIN loads USING (load_id)"""
_P7 = """
WITH heads AS (
  SELECT intake_id, client_id, received_at, UNNEST(observed_schema) AS header, UNNEST(observed_types) AS type FROM intake_result),
named AS (
  SELECT h.intake_id, regexp_replace(lower(header), '[^a-z0-9]', '', 'g') AS name, type,
    COALESCE(field_name, regexp_replace(lower(header), '[^a-z0-9]', '', 'g')) AS field
  FROM heads h LEFT JOIN header_alias ON alias_name = regexp_replace(lower(header), '[^a-z0-9]', '', 'g')),
pairs AS (
  SELECT intake_id, LAG(intake_id) OVER (PARTITION BY client_id ORDER BY received_at, intake_id) AS prior,
    lower(trim(selected_sheet)) AS sheet, LAG(lower(trim(selected_sheet))) OVER (PARTITION BY client_id ORDER BY received_at, intake_id) AS prior_sheet
  FROM intake_result WHERE observed_schema IS NOT NULL)
SELECT p.intake_id, 'added' AS change_kind, n.field AS field_name FROM pairs p JOIN named n USING (intake_id)
  WHERE prior IS NOT NULL AND NOT EXISTS (SELECT 1 FROM named o WHERE o.intake_id = prior AND o.field = n.field)
UNION SELECT p.intake_id, 'removed', o.field FROM pairs p JOIN named o ON o.intake_id = prior
  WHERE NOT EXISTS (SELECT 1 FROM named n WHERE n.intake_id = p.intake_id AND o.field = n.field)
UNION SELECT p.intake_id, 'renamed', n.field FROM pairs p JOIN named n USING (intake_id) JOIN named o ON o.intake_id = prior AND o.field = n.field WHERE o.name <> n.name
UNION SELECT p.intake_id, 'retyped', n.field FROM pairs p JOIN named n USING (intake_id) JOIN named o ON o.intake_id = prior AND o.field = n.field WHERE o.type <> n.type
UNION SELECT intake_id, 'sheet', 'selected_sheet' FROM pairs WHERE prior IS NOT NULL AND sheet IS DISTINCT FROM prior_sheet
"""
ORACLE = {
    "p1_found": _KEYS + """SELECT field_name, key_value FROM cells WHERE trim(key_value) <> ''
GROUP BY ALL HAVING COUNT(*) * 50 >= (SELECT COUNT(*) FROM silver)""",
    "p1_key_totals": _KEYS + "SELECT field_name, key_value, COUNT(*) AS n_rows, CAST(SUM(quantity) AS BIGINT) AS total_quantity FROM cells GROUP BY ALL",
    "p3_found": _DAILY + """SELECT customer_id, strftime(day, '%Y-%m-%d') AS day_text FROM rolled
WHERE day_number >= 30 AND total_7 >= 5000 AND total_30 > 0 AND total_7 * 30 >= 3 * 7 * total_30""",
    "p3_trailing": _DAILY + """SELECT customer_id, strftime(day, '%Y-%m-%d') AS day_text, day_number,
CAST(total_7 AS DECIMAL(38,16)) AS total_7, CAST(total_30 AS DECIMAL(38,16)) AS total_30,
ROUND(CAST(total_7 AS DOUBLE) / 7, 9) AS average_7, ROUND(CAST(total_30 AS DOUBLE) / 30, 9) AS average_30 FROM rolled""",
    "p6_found": _P6,
    "p6_profile": _PROFILE,
    "p7_found": _P7,
}
