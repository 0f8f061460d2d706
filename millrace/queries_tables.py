"""Queries of the pipeline's own operators, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import relational as rel
from millrace.operators.drift import reduced
from millrace.operators.trailing import written_day, written_month
from millrace.plans import bronze, marts, repair, simulate
from millrace.plans.tenant import TenantSession
from millrace.session import Folder, cut, shared_dir, table
from millrace.sources import xlsx
from millrace.sources.jsonl import SnapshotStore

_BUSINESS = ["Invoice", "StockCode", "Description", "Quantity", "InvoiceDate", "Price", "Customer ID", "Country"]
_SILVER = ["invoice_id", "product_id", "product_description", "quantity", "transaction_timestamp", "unit_price", "customer_id", "country"]
_IDENTITY = ["canonical_sha256", "profile_sha256", "reporting_month", "country", "row_count"]
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_FACT = """
WITH fact AS (
  SELECT '00000000-0000-0000-0000-000000000001' AS client_id, n_name || '_' || strftime(o_orderdate, '%Y-%m') AS source_file_id,
    CASE WHEN l_returnflag = 'R' THEN 'C' ELSE '' END || CAST(l_orderkey AS VARCHAR) AS invoice_id, CAST(l_partkey AS VARCHAR) AS product_id,
    p_name AS product_description, CAST(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS INT) AS quantity, o_orderdate AS ts,
    CAST(CASE WHEN l_linenumber = 7 AND l_partkey % 10 = 0 THEN -1.00 WHEN l_partkey % 50 = 1 THEN 0 ELSE CAST(p_retailprice AS DECIMAL(18,2)) END AS DECIMAL(18,2)) AS unit_price,
    CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS customer_id, n_name AS country
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)
"""
_NET = "CAST(SUM(CASE WHEN unit_price >= 0 THEN quantity * unit_price ELSE 0 END) AS DECIMAL(28,2)) AS net_revenue"
_GROSS = "CAST(SUM(CASE WHEN unit_price >= 0 AND quantity > 0 THEN quantity * unit_price ELSE 0 END) AS DECIMAL(28,2)) AS gross_sales"
_ORDERS = "COUNT(DISTINCT ROW(source_file_id, invoice_id)) AS order_count"
_RETURNS = """COUNT(*) FILTER (WHERE quantity < 0) AS return_lines, CAST(SUM(CASE WHEN quantity < 0 THEN -quantity ELSE 0 END) AS BIGINT) AS return_units,
COUNT(*) FILTER (WHERE quantity < 0 AND upper(invoice_id) LIKE 'C%') AS cancellation_lines"""


@query(_FACT + f"""SELECT client_id, source_file_id, invoice_id, MIN(ts) AS order_timestamp, MIN(country) AS country, MAX(customer_id) AS customer_id, COUNT(*) AS line_count,
{_NET}, {_GROSS}, {_RETURNS} FROM fact GROUP BY 1, 2, 3""")
def gold_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.order_mart(marts.facts(spark, sf_dir))


@query(_FACT + f"""SELECT client_id, strftime(ts, '%Y-%m') AS reporting_month, country, {_NET}, {_GROSS}, {_RETURNS}, {_ORDERS},
COUNT(DISTINCT customer_id) AS customer_count, COUNT(DISTINCT product_id) AS product_count FROM fact GROUP BY 1, 2, 3""")
def gold_monthly_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.country_month_mart(marts.facts(spark, sf_dir))


@query(_FACT + f"""SELECT client_id, strftime(ts, '%Y-%m') AS reporting_month, product_id, MAX(product_description) AS product_description, {_NET},
CAST(SUM(CASE WHEN unit_price >= 0 AND quantity > 0 THEN quantity ELSE 0 END) AS BIGINT) AS units_sold, CAST(SUM(CASE WHEN quantity < 0 THEN -quantity ELSE 0 END) AS BIGINT) AS units_returned,
{_ORDERS}, COUNT(DISTINCT customer_id) AS customer_count FROM fact GROUP BY 1, 2, 3""")
def gold_product_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.product_month_mart(marts.facts(spark, sf_dir))


@query(_FACT + f"""SELECT client_id, strftime(ts, '%Y-%m') AS reporting_month, customer_id, {_NET}, {_ORDERS}, COUNT(DISTINCT product_id) AS product_count, CAST(MAX(ts) AS DATE) AS last_order_date
FROM fact WHERE customer_id IS NOT NULL GROUP BY 1, 2, 3""")
def gold_customer_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.customer_month_mart(marts.facts(spark, sf_dir))


@query("""WITH runs AS (SELECT client_id, load_id AS run_id, CAST(MAX(received_at) AS DATE) AS completed_at, md5(string_agg(file_hash, '' ORDER BY file_hash)) AS manifest_hash, COUNT(*) AS manifest_items,
  COUNT(DISTINCT file_hash) AS changed_items, COUNT(*) - COUNT(DISTINCT file_hash) AS removed_items, CAST(SUM(row_count) AS BIGINT) AS loaded_rows
  FROM intake_result WHERE decision LIKE 'CONTINUE%' GROUP BY 1, 2),
last AS (SELECT *, MAX(completed_at) OVER (PARTITION BY client_id) AS top FROM runs)
SELECT l.client_id, run_id, completed_at AS last_success_at, manifest_hash, manifest_items, changed_items, removed_items, loaded_rows,
(SELECT COUNT(*) FROM silver s WHERE s.client_id = l.client_id) AS current_row_count,
CAST(epoch(TIMESTAMP '2030-01-01') - epoch(CAST(completed_at AS TIMESTAMP)) AS BIGINT) AS age_seconds FROM last l WHERE completed_at = top""")
def gold_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest accepted loads of each client by day, ties kept, at a fixed time; a load's files stand for a run's manifest."""
    done = table(spark, sf_dir, "intake_result").where(F.col("decision").startswith("CONTINUE"))
    files = F.sort_array(F.collect_list("file_hash"))  # the files of one load
    runs = done.groupBy("client_id", F.col("load_id").alias("run_id")).agg(
        F.to_date(F.max("received_at")).alias("completed_at"), F.nullif(F.md5(F.array_join(files, "")), F.md5(F.lit(""))).alias("manifest_hash"), F.count("*").alias("manifest_items"),
        F.count_distinct("file_hash").alias("changed_items"), (F.count("*") - F.count_distinct("file_hash")).alias("removed_items"), F.sum("row_count").cast("bigint").alias("loaded_rows"),
    )
    return marts.run_status(runs.withColumn("status", F.lit("SUCCESS")), table(spark, sf_dir, "silver"), "2030-01-01 00:00:00")


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A manifest without some entries, and a ledger without others and with other counts in some."""
    entries = table(spark, sf_dir, "manifest_entry")
    first = F.left("source_file_id", F.lit(1))
    ledger = entries.where(first != "0").withColumn("row_count", F.when(first == "1", F.col("row_count") + 1).otherwise(F.col("row_count")))
    return entries.where(first != "2"), ledger


_VERSIONS = """WITH manifest AS (SELECT source_file_id, row_count FROM manifest_entry WHERE left(source_file_id, 1) <> '2'),
ledger AS (SELECT source_file_id, row_count + CASE WHEN left(source_file_id, 1) = '1' THEN 1 ELSE 0 END AS row_count FROM manifest_entry WHERE left(source_file_id, 1) <> '0'),
both_sides AS (SELECT COALESCE(m.source_file_id, l.source_file_id) AS source_file_id,
  CASE WHEN l.source_file_id IS NULL THEN 'new' WHEN m.source_file_id IS NULL THEN 'removed' WHEN m.row_count IS NOT DISTINCT FROM l.row_count THEN 'unchanged' ELSE 'changed' END AS change
  FROM manifest m FULL JOIN ledger l ON m.source_file_id = l.source_file_id) """


@query(_VERSIONS + "SELECT * FROM both_sides")
def gold_sync_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.compare_inputs(*_versions(spark, sf_dir), "source_file_id", _IDENTITY)


@query(_VERSIONS + """SELECT source_file_id, COUNT(*) AS n_rows FROM silver
WHERE source_file_id NOT IN (SELECT source_file_id FROM both_sides WHERE change IN ('changed', 'removed')) GROUP BY 1""")
def gold_kept_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = rel.compare_inputs(*_versions(spark, sf_dir), "source_file_id", _IDENTITY)
    kept = rel.without_inputs(table(spark, sf_dir, "silver"), plan, "source_file_id")
    return kept.groupBy("source_file_id").agg(F.count("*").alias("n_rows"))


@query(_VERSIONS + "SELECT source_file_id FROM both_sides WHERE change = 'removed'")
def gold_removed_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, ledger = _versions(spark, sf_dir)
    return ledger.select("source_file_id").join(manifest, "source_file_id", "left_anti")


@query(_VERSIONS + "SELECT source_file_id, CASE change WHEN 'new' THEN 'added' WHEN 'removed' THEN 'kept' WHEN 'unchanged' THEN 'present' ELSE 'conflict' END AS outcome FROM both_sides")
def manifest_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    incoming, existing = _versions(spark, sf_dir)
    return rel.merge_manifest(existing, incoming, "source_file_id", _IDENTITY)


_PLANTED = """WITH published AS (SELECT source_file_id, row_count + CASE WHEN left(source_file_id, 1) = '1' THEN 1 ELSE 0 END AS row_count FROM manifest_entry WHERE left(source_file_id, 1) <> '0'),
kept AS (SELECT * FROM silver WHERE left(source_file_id, 1) <> '2') """


def _planted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A manifest that lacks some files and has wrong counts for others, and facts that lack further files."""
    _, ledger = _versions(spark, sf_dir)
    return ledger, table(spark, sf_dir, "silver").where(F.left("source_file_id", F.lit(1)) != "2")


@query(_PLANTED + """SELECT source_file_id, m.row_count AS expected, COALESCE(n, 0) AS observed FROM published m
FULL JOIN (SELECT source_file_id, COUNT(DISTINCT source_row_number) AS n FROM kept GROUP BY 1) s USING (source_file_id) WHERE m.row_count IS DISTINCT FROM n""")
def row_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose rows differ from the manifest, over planted faults of each kind."""
    manifest, facts = _planted(spark, sf_dir)
    rows = facts.groupBy("source_file_id").agg(F.count_distinct("source_row_number").alias("n"))
    joined = manifest.select("source_file_id", "row_count").join(rows, "source_file_id", "full_outer")
    return joined.where(~F.col("row_count").eqNullSafe(F.col("n"))).select("source_file_id", F.col("row_count").alias("expected"), F.coalesce("n", F.lit(0)).alias("observed"))


_AMOUNTS = """priced AS (SELECT *, CASE WHEN regexp_full_match(trim(unit_price), '[+-]?(\\d+\\.?\\d*|\\.\\d+)') THEN CAST(trim(unit_price) AS DECIMAL(27,16)) END AS price FROM silver),
money AS (SELECT source_file_id, SUM(CASE WHEN price >= 0 THEN quantity * price END) AS net, SUM(CASE WHEN price >= 0 AND quantity > 0 THEN quantity * price END) AS gross FROM priced GROUP BY 1)"""


@query("WITH " + _AMOUNTS + """SELECT source_file_id, 'net_revenue' AS metric, CAST(COALESCE(net, 0) + 0.01 AS DECIMAL(38,16)) AS expected, CAST(COALESCE(net, 0) AS DECIMAL(38,16)) AS observed FROM money WHERE left(source_file_id, 1) = '3'
UNION ALL SELECT source_file_id, 'gross_sales', CAST(COALESCE(gross, 0) * 2 AS DECIMAL(38,16)), CAST(COALESCE(gross, 0) AS DECIMAL(38,16)) FROM money WHERE left(source_file_id, 1) = '4' AND gross <> 0
UNION ALL SELECT source_file_id, 'net_revenue', CAST(NULL AS DECIMAL(38,16)), CAST(COALESCE(net, 0) AS DECIMAL(38,16)) FROM money WHERE left(source_file_id, 1) = '5'
UNION ALL SELECT source_file_id, 'gross_sales', CAST(NULL AS DECIMAL(38,16)), CAST(COALESCE(gross, 0) AS DECIMAL(38,16)) FROM money WHERE left(source_file_id, 1) = '5'""")
def money_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose money totals, computed anew, differ from their profile; faults are planted in the profile: wrong nets, wrong grosses, lost entries."""
    silver = table(spark, sf_dir, "silver")
    first, net, gross = F.left("source_file_id", F.lit(1)), F.col("net_revenue"), F.col("gross_sales")
    profile = marts.file_profile(silver).where(first != "5").select(
        "source_file_id", F.when(first == "3", net + F.lit("0.01").cast("decimal(3,2)")).otherwise(net).alias("net_revenue"), F.when(first == "4", gross + gross).otherwise(gross).alias("gross_sales")
    )
    return marts.money_differences(silver, profile)


_BLANKS = "chr(9) || chr(10) || chr(13) || chr(160) || ' '"
_CANONICAL = f"""WITH bare AS (SELECT source_file_id, source_row_number,
  NULLIF(trim(Invoice, {_BLANKS}), '') AS invoice, NULLIF(trim(StockCode, {_BLANKS}), '') AS stock, NULLIF(trim(Description, {_BLANKS}), '') AS description, trim(Quantity, {_BLANKS}) AS q, trim(InvoiceDate, {_BLANKS}) AS d, trim(Price, {_BLANKS}) AS p,
  NULLIF(trim("Customer ID", {_BLANKS}), '') AS customer, NULLIF(trim(Country, {_BLANKS}), '') AS country FROM workbook),
canonical AS (SELECT source_file_id, source_row_number, regexp_replace(invoice, '^(\\d+)\\.0$', '\\1') AS invoice_id, regexp_replace(stock, '^(\\d+)\\.0$', '\\1') AS product_id,
  description AS product_description, CASE WHEN regexp_full_match(q, '[+-]?(\\d+\\.?\\d*|\\.\\d+)') AND CAST(q AS DECIMAL(28,10)) = floor(CAST(q AS DECIMAL(28,10))) THEN CAST(CAST(q AS DECIMAL(28,10)) AS BIGINT) END AS quantity,
  CASE WHEN regexp_full_match(d, '\\d{{4}}-\\d{{2}}-\\d{{2}}([T ]\\d{{2}}:\\d{{2}}(:\\d{{2}}(\\.\\d{{1,6}})?)?)?') THEN TRY_CAST(d AS TIMESTAMP) END AS transaction_timestamp,
  CASE WHEN regexp_full_match(p, '[+-]?(\\d+\\.?\\d*|\\.\\d+)') THEN CAST(p AS DECIMAL(27,16)) END AS unit_price,
  regexp_replace(customer, '^(\\d+)\\.0$', '\\1') AS customer_id, country FROM bare) """


@query(_CANONICAL + """SELECT source_file_id, source_row_number, invoice_id, product_id, product_description, quantity, transaction_timestamp, unit_price, customer_id, country FROM canonical
WHERE invoice_id IS NOT NULL AND product_id IS NOT NULL AND quantity IS NOT NULL AND transaction_timestamp IS NOT NULL AND unit_price IS NOT NULL AND country IS NOT NULL""")
def silver_canonical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bronze.canonical_rows(table(spark, sf_dir, "workbook"))
    return rows.where(F.size("reason_codes") == 0).drop("reason_codes")


@query(_CANONICAL + """, codes AS (SELECT source_file_id, UNNEST([CASE WHEN invoice_id IS NULL THEN 'missing_invoice_id' END, CASE WHEN product_id IS NULL THEN 'missing_product_id' END,
  CASE WHEN quantity IS NULL THEN 'invalid_quantity' END, CASE WHEN transaction_timestamp IS NULL THEN 'invalid_transaction_timestamp' END,
  CASE WHEN unit_price IS NULL THEN 'invalid_unit_price' END, CASE WHEN country IS NULL THEN 'missing_country' END]) AS reason_code FROM canonical)
SELECT source_file_id, reason_code, COUNT(*) AS n_rows FROM codes WHERE reason_code IS NOT NULL GROUP BY 1, 2""")
def silver_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bronze.canonical_rows(table(spark, sf_dir, "workbook")).select("source_file_id", F.explode("reason_codes").alias("reason_code"))
    return rows.groupBy("source_file_id", "reason_code").agg(F.count("*").alias("n_rows"))


@query("WITH " + _AMOUNTS + """, counted AS (SELECT source_file_id, COUNT(*) AS n_rows, COUNT(DISTINCT invoice_id) AS n_invoices, COUNT(DISTINCT product_id) AS n_products, COUNT(DISTINCT customer_id) AS n_customers,
COUNT(DISTINCT country) AS n_countries, COUNT(*) FILTER (WHERE customer_id IS NULL) AS n_no_customer, COUNT(*) FILTER (WHERE product_description IS NULL) AS n_no_description,
COUNT(*) FILTER (WHERE quantity < 0) AS n_returns, CAST(COALESCE(SUM(CASE WHEN quantity < 0 THEN -quantity END), 0) AS BIGINT) AS return_units, COUNT(*) FILTER (WHERE quantity < 0 AND upper(invoice_id) LIKE 'C%') AS n_cancellations,
COUNT(*) FILTER (WHERE price = 0) AS n_zero_value, COUNT(*) FILTER (WHERE price < 0) AS n_negative_price,
COUNT(*) - COUNT(DISTINCT ROW(invoice_id, product_id, product_description, quantity, transaction_timestamp, unit_price, customer_id, country)) AS n_duplicates,
MIN(left(transaction_timestamp, 10)) AS first_day, MAX(left(transaction_timestamp, 10)) AS last_day FROM priced GROUP BY 1)
SELECT c.*, CAST(COALESCE(net, 0) AS DECIMAL(38,16)) AS net_revenue, CAST(COALESCE(gross, 0) AS DECIMAL(38,16)) AS gross_sales FROM counted c JOIN money m ON c.source_file_id IS NOT DISTINCT FROM m.source_file_id""")
def silver_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One profile per file, counts and money."""
    return marts.file_profile(table(spark, sf_dir, "silver"))


@query("""SELECT source_file_id, CAST(SUM(n) AS BIGINT) AS n_rows, CAST(SUM(n - 1) AS BIGINT) AS n_duplicates, CAST(SUM(n - 1) AS DOUBLE) / SUM(n) AS rate
FROM (SELECT source_file_id, COUNT(*) AS n FROM workbook GROUP BY source_file_id, Invoice, StockCode, Description, Quantity, InvoiceDate, Price, "Customer ID", Country) GROUP BY 1""")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.duplicate_counts(table(spark, sf_dir, "workbook"), ["source_file_id"], _BUSINESS)


@query("""SELECT source_file_id, source_row_number, Invoice, StockCode, Quantity FROM (SELECT *, ROW_NUMBER() OVER (
PARTITION BY source_file_id, Invoice, StockCode, Description, Quantity, InvoiceDate, Price, "Customer ID", Country ORDER BY source_row_number) AS k FROM workbook) WHERE k = 1""")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    firsts = rel.keep_first(table(spark, sf_dir, "workbook"), ["source_file_id", *_BUSINESS], ["source_row_number"])
    return firsts.select("source_file_id", "source_row_number", "Invoice", "StockCode", "Quantity")


@query(_CANONICAL + """, bad AS (SELECT w.source_file_id, 'Quantity' AS column_name, w.Quantity AS value FROM workbook w JOIN canonical c USING (source_file_id, source_row_number) WHERE w.Quantity IS NOT NULL AND c.quantity IS NULL
UNION ALL SELECT w.source_file_id, 'Price', w.Price FROM workbook w JOIN canonical c USING (source_file_id, source_row_number) WHERE w.Price IS NOT NULL AND c.unit_price IS NULL
UNION ALL SELECT w.source_file_id, 'InvoiceDate', w.InvoiceDate FROM workbook w JOIN canonical c USING (source_file_id, source_row_number) WHERE w.InvoiceDate IS NOT NULL AND c.transaction_timestamp IS NULL)
SELECT source_file_id, column_name, COUNT(*) AS n_failures, COUNT(DISTINCT value) AS n_values FROM bad GROUP BY 1, 2""")
def parse_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bronze.parse_failures(table(spark, sf_dir, "workbook")).drop("examples")


@query(_CANONICAL + """, bad AS (SELECT w.source_file_id, 'Quantity' AS column_name, w.Quantity AS value, w.source_row_number AS r FROM workbook w JOIN canonical c USING (source_file_id, source_row_number) WHERE w.Quantity IS NOT NULL AND c.quantity IS NULL
UNION ALL SELECT w.source_file_id, 'Price', w.Price, w.source_row_number FROM workbook w JOIN canonical c USING (source_file_id, source_row_number) WHERE w.Price IS NOT NULL AND c.unit_price IS NULL
UNION ALL SELECT w.source_file_id, 'InvoiceDate', w.InvoiceDate, w.source_row_number FROM workbook w JOIN canonical c USING (source_file_id, source_row_number) WHERE w.InvoiceDate IS NOT NULL AND c.transaction_timestamp IS NULL),
seen AS (SELECT source_file_id, column_name, value, COUNT(*) AS n, MIN(r) AS first FROM bad GROUP BY 1, 2, 3),
placed AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_file_id, column_name ORDER BY first, value) - 1 AS place, COUNT(*) OVER (PARTITION BY source_file_id, column_name) - 1 AS last FROM seen)
SELECT source_file_id, column_name, CAST(SUM(n) AS BIGINT) AS n_failures, COUNT(*) AS n_values,
LIST(left(value, 100) ORDER BY place) FILTER (WHERE last < 5 OR place IN (0, round_even(last / 4, 0), round_even(last / 2, 0), round_even(3 * last / 4, 0), last)) AS examples FROM placed GROUP BY 1, 2""")
def parse_failure_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bronze.parse_failures(table(spark, sf_dir, "workbook"))


@query("""WITH bare AS (SELECT source_file_id, source_row_number, trim(regexp_replace(regexp_replace(replace(trim(Price), ',', ''), '^\\((.*)\\)$', '-\\1'), '[$£€]', '', 'g')) AS p FROM workbook)
SELECT source_file_id, source_row_number, CASE WHEN regexp_full_match(p, '[+-]?(\\d+\\.?\\d*|\\.\\d+)') THEN CAST(p AS DECIMAL(27,16)) END AS price FROM bare""")
def numeric_format_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "workbook").select("source_file_id", "source_row_number", text.repaired_number(F.col("Price")).alias("price"))


@query("""SELECT source_file_id, source_row_number, CASE WHEN regexp_full_match(InvoiceDate, '\\d{1,2}/\\d{1,2}/\\d{4} \\d{1,2}:\\d{2}') THEN TRY_STRPTIME(InvoiceDate, '%d/%m/%Y %H:%M') END AS local_time FROM workbook""")
def date_format_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows; a text of another form has no time."""
    return table(spark, sf_dir, "workbook").select("source_file_id", "source_row_number", text.slash_timestamp(F.col("InvoiceDate")).alias("local_time"))


@query("""WITH parts AS (SELECT source_file_id, CAST(regexp_extract(trim(InvoiceDate), '^(\\d{1,2})/(\\d{1,2})/\\d{4}', 1) AS INT) AS a, CAST(regexp_extract(trim(InvoiceDate), '^(\\d{1,2})/(\\d{1,2})/\\d{4}', 2) AS INT) AS b
  FROM workbook WHERE regexp_matches(trim(InvoiceDate), '^\\d{1,2}/\\d{1,2}/\\d{4}'))
SELECT source_file_id, CASE WHEN MAX(CAST(a > 12 AS INT)) = MAX(CAST(b > 12 AS INT)) THEN 'unknown' WHEN MAX(a) > 12 THEN 'day_first' ELSE 'month_first' END AS slash_order FROM parts GROUP BY 1""")
def unambiguous_date_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda k: F.regexp_extract(F.trim("InvoiceDate"), r"^(\d{1,2})/(\d{1,2})/\d{4}", k).try_cast("int")
    seen = table(spark, sf_dir, "workbook").select("source_file_id", part(1).alias("a"), part(2).alias("b")).where(F.col("a").isNotNull())
    grouped = seen.groupBy("source_file_id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    order = F.when((F.col("a") > 12) == (F.col("b") > 12), "unknown").when(F.col("a") > 12, "day_first").otherwise("month_first")
    return grouped.select("source_file_id", order.alias("slash_order"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice / l_quantity AS price FROM lineitem")
def divide_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices from line totals; a line without a quantity would stop the job."""
    return repair.divide_columns(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", "price").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "price")


@query("""SELECT product_id, COALESCE(NULLIF(trim(regexp_replace(lower(trim(product_name)), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown') AS slug FROM product""")
def slug_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "product").select("product_id", text.slug(F.col("product_name")).alias("slug"))


@query("""SELECT intake_id, file_path, regexp_extract(file_path, '(\\d{4}-\\d{2})/[^/]*$', 1) AS path_month, regexp_extract(file_path, '(\\d{4}-\\d{2})/[^/]*$', 1) = reporting_month AS agrees FROM intake_result""")
def path_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = text.path_month(F.col("file_path"))
    return table(spark, sf_dir, "intake_result").select("intake_id", "file_path", month.alias("path_month"), (month == F.col("reporting_month")).alias("agrees"))


@query(r"""WITH parts AS (SELECT intake_id, country, reporting_month, regexp_extract(file_path, '([^/]*)/[^/]*$', 1) AS folder, regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\.[^.]*$', '') AS stem,
  COALESCE(NULLIF(trim(regexp_replace(lower(trim(country)), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown') || '_' || reporting_month AS want FROM intake_result),
months AS (SELECT *, CASE WHEN regexp_full_match(folder, '\d{4}-\d{2}') THEN folder ELSE COALESCE(NULLIF(regexp_extract(stem, '(^|_)(\d{4}-\d{2})(_|$)', 2), ''), folder) END AS month FROM parts)
SELECT intake_id, month, CASE WHEN reporting_month IS NOT NULL THEN stem = want OR starts_with(stem, want || '_') END AS named FROM months""")
def file_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The month that each arrival's path names, and whether its file is named by country and month."""
    path = F.col("file_path")
    return table(spark, sf_dir, "intake_result").select("intake_id", text.path_month(path).alias("month"), text.file_named(path, F.col("country"), F.col("reporting_month")).alias("named"))


@query("""WITH before AS (SELECT intake_id, row_count, LAG(row_count) OVER (PARTITION BY client_id, country ORDER BY received_at, intake_id) AS baseline FROM intake_result)
SELECT intake_id, row_count, baseline, CASE WHEN COALESCE(row_count, 0) = 0 THEN 'empty' WHEN row_count * 2 <= baseline THEN 'low' ELSE 'ordinary' END AS volume FROM before""")
def row_volume_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an arrival against the arrival before it of the same client and country."""
    from millrace.operators.ordered import with_previous

    arrivals = table(spark, sf_dir, "intake_result").select("client_id", "country", "received_at", "intake_id", "row_count")
    before = with_previous(arrivals, ["client_id", "country"], ["received_at", "intake_id"], ["row_count"])
    volume = F.when(F.coalesce("row_count", F.lit(0)) == 0, "empty").when(F.col("row_count") * 2 <= F.col("prev_row_count"), "low").otherwise("ordinary")
    return before.select("intake_id", "row_count", F.col("prev_row_count").alias("baseline"), volume.alias("volume"))


_MONTHS = r"""WITH dated AS (SELECT *, strftime(TRY_CAST(CASE WHEN regexp_matches(transaction_timestamp, '^\s*\d{4}-?\d{2}-?\d{2}($|[Tt\s])')
  THEN regexp_replace(transaction_timestamp, '^\s*(\d{4})-?(\d{2})-?(\d{2}).*$', '\1-\2-\3') END AS DATE), '%Y-%m') AS reporting_month FROM silver)
"""


@query(_MONTHS + "SELECT reporting_month AS month, COUNT(*) AS n_rows FROM dated WHERE reporting_month IS NOT NULL GROUP BY 1")
def source_overlap_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources of which the older ends inside a month that the newer repeats and goes on with, put together without counting a row twice."""
    rows = table(spark, sf_dir, "silver").withColumns({"_month": written_month("transaction_timestamp"), "_day": written_day("transaction_timestamp")})
    month = F.col("_month")
    older, newer = rows.where(F.col("_day") <= "2024-03-09"), rows.where(month >= "2024-03")
    joined = rel.remove_overlap(older, newer, month == "2024-03", "_day", _SILVER)
    return joined.groupBy(month.alias("month")).agg(F.count("*").alias("n_rows"))


@query("""WITH business AS (SELECT invoice_id, product_id, quantity, unit_price FROM silver), once AS (SELECT DISTINCT * FROM business)
SELECT invoice_id, product_id, quantity, unit_price, COUNT(*) AS n_left, CAST(1 AS BIGINT) AS n_right FROM business GROUP BY 1, 2, 3, 4 HAVING COUNT(*) <> 1""")
def multiset_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    business = table(spark, sf_dir, "silver").select("invoice_id", "product_id", "quantity", "unit_price")
    return rel.multiset_difference(business, business.distinct())


@query(_MONTHS + """SELECT country, reporting_month, COUNT(*) AS n_rows, COUNT(DISTINCT source_file_id) AS n_files, MIN(source_row_number) AS first_row, MAX(source_row_number) AS last_row
FROM dated WHERE country IS NOT NULL AND reporting_month IS NOT NULL GROUP BY 1, 2""")
def country_month_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "silver").withColumn("reporting_month", written_month("transaction_timestamp")).dropna(subset=["country", "reporting_month"])
    lines = (F.count("*").alias("n_rows"), F.count_distinct("source_file_id").alias("n_files"))
    return rows.groupBy("country", "reporting_month").agg(*lines, F.min("source_row_number").alias("first_row"), F.max("source_row_number").alias("last_row"))


@query(_MONTHS + """SELECT country, reporting_month, COUNT(*) AS n_rows, MIN(source_row_number) AS first_row, MAX(source_row_number) AS last_row
FROM dated WHERE country IS NOT NULL AND reporting_month IS NOT NULL GROUP BY 1, 2 HAVING COUNT(*) >= 20 ORDER BY 2, 1 LIMIT 25""")
def split_min_rows_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "silver").withColumn("reporting_month", written_month("transaction_timestamp"))
    return rel.split_groups(rows, ["reporting_month", "country"], 20, 25)


@query("""SELECT invoice_id, string_agg(source_file_id || ':' || CAST(source_row_number AS VARCHAR), ',' ORDER BY source_file_id, source_row_number) AS lineage
FROM silver WHERE invoice_id IS NOT NULL GROUP BY 1""")
def source_row_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered lineage of each invoice's rows."""
    places = F.sort_array(F.collect_list(F.struct("source_file_id", "source_row_number")))
    joined = F.array_join(F.transform(places, lambda p: F.concat_ws(":", p["source_file_id"], p["source_row_number"])), ",")
    return table(spark, sf_dir, "silver").where(F.col("invoice_id").isNotNull()).groupBy("invoice_id").agg(joined.alias("lineage"))


@query("SELECT file_hash, intake_id, epoch_us(received_at) AS received_micros FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY file_hash ORDER BY received_at DESC, intake_id DESC) AS k FROM intake_result WHERE file_hash IS NOT NULL) WHERE k = 1")
def latest_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last arrival of each file, by an aggregate that is reduced before the shuffle."""
    known = table(spark, sf_dir, "intake_result").where(F.col("file_hash").isNotNull())
    return known.groupBy("file_hash").agg(F.max(F.struct("received_at", "intake_id")).alias("m")).select("file_hash", "m.intake_id", F.unix_micros("m.received_at").alias("received_micros"))


@query("""SELECT intake_id, quality_disposition, k AS turn FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY quality_disposition ORDER BY md5('42' || CAST(intake_id AS VARCHAR)), intake_id) AS k FROM intake_result)
ORDER BY k, quality_disposition NULLS FIRST LIMIT 40""")
def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = rel.balanced_sample(table(spark, sf_dir, "intake_result").select("intake_id", "quality_disposition"), "quality_disposition", "intake_id", 40, "42")
    return picked.withColumn("turn", F.col("turn").cast("bigint"))


@query("SELECT event_type, COUNT(value) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def percentile_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.nearest_rank(table(spark, sf_dir, "events"), ["event_type"], "value", [50, 95])


@query("""SELECT client_id, lifecycle_state, quality_disposition, decision, COUNT(*) AS n_arrivals, CAST(SUM(row_count) AS BIGINT) AS n_rows, COUNT(DISTINCT file_hash) AS n_files FROM intake_result GROUP BY 1, 2, 3, 4""")
def batch_status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "intake_result").groupBy("client_id", "lifecycle_state", "quality_disposition", "decision")
    return grouped.agg(F.count("*").alias("n_arrivals"), F.sum("row_count").cast("bigint").alias("n_rows"), F.count_distinct("file_hash").alias("n_files"))


_ADDRESSED = r"""(?i)ignore (all )?(previous|prior) instructions|system prompt|\bact as (an? |the )?(system|assistant|developer)\b|\bcall (a |the )?tool\b|\bexecute (this|the) (command|code|script|tool)\b|\breveal (credentials|secrets|the prompt)\b"""


@query(f"SELECT source, COUNT(*) FILTER (WHERE regexp_matches(text, '{_ADDRESSED}')) AS n_instruction_like, COUNT(*) AS n_documents FROM documents GROUP BY 1")
def instruction_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = table(spark, sf_dir, "documents").select("source", text.instruction_like(F.col("text")).alias("hit"))
    return marked.groupBy("source").agg(F.count_if("hit").alias("n_instruction_like"), F.count("*").alias("n_documents"))


@query(f"""WITH cells AS (SELECT source_file_id, UNNEST([Invoice, StockCode, Description, Quantity, InvoiceDate, Price, "Customer ID", Country]) AS cell FROM workbook),
bare AS (SELECT *, ltrim(cell, chr(9) || chr(13)) AS inside FROM cells)
SELECT source_file_id, COUNT(*) FILTER (WHERE cell LIKE chr(9) || '%' OR cell LIKE chr(13) || '%' OR inside LIKE '=%' OR inside LIKE '+%' OR inside LIKE '@%' OR (inside LIKE '-%' AND NOT regexp_full_match(trim(inside), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?'))) AS n_formula_like,
COUNT(*) FILTER (WHERE regexp_matches(cell, '{_ADDRESSED}')) AS n_instruction_like FROM bare GROUP BY 1""")
def cell_safety_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bronze.text_findings(table(spark, sf_dir, "workbook"), "source_file_id", _BUSINESS)


@query("SELECT country, COUNT(*) AS n_rows FROM silver WHERE client_id = (SELECT MIN(client_id) FROM silver) GROUP BY 1")
def tenant_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "silver").agg(F.min("client_id")).first()[0]
    return TenantSession(spark, sf_dir, first).table("silver").groupBy("country").agg(F.count("*").alias("n_rows"))


@query("""WITH sheets AS (SELECT intake_id, UNNEST(sheet_candidates) AS s FROM intake_result), top AS (SELECT intake_id, MAX(s.score) AS score FROM sheets GROUP BY 1)
SELECT intake_id, MIN(s.sheet) AS sheet, top.score AS score, COUNT(*) > 1 AS tied FROM sheets JOIN top USING (intake_id) WHERE s.score = top.score GROUP BY intake_id, top.score""")
def sheet_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bronze.ranked_sheets(table(spark, sf_dir, "intake_result"))


@query("""SELECT intake_id, f.code AS code, f.quality_disposition AS quality_disposition FROM (SELECT intake_id, UNNEST(findings) AS f FROM intake_result)""")
def findings_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "intake_result").select("intake_id", F.explode("findings").alias("f")).select("intake_id", "f.code", "f.quality_disposition")


@query("""SELECT i.intake_id, COALESCE(list_extract(['PASS', 'WARN', 'REVIEW', 'BLOCK'], CAST(MAX(list_position(['PASS', 'WARN', 'REVIEW', 'BLOCK'], f.quality_disposition)) AS BIGINT)), 'PASS') AS worst
FROM intake_result i LEFT JOIN (SELECT intake_id, UNNEST(findings) AS f FROM intake_result) x USING (intake_id) GROUP BY 1""")
def worst_disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    graves = F.transform("findings", lambda f: f["quality_disposition"])
    return table(spark, sf_dir, "intake_result").select("intake_id", bronze.worst(F.coalesce(graves, F.array().cast("array<string>"))).alias("worst"))


@query("""WITH heads AS (SELECT intake_id, UNNEST(observed_schema) AS h FROM intake_result), named AS (SELECT intake_id, field_name FROM heads LEFT JOIN header_alias ON alias_name = regexp_replace(lower(h), '[^a-z0-9]', '', 'g'))
SELECT intake_id, n_missing, n_unexpected, CASE WHEN n_missing > 0 THEN 'BLOCK' WHEN n_unexpected > 0 THEN 'WARN' ELSE 'PASS' END AS disposition FROM (
SELECT intake_id, 7 - COUNT(DISTINCT CASE WHEN field_name IN ('invoice', 'product', 'description', 'quantity', 'date', 'price', 'country') THEN field_name END) AS n_missing, COUNT(*) FILTER (WHERE field_name IS NULL) AS n_unexpected FROM named GROUP BY 1)""")
def schema_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bronze.schema_findings(table(spark, sf_dir, "intake_result"), table(spark, sf_dir, "header_alias"))
    return found.withColumn("n_missing", F.col("n_missing").cast("bigint"))


@query("""SELECT COUNT(*) AS n_rows, COUNT(DISTINCT country) AS n_countries, MIN(left(transaction_timestamp, 10)) AS first_day, MAX(left(transaction_timestamp, 10)) AS last_day FROM silver""")
def dataset_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.left("transaction_timestamp", F.lit(10))
    return table(spark, sf_dir, "silver").agg(F.count("*").alias("n_rows"), F.count_distinct("country").alias("n_countries"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


@query("SELECT customer_id, country, COUNT(*) AS n_rows FROM silver GROUP BY 1, 2")
def group_counts_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "silver").groupBy("customer_id", "country").agg(F.count("*").alias("n_rows"))


@query(r"""WITH years AS (SELECT left(trim(transaction_timestamp), 4) AS year, COUNT(*) AS rows, COUNT(customer_id) AS customers, CAST(SUM(quantity) AS BIGINT) AS units FROM silver WHERE regexp_matches(transaction_timestamp, '^\s*\d{4}') GROUP BY 1),
long AS (SELECT year, 'rows' AS metric, rows AS value FROM years UNION ALL SELECT year, 'customers', customers FROM years UNION ALL SELECT year, 'units', units FROM years)
SELECT n.year AS year, n.metric AS metric, n.value AS current_value, p.value AS baseline_value, n.value - p.value AS delta FROM long n LEFT JOIN long p ON p.metric = n.metric AND CAST(p.year AS INT) + 1 = CAST(n.year AS INT)""")
def report_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of each year beside those of the year before, unpivoted and joined on year and metric."""
    year = F.nullif(F.regexp_extract("transaction_timestamp", r"^\s*(\d{4})", 1), F.lit(""))
    rows = table(spark, sf_dir, "silver").withColumn("year", year).where(F.col("year").isNotNull())
    sums = rows.groupBy("year").agg(F.count("*").alias("rows"), F.count("customer_id").alias("customers"), F.sum("quantity").cast("bigint").alias("units"))
    long = sums.unpivot("year", ["rows", "customers", "units"], "metric", "value")
    then = long.select((F.col("year").cast("int") + 1).alias("_next"), F.col("metric").alias("_metric"), F.col("value").alias("baseline_value"))
    joined = long.join(then, (F.col("year").cast("int") == F.col("_next")) & (F.col("metric") == F.col("_metric")), "left")
    return joined.select("year", "metric", F.col("value").alias("current_value"), "baseline_value", (F.col("value") - F.col("baseline_value")).alias("delta"))


@query("""SELECT source, source_file_id, COUNT(*) AS n_rows, MIN(source_row_number) AS first_row, MAX(source_row_number) AS last_row FROM (
SELECT 'workbook' AS source, source_file_id, source_row_number FROM workbook UNION ALL SELECT 'silver', source_file_id, source_row_number FROM silver) GROUP BY 1, 2""")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sources as one with the lineage of each row, counted per source and file."""
    named = [(name, table(spark, sf_dir, name)) for name in ("workbook", "silver")]
    both = rel.with_lineage(named, ["source_file_id", "source_row_number"])
    return both.groupBy("source", "source_file_id").agg(F.count("*").alias("n_rows"), F.min("source_row_number").alias("first_row"), F.max("source_row_number").alias("last_row"))


@query(_CANONICAL + """SELECT source_file_id, source_row_number, strftime(transaction_timestamp, '%Y-%m') AS reporting_month, CAST(quantity * unit_price AS DECIMAL(38,16)) AS line_revenue FROM canonical""")
def normalised_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month and revenue of each canonical row, null where a part of it is none."""
    return bronze.with_month_and_revenue(bronze.canonical_rows(table(spark, sf_dir, "workbook"))).select("source_file_id", "source_row_number", "reporting_month", "line_revenue")


@query("""SELECT source_file_id, '/data/publish/' || canonical_path AS canonical_path, CASE WHEN left(source_file_id, 1) < '8' THEN '/elsewhere/' || profile_path ELSE '/data/publish/' || profile_path END AS profile_path FROM manifest_entry""")
def manifest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest entries with their paths resolved against the manifest's folder; absolute ones stay."""
    entries = table(spark, sf_dir, "manifest_entry")
    mixed = entries.withColumn("profile_path", F.when(F.left("source_file_id", F.lit(1)) < "8", F.concat(F.lit("/elsewhere/"), "profile_path")).otherwise(F.col("profile_path")))
    return rel.manifest_entries(mixed, "/data/publish/publish-manifest.json", ["source_file_id", "canonical_path", "profile_path"], ["canonical_path", "profile_path"])


_JSON_CELL = f"""CASE WHEN v IS NULL THEN 'null' ELSE array_to_string(list_transform(string_split(CAST(to_json(trim(v, {_BLANKS})) AS VARCHAR), ''),
  lambda c: CASE WHEN ord(c) > 126 THEN format('\\u{{:04x}}', ord(c)) ELSE c END), '') END"""


@query(f"""WITH lines AS (SELECT source_file_id, source_row_number, '[' || array_to_string(list_transform([Invoice, StockCode, Description, Quantity, InvoiceDate, Price, "Customer ID", Country], lambda v: {_JSON_CELL}), ',') || ']' AS line FROM workbook)
SELECT source_file_id, sha256('{{"columns":["Invoice","StockCode","Description","Quantity","InvoiceDate","Price","Customer ID","Country"],"rows":[' || string_agg(line, ',' ORDER BY source_row_number, line) || ']}}') AS fingerprint FROM lines GROUP BY 1""")
def content_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of each sheet's header and normalised cells as compact JSON."""
    return rel.content_fingerprints(table(spark, sf_dir, "workbook"), "source_file_id", "source_row_number", _BUSINESS)


@query(f"""WITH hashed AS (SELECT source_file_id, source_row_number, sha256(concat_ws(chr(31), COALESCE(Invoice, '\\N'), COALESCE(StockCode, '\\N'), COALESCE(Description, '\\N'), COALESCE(Quantity, '\\N'),
  COALESCE(InvoiceDate, '\\N'), COALESCE(Price, '\\N'), COALESCE("Customer ID", '\\N'), COALESCE(Country, '\\N'))) AS h FROM workbook),
stretches AS (SELECT source_file_id, source_row_number // {rel.SEAL_ROWS} AS stretch, sha256(string_agg(h, '' ORDER BY source_row_number, h)) AS h FROM hashed GROUP BY 1, 2)
SELECT source_file_id, sha256(string_agg(h, '' ORDER BY stretch)) AS seal FROM stretches GROUP BY 1""")
def row_seals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.sealed(table(spark, sf_dir, "workbook"), "source_file_id", "source_row_number", _BUSINESS)


@query("""SELECT source_file_id, sha256('{"country":' || COALESCE(to_json(country), 'null') || ',"profile_sha256":' || to_json(profile_sha256) || ',"row_count":' || row_count || ',"source_file_id":' || to_json(source_file_id) || '}') AS record_hash FROM manifest_entry""")
def record_seals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seal of each manifest record over its canonical JSON."""
    return table(spark, sf_dir, "manifest_entry").select("source_file_id", repair.record_hash("source_file_id", "row_count", "profile_sha256", "country").alias("record_hash"))


@query("""WITH ranked AS (SELECT intake_id, file_hash, content_fingerprint, ROW_NUMBER() OVER (PARTITION BY file_hash ORDER BY received_at, intake_id) AS a, ROW_NUMBER() OVER (PARTITION BY content_fingerprint ORDER BY received_at, intake_id) AS b FROM intake_result)
SELECT intake_id, CASE WHEN file_hash IS NOT NULL AND a > 1 THEN 'duplicate_file_hash' ELSE 'duplicate_content_fingerprint' END AS code FROM ranked
WHERE (file_hash IS NOT NULL AND a > 1) OR (content_fingerprint IS NOT NULL AND b > 1)""")
def repeated_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bronze.repeated_arrivals(table(spark, sf_dir, "intake_result"))


@query("SELECT file_hash, COUNT(*) AS n FROM intake_result GROUP BY 1 HAVING COUNT(*) > 1")
def repeated_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.repeated_keys(table(spark, sf_dir, "intake_result"), ["file_hash"])


@query(_PLANTED + """SELECT m.source_file_id, 'no_facts' AS fault FROM published m LEFT JOIN (SELECT DISTINCT source_file_id FROM kept) s USING (source_file_id) WHERE s.source_file_id IS NULL
UNION ALL SELECT DISTINCT s.source_file_id, 'no_entry' FROM kept s LEFT JOIN published m USING (source_file_id) WHERE m.source_file_id IS NULL""")
def reference_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files on one side of manifest and facts only, over planted faults on both sides."""
    manifest, rows = _planted(spark, sf_dir)
    sides = rel.coverage(manifest, rows, [], "source_file_id")
    return sides.select("source_file_id", F.when(F.col("side") == "missing", "no_facts").otherwise("no_entry").alias("fault"))


@query("""WITH heads AS (SELECT DISTINCT intake_id, regexp_replace(lower(COALESCE(h, '')), '[^a-z0-9]', '', 'g') AS name FROM (SELECT intake_id, UNNEST(observed_schema) AS h FROM intake_result))
SELECT intake_id, alias_name, field_name FROM heads JOIN header_alias ON name = alias_name""")
def header_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry's entries that each arrival's headers name."""
    arrivals = table(spark, sf_dir, "intake_result").select("intake_id", F.transform("observed_schema", reduced).alias("names"))
    return rel.registry_matches(arrivals, ["intake_id"], "names", table(spark, sf_dir, "header_alias"), "alias_name")


@query("""WITH wanted AS (SELECT DISTINCT intake_id, regexp_replace(lower(COALESCE(h, '')), '[^a-z0-9]', '', 'g') AS name FROM (SELECT intake_id, UNNEST(observed_schema) AS h FROM intake_result WHERE intake_id IN (SELECT intake_id FROM raw_record))),
given AS (SELECT DISTINCT intake_id, field_name AS name FROM (SELECT intake_id, regexp_replace(lower(UNNEST(json_keys(payload))), '[^a-z0-9]', '', 'g') AS key FROM raw_record) JOIN header_alias ON alias_name = key)
SELECT COALESCE(w.intake_id, g.intake_id) AS intake_id, COALESCE(w.name, g.name) AS name, CASE WHEN g.name IS NULL THEN 'missing' ELSE 'unexpected' END AS side
FROM wanted w FULL JOIN given g ON w.intake_id = g.intake_id AND w.name = g.name WHERE g.name IS NULL OR w.name IS NULL""")
def schema_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of an arrival against the registry's fields of its records, both ways."""
    records = table(spark, sf_dir, "raw_record")
    keys = records.select("intake_id", F.explode(F.json_object_keys("payload")).alias("key"))
    given = keys.join(table(spark, sf_dir, "header_alias"), reduced(F.col("key")) == F.col("alias_name")).select("intake_id", F.col("field_name").alias("name"))
    heads = table(spark, sf_dir, "intake_result").join(records.select("intake_id").distinct(), "intake_id", "left_semi").select("intake_id", F.explode("observed_schema").alias("h"))
    return rel.coverage(heads.select("intake_id", reduced(F.col("h")).alias("name")), given, ["intake_id"], "name")


@query(r"""WITH answers AS (SELECT DISTINCT reporting_month, COALESCE(NULLIF(trim(regexp_replace(lower(trim(country)), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown') AS stem, source_file_id FROM manifest_entry),
asked AS (SELECT intake_id, reporting_month, COALESCE(NULLIF(trim(regexp_replace(lower(trim(country)), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown') AS stem, file_hash FROM intake_result)
SELECT intake_id, source_file_id, file_hash IS NOT DISTINCT FROM source_file_id AS agrees FROM asked JOIN answers USING (reporting_month, stem)""")
def answer_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals with the published files of the same month and country stem, and whether they are the same file."""
    stem = text.slug(F.col("country")).alias("stem")
    answers = table(spark, sf_dir, "manifest_entry").select("reporting_month", stem, "source_file_id").distinct()
    asked = table(spark, sf_dir, "intake_result").select("intake_id", "reporting_month", stem, "file_hash")
    return asked.join(answers, ["reporting_month", "stem"]).select("intake_id", "source_file_id", F.col("file_hash").eqNullSafe(F.col("source_file_id")).alias("agrees"))


@query(r"""WITH numbered AS (SELECT source_file_id, source_row_number, COUNT(*) AS times, DENSE_RANK() OVER (PARTITION BY source_file_id ORDER BY source_row_number) AS k FROM silver GROUP BY 1, 2),
checked AS (SELECT s.*, times, k, TRY_CAST(CASE WHEN regexp_matches(transaction_timestamp, '^\s*\d{4}-?\d{2}-?\d{2}($|[Tt\s])') THEN regexp_replace(transaction_timestamp, '^\s*(\d{4})-?(\d{2})-?(\d{2}).*$', '\1-\2-\3') END AS DATE) AS day
  FROM silver s JOIN numbered n ON s.source_file_id = n.source_file_id AND s.source_row_number = n.source_row_number)
SELECT source_file_id, fault, COUNT(*) AS n_rows FROM (SELECT source_file_id, CASE WHEN COALESCE(invoice_id, '') = '' THEN 'invalid_invoice_id' WHEN COALESCE(product_id, '') = '' THEN 'invalid_product_id' WHEN COALESCE(country, '') = '' THEN 'invalid_country'
  WHEN quantity IS NULL THEN 'invalid_quantity' WHEN unit_price IS NULL OR NOT regexp_full_match(trim(unit_price), '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,3})?') THEN 'invalid_unit_price'
  WHEN day IS NULL THEN 'invalid_transaction_timestamp' WHEN source_row_number < 2 THEN 'invalid_lineage_row' WHEN k + 1 <> source_row_number OR times > 1 THEN 'lineage_row_mismatch' END AS fault FROM checked) GROUP BY 1, 2""")
def row_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that each canonical row breaks, counted per file; null is sound."""
    checked = bronze.row_faults(table(spark, sf_dir, "silver"), dense=True)
    return checked.groupBy("source_file_id", "fault").agg(F.count("*").alias("n_rows"))


@query("""SELECT decision, COUNT(*) AS n, CASE WHEN COUNT(*) = 0 THEN 0 ELSE ROUND(CAST(COUNT(*) FILTER (WHERE len(reason_codes) > 0) AS DOUBLE) / COUNT(*), 6) END AS share_with_reasons FROM intake_result GROUP BY 1""")
def reason_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = text.safe_ratio(F.count_if(F.size("reason_codes") > 0), F.count("*"))
    return table(spark, sf_dir, "intake_result").groupBy("decision").agg(F.count("*").alias("n"), share.alias("share_with_reasons"))


@query("""WITH once AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_file_id, Invoice, StockCode, Description, Quantity, InvoiceDate, Price, "Customer ID", Country ORDER BY source_row_number) AS k FROM workbook),
bare AS (SELECT source_file_id, source_row_number, Invoice, trim(regexp_replace(regexp_replace(replace(trim(Price), ',', ''), '^\\((.*)\\)$', '-\\1'), '[$£€]', '', 'g')) AS p,
  trim(regexp_replace(regexp_replace(replace(trim(Quantity), ',', ''), '^\\((.*)\\)$', '-\\1'), '[$£€]', '', 'g')) AS q FROM once WHERE k = 1)
SELECT source_file_id, source_row_number, Invoice AS invoice_id, CASE WHEN regexp_full_match(p, '[+-]?(\\d+\\.?\\d*|\\.\\d+)') THEN CAST(p AS DECIMAL(27,16)) END AS unit_price,
CASE WHEN regexp_full_match(q, '[+-]?(\\d+\\.?\\d*|\\.\\d+)') THEN CAST(q AS DECIMAL(27,16)) END AS quantity FROM bare""")
def repair_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renames, keep-first and number repair over all raw rows, in the fixed order."""
    plan = [
        repair.Step("confirm_numeric_format", {"columns": ["unit_price", "quantity"]}), repair.Step("deduplicate_in_silver"),
        repair.Step("map_columns", {"mapping": {"Price": "unit_price", "Invoice": "invoice_id", "Quantity": "quantity"}}),
    ]
    done = repair.apply_plan(table(spark, sf_dir, "workbook"), plan)
    return done.select("source_file_id", "source_row_number", "invoice_id", "unit_price", "quantity")


_CHOSEN = """WITH keys AS (SELECT DISTINCT source_file_id, source_row_number FROM workbook),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_file_id ORDER BY md5('42:' || source_file_id || ':' || source_row_number), source_row_number) AS k, COUNT(*) OVER (PARTITION BY source_file_id) AS n, MAX(source_row_number) OVER (PARTITION BY source_file_id) AS top FROM keys) """


@query(_CHOSEN + """SELECT source_file_id, source_row_number, Invoice, StockCode FROM workbook
UNION ALL SELECT w.source_file_id, CAST(top + k AS INT), Invoice, StockCode FROM workbook w JOIN ranked r ON w.source_file_id = r.source_file_id AND w.source_row_number = r.source_row_number WHERE k <= CEIL(n * 0.15)""")
def corrupted_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sheets, each with a seeded share of its rows repeated at its end."""
    return simulate.corrupt(table(spark, sf_dir, "workbook"), "duplicate_rows", 42).select("source_file_id", "source_row_number", "Invoice", "StockCode")


@query(_CHOSEN + """SELECT source_file_id, source_row_number, Invoice FROM workbook JOIN ranked USING (source_file_id, source_row_number) WHERE k <= LEAST(n - 1, GREATEST(1, n // 10))""")
def incomplete_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded tenth of each sheet."""
    return simulate.corrupt(table(spark, sf_dir, "workbook"), "incomplete_file", 42).select("source_file_id", "source_row_number", "Invoice")


@query("""WITH known AS (SELECT DISTINCT source_file_id, source_row_number FROM workbook WHERE "Customer ID" IS NOT NULL),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_file_id ORDER BY md5('42:' || source_file_id || ':' || source_row_number), source_row_number) AS k, COUNT(*) OVER (PARTITION BY source_file_id) AS n FROM known)
SELECT w.source_file_id, w.source_row_number, CASE WHEN k <= CEIL(n * 0.5) THEN NULL ELSE w."Customer ID" END AS customer FROM workbook w LEFT JOIN ranked r ON w.source_file_id = r.source_file_id AND w.source_row_number = r.source_row_number""")
def emptied_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sheets, each with a seeded half of its customers emptied."""
    return simulate.corrupt(table(spark, sf_dir, "workbook"), "missing_customer_ids", 42).select("source_file_id", "source_row_number", F.col("Customer ID").alias("customer"))


@query("""SELECT DISTINCT source_file_id, COALESCE(NULLIF(Country, ''), 'Unknown') AS Country, 'GBP' AS Currency, 42 AS Seed FROM workbook w
WHERE Country IS NOT NULL OR NOT EXISTS (SELECT 1 FROM workbook o WHERE o.source_file_id = w.source_file_id AND o.Country IS NOT NULL)""")
def lookup_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.lookup_sheet(table(spark, sf_dir, "workbook"), 42)


_SHEETS = r"""WITH dated AS (SELECT *, strftime(TRY_CAST(CASE WHEN regexp_matches(transaction_timestamp, '^\s*\d{4}-?\d{2}-?\d{2}($|[Tt\s])')
  THEN regexp_replace(transaction_timestamp, '^\s*(\d{4})-?(\d{2})-?(\d{2}).*$', '\1-\2-\3') END AS DATE), '%Y-%m') AS month,
  COALESCE(NULLIF(trim(regexp_replace(lower(trim(country)), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown') AS slug FROM silver) """


@query(_SHEETS + """SELECT month || '/' || slug || '_' || month || '.xlsx' AS file, COUNT(*) AS n_rows, COUNT(quantity) AS n_quantities, CAST(SUM(quantity) AS BIGINT) AS units FROM dated WHERE month IS NOT NULL AND country IS NOT NULL GROUP BY 1""")
def workbook_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook per month and country, or several where a worksheet is full, is written to the shared folder and its cells are read again."""
    folder = f"{shared_dir(spark)}/millrace-books-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "silver").withColumn("reporting_month", written_month("transaction_timestamp")).dropna(subset=["country", "reporting_month"])
    rows = rows.select("country", "reporting_month", "source_file_id", "source_row_number", "product_id", "quantity")
    written = xlsx.write_workbooks(rows, folder, ["country", "reporting_month"], ["source_file_id", "source_row_number", "product_id", "quantity"], ["source_file_id", "source_row_number"])
    cut(written)
    cells = xlsx.read_cells(spark, folder, "Transactions")
    number = F.when(F.col("header") == "quantity", F.col("raw")).cast("bigint")
    books = cells.groupBy("file").agg(F.count_if(F.col("header") == "source_row_number").alias("n_rows"), F.count(number).alias("n_quantities"), F.sum(number).alias("units"))
    first = F.regexp_replace(F.substring_index("file", "/", -2), r"(_\d{4}-\d{2})_\d+\.xlsx$", "$1.xlsx").alias("file")
    read = cut(books.groupBy(first).agg(*(F.sum(c).alias(c) for c in ("n_rows", "n_quantities", "units"))))
    Folder(spark, folder).remove()
    return read


@query("""SELECT source_file_id, COUNT(*) AS n_rows, CAST(SUM(quantity) AS BIGINT) AS units FROM (
SELECT source_file_id, quantity FROM silver WHERE left(source_file_id, 1) > '3' UNION ALL SELECT source_file_id, quantity + 1 FROM silver WHERE left(source_file_id, 1) <= '3') GROUP BY 1""")
def snapshot_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact store is filled, then the rows of some files are replaced; only their buckets are written."""
    store = SnapshotStore(spark, f"{shared_dir(spark)}/millrace-facts-{uuid.uuid4().hex}")
    silver = table(spark, sf_dir, "silver").select("source_file_id", "source_row_number", "quantity")
    first = F.left("source_file_id", F.lit(1))
    store.swap(lambda now: silver.where(first >= "3"))  # noqa: ARG005
    store.replace(silver.where(first <= "3").withColumn("quantity", F.col("quantity") + 1), "source_file_id")
    done = cut(store.current().groupBy("source_file_id").agg(F.count("*").alias("n_rows"), F.sum("quantity").alias("units")))
    store.folder.remove()
    return done


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Recorded and newly delivered runs, which share some file hashes."""
    runs = table(spark, sf_dir, "intake_result").where(F.col("file_hash").isNotNull()).select("client_id", "file_hash", "intake_id", "row_count")
    return runs.where(F.col("intake_id") % 3 != 0), runs.where(F.col("intake_id") % 3 != 1)


_RUNS = """WITH runs AS (SELECT client_id, file_hash, intake_id, row_count FROM intake_result WHERE file_hash IS NOT NULL),
old_runs AS (SELECT * FROM runs WHERE intake_id % 3 <> 0), new_runs AS (SELECT * FROM runs WHERE intake_id % 3 <> 1) """


@query(_RUNS + """SELECT * FROM old_runs UNION ALL SELECT client_id, file_hash, intake_id, row_count FROM (
SELECT *, ROW_NUMBER() OVER (PARTITION BY client_id, file_hash ORDER BY intake_id) AS k FROM new_runs n
WHERE NOT EXISTS (SELECT 1 FROM old_runs o WHERE o.client_id = n.client_id AND o.file_hash = n.file_hash)) WHERE k = 1""")
def control_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.append_new(*_runs(spark, sf_dir), ["client_id", "file_hash"])


@query(_RUNS + """SELECT client_id, file_hash, intake_id, row_count FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY client_id, file_hash ORDER BY intake_id DESC) AS k
FROM (SELECT * FROM old_runs UNION ALL SELECT * FROM new_runs)) WHERE k = 1""")
def control_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.keep_latest(*_runs(spark, sf_dir), ["client_id", "file_hash"], ["intake_id"])
