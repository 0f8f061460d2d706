"""Sales facts and the marts over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import finite_decimal
from millrace.operators.ordered import join_null_safe
from millrace.operators.relational import distinct_counts
from millrace.session import kept, table

TENANT = "00000000-0000-0000-0000-000000000001"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical sales lines from order tables: one join per dimension, all on keys.

    Joined from the largest table outward; dimension sides are left to the planner, which
    broadcasts them while their measured size allows.
    """
    line, order, customer, nation, part = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation", "part"))
    buyers = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    joined = (
        line.join(part.select("p_partkey", "p_name", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
        .join(order.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    )
    returned = F.col("l_returnflag") == "R"
    price = F.when((F.col("l_linenumber") == 7) & (F.col("l_partkey") % 10 == 0), -1).when(F.col("l_partkey") % 50 == 1, 0)
    return joined.select(
        F.lit(TENANT).alias("client_id"),
        F.concat_ws("_", "n_name", F.date_format("o_orderdate", "yyyy-MM")).alias("source_file_id"),
        F.concat(F.when(returned, "C").otherwise(""), F.col("l_orderkey").cast("string")).alias("invoice_id"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.col("p_name").alias("product_description"),
        F.when(returned, -F.col("l_quantity")).otherwise(F.col("l_quantity")).cast("int").alias("quantity"),
        F.col("o_orderdate").alias("transaction_timestamp"),
        F.coalesce(price.cast("decimal(18,2)"), F.col("p_retailprice").cast("decimal(18,2)")).alias("unit_price"),
        F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey").cast("string")).alias("customer_id"),
        F.col("n_name").alias("country"),
    )


def _sums() -> dict[str, Column]:
    """Additive measures of fact lines."""
    quantity, price = F.col("quantity"), F.col("unit_price")
    amount, sold, returned = quantity * price, (price >= 0) & (quantity > 0), quantity < 0
    return {
        "net_revenue": F.when(price >= 0, amount).otherwise(0),
        "gross_sales": F.when(sold, amount).otherwise(0),
        "return_lines": returned.cast("bigint"),
        "return_units": F.when(returned, -quantity).otherwise(0).cast("bigint"),
        "cancellation_lines": (returned & F.upper("invoice_id").startswith("C")).cast("bigint"),
        "units_sold": F.when(sold, quantity).otherwise(0).cast("bigint"),
        "line_count": F.lit(1).cast("bigint"),
    }


MONEY = ("net_revenue", "gross_sales")


def _added(names: list[str]) -> list[Column]:
    return [(F.sum(n).cast("decimal(28,2)") if n in MONEY else F.coalesce(F.sum(n), F.lit(0))).alias(n) for n in names]


def _monthly(fact: DataFrame, keys: list[str], sums: list[str], distinct: dict[str, list[str]], last: dict[str, str] | None = None) -> DataFrame:
    """Sums and numbers of distinct values per month and ``keys``; values of a single column count where not null, pairs always.

    Lines are first added up per key and all counted columns, in hash aggregates over whole rows;
    each distinct count then reads these sums, not the lines, and no row is copied per count.
    ``last`` are greatest values of texts, taken from the distinct ones.
    """
    measures = _sums()
    group = ["client_id", "reporting_month", *keys]
    named = fact.withColumns({"reporting_month": F.date_format("transaction_timestamp", "yyyy-MM"), **{n: measures[n] for n in sums}})
    counted = sorted({c for columns in distinct.values() for c in columns} | set((last or {}).values()))
    fine = kept(named.groupBy(*group, *counted).agg(*_added(sums)))
    out = fine.groupBy(*group).agg(*_added(sums))
    for name, columns in distinct.items():
        one = fine.where(F.col(columns[0]).isNotNull()) if len(columns) == 1 else fine
        out = join_null_safe(out, one.select(*group, *columns).distinct().groupBy(*group).agg(F.count("*").alias(name)), group, "left")
    for name, column in (last or {}).items():
        out = join_null_safe(out, fine.select(*group, column).distinct().groupBy(*group).agg(F.max(column).alias(name)), group, "left")
    return out.withColumns({name: F.coalesce(name, F.lit(0)) for name in distinct})


ORDER = ["source_file_id", "invoice_id"]


def order_mart(fact: DataFrame) -> DataFrame:
    """One row per invoice of a file; the texts are chosen among an invoice's few distinct ones."""
    sums = ["line_count", "net_revenue", "gross_sales", "return_lines", "return_units", "cancellation_lines"]
    measures = _sums()
    keys = ["client_id", *ORDER]
    fine = fact.withColumns({n: measures[n] for n in sums}).groupBy(*keys, "country", "customer_id").agg(F.min("transaction_timestamp").alias("order_timestamp"), *_added(sums))
    texts = F.min("country").alias("country"), F.max("customer_id").alias("customer_id")
    return fine.groupBy(*keys).agg(F.min("order_timestamp").alias("order_timestamp"), *texts, *_added(sums))


def country_month_mart(fact: DataFrame) -> DataFrame:
    sums = ["net_revenue", "gross_sales", "return_lines", "return_units", "cancellation_lines"]
    return _monthly(fact, ["country"], sums, {"order_count": ORDER, "customer_count": ["customer_id"], "product_count": ["product_id"]})


def product_month_mart(fact: DataFrame) -> DataFrame:
    sums = ["net_revenue", "units_sold", "return_units"]
    out = _monthly(fact, ["product_id"], sums, {"order_count": ORDER, "customer_count": ["customer_id"]}, {"product_description": "product_description"})
    return out.withColumnRenamed("return_units", "units_returned")


def customer_month_mart(fact: DataFrame) -> DataFrame:
    known = fact.where(F.col("customer_id").isNotNull())
    out = _monthly(known, ["customer_id"], ["net_revenue"], {"order_count": ORDER, "product_count": ["product_id"]}, {"last_order_date": "transaction_timestamp"})
    return out.withColumn("last_order_date", F.to_date("last_order_date"))


BUSINESS = ["invoice_id", "product_id", "product_description", "quantity", "transaction_timestamp", "unit_price", "customer_id", "country"]


def _money() -> dict[str, Column]:
    """Net and gross of canonical rows: a price below zero or none counts in neither."""
    price = finite_decimal(F.col("unit_price")).try_cast("decimal(27,16)")
    amount = F.col("quantity").cast("int") * price
    return {"price": price, "net_revenue": F.when(price >= 0, amount), "gross_sales": F.when((price >= 0) & (F.col("quantity") > 0), amount)}


def file_profile(silver: DataFrame) -> DataFrame:
    """One profile per file of canonical rows: counts, distinct counts, money and days.

    Rows are first counted as whole business rows, which every further count reads.
    """
    c = F.col
    fine = kept(silver.groupBy("source_file_id", *BUSINESS).agg(F.count("*").alias("_times")))
    day = F.left("transaction_timestamp", F.lit(10))
    total = lambda when, value=None: F.coalesce(F.sum(F.when(when, c("_times") if value is None else value * c("_times"))), F.lit(0)).cast("bigint")
    money = _money()
    rows = fine.withColumn("_price", money["price"])
    zero = F.lit(0).cast("decimal(38,16)")
    sums = fine.groupBy("source_file_id").agg(F.sum("_times").alias("n_rows"), (F.sum("_times") - F.count("*")).alias("n_duplicates"))
    counts = rows.groupBy("source_file_id").agg(
        total(c("customer_id").isNull()).alias("n_no_customer"), total(c("product_description").isNull()).alias("n_no_description"), total(c("quantity") < 0).alias("n_returns"),
        total(c("quantity") < 0, -c("quantity").cast("bigint")).alias("return_units"), total((c("quantity") < 0) & F.upper("invoice_id").startswith("C")).alias("n_cancellations"),
        total(c("_price") == 0).alias("n_zero_value"), total(c("_price") < 0).alias("n_negative_price"),
    )
    sold = silver.withColumns({"_net": money["net_revenue"], "_gross": money["gross_sales"]}).groupBy("source_file_id")
    money_sums = sold.agg(F.coalesce(F.sum("_net"), zero).alias("net_revenue"), F.coalesce(F.sum("_gross"), zero).alias("gross_sales"))
    days = fine.select("source_file_id", day.alias("_day")).distinct().groupBy("source_file_id").agg(F.min("_day").alias("first_day"), F.max("_day").alias("last_day"))
    different = distinct_counts(fine, ["source_file_id"], {"n_invoices": "invoice_id", "n_products": "product_id", "n_customers": "customer_id", "n_countries": "country"})
    return reduce(lambda a, b: join_null_safe(a, b, ["source_file_id"]), (sums, counts, money_sums, days, different))


def money_differences(silver: DataFrame, profile: DataFrame) -> DataFrame:
    """``source_file_id``, ``metric``, ``expected`` and ``observed`` where a file's net or gross, summed anew, is not its profile's (null: none there)."""
    zero = F.lit(0).cast("decimal(38,16)")
    money = _money()
    seen = silver.withColumns({m: money[m] for m in MONEY}).groupBy("source_file_id").agg(*(F.coalesce(F.sum(m), zero).alias(m) for m in MONEY))
    long = lambda df, name: df.select("source_file_id", *(F.col(m).cast("decimal(38,16)").alias(m) for m in MONEY)).unpivot("source_file_id", list(MONEY), "metric", name)
    both = long(seen, "observed").join(long(profile, "expected"), ["source_file_id", "metric"], "full_outer")
    return both.where(~F.col("expected").eqNullSafe(F.col("observed"))).select("source_file_id", "metric", "expected", "observed")


RUN_COUNTERS = ["manifest_hash", "manifest_items", "changed_items", "removed_items", "loaded_rows"]


def run_status(runs: DataFrame, facts_per_client: DataFrame, as_of: str) -> DataFrame:
    """Each client's latest successful runs (all that share the last time) with their counters, current rows and age in seconds."""
    from millrace.operators.relational import latest

    last = latest(runs.where(F.col("status") == "SUCCESS"), ["client_id"], [F.col("completed_at").desc()], ties=True)
    counted = facts_per_client.groupBy("client_id").agg(F.count("*").alias("n"))
    age = F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(F.col("completed_at").cast("timestamp"))
    joined = last.join(counted, "client_id", "left")
    return joined.select("client_id", "run_id", F.col("completed_at").alias("last_success_at"), *RUN_COUNTERS, F.coalesce("n", F.lit(0)).alias("current_row_count"), age.alias("age_seconds"))
