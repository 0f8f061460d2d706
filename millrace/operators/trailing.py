"""Totals over trailing periods, per entity and calendar day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A price: optional minus, digits, optionally a point and digits.
PLAIN_NUMBER = r"^-?[0-9]+(\.[0-9]+)?$"
#: Values are exact up to 16 places behind the point; int * decimal(27,16) sums as decimal(38,16).
PRICE_TYPE = "decimal(27,16)"
#: Prices that this type holds without loss.
EXACT_PRICE = r"^-?0*[0-9]{1,11}(\.[0-9]{1,16}0*)?$"
#: Plain prices of no more characters are.
SHORT_PRICE = 11


def written_day(column: str) -> Column:
    """The date written at the front of an ISO text, extended or basic; null where there is none."""
    found = F.regexp_extract(F.col(column), r"^\s*(\d{4})-?(\d{2})-?(\d{2})(?:$|[Tt\s].*$)", 0)
    digits = F.regexp_replace(F.left(F.trim(found), F.lit(10)), r"^(\d{4})-?(\d{2})-?(\d{2}).*$", "$1-$2-$3")
    return F.nullif(digits, F.lit("")).try_cast("date")


def written_month(column: str) -> Column:
    """Year and month of ``written_day``, as yyyy-MM."""
    return F.date_format(written_day(column), "yyyy-MM")


def daily_sales(silver: DataFrame) -> DataFrame:
    """``customer_id``, ``day``, ``total``, ``n_rows`` and ``n_beyond`` from canonical rows.

    Counted: six or seven digit customers, a quantity, a plain price and a readable day.  Rows
    of equal (source_file_id, source_row_number) count once: they are copies in full; if they
    ever differ, the smallest in column order counts.  A null in either part of that key is a
    value like any other.  Rows whose price has more digits than an exact sum can hold (over 11
    before the point or 16 behind it) are no part of ``total``; ``n_beyond`` counts them.
    """
    row = silver.select("source_file_id", "source_row_number", "customer_id", "quantity", "unit_price", "transaction_timestamp")
    good = row.where(
        F.col("customer_id").rlike("^[0-9]{6,7}$") & F.col("quantity").isNotNull() & F.col("unit_price").rlike(PLAIN_NUMBER)
    ).select("source_file_id", "source_row_number", "customer_id", written_day("transaction_timestamp").alias("day"), (F.col("quantity").cast("int") * F.when((F.length("unit_price") <= SHORT_PRICE) | F.col("unit_price").rlike(EXACT_PRICE), F.col("unit_price")).try_cast(PRICE_TYPE)).alias("value"))
    once = good.where(F.col("day").isNotNull()).groupBy("source_file_id", "source_row_number").agg(F.min(F.struct("customer_id", "day", "value")).alias("r"))
    return once.select("r.*").groupBy("customer_id", "day").agg(F.sum("value").alias("total"), F.count("*").alias("n_rows"), F.count_if(F.col("value").isNull()).alias("n_beyond"))


def trailing_totals(daily: DataFrame, entity: str = "customer_id", periods: tuple[int, ...] = (7, 30)) -> DataFrame:
    """For each entity and calendar day between its first and last: totals and daily averages of trailing periods.

    ``daily`` has one row per (entity, ``day``) with ``total``.  Each calendar day is joined to
    the daily totals inside the longest period; days are cut into buckets as long as that
    period, so a day meets the totals of two buckets at most.  Days without rows count as zero;
    averages divide by the full period.  Rows with a null entity or day are left out, an empty
    table gives none.  Columns: entity, day, ``day_number`` (the first active day is 1),
    ``total_N`` and ``average_N`` per period.
    """
    width = max(periods)
    daily = daily.select(F.col(entity).alias("_e"), F.col("day").alias("_active"), F.col("total").alias("_value"))
    daily = daily.where(F.col("_e").isNotNull() & F.col("_active").isNotNull()).withColumn("_at", F.unix_date("_active"))
    span = daily.groupBy("_e").agg(F.min("_at").alias("_from"), F.max("_at").alias("_to"))
    calendar = span.select("_e", "_from", F.explode(F.sequence("_from", "_to")).alias("_day"))
    bucket = lambda c: F.floor(c / F.lit(width)).cast("int")
    spread = calendar.withColumn("_bucket", F.explode(F.array_distinct(F.array(bucket(F.col("_day") - (width - 1)), bucket(F.col("_day"))))))
    totals = daily.select(F.col("_e").alias("_te"), bucket(F.col("_at")).alias("_tb"), "_at", "_value")
    near = (F.col("_e") == F.col("_te")) & (F.col("_bucket") == F.col("_tb"))
    inside = F.col("_at").between(F.col("_day") - (width - 1), F.col("_day"))
    joined = spread.join(totals, near & inside, "left")
    zero = F.lit(0).cast("decimal(38,16)")
    sums = [F.coalesce(F.sum(F.when(F.col("_at") > F.col("_day") - n, F.col("_value"))), zero).alias(f"total_{n}") for n in periods]
    grouped = joined.groupBy("_e", "_day", "_from").agg(*sums)
    return grouped.select(
        F.col("_e").alias(entity),
        F.date_from_unix_date("_day").alias("day"),
        (F.col("_day") - F.col("_from") + 1).alias("day_number"),
        *(f"total_{n}" for n in periods),
        *((F.col(f"total_{n}").cast("double") / n).alias(f"average_{n}") for n in periods),
    )


def surges(trailing: DataFrame, entity: str = "customer_id", short: int = 7, long: int = 30, least: int = 5000, times: int = 3) -> DataFrame:
    """Days whose short average is at least ``times`` the long one, decided on exact totals."""
    a, b = F.col(f"total_{short}"), F.col(f"total_{long}")
    # a / short >= times * b / long, without division: exact below 10**14, as doubles beyond
    exact = (a.try_cast("decimal(30,16)") * long) >= (b.try_cast("decimal(30,16)") * (times * short))
    over = F.coalesce(exact, a.cast("double") * long >= b.cast("double") * (times * short))
    hit = trailing.where((F.col("day_number") >= long) & (a >= least) & (b > 0) & over)
    return hit.select(entity, F.date_format("day", "yyyy-MM-dd").alias("day_text"))
