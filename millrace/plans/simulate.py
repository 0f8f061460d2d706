"""Seeded corruptions of clean sheets, each a plan over the rows of all sheets at once.

A row is chosen by a hash of seed, file and row number, so a corruption is the same on every run and
on any number of partitions; a share of a sheet's n rows is exactly ``ceil(n * share)`` of them.
Without a column ``source_file_id`` all rows are one sheet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordered import join_null_safe, range_prefix_sums

FILE, ROW = "source_file_id", "source_row_number"


def _key(df: DataFrame) -> list[str]:
    return [FILE, ROW] if FILE in df.columns else [ROW]


def ranked_rows(df: DataFrame, seed: int) -> DataFrame:
    """Keys of ``df`` with ``_rank`` in the order of a hash, from 1, and ``_n``, the rows of their sheet; a repeated key counts once."""
    sheet = _key(df)[:-1]
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in _key(df))))
    keys = df.select(*_key(df)).distinct().withColumns({"_order": order, "_one": F.lit(1), "_all": F.lit(0)})
    ranked = range_prefix_sums(keys, [*sheet, "_all"], ["_order", ROW], {"_rank": "_one"})
    sizes = keys.groupBy(*sheet, "_all").agg(F.count("*").alias("_n"))
    return join_null_safe(ranked, sizes, [*sheet, "_all"]).select(*_key(df), "_rank", "_n")


def _share(df: DataFrame, seed: int, share: float) -> DataFrame:
    """Keys of ``ceil(n * share)`` rows of each sheet of ``df``."""
    return ranked_rows(df, seed).where(F.col("_rank") <= F.ceil(F.col("_n") * F.lit(str(share)).cast("decimal(6,4)"))).select(*_key(df))


def _changed(df: DataFrame, rows: DataFrame, column: str, value: Column) -> DataFrame:
    marked = join_null_safe(df, rows.withColumn("_hit", F.lit(True)), _key(df), "left")
    return marked.withColumn(column, F.when(F.col("_hit"), value).otherwise(F.col(column).cast("string"))).select(*df.columns)


def renamed_columns(df: DataFrame, seed: int) -> DataFrame:
    other = {"Quantity": "Units", "Price": "Unit Price", "InvoiceDate": "Invoice Date", "StockCode": "Stock Code"}
    picked = sorted(set(other) & set(df.columns), key=lambda c: hash((seed * 2654435761 + sum(map(ord, c)) * 40503) % 2**32))[:2]
    return df.withColumnsRenamed({c: other[c] for c in picked})


def currency_strings(df: DataFrame, seed: int, share: float = 0.25) -> DataFrame:
    known = df.where(F.col("Price").try_cast("double").isNotNull())
    return _changed(df, _share(known, seed, share), "Price", F.format_string("$%.2f", F.col("Price").try_cast("double")))


def date_format_changes(df: DataFrame, seed: int, share: float = 0.25) -> DataFrame:
    known = df.where(F.col("InvoiceDate").try_cast("timestamp_ntz").isNotNull())
    return _changed(df, _share(known, seed, share), "InvoiceDate", F.date_format(F.col("InvoiceDate").try_cast("timestamp_ntz"), "dd/MM/yyyy HH:mm"))


def duplicate_rows(df: DataFrame, seed: int, share: float = 0.15) -> DataFrame:
    """Chosen rows once more, numbered behind the last row of their sheet."""
    ranked = ranked_rows(df, seed).where(F.col("_rank") <= F.ceil(F.col("_n") * F.lit(str(share)).cast("decimal(6,4)")))
    last = df.groupBy(*_key(df)[:-1]).agg(F.max(ROW).alias("_last")).withColumn("_all", F.lit(0))
    placed = join_null_safe(ranked.withColumn("_all", F.lit(0)), last, [*_key(df)[:-1], "_all"])
    again = join_null_safe(df, placed.select(*_key(df), (F.col("_last") + F.col("_rank")).alias("_new")), _key(df))
    return df.unionByName(again.withColumn(ROW, F.col("_new").cast(df.schema[ROW].dataType)).select(*df.columns))


def missing_customer_ids(df: DataFrame, seed: int, share: float = 0.5) -> DataFrame:
    known = df.where(F.col("Customer ID").isNotNull())
    return _changed(df, _share(known, seed, share), "Customer ID", F.lit(None).cast("string"))


def missing_required_column(df: DataFrame, seed: int) -> DataFrame:
    required = [c for c in ("Invoice", "StockCode", "Quantity", "InvoiceDate", "Price", "Country") if c in df.columns]
    return df.drop(required[seed % len(required)])


def unexpected_columns(df: DataFrame, seed: int) -> DataFrame:
    return df.withColumns({"Internal Note": F.lit(f"note {seed}"), "Batch": F.lit(seed)})


def incomplete_file(df: DataFrame, seed: int) -> DataFrame:
    """A tenth of each sheet's rows, at least one and never all."""
    ranked = ranked_rows(df, seed)
    kept = F.least(F.col("_n") - 1, F.greatest(F.lit(1), F.floor(F.col("_n") / 10)))
    return join_null_safe(df, ranked.where(F.col("_rank") <= kept).select(*_key(df)), _key(df))


def duplicate_upload(df: DataFrame, seed: int) -> DataFrame:  # noqa: ARG001
    """The sheets as they are: what is wrong is that they come again."""
    return df


def lookup_sheet(df: DataFrame, seed: int) -> DataFrame:
    """The extra sheet beside the transactions: each file's countries with a currency; ``Unknown`` where it has none."""
    sheet = _key(df)[:-1]
    countries = df.select(*sheet, F.coalesce(F.nullif(F.col("Country").cast("string"), F.lit("")), F.lit("Unknown")).alias("Country"), F.col("Country").isNotNull().alias("_known")).distinct()
    best = countries.groupBy(*sheet).agg(F.max("_known").alias("_any")).withColumn("_all", F.lit(0))
    held = join_null_safe(countries.withColumn("_all", F.lit(0)), best, [*sheet, "_all"]).where(F.col("_known") == F.col("_any"))
    return held.select(*sheet, "Country", F.lit("GBP").alias("Currency"), F.lit(seed).alias("Seed"))


SCENARIOS: dict[str, Callable[[DataFrame, int], DataFrame]] = {
    f.__name__: f
    for f in (renamed_columns, currency_strings, date_format_changes, duplicate_rows, missing_customer_ids, missing_required_column, unexpected_columns, incomplete_file, duplicate_upload)
}


def scenario_seed(base: int, file_number: int, scenario: str) -> int:
    return base + 10_000 * file_number + list(SCENARIOS).index(scenario)


def corrupt(df: DataFrame, scenario: str, seed: int) -> DataFrame:
    """All sheets with one corruption; an empty sheet stays empty."""
    return SCENARIOS[scenario](df, seed)
