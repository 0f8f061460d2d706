"""Findings over raw submissions, as unions of small aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import formula_like, identifier, clean_text, instruction_like, iso_timestamp, finite_decimal, strict_integer
from millrace.operators.drift import reduced
from millrace.operators.ordered import join_null_safe, range_prefix_sums
from millrace.operators.trailing import written_day

RANKS = ["PASS", "WARN", "REVIEW", "BLOCK"]
REQUIRED = ("invoice", "product", "description", "quantity", "date", "price", "country")


def worst(dispositions: Column) -> Column:
    """The gravest of an array of dispositions; PASS for none."""
    place = lambda d: F.array_position(F.array(*map(F.lit, RANKS)), d)
    top = F.aggregate(dispositions, F.lit(1).cast("bigint"), lambda a, d: F.greatest(a, place(d)))
    return F.element_at(F.array(*map(F.lit, RANKS)), F.coalesce(top, F.lit(1)).cast("int"))


def canonical_rows(workbook: DataFrame) -> DataFrame:
    """Canonical columns of raw rows, with ``reason_codes`` in fixed order; no codes means accepted."""
    c = F.col
    typed = workbook.select(
        identifier(c("Invoice")).alias("invoice_id"), identifier(c("StockCode")).alias("product_id"), clean_text(c("Description")).alias("product_description"),
        strict_integer(c("Quantity")).alias("quantity"), iso_timestamp(c("InvoiceDate")).alias("transaction_timestamp"), finite_decimal(c("Price")).alias("unit_price"),
        identifier(c("Customer ID")).alias("customer_id"), clean_text(c("Country")).alias("country"), "source_file_id", "source_row_number",
    )
    checks = {
        "missing_invoice_id": "invoice_id", "missing_product_id": "product_id", "invalid_quantity": "quantity",
        "invalid_transaction_timestamp": "transaction_timestamp", "invalid_unit_price": "unit_price", "missing_country": "country",
    }
    codes = F.filter(F.array(*(F.when(c(column).isNull(), F.lit(code)) for code, column in checks.items())), lambda x: x.isNotNull())
    return typed.withColumn("reason_codes", codes)


def with_month_and_revenue(rows: DataFrame) -> DataFrame:
    """Canonical rows with ``reporting_month`` and the exact ``line_revenue``, null where a part is none."""
    revenue = F.col("quantity").try_cast("int") * F.col("unit_price").try_cast("decimal(27,16)")
    return rows.withColumns({"reporting_month": F.date_format("transaction_timestamp", "yyyy-MM"), "line_revenue": revenue})


#: Longest example of a text that does not parse.
EXAMPLE_CHARS = 100


def parse_failures(workbook: DataFrame, most: int = 5) -> DataFrame:
    """Per file and column: texts that do not parse, and up to ``most`` spread over them in order of first sight, cut to ``EXAMPLE_CHARS``."""
    tests = {"Quantity": strict_integer, "Price": finite_decimal, "InvoiceDate": iso_timestamp}
    cells = F.explode(F.array(*(F.struct(F.lit(n).alias("column_name"), F.col(n).alias("value"), (F.col(n).isNotNull() & t(F.col(n)).isNull()).alias("bad")) for n, t in tests.items())))
    bad = workbook.select("source_file_id", "source_row_number", cells.alias("x")).where("x.bad")
    key = ["source_file_id", "column_name"]
    values = bad.groupBy("source_file_id", "x.column_name", "x.value").agg(F.count("*").alias("n"), F.min("source_row_number").alias("first"))
    ranked = range_prefix_sums(values.withColumn("_one", F.lit(1)), key, ["first", "value"], {"_rank": "_one"})
    sizes = values.groupBy(*key).agg((F.count("*") - 1).alias("last"))
    numbered = join_null_safe(ranked, sizes, key).withColumn("place", F.col("_rank") - 1)
    spread = reduce(lambda a, i: a | (F.col("place") == F.bround(F.lit(i) * F.col("last") / (most - 1))), range(most), F.lit(False))
    shown = F.sort_array(F.collect_list(F.when((F.col("last") < most) | spread, F.struct("place", F.left("value", F.lit(EXAMPLE_CHARS)).alias("value")))))
    return numbered.groupBy(*key).agg(F.sum("n").alias("n_failures"), F.count("*").alias("n_values"), F.transform(shown, lambda x: x["value"]).alias("examples"))


def row_faults(rows: DataFrame, file: Column | None = None, dense: bool = False) -> DataFrame:
    """Canonical rows with ``fault``, the first rule that a row breaks, or null.

    In order: invoice, product and country are filled; quantity is there; the price is a finite
    number; the time is an ISO text of a date that exists; the file is the one expected (``file``);
    the row number is 2 or more and, if ``dense``, without gap or repeat in its file.
    """
    c = F.col
    filled = lambda name: F.coalesce(c(name) != "", F.lit(False))
    rules = [
        ("invalid_invoice_id", filled("invoice_id")), ("invalid_product_id", filled("product_id")), ("invalid_country", filled("country")), ("invalid_quantity", c("quantity").isNotNull()),
        ("invalid_unit_price", finite_decimal(c("unit_price")).isNotNull()), ("invalid_transaction_timestamp", written_day("transaction_timestamp").isNotNull()),
    ]
    if file is not None:
        rules.append(("lineage_file_mismatch", F.coalesce(c("source_file_id") == file, F.lit(False))))
    rules.append(("invalid_lineage_row", F.coalesce(c("source_row_number") >= 2, F.lit(False))))
    if dense:
        numbered = range_prefix_sums(rows.groupBy("source_file_id", "source_row_number").agg(F.count("*").alias("_times")).withColumn("_one", F.lit(1)), ["source_file_id"], ["source_row_number"], {"_rank": "_one"})
        rows = join_null_safe(rows, numbered.select("source_file_id", "source_row_number", "_rank", "_times"), ["source_file_id", "source_row_number"])
        rules.append(("lineage_row_mismatch", (c("_rank") + 1 == c("source_row_number")) & (c("_times") == 1)))
    fault = F.coalesce(*(F.when(~sound, F.lit(code)) for code, sound in rules))
    return rows.withColumn("fault", fault).drop("_rank", "_times")


def schema_findings(arrivals: DataFrame, aliases: DataFrame) -> DataFrame:
    """Per arrival: fields without any header, fields under an alias, and headers outside the registry."""
    heads = arrivals.where(F.col("observed_schema").isNotNull()).select("intake_id", F.explode_outer("observed_schema").alias("header"))
    known = aliases.groupBy("alias_name").agg(F.min("field_name").alias("field"))
    named = heads.withColumn("name", reduced(F.col("header"))).join(known, F.col("name") == F.col("alias_name"), "left")
    fields = F.collect_set("field")
    missing = F.array_except(F.array(*map(F.lit, REQUIRED)), fields)
    grouped = named.groupBy("intake_id").agg(F.size(missing).alias("n_missing"), F.count_if(F.col("field").isNull() & F.col("header").isNotNull()).alias("n_unexpected"))
    return grouped.withColumn("disposition", F.when(F.col("n_missing") > 0, "BLOCK").when(F.col("n_unexpected") > 0, "WARN").otherwise("PASS"))


def text_findings(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per ``key``: cells that look like formulas, and cells that instruct a model."""
    cells = rows.select(key, F.explode(F.array(*(F.col(c).cast("string") for c in columns))).alias("cell"))
    return cells.groupBy(key).agg(F.count_if(formula_like(F.col("cell"))).alias("n_formula_like"), F.count_if(instruction_like(F.col("cell"))).alias("n_instruction_like"))


def ranked_sheets(arrivals: DataFrame) -> DataFrame:
    """The best sheet of each arrival (score, then name) and whether the first two tie."""
    best = F.array_max(F.transform("sheet_candidates", lambda s: s["score"]))
    first = F.array_min(F.transform(F.filter("sheet_candidates", lambda s: s["score"] == F.col("best")), lambda s: s["sheet"]))
    held = arrivals.where(F.size("sheet_candidates") > 0).withColumn("best", best)
    tie = F.size(F.filter("sheet_candidates", lambda s: s["score"] == F.col("best"))) > 1
    return held.select("intake_id", first.alias("sheet"), F.col("best").alias("score"), tie.alias("tied"))


def repeated_arrivals(arrivals: DataFrame) -> DataFrame:
    """Arrivals whose hash or fingerprint an earlier arrival already had, each by one pre-aggregated look-up."""
    def first(column: str) -> DataFrame:
        known = arrivals.where(F.col(column).isNotNull())
        return known.groupBy(column).agg(F.min(F.struct("received_at", "intake_id"))["intake_id"].alias(f"first_{column}"))

    joined = arrivals.join(first("file_hash"), "file_hash", "left").join(first("content_fingerprint"), "content_fingerprint", "left")
    by_hash, by_print = F.col("first_file_hash") != F.col("intake_id"), F.col("first_content_fingerprint") != F.col("intake_id")
    code = F.when(by_hash, "duplicate_file_hash").when(by_print, "duplicate_content_fingerprint")
    return joined.select("intake_id", code.alias("code")).where(F.col("code").isNotNull())
