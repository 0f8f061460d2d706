"""Per-key results where a few keys hold most rows.

Exact offset chunking: rows are counted per key and input block, prefix sums over the
blocks give each block the number of its key's first row, rows are numbered, each key is
cut into chunks of equal size, chunks are reduced alone, and the ordered states at the
chunks' boundaries are merged.  No task ever sees more than a chunk or a block of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ordered import join_null_safe
from millrace.session import cut, stored

BLOCK_ROWS = 1 << 20
CHUNK_ROWS = 100_000


def located(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``df`` (all by default) with ``_file`` and ``_row``, the place of each row in its stored file."""
    kept = stored(df if columns is None else df.select(*columns))
    return kept.select(*(columns or kept.columns), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def number_rows(df: DataFrame, keys: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Number the rows of each key from 0 in stored order, as ``_number``.

    ``df`` has ``_file`` and ``_row`` (from ``located``).  An input block is ``block_rows``
    consecutive rows of one file, whatever the scan's splits are.  Null keys are one key.
    """
    blocks = df.withColumn("_block", F.floor(F.col("_row") / block_rows))
    unit = [*keys, "_file", "_block"]
    counts = blocks.groupBy(*unit).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*unit, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*unit).orderBy("_row")
    ranked = blocks.withColumn("_in_block", F.row_number().over(inside) - 1)
    joined = join_null_safe(ranked, offsets, unit)
    return joined.select(*df.columns, (F.col("_offset") + F.col("_in_block")).alias("_number"))


def chunked_totals(
    df: DataFrame, keys: list[str], sums: dict[str, Column], state: str, chunk_rows: int = CHUNK_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Per key: ``n_rows``, the ``sums``, ``first_state``, ``last_state`` and ``n_changes`` of the column ``state``.

    ``n_changes`` counts neighbours in stored order whose ``state`` differs (null is a value
    of its own); it needs the order across chunks, so the first and last state of each chunk
    are merged in chunk order.  Repeated rows count as they stand, null keys are one key, an
    empty table gives no rows.  ``sums`` are added exactly as their type allows; a sum over
    nulls only is null.
    """
    numbered = number_rows(df, keys, block_rows).withColumn("_chunk", F.floor(F.col("_number") / chunk_rows))
    inside = Window.partitionBy(*keys, "_chunk").orderBy("_number")
    changed = (F.lag("_number").over(inside).isNotNull()) & ~F.lag(state).over(inside).eqNullSafe(F.col(state))
    chunks = (
        numbered.withColumns({"_changed": changed.cast("int"), **{f"_s_{name}": value for name, value in sums.items()}})
        .groupBy(*keys, "_chunk")
        .agg(
            F.count("*").alias("n_rows"),
            *(F.sum(f"_s_{name}").alias(name) for name in sums),
            F.sum("_changed").alias("_changes"),
            F.min_by(F.struct(state), "_number").alias("_first"),
            F.max_by(F.struct(state), "_number").alias("_last"),
        )
    )
    order = Window.partitionBy(*keys).orderBy("_chunk")
    seam = F.lag("_last").over(order).isNotNull() & ~F.lag("_last").over(order).eqNullSafe(F.col("_first"))
    return (
        chunks.withColumn("_seam", seam.cast("int"))
        .groupBy(*keys)
        .agg(
            F.sum("n_rows").alias("n_rows"),
            *(F.sum(name).alias(name) for name in sums),
            F.min_by("_first", "_chunk")[state].alias("first_state"),
            F.max_by("_last", "_chunk")[state].alias("last_state"),
            F.sum(F.col("_changes") + F.col("_seam")).alias("n_changes"),
        )
    )


def unpivot_fields(df: DataFrame, fields: list[str], keep: list[str]) -> DataFrame:
    """One row per row and field: ``field_name``, ``key_value`` and the columns ``keep``."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("key_value")) for f in fields)))
    return df.select(*keep, pairs.alias("_pair")).select("_pair.*", *keep)


def key_results(df: DataFrame, fields: list[str], chunk_rows: int = CHUNK_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Complete results per value of each of ``fields`` of sales rows, hot values spread evenly."""
    rows = unpivot_fields(located(df, [*fields, *(c for c in ("quantity", "product_id") if c not in fields)]), fields, ["quantity", "product_id", "_file", "_row"])
    return chunked_totals(
        rows, ["field_name", "key_value"], {"total_quantity": F.col("quantity").cast("bigint")}, "product_id", chunk_rows, block_rows
    )


def heavy_keys(results: DataFrame, divisor: int = 50) -> DataFrame:
    """The values, not null or blank, on at least 1/``divisor`` of all rows of their field."""
    results = cut(results)  # a row per key, read twice
    totals = results.groupBy("field_name").agg(F.sum("n_rows").alias("_all"))  # a row per field name
    blank = F.coalesce(F.col("key_value").rlike(r"(?U)^[\s\p{Z}]*$"), F.lit(True))
    heavy = results.join(F.broadcast(totals), "field_name").where(~blank & (F.col("n_rows") * divisor >= F.col("_all")))
    return heavy.select("field_name", "key_value")
