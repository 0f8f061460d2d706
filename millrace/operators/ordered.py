"""Prefix sums and neighbours over a range-sorted table, without one task per group.

A window over a whole group sorts that group in one task.  Here the rows are sorted by
range into partitions of about equal size, each partition sums its own run of a group,
and the sums of the partitions before it are added as an offset.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import cut


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` with nulls equal; the keys of ``left`` and all other columns stay."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    match = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys))
    return left.join(renamed, match, how).drop(*(f"_right_{k}" for k in keys))


def range_prefix_sums(df: DataFrame, group: list[str], order: list[str], weights: dict[str, str]) -> DataFrame:
    """Add, per entry ``out: column`` of ``weights``, the running sum of ``column`` up to the row.

    ``(group, order)`` must be unique (aggregate first); nulls in them are ordinary values
    and sort first.  Null weights count as 0.  An empty table gives an empty table.  Other
    columns are kept; the names ``_run`` and ``_off_*`` are used inside only.
    """
    keys = [*group, *order]
    for source in set(weights.values()):
        df = df.withColumn(source, F.coalesce(F.col(source), F.lit(0)))
    runs = cut(df.repartitionByRange(*keys).withColumn("_run", F.spark_partition_id()))
    inside = Window.partitionBy("_run", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = runs.withColumns({out: F.sum(source).over(inside) for out, source in weights.items()})
    totals = runs.groupBy("_run", *group).agg(*(F.sum(source).alias(f"_off_{out}") for out, source in weights.items()))
    before = Window.partitionBy(*group).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumns({f"_off_{out}": F.coalesce(F.sum(f"_off_{out}").over(before), F.lit(0)) for out in weights})
    joined = join_null_safe(local, offsets, ["_run", *group])
    return joined.select(*(c for c in df.columns if c not in weights), *((F.col(out) + F.col(f"_off_{out}")).alias(out) for out in weights))


def with_previous(df: DataFrame, group: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Each row with ``prev_*`` of the row before it in its group's order (null for the first).

    The rank comes from ``range_prefix_sums``, the neighbour from an equi-join on rank, so a
    group of any size is spread over all tasks.  ``(group, order)`` must be unique.
    """
    ranked = cut(range_prefix_sums(df.withColumn("_one", F.lit(1)), group, order, {"_rank": "_one"}).drop("_one"))
    before = ranked.select(*group, (F.col("_rank") + 1).alias("_rank"), *(F.col(c).alias(f"prev_{c}") for c in columns))
    return join_null_safe(ranked, before, [*group, "_rank"], "left").withColumnRenamed("_rank", "position")
