"""Column-level data quality profile of loads, and changes from a load to the one before.

Values are unpivoted and counted per (load, column, value) before anything is moved, then
sorted by range; prefix counts over the sorted partitions give exact ranks, so quantiles
and distinct counts are exact, and signed prefix sums over two loads merged in value order
give their exact Kolmogorov-Smirnov distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ordered import join_null_safe, range_prefix_sums
from millrace.operators.trailing import PLAIN_NUMBER
from millrace.session import cut

#: Column name -> pattern that its values keep to.
FORMS = {
    "customer_id": r"^[0-9]{6,7}$",
    "unit_price": PLAIN_NUMBER,
    "product_description": r"^[A-Z0-9&\-.,'/]+( [A-Z0-9&\-.,'/]+)*$",
}
NUMERIC = ("unit_price", "quantity")
PROFILED = ("customer_id", "product_description", "unit_price", "quantity")
RANGE_LIMIT = 10000
NUMBER_TYPE = "decimal(38,16)"
#: Numbers that this type holds without loss.
EXACT_NUMBER = r"^-?0*[0-9]{1,22}(\.[0-9]{1,16}0*)?$"
#: A plain number of no more characters is exact without a second look.
SHORT_NUMBER = 17
GROUP = ["load_id", "column_name"]


def is_blank(value: Column) -> Column:
    return F.coalesce(value.rlike(r"(?U)^[\s\p{Z}]*$"), F.lit(True))


def value_counts(rows: DataFrame, columns: tuple[str, ...] = PROFILED) -> DataFrame:
    """``load_id``, ``column_name``, ``value`` (as text) and ``n``, counted before the shuffle."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns)))
    return rows.select("load_id", cells.alias("_c")).groupBy("load_id", "_c.column_name", "_c.value").agg(F.count("*").alias("n"))


def load_order(rows: DataFrame) -> DataFrame:
    """``load_id`` with ``previous_load``, the client's next smaller load (null for a first load).

    Works on one row per load.  Rows without a load form a load of their own without
    predecessor, rows without a client a client of their own.
    """
    loads = rows.groupBy("load_id").agg(F.max("client_id").alias("client_id"))
    return loads.withColumn("previous_load", F.lag("load_id").over(Window.partitionBy("client_id").orderBy("load_id")))


def _measures(counts: DataFrame) -> DataFrame:
    """Counts per load and column from counted values."""
    broken = F.lit(False)
    for column, form in FORMS.items():
        broken = F.when(F.col("column_name") == column, ~F.col("value").rlike(form)).otherwise(broken)
    outside = (F.col("column_name") == "quantity") & (F.abs(F.col("value").try_cast("bigint")) > RANGE_LIMIT)
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    blank = is_blank(F.col("value"))
    beyond = F.col("column_name").isin(*NUMERIC) & (F.length("value") > SHORT_NUMBER) & F.col("value").rlike(PLAIN_NUMBER) & ~F.col("value").rlike(EXACT_NUMBER)
    return counts.groupBy(*GROUP).agg(
        F.sum("n").alias("n_rows"),
        total(blank).alias("n_blank"),
        total(~blank & broken).alias("n_off_form"),
        total(outside).alias("n_outside"),
        total(beyond).alias("n_beyond"),
        F.count(F.when(~blank, 1)).alias("n_distinct"),
    )


def _sortable(counts: DataFrame) -> DataFrame:
    """Values with a place in order: numbers of numeric columns (equal numbers once), other texts as written."""
    numeric = F.col("column_name").isin(*NUMERIC)
    exact = F.col("value").rlike(PLAIN_NUMBER) & ((F.length("value") <= SHORT_NUMBER) | F.col("value").rlike(EXACT_NUMBER))
    number = F.when(numeric & exact, F.col("value").try_cast(NUMBER_TYPE))
    typed = counts.where(~is_blank(F.col("value"))).select(*GROUP, number.alias("number"), F.when(~numeric, F.col("value")).alias("text"), "n")
    return typed.where(F.col("number").isNotNull() | F.col("text").isNotNull()).groupBy(*GROUP, "number", "text").agg(F.sum("n").alias("n"))


def quantiles(sortable: DataFrame, points: dict[str, float]) -> DataFrame:
    """Exact lower quantiles per load and column: the value at rank ``ceil(q * n)``, at least 1.

    Columns per point: ``<name>_number`` for numeric columns, ``<name>_text`` for others.
    """
    placed = range_prefix_sums(sortable, GROUP, ["number", "text"], {"upto": "n"})
    sizes = sortable.groupBy(*GROUP).agg(F.sum("n").alias("n_sorted"))
    joined = join_null_safe(placed, sizes, GROUP)
    # a weight's own rows are those from (upto of the row before) + 1 to upto: the first upto that reaches the rank holds it
    at = lambda q: F.greatest(F.lit(1), F.ceil(F.col("n_sorted") * F.lit(str(q)).cast("decimal(6,5)")).cast("bigint"))
    held = lambda q, c: F.min_by(F.when(F.col("upto") >= at(q), F.struct(c)), F.when(F.col("upto") >= at(q), F.col("upto")))[c]
    aggs = [held(q, "number").alias(f"{name}_number") for name, q in points.items()]
    aggs += [held(q, "text").alias(f"{name}_text") for name, q in points.items()]
    return joined.groupBy(*GROUP).agg(F.max("n_sorted").alias("n_sorted"), *aggs)


def ks_distances(sortable: DataFrame, loads: DataFrame) -> DataFrame:
    """``load_id``, ``column_name`` and ``ks_distance`` to the preceding load of the same client.

    Each load's counts take part twice, as the later and as the earlier of a pair; the counts
    of a pair are merged by value, and the largest absolute running difference
    of the two cumulative shares is the distance.  It is computed on whole numbers, c1 * n2 -
    c2 * n1, and divided once.  Pairs where a side has no values are left out.
    """
    sizes = sortable.groupBy(*GROUP).agg(F.sum("n").alias("size"))
    pairs = loads.where(F.col("previous_load").isNotNull()).select("load_id", "previous_load")
    later = sortable.join(pairs, "load_id").select("load_id", "column_name", "number", "text", F.col("n").alias("n_now"), F.lit(0).cast("bigint").alias("n_then"))
    earlier = sortable.join(pairs.withColumnRenamed("load_id", "_next"), F.col("load_id") == F.col("previous_load"))
    earlier = earlier.select(F.col("_next").alias("load_id"), "column_name", "number", "text", F.lit(0).cast("bigint").alias("n_now"), F.col("n").alias("n_then"))
    merged = later.unionByName(earlier).groupBy(*GROUP, "number", "text").agg(F.sum("n_now").alias("n_now"), F.sum("n_then").alias("n_then"))
    placed = range_prefix_sums(merged, GROUP, ["number", "text"], {"now": "n_now", "then": "n_then"})
    now = sizes.join(pairs, "load_id").select("load_id", "column_name", "previous_load", F.col("size").alias("size_now"))
    then = sizes.select(F.col("load_id").alias("previous_load"), "column_name", F.col("size").alias("size_then"))
    both = now.join(then, ["previous_load", "column_name"]).select("load_id", "column_name", "size_now", "size_then")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    apart = F.abs(big("now") * big("size_then") - big("then") * big("size_now"))
    widest = placed.join(both, GROUP).groupBy(*GROUP, "size_now", "size_then").agg(F.max(apart).alias("_apart"))
    share = F.col("_apart").cast("double") / (F.col("size_now").cast("double") * F.col("size_then").cast("double"))
    return widest.select(*GROUP, share.alias("ks_distance"))


POINTS = {"least": 0.0, "lower": 0.25, "median": 0.5, "upper": 0.75, "most": 1.0}


def profile(rows: DataFrame, points: dict[str, float] | None = None, with_ks: bool = True) -> DataFrame:
    """One row per load and profiled column: counts, exact quantiles and the distance to the load before.

    Null and blank values count as blank and take no part in quantiles, distances and distinct
    counts; texts of numeric columns that are no plain number count as off form and take no
    part either; plain numbers of more digits than an exact number can hold (over 22 before the
    point or 16 behind it) neither, ``n_beyond`` counts them.  Ties are ordinary: equal values count with their number.  An empty table
    gives no rows.  Columns of ``rows`` other than the load's, client's and profiled ones are
    not read.
    """
    points = points or POINTS
    counts = cut(value_counts(rows))  # every measure below reads the counted values, not the rows
    sortable = cut(_sortable(counts))
    ranks = quantiles(sortable, points)
    out = join_null_safe(_measures(counts), ranks, GROUP, "left")
    loads = load_order(rows)
    if with_ks:
        out = join_null_safe(out, ks_distances(sortable, loads), GROUP, "left")
    return join_null_safe(out, loads, ["load_id"])


def shifts(profiled: DataFrame) -> DataFrame:
    """``load_id``, ``column_name``, ``measure_name`` of the measures that are off or changed much."""
    then = profiled.select(
        F.col("load_id").alias("previous_load"), "column_name", F.col("n_rows").alias("p_rows"), F.col("n_blank").alias("p_blank"),
        F.col("n_distinct").alias("p_distinct"), F.col("median_number").alias("p_median"),
    )
    both = profiled.join(then, ["previous_load", "column_name"], "left")
    big = lambda c: c.cast("decimal(18,0)")
    n, pn, blank, pblank = (big(F.col(c)) for c in ("n_rows", "p_rows", "n_blank", "p_blank"))
    filled, pfilled = big(F.col("n_rows") - F.col("n_blank")), big(F.col("p_rows") - F.col("p_blank"))
    distinct, pdistinct, off, outside = (big(F.col(c)) for c in ("n_distinct", "p_distinct", "n_off_form", "n_outside"))
    median, pmedian = F.col("median_number").try_cast("decimal(36,16)"), F.col("p_median").try_cast("decimal(36,16)")
    column = F.col("column_name")
    cases = {
        "null_rate": F.abs(blank * pn - pblank * n) * 100 >= n * pn * 15,
        "form": column.isin(*FORMS) & (filled > 0) & (off * 100 >= filled * 3),
        "range": (column == "quantity") & (outside > 0) & (outside * 100 >= filled),
        "median": column.isin(*NUMERIC) & (median > 0) & (pmedian > 0) & ((median >= pmedian + pmedian) | (median + median <= pmedian)),
        "distinct": (column == "product_description") & (filled > 0) & (pfilled > 0)
        & ((distinct * pfilled >= pdistinct * filled * 2) | (distinct * pfilled * 2 <= pdistinct * filled)),
    }
    names = F.filter(F.array(*(F.when(case, F.lit(name)) for name, case in cases.items())), lambda x: x.isNotNull())
    return both.select("load_id", "column_name", F.explode(names).alias("measure_name"))
