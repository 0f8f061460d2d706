"""Set comparison, ranking, deduplication and sampling over tables."""

from __future__ import annotations

import hashlib
import json
import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ordered import join_null_safe, range_prefix_sums


def same_values(columns: list[str], left: str, right: str) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns))


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows with the times they occur on each side, where these differ; nulls are equal."""
    counted = left.withColumn("_l", F.lit(1)).withColumn("_r", F.lit(0)).unionByName(right.withColumn("_l", F.lit(0)).withColumn("_r", F.lit(1)))
    sums = counted.groupBy(*left.columns).agg(F.sum("_l").alias("n_left"), F.sum("_r").alias("n_right"))
    return sums.where(F.col("n_left") != F.col("n_right"))


def with_lineage(sources: list[tuple[str, DataFrame]], columns: list[str]) -> DataFrame:
    """The ``columns`` of all sources, by name, with the ``source`` of each row."""
    return reduce(DataFrame.unionByName, (df.select(F.lit(name).alias("source"), *columns) for name, df in sources))


def manifest_entries(entries: DataFrame, manifest_path: str, required: list[str], paths: list[str]) -> DataFrame:
    """The ``required`` fields of manifest entries, ``paths`` among them resolved against the manifest's folder.

    A missing column is an error at once, a null or empty required field stops the job when it is read.
    """
    if missing := set(required) - set(entries.columns):
        raise ValueError(f"no such fields: {sorted(missing)}")
    folder = manifest_path.rsplit("/", 1)[0] if "/" in manifest_path else "."

    def field(name: str) -> Column:
        there = F.coalesce(F.col(name).cast("string") != "", F.lit(False))
        value = F.when(F.col(name).rlike(r"^(/|[a-zA-Z][a-zA-Z0-9+.-]*:)"), F.col(name)).otherwise(F.concat(F.lit(f"{folder}/"), F.col(name))) if name in paths else F.col(name)
        return F.when(there, value).otherwise(F.raise_error(F.lit(f"entry without {name}"))).alias(name)

    return entries.select(*map(field, required))


def keep_first(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """The first row, in ``order``, of each group of rows equal in ``columns`` (nulls equal); it keeps its lineage.

    Groups are reduced before the shuffle, so a row repeated millions of times costs no more than any other.
    """
    rest = [c for c in df.columns if c not in columns]
    firsts = df.groupBy(*columns).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return firsts.select(*columns, "_first.*").select(*df.columns)


def distinct_counts(fine: DataFrame, group: list[str], counts: dict[str, str]) -> DataFrame:
    """``group`` and, per entry ``out: column``, how many different values not null it has.

    ``fine`` should be reduced already (distinct rows): each count reads its own two columns of
    it by hash aggregates, so no row is copied once per count as one aggregate over all would.
    """
    out = fine.select(*group).distinct()
    for name, column in counts.items():
        n = fine.where(F.col(column).isNotNull()).select(*group, column).distinct().groupBy(*group).agg(F.count("*").alias(name))
        out = join_null_safe(out, n, group, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def registry_matches(df: DataFrame, key: list[str], codes: str, registry: DataFrame, code: str) -> DataFrame:
    """``key``, ``code`` and the registry's columns of every entry that one of the codes in the array ``codes`` names."""
    named = df.select(*key, F.explode(F.array_distinct(codes)).alias("_code"))
    return named.join(registry, F.col("_code") == F.col(code)).drop("_code")


def coverage(wanted: DataFrame, given: DataFrame, key: list[str], item: str) -> DataFrame:
    """``key``, ``item`` and ``side`` of items on one side only, null keys and items being equal: missing from ``given`` or unexpected in it."""
    one = wanted.select(*key, item).distinct().withColumns({"_w": F.lit(1), "_g": F.lit(0)})
    two = given.select(*key, item).distinct().withColumns({"_w": F.lit(0), "_g": F.lit(1)})
    both = one.unionByName(two).groupBy(*key, item).agg(F.sum("_w").alias("_w"), F.sum("_g").alias("_g"))
    return both.where(F.col("_w") != F.col("_g")).select(*key, item, F.when(F.col("_w") > 0, "missing").otherwise("unexpected").alias("side"))


def duplicate_counts(df: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """Rows, repeated rows (equal in ``columns``, nulls equal) and their rate per group."""
    rows = df.groupBy(*group, *columns).agg(F.count("*").alias("_n")).groupBy(*group)
    out = rows.agg(F.sum("_n").alias("n_rows"), F.sum(F.col("_n") - 1).alias("n_duplicates"))
    return out.withColumn("rate", F.col("n_duplicates").cast("double") / F.col("n_rows"))


def latest(df: DataFrame, key: list[str], order: list[Column], ties: bool = False) -> DataFrame:
    """The last row per key; with ``ties`` all rows that share the last place."""
    window = Window.partitionBy(*key).orderBy(*order)
    rank = F.rank() if ties else F.row_number()
    return df.withColumn("_rank", rank.over(window)).where(F.col("_rank") == 1).drop("_rank")


def compare_inputs(manifest: DataFrame, ledger: DataFrame, key: str, identity: list[str]) -> DataFrame:
    """``key`` and ``change``: new, removed, changed or unchanged, by null-safe equality of ``identity``."""
    joined = manifest.select(key, *identity).withColumn("_m", F.lit(True)).alias("m").join(
        ledger.select(key, *identity).withColumn("_l", F.lit(True)).alias("l"), F.col(f"m.{key}") == F.col(f"l.{key}"), "full_outer"
    )
    change = F.when(F.col("l._l").isNull(), "new").when(F.col("m._m").isNull(), "removed").when(same_values(identity, "m", "l"), "unchanged").otherwise("changed")
    return joined.select(F.coalesce(f"m.{key}", f"l.{key}").alias(key), change.alias("change"))


def without_inputs(facts: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Facts whose input is neither changed nor removed."""
    return facts.join(changes.where(F.col("change").isin("changed", "removed")).select(key), key, "left_anti")


def merge_manifest(existing: DataFrame, incoming: DataFrame, key: str, identity: list[str]) -> DataFrame:
    """``key`` and ``outcome`` of each entry: kept, added, present or conflict."""
    named = {"new": "added", "removed": "kept", "unchanged": "present", "changed": "conflict"}
    change = compare_inputs(incoming, existing, key, identity)
    outcome = reduce(lambda a, kv: a.when(F.col("change") == kv[0], kv[1]), named.items(), F)
    return change.select(key, outcome.alias("outcome"))


def append_new(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """``existing`` and the rows of ``incoming`` whose key it does not have; of incoming rows of one key the least counts."""
    rest = [c for c in incoming.columns if c not in key]
    once = incoming.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_row")).select(*key, "_row.*").select(*existing.columns)
    return existing.unionByName(once.join(existing.select(*key), key, "left_anti").select(*existing.columns))


def keep_latest(existing: DataFrame, incoming: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key over both sides, the last in ``order``; reduced before the shuffle."""
    both = existing.unionByName(incoming)
    rest = [c for c in both.columns if c not in key]
    last = both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return last.select(*key, "_row.*").select(*existing.columns)


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def remove_overlap(older: DataFrame, newer: DataFrame, month: Column, time: str, business: list[str]) -> DataFrame:
    """The two sources as one, without the older one's rows of the month that both have.

    The newer source repeats the older one's part of the month and may go on from there: its rows
    between the older one's first and last time of that month must be the same rows, as multisets
    of ``business``; a difference is an error.  Where either side has no row of the month, all rows stay.
    """
    before, after = older.where(month), newer.where(month)
    span = before.agg(F.min(time).alias("lo"), F.max(time).alias("hi")).first()
    if span["lo"] is None or after.isEmpty():
        return older.unionByName(newer)
    repeated = after.where(F.col(time).between(F.lit(span["lo"]), F.lit(span["hi"])))
    if not multiset_difference(before.select(*business), repeated.select(*business)).isEmpty():
        raise ValueError("the sources differ in the month that both have")
    return older.where(~F.coalesce(month, F.lit(False))).unionByName(newer)


def split_groups(df: DataFrame, group: list[str], least: int, most: int) -> DataFrame:
    """Groups with at least ``least`` rows, the first ``most`` in key order, with their row numbers' range."""
    sizes = df.dropna(subset=group).groupBy(*group).agg(F.count("*").alias("n_rows"), F.min("source_row_number").alias("first_row"), F.max("source_row_number").alias("last_row"))
    return sizes.where(F.col("n_rows") >= least).orderBy(*group).limit(most)


def balanced_sample(df: DataFrame, stratum: str, key: str, size: int, seed: str) -> DataFrame:
    """``size`` rows taken in turn from the strata, inside a stratum by a hash of seed and key."""
    order = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))
    turn = df.withColumn("turn", F.row_number().over(Window.partitionBy(stratum).orderBy(order, key)))
    # no stratum gives more than the whole sample, so each task keeps that many of its rows
    return turn.where(F.col("turn") <= size).orderBy("turn", stratum).limit(size)


def exact_sample(df: DataFrame, share: float, key: str, seed: str) -> DataFrame:
    """``ceil(n * share)`` rows by a hash of seed and ``key`` (unique), the same on every run."""
    return first_by_hash(df, math.ceil(df.count() * share), key, seed)


def first_by_hash(df: DataFrame, n: int, key: str, seed: str) -> DataFrame:
    """The ``n`` rows whose hash of seed and ``key`` (unique) is least; ranks are counted over range-sorted partitions."""
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))
    ranked = range_prefix_sums(df.select(key, order.alias("_order"), F.lit(1).alias("_one")), [], ["_order", key], {"_rank": "_one"})
    return df.join(ranked.where(F.col("_rank") <= n).select(key), key, "left_semi")


def nearest_rank(df: DataFrame, group: list[str], value: str, percents: list[int]) -> DataFrame:
    """Nearest-rank percentiles per group: the value at rank ``ceil(p * n / 100)``, from counts of values ranked over range-sorted partitions.

    Null values count nowhere; a group of nulls only has n 0 and no percentile.
    """
    keys = [*group, "_all"]
    df = df.withColumn("_all", F.lit(0))
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ranked = range_prefix_sums(counts, keys, [value], {"_upto": "_n"})
    sizes = df.groupBy(*keys).agg(F.count(value).alias("n"))
    joined = join_null_safe(ranked, sizes, keys)
    rank = lambda p: F.greatest(F.floor((F.col("n") * p + 99) / 100), F.lit(1))
    found = joined.groupBy(*keys).agg(*(F.min(F.when(F.col("_upto") >= rank(p), F.col(value))).alias(f"p{p}") for p in percents))
    return join_null_safe(sizes, found, keys, "left").drop("_all")


SEAL_ROWS = 10_000


def sealed(df: DataFrame, group: str, order: str, columns: list[str]) -> DataFrame:
    """``group`` and ``seal``: a hash over hashes of its rows in ``order``, a whole number (nulls marked).

    Rows are hashed in stretches of ``SEAL_ROWS`` numbers of ``order``, the stretches' hashes once
    more, so a group of any size is sealed by many tasks.
    """
    row = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns)), 256)
    joined = lambda at, h: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(at, h))), lambda x: x["h"]), ""), 256)
    stretches = df.groupBy(group, F.floor(F.col(order) / SEAL_ROWS).alias("_at")).agg(joined(F.col(order), row.alias("h")).alias("h"))
    return stretches.groupBy(group).agg(joined(F.col("_at"), F.col("h")).alias("seal"))


def content_fingerprints(df: DataFrame, group: str, order: str, columns: list[str]) -> DataFrame:
    """``group`` and ``fingerprint`` of a sheet's content: SHA-256 of its header and rows in ``order`` as compact JSON.

    Texts count without outer blanks, whole floating numbers as integers, times in ISO form, and
    nulls as null.  The hash runs over the whole sheet in one piece, so a group is one task; it
    is no larger than a worksheet can be.
    """
    kind = df.schema[group].dataType.simpleString()

    def cell(v: object) -> object:
        if v is None or v is pd.NaT or v != v:
            return None
        if hasattr(v, "isoformat"):
            return v.isoformat()
        return str(int(v)) if isinstance(v, float) and v.is_integer() else str(v).strip()

    def run(part: pd.DataFrame) -> pd.DataFrame:
        rows = [json.dumps([cell(v) for v in row], separators=(",", ":")) for row in part[columns].itertuples(index=False, name=None)]
        whole = hashlib.sha256(('{"columns":' + json.dumps([c.strip() for c in columns], separators=(",", ":")) + ',"rows":[').encode())
        for k, at in enumerate(sorted(range(len(rows)), key=lambda i: (part[order].iloc[i], rows[i]))):
            whole.update(("," * (k > 0) + rows[at]).encode())
        whole.update(b"]}")
        return pd.DataFrame({group: [part[group].iloc[0]], "fingerprint": [whole.hexdigest()]})

    return df.select(group, order, *columns).groupBy(group).applyInPandas(run, f"`{group}` {kind}, fingerprint string")
