"""Schemas that drift between files: matched column by column, reported and unified.

Consecutive versions of a client's schema are matched by a bipartite assignment.  Columns
known under the same field weigh most; the rest are scored by name similarity, type and a
sketch of their values, so that a rename outside the alias registry is reported as likely.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import finite_decimal
from millrace.operators.ordered import with_previous

SKETCH = 8
LIKELY = 0.62
CHANGES = "intake_id bigint, change_kind string, field_name string, previous_header string, header string, previous_type string, type string, score double"


def reduced(header: Column) -> Column:
    """A header in lower case with only a-z and 0-9; null becomes empty."""
    return F.regexp_replace(F.lower(F.coalesce(header, F.lit(""))), "[^a-z0-9]", "")


def column_profiles(arrivals: DataFrame, records: DataFrame, aliases: DataFrame) -> DataFrame:
    """``intake_id`` and ``columns``: per header in file order its reduced name, field, type and value sketch.

    The sketch holds, per hash function, the least hash of the values' shapes (digits and
    letters each reduced to one sign), so it has a fixed size for any number of rows.
    """
    heads = arrivals.where(F.col("observed_schema").isNotNull()).select(
        "intake_id", F.posexplode("observed_schema").alias("position", "header"), F.col("observed_types").alias("_types")
    )
    heads = heads.select("intake_id", "position", reduced(F.col("header")).alias("name"), F.get("_types", "position").alias("type"))
    known = aliases.groupBy("alias_name").agg(F.min("field_name").alias("field_name"))
    named = heads.join(known, heads["name"] == known["alias_name"], "left").withColumn("field", F.coalesce("field_name", "name"))
    cells = records.select("intake_id", F.explode(F.from_json("payload", "map<string,string>")).alias("header", "value"))
    shape = F.regexp_replace(F.regexp_replace("value", r"\d+", "9"), r"\p{L}+", "a")
    sketches = (
        cells.where(F.col("value").isNotNull())
        .groupBy("intake_id", reduced(F.col("header")).alias("name"))
        .agg(F.array(*(F.min(F.xxhash64(shape, F.lit(k))) for k in range(SKETCH))).alias("sketch"))
    )
    full = named.join(sketches, ["intake_id", "name"], "left")
    columns = F.sort_array(F.collect_list(F.struct("position", "name", "field", "type", "sketch")))
    profiled = full.groupBy("intake_id").agg(columns.alias("columns"))
    empty = arrivals.where(F.col("observed_schema").isNotNull()).select("intake_id", "client_id", "received_at", "selected_sheet")
    return empty.join(profiled, "intake_id", "left").withColumn("columns", F.coalesce("columns", F.array().cast(profiled.schema["columns"].dataType)))


def assign(score: np.ndarray) -> list[tuple[int, int]]:
    """The one-to-one matching of rows and columns with the greatest total score (shortest augmenting paths)."""
    if not score.size:
        return []
    turned = score.shape[0] > score.shape[1]
    cost = -(score.T if turned else score)
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used, way = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool), np.zeros(m + 1, dtype=int)
        while True:
            used[j0] = True
            slack = cost[owner[j0] - 1] - u[owner[j0]] - v[1:]
            better = ~used[1:] & (slack < least[1:])
            least[1:][better], way[1:][better] = slack[better], j0
            j1 = int(np.argmin(np.where(used[1:], np.inf, least[1:]))) + 1
            step = least[j1]
            u[owner[used]] += step
            v[used] -= step
            least[~used] -= step
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0], j0 = owner[way[j0]], way[j0]
    found = [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return [(b, a) if turned else (a, b) for a, b in found]


def _similarity(a: dict, b: dict) -> float:
    """Between 0 and 1: half name, a fifth type, the rest value shapes where both are known."""
    name = difflib.SequenceMatcher(None, a["name"], b["name"], autojunk=False).ratio()
    short, long = sorted((a["name"], b["name"]), key=len)
    within = iter(long)
    if len(short) >= 2 and all(c in within for c in short):  # an abbreviation keeps the order of letters
        name = max(name, 0.8)
    known = 0.5 * name + 0.2 * (a["type"] == b["type"])
    if a["sketch"] is None or b["sketch"] is None:
        return known / 0.7
    return known + 0.3 * float(np.mean(np.asarray(a["sketch"]) == np.asarray(b["sketch"])))


def match_columns(old: list[dict], new: list[dict]) -> list[tuple[int, int, float]]:
    """Matched positions with their score: 3 same name, 2 same field, below 1 likely rename."""
    pairs: list[tuple[int, int, float]] = []
    by_name: dict[str, list[int]] = {}
    for i, a in enumerate(old):
        by_name.setdefault(a["name"], []).append(i)
    left, right = set(range(len(old))), []
    for j, b in enumerate(new):  # equal names outweigh anything else, so they are fixed before
        if by_name.get(b["name"]):
            i = by_name[b["name"]].pop(0)
            left.discard(i)
            pairs.append((i, j, 3.0))
        else:
            right.append(j)
    rows = sorted(left)
    if rows and right:
        similar = np.array([[_similarity(old[i], new[j]) for j in right] for i in rows])
        same = np.array([[float(old[i]["field"] == new[j]["field"]) for j in right] for i in rows])
        for r, c in assign(np.where(same > 0, 100 + similar, np.where(similar >= LIKELY, similar, 0.0))):
            if same[r, c]:
                pairs.append((rows[r], right[c], 2.0))
            elif similar[r, c] >= LIKELY:
                pairs.append((rows[r], right[c], float(similar[r, c])))
    return pairs


def _compare(intake_id: int, old: list[dict], new: list[dict]) -> Iterator[tuple]:
    before, now = {c["field"] for c in old}, {c["field"] for c in new}
    yield from ((intake_id, "added", f, None, None, None, None, None) for f in sorted(now - before))
    yield from ((intake_id, "removed", f, None, None, None, None, None) for f in sorted(before - now))
    seen = set()
    for i, j, score in match_columns(old, new):
        a, b = old[i], new[j]
        kinds = ["likely_renamed"] if score < 1 else [*["renamed"] * (a["name"] != b["name"]), *["retyped"] * (a["type"] != b["type"])]
        for kind in kinds:
            if (kind, b["field"]) not in seen:
                seen.add((kind, b["field"]))
                yield (intake_id, kind, b["field"], a["name"], b["name"], a["type"], b["type"], score)


def _changes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in CHANGES.split(", ")]
    for batch in batches:
        rows = [x for r in batch.itertuples() for x in _compare(r.intake_id, list(r.prev_columns), list(r.columns))]
        yield pd.DataFrame(rows, columns=names)


def schema_changes(arrivals: DataFrame, records: DataFrame, aliases: DataFrame) -> DataFrame:
    """Every change from one file of a client to the next, in order of arrival.

    Arrivals without a schema are passed over; equal times are ordered by ``intake_id``.  An
    empty schema is compared like any other.  ``field_name`` is the registry's field or else
    the reduced header.  Kinds: added, removed, renamed, retyped, sheet, and likely_renamed for
    a matched pair of different fields (which also counts as added and removed).  Several
    headers of one field are matched one to one; a kind is reported once per field.
    """
    ordered = with_previous(column_profiles(arrivals, records, aliases), ["client_id"], ["received_at", "intake_id"], ["columns", "selected_sheet"])
    paired = ordered.where(F.col("position") > 1)
    changed = paired.where(~F.col("columns").eqNullSafe(F.col("prev_columns")))
    rows = changed.select("intake_id", F.col("prev_columns"), "columns").mapInPandas(_changes, CHANGES)
    tidy = lambda c: F.lower(F.regexp_replace(c, r"(?U)^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    sheet = paired.where(~tidy(F.col("selected_sheet")).eqNullSafe(tidy(F.col("prev_selected_sheet"))))
    sheets = sheet.select("intake_id", F.lit("sheet").alias("change_kind"), F.lit("selected_sheet").alias("field_name"), F.col("prev_selected_sheet").alias("previous_header"), F.col("selected_sheet").alias("header"))
    return rows.unionByName(sheets, allowMissingColumns=True)


FIELDS = ("invoice", "product", "description", "quantity", "date", "price", "customer", "country")
NUMBERS = ("quantity", "price")


def learned_fields(changes: DataFrame, aliases: DataFrame) -> DataFrame:
    """``name`` and ``learned``: the field of headers that the registry lacks but a matching tied to one that it has.

    A match counts in both directions of time, over all clients.  Of several fields the one with
    most matches holds, then the better score, then the greater name.
    """
    known = aliases.groupBy("alias_name").agg(F.min("field_name").alias("_field"))
    pairs = changes.where(F.col("change_kind") == "likely_renamed").select(F.explode(F.array(F.struct(F.col("previous_header").alias("here"), F.col("header").alias("there")), F.struct(F.col("header").alias("here"), F.col("previous_header").alias("there")))).alias("p"), "score")
    pairs = pairs.select("p.here", "p.there", "score").join(known, F.col("there") == F.col("alias_name")).drop("alias_name")
    pairs = pairs.join(known.select("alias_name"), F.col("here") == F.col("alias_name"), "left_anti")
    votes = pairs.groupBy("here", "_field").agg(F.struct(F.count("*").alias("n"), F.max("score").alias("score"), "_field").alias("v"))
    return votes.groupBy(F.col("here").alias("name")).agg(F.max("v")["_field"].alias("learned"))


def unified_records(records: DataFrame, aliases: DataFrame, changes: DataFrame | None = None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One consistent table of raw records: a text column per field, other headers in ``extras``.

    A header's field is the registry's, or else the one that the matched ``changes`` between
    versions tie it to (``schema_changes``), or else it is an extra.  Texts are one type for all
    files; ``quantity_value`` and ``price_value`` are the exact numbers of these two fields, null where a text is none.
    Whole numbers that were turned into decimals lose their ``.0`` again, in all fields but
    the price.  Of several headers of one field the smallest header's value counts.  A record
    whose payload is null or no JSON object keeps its key with nulls.
    """
    known = aliases.groupBy("alias_name").agg(F.min("field_name").alias("field_name"))
    cells = records.select("intake_id", "source_row_number", F.explode_outer(F.from_json("payload", "map<string,string>")).alias("header", "value"))
    cells = cells.withColumn("_name", reduced(F.col("header")))
    named = cells.join(known, cells["_name"] == known["alias_name"], "left")
    if changes is None:
        named = named.withColumn("field", F.coalesce("field_name", "_name"))
    else:
        more = learned_fields(changes, aliases)
        named = named.join(more, named["_name"] == more["name"], "left").withColumn("field", F.coalesce("field_name", "learned", "_name"))
    whole = F.regexp_replace("value", r"^(-?\d+)\.0$", "$1")
    value = lambda f: F.min_by(F.when(F.col("field") == f, F.col("value") if f == "price" else whole), F.when(F.col("field") == f, F.col("header")))
    extra = F.when(F.col("header").isNotNull() & ~F.col("field").isin(*fields), F.struct("field", "value"))
    entries = F.array_sort(F.array_distinct(F.collect_list(extra)))
    unified = named.groupBy("intake_id", "source_row_number").agg(*(value(f).alias(f) for f in fields), F.to_json(entries).alias("extras"))
    return unified.withColumns({f"{f}_value": finite_decimal(F.col(f)) for f in NUMBERS if f in fields})
