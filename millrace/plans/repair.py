"""Approved repairs of raw sheets, folded over a DataFrame in one fixed order."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import repaired_number, slash_timestamp
from millrace.operators.relational import keep_first

LINEAGE = ("source_file_id", "source_row_number")


@dataclass(frozen=True)
class Step:
    operation: str
    parameters: dict = field(default_factory=dict)


def map_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename columns; unknown sources, repeated targets and targets that exist already are errors."""
    targets = list(mapping.values())
    if missing := set(mapping) - set(df.columns):
        raise ValueError(f"no such columns: {sorted(missing)}")
    if len(set(targets)) < len(targets) or set(targets) & (set(df.columns) - set(mapping)):
        raise ValueError(f"targets collide: {sorted(targets)}")
    return df.withColumnsRenamed(mapping)


def deduplicate(df: DataFrame) -> DataFrame:
    """The first of each group of equal raw rows of a file; row numbers stay those of the sheet."""
    return keep_first(df, [c for c in df.columns if c != "source_row_number"], ["source_row_number"])


def confirm_numeric_format(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: repaired_number(F.col(c)) for c in columns})


def confirm_date_format(df: DataFrame, column: str, month_first: bool = False) -> DataFrame:
    return df.withColumn(column, slash_timestamp(F.col(column), month_first))


def divide_columns(df: DataFrame, numerator: str, denominator: str, target: str) -> DataFrame:
    """``target = numerator / denominator``; a null on either side or a zero below stops the job."""
    bad = F.col(numerator).isNull() | F.col(denominator).isNull() | (F.col(denominator) == 0)
    return df.withColumn(target, F.when(bad, F.raise_error(F.lit("division without a value"))).otherwise(F.col(numerator) / F.col(denominator)))


#: Raw cells are compared before they are parsed, so duplicates go after renames and before formats.
ORDER: dict[str, Callable[..., DataFrame]] = {
    "map_columns": map_columns, "deduplicate_in_silver": deduplicate, "confirm_numeric_format": confirm_numeric_format,
    "confirm_date_format": confirm_date_format, "divide_columns": divide_columns,
}


def apply_plan(df: DataFrame, plan: list[Step], approved: set[str] | list[Step] | None = None) -> DataFrame:
    """Apply the steps in the fixed order, whatever order the plan lists them in.

    Unknown steps are errors, and so is any difference from ``approved`` where it is given: a set of
    operations, or a list of steps whose parameters count too.
    """
    names = [s.operation for s in plan]
    if unknown := set(names) - set(ORDER):
        raise ValueError(f"unknown operations: {sorted(unknown)}")
    if approved is not None:
        asked = approved if isinstance(approved, set) else None
        listed = sorted(json.dumps([s.operation, s.parameters], sort_keys=True, default=str) for s in plan)
        wanted = None if asked is not None else sorted(json.dumps([s.operation, s.parameters], sort_keys=True, default=str) for s in approved)
        if set(names) != asked if asked is not None else listed != wanted:
            raise PermissionError(f"plan {sorted(names)} is not what was approved")
    for step in sorted(plan, key=lambda s: list(ORDER).index(s.operation)):
        df = ORDER[step.operation](df, **step.parameters)
    return df


def document_hash(document: dict) -> str:
    """SHA-256 of a document in canonical JSON: sorted keys, no blanks."""
    return hashlib.sha256(json.dumps(document, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def record_hash(*columns: str) -> Column:
    """The same hash of flat records whose columns are texts, whole numbers or null, as an expression."""
    escaped = lambda c: F.regexp_replace(F.to_json(F.array(F.col(c))), r"^\[|\]$", "")
    parts = [F.concat(F.lit(f'"{c}":'), F.coalesce(escaped(c), F.lit("null"))) for c in sorted(columns)]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256)


def seal(document: dict) -> dict:
    return document | {"record_hash": document_hash(document)}


def unseal(document: dict) -> dict:
    """The document without its seal; a changed document is an error."""
    bare = {k: v for k, v in document.items() if k != "record_hash"}
    if document.get("record_hash") != document_hash(bare):
        raise ValueError("the document was changed after it was sealed")
    return bare
