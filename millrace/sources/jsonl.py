"""Canonical rows as JSON lines, read with a strict shape, and snapshots swapped in one step."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import finite_decimal
from millrace.operators.trailing import written_day
from millrace.session import Folder

FIELDS = ("invoice_id", "product_id", "product_description", "quantity", "transaction_timestamp", "unit_price", "customer_id", "country", "source_file_id", "source_row_number")


#: Fields that must hold a text with something in it, and those that may be null instead.
FILLED, OPEN = ("invoice_id", "product_id", "country", "source_file_id"), ("product_description", "customer_id")


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """Canonical rows, with ``fault`` where a line breaks their shape: the first rule in this order.

    A line is an object of exactly the known fields; texts are texts (filled where they must be),
    numbers are whole numbers and not texts, prices are texts of a finite number, times are texts
    of an ISO time whose date exists, rows start at 2.  A faulty line keeps its text in ``line``
    and is never dropped; ``require_sound`` refuses it.
    """
    lines = spark.read.text(path, recursiveFileLookup=True).withColumnRenamed("value", "line")
    keys = F.sort_array(F.json_object_keys("line"))
    schema = ", ".join(f"{f} {'bigint' if f in ('quantity', 'source_row_number') else 'string'}" for f in FIELDS)
    row = F.from_json("line", schema, {"mode": "PERMISSIVE"})
    expected = F.array(*(F.lit(f) for f in sorted(FIELDS)))
    read = lines.select("line", row.alias("r"), keys.alias("_keys"), F.try_parse_json("line").alias("_v"))
    kind = lambda f: F.schema_of_variant(F.try_variant_get("_v", f"$.{f}", "variant"))
    value = lambda f: F.col(f"r.{f}")
    rules = [(f"invalid_{f}", (kind(f) == "STRING") & (value(f) != "")) for f in FILLED[:3]]
    rules += [(f"invalid_{f}", kind(f).isin("STRING", "VOID")) for f in OPEN]
    rules += [
        ("invalid_quantity", kind("quantity") == "BIGINT"),
        ("invalid_unit_price", (kind("unit_price") == "STRING") & finite_decimal(value("unit_price")).isNotNull()),
        ("invalid_transaction_timestamp", (kind("transaction_timestamp") == "STRING") & written_day("r.transaction_timestamp").isNotNull()),
        ("invalid_source_file_id", (kind("source_file_id") == "STRING") & (value("source_file_id") != "")),
        ("invalid_source_row_number", (kind("source_row_number") == "BIGINT") & (value("source_row_number") >= 2)),
    ]
    shape = F.when(F.col("_keys").isNull(), "not_an_object").when(F.col("_keys") != expected, "unexpected_fields")
    fault = F.coalesce(shape, *(F.when(~F.coalesce(sound, F.lit(False)), F.lit(code)) for code, sound in rules))
    return read.select("line", "r", fault.alias("fault")).select("line", "r.*", "fault")


def require_sound(rows: DataFrame) -> DataFrame:
    """The rows without their checks; a faulty line stops the job when it is read."""
    sound = F.when(F.col("fault").isNull(), F.col("source_file_id")).otherwise(F.raise_error(F.concat(F.lit("faulty line: "), F.col("fault"))))
    return rows.withColumn("source_file_id", sound).drop("line", "fault")


PART_ROWS = 100_000


def write_rows(rows: DataFrame, path: str) -> None:
    """JSON lines in a folder per source file, ``PART_ROWS`` row numbers a part; only folders of files at hand are replaced."""
    part = F.floor(F.col("source_row_number") / PART_ROWS)
    full = rows.repartition("source_file_id", part).select(F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false"}).alias("value"), "source_file_id")
    full.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_file_id").text(path)


class SnapshotStore:
    """A table in a shared folder as parts that were written whole; numbered lists name the parts that hold.

    New parts are written beside the old before a new list is; the last list holds, so a failed run
    leaves the last good rows.  ``swap`` writes the whole table anew, ``replace`` only the buckets
    that hold the keys at hand.  Every run, failed ones too, is logged.  One writer at a time.
    """

    BUCKETS = 64

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.path = spark, folder.rstrip("/")
        self.folder = Folder(spark, self.path)

    def _list(self) -> dict | None:
        names = [n for n in self.folder.names("lists") if n.endswith(".json")]
        return json.loads(self.folder.read(f"lists/{names[-1]}")) if names else None

    def _hold(self, parts: list[str], key: str | None) -> None:
        names = [n for n in self.folder.names("lists") if n.endswith(".json")]
        number = int(names[-1].removesuffix(".json")) + 1 if names else 0
        self.folder.write(f"lists/{number:09d}.json", json.dumps({"parts": parts, "key": key}))

    def _read(self, parts: list[str]) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.path}/{p}" for p in parts))

    def current(self) -> DataFrame | None:
        held = self._list()
        return self._read(held["parts"]) if held else None

    def _logged(self, work) -> str:  # noqa: ANN001
        run, at = uuid.uuid4().hex, f"{time.time_ns():020d}"
        try:
            work(run)
        except Exception as error:
            self.folder.write(f"runs/{at}-{run}.json", json.dumps({"run_id": run, "status": "FAILED", "error": str(error)[:500]}))
            raise
        self.folder.write(f"runs/{at}-{run}.json", json.dumps({"run_id": run, "status": "SUCCESS"}))
        return run

    def swap(self, build, partition_by: list[str] | None = None) -> str:  # noqa: ANN001
        """Write what ``build(current)`` returns as the whole table; an error is logged and raised."""

        def work(run: str) -> None:
            writer = build(self.current()).write
            (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.path}/part-{run}")
            self._hold([f"part-{run}"], None)

        return self._logged(work)

    def replace(self, rows: DataFrame, key: str) -> str:
        """Put ``rows`` in place of all rows with their ``key`` values; other buckets are not read or written.

        The first time the whole table is dealt to ``BUCKETS`` buckets by a hash of ``key``.
        Equal rows are kept as often as they come; a null key is a value like any other.
        """
        bucket = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("\x00"))), F.lit(self.BUCKETS)).cast("int")

        def work(run: str) -> None:
            held = self._list()
            dealt = rows.withColumn("_bucket", bucket)
            old = {p.split("=")[-1]: p for p in held["parts"]} if held and held["key"] == key else {}
            touched = [str(r[0]) for r in dealt.select("_bucket").distinct().collect()]  # at most BUCKETS
            before = [old[b] for b in touched if b in old] if old or not held else held["parts"]
            merged = dealt
            if before:
                keys = rows.select(F.col(key).alias("_key")).distinct()
                stay = self._read(before).join(keys, F.col(key).eqNullSafe(F.col("_key")), "left_anti").select(*rows.columns)
                merged = stay.withColumn("_bucket", bucket).unionByName(dealt)
            merged.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/part-{run}")
            new = {n.split("=")[-1]: f"part-{run}/{n}" for n in self.folder.names(f"part-{run}") if n.startswith("_bucket=")}
            self._hold(sorted((old | new).values()), key)

        return self._logged(work)

    def runs(self) -> list[dict]:
        return [json.loads(self.folder.read(f"runs/{n}")) for n in self.folder.names("runs")]
