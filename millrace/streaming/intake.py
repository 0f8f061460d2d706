"""Arriving canonical files as a stream that keeps the fact snapshot up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from millrace.sources.jsonl import SnapshotStore


def follow(spark: SparkSession, schema: str, inbox: str, store: SnapshotStore, key: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Each batch of parquet files replaces the facts of the inputs (``key``) that it holds.

    Only the buckets of these inputs are read and written.  A batch that is delivered twice gives
    the same table, so a restart does no harm.
    """

    def sync(batch: DataFrame, _: int) -> None:
        held = batch.persist()
        try:
            if not held.isEmpty():
                store.replace(held, key)
        finally:
            held.unpersist()

    stream = spark.readStream.schema(schema).parquet(inbox).writeStream.foreachBatch(sync).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if available_now else stream).start()
