"""Session helpers: reading tables, cutting lineage in the shared folder, spreading small scans."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, wherever it is installed."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    package = Path(__file__).resolve().parent
    held = tempfile.mkdtemp(prefix="millrace-package-")
    sc.addPyFile(shutil.make_archive(os.path.join(held, package.name), "zip", package.parent, package.name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage, as set in the session.

    The setting ``spark.checkpoint.dir`` wins.  Only a local master without it gets a
    temporary folder of its own; on a cluster a missing setting is an error, since a
    machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_KEY, None) or sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="millrace-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)
    return configured


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` reliably; later reads come from the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a stored table, so that each row has a fixed file and position.

    A plain file scan is returned as it is; anything else is written to the shared folder
    once.  Positions then stay the same when a task is run again.
    """
    try:
        df.select("_metadata.file_path", "_metadata.row_index").schema  # noqa: B018
        return df
    except AnalysisException:
        return kept(df)


def _kept_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/millrace-kept-{spark.sparkContext.applicationId}"


def kept(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` as a table written to the shared folder: columns that a reader does not need are not read.

    Tables stay until ``release``, since plans made from them may be run at any time; one at a
    ``path`` of the caller's is the caller's to remove.
    """
    path = path or f"{_kept_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files go as soon as it is over, not once the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release(spark: SparkSession) -> None:
    """Remove all tables that this application keeps; plans made from them cannot be run any more."""
    Folder(spark, _kept_dir(spark)).remove()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition ``df`` only where its scan has fewer partitions than the cluster has cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys) if keys else df.repartition(cores)


class Folder:
    """A folder that all executors share, through Hadoop's file system; small texts and whole subfolders only."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _at(self, name: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        """Names inside a subfolder, in order; none where it does not exist."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(name))) if self.exists(name) else []

    def exists(self, name: str = "") -> bool:
        return bool(self._fs.exists(self._at(name)))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Write a text in one step: readers see all of it or, before, nothing."""
        held = f"{name}.{uuid.uuid4().hex}"
        stream = self._fs.create(self._at(held), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self._fs.rename(self._at(held), self._at(name)):
            self.remove(held)
            raise FileExistsError(f"{self.path}/{name}")

    def remove(self, name: str = "") -> None:
        self._fs.delete(self._at(name), True)
