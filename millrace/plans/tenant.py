"""A session that sees one tenant's rows only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class TenantSession:
    """Every table it hands out is filtered by ``client_id``; writes of other tenants' rows are refused."""

    def __init__(self, spark: SparkSession, sf_dir: str, client_id: str):
        self.spark, self.sf_dir, self.client_id = spark, sf_dir, client_id

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if "client_id" not in df.columns:
            raise PermissionError(f"{name} has no client_id")
        return df.where(F.col("client_id") == self.client_id)

    def own(self, df: DataFrame) -> DataFrame:
        """``df`` for writing; a row of another tenant, or of none, stops the job."""
        mine = F.col("client_id").eqNullSafe(F.lit(self.client_id))
        return df.withColumn("client_id", F.when(mine, F.col("client_id")).otherwise(F.raise_error(F.lit("row of another tenant"))))
