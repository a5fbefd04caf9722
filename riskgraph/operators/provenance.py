"""Which runs filled the tables: an append-only record."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, url string, branch string, head_sha string, mode string, tool_version string, schema_version int, status string, at timestamp"


def record(spark: SparkSession, path: str, url: str, branch: str, head_sha: str, mode: str, status: str = "running", id: str | None = None, tool_version: str = "1", schema_version: int = 1) -> str:
    """Appends a state of a run and returns the run's id; a finished run has a second row."""
    id = id or uuid.uuid4().hex
    row = spark.createDataFrame([(id, url, branch, head_sha, mode, tool_version, schema_version, status)], SCHEMA.rsplit(",", 1)[0])
    row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)
    return id


def runs(spark: SparkSession, path: str) -> DataFrame:
    """One row per run with its latest state."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    last = rows.groupBy("id").agg(F.max_by(F.struct(*rows.columns), F.struct("at", F.col("status") != "running")).alias("r")).select("r.*")
    return last.withColumnRenamed("at", "finished_at")


def known(spark: SparkSession, path: str) -> bool:
    """Whether any run has been recorded there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
