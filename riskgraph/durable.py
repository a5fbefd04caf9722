"""Tables that outlive a lost executor.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``, the folder that the
cluster shares. Where that setting is absent and Spark runs on this machine alone, as in
tests, a folder below the system's temporary directory serves instead; on a cluster its
absence is an error. Tables that are still there when the driver ends are deleted then.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session; made up only where the cluster names none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        path = "file://" + os.path.join(tempfile.gettempdir(), f"riskgraph-{os.getuid()}")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_bases: dict[str, object] = {}


def _delete(jvm, path: str) -> None:
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)


@atexit.register
def forget() -> None:
    """Deletes all tables that this driver has written and not yet deleted; frames that read them end here."""
    while _bases:
        base, jvm = _bases.popitem()
        with contextlib.suppress(Exception):  # the session may be gone, and the folder with it
            _delete(jvm, base)


class Stage:
    """Written intermediate tables of one job, dropped one by one when no later step needs them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _bases[self.base] = spark._jvm
        self.count = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Writes the rows and returns a frame that reads them."""
        path = f"{self.base}/{self.count}"
        self.count += 1
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stage_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables made by keep() that nothing reads any more, and frees shuffle files behind them."""
        jvm = self.spark._jvm
        for df in frames:
            at = jvm.org.apache.hadoop.fs.Path(df._stage_path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.free()

    def free(self) -> None:
        """Lets Spark's cleaner remove the shuffle files of frames that are out of reach."""
        import gc

        gc.collect()
        self.spark._jvm.System.gc()
