"""Lineage cutting through written tables in the folder all executors share.

Iterative operators write each round as a Parquet table below the folder that the cluster names in
``spark.checkpoint.dir`` and read it back, so a lost executor costs a re-read and never a recomputation of the
rounds before.  Only where the setting is absent (tests on one machine) a folder of our own is used.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, or a folder of our own where none is set."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="claimloom-")
        spark.sparkContext.setCheckpointDir(_LOCAL[app])
    return _LOCAL[app]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table that no plan reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of plans that are written and dropped.  Spark deletes them when the driver collects its garbage, which with a small heap of results may be never."""
    for _ in range(2):  # plans are let go by Python first, then by the JVM, which deletes their files in a thread of its own
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the written tables below a folder; none where it does not exist.  Tables that were never finished do not count."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    done = lambda s: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
    return [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and done(s)]


class Scratch:
    """A folder of written tables that belongs to one operator run."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self._quiet_close)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the table read back (its lineage is the files alone)."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def read_all(self, names: list[str], schema) -> DataFrame:
        """The union of several written tables of one schema, as one scan."""
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{n}" for n in names])

    def drop(self, name: str) -> None:
        remove(self.spark, f"{self.root}/{name}")

    def close(self) -> None:
        remove(self.spark, self.root)

    def _quiet_close(self) -> None:
        try:
            self.close()
        except Exception:  # the JVM may be gone already when Python exits
            pass
