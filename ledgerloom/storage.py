"""Durable intermediate tables.

Iterative operators cut their lineage by writing a Parquet table below the folder named in
``spark.checkpoint.dir``, which every executor shares, so a lost executor never loses a round.  Only
local sessions may do without that setting; they get a temporary folder.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only in local mode and only if unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    set_by_code = spark.sparkContext.getCheckpointDir()
    if set_by_code:
        return set_by_code.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="ledgerloom-")
        atexit.register(shutil.rmtree, _local_dirs[app], True)
    return "file://" + _local_dirs[app]


def _delete(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def tables_below(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below ``path`` whose write has succeeded."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))


class Workspace:
    """Tables of one operator run. ``write`` replaces the lineage; ``drop`` frees a superseded round."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        self._written: list[tuple[DataFrame, str]] = []
        atexit.register(self._at_exit)

    def _at_exit(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                _delete(self.spark, self.root)
        except Exception:  # the session is already gone; the folder belongs to the cluster's cleaner
            pass

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return it read back, without its lineage."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        schema = df.schema
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        self._written.append((out, path))
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables written here that no later step reads."""
        for df in frames:
            for entry in [e for e in self._written if e[0] is df]:
                self._written.remove(entry)
                _delete(self.spark, entry[1])


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for steps in Python.

    Tables of many files come back as they are, without a shuffle; a table of one small file is dealt out.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
