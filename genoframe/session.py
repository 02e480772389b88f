"""Sessions for local runs, and intermediate tables. On a cluster the session comes from spark-submit."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | None = None, partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks: UTC, adaptive execution, one shuffle partition a core."""
    cores = cores or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("genoframe")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .getOrCreate()
    )


_roots: list[str] = []


def _delete_all() -> None:
    """Delete the tables of this application, if its JVM still runs."""
    from py4j.protocol import Py4JError

    jvm = SparkContext._jvm
    try:
        for root in _roots if jvm is not None else ():
            path = jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)
    except (Py4JError, OSError):
        return


class Scratch:
    """Tables written to the folder of ``spark.checkpoint.dir``, which driver and executors share.

    A written table cuts the lineage: a lost executor costs a re-read, not a re-computation. Where the
    setting is missing a temporary folder stands in, but only for a local master. What results read lazily has to
    stay while the application runs; when its driver ends, all its tables are deleted.
    """

    def __init__(self, spark: SparkSession):
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        self.spark, self.root = spark, f"{root.rstrip('/')}/{uuid.uuid4().hex}"
        if not _roots:
            atexit.register(_delete_all)
        _roots.append(self.root)

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        saved._scratch_path = path
        return saved

    def drop(self, df: DataFrame) -> None:
        """Delete a saved table that no later plan reads."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
