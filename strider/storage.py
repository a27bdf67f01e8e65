"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: Deletes the shuffle files of a finished write, which nothing reads again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scratch: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir. It goes when the `scratch` around it ends, or with the application.

    Where the setting is missing, a local session (tests) gets a local folder; on a cluster executors could not see that
    one, so the call fails."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="strider-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/strider-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    atexit.register(remove, spark, path)
    return path


@contextmanager
def scratch(spark: SparkSession):
    """Deletes the folders that were handed out inside when it ends; what is still needed must be written elsewhere."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the JVM may be gone at exit
        pass


def written(df: DataFrame, path: str) -> DataFrame:
    """Writes a Parquet table and reads it: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, path: str, **figures: Column) -> tuple[DataFrame, dict]:
    """`written`, and aggregates of the rows, computed while writing."""
    seen = Observation()
    return written(df.observe(seen, *[c.alias(k) for k, c in figures.items()]), path), seen.get
