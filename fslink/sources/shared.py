"""Cutting lineage through the folder that all nodes share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset (tests), one of this machine
    that goes with the process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        local = tempfile.mkdtemp(prefix="fslink-shared-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        named = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new, unused path below the shared folder, deleted when the driver ends."""
    path = f"{shared_root(spark)}/fslink-{tag}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    """Frees a path if the session still lives; a session that was stopped leaves it to the folder's owner."""
    try:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # noqa: BLE001 - the gateway may be gone
        pass


def settle(df: DataFrame, tag: str = "settled") -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: computed once, without lineage,
    and of known size to later plans."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.settled_at = path
    return found


def release(df: DataFrame) -> None:
    """Frees the files of a table that ``settle`` wrote and that nothing reads any more."""
    _delete(df.sparkSession, df.settled_at)


def freed(spark: SparkSession) -> None:
    """Frees the shuffle files of plans that nobody holds any more; else they stay until the JVM happens to
    collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
