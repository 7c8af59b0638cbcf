"""Helpers shared by the corpus operators: tables, shared folders, lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what the cluster names in ``spark.checkpoint.dir``.  Only where that is unset (tests,
    local mode) a folder of this machine serves.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="fslink-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
        atexit.register(_forget, spark, named)
    return named.rstrip("/")


def _forget(spark: SparkSession, uri: str) -> None:
    import shutil

    shutil.rmtree(uri.removeprefix("file://"), ignore_errors=True)


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


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    The result has no lineage behind it, so a lost executor costs the rereading of files and no
    recomputation, and later plans know its true size.
    """
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file on this machine (driver or executor)."""
    import public_tokenizers

    return public_tokenizers.path(name)
