"""Incremental ingest: new feed files become cases, once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, path: str, schema: T.StructType, format: str = "parquet", glob: str | None = None) -> DataFrame:
    """The files of a folder, and those that come, as a stream."""
    reader = spark.readStream.format(format).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if format == "csv":
        reader = reader.option("header", True).option("nullValue", "\x00").option("emptyValue", "")
    return reader.load(path)


def ingest(rows: DataFrame, target: str, checkpoint: str, key: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df, at: str | None = None, delay: str = "1 day") -> StreamingQuery:
    """Takes all that is there (``availableNow``) through ``transform`` and adds each batch's rows with
    keys that the target hasn't yet.  A batch owns a folder of the target, so a replayed batch adds nothing.

    With ``at``, a time column, keys are remembered in the stream's state for ``delay`` only, and what a
    batch costs doesn't grow with the target.  Without it the keys of all earlier batches are read (that column
    alone): exact however late a repeat comes, at a cost that grows.
    """
    stream = rows if at is None else deduplicated(rows, key, at, delay)

    def write(batch: DataFrame, number: int) -> None:
        made = transform(batch).dropDuplicates([key])
        if at is None and number:
            spark = made.sparkSession
            earlier = _batches(spark, target, number)
            if earlier:
                made = made.join(spark.read.option("basePath", target).parquet(*earlier).select(key), key, "left_anti")
        made.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _batches(spark: SparkSession, target: str, number: int) -> list[str]:
    """The folders of the batches before this one that were written."""
    root = spark._jvm.org.apache.hadoop.fs.Path(target)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(root):
        return []
    names = [s.getPath().toString() for s in store.listStatus(root) if s.getPath().getName().startswith("batch=")]
    return [n for n in names if int(n.rsplit("=", 1)[1]) < number]


def deduplicated(rows: DataFrame, key: str, at: str, delay: str = "1 day") -> DataFrame:
    """A stream without replays of a key within the watermark: state is bounded by the delay."""
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])
