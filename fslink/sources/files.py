"""Reading and writing feeds, tables, models and configuration."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_feed(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV feed with a header; every cell a string, blank cells stay empty strings."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    # The reader makes blank cells null; to the normaliser a blank is an empty string.
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False).na.fill("")


def write_feed(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="")


def union_feeds(feeds: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), feeds)


def write_cases(cases: DataFrame, path: str) -> None:
    """Parquet partitioned by class and quarter of registration, the secondary index's two parts."""
    keyed = cases.withColumn("year_quarter", F.concat(F.year("registered_at"), F.lit("Q"), F.quarter("registered_at")))
    keyed.write.mode("overwrite").partitionBy("crime_type", "year_quarter").parquet(path)


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def dump_model(model: dict, path: str) -> None:
    """A small model or manifest as one JSON file on the driver."""
    with open(path, "w") as f:
        json.dump(model, f, indent=1, sort_keys=True)


def load_model(path: str) -> dict:
    with open(path) as f:
        return json.load(f)


def load_config(folder: str) -> dict:
    """Every YAML file of a folder, by its name without the ending."""
    import pathlib

    import yaml

    return {p.stem: yaml.safe_load(p.read_text()) for p in sorted(pathlib.Path(folder).glob("*.yaml"))}


def publish_config(config: dict, folder: str) -> None:
    """The configuration as JSON, one file per part."""
    import pathlib

    for name, part in config.items():
        (pathlib.Path(folder) / f"{name}.json").write_text(json.dumps(part, sort_keys=True))


def feed_of(code: str, config: dict):
    """A Feed from the 'states' configuration."""
    from fslink.operators.normalise import Feed

    state = config["states"]["states"][code]
    feed = state["feed"]
    return Feed(code, dict(feed["columns"]), feed["layout"], feed["date_format"], feed["date_only_format"], feed.get("multi_value_delimiter"), tuple(state["recording"].get("structurally_absent") or ()), state.get("narrative_language", "en"))


def write_vectors(vectors: DataFrame, path: str) -> None:
    """The vector index: id and vector, sorted by id so that lookups prune row groups."""
    vectors.repartitionByRange(F.col(vectors.columns[0])).sortWithinPartitions(vectors.columns[0]).write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str, ids: list | None = None) -> DataFrame:
    """The vector index, or the vectors of a few ids; the file's order by id lets row groups be skipped."""
    index = spark.read.parquet(path)
    return index if ids is None else index.where(F.col(index.columns[0]).isin(ids))
