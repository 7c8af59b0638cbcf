"""Key-value access patterns on Parquet tables: lookups, ranges, upserts, in-place updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def get_item(table: DataFrame, key: str, value) -> DataFrame:
    return table.where(F.col(key) == value)


def query(table: DataFrame, key: str, value, sort_key: str, limit: int = 200) -> DataFrame:
    """Rows of a partition key in the order of the sort key."""
    return table.where(F.col(key) == value).orderBy(sort_key).limit(limit)


def scan(table: DataFrame, columns: list[str], condition: Column | None = None) -> DataFrame:
    found = table if condition is None else table.where(condition)
    return found.select(*columns)


def latest(rows: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The row written last for each key; ties go to the greatest ``tie``."""
    order = Window.partitionBy(*keys).orderBy(F.desc(at), F.desc(tie))
    return rows.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def upsert(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The table with the new rows in place of those of the same keys."""
    return table.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.dropDuplicates(keys), allowMissingColumns=True)


def update(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table with the non-null values of ``changes`` (key and some columns) written over."""
    names = [c for c in changes.columns if c != key]
    fresh = changes.select(key, *(F.col(c).alias(f"_new_{c}") for c in names))
    joined = table.join(fresh, key, "left")
    return joined.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in names else F.col(c) for c in table.columns))


def enrichment_targets(cases: DataFrame) -> DataFrame:
    return cases.where("needs_enrichment").select("case_id")


def chunks(ids: DataFrame, id: str, size: int = 1000) -> DataFrame:
    """Adds a chunk number with about ``size`` ids each, dealt by hash so that no global order of
    all rows is needed."""
    n = max(1, -(-ids.count() // size))
    return ids.withColumn("chunk", (F.conv(F.substring(F.md5(F.col(id).cast("string")), 1, 8), 16, 10).cast("long") % n).cast("int"))


def with_truth(cases: DataFrame, truth: DataFrame, key: str = "case_id") -> DataFrame:
    """The cases with their entity from the truth (key, entity); those it doesn't know are left out."""
    return cases.join(truth.select(key, "entity"), key, "left").where(F.col("entity").isNotNull())


def truth_with_recorded(truth: DataFrame, recorded: DataFrame, key: str) -> DataFrame:
    """True and recorded values of each case, the recorded ones as rec_<column>."""
    said = recorded.select(key, *(F.col(c).alias(f"rec_{c}") for c in recorded.columns if c != key))
    return truth.join(said, key)


def export_subset(cases: DataFrame, links: DataFrame, examples: DataFrame, folder: str, everything: bool = False) -> None:
    """Cases and links for a demonstration: those of the examples and of all their partners, or all."""
    if not everything:
        ids = with_partners(examples, links)
        cases, links = cases.join(ids, "case_id", "left_semi"), links.join(ids, "case_id", "left_semi")
    cases.write.mode("overwrite").parquet(f"{folder}/cases")
    links.write.mode("overwrite").parquet(f"{folder}/links")


def with_partners(examples: DataFrame, links: DataFrame) -> DataFrame:
    """case_id of the examples and of all their partners."""
    own = examples.select("case_id").distinct()
    return own.union(links.join(own, "case_id", "left_semi").select(F.col("partner_id").alias("case_id"))).distinct()
