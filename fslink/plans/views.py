"""Case tables over the star-schema tables: orders stand for cases, customers for entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fslink.spec import EXT, TAGS, FieldSpec, LinkageSpec

SPEC = LinkageSpec(
    id="id",
    cls="cls",
    entity="entity",
    fields=(FieldSpec("status"), FieldSpec("segment"), FieldSpec("quarter"), FieldSpec("flags", TAGS), FieldSpec("region", section=EXT), FieldSpec("season", section=EXT)),
    family_of={"1-URGENT": "A", "2-HIGH": "A"},
)
ALPHA_SAME, ALPHA_CROSS = 7.05, 20.05

CASES_SQL = """
cases AS (
  SELECT o.o_orderkey AS id, o.o_orderpriority AS cls, CASE WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'A' ELSE o.o_orderpriority END AS family,
         o.o_custkey AS entity, o.o_orderstatus AS status, c.c_mktsegment AS segment, CAST(quarter(o.o_orderdate) AS VARCHAR) AS quarter, t.flags,
         r.r_name AS region, CASE WHEN month(o.o_orderdate) <= 4 THEN 'early' WHEN month(o.o_orderdate) <= 8 THEN 'mid' ELSE 'late' END AS season, o.o_orderdate AS happened
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS flags FROM lineitem GROUP BY l_orderkey) t ON t.l_orderkey = o.o_orderkey)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation, region, lineitem = (table(spark, sf_dir, n) for n in ("orders", "customer", "nation", "region", "lineitem"))
    flags = lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set("l_returnflag")).alias("flags"))
    where = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("segment"), F.col("r_name").alias("region"))
    month = F.month("o_orderdate")
    base = orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("cls"), F.col("o_custkey").alias("entity"), F.col("o_orderstatus").alias("status"),
        F.quarter("o_orderdate").cast("string").alias("quarter"), F.when(month <= 4, "early").when(month <= 8, "mid").otherwise("late").alias("season"), F.col("o_orderdate").alias("happened"),
    )
    return base.join(where, "entity", "left").join(flags, "id", "left")
