"""The corpus operators' queries for the driver, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fslink.llm import gbt_quality, html_main_text, jaccard_join, line_crf, mixing, multiset_hash, packing, secret_scan, token_counts, token_frames
from fslink.llm.common import table
from fslink.llm.oracle import ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.judge(table(spark, sf_dir, "documents"))


def op2_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_frames.round_trip(table(spark, sf_dir, "documents"))


def op3_gbt_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return gbt_quality.score(docs, gbt_quality.learn(docs, table(spark, sf_dir, "labels")))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_classes(table(spark, sf_dir, "documents"))


def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main_text.extract(table(spark, sf_dir, "pages"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.withColumn("first_position", F.round(F.try_element_at("positions", F.lit(1)), 9)).drop("positions")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents")))


def op10_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.edits(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_line_crf": op1_line_crf,
        "op2_token_frames": op2_token_frames,
        "op3_gbt_quality": op3_gbt_quality,
        "op4_jaccard_join": op4_jaccard_join,
        "op5_html_main_text": op5_html_main_text,
        "op6_token_counts": op6_token_counts,
        "op7_mixing": op7_mixing,
        "op8_secret_scan": op8_secret_scan,
        "op9_packing": op9_packing,
        "op10_multiset_hash": op10_multiset_hash,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
