"""Connected components of links, and what is told about them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fslink.sources.shared import settle

THRESHOLD_BITS = 10.0
EGO_BITS = 5.0


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the vertices of undirected edges (a, b); root is the component's least node.

    Rounds of contraction: each vertex points to the least of itself and its neighbours in an order
    drawn anew by a hash of the round, edges follow the pointers and loops vanish.  A round is expected
    to take away a constant share of the vertices, also of a chain, so about log n rounds do.  Every
    round is written, and the edges are settled before the first.
    """
    turn = 0
    pairs = lambda df: df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = settle(edges.select("a", "b"))
    left = settle(pairs(edges))
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    while left.take(1):
        around = left.union(left.select("b", "a"))
        turn += 1
        drawn = lambda c, turn=turn: F.struct(F.xxhash64(c, F.lit(turn)).alias("order"), F.col(c).alias("node"))
        least = around.groupBy("a").agg(F.min(drawn("b")).alias("m"))
        pointer = settle(least.select(F.col("a").alias("v"), F.least(drawn("a"), "m").getField("node").alias("w")))
        moved = left.join(pointer, F.col("a") == F.col("v")).select(F.col("w").alias("a"), "b")
        moved = moved.join(pointer, F.col("b") == F.col("v")).select("a", F.col("w").alias("b"))
        left = settle(pairs(moved))
        labels = settle(labels.join(pointer, F.col("root") == F.col("v"), "left").select("node", F.coalesce("w", "root").alias("root")))
    least = labels.groupBy("root").agg(F.min("node").alias("least"))
    return labels.join(least, "root").select("node", F.col("least").alias("root"))


def clusters(links: DataFrame, threshold: float = THRESHOLD_BITS) -> DataFrame:
    """(cluster_id, members, size, edges, mean_bits) of the components that links (id_a, id_b,
    total_bits) of at least ``threshold`` form, largest first, then by mean bits."""
    strong = links.where(F.col("total_bits") >= threshold).select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "total_bits")
    strong = settle(strong.where("a <> b"))
    root = settle(components(strong))
    members = root.groupBy("root").agg(F.array_sort(F.collect_set("node")).alias("members"), F.count("*").alias("size"))
    weight = strong.join(root, F.col("a") == F.col("node")).groupBy("root").agg(F.count("*").alias("edges"), F.avg("total_bits").alias("mean_bits"))
    return members.join(weight, "root").select(F.col("root").alias("cluster_id"), "members", "size", "edges", "mean_bits").orderBy(F.desc("size"), F.desc("mean_bits"), "cluster_id")


def ego_cluster(links: DataFrame, cases: DataFrame, id: str, at: str, place: str, case_id, least_bits: float = EGO_BITS) -> DataFrame:
    """The case and its partners of at least so much evidence beyond the prior, by time; relocated
    says whether they are of more than one place.  links: case_id, partner_id, total_bits,
    prior_bits."""
    near = links.where((F.col("case_id") == case_id) & (F.col("total_bits") - F.coalesce("prior_bits", F.lit(0.0)) >= least_bits)).select(F.col("partner_id").alias("member"))
    own = near.sparkSession.range(1).select(F.lit(case_id).alias("member"))
    rows = own.union(near).distinct().join(cases.select(F.col(id).alias("member"), F.col(at).alias("at"), F.col(place).alias("place")), "member")
    places = rows.agg((F.countDistinct("place") > 1).alias("relocated"))
    return rows.crossJoin(F.broadcast(places)).orderBy("at", "member")
