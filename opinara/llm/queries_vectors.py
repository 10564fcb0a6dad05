"""Queries over vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.llm.clustering import cluster_members, describe_clusters
from opinara.llm.neighbours import nearest
from opinara.llm.vectors import Prepared, prepared
from opinara.runtime import written
from opinara.sources.tables import table

SIMILAR = 0.89


def _prepared(spark: SparkSession, d: str) -> Prepared:
    return prepared(table(spark, d, "review_embeddings").select("id", "vector"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = nearest(_prepared(spark, d), least=SIMILAR).select("id", F.explode("neighbours").alias("x")).where(F.col("x.cosine") >= SIMILAR)
    return pairs.select(F.least("id", "x.id").alias("id_a"), F.greatest("id", "x.id").alias("id_b")).distinct()


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar other ids of every id, with rank and cosine."""
    ranked = nearest(_prepared(spark, d)).select("id", F.posexplode("neighbours").alias("at", "x"))
    return ranked.select("id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("neighbour_id"), F.col("x.cosine").alias("cosine"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return cluster_members(_prepared(spark, d)).where("member_id <> first_id").select("first_id", "member_id")


def p5_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Every cluster with size, mean similarity and most typical ids."""
    return describe_clusters(_prepared(spark, d))


def p5_stored(spark: SparkSession, d: str) -> DataFrame:
    """The stored clusters of the earlier run against the found ones: stored size and mean similarity, the reviews that
    name the cluster and have a usable vector, the found cluster most of them lie in, and whether the stored size is
    stale.  A stored cluster listed twice counts once, with its largest size."""
    p = _prepared(spark, d)
    stored = table(spark, d, "clusters").groupBy("id").agg(F.max("size").alias("stored_size"), F.max("mean_similarity").alias("stored_similarity"))
    named = table(spark, d, "reviews").select(F.col("id").alias("member_id"), F.col("cluster_id").alias("id")).where("cluster_id is not null").distinct()
    members = written(named.join(p.ids.select(F.col("id").alias("member_id")), "member_id"), "stored-members")
    size = members.groupBy("id").agg(F.count(F.lit(1)).alias("n_members"))
    found = written(cluster_members(p), "found-members")
    overlap = members.join(found.select("member_id", "first_id", "size"), "member_id").groupBy("id", "first_id", "size").agg(F.count(F.lit(1)).alias("n"))
    best = overlap.groupBy("id").agg(F.max(F.struct("n", "size", "first_id")).alias("b"), F.count(F.lit(1)).alias("n_found_clusters"))
    out = stored.join(size, "id", "left").join(best, "id", "left").fillna(0, ["n_members", "n_found_clusters"])
    return out.select(F.col("id").alias("cluster_id"), "stored_size", F.round("stored_similarity", 6).alias("stored_similarity"), "n_members", "n_found_clusters", F.col("b.first_id").alias("found_first_id"), F.col("b.n").alias("n_shared"), F.col("b.size").alias("found_size"), (F.coalesce("stored_size", F.lit(0)) != F.col("n_members")).alias("is_stale"))


QUERIES = {f.__name__: f for f in (p2_found, p2_neighbours, p5_found, p5_clusters, p5_stored)}
SQL: dict[str, str] = {}
