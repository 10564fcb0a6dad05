"""Evidence packages: per-cluster statistics joined from independent aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara import config
from opinara.functions import text as tx
from opinara.functions import values as vl
from opinara.operators.search import against
from opinara.operators.themes import term_weights
from opinara.runtime import written


def source_synergy(df: DataFrame, group: str = "cluster_id", source: str = "source") -> DataFrame:
    """(group, entropy): entropy of the sources over that of equal shares; one source gives 0."""
    n = df.groupBy(group, source).agg(F.count(F.lit(1)).alias("n"))
    per = n.groupBy(group).agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.log2(F.col("n"))).alias("x"))
    return per.select(group, F.when(F.col("k") > 1, (F.log2("t") - F.col("x") / F.col("t")) / F.log2("k")).otherwise(0.0).alias("entropy"))


def distribution(df: DataFrame, group: str, key: Column, name: str) -> DataFrame:
    """(group, map of key to count); null keys are left out."""
    n = df.select(group, key.alias("_k")).where("_k is not null").groupBy(group, "_k").agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(group).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_k", "_n")))).alias(name))


def tags(vectors: DataFrame, anchors: DataFrame, threshold: float = config.ANCHOR_THRESHOLD) -> DataFrame:
    """(id, tags): names of the anchors (name, vector) with a cosine of at least ``threshold``, sorted."""
    hits = against(vectors, anchors, "id", "vector", "name", "vector", least=threshold)
    return hits.groupBy("id").agg(F.array_sort(F.collect_set("other")).alias("_tags"))


def ranked_ids(df: DataFrame, group: str, order: list[Column], n: int, salts: int = 32) -> DataFrame:
    """The first ``n`` rows of every group, ranked first inside salted parts and then among their winners, so that no
    window holds a whole group."""
    part = Window.partitionBy(group, F.pmod(F.xxhash64("id"), F.lit(salts))).orderBy(*order)
    first = df.withColumn("_p", F.row_number().over(part)).where(F.col("_p") <= n).drop("_p")
    return first.withColumn("_p", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_p") <= n).drop("_p")


def filtered_packages(reviews: DataFrame, vectors: DataFrame, clusters: DataFrame, *, start: str | None = None, end: str | None = None, sources: list[str] | None = None, limit: int | None = None, **options) -> DataFrame:  # noqa: ANN003
    """Evidence packages over the reviews of a window and sources, at most the ``limit`` newest, best opportunity first.

    Dates are compared as texts and the end is taken as it is; shares are of the filtered reviews; ties of the date go
    to the smaller id, ties of the score to the smaller cluster id.
    """
    rows = reviews.where("cluster_id is not null")
    if start:
        rows = rows.where(F.col("published_at") >= start)
    if end:
        rows = rows.where(F.col("published_at") <= end)
    if sources:
        rows = rows.where(F.col("source").isin(*sources))
    if limit:
        rows = rows.orderBy(F.desc_nulls_last("published_at"), "id").limit(limit)
    return packages(rows, vectors, clusters, **options).orderBy(F.desc("opportunity_score"), "cluster_id")


def packages(reviews: DataFrame, vectors: DataFrame, clusters: DataFrame, anchors: DataFrame | None = None, churn_tag: str = "churn_indicator", review_cols: tuple[str, ...] = ("id", "raw_text", "translated_text", "rating", "source", "published_at"), dimension: int = 384, tag_vectors: DataFrame | None = None) -> DataFrame:
    """One row per cluster, best opportunity first in a plain sort by the caller.

    ``reviews`` has unique ids; ``vectors`` (id, vector) and ``clusters`` (id, centroid, mean_similarity, variance) are
    joined on the left: a review without vector counts but is not ranked; a cluster without statistics has similarity
    0.80 and the vector of its newest review as centroid.  Tags compare ``anchors`` with ``tag_vectors`` (id, vector),
    which must come from the embedder of the anchors; without them the stored vectors are taken.
    """
    text = tx.first_filled(F.col("translated_text"), F.col("raw_text"))
    keep = dict.fromkeys((*review_cols, "id", "cluster_id", "raw_text", "translated_text", "rating", "source", "metadata", "published_at"))
    # seven aggregates read these two tables: they are written once
    rows = written(reviews.where(F.col("cluster_id").isNotNull()).select(*keep), "package-rows")
    total = rows.count()
    vec = vectors.where(vl.usable(F.col("vector"), dimension)).groupBy("id").agg(F.min("vector").alias("vector"))
    vec = written(vec.join(rows.select("id"), "id", "left_semi"), "package-vectors")
    meta = clusters.groupBy("id").agg(F.max(F.struct("last_updated", "centroid", "mean_similarity", "variance")).alias("c")).select(F.col("id").alias("cluster_id"), "c.centroid", "c.mean_similarity", "c.variance")
    none = F.array().cast("array<string>")
    full = rows.select("id", "cluster_id", "rating", tx.mentions_premium(F.col("metadata"), text).cast("int").alias("_premium"))
    full = full.join(tags(vec if tag_vectors is None else tag_vectors.join(rows.select("id"), "id", "left_semi"), anchors), "id", "left") if anchors is not None else full.withColumn("_tags", none)
    full = full.withColumn("_tags", F.coalesce("_tags", none))
    placed = rows.select("cluster_id", "id", "published_at").join(vec, "id")
    base = full.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("size"), F.coalesce(F.avg("rating"), F.lit(config.DEFAULT_RATING)).alias("average_rating"),
        F.avg("_premium").alias("premium_ratio"), F.avg(F.array_contains("_tags", churn_tag).cast("int")).alias("churn_ratio"),
    )
    sources = distribution(rows, "cluster_id", F.col("source"), "source_distribution")
    places = distribution(rows.select("cluster_id", F.explode(tx.location_all(text)).alias("l")), "cluster_id", F.col("l"), "location_distribution")
    tagged = distribution(full.select("cluster_id", F.explode("_tags").alias("t")), "cluster_id", F.col("t"), "tag_distribution")
    themes = term_weights(rows.withColumn("_t", text), "cluster_id", "_t").groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term", "weight"))), lambda x: F.struct(x["term"].alias("term"), x["weight"].alias("score"))).alias("themes"))
    # ranking by similarity to the centroid
    first = placed.groupBy("cluster_id").agg(F.max_by("vector", F.struct("published_at", "id")).alias("_first"))
    centre = first.join(meta.select("cluster_id", "centroid"), "cluster_id", "left").select("cluster_id", vl.normalised(F.coalesce("centroid", "_first")).alias("_centre"))
    similar = placed.join(centre, "cluster_id").select("cluster_id", "id", (vl.dot(F.col("vector"), F.col("_centre")) / vl.norm(F.col("vector"))).alias("_sim"))
    similar = written(similar, "package-similarities")
    scored = rows.select("id", "cluster_id", "rating").join(similar.drop("cluster_id"), "id").join(base.select("cluster_id", "average_rating"), "cluster_id")
    odd = (F.col("average_rating") >= 4.0) & (F.col("rating") <= 2) | (F.col("average_rating") <= 2.5) & (F.col("rating") >= 4)
    best = lambda df, n, name: ranked_ids(df, "cluster_id", [F.desc("_sim"), F.col("id")], n).withColumn("part", F.lit(name))
    parts = [best(scored, 5, "medoids"), ranked_ids(scored, "cluster_id", [F.col("_sim"), F.desc("id")], 3).withColumn("part", F.lit("outliers")), best(scored.where(odd), 3, "anomalies")]
    picked = parts[0].unionByName(parts[1]).unionByName(parts[2]).join(rows.select("id", F.struct(*review_cols).alias("r")), "id")
    pick = lambda name: F.transform(F.sort_array(F.collect_list(F.when(F.col("part") == name, F.struct((-F.col("_sim")).alias("d"), "id", "r")))), lambda x: x["r"])
    counts = scored.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("_placed"))
    chosen = picked.groupBy("cluster_id").agg(*[pick(n).alias(n) for n in ("medoids", "outliers", "anomalies")]).join(counts, "cluster_id")
    chosen = chosen.withColumn("outliers", F.when(F.col("_placed") >= 3, F.col("outliers"))).drop("_placed")
    out = base
    for part in (source_synergy(rows), sources, places, tagged, themes, chosen, meta):
        out = out.join(part, "cluster_id", "left")
    sim = F.coalesce("mean_similarity", F.lit(config.DEFAULT_SIMILARITY))
    out = out.withColumn("csss", F.col("entropy") * sim)
    score = vl.opportunity(F.col("size"), F.lit(total), F.col("average_rating"), F.col("csss"), F.col("churn_ratio"), F.col("premium_ratio"))
    empty_map = F.expr("cast(map() as map<string,bigint>)")
    return out.select(
        "cluster_id", "size", "average_rating", sim.alias("mean_similarity"), F.coalesce("variance", F.lit(0.0)).alias("variance"), "csss", score.alias("opportunity_score"),
        "source_distribution", F.coalesce("location_distribution", empty_map).alias("location_distribution"), F.coalesce("tag_distribution", empty_map).alias("tag_distribution"),
        "premium_ratio", "themes", "medoids", "outliers", "anomalies",
    )
