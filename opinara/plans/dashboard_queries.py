"""Queries of the dashboard, of research inputs and of run bookkeeping, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from opinara import config
from opinara.functions import text as tx
from opinara.functions import values as vl
from opinara.operators import metrics
from opinara.operators.evidence import ranked_ids
from opinara.operators.filters import target_run
from opinara.plans.review_queries import S_BEST, S_CURRENT, best_text, current, reviews
from opinara.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


LIVE = ("google_play", "app_store", "reddit", "youtube", "community_forum")


@query("SELECT count(*) AS fetched, count(*) FILTER (analysed = 1) AS analysed, count(*) - count(*) FILTER (analysed = 1) AS pending, max(published_at) AS newest FROM reviews WHERE source IN ('google_play', 'app_store', 'reddit', 'youtube', 'community_forum')")
def agg_live_totals(s, d):
    """One row: fetched, analysed and pending reviews of the live sources, and the newest date."""
    done = F.sum(metrics.flag(F.col("analysed") == 1))
    rows = reviews(s, d, "source", "analysed", "published_at").where(F.col("source").isin(*LIVE))
    return rows.agg(F.count(F.lit(1)).alias("fetched"), F.coalesce(done, F.lit(0)).alias("analysed"), (F.count(F.lit(1)) - F.coalesce(done, F.lit(0))).alias("pending"), F.max("published_at").alias("newest"))


@query("SELECT min(published_at) AS first_at, max(published_at) AS last_at, count(*) AS n FROM reviews WHERE cluster_id IS NOT NULL AND source IN ('google_play', 'reddit')")
def agg_meta_range(s, d):
    """Date range and size of a slice."""
    rows = reviews(s, d, "cluster_id", "source", "published_at").where(F.col("cluster_id").isNotNull() & F.col("source").isin("google_play", "reddit"))
    return rows.agg(F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"), F.count(F.lit(1)).alias("n"))


@query(f"SELECT cluster_id, size, round(size * 100.0 / (SELECT count(*) FROM {S_CURRENT} WHERE cluster_id IS NOT NULL), 2) AS share_percent FROM (SELECT cluster_id, count(*) AS size FROM {S_CURRENT} WHERE cluster_id IS NOT NULL AND NOT starts_with(cluster_id, 'unrelated_') GROUP BY 1) ORDER BY size DESC, cluster_id LIMIT 5")
def agg_top_themes(s, d):
    """The five largest detailed clusters with their share of all clustered reviews."""
    per = current(s, d, "id", "cluster_id").where("cluster_id is not null").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    total = per.agg(F.sum("size").alias("total"))
    rows = per.where(~F.col("cluster_id").like("unrelated_%")).orderBy(F.desc("size"), "cluster_id").limit(5)
    return rows.join(F.broadcast(total)).select("cluster_id", "size", vl.percent(F.col("size"), F.col("total")).alias("share_percent"))  # one row on the small side


@query(f"SELECT cluster_id, id, source, rating, CASE WHEN length(t) > 150 THEN substr(t, 1, 147) || '...' ELSE t END AS quote FROM (SELECT cluster_id, id, source, rating, {S_BEST} AS t, row_number() OVER (PARTITION BY cluster_id ORDER BY id) AS r FROM {S_CURRENT} WHERE cluster_id IS NOT NULL) WHERE r <= 5")
def top_reviews_per_cluster(s, d):
    """Five reviews of every cluster, in order of their ids, texts cut to 150 characters."""
    rows = current(s, d, "id", "cluster_id", "source", "rating", "raw_text", "translated_text").where("cluster_id is not null")
    ids = ranked_ids(rows.select("id", "cluster_id"), "cluster_id", [F.col("id")], 5).select("id")
    t = best_text()
    return rows.join(ids, "id").select("cluster_id", "id", "source", "rating", F.when(F.length(t) > 150, F.concat(F.substring(t, 1, 147), F.lit("..."))).otherwise(t).alias("quote"))


@query(f"WITH c AS (SELECT * FROM {S_CURRENT} WHERE cluster_id IS NOT NULL), k AS (SELECT cluster_id, count(*) AS size FROM c GROUP BY 1 ORDER BY size DESC, cluster_id LIMIT 20) SELECT k.cluster_id, k.size, string_agg(c.id, ',' ORDER BY c.id) AS sample_ids FROM k JOIN (SELECT cluster_id, id, row_number() OVER (PARTITION BY cluster_id ORDER BY id) AS r FROM c) c ON c.cluster_id = k.cluster_id AND c.r <= 3 GROUP BY 1, 2")
def pkg_inspect(s, d):
    """The twenty largest clusters with three sample reviews each."""
    rows = current(s, d, "id", "cluster_id").where("cluster_id is not null")
    top = rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "cluster_id").limit(20)
    picked = ranked_ids(rows.join(F.broadcast(top.select("cluster_id")), "cluster_id"), "cluster_id", [F.col("id")], 3)
    return top.join(picked.groupBy("cluster_id").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("sample_ids")), "cluster_id")


@query("SELECT theme_id, n_proposed, n_verified, n_proposed - n_verified AS n_rejected, CASE WHEN n_proposed > 0 THEN round(n_verified * 100.0 / n_proposed, 2) END AS rate_percent FROM (SELECT t.theme_id, count(p.review_id) AS n_proposed, count(p.review_id) FILTER (p.review_id IN (SELECT id FROM reviews)) AS n_verified FROM decomposed_themes t LEFT JOIN (SELECT DISTINCT theme_id, review_id FROM theme_reviews) p ON p.theme_id = t.theme_id GROUP BY 1)")
def theme_verification_rate(s, d):
    """Per theme: assigned reviews, those that exist, and their rate; a theme without reviews has no rate."""
    known = reviews(s, d, "id").distinct().select(F.col("id").alias("review_id"), F.lit(1).alias("known"))
    pairs = table(s, d, "theme_reviews").distinct().join(known, "review_id", "left")
    per = table(s, d, "decomposed_themes").select("theme_id").join(pairs, "theme_id", "left").groupBy("theme_id").agg(F.count("review_id").alias("n_proposed"), F.count("known").alias("n_verified"))
    return per.select("theme_id", "n_proposed", "n_verified", (F.col("n_proposed") - F.col("n_verified")).alias("n_rejected"), F.round(F.try_divide(F.col("n_verified") * 100.0, F.col("n_proposed")), 2).alias("rate_percent"))


@query("SELECT theme_id, pos::INT AS pos, p.review_id, coalesce(r.rating, 0) AS rating, coalesce(r.source, 'unknown') AS source, r.id IS NOT NULL AS found FROM (SELECT theme_id, review_id, row_number() OVER (PARTITION BY theme_id ORDER BY review_id) - 1 AS pos FROM (SELECT DISTINCT theme_id, review_id FROM theme_reviews)) p LEFT JOIN " + S_CURRENT + " r ON r.id = p.review_id WHERE pos < 10")
def join_by_id_loop(s, d):
    """The first ten reviews of every theme by id; an id without a review gives a placeholder."""
    pairs = table(s, d, "theme_reviews").select("theme_id", F.col("review_id").alias("id")).distinct()
    first = ranked_ids(pairs, "theme_id", [F.col("id")], 10)
    place = (F.row_number().over(Window.partitionBy("theme_id").orderBy("id")) - 1).alias("pos")  # at most ten rows a theme
    out = first.select("theme_id", place, "id").join(current(s, d, "id", "rating", "source").withColumn("found", F.lit(True)), "id", "left")
    return out.select("theme_id", "pos", F.col("id").alias("review_id"), F.coalesce("rating", F.lit(0)).alias("rating"), F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce("found", F.lit(False)).alias("found"))


@query("SELECT source, count(*) AS fetched, count(DISTINCT id) AS saved, count(*) - count(DISTINCT id) AS repeated FROM reviews WHERE id IS NOT NULL GROUP BY 1")
def agg_ingest_stats(s, d):
    """Per source: landed rows, different ids and repeated ones."""
    per = reviews(s, d, "id", "source").where("id is not null").groupBy("source").agg(F.count(F.lit(1)).alias("fetched"), F.countDistinct("id").alias("saved"))
    return per.withColumn("repeated", F.col("fetched") - F.col("saved"))


S_OUTCOME = f"CASE WHEN coalesce(trim(raw_text), '') = '' THEN 'empty' WHEN coalesce(detected_language, '') NOT IN ({', '.join(repr(x) for x in config.ALLOWED_LANGUAGES)}) THEN 'language' WHEN len(list_filter(regexp_extract_all(lower(raw_text), '{tx.WORD}'), lambda w: w NOT IN ({', '.join(repr(x) for x in config.LENGTH_STOP_WORDS)}))) < {config.MIN_WORDS} THEN 'short' ELSE 'saved' END"


@query(f"SELECT source, {S_OUTCOME} AS outcome, count(*) AS n FROM reviews GROUP BY 1, 2")
def agg_production_stats(s, d):
    """Landed rows per source and outcome: empty, language, short or saved."""
    lang = F.coalesce(F.col("detected_language"), F.lit("")).isin(*config.ALLOWED_LANGUAGES)
    outcome = F.when(F.coalesce(F.trim("raw_text"), F.lit("")) == "", "empty").when(~lang, "language").when(tx.meaningful_words(F.col("raw_text")) < config.MIN_WORDS, "short").otherwise("saved")
    return reviews(s, d, "source", "raw_text", "detected_language").groupBy("source", outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


CLASSES = (("shuffle", ["shuffle", "repeat", "loop"]), ("discovery", ["discover", "recommend", "radar", "weekly"]), ("playlist", ["playlist", "library", "mix"]), ("price", ["premium", "ads", "price", "pay"]), ("faults", ["crash", "freeze", "error", "login", "download"]))
S_CLASS = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(t, '{w}')" for w in ws) + f" THEN '{n}'" for n, ws in CLASSES) + " ELSE 'other' END"


@query(f"SELECT class, count(*) AS size, round(count(*) * 100.0 / sum(count(*)) OVER (), 0) AS share_percent FROM (SELECT {S_CLASS} AS class FROM (SELECT lower({S_BEST}) AS t FROM reviews)) GROUP BY 1")
def agg_thematic_class(s, d):
    """Reviews by the first thematic class of which a word occurs, with rounded shares."""
    kind = None
    for name, words in CLASSES:
        kind = F.when(tx.contains_any(best_text(), words), name) if kind is None else kind.when(tx.contains_any(best_text(), words), name)
    per = reviews(s, d, "raw_text", "translated_text").groupBy(kind.otherwise("other").alias("class")).agg(F.count(F.lit(1)).alias("size"))
    return per.withColumn("share_percent", F.round(F.col("size") * 100.0 / F.sum("size").over(Window.partitionBy()), 0))


@query("SELECT id, size, round(mean_similarity, 6) AS mean_similarity, round(variance, 6) AS variance FROM clusters QUALIFY row_number() OVER (PARTITION BY id ORDER BY last_updated DESC NULLS LAST, size DESC, mean_similarity DESC NULLS LAST, variance DESC NULLS LAST) = 1")
def clu_stats(s, d):
    """Size, mean similarity and variance of every stored cluster, its newest row."""
    order = [F.desc_nulls_last(c) for c in ("last_updated", "size", "mean_similarity", "variance")]
    rows = table(s, d, "clusters").select("id", "size", "mean_similarity", "variance", "last_updated")
    best = rows.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where("_r = 1")
    return best.select("id", "size", F.round("mean_similarity", 6).alias("mean_similarity"), F.round("variance", 6).alias("variance"))


@query("SELECT coalesce((SELECT run_id FROM pipeline_runs WHERE status IN ('running', 'completed') ORDER BY CASE status WHEN 'running' THEN 0 ELSE 1 END, started_at DESC NULLS LAST, run_id LIMIT 1), (SELECT max(last_run_id) FROM reviews)) AS run_id, (SELECT count(*) FROM pipeline_runs WHERE status = 'running') > 0 AS running")
def stm_run_state(s, d):
    """The run that counts (the running one, else the newest completed, else the largest id of the reviews), and whether one runs."""
    runs = table(s, d, "pipeline_runs")
    one = runs.agg((F.coalesce(F.sum(metrics.flag(F.col("status") == "running")), F.lit(0)) > 0).alias("running"))
    newest = target_run(runs).agg(F.max("run_id").alias("a"))
    last = reviews(s, d, "last_run_id").agg(F.max("last_run_id").alias("b"))
    return one.join(F.broadcast(newest)).join(F.broadcast(last)).select(F.coalesce("a", "b").alias("run_id"), "running")  # one row each


S_PLACE_OF = "coalesce(nullif(trim(location), ''), 'unknown')"


@query(f"SELECT source, place, n FROM (SELECT source, {S_PLACE_OF} AS place, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, {S_PLACE_OF}) AS r FROM reviews GROUP BY 1, 2) WHERE r <= 3")
def top_locations(s, d):
    """The three most frequent stored locations of every source."""
    place = F.coalesce(F.nullif(F.trim("location"), F.lit("")), F.lit("unknown"))
    per = reviews(s, d, "source", "location").groupBy("source", place.alias("place")).agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("_r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "place"))).where("_r <= 3").drop("_r")


@query(f"SELECT count(*) AS n_rows, round(avg(length(raw_text)), 4) AS mean_chars, round(count(*) FILTER ({S_OUTCOME} = 'language') * 100.0 / count(*), 2) AS language_reject_percent, round(count(*) FILTER ({S_OUTCOME} = 'short') * 100.0 / count(*), 2) AS short_reject_percent, round((count(*) - count(DISTINCT id)) * 100.0 / count(*), 2) AS repeat_percent FROM reviews")
def agg_benchmark(s, d):
    """Rates of the landed rows: mean length, rejects by reason and repeats."""
    lang = F.coalesce(F.col("detected_language"), F.lit("")).isin(*config.ALLOWED_LANGUAGES)
    filled = F.coalesce(F.trim("raw_text"), F.lit("")) != ""
    few = tx.meaningful_words(F.col("raw_text")) < config.MIN_WORDS
    n = F.count(F.lit(1))
    return reviews(s, d, "id", "raw_text", "detected_language").agg(
        n.alias("n_rows"), F.round(F.avg(F.length("raw_text")), 4).alias("mean_chars"),
        vl.percent(F.sum(metrics.flag(filled & ~lang)), n).alias("language_reject_percent"), vl.percent(F.sum(metrics.flag(filled & lang & few)), n).alias("short_reject_percent"),
        vl.percent(n - F.countDistinct("id"), n).alias("repeat_percent"),
    )
