"""Queries over the review tables, each with its SQL where SQL can express it.

All queries run over whole tables.  ``current`` is the table after merging landed rows: of every id the row with the
largest landing id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara import config
from opinara.functions import text as tx
from opinara.functions import values as vl
from opinara.operators import metrics, records, routing, search
from opinara.operators.dedup import near_duplicates, shingled, signature
from opinara.operators.evidence import filtered_packages, packages, source_synergy
from opinara.operators.filters import ReviewFilter, discovery, mismatch, process_reviews, target_run
from opinara.operators.leader import leader_follower
from opinara.operators.summary import summarised
from opinara.operators.themes import term_weights
from opinara.plans.providers import HashedEmbedder
from opinara.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
NOW = "2026-08-31 00:00:00"
FROM, TO = "2026-03-01", "2026-05-31"
DIMENSION = 384
WORD = r"[\p{L}\p{N}_]+"

# pieces of SQL shared by the oracles
S_CURRENT = "(SELECT * FROM reviews QUALIFY row_number() OVER (PARTITION BY id ORDER BY landing_id DESC) = 1)"
S_BEST = "coalesce(nullif(translated_text, ''), raw_text)"
S_USABLE = "(SELECT id, min(vector) AS vector FROM review_embeddings WHERE len(vector) = 384 AND list_bool_and(list_transform(vector, lambda x: isfinite(x))) AND list_max(list_transform(vector, lambda x: abs(x))) > 0 GROUP BY id)"


def strip_sql(c: str) -> str:
    """The cleaning steps in SQL, with the same patterns."""
    for pattern in (tx.EMAIL, tx.PHONE, tx.URL, tx.HANDLE, tx.ASTRAL):
        c = f"regexp_replace({c}, '{pattern}', '', 'g')"
    return f"trim(regexp_replace({c}, '{tx.BLANKS}', ' ', 'g'))"



def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _list(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def reviews(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    df = table(spark, d, "reviews")
    return df.select(*cols) if cols else df


def current(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    df = records.latest(reviews(spark, d, *dict.fromkeys((*cols, "id", "landing_id"))) if cols else reviews(spark, d), "id", [F.desc("landing_id")])
    return df.select(*cols) if cols else df


def usable(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "review_embeddings").where(vl.usable(F.col("vector"), DIMENSION)).groupBy("id").agg(F.min("vector").alias("vector"))


def best_text() -> Column:
    return tx.first_filled(F.col("translated_text"), F.col("raw_text"))


# ---- scans, filters, sinks
@query("SELECT landing_id, id, source, rating, published_at FROM reviews WHERE source IN ('google_play', 'app_store') AND rating >= 1 AND rating <= 3 AND published_at >= '2026-03-01' AND published_at <= '2026-06-01'")
def scan_reviews(s, d):
    f = ReviewFilter(sources=["google_play", "app_store"], min_rating=1, max_rating=3, start=FROM, end=TO)
    return f.apply(reviews(s, d)).select("landing_id", "id", "source", "rating", "published_at")


@query("SELECT last_run_id, count(*) AS n, min(published_at) AS first_at, max(published_at) AS last_at FROM reviews GROUP BY 1")
def scan_session(s, d):
    return reviews(s, d, "last_run_id", "published_at").groupBy("last_run_id").agg(F.count(F.lit(1)).alias("n"), F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"))


@query("SELECT count(DISTINCT id) AS n FROM reviews")
def scan_existing_ids(s, d):
    return reviews(s, d, "id").distinct().agg(F.count("id").alias("n"))


S_STAGED = "(SELECT id FROM reviews WHERE analysed = 1)"


@query(f"SELECT source, count(*) AS n, count(*) FILTER (NOT staged) AS n_copied FROM (SELECT source, id IN {S_STAGED} AS staged FROM {S_CURRENT} WHERE id IS NOT NULL) WHERE staged OR source IN ('google_play', 'app_store') GROUP BY 1")
def replica_copy(s, d):
    """The analysed rows are staged already; of the rest the storefront rows are copied."""
    rows = current(s, d, "id", "source")
    staged = rows.join(reviews(s, d, "id", "analysed").where("analysed = 1").select("id"), "id", "left_semi").withColumn("staged", F.lit(True))
    out = records.replica(rows.withColumn("staged", F.lit(False)), staged)
    return out.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col("staged")).cast("bigint")).alias("n_copied"))


@query(f"SELECT landing_id FROM reviews WHERE source IN ('google_play', 'app_store') AND {_any('lower(raw_text)', ['playlist', 'podcast'])} OR source IN ('google_play', 'app_store') AND {_any('''lower(coalesce(translated_text, ''))''', ['playlist', 'podcast'])}")
def theme_bridge(s, d):
    words = ["playlist", "podcast"]
    return reviews(s, d).where(F.col("source").isin("google_play", "app_store") & (tx.contains_any(F.col("raw_text"), words) | tx.contains_any(F.col("translated_text"), words))).select("landing_id")


@query("""WITH o AS (SELECT * FROM reviews WHERE analysed = 1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY landing_id) = 1),
n AS (SELECT * FROM reviews QUALIFY row_number() OVER (PARTITION BY id ORDER BY landing_id DESC) = 1)
SELECT n.id, n.rating, CASE WHEN o.id IS NULL THEN n.source ELSE o.source END AS source, CASE WHEN o.id IS NULL THEN n.country ELSE o.country END AS country, 0 AS analysed, n.last_run_id,
CASE WHEN o.id IS NULL THEN n.created_at ELSE o.created_at END AS created_at FROM n LEFT JOIN o ON o.id = n.id WHERE n.id IS NOT NULL""")
def sink_upsert(s, d):
    """The newest row of every id merged into the table of analysed ids: known ids change, others are inserted."""
    cols = ["id", "rating", "source", "country", "analysed", "last_run_id", "created_at"]
    rows = reviews(s, d, "landing_id", *cols)
    old, new = records.latest(rows.where("analysed = 1"), "id", [F.asc("landing_id")]), records.latest(rows, "id", [F.desc("landing_id")])
    return records.upsert(old.select(cols), new.select(cols), "id", keep=("created_at", "source", "country"), reset={"analysed": 0})


@query("SELECT count(*) AS n, sum(landing_id)::BIGINT AS checksum FROM (SELECT coalesce(min(landing_id) FILTER (analysed = 1), min(landing_id)) AS landing_id FROM reviews WHERE id IS NOT NULL GROUP BY id)")
def sink_insert_ignore(s, d):
    """All rows, first come first, inserted into the table of analysed ids."""
    rows = reviews(s, d, "id", "landing_id", "analysed")
    old = records.first_occurrence(rows.where("analysed = 1"), "id", "landing_id")
    return records.insert_ignore(old, records.first_occurrence(rows, "id", "landing_id"), "id").agg(F.count(F.lit(1)).alias("n"), F.sum("landing_id").alias("checksum"))


@query(f"SELECT CASE WHEN e.id IS NOT NULL THEN 1 ELSE r.analysed END AS analysed, count(*) AS n FROM reviews r LEFT JOIN (SELECT DISTINCT id FROM {S_USABLE}) e ON r.id = e.id GROUP BY 1")
def sink_mark_analysed(s, d):
    return records.mark(reviews(s, d, "id", "analysed"), usable(s, d), "id", "analysed", 1).groupBy("analysed").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT id, source FROM (SELECT id, source, row_number() OVER (PARTITION BY source ORDER BY published_at DESC NULLS LAST, id) AS r FROM {S_CURRENT} WHERE source IN ('google_play', 'reddit')) WHERE r <= CASE source WHEN 'google_play' THEN 200 ELSE 50 END")
def sink_associate_run(s, d):
    return records.newest_per_source(current(s, d, "id", "source", "published_at"), {"google_play": 200, "reddit": 50}, "published_at", "id").select("id", "source")


@query(f"SELECT landing_id FROM reviews WHERE trim(raw_text) <> '' AND (source <> 'google_play' OR country = 'in') AND (source <> 'google_play' OR detected_language = 'en')")
def flt_meta_geo(s, d):
    return ReviewFilter(country="in", lang="en").apply(reviews(s, d)).where(F.trim("raw_text") != "").select("landing_id")


@query("SELECT r.landing_id FROM reviews r WHERE r.last_run_id = (SELECT run_id FROM pipeline_runs WHERE status IN ('running', 'completed') ORDER BY CASE status WHEN 'running' THEN 0 ELSE 1 END, started_at DESC NULLS LAST, run_id LIMIT 1)")
def flt_latest_run(s, d):
    run = target_run(table(s, d, "pipeline_runs")).first()
    return ReviewFilter(only_latest=True, run_id=run[0] if run else None).apply(reviews(s, d)).select("landing_id")


@query("SELECT coalesce(nullif(cluster_id LIKE 'unrelated\\_%' ESCAPE '\\', false), false) AS surface, count(*) AS n FROM reviews WHERE cluster_id IS NOT NULL GROUP BY 1")
def flt_discovery(s, d):
    return reviews(s, d, "cluster_id").where("cluster_id is not null").groupBy((~discovery()).alias("surface")).agg(F.count(F.lit(1)).alias("n"))


S_DAY = "try_cast(CASE WHEN regexp_matches(substr(published_at, 1, 10), '^\\d{4}-\\d\\d?-\\d\\d?([ T]|$)') THEN regexp_extract(substr(published_at, 1, 10), '^[\\d-]+') END AS DATE)"
S_WITHIN = f"coalesce({S_DAY} BETWEEN DATE '{FROM}' AND DATE '{TO}', true)"


@query(f"SELECT count(*) FILTER ({S_WITHIN}) AS in_range, count(*) FILTER (NOT {S_WITHIN}) AS out_of_range, count(*) FILTER ({S_WITHIN}) < 1000000000 AND count(*) FILTER (NOT {S_WITHIN}) > 0 AS needs_decision FROM reviews")
def flt_date_window(s, d):
    return mismatch(reviews(s, d, "published_at"), FROM, TO, 10**9)


# ---- row-level text functions
@query("SELECT landing_id, md5(" + strip_sql("raw_text") + ") AS digest FROM reviews")
def txt_strip_pii(s, d):
    return reviews(s, d, "landing_id", "raw_text").select("landing_id", F.md5(tx.strip_details(F.col("raw_text"))).alias("digest"))


@query("SELECT landing_id, md5(replace(replace(replace(replace(regexp_replace(raw_text, '<[^>]*>', '', 'g'), '‘', ''''), '’', ''''), '“', '\"'), '”', '\"')) AS digest FROM reviews")
def txt_strip_html(s, d):
    return reviews(s, d, "landing_id", "raw_text").select("landing_id", F.md5(tx.strip_markup(F.col("raw_text"))).alias("digest"))


@query(f"SELECT landing_id, len(list_filter(regexp_extract_all(lower(raw_text), '{tx.WORD}'), lambda w: w NOT IN ({_list(config.LENGTH_STOP_WORDS)}))) AS n_words FROM reviews")
def txt_meaningful_words(s, d):
    return reviews(s, d, "landing_id", "raw_text").select("landing_id", tx.meaningful_words(F.col("raw_text")).alias("n_words"))


@query(f"SELECT landing_id, {_any('lower(raw_text)', config.PRIORITY_KEYWORDS)} AS priority FROM reviews")
def txt_priority_match(s, d):
    return reviews(s, d, "landing_id", "raw_text").select("landing_id", tx.contains_any(F.col("raw_text"), config.PRIORITY_KEYWORDS).alias("priority"))


@query(f"SELECT CASE WHEN detected_language IN ({_list(config.ALLOWED_LANGUAGES)}) THEN detected_language WHEN len(list_intersect(regexp_split_to_array(lower(raw_text), '[ \\t\\n\\r\\f\\v]+'), [{_list(config.HINGLISH_WORDS)}])) > 0 THEN 'hinglish' END AS label, count(*) AS n FROM reviews GROUP BY 1")
def txt_language_policy(s, d):
    return reviews(s, d, "detected_language", "raw_text").groupBy(tx.language_policy(F.col("detected_language"), F.col("raw_text")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


S_PLACES = ", ".join(f"CASE WHEN contains(t, '{k}') AND regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_]){k}([^\\p{{L}}\\p{{N}}_]|$)') THEN '{v}' END" for k, v in (config.REGIONS | config.CITIES).items())


@query(f"SELECT landing_id, unnest(list_distinct(list_filter([{S_PLACES}], lambda x: x IS NOT NULL))) AS location FROM (SELECT landing_id, lower({S_BEST}) AS t FROM reviews)")
def txt_location_all(s, d):
    return reviews(s, d, "landing_id", "raw_text", "translated_text").select("landing_id", F.explode(tx.location_all(best_text())).alias("location"))


S_RANKED = sorted(config.CITIES.items(), key=lambda kv: -len(kv[0])) + sorted(config.REGIONS.items(), key=lambda kv: -len(kv[0]))


@query("SELECT landing_id, CASE " + " ".join(f"WHEN regexp_matches(lower(raw_text), '(^|[^\\p{{L}}\\p{{N}}_]){k}([^\\p{{L}}\\p{{N}}_]|$)') THEN '{v}'" for k, v in S_RANKED) + " END AS location FROM reviews")
def txt_location_one(s, d):
    return reviews(s, d, "landing_id", "raw_text").select("landing_id", tx.location_one(F.col("raw_text")).alias("location"))


S_DEVICE = "CASE " + " ".join(f"WHEN {_any('t', ks)} THEN '{n}'" for n, ks in config.DEVICE_RULES) + " ELSE 'mobile' END"


@query(f"SELECT {S_DEVICE} AS device, count(*) AS n FROM (SELECT lower({S_BEST}) AS t FROM reviews) GROUP BY 1")
def txt_device(s, d):
    return reviews(s, d, "raw_text", "translated_text").groupBy(tx.device(best_text()).alias("device")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT theme_id, trim(regexp_replace(regexp_replace(trim(lower(name)), '[^\\w\\s\\-]', '', 'g'), '[\\s_\\-]+', '_', 'g'), '_') AS slug FROM decomposed_themes")
def txt_slugify(s, d):
    return table(s, d, "decomposed_themes").select("theme_id", tx.slug(F.col("name")).alias("slug"))


LINKS = {"reddit": "https://forum.example/comments/{id}", "youtube": "https://video.example/watch?c={id}", "google_play": "https://store.example/app"}


@query("SELECT landing_id, CASE source WHEN 'reddit' THEN 'https://forum.example/comments/' || regexp_replace(id, '^t[13]_', '') WHEN 'youtube' THEN 'https://video.example/watch?c=' || regexp_replace(id, '^t[13]_', '') WHEN 'google_play' THEN 'https://store.example/app' ELSE '#' END AS url FROM reviews")
def txt_review_url(s, d):
    return reviews(s, d, "landing_id", "id", "source").select("landing_id", tx.link(F.col("source"), F.col("id"), LINKS).alias("url"))


@query("SELECT landing_id, sha256(source || ':' || raw_text || ':' || published_at) AS sha, md5('x_' || substr(raw_text, 1, 50) || '_' || published_at) AS short, CASE WHEN length(raw_text) > 120 THEN substr(raw_text, 1, 120) || '...' ELSE raw_text END AS quote FROM reviews")
def id_hashes(s, d):
    return reviews(s, d, "landing_id", "source", "raw_text", "published_at").select("landing_id", tx.sha_id(F.col("source"), F.col("raw_text"), F.col("published_at")).alias("sha"), tx.md5_id(F.lit("x"), F.col("raw_text"), F.col("published_at")).alias("short"), tx.cut(F.col("raw_text"), 120).alias("quote"))


@query("SELECT landing_id, CASE WHEN rating IS NULL THEN NULL ELSE greatest(1, least(5, rating)) END AS rating, CASE WHEN length(published_at) > 10 THEN published_at ELSE coalesce(strftime(try_cast(CASE WHEN regexp_matches(published_at, '^\\d{4}-\\d\\d?-\\d\\d?$') THEN published_at END AS DATE) + INTERVAL 1 DAY, '%Y-%m-%d'), published_at) END AS end_at FROM reviews")
def num_rating_and_end(s, d):
    return reviews(s, d, "landing_id", "rating", "published_at").select("landing_id", vl.clamp_rating(F.col("rating")).alias("rating"), vl.end_of_day(F.col("published_at")).alias("end_at"))


def _number(*keys: str) -> str:
    return "greatest(0.0, coalesce(" + ", ".join(f"try_cast(json_extract_string(m, '$.{k}') AS DOUBLE)" for k in keys) + ", 0.0))"


S_POST = "CASE WHEN coalesce(json_extract_string(m, '$.is_post'), 'true') = 'false' THEN 1.0 ELSE 1.5 END"


@query(f"SELECT landing_id, round(coalesce(CASE WHEN m IS NULL THEN NULL WHEN source IN ('google_play', 'app_store') THEN 1.0 + ln(1 + {_number('thumbs_up_count', 'thumbsUpCount')}) WHEN source = 'youtube' THEN 1.0 + ln(1 + {_number('like_count', 'likeCount')}) WHEN source = 'reddit' THEN {S_POST} * (1.0 + ln(1 + {_number('upvotes', 'score')})) WHEN source = 'community_forum' THEN 1.0 + ln(1 + {_number('kudos_count', 'kudos')}) END, 1.0), 6) AS weight FROM (SELECT landing_id, source, CASE WHEN json_valid(metadata) THEN metadata END AS m FROM reviews)")
def num_engagement(s, d):
    return reviews(s, d, "landing_id", "source", "metadata").select("landing_id", F.round(vl.engagement(F.col("source"), F.col("metadata")), 6).alias("weight"))


S_PATH = f"CASE WHEN {_any('t', config.DISCOVERY_KEYWORDS)} THEN 'discovery' WHEN contains(t, 'ad') THEN 'unrelated_ads' WHEN {_any('t', config.BUG_KEYWORDS)} THEN 'unrelated_bugs' WHEN contains(t, 'widget') THEN 'unrelated_widgets' ELSE 'unrelated_general' END"


@query(f"SELECT {S_PATH} AS path, count(*) AS n FROM (SELECT lower({S_BEST}) AS t FROM reviews) GROUP BY 1")
def clu_dual_path(s, d):
    return reviews(s, d, "raw_text", "translated_text").groupBy(tx.discovery_path(best_text()).alias("path")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT landing_id, contains(lower(coalesce(metadata, '')), 'premium') OR contains(lower(" + S_BEST + "), 'premium') AS premium FROM reviews")
def flag_premium(s, d):
    return reviews(s, d, "landing_id", "metadata", "raw_text", "translated_text").select("landing_id", tx.mentions_premium(F.col("metadata"), best_text()).alias("premium"))


S_SHINGLES = f"(SELECT landing_id, list_distinct(list_transform(range(1, length(f) - 1), lambda i: substr(f, i, 3))) AS sh FROM (SELECT landing_id, regexp_replace(lower(raw_text), '{tx.BLANKS}', '', 'g') AS f FROM reviews) WHERE length(f) >= 3)"


@query(f"SELECT landing_id, len(sh) AS n_shingles, md5(array_to_string(list_sort(sh), ' ')) AS digest FROM {S_SHINGLES}")
def txt_shingles(s, d):
    sh = reviews(s, d, "landing_id", "raw_text").select("landing_id", tx.shingles(F.col("raw_text")).alias("sh")).where(F.size("sh") > 0)
    return sh.select("landing_id", F.size("sh").alias("n_shingles"), F.md5(F.array_join(F.array_sort("sh"), " ")).alias("digest"))


@query()
def txt_textrank(s, d):
    """Summaries of all documents of more than 150 words."""
    docs = table(s, d, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.length("text").alias("n_chars"), summarised(F.col("text")).alias("summary")).select("doc_id", "n_chars", F.length("summary").alias("n_summary"), F.md5("summary").alias("digest"))


@query()
def flt_process_review(s, d):
    """The whole record chain, with near-duplicates removed and long texts summarised."""
    out = process_reviews(reviews(s, d), F.lit(NOW).cast("timestamp"), "landing_id", "landing_id")
    return out.select("landing_id", "detected_language", "location", F.md5("cleaned_text").alias("digest"))


# ---- joins
@query(f"SELECT r.landing_id, e.id FROM reviews r JOIN {S_USABLE} e ON r.id = e.id")
def join_review_embedding(s, d):
    return reviews(s, d, "landing_id", "id").join(usable(s, d).select("id"), "id").select("landing_id", "id")


@query(f"SELECT r.landing_id FROM reviews r WHERE NOT EXISTS (SELECT 1 FROM {S_USABLE} e WHERE e.id = r.id) AND r.cluster_id IS NOT NULL AND NOT starts_with(r.cluster_id, 'unrelated_')")
def join_missing_embeddings(s, d):
    return reviews(s, d, "landing_id", "id", "cluster_id").where(discovery()).join(usable(s, d), "id", "left_anti").select("landing_id")


@query(f"SELECT r.landing_id FROM reviews r WHERE EXISTS (SELECT 1 FROM {S_USABLE} e WHERE e.id = r.id)")
def join_semi_existing(s, d):
    return reviews(s, d, "landing_id", "id").join(usable(s, d), "id", "left_semi").select("landing_id")


@query(f"SELECT t.theme_id, r.source, count(*) AS n FROM (SELECT DISTINCT theme_id, review_id FROM theme_reviews) t JOIN {S_CURRENT} r ON r.id = t.review_id GROUP BY 1, 2")
def join_theme_review(s, d):
    pairs = table(s, d, "theme_reviews").distinct()
    return pairs.join(current(s, d, "id", "source"), pairs.review_id == F.col("id")).groupBy("theme_id", "source").agg(F.count(F.lit(1)).alias("n"))


S_THEMES = "(SELECT DISTINCT t.theme_id, t.review_id FROM theme_reviews t WHERE t.review_id IN (SELECT id FROM reviews))"


@query(f"SELECT a.theme_id AS theme_a, b.theme_id AS theme_b, count(DISTINCT a.review_id) AS n_reviews FROM {S_THEMES} a JOIN {S_THEMES} b ON a.review_id = b.review_id GROUP BY 1, 2")
def join_cooccurrence(s, d):
    return metrics.cooccurrence(table(s, d, "theme_reviews"), reviews(s, d, "id"))


@query(f"WITH m AS (SELECT a.theme_id AS theme_a, b.theme_id AS theme_b, count(DISTINCT a.review_id) AS n_reviews FROM {S_THEMES} a JOIN {S_THEMES} b ON a.review_id = b.review_id WHERE a.theme_id <> b.theme_id GROUP BY 1, 2) SELECT *, round(n_reviews / max(n_reviews) OVER (PARTITION BY theme_a), 6) AS heat FROM m")
def agg_heat_ratio(s, d):
    return metrics.heat(metrics.cooccurrence(table(s, d, "theme_reviews"), reviews(s, d, "id")))


S_DOT = "list_inner_product({a}::DOUBLE[], {b}::DOUBLE[]) / sqrt(list_inner_product({a}::DOUBLE[], {a}::DOUBLE[]) * list_inner_product({b}::DOUBLE[], {b}::DOUBLE[]))"
S_CENTRES = "(SELECT id, max(centroid) AS centroid FROM clusters WHERE len(centroid) = 384 AND list_max(list_transform(centroid, lambda x: abs(x))) > 0 GROUP BY id)"


def _centres(s, d):
    return table(s, d, "clusters").where(vl.usable(F.col("centroid"), DIMENSION)).groupBy("id").agg(F.max("centroid").alias("centroid"))


@query(f"SELECT id, cluster, round(c, 5) AS cosine FROM (SELECT e.id, c.id AS cluster, {S_DOT.format(a='e.vector', b='c.centroid')} AS c, row_number() OVER (PARTITION BY e.id ORDER BY {S_DOT.format(a='e.vector', b='c.centroid')} DESC, c.id) AS r FROM {S_USABLE} e, {S_CENTRES} c) WHERE r = 1")
def join_knn(s, d):
    """The nearest centroid of every vector."""
    hits = search.against(usable(s, d), _centres(s, d).withColumnRenamed("id", "cid"), "id", "vector", "cid", "centroid", top=1)
    return hits.select("id", F.col("other").alias("cluster"), F.round("cosine", 5).alias("cosine"))


@query(f"SELECT e.id, c.id AS cluster FROM {S_USABLE} e, {S_CENTRES} c WHERE {S_DOT.format(a='e.vector', b='c.centroid')} >= 0.6")
def join_theme_theta(s, d):
    """All centroids of at least the verification threshold."""
    hits = search.against(usable(s, d), _centres(s, d).withColumnRenamed("id", "cid"), "id", "vector", "cid", "centroid", least=config.THEME_THRESHOLD)
    return hits.select("id", F.col("other").alias("cluster"))


# ---- aggregates
@query("SELECT s.source, count(r.source) AS total, coalesce(sum(CASE WHEN r.analysed = 1 THEN 1 ELSE 0 END), 0)::BIGINT AS analysed, max(r.published_at) AS newest, (count(r.source) - coalesce(sum(CASE WHEN r.analysed = 1 THEN 1 ELSE 0 END), 0))::BIGINT AS pending FROM (VALUES ('google_play'), ('app_store'), ('reddit'), ('youtube'), ('community_forum')) s(source) LEFT JOIN reviews r ON r.source = s.source GROUP BY 1")
def agg_source_counts(s, d):
    return metrics.source_counts(reviews(s, d, "source", "analysed", "published_at"))


@query("SELECT *, coalesce(round(discovery * 100.0 / total, 2), 0) AS discovery_percent, coalesce(round(operational * 100.0 / total, 2), 0) AS operational_percent FROM (SELECT count(*) AS total, count(*) FILTER (cluster_id IS NOT NULL AND NOT starts_with(cluster_id, 'unrelated_')) AS discovery, count(*) FILTER (starts_with(cluster_id, 'unrelated_')) AS operational, count(*) FILTER (cluster_id = 'unrelated_general') AS \"general\", count(*) FILTER (cluster_id = 'unrelated_ads') AS ads, count(*) FILTER (cluster_id = 'unrelated_bugs') AS bugs, count(*) FILTER (cluster_id = 'unrelated_widgets') AS widgets FROM reviews)")
def agg_split_ratio(s, d):
    return metrics.split_ratio(reviews(s, d, "cluster_id"))


def _shares_sql(key: str, extra: str = "") -> str:
    return f"SELECT {key}, count(*) AS n, round(coalesce(avg(rating), 0), 2) AS avg_rating, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS share_percent FROM reviews {extra} GROUP BY {key}"


@query(_shares_sql("device_type"))
def agg_device_global(s, d):
    return metrics.shares(reviews(s, d, "device_type", "rating"), "device_type")


@query(_shares_sql("device_type", "WHERE cluster_id IS NOT NULL AND NOT starts_with(cluster_id, 'unrelated_')"))
def agg_device_discovery(s, d):
    return metrics.shares(reviews(s, d, "device_type", "rating", "cluster_id").where(discovery()), "device_type")


@query(_shares_sql("source"))
def agg_source_distribution(s, d):
    return metrics.shares(reviews(s, d, "source", "rating"), "source")


@query("SELECT t.theme_id, count(p.review_id) AS n FROM decomposed_themes t LEFT JOIN (SELECT DISTINCT theme_id, review_id FROM theme_reviews) p ON p.theme_id = t.theme_id GROUP BY 1")
def agg_theme_counts(s, d):
    return table(s, d, "decomposed_themes").select("theme_id").join(table(s, d, "theme_reviews").distinct(), "theme_id", "left").groupBy("theme_id").agg(F.count("review_id").alias("n"))


@query("SELECT v.voice, coalesce(n, 0) AS n, round(coalesce(n, 0) * 100.0 / sum(coalesce(n, 0)) OVER (), 1) AS share_percent FROM (VALUES ('discovery'), ('ads'), ('bugs'), ('widgets'), ('general')) v(voice) LEFT JOIN (SELECT CASE WHEN cluster_id IS NULL OR cluster_id = 'unrelated_general' THEN 'general' WHEN cluster_id IN ('unrelated_ads', 'unrelated_bugs', 'unrelated_widgets') THEN replace(cluster_id, 'unrelated_', '') ELSE 'discovery' END AS voice, count(*) AS n FROM reviews GROUP BY 1) g ON g.voice = v.voice")
def agg_share_of_voice(s, d):
    return metrics.share_of_voice(reviews(s, d, "cluster_id"))


@query(f"SELECT theme_id, count(*) AS n, coalesce(sum(6 - rating), 0)::BIGINT AS pain, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS share_percent FROM (SELECT DISTINCT theme_id, review_id FROM theme_reviews) t JOIN {S_CURRENT} r ON r.id = t.review_id GROUP BY 1")
def agg_theme_pain(s, d):
    return metrics.theme_pain(table(s, d, "theme_reviews"), current(s, d, "id", "rating"))


@query(f"WITH c AS {S_CURRENT}, k(cluster_id, category) AS (VALUES {', '.join(f'({chr(39)}{a}{chr(39)}, {chr(39)}{b}{chr(39)})' for a, b in config.UNRELATED.items())}), w AS (SELECT cluster_id, string_agg(id, ',' ORDER BY r) AS ids FROM (SELECT cluster_id, id, row_number() OVER (PARTITION BY cluster_id ORDER BY coalesce(rating, 3), id) AS r FROM c WHERE cluster_id IN (SELECT cluster_id FROM k)) WHERE r <= 5 GROUP BY 1) SELECT k.cluster_id, k.category, count(c.id) AS n, coalesce(any_value(w.ids), '') AS critical_ids, round(count(c.id) * 100.0 / (SELECT count(*) FROM c), 2) AS share_percent FROM k LEFT JOIN c ON c.cluster_id = k.cluster_id LEFT JOIN w ON w.cluster_id = k.cluster_id GROUP BY 1, 2")
def agg_operational(s, d):
    return metrics.operational(current(s, d, "id", "cluster_id", "rating"))


@query("SELECT b AS decile, coalesce(volume, 0) AS volume, round(coalesce(a, 3.0), 2) AS avg_rating FROM (SELECT unnest(range(1, 11))::INT AS b) LEFT JOIN (SELECT least(10, greatest(1, trunc(coalesce(s, 20.0) / 10)::INT + 1)) AS decile, count(*) AS volume, avg(rating) AS a FROM reviews r LEFT JOIN (SELECT id, max(coalesce(mean_similarity, 0) * 100) AS s FROM clusters GROUP BY id) c ON c.id = r.cluster_id GROUP BY 1) g ON g.decile = b")
def agg_deciles(s, d):
    """Bins of a score per cluster, here its mean similarity times 100."""
    scores = table(s, d, "clusters").groupBy(F.col("id").alias("cluster_id")).agg(F.max(F.coalesce("mean_similarity", F.lit(0.0)) * 100).alias("opportunity_score"))
    return metrics.deciles(reviews(s, d, "cluster_id", "rating"), scores)


@query()
def agg_confusion(s, d):
    """Estimated quality of the theme assignments: members of a theme against the ids verified by vectors."""
    members = table(s, d, "theme_reviews").groupBy("theme_id").agg(F.collect_set("review_id").alias("proposed"))
    vectors = table(s, d, "theme_reviews").distinct().join(usable(s, d), F.col("review_id") == F.col("id")).select("theme_id", "vector")
    means = metrics.mean_vectors(vectors, "theme_id", "vector").select("theme_id", F.col("mean_vector").alias("vector"))
    themes = members.join(search.verified_themes(usable(s, d), means), "theme_id", "left").withColumn("verified", F.coalesce("verified", F.array().cast("array<string>")))
    return metrics.estimated_confusion(themes, F.lit(reviews(s, d, "id").count()))


@query("SELECT count(*) AS \"rows\", f.field, f.missing, CASE WHEN f.missing = n THEN 'fail' WHEN f.missing > 0 THEN 'warning' ELSE 'pass' END AS verdict FROM (SELECT count(*) AS n, count(*) FILTER (rating IS NULL) AS rating, count(*) FILTER (country IS NULL OR trim(country) = '') AS country, count(*) FILTER (sentiment IS NULL) AS sentiment, count(*) FILTER (source IS NULL OR trim(source) = '') AS source FROM reviews) t, LATERAL (SELECT unnest(['rating', 'country', 'sentiment', 'source']) AS field, unnest([rating, country, sentiment, source]) AS missing) f, reviews GROUP BY f.field, f.missing, n")
def agg_integrity(s, d):
    return metrics.integrity(reviews(s, d, "rating", "country", "sentiment", "source"), ("rating", "country", "sentiment", "source"))


S_AUDIT = f"CASE WHEN detected_language IN ({_list(config.ALLOWED_LANGUAGES)}) THEN detected_language WHEN detected_language IN ({_list(config.CONFUSABLE_LANGUAGES)}) AND len(list_intersect(regexp_split_to_array(lower(t), '[ \\t\\n\\r\\f\\v]+'), [{_list(config.HINGLISH_AUDIT_WORDS)}])) > 0 THEN 'hinglish (' || detected_language || ')' END"
S_PLAIN = "coalesce(translate(regexp_replace(raw_text, '<[^>]*>', '', 'g'), '‘’“”', chr(39) || chr(39) || chr(34) || chr(34)), '')"


@query(f"SELECT coalesce(label, detected_language, 'unknown') AS language, label IS NOT NULL AS kept, count(*) AS n FROM (SELECT detected_language, CASE WHEN t <> '' THEN {S_AUDIT} END AS label FROM (SELECT detected_language, {S_PLAIN} AS t FROM reviews)) GROUP BY 1, 2")
def agg_lang_audit(s, d):
    return metrics.language_audit(reviews(s, d, "detected_language", "raw_text"))


@query("SELECT cluster_id, count(*) AS size, round(coalesce(avg(rating), 3.0), 2) AS avg_rating, min(published_at) AS first_at, max(published_at) AS last_at FROM reviews WHERE cluster_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 3")
def agg_cluster_view(s, d):
    per = reviews(s, d, "cluster_id", "rating", "published_at").where("cluster_id is not null").groupBy("cluster_id")
    return per.agg(F.count(F.lit(1)).alias("size"), F.round(F.coalesce(F.avg("rating"), F.lit(3.0)), 2).alias("avg_rating"), F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at")).where("size >= 3")


@query(f"SELECT cluster_id, i, round(avg(x), 5) AS mean_value FROM (SELECT r.cluster_id, unnest(range(0, 384))::INT AS i, unnest(e.vector)::DOUBLE AS x FROM {S_CURRENT} r JOIN {S_USABLE} e ON e.id = r.id WHERE r.cluster_id IS NOT NULL) GROUP BY 1, 2")
def vec_mean(s, d):
    """Element-wise mean vector of every cluster, one row a place."""
    rows = current(s, d, "id", "cluster_id").where("cluster_id is not null").join(usable(s, d), "id")
    return metrics.mean_vectors(rows, "cluster_id", "vector").select("cluster_id", F.posexplode("mean_vector").alias("i", "x")).select("cluster_id", "i", F.round("x", 5).alias("mean_value"))


S_TERMS = f"(SELECT cluster_id AS g, t FROM (SELECT cluster_id, unnest(regexp_extract_all(lower({S_BEST}), '[\\p{{L}}\\p{{N}}_]+')) AS t FROM reviews WHERE cluster_id IS NOT NULL) WHERE regexp_matches(t, '^[a-z]{{3,15}}$'))"


@query(f"WITH tf AS (SELECT g, t, count(*) AS tf FROM {S_TERMS} GROUP BY 1, 2), m AS (SELECT avg(n) AS mean_length FROM (SELECT sum(tf) AS n FROM tf GROUP BY g)), u AS (SELECT * FROM tf WHERE t NOT IN ({_list(config.TERM_STOP_WORDS)})), df AS (SELECT t, count(*) AS df FROM u GROUP BY 1), w AS (SELECT u.g, u.t, u.tf * ln(1 + mean_length / df) * CASE WHEN u.t IN ({_list(config.TERM_PRIORITY_WORDS)}) THEN 1.5 ELSE 1.0 END AS w FROM u JOIN df ON df.t = u.t, m) SELECT g AS cluster_id, t AS term, round(w, 5) AS weight, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY round(w, 9) DESC, t) AS r FROM w) WHERE r <= 10")
def agg_ctfidf(s, d):
    rows = reviews(s, d, "cluster_id", "raw_text", "translated_text").withColumn("t", best_text())
    return term_weights(rows, "cluster_id", "t").select("cluster_id", "term", F.round("weight", 5).alias("weight"), "rank")


@query("SELECT cluster_id, round(CASE WHEN count(*) > 1 THEN -sum(n / t * log2(n / t)) / log2(count(*)) ELSE 0 END, 6) AS entropy FROM (SELECT cluster_id, source, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY cluster_id)::DOUBLE AS t FROM reviews WHERE cluster_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def agg_entropy(s, d):
    return source_synergy(reviews(s, d, "cluster_id", "source").where("cluster_id is not null")).select("cluster_id", F.round("entropy", 6).alias("entropy"))


@query("WITH t AS (SELECT count(*) AS total FROM reviews WHERE cluster_id IS NOT NULL) SELECT cluster_id, round(greatest(0.1, least(1.0, (5.0 - a) / 4.0)) * (n / total) * 0.8 * (1 + 0.5 * p) * 100, 6) AS score FROM (SELECT cluster_id, count(*) AS n, coalesce(avg(rating), 3.0) AS a, avg(CASE WHEN contains(lower(coalesce(metadata, '')), 'premium') OR contains(lower(" + S_BEST + "), 'premium') THEN 1 ELSE 0 END) AS p FROM reviews WHERE cluster_id IS NOT NULL GROUP BY 1), t")
def agg_opportunity(s, d):
    rows = reviews(s, d, "cluster_id", "rating", "metadata", "raw_text", "translated_text").where("cluster_id is not null")
    total = rows.count()
    per = rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("rating"), F.lit(3.0)).alias("a"), F.avg(tx.mentions_premium(F.col("metadata"), best_text()).cast("int")).alias("p"))
    return per.select("cluster_id", F.round(vl.opportunity(F.col("n"), F.lit(total), F.col("a"), F.lit(0.8), F.lit(0.0), F.col("p")), 6).alias("score"))


@query("SELECT word, sum(size)::BIGINT AS weight FROM (SELECT unnest(regexp_split_to_array(lower(regexp_replace(name, '[^a-zA-Z0-9\\s]', '', 'g')), '\\s+')) AS word, 1 AS size FROM decomposed_themes) WHERE length(word) > 3 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def agg_word_map(s, d):
    return metrics.word_map(table(s, d, "decomposed_themes").withColumn("size", F.lit(1)), "name", "size")


@query("SELECT status, count(*) AS n, sum(coalesce(CASE WHEN json_valid(fetched_json) THEN (SELECT sum(try_cast(v AS BIGINT)) FROM (SELECT unnest(json_extract_string(fetched_json, '$.*')) AS v)) END, 0))::BIGINT AS fetched FROM pipeline_runs GROUP BY 1")
def agg_run_totals(s, d):
    counts = F.aggregate(F.map_values(F.from_json("fetched_json", "map<string,bigint>")), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return table(s, d, "pipeline_runs").groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(counts, F.lit(0))).alias("fetched"))


# ---- routing, packages, clustering, near-duplicates
def _terms(s, d):
    rows = reviews(s, d, "cluster_id", "raw_text", "translated_text").withColumn("t", best_text())
    return term_weights(rows, "cluster_id", "t").groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("terms"))


S_TOP = SQL["agg_ctfidf"]


@query(f"WITH p AS (SELECT cluster_id, list(term) AS terms FROM ({S_TOP}) GROUP BY 1), k(rq_id, w) AS (VALUES {', '.join(f'({chr(39)}{q}{chr(39)}, {chr(39)}{w}{chr(39)})' for q, ws in config.QUESTION_RULES.items() for w in ws)}) SELECT DISTINCT rq_id, cluster_id FROM p, k WHERE list_contains(terms, w) OR contains(cluster_id, w)")
def route_fixed(s, d):
    return routing.route_fixed(_terms(s, d))


QUESTIONS = {"TRQ1": ("Shuffle and playlist", "Which songs repeat in playlists?"), "TRQ2": ("Downloads offline", "Why do downloads vanish?")}


@query(f"WITH p AS (SELECT cluster_id, list(term) AS terms FROM ({S_TOP}) GROUP BY 1), k(rq_id, w) AS (VALUES {', '.join(f'({chr(39)}{q}{chr(39)}, {chr(39)}{w}{chr(39)})' for q, (a, b) in QUESTIONS.items() for w in routing.question_words(a, b))}) SELECT DISTINCT rq_id, cluster_id FROM p, k WHERE contains(lower(cluster_id), w) OR len(list_filter(terms, lambda t: contains(t, w))) > 0")
def route_dynamic(s, d):
    return routing.route_dynamic(_terms(s, d), QUESTIONS)


@query(f"SELECT cluster_id, coalesce(array_to_string(list_transform(list(term ORDER BY rank)[1:3], lambda t: upper(substr(t, 1, 1)) || substr(t, 2)), ' / '), 'General Discovery') AS name FROM ({S_TOP}) GROUP BY 1")
def name_fallback(s, d):
    return _terms(s, d).select("cluster_id", routing.fallback_name(F.col("terms")).alias("name"))


def _tagging(s, d) -> dict:
    """Anchors and texts embedded by the same provider."""
    embed = HashedEmbedder(DIMENSION).embed
    anchors = s.createDataFrame(list(config.ANCHORS.items()), "name string, phrase string").select("name", embed(F.col("phrase")).alias("vector"))
    return {"anchors": anchors, "tag_vectors": current(s, d, "id", "cluster_id", "raw_text", "translated_text").where("cluster_id is not null").select("id", embed(best_text()).alias("vector"))}


def evidence_packages(s, d) -> DataFrame:
    return packages(current(s, d), table(s, d, "review_embeddings"), table(s, d, "clusters"), **_tagging(s, d))


@query()
def pkg_filtered(s, d):
    """Evidence packages of a date window and three sources, of the newest million reviews, best opportunity first."""
    return filtered_packages(current(s, d), table(s, d, "review_embeddings"), table(s, d, "clusters"), start=FROM, end=TO, sources=["google_play", "app_store", "reddit"], limit=1_000_000, **_tagging(s, d))


S_META = "(SELECT id, mean_similarity FROM clusters QUALIFY row_number() OVER (PARTITION BY id ORDER BY last_updated DESC NULLS LAST, centroid DESC, mean_similarity DESC NULLS LAST) = 1)"


@query(f"""WITH r AS (SELECT * FROM {S_CURRENT} WHERE cluster_id IS NOT NULL), v AS {S_USABLE}, m AS {S_META},
b AS (SELECT cluster_id, count(*) AS size, coalesce(avg(rating), 3.0) AS average_rating, avg(CASE WHEN contains(lower(coalesce(metadata, '')), 'premium') OR contains(lower({S_BEST}), 'premium') THEN 1 ELSE 0 END) AS premium FROM r GROUP BY 1),
e AS (SELECT cluster_id, CASE WHEN count(*) > 1 THEN -sum(n / t * log2(n / t)) / log2(count(*)) ELSE 0 END AS entropy FROM (SELECT cluster_id, source, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY cluster_id)::DOUBLE AS t FROM r GROUP BY 1, 2) GROUP BY 1),
k AS (SELECT r.cluster_id, count(*) AS n_placed FROM r JOIN v ON v.id = r.id GROUP BY 1)
SELECT b.cluster_id, b.size, round(b.average_rating, 6) AS average_rating, round(e.entropy * coalesce(m.mean_similarity, 0.8), 6) AS csss,
round(greatest(0.1, least(1.0, (5.0 - b.average_rating) / 4.0)) * (b.size / (SELECT count(*) FROM r)) * e.entropy * coalesce(m.mean_similarity, 0.8) * (1 + 0.5 * b.premium) * 100, 6) AS opportunity_score,
least(5, coalesce(k.n_placed, 0)) AS n_medoids, CASE WHEN k.n_placed >= 3 THEN 3 ELSE 0 END AS n_outliers
FROM b JOIN e ON e.cluster_id = b.cluster_id LEFT JOIN m ON m.id = b.cluster_id LEFT JOIN k ON k.cluster_id = b.cluster_id""")
def pkg_flat(s, d):
    """The figures of all evidence packages, without anchors."""
    p = packages(current(s, d), table(s, d, "review_embeddings"), table(s, d, "clusters"))
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    return p.select("cluster_id", "size", F.round("average_rating", 6).alias("average_rating"), F.round("csss", 6).alias("csss"), F.round("opportunity_score", 6).alias("opportunity_score"), size("medoids").cast("bigint").alias("n_medoids"), size("outliers").alias("n_outliers"))


@query()
def hash_package(s, d):
    p = evidence_packages(s, d)
    listed = F.concat(*[F.coalesce(c, F.slice("medoids", 1, 0)) for c in ("medoids", "outliers", "anomalies")])
    return p.where("medoids is not null").select("cluster_id", routing.package_hash(F.transform("themes", lambda t: t["term"]), listed).alias("digest"))


@query()
def prompt_evidence(s, d):
    p = evidence_packages(s, d).where("medoids is not null")
    return routing.prompts(p, routing.route_fixed(p.select("cluster_id", F.transform("themes", lambda t: t["term"]).alias("terms"))))


@query()
def clu_leader_follower(s, d):
    """Order-dependent clusters of all usable vectors: folded in parts, their leaders merged."""
    return leader_follower(usable(s, d), "id", "vector", ["id"], scaled=True)


@query()
def dedup_minhash_sig(s, d):
    """Published md5 form of the signature, as one digest a text."""
    sh = shingled(reviews(s, d, "landing_id", "raw_text"), "landing_id", "raw_text", "landing_id")
    return sh.select(F.col("k").alias("landing_id"), F.md5(F.concat_ws(",", signature(F.col("sh")))).alias("signature"))


@query()
def dedup_lsh(s, d):
    """Which reviews are kept by first-come near-duplicate removal."""
    return near_duplicates(reviews(s, d, "landing_id", "raw_text"), "landing_id", "raw_text", "landing_id")


@query("SELECT least(10, 1 + (landing_id % 10))::INT AS bucket, count(*) AS n FROM (SELECT min(landing_id) AS landing_id FROM reviews GROUP BY id) GROUP BY 1")
def dedup_exact_id(s, d):
    firsts = records.first_occurrence(reviews(s, d, "id", "landing_id"), "id", "landing_id")
    return firsts.groupBy((1 + F.col("landing_id") % 10).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, date_trunc('hour', ts) AS \"hour\", count(*) AS n FROM events GROUP BY 1, 2")
def stm_counts(s, d):
    """The batch form of the running counts."""
    return table(s, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
