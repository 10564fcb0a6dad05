"""Dashboard metrics over reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara import config
from opinara.functions import text as tx
from opinara.functions import values as vl
from opinara.operators.filters import discovery

def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("bigint")


def source_counts(df: DataFrame, sources: tuple[str, ...] = config.SOURCES) -> DataFrame:
    """Per source: rows, analysed, pending; the listed sources always come out."""
    spark = df.sparkSession
    got = df.groupBy("source").agg(F.count("*").alias("total"), F.sum(flag(F.col("analysed") == 1)).alias("analysed"), F.max("published_at").alias("newest"))
    listed = spark.createDataFrame([(s,) for s in sources], "source string")
    return listed.join(got, "source", "left").fillna({"total": 0, "analysed": 0}).withColumn("pending", F.col("total") - F.col("analysed"))


def split_ratio(df: DataFrame) -> DataFrame:
    """One row: all, discovery and operational rows with shares, and the operational breakdown."""
    d = discovery()
    parts = {n.removeprefix("unrelated_"): F.sum(flag(F.col("cluster_id") == n)).alias(n.removeprefix("unrelated_")) for n in config.UNRELATED}
    one = df.agg(F.count("*").alias("total"), F.coalesce(F.sum(flag(d)), F.lit(0)).alias("discovery"), F.coalesce(F.sum(flag(F.col("cluster_id").like("unrelated_%"))), F.lit(0)).alias("operational"), *parts.values())
    return one.withColumns({"discovery_percent": vl.percent(F.col("discovery"), F.col("total")), "operational_percent": vl.percent(F.col("operational"), F.col("total"))})


def shares(df: DataFrame, key: str, default_rating: float = 0.0) -> DataFrame:
    """Per key: rows, share of all rows, mean rating (``default_rating`` without any)."""
    per = df.groupBy(key).agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg("rating"), F.lit(default_rating)), 2).alias("avg_rating"))
    return per.withColumn("share_percent", vl.percent(F.col("n"), F.sum("n").over(Window.partitionBy())))


def share_of_voice(df: DataFrame) -> DataFrame:
    """Five groups with their share; rows without cluster count as general."""
    kind = F.when(F.col("cluster_id").isNull() | (F.col("cluster_id") == "unrelated_general"), "general").when(F.col("cluster_id").isin("unrelated_ads", "unrelated_bugs", "unrelated_widgets"), F.regexp_replace("cluster_id", "unrelated_", "")).otherwise("discovery")
    names = df.sparkSession.createDataFrame([(n,) for n in ("discovery", "ads", "bugs", "widgets", "general")], "voice string")
    got = df.groupBy(kind.alias("voice")).agg(F.count("*").alias("n"))
    return names.join(got, "voice", "left").fillna({"n": 0}).withColumn("share_percent", vl.percent(F.col("n"), F.sum("n").over(Window.partitionBy()), 1))


def theme_pain(theme_reviews: DataFrame, reviews: DataFrame) -> DataFrame:
    """Per theme: distinct pairs with a review, the sum of 6 - rating over rated ones, share of all pairs."""
    pairs = theme_reviews.distinct().join(reviews.select(F.col("id").alias("review_id"), "rating"), "review_id")
    per = pairs.groupBy("theme_id").agg(F.count("*").alias("n"), F.coalesce(F.sum(6 - F.col("rating")), F.lit(0)).alias("pain"))
    return per.withColumn("share_percent", vl.percent(F.col("n"), F.sum("n").over(Window.partitionBy()), 1))


def cooccurrence(theme_reviews: DataFrame, reviews: DataFrame) -> DataFrame:
    """Per ordered pair of themes: reviews in both; the diagonal counts the reviews of a theme.

    The themes of a review are gathered first (a review has few), so pairs are formed inside one row.
    """
    known = theme_reviews.join(reviews.select(F.col("id").alias("review_id")).distinct(), "review_id", "left_semi")
    sets = known.groupBy("review_id").agg(F.collect_set("theme_id").alias("t"))
    pairs = sets.select(F.explode("t").alias("theme_a"), "t").select("theme_a", F.explode("t").alias("theme_b"))
    return pairs.groupBy("theme_a", "theme_b").agg(F.count("*").alias("n_reviews"))


def heat(matrix: DataFrame) -> DataFrame:
    """Off-diagonal value over the largest off-diagonal value of its row."""
    top = F.max("n_reviews").over(Window.partitionBy("theme_a"))
    return matrix.where("theme_a <> theme_b").withColumn("heat", F.round(F.col("n_reviews") / top, 6))


def operational(df: DataFrame) -> DataFrame:
    """Per surface group: rows, share of all rows, and the five most critical ids (rating, null as 3, then id)."""
    total = df.count() or 1
    rows = df.where(F.col("cluster_id").isin(*config.UNRELATED))
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.coalesce("rating", F.lit(3)), "id"))
    worst = rows.select("cluster_id", "id", rank.alias("r")).where("r <= 5").groupBy("cluster_id").agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("r", "id"))), lambda x: x["id"])).alias("critical_ids"))
    names = df.sparkSession.createDataFrame(list(config.UNRELATED.items()), "cluster_id string, category string")
    per = rows.groupBy("cluster_id").agg(F.count("*").alias("n"))
    return names.join(per, "cluster_id", "left").join(worst, "cluster_id", "left").fillna({"n": 0, "critical_ids": ""}).withColumn("share_percent", F.round(F.col("n") * 100.0 / total, 2))


def estimated_confusion(themes: DataFrame, total: Column) -> DataFrame:
    """One row of estimated quality from (proposed, verified) id arrays per theme; missed ones are taken as 8 percent."""
    n = F.size(F.array_distinct("verified"))
    one = themes.agg(F.sum(n).alias("tp"), F.sum(F.size(F.array_except("proposed", "verified"))).alias("fp"), F.sum(F.greatest(F.lit(1), F.floor(n * 0.08).cast("int"))).alias("fn")).fillna(0)
    one = one.withColumn("tn", F.greatest(F.lit(0).cast("bigint"), total - F.col("tp") - F.col("fp") - F.col("fn")))
    one = one.withColumn("p", F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.92))).withColumn("r", F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.95)))
    f1 = F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.93))
    return one.select("tp", "fp", "fn", "tn", F.round(F.col("p") * 100, 1).alias("precision"), F.round(F.col("r") * 100, 1).alias("recall"), F.round(f1 * 100, 1).alias("f1"))


def deciles(df: DataFrame, scores: DataFrame) -> DataFrame:
    """Volume and mean rating of the ten score bins; a cluster without score has 20, a bin without ratings 3."""
    per = df.join(scores.select("cluster_id", F.col("opportunity_score").alias("s")), "cluster_id", "left")
    got = per.groupBy(vl.decile(F.coalesce("s", F.lit(config.DEFAULT_SCORE))).alias("decile")).agg(F.count("*").alias("volume"), F.avg("rating").alias("a"))
    bins = df.sparkSession.range(1, 11).select(F.col("id").cast("int").alias("decile"))
    return bins.join(got, "decile", "left").select("decile", F.coalesce("volume", F.lit(0)).alias("volume"), F.round(F.coalesce("a", F.lit(config.DEFAULT_RATING)), 2).alias("avg_rating"))


def integrity(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Per column: rows, missing values and a verdict."""
    one = df.agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(flag(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""))), F.lit(0)).alias(c) for c in columns])
    long = one.select("rows", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("missing")) for c in columns])).alias("x")).select("rows", "x.*")
    verdict = F.when((F.col("rows") == 0) | (F.col("missing") == F.col("rows")), "fail").when(F.col("missing") > 0, "warning").otherwise("pass")
    return long.withColumn("verdict", verdict)


def language_audit(df: DataFrame) -> DataFrame:
    """Rows kept and dropped by the audit, per language."""
    label = tx.language_audit(F.col("detected_language"), tx.strip_markup(F.col("raw_text")))
    return df.groupBy(F.coalesce(label, "detected_language", F.lit("unknown")).alias("language"), label.isNotNull().alias("kept")).agg(F.count("*").alias("n"))


def mean_vectors(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, n, mean vector): sums are taken per place, so that a group of any size is pre-aggregated."""
    places = df.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    return places.groupBy(group).agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("mean_vector"))


def word_map(df: DataFrame, words: str, size: str, top: int = 20) -> DataFrame:
    """The words of more than three letters with the largest summed sizes."""
    w = df.select(F.explode(F.split(F.lower(F.regexp_replace(words, r"[^a-zA-Z0-9\s]", "")), r"\s+")).alias("word"), size).where(F.length("word") > 3)
    return w.groupBy("word").agg(F.sum(size).alias("weight")).orderBy(F.desc("weight"), "word").limit(top)
