"""Landed payloads of the review sources as rows of the review schema.  Fetching them is left to the landing job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.functions import text as tx
from opinara.schemas import REVIEW_DDL, conform


def _rows(df: DataFrame, source: str, key: Column, text: Column, at: Column, rating: Column | None = None, country: Column | None = None) -> DataFrame:
    text = F.trim(text)
    rows = df.select(
        F.coalesce(key.cast("string"), tx.sha_id(F.lit(source), text, at.cast("string"))).alias("id"), text.alias("raw_text"), (rating if rating is not None else F.lit(None)).cast("int").alias("rating"),
        F.lit(source).alias("source"), (country if country is not None else F.lit(None)).cast("string").alias("country"), at.cast("string").alias("published_at"), F.lit(0).alias("analysed"),
    )
    return conform(rows.where(F.length("raw_text") > 0), REVIEW_DDL)


def play_store(df: DataFrame, country: str = "in") -> DataFrame:
    """Fields: reviewId, content, score, at."""
    return _rows(df, "google_play", F.col("reviewId"), F.col("content"), F.col("at"), F.col("score"), F.lit(country))


def app_store(df: DataFrame, country: str = "in") -> DataFrame:
    """Fields: id, title, review, rating, date; the text is title and review on two lines."""
    return _rows(df, "app_store", F.col("id"), F.concat_ws("\n", F.nullif(F.trim("title"), F.lit("")), F.nullif(F.trim("review"), F.lit(""))), F.col("date"), F.col("rating"), F.lit(country))


def forum(df: DataFrame) -> DataFrame:
    """Fields: title, body, date (already cut out of the page)."""
    return _rows(df, "community_forum", F.lit(None), F.concat_ws("\n", F.nullif(F.trim("title"), F.lit("")), F.nullif(F.trim(tx.strip_markup(F.col("body"))), F.lit(""))), F.col("date"))


def forum_pages(df: DataFrame, html: str = "html") -> DataFrame:
    """(title, body) of every message of landed pages: elements of class ``subject``/``title`` and ``body``/``message``."""
    block = F.explode(F.regexp_extract_all(html, F.lit(r"(?is)<(?:article|li|div)[^>]*class=\"[^\"]*message[^\"]*\"[^>]*>(.*?)</(?:article|li)>"), 1)).alias("b")
    title = F.regexp_extract("b", r"(?is)<[^>]*class=\"[^\"]*(?:subject|title)[^\"]*\"[^>]*>(.*?)</", 1)
    body = F.regexp_extract("b", r"(?is)<[^>]*class=\"[^\"]*body[^\"]*\"[^>]*>(.*?)</(?:div|p)>", 1)
    date = F.regexp_extract("b", r"(?is)<time[^>]*datetime=\"([^\"]*)\"", 1)
    return df.select(block).select(F.trim(tx.strip_markup(title)).alias("title"), F.trim(tx.strip_markup(body)).alias("body"), F.nullif(date, F.lit("")).alias("date"))


def youtube(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Fields: id, text, published_at; comments inside the window, bounds included."""
    at = F.try_to_timestamp(F.col("published_at"))
    if start:
        df = df.where(at >= F.lit(start).cast("timestamp"))
    if end:
        df = df.where(at < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp"))
    return _rows(df, "youtube", F.col("id"), F.col("text"), F.col("published_at"))


def reddit(df: DataFrame) -> DataFrame:
    """Fields: id, title, body, created, comments array<struct<id,body,created>>: posts and their comments as rows."""
    posts = _rows(df, "reddit", F.concat(F.lit("t3_"), "id"), F.concat_ws("\n", F.nullif(F.trim("title"), F.lit("")), F.nullif(F.trim("body"), F.lit(""))), F.col("created"))
    inner = df.select(F.explode_outer("comments").alias("c")).where("c is not null").select("c.*")
    return posts.unionByName(_rows(inner, "reddit", F.concat(F.lit("t1_"), "id"), F.col("body"), F.col("created")))


def dataset(spark: SparkSession, paths: list[str], kind: str) -> DataFrame:
    """Past exports of JSON objects with text and date."""
    df = spark.read.json(paths)
    return _rows(df, kind, tx.md5_id(F.lit(kind), F.col("text"), F.col("date").cast("string")), F.col("text"), F.col("date"))


def targeted(spark: SparkSession, groups: list[str], keywords: list[str], template: str, most: int = 10) -> DataFrame:
    """Search addresses of every group and keyword, the first ``most`` in order; both lists are plain parameters."""
    rows = [(g, k, template.format(group=g, keyword=k)) for g in groups for k in keywords][:most]
    return spark.createDataFrame(rows, "group_name string, keyword string, url string")


def artifact(spark: SparkSession, candidates: list[str], schema: str) -> DataFrame:
    """The first JSON document that can be read, else an empty table."""
    for path in candidates:
        try:
            df = spark.read.schema(schema).json(path, multiLine=True)
            df.take(1)
        except Exception:  # noqa: BLE001  the next candidate is tried
            continue
        return df
    return spark.createDataFrame([], schema)
