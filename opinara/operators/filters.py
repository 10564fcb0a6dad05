"""Predicates over review rows and the record preprocessing chain."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara import config
from opinara.functions import text as tx
from opinara.functions import values as vl
from opinara.operators.dedup import near_duplicates
from opinara.operators.summary import summarised
from opinara.runtime import written


@dataclass
class ReviewFilter:
    """Filter of dashboard queries; nothing set means no filter.

    Country and language hold for ``geo_source`` only, other sources pass.  ``end`` includes its whole day.
    With ``only_latest`` the rows of ``run_id`` count and the other filters do not; without a run there are none.
    """

    sources: list[str] = field(default_factory=list)
    start: str | None = None
    end: str | None = None
    min_rating: int | None = None
    max_rating: int | None = None
    country: str | None = None
    lang: str | None = None
    only_latest: bool = False
    run_id: str | None = None
    geo_source: str = "google_play"

    def column(self) -> Column:
        if self.only_latest:
            return F.col("last_run_id") == self.run_id if self.run_id else F.lit(False)
        out = F.lit(True)
        if self.sources:
            out &= F.col("source").isin(*self.sources)
        if self.start:
            out &= F.col("published_at") >= self.start
        if self.end:
            out &= F.col("published_at") <= vl.end_of_day(F.lit(self.end))
        if self.min_rating is not None:
            out &= F.col("rating") >= self.min_rating
        if self.max_rating is not None:
            out &= F.col("rating") <= self.max_rating
        for name, value in (("country", self.country), ("detected_language", self.lang)):
            if value and value != "all":
                out &= (F.col("source") != self.geo_source) | (F.col(name) == value)
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(self.column())


def discovery(cluster: str = "cluster_id") -> Column:
    """In a detailed cluster: a cluster id that is no surface group."""
    return F.col(cluster).isNotNull() & ~F.col(cluster).like("unrelated_%")


def target_run(runs: DataFrame) -> DataFrame:
    """The running run, else the newest completed one: at most one row."""
    rank = F.when(F.col("status") == "running", 0).when(F.col("status") == "completed", 1)
    return runs.where(rank.isNotNull()).orderBy(rank, F.col("started_at").desc_nulls_last(), "run_id").limit(1).select("run_id")


def in_range(at: Column, start: str | None, end: str | None) -> Column:
    """Within the window; missing or unreadable dates count as within."""
    day = F.substring(at, 1, 10).try_cast("date")
    out = F.lit(True)
    if start:
        out &= F.coalesce(day >= F.lit(start).cast("date"), F.lit(True))
    if end:
        out &= F.coalesce(day <= F.lit(end).cast("date"), F.lit(True))
    return out


def mismatch(df: DataFrame, start: str | None, end: str | None, requested: int) -> DataFrame:
    """One row: rows in and out of range, and whether a decision is needed because too few are in range."""
    flag = in_range(F.col("published_at"), start, end)
    return df.agg(F.coalesce(F.sum(flag.cast("bigint")), F.lit(0)).alias("in_range"), F.coalesce(F.sum((~flag).cast("bigint")), F.lit(0)).alias("out_of_range")).withColumn(
        "needs_decision", F.lit(bool(start or end)) & (F.col("in_range") < requested) & (F.col("out_of_range") > 0)
    )


def decide(df: DataFrame, start: str | None, end: str | None, decision: str) -> DataFrame:
    """``strict`` keeps the rows in range, ``expand`` all."""
    return df if decision == "expand" else df.where(in_range(F.col("published_at"), start, end))


def short(text: Column, keywords: list[str] | None = None) -> Column:
    """Too few meaningful words and no priority keyword."""
    return (tx.meaningful_words(text) < config.MIN_WORDS) & ~tx.contains_any(text, keywords or config.PRIORITY_KEYWORDS)


def preprocess(df: DataFrame, now: Column, *, lang: str = "detected_language", translate=None, keywords: list[str] | None = None) -> DataFrame:  # noqa: ANN001
    """The record chain up to de-duplication: blank, horizon, markup, language, translation, details, location, length.

    ``translate`` maps (text column, language column) to a text column; without it texts stay as they are.
    ``translated_text`` is set only for languages other than English.  The horizon holds for times with a zone; times
    without one and unreadable ones are kept.
    """
    fresh = ~vl.has_zone(F.col("published_at")) | vl.within_horizon(F.try_to_timestamp(F.col("published_at")), now)
    df = df.where(F.length(F.trim("raw_text")) > 0).where(fresh)
    df = df.withColumn("_clean", tx.strip_markup(F.col("raw_text")))
    df = df.withColumn("_label", tx.language_policy(F.lower(F.coalesce(F.nullif(F.trim(lang), F.lit("")), F.lit("en"))), F.col("_clean"))).where("_label is not null")
    moved = translate(F.col("_clean"), F.col("_label")) if translate else F.col("_clean")
    df = df.withColumn("cleaned_text", tx.strip_details(F.when(F.col("_label") == "en", F.col("_clean")).otherwise(moved)))
    # bound in a lambda, the cleaned text is made once for all keywords
    df = df.where(~F.exists(F.array("cleaned_text"), lambda t: short(t, keywords)))
    return df.withColumns({
        "location": F.coalesce(tx.location_one(F.col("raw_text")), tx.location_one(F.col("cleaned_text"))),
        "translated_text": F.when(F.col("_label") != "en", F.col("cleaned_text")),
        "detected_language": F.col("_label"),
    }).drop("_clean", "_label")


def process_reviews(df: DataFrame, now: Column, key: str, order: str, **options) -> DataFrame:  # noqa: ANN003
    """The whole record chain: :func:`preprocess`, then near-duplicate removal in ``order`` (first come, first kept) and
    the summary of long texts.  ``key`` is unique; texts too short for shingles are never duplicates."""
    rows = written(preprocess(df, now, **options), "processed-reviews")
    lost = near_duplicates(rows, key, "cleaned_text", order).where("not kept").select(key)
    rows = rows.join(lost, key, "left_anti").withColumn("cleaned_text", summarised(F.col("cleaned_text")))
    return rows.withColumn("translated_text", F.when(F.col("translated_text").isNotNull(), F.col("cleaned_text")))
