"""Queries over mixed timestamp notations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.operators.timestamps import CANONICAL, normalise_timestamps
from opinara.sources.tables import table


def _normalised(spark: SparkSession, d: str) -> DataFrame:
    reviews = table(spark, d, "reviews").select("landing_id", "source", "country", "published_at", "scraped_at", "created_at")
    return normalise_timestamps(reviews, table(spark, d, "source_locales"), table(spark, d, "zone_abbreviations"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every readable value that is not yet in the canonical form, as microseconds since 1970 in UTC."""
    return _normalised(spark, d).where(~F.col("value").rlike(CANONICAL)).select("landing_id", "field_name", "utc_micros")


def p1_notations(spark: SparkSession, d: str) -> DataFrame:
    """Values per field and notation, with the number of those that had several readings."""
    return _normalised(spark, d).groupBy("field_name", "notation").agg(F.count(F.lit(1)).alias("n_values"), F.sum((F.col("n_readings") > 1).cast("bigint")).alias("n_ambiguous"))


QUERIES = {"p1_found": p1_found, "p1_notations": p1_notations}
SQL: dict[str, str] = {}
