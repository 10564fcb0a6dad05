"""Queries over review and document texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.llm.duplicates import copy_groups, one_per_group
from opinara.llm.language import identify, normal_label
from opinara.llm.moderation import CASE, moderate
from opinara.llm.privacy import find_details
from opinara.llm.quality import text_quality
from opinara.sources.tables import table


N_WORDS = r"[\p{L}\p{N}][\p{L}\p{M}\p{N}'’\-]*"


def _languages(spark: SparkSession, d: str) -> DataFrame:
    return identify(table(spark, d, "reviews").select("landing_id", "raw_text", "detected_language"), table(spark, d, "language_samples"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "reviews").select("landing_id", normal_label(F.col("detected_language")).alias("label"), F.size(F.regexp_extract_all("raw_text", F.lit(N_WORDS), 0)).alias("n"))
    langs = F.array_distinct(F.transform("segments", lambda s: s["lang"]))
    found = _languages(spark, d).select("landing_id", langs.alias("langs")).join(own.where("n >= 4"), "landing_id")
    case = (F.size("langs") > 1) | F.col("label").isNull() | (F.col("label") != F.get("langs", F.lit(0)))
    return found.where(case).select("landing_id", F.explode("langs").alias("lang"))


def p4_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every segment of every review, with language and confidence; texts without words give ``und``."""
    seg = _languages(spark, d).select("landing_id", F.posexplode_outer("segments").alias("segment_no", "s"))
    return seg.select("landing_id", F.coalesce("segment_no", F.lit(0)).alias("segment_no"), F.coalesce("s.lang", F.lit("und")).alias("lang"), F.coalesce("s.confidence", F.lit(0.0)).alias("confidence"), "s.seg_start", "s.seg_end")


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return moderate(table(spark, d, "reviews").select("landing_id", "raw_text"), table(spark, d, "moderation_samples"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).where(F.col("score") >= CASE).select("landing_id")


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    """Per source, whatever its spelling: reviews, cases and their rate."""
    source = F.lower(F.trim(F.regexp_replace("source", "[-_]", "_")))
    scored = _scores(spark, d).join(table(spark, d, "reviews").select("landing_id", source.alias("source_name")), "landing_id")
    return scored.groupBy("source_name").agg(F.count(F.lit(1)).alias("n_reviews"), F.sum((F.col("score") >= CASE).cast("bigint")).alias("n_cases"), F.round(F.avg((F.col("score") >= CASE).cast("double")), 6).alias("case_rate"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    rows = copy_groups(table(spark, d, "reviews").select("landing_id", "raw_text", "source"))
    return rows.where("record_id <> first_id").select(F.col("first_id").alias("first_landing_id"), F.col("record_id").alias("landing_id"))


def p6_records(spark: SparkSession, d: str) -> DataFrame:
    """One record of each group, with its number of copies."""
    return one_per_group(table(spark, d, "reviews").select("landing_id", "id", "raw_text", "source")).select("landing_id", "id", "source", "n_copies")


def _details(spark: SparkSession, d: str) -> DataFrame:
    """Details of both text fields; a translation equal to its raw text is read once."""
    both = table(spark, d, "reviews").select("landing_id", "raw_text", "translated_text")
    same = F.col("raw_text") == F.col("translated_text")
    fields = F.when(same, F.array(F.struct(F.lit("raw_text,translated_text").alias("fields"), F.col("raw_text").alias("text")))).otherwise(F.array(*[F.struct(F.lit(f).alias("fields"), F.col(f).alias("text")) for f in ("raw_text", "translated_text")]))
    rows = both.select("landing_id", F.inline(fields)).where(F.length("text") > 0)
    return find_details(rows, table(spark, d, "name_list"), ["landing_id", "fields"], "text").withColumn("field_name", F.explode(F.split("fields", ","))).drop("fields")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _details(spark, d).select("landing_id", "field_name", F.explode(F.array_distinct(F.transform("details", lambda x: x["kind"]))).alias("kind"))


def p7_masked(spark: SparkSession, d: str) -> DataFrame:
    """Every text with typed placeholders, and the number of details replaced."""
    return _details(spark, d).select("landing_id", "field_name", "masked", F.size("details").alias("n_details"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return text_quality(table(spark, d, "documents").select("doc_id", "text")).where("not is_prose").select("doc_id")


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return text_quality(table(spark, d, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (p3_found, p3_rates, p4_found, p4_segments, p6_found, p6_records, p7_found, p7_masked, p10_found, p10_statistics)}
SQL: dict[str, str] = {}
