"""Schemas of the tables and nested documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REVIEW_DDL = (
    "id string, raw_text string, translated_text string, rating int, source string, country string, sentiment double, location string, published_at string, "
    "created_at string, scraped_at string, analysed int, last_run_id string, detected_language string, cleaned_text string, metadata string, cluster_id string, device_type string"
)
EMBEDDING_DDL = "id string, vector array<float>"
CLUSTER_DDL = "id string, centroid array<float>, size int, mean_similarity double, variance double, last_updated timestamp"
RUN_DDL = "run_id string, started_at string, completed_at string, status string, fetched_json string, analysed_json string"
CACHE_DDL = "key string, value string, updated_at timestamp"
THEME_DDL = "theme_id string, name string, description string, category string, updated_at timestamp"
THEME_REVIEW_DDL = "theme_id string, review_id string"
ANSWER_DDL = "rq_id string, title string, content string, confidence_score double, updated_at timestamp"


def ensure_columns(df: DataFrame, ddl: str) -> DataFrame:
    """Add the columns of a schema that a DataFrame lacks, as typed nulls; extra columns stay."""
    want = T.StructType.fromDDL(ddl)
    have = {c.lower() for c in df.columns}
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in want if f.name.lower() not in have}) if any(f.name.lower() not in have for f in want) else df


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Exactly the columns of a schema, in its order and types; unreadable values become null."""
    df = ensure_columns(df, ddl)
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(ddl)])
