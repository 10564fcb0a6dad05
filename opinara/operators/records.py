"""Keyed changes of tables, as DataFrames in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of every key in the given order; null keys are dropped."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.where(F.col(key).isNotNull()).withColumn("_r", rank).where("_r = 1").drop("_r")


def upsert(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = (), reset: dict[str, object] | None = None, only: tuple[str, ...] | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` merged in by key (keys of ``new`` must be unique).

    A row under a known key takes the new values, but keeps those named in ``keep``; ``only`` restricts the columns
    that may change; ``reset`` sets columns of every merged row.
    """
    changed = [c for c in (only or new.columns) if c != key and c not in keep]
    n = new.select(F.col(key), F.lit(True).alias("_new"), *[F.col(c).alias(f"_n_{c}") for c in new.columns if c != key])
    both = old.withColumn("_old", F.lit(True)).join(n, key, "full_outer")
    cols = []
    for c in old.columns:
        if c == key:
            cols.append(F.col(c))
            continue
        value = F.col(c)
        if c in new.columns:
            fresh = F.col(f"_n_{c}")
            value = F.when(F.col("_old").isNull(), fresh)
            value = value.when(F.col("_new").isNotNull(), fresh).otherwise(F.col(c)) if c in changed else value.otherwise(F.col(c))
        if reset and c in reset:
            value = F.when(F.col("_new").isNotNull(), F.lit(reset[c])).otherwise(value)
        cols.append(value.alias(c))
    return both.select(*cols)


def insert_ignore(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` and those rows of ``new`` whose key it lacks; of a repeated new key one row."""
    fresh = new.dropDuplicates([key]).join(old.select(key), key, "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True)


def mark(df: DataFrame, ids: DataFrame, key: str, column: str, value: object) -> DataFrame:
    """Set a column for the keys in ``ids``."""
    hit = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    return df.join(hit, key, "left").withColumn(column, F.when(F.col("_hit"), F.lit(value)).otherwise(F.col(column))).drop("_hit")


def newest_per_source(df: DataFrame, limits: dict[str, int], at: str, key: str, source: str = "source") -> DataFrame:
    """The newest rows of every source, as many as its limit; sources without a limit give none."""
    limit = F.coalesce(*[F.when(F.col(source) == s, F.lit(n)) for s, n in limits.items()], F.lit(0)) if limits else F.lit(0)
    rank = F.row_number().over(Window.partitionBy(source).orderBy(F.col(at).desc_nulls_last(), F.col(key)))
    return df.where(F.col(source).isin(*limits)).withColumn("_r", rank).where(F.col("_r") <= limit).drop("_r")


def first_occurrence(df: DataFrame, key: str, order: str) -> DataFrame:
    return latest(df, key, [F.col(order).asc_nulls_last()])


def replica(primary: DataFrame, staged: DataFrame, sources: tuple[str, ...] = ("google_play", "app_store"), key: str = "id") -> DataFrame:
    """The staging table with the storefront rows it lacks."""
    return insert_ignore(staged, primary.where(F.col("source").isin(*sources)), key)


def prune(df: DataFrame, keep: Column) -> DataFrame:
    """Rows for which the audit holds; an audit of null drops the row."""
    return df.where(F.coalesce(keep, F.lit(False)))
