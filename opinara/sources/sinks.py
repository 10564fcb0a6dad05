"""Writers.  A table is replaced by writing beside it and swapping, so that a reader of the old one is never cut off."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _swap(spark: SparkSession, new: str, path: str) -> None:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target, source = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(new)
    fs = target.getFileSystem(conf)
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}.old-{uuid.uuid4().hex}")
    if fs.exists(target):
        fs.rename(target, aside)
    fs.rename(source, target)
    fs.delete(aside, True)


def replace_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Replace a Parquet table, which ``df`` may read from."""
    new = f"{path}.new-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(new) if partition_by else df.write.parquet(new)
    _swap(df.sparkSession, new, path)


def append_table(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_documents(df: DataFrame, path: str) -> None:
    """One JSON document a row."""
    df.write.mode("overwrite").json(path)


def run_record(run_id: str, status: str, fetched: Column, analysed: Column, at: Column, counts: DataFrame) -> DataFrame:
    """One run row with per-source counts as JSON maps, out of (source, fetched, analysed) rows."""
    return counts.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", fetched))))).alias("fetched_json"), F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", analysed))))).alias("analysed_json")).select(F.lit(run_id).alias("run_id"), at.cast("string").alias("started_at"), F.when(F.lit(status) == "completed", at.cast("string")).alias("completed_at"), F.lit(status).alias("status"), "fetched_json", "analysed_json")
