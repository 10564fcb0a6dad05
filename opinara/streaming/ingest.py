"""Structured Streaming forms: landing, de-duplication, running counts and incremental clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from opinara.operators.filters import preprocess
from opinara.operators.records import insert_ignore, upsert
from opinara.schemas import REVIEW_DDL
from opinara.sources.sinks import replace_table


def landed(spark: SparkSession, path: str, ddl: str = REVIEW_DDL, files_per_trigger: int = 16) -> DataFrame:
    """Landed Parquet files as a stream; the number of files a trigger bounds a micro-batch."""
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def fresh(stream: DataFrame, key: str = "id", at: str = "event_time", delay: str = "1 day") -> DataFrame:
    """First row of every key within the watermark; ``at`` is derived from ``published_at`` where it is missing."""
    if at not in stream.columns:
        stream = stream.withColumn(at, F.coalesce(F.try_to_timestamp(F.col("published_at")), F.current_timestamp()))
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def cleaned(stream: DataFrame, now=None) -> DataFrame:  # noqa: ANN001
    """The record chain up to de-duplication on a stream."""
    return preprocess(stream, now if now is not None else F.current_timestamp())


def counts(stream: DataFrame, key: str = "source") -> DataFrame:
    """Running counts, for ``complete`` or ``update`` output."""
    return stream.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def windowed(stream: DataFrame, at: str, size: str = "1 hour", delay: str = "1 hour", key: str = "source") -> DataFrame:
    """Counts per event-time window; rows later than ``delay`` are dropped."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, size), key).agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", key, "n")


def upsert_into(path: str, key: str = "id", ignore: bool = False):  # noqa: ANN201
    """A ``foreachBatch`` function that merges a micro-batch into a Parquet table; repeating a batch changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates([key])
        try:
            old = spark.read.parquet(path)
        except Exception:  # noqa: BLE001  the first batch makes the table
            replace_table(rows, path)
            return
        replace_table(insert_ignore(old, rows, key) if ignore else upsert(old, rows, key, keep=("created_at", "source", "country"), reset={"analysed": 0}), path)

    return write


def run_once(stream: DataFrame, write, checkpoint: str, mode: str = "append") -> StreamingQuery:  # noqa: ANN001
    """Process all that is there, batch by batch, and stop."""
    return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


STATE = "centroids binary, sizes array<int>, dimension int"


def incremental_clusters(stream: DataFrame, threshold: float, key: str = "id", vector: str = "vector", part: str = "part") -> DataFrame:
    """(part, id, cluster_id): leader-follower clusters kept in state, one state per value of ``part``."""
    kinds = dict(stream.dtypes)

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cents, sizes = [], []
        if state.exists:
            raw, old, d = state.get
            cents = list(np.frombuffer(raw, np.float32).reshape(-1, d).copy())
            sizes = list(old)
        for pdf in frames:
            pdf = pdf.sort_values(key)
            out = []
            for v in pdf[vector]:
                x = np.asarray(v, np.float32)
                n = float(np.linalg.norm(x))
                x = x / n if n > 0 else x
                sims = np.stack(cents) @ x if cents else np.zeros(0)
                k = int(sims.argmax()) if len(sims) else -1
                if k >= 0 and sims[k] >= threshold:
                    c = (cents[k] * sizes[k] + x) / (sizes[k] + 1)
                    m = float(np.linalg.norm(c))
                    cents[k] = c / m if m > 0 else c
                    sizes[k] += 1
                else:
                    k = len(cents)
                    cents.append(x)
                    sizes.append(1)
                out.append(f"cluster_{k + 1}")
            yield pd.DataFrame({part: [keys[0]] * len(pdf), key: pdf[key].to_numpy(), "cluster_id": out})
        if cents:
            state.update((np.stack(cents).tobytes(), [int(s) for s in sizes], len(cents[0])))

    return stream.groupBy(part).applyInPandasWithState(step, f"{part} {kinds[part]}, {key} {kinds[key]}, cluster_id string", STATE, "append", GroupStateTimeout.NoTimeout)
