"""Session settings and intermediate tables.

Intermediate results that are read more than once are written as Parquet to the folder all executors share
(``spark.checkpoint.dir``).  A written table cuts the lineage and survives the loss of any executor; nothing
here relies on blocks held by a single executor.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARED_DIR_KEY = "spark.checkpoint.dir"

_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a temporary one only where it is unset and one machine does all work (tests)."""
    named = spark.conf.get(SHARED_DIR_KEY, None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"{SHARED_DIR_KEY} is not set: executors need a shared folder, a local one would lie on one machine")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = tempfile.mkdtemp(prefix="opinara-")
        atexit.register(shutil.rmtree, _fallback[app], ignore_errors=True)
    return _fallback[app]


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a DataFrame that reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/opinara/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files behind a DataFrame made by :func:`written`, if the folder is a local or shared mount."""
    for folder in {str(Path(urlparse(f).path).parent) for f in df.inputFiles()}:
        if "/opinara/" in folder:
            shutil.rmtree(folder, ignore_errors=True)


def parallelism(spark: SparkSession) -> int:
    """Tasks that can run at once."""
    return max(1, spark.sparkContext.defaultParallelism)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("opinara")
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | extra
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition a small input whose few file splits would leave most cores idle before Python work.

    Inputs with at least as many splits as cores are left alone, so a large scan is never shuffled for this.
    """
    cores = parallelism(df.sparkSession)
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def bounded_sample(df: DataFrame, column: str, rows: int, n: int | None = None) -> list:
    """At most ``rows`` values of a column, chosen by their hash: the same for every partitioning, and bounded on the driver.

    ``n`` is the number of rows, if it is known.
    """
    n = df.count() if n is None else n
    h = F.xxhash64(column)
    if n > 4 * rows:  # about twice the wanted rows pass; the order below decides among them
        df = df.where(F.pmod(h, F.lit(1 << 20)) < max(1, (2 * rows << 20) // n))
    return [r[0] for r in df.select(column).orderBy(h, column).limit(rows).collect()]
