"""Class-based term weights: tf(class, term) * ln(1 + mean class length / classes with the term)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinara import config
from opinara.functions import text as tx

BOOST = 1.5


def term_weights(df: DataFrame, group: str, text: str, top: int = 10, stop_words: list[str] | None = None, priority: list[str] | None = None) -> DataFrame:
    """(group, term, weight, rank) of the ``top`` terms of every group; ties go to the smaller term.

    The mean class length counts stop words, the term counts do not.  Groups and texts of null are left out.
    """
    stop, boosted = stop_words or config.TERM_STOP_WORDS, priority or config.TERM_PRIORITY_WORDS
    # one row per group and term before the shuffle; a group of any size is only ever a count
    counts = df.where(F.col(group).isNotNull()).select(group, F.explode(tx.terms(F.col(text))).alias("term")).groupBy(group, "term").agg(F.count(F.lit(1)).alias("tf"))
    length = counts.groupBy(group).agg(F.sum("tf").alias("n")).agg(F.avg("n").alias("mean_length"))
    useful = counts.where(~F.col("term").isin(*stop))
    spread = useful.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.col("tf") * F.log(1 + F.col("mean_length") / F.col("df")) * F.when(F.col("term").isin(*boosted), BOOST).otherwise(1.0)
    # one row by construction
    scored = useful.join(spread, "term").crossJoin(F.broadcast(length)).select(group, "term", weight.alias("weight"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("weight"), "term"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top)
