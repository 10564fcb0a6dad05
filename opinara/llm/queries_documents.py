"""Queries over documents measured in tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.llm import topics
from opinara.llm.mixing import margins, mix, shares
from opinara.llm.packing import SHARD_ITEMS, pack
from opinara.llm.tokens import count_tokens
from opinara.runtime import written
from opinara.sources.tables import table


def _packed(spark: SparkSession, d: str) -> DataFrame:
    items = written(count_tokens(table(spark, d, "documents").select("doc_id", "text")), "token-counts")
    return pack(items, table(spark, d, "token_budgets"), -(-items.count() // SHARD_ITEMS))


def p8_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every document with its bin, for each budget."""
    return _packed(spark, d)


def p8_bins(spark: SparkSession, d: str) -> DataFrame:
    """Per budget: bins, documents cut, and the share of space left unused."""
    bins = _packed(spark, d).groupBy("budget_name", "capacity_tokens", "bin_id").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("n_items"))
    out = bins.groupBy("budget_name", "capacity_tokens").agg(F.count(F.lit(1)).alias("n_bins"), F.sum("n_items").alias("n_items"), F.sum("used").alias("used_tokens"), F.max("used").alias("largest_bin"))
    return out.withColumn("unused_share", F.round(1 - F.col("used_tokens") / (F.col("n_bins") * F.col("capacity_tokens")), 6))


def _counted(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    counted = written(count_tokens(docs.select("doc_id", "source", "lang", "text"), keep=("source", "lang"), words=topics.coded), "document-words")
    return written(topics.labelled(counted, topics.fitted(counted.select("words"))), "document-tokens")


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    return mix(_counted(spark, d), table(spark, d, "mix_targets"))


def p9_selection(spark: SparkSession, d: str) -> DataFrame:
    """The documents of every mix and how often each is used."""
    return _mixed(spark, d)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached shares of tokens."""
    return shares(_mixed(spark, d), table(spark, d, "mix_targets"))


def p9_margins(spark: SparkSession, d: str) -> DataFrame:
    """Shares of languages and topics in the pool and in the selection of every mix."""
    docs, targets = _counted(spark, d), table(spark, d, "mix_targets")
    return margins(mix(docs, targets), docs, targets)


QUERIES = {f.__name__: f for f in (p8_assignment, p8_bins, p9_selection, p9_shares, p9_margins)}
SQL: dict[str, str] = {}
