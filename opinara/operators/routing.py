"""Routing of packages to questions, content hashes, cache joins and prompt texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara import config
from opinara.functions import text as tx


def route_fixed(packages: DataFrame, rules: dict[str, list[str]] | None = None) -> DataFrame:
    """(rq_id, cluster_id): a word of the rule is one of the terms or part of the cluster id."""
    rows = [(rq, w) for rq, ws in (rules or config.QUESTION_RULES).items() for w in ws]
    each = F.explode(F.array(*[F.struct(F.lit(rq).alias("rq_id"), F.lit(w).alias("w")) for rq, w in rows]))
    pairs = packages.select("cluster_id", "terms", each.alias("x")).select("cluster_id", "terms", "x.*")
    return pairs.where(F.array_contains("terms", F.col("w")) | F.col("cluster_id").contains(F.col("w"))).select("rq_id", "cluster_id").distinct()


def question_words(title: str, question: str, stop: list[str] | None = None) -> list[str]:
    return sorted(set(re.findall(r"\b\w{4,15}\b", f"{title} {question}".lower())) - set(stop or config.ROUTING_STOP_WORDS))


def route_dynamic(packages: DataFrame, questions: dict[str, tuple[str, str]]) -> DataFrame:
    """(rq_id, cluster_id): a word of title or question is part of the cluster id or of a term."""
    out = []
    low = F.lower("cluster_id")
    for rq, (title, question) in questions.items():
        ws = question_words(title, question)
        hit = F.lit(False)
        for w in ws:
            hit = hit | low.contains(w) | F.coalesce(F.array_join(F.transform("terms", F.lower), "\n").contains(w), F.lit(False))
        out.append(F.when(hit, F.lit(rq)))
    return packages.select("cluster_id", F.explode(F.array_compact(F.array(*out))).alias("rq_id")).select("rq_id", "cluster_id")


def package_hash(terms: Column, reviews: Column) -> Column:
    """SHA-256 of the sorted terms and sorted ``id:text:rating`` of the reviews (struct array)."""
    line = F.transform(reviews, lambda r: F.concat_ws(":", r["id"], tx.first_filled(r["translated_text"], F.coalesce(r["raw_text"], F.lit(""))), F.coalesce(r["rating"].cast("string"), F.lit("None"))))
    return F.sha2(F.concat(F.lit("themes:"), F.array_join(F.array_sort(terms), ","), F.lit("|reviews:"), F.array_join(F.array_sort(line), "|")), 256)


def question_hash(rq_id: Column, question: Column, hashes: Column, previous: Column) -> Column:
    return F.sha2(F.concat(F.lit("rq_id:"), rq_id, F.lit("|q:"), question, F.lit("|pkgs:"), F.array_join(F.array_sort(hashes), ","), F.lit("|prev:"), F.coalesce(previous, F.lit(""))), 256)


def cached(df: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(rows with their cached value, rows without one)."""
    latest = cache.groupBy(key).agg(F.max_by("value", "updated_at").alias("value"))
    return df.join(latest, key), df.join(latest, key, "left_anti")


def fallback_name(terms: Column) -> Column:
    """The first three terms with capitals, or ``General Discovery``."""
    return F.when(F.size(terms) > 0, F.array_join(F.transform(F.slice(terms, 1, 3), lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 1000)))), " / ")).otherwise(F.lit("General Discovery"))


def evidence_lines(packages: DataFrame) -> Column:
    """Prompt text of one package: id, size, rating, five terms and two quotes of 150 characters."""
    quotes = F.array_join(F.transform(F.slice("medoids", 1, 2), lambda m: F.concat(F.lit('    * [ID: '), m["id"], F.lit('] "'), F.substring(tx.first_filled(m["translated_text"], m["raw_text"]), 1, 150), F.lit('..."\n'))), "")
    return F.concat(F.lit("- Cluster: "), F.col("cluster_id"), F.lit(" (Size: "), F.col("size").cast("string"), F.lit(", Avg Rating: "), F.round("average_rating", 2).cast("string"), F.lit(")\n  Themes: "), F.array_join(F.slice(F.transform("themes", lambda t: t["term"]), 1, 5), ", "), F.lit("\n"), F.when(F.size("medoids") > 0, F.concat(F.lit("  Key Quotes:\n"), quotes)).otherwise(F.lit("")))


def prompts(packages: DataFrame, routed: DataFrame, most: int = 6) -> DataFrame:
    """(rq_id, prompt) from the ``most`` packages of the best opportunity of every question."""
    from pyspark.sql import Window

    rows = routed.join(packages, "cluster_id").withColumn("line", evidence_lines(packages))
    rank = F.row_number().over(Window.partitionBy("rq_id").orderBy(F.desc("opportunity_score"), "cluster_id"))
    top = rows.withColumn("r", rank).where(F.col("r") <= most)
    return top.groupBy("rq_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "line"))), lambda x: x["line"]), "\n").alias("prompt"))
