"""Mixing sources to target weights by iterative proportional fitting.

The tokens of every (source, language, topic) cell are raked to the target shares of the sources and to the language
and topic shares of the pool; the source step is last.  A cell's weight, at most ``max_repeats``, is the number of
times its documents are used on average.  The total is the largest that lets every source reach its share.  Documents
are then drawn by systematic sampling along the order of their lengths, which keeps drawn tokens close to weighted
tokens, and a last step adds or removes short documents until a source is within one short document of its target.

Prefix sums are taken inside length buckets with salts and over the bucket totals, so that a source may hold any
share of the documents; the salts grow with the number of documents, so that no window does.  The raking works on
cells, whose number is bounded by sources x languages x topics; topics come from a model with a fixed number of them
(:mod:`opinara.llm.topics`).

Defined results: null sources and documents without tokens belong to no mix; source spellings are folded; a source of
a mix without documents gets share 0 and the others keep their proportions; null languages are one language ``und``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.runtime import written

RAKE_ROUNDS = 50
SALT_ROWS = 100_000  # documents of a source for which one more salt is taken


def folded_source(c: Column) -> Column:
    return F.nullif(F.regexp_replace(F.lower(F.trim(c)), "-", "_"), F.lit(""))


def rake(tokens: np.ndarray, targets: list[np.ndarray], codes: list[np.ndarray], most: np.ndarray) -> np.ndarray:
    """Weights of the cells; the first margin holds exactly, the others as far as the caps allow."""
    weight = np.ones(len(tokens))
    for _ in range(RAKE_ROUNDS):
        for target, code in reversed(list(zip(targets, codes))):
            now = np.bincount(code, weight * tokens, len(target))
            weight = np.minimum(weight * np.where(now > 0, target / np.maximum(now, 1e-12), 0)[code], most)
    for _ in range(100):  # fill up a source whose cells were capped
        now = np.bincount(codes[0], weight * tokens, len(targets[0]))
        free = weight < most * (1 - 1e-12)
        room = np.bincount(codes[0], np.where(free, weight * tokens, 0), len(targets[0]))
        gap = targets[0] - now
        if np.all(np.abs(gap) <= 1e-9 * np.maximum(targets[0], 1)) or not room.any():
            break
        weight = np.where(free, np.minimum(weight * (1 + np.where(room > 0, gap / np.maximum(room, 1e-12), 0))[codes[0]], most), weight)
    return weight


def _prefix(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Add ``before``: the sum of ``value`` over the rows of the same keys with smaller (length bucket, salt, order)."""
    part = [*keys, "bucket", "salt"]
    totals = df.groupBy(*part).agg(F.sum(value).alias("_t"))
    over = Window.partitionBy(*keys).orderBy("bucket", "salt").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*part, F.coalesce(F.sum("_t").over(over), F.lit(0.0)).alias("_b"))
    inner = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_i", F.coalesce(F.sum(value).over(inner), F.lit(0.0))).join(totals, part).withColumn("before", F.col("_i") + F.col("_b")).drop("_i", "_b")


def pooled(docs: DataFrame) -> DataFrame:
    topic = F.coalesce("topic", F.lit("none")) if "topic" in docs.columns else F.lit("none")
    pool = docs.select("doc_id", folded_source(F.col("source")).alias("source_name"), F.coalesce(F.lower("lang"), F.lit("und")).alias("lang"), topic.alias("topic"), "n_tokens")
    return pool.where("source_name is not null and n_tokens > 0")


def mix(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """One row (mix_name, doc_id, source_name, lang, topic, n_tokens, times) per document used.

    ``docs`` has (doc_id, source, lang, n_tokens) and may have a topic; ``targets`` is a small table.
    """
    pool = written(pooled(docs), "mixing-pool")
    spark = docs.sparkSession
    salts = 16 + pool.count() // SALT_ROWS
    cells = pool.groupBy("source_name", "lang", "topic").agg(F.sum("n_tokens").alias("t")).collect()
    wanted: dict[str, dict[str, tuple[float, int]]] = {}
    for r in targets.select("mix_name", folded_source(F.col("source_name")).alias("s"), "target_share", "max_repeats").collect():
        wanted.setdefault(r["mix_name"], {})[r["s"]] = (float(r["target_share"]), int(r["max_repeats"]))
    rows = []
    for name, shares in sorted(wanted.items()):
        own = [c for c in cells if c["source_name"] in shares and shares[c["source_name"]][0] > 0 and shares[c["source_name"]][1] > 0]
        if not own:
            continue
        tokens = np.array([float(c["t"]) for c in own])
        codes, margins = [], []
        for k in ("source_name", "lang", "topic"):
            values = sorted({c[k] for c in own})
            codes.append(np.array([values.index(c[k]) for c in own]))
            margins.append(values)
        share = np.array([shares[s][0] for s in margins[0]])
        share /= share.sum()
        have = np.bincount(codes[0], tokens)
        repeats = np.array([shares[s][1] for s in margins[0]])
        total = min(float(np.min(repeats * have / share)), float(tokens.sum()))
        goals = [share * total] + [np.bincount(code, tokens) / tokens.sum() * total for code in codes[1:]]
        weight = rake(tokens, goals, codes, repeats[codes[0]].astype(float))
        rows += [(name, c["source_name"], c["lang"], c["topic"], float(w), int(repeats[k]), float(goals[0][k])) for c, w, k in zip(own, weight, codes[0])]
    weights = spark.createDataFrame(rows, "mix_name string, source_name string, lang string, topic string, w double, most int, goal double")
    df = pool.join(weights, ["source_name", "lang", "topic"])
    df = df.withColumn("bucket", F.floor(F.log2(F.col("n_tokens").cast("double")) * 8)).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    keys = ["mix_name", "source_name"]
    df = _prefix(df, keys, "w", ["n_tokens", "doc_id"])
    u = F.pmod(F.xxhash64(*keys), F.lit(1_000_003)) / F.lit(1_000_003.0)
    drawn = (F.floor(F.col("before") + F.col("w") + u + 1e-9) - F.floor(F.col("before") + u + 1e-9)).cast("int")
    df = written(df.select(*keys, "lang", "topic", "doc_id", "n_tokens", "bucket", "salt", "most", "goal", F.least(drawn, F.col("most")).alias("times")), "mixing-draw")
    # correction by short documents
    gap = df.groupBy(*keys).agg((F.first("goal") - F.sum(F.col("times") * F.col("n_tokens"))).alias("gap"))
    df = df.join(gap, keys)
    can = F.when((F.col("gap") > 0) & (F.col("times") < F.col("most")) | (F.col("gap") < 0) & (F.col("times") > 0), F.col("n_tokens").cast("double")).otherwise(0.0)
    df = _prefix(df.withColumn("can", can), keys, "can", ["n_tokens", "doc_id"])
    step = F.when((F.col("can") > 0) & (F.col("before") + F.col("can") <= F.abs("gap")), F.signum("gap").cast("int")).otherwise(0)
    return df.select(*keys, "lang", "topic", "doc_id", "n_tokens", (F.col("times") + step).alias("times")).where("times > 0")


def shares(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and reached share of every source of every mix."""
    got = selection.groupBy("mix_name", "source_name").agg(F.sum(F.col("times") * F.col("n_tokens")).alias("tokens"), F.max("times").alias("most_times"), F.count(F.lit(1)).alias("n_docs"))
    want = targets.select("mix_name", folded_source(F.col("source_name")).alias("source_name"), "target_share", "max_repeats")
    both = want.join(got, ["mix_name", "source_name"], "left").fillna({"tokens": 0, "most_times": 0, "n_docs": 0})
    return both.withColumn("actual_share", F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(Window.partitionBy("mix_name"))), F.lit(0.0)))


def margins(selection: DataFrame, docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Wanted and reached share of tokens of every language and topic of every mix; wanted are those of the pool."""
    wanted = targets.where("target_share > 0 and max_repeats > 0").select("mix_name", folded_source(F.col("source_name")).alias("source_name"))
    pool = pooled(docs).join(F.broadcast(wanted), "source_name").groupBy("mix_name", "lang", "topic").agg(F.sum("n_tokens").alias("have"))
    got = selection.groupBy("mix_name", "lang", "topic").agg(F.sum(F.col("times") * F.col("n_tokens")).alias("got"))
    cells = pool.join(got, ["mix_name", "lang", "topic"], "left").fillna(0, ["got"])
    both = cells.select("mix_name", F.inline(F.array(*[F.struct(F.lit(m).alias("margin"), F.col(m).alias("value")) for m in ("lang", "topic")])), "have", "got")
    per = both.groupBy("mix_name", "margin", "value").agg(F.sum("have").alias("have"), F.sum("got").alias("got"))
    over = Window.partitionBy("mix_name", "margin")
    share = lambda c: F.round(F.coalesce(F.try_divide(F.col(c), F.sum(c).over(over)), F.lit(0.0)), 6)
    return per.select("mix_name", "margin", "value", share("have").alias("pool_share"), share("got").alias("actual_share"))
