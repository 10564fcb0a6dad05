"""Leader-follower clustering in record order.

A vector joins the most similar centroid if the cosine reaches the threshold, else it founds a cluster.  Centroids are
running means scaled to unit length; similarity statistics are running (Welford) over the similarity to the centroid
before the vector joined.  The exact form is one ordered fold over one group: its result depends on the order of all
rows.  ``scaled`` folds salted parts and then their leaders, which bounds every group and is an approximation.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara import config


class Leaders:
    def __init__(self, threshold: float, dimension: int) -> None:
        self.threshold = threshold
        self.centroids = np.zeros((64, dimension), np.float32)
        self.size: list[int] = []
        self.mean: list[float] = []
        self.m2: list[float] = []

    def add(self, vector: np.ndarray, weight: int = 1) -> int:
        n = float(np.linalg.norm(vector))
        v = vector / n if n > 0 else vector
        k = len(self.size)
        if k:
            sims = self.centroids[:k] @ v
            best = int(sims.argmax())
            if sims[best] >= self.threshold:
                s = float(sims[best])
                size = self.size[best] + weight
                c = (self.centroids[best] * self.size[best] + v * weight) / size
                cn = float(np.linalg.norm(c))
                self.centroids[best] = c / cn if cn > 0 else c
                delta = s - self.mean[best]
                self.mean[best] += delta * weight / size
                self.m2[best] += delta * (s - self.mean[best]) * weight
                self.size[best] = size
                return best
        if k == len(self.centroids):
            self.centroids = np.vstack([self.centroids, np.zeros_like(self.centroids)])
        self.centroids[k] = v
        self.size.append(weight)
        self.mean.append(1.0)
        self.m2.append(0.0)
        return k


def split_two(x: np.ndarray, rounds: int = 10) -> np.ndarray:
    """Side (0 or 1) of every unit vector: two-means from the farthest point and the one farthest from it."""
    centre = x.mean(0)
    a = int((x @ centre).argmin())
    b = int((x @ x[a]).argmin())
    two = np.stack([x[a], x[b]])
    side = (x @ two.T).argmax(1)
    for _ in range(rounds):
        two = np.stack([x[side == s].mean(0) if (side == s).any() else two[s] for s in (0, 1)])
        two /= np.maximum(np.linalg.norm(two, axis=1, keepdims=True), 1e-12)
        new = (x @ two.T).argmax(1)
        if (new == side).all():
            break
        side = new
    return side


def leader_follower(df: DataFrame, key: str, vector: str, order: list[str], threshold: float = config.MERGE_THRESHOLD, scaled: bool = False, part_rows: int = 20_000) -> DataFrame:
    """(key, cluster_id) per row; cluster ids count from ``cluster_1`` in order of their founders."""
    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("k"), F.col(vector).alias("v"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    sort = [f"o{i}" for i in range(len(order))] + ["k"]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(sort, na_position="first", kind="stable")
        leaders = Leaders(threshold, len(pdf["v"].iloc[0]))
        found = [leaders.add(np.asarray(v, np.float32)) for v in pdf["v"]]
        return pd.DataFrame({"k": pdf["k"], "c": found, "centroid": [leaders.centroids[f].tolist() for f in found], "n": [leaders.size[f] for f in found]})

    def name(pdf: pd.DataFrame) -> pd.DataFrame:
        out = fold(pdf)
        return pd.DataFrame({"k": out["k"], "cluster_id": "cluster_" + (out["c"] + 1).astype(str)})

    if not scaled:
        return rows.withColumn("g", F.lit(1)).groupBy("g").applyInPandas(lambda pdf: name(pdf), f"k {kind}, cluster_id string").withColumnRenamed("k", key)
    parts = max(1, -(-rows.count() // part_rows))
    part = F.pmod(F.xxhash64("k"), F.lit(parts))
    first = rows.withColumn("p", part).groupBy("p").applyInPandas(lambda pdf: fold(pdf).assign(p=pdf["p"].iloc[0]), f"k {kind}, c int, centroid array<float>, n int, p bigint")
    heads = first.groupBy("p", "c").agg(F.min("k").alias("h"), F.first("centroid").alias("v"), F.first("n").alias("w"))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["w", "h"], ascending=[False, True])
        leaders = Leaders(threshold, len(pdf["v"].iloc[0]))
        found = [leaders.add(np.asarray(v, np.float32), int(w)) for v, w in zip(pdf["v"], pdf["w"])]
        return pd.DataFrame({"p": pdf["p"], "c": pdf["c"], "cluster_id": [f"cluster_{f + 1}" for f in found]})

    merged = heads.withColumn("g", F.lit(1)).groupBy("g").applyInPandas(lambda pdf: merge(pdf), "p bigint, c int, cluster_id string")
    return first.join(merged, ["p", "c"]).select(F.col("k").alias(key), "cluster_id")


def sweep(df: DataFrame, key: str, vector: str, order: list[str], thresholds: list[float]) -> DataFrame:
    """Clusters, mean and largest size per threshold."""
    out = None
    for t in thresholds:
        sizes = leader_follower(df, key, vector, order, t).groupBy("cluster_id").count()
        row = sizes.agg(F.lit(t).alias("threshold"), F.count(F.lit(1)).alias("clusters"), F.round(F.avg("count"), 6).alias("mean_size"), F.max("count").alias("largest"))
        out = row if out is None else out.unionByName(row)
    return out
