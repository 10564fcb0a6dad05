"""Similarity joins and exact nearest neighbours against a small side."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinara import config

SMALL_SIDE = 64 * 1024 * 1024  # bytes of vectors that go to every worker at once
TILE = 16 * 1024 * 1024  # bytes of cosines that a worker holds at once
NEAR = 1e-12  # cosines of a product of matrices, which sums in an order that varies with the place of a row, are off by far less


def _blocks(df: DataFrame, key: str, vector: str) -> list[DataFrame]:
    """A side cut by the hash of its key into parts of at most about ``SMALL_SIDE`` bytes."""
    n, width = df.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(vector)), F.lit(0))).first()
    many = -(-2 * n * width * 8 // SMALL_SIDE) if n * width * 8 > SMALL_SIDE else 1
    return [df.where(F.pmod(F.xxhash64(key), F.lit(many)) == i) for i in range(many)] if many > 1 else [df]


def _gathered(df: DataFrame, key: str, vector: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys and vectors, in their own precision, of a part whose size is bounded."""
    kind = np.float32 if dict(df.dtypes)[vector] == "array<float>" else np.float64
    rows = df.select(key, vector).orderBy(key).collect()
    if not rows:
        return np.empty(0, object), np.zeros((0, 0), kind)
    return np.array([r[0] for r in rows] + [None], object)[:-1], np.array([r[1] for r in rows], kind)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of the rows of ``x`` with those of ``y``, summed component by component as in SQL: equal rows give equal cosines."""

    def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.add.accumulate(a * b, axis=1)[:, -1]

    x, y = x.astype(np.float64), y.astype(np.float64)
    size = np.sqrt(dot(x, x) * dot(y, y))
    return np.divide(dot(x, y), size, out=np.zeros(len(x)), where=size > 0)


def _best(s: np.ndarray, v: np.ndarray, m: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and cosines of the ``top`` best columns of every row of ``s``, the smaller column first of equal ones.

    Whatever lies within ``NEAR`` of the last place is compared by the cosines of :func:`_cosines`, so many pairs at a time that they fit ``TILE``.
    """
    if top < s.shape[1]:
        last = s.max(1) if top == 1 else np.partition(s, -top, axis=1)[:, -top]
        i, j = np.nonzero(s >= last[:, None] - NEAR)
    else:
        i, j = np.repeat(np.arange(len(s)), s.shape[1]), np.tile(np.arange(s.shape[1]), len(s))
    c, step = np.empty(len(i)), max(1, TILE // (8 * max(1, v.shape[1])))
    for at in range(0, len(i), step):
        part = slice(at, at + step)
        c[part] = _cosines(v[i[part]], m[j[part]])
    order = np.lexsort((j, -c, i))
    i, j, c = i[order], j[order], c[order]
    kept = np.arange(len(i)) - np.searchsorted(i, i) < top
    return i[kept], j[kept], c[kept]


def against(big: DataFrame, small: DataFrame, key: str, vector: str, small_key: str, small_vector: str, *, top: int | None = None, least: float | None = None) -> DataFrame:
    """(key, other, cosine) of every row of ``big`` with the rows of ``small``: the ``top`` best, or all of at least ``least``.

    ``small`` goes to the workers in parts of bounded size, however large it is; ``big`` is streamed once a part and
    never shuffled; a worker compares so many of its rows at a time that their cosines fit ``TILE``.  With several parts the best of each are merged to the ``top`` best of all.  Ties go to the
    smaller key of ``small``; a zero vector has cosine 0 with everything.
    """
    parts = [_against(big, part, key, vector, small_key, small_vector, top, least) for part in _blocks(small, small_key, small_vector)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    if top is not None and len(parts) > 1:
        rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("cosine"), "other"))
        out = out.withColumn("_r", rank).where(F.col("_r") <= top).drop("_r")
    return out


def _against(big: DataFrame, small: DataFrame, key: str, vector: str, small_key: str, small_vector: str, top: int | None, least: float | None) -> DataFrame:
    keys, x = _gathered(small, small_key, small_vector)
    types = dict(big.dtypes)[key], dict(small.dtypes)[small_key]
    shared = big.sparkSession.sparkContext.broadcast((keys, x))

    def run(parts):  # noqa: ANN001, ANN202
        names, m = shared.value
        units = _unit(m).T
        step = max(1, TILE // (8 * max(1, len(names))))
        for whole in parts:
            for at in range(0, len(whole) if len(names) else 0, step):
                pdf = whole.iloc[at : at + step]
                v = np.stack(pdf[vector].to_numpy())
                s = _unit(v) @ units
                if top is not None:
                    i, j, c = _best(s, v, m, top)
                else:
                    i, j = np.nonzero(s >= (least if least is not None else -2))
                    c = s[i, j]
                if len(i):
                    yield pd.DataFrame({key: pdf[key].to_numpy()[i], "other": names[j], "cosine": c})

    return big.select(key, vector).mapInPandas(run, f"{key} {types[0]}, other {types[1]}, cosine double")


def verified_themes(reviews: DataFrame, themes: DataFrame, threshold: float = config.THEME_THRESHOLD) -> DataFrame:
    """(theme_id, verified ids): reviews whose vector is similar enough to that of the theme."""
    hits = against(reviews, themes, "id", "vector", "theme_id", "vector", least=threshold)
    return hits.groupBy(F.col("other").alias("theme_id")).agg(F.array_sort(F.collect_set("id")).alias("verified"))


def plane(centroids: DataFrame, key: str, vector: str) -> DataFrame:
    """Two coordinates of every centroid: centred, first two singular directions, largest component positive.

    Fewer than two centroids lie at the origin.  The centroids are measured and gathered as a small side.
    """
    n = centroids.count()
    spark = centroids.sparkSession
    kind = dict(centroids.dtypes)[key]
    rows = centroids.select(key, vector).orderBy(key)
    if n * 4 * 384 > SMALL_SIDE:
        raise ValueError("too many centroids for one decomposition")
    got = rows.collect()
    xy = np.zeros((len(got), 2))
    if len(got) >= 2:
        x = np.array([r[1] for r in got], np.float64)
        u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
        k = min(2, len(s))
        xy[:, :k] = u[:, :k] * s[:k]
        xy *= np.where(xy[np.abs(xy).argmax(0), np.arange(2)] < 0, -1, 1)
    return spark.createDataFrame([(r[0], float(a), float(b)) for r, (a, b) in zip(got, xy)], f"{key} {kind}, x double, y double")


def spiral(df: DataFrame, order: list) -> DataFrame:  # noqa: ANN001
    """Coordinates on a spiral from the rank of every row."""
    i = (F.row_number().over(Window.orderBy(*order)) - 1).cast("double")
    return df.withColumn("x", F.cos(i * 0.5) * (1 + i * 0.1)).withColumn("y", F.sin(i * 0.5) * (1 + i * 0.1))
