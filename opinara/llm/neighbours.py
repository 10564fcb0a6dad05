"""The most similar vectors of every vector, by a permutation index.

A bounded sample of vectors serves as pivots.  Every vector is represented by the order of its ``ORDER`` nearest pivots
and posted in the inverted files of the first ``POSTED``.  Within a file, candidates are ranked by the footrule distance
of their pivot orders; the nearest ``RERANK`` and at least the nearest ``RERANK_SHARE`` of the file (with all ties) are
ranked again by cosine, and the best of a vector's files are merged.  Every vector is indexed; recall against brute
force is measured in the tests, where the footrule decides.

The number of pivots grows with the square root of the number of vectors (up to ``PIVOTS``, reached at 6 billion), so
files grow only so.  A file larger than a block is cut into blocks in which all its pairs still meet.

Defined results: unusable vectors and ids without one take no part; a repeated id counts once; equal vectors are
neighbours with cosine 1; ties go to the smaller id; with fewer than ``k`` other ids all of them come out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.vectors import Prepared, blocks, by_block, first_members, packed, stacked, unit, unpacked
from opinara.runtime import bounded_sample

K = 10
ORDER, POSTED = 16, 3
RERANK, RERANK_SHARE = 512, 0.6
PIVOT_FACTOR = 0.4
PIVOTS = (32, 32_000)


class Footrule:
    """Footrule distances of pivot orders; a pivot missing from an order stands at the place after its last.

    A pivot at place i of one order and j of the other saves ``2 * (n - max(i, j))`` of the distance ``n * (n + 1)`` of
    two orders without a common pivot; the savings of one order are looked up for the places of all others.
    """

    def __init__(self, order: np.ndarray) -> None:
        n = order.shape[1]
        pivots, at = np.unique(order, return_inverse=True)
        self.at = at.reshape(order.shape)
        self.key = np.ascontiguousarray((self.at * n + np.arange(n)).T)
        self.saved = (2 * (n - np.maximum.outer(np.arange(n), np.arange(n)))).astype(np.int16)
        self.table = np.zeros((len(pivots), n), np.int16)
        self.none = n * (n + 1)

    def of(self, i: int) -> np.ndarray:
        """Distances of order ``i`` to all orders."""
        mine = self.at[i]
        self.table[mine] = self.saved
        out = self.none - self.table.ravel()[self.key].sum(0, dtype=np.int32)
        self.table[mine] = 0
        return out


def search_file(h: np.ndarray, order: np.ndarray, x: np.ndarray, k: int = K, rerank: int = RERANK, share: float = RERANK_SHARE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, neighbour row, cosine) of the best of a file for each of its rows, among those the footrule ranks first."""
    n = len(h)
    if n < 2:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.float32)
    wanted = min(n, max(rerank, int(np.ceil(share * n))))
    ranks = Footrule(order)
    rows, cols, sims = [], [], []
    take = min(k, n - 1)
    for a in range(0, n, 512):
        s = x[a : a + 512] @ x.T
        m = len(s)
        s[np.arange(m), np.arange(a, a + m)] = -2
        for i in range(m if wanted < n else 0):
            far = ranks.of(a + i)
            cut = np.searchsorted(np.bincount(far).cumsum(), wanted)
            s[i, far > cut] = -2
        top = np.argpartition(-s, take - 1, 1)[:, :take]
        val = np.take_along_axis(s, top, 1)
        keep = val > -2
        rows.append(np.repeat(np.arange(a, a + m), keep.sum(1)))
        cols.append(top[keep])
        sims.append(val[keep])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(sims)


def class_neighbours(p: Prepared, k: int = K, least: float | None = None, rerank: int = RERANK, share: float = RERANK_SHARE) -> DataFrame:
    """(h, near array<struct<c,o>>): up to ``k`` nearest other classes of every class, best first."""
    m = int(min(PIVOTS[1], max(PIVOTS[0], math.ceil(PIVOT_FACTOR * math.sqrt(max(1, p.n))))))
    picked = bounded_sample(p.classes, "q", m)
    if len(picked) < 2:
        return p.classes.select("h", F.expr("cast(array() as array<struct<c:float,o:bigint>>)").alias("near"))
    pivots = unit(np.frombuffer(b"".join(bytes(x) for x in picked), np.int16).reshape(len(picked), -1))
    shared = p.classes.sparkSession.sparkContext.broadcast(pivots)  # at most PIVOTS[1] vectors
    width, posts = min(ORDER, len(picked)), min(POSTED, len(picked))

    def post(parts):  # noqa: ANN001, ANN202
        for batch in parts:
            if not len(batch):
                continue
            q = stacked(batch.column("q"))
            x = unit(q)
            s = x @ shared.value.T
            top = np.argpartition(-s, width - 1, 1)[:, :width]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), 1, kind="stable"), 1)
            at = np.repeat(np.arange(len(x)), posts)
            orders = pa.FixedSizeListArray.from_arrays(pa.array(top[at].ravel().astype(np.int16)), width).cast(pa.list_(pa.int16()))
            yield pa.RecordBatch.from_arrays([pa.array(top[:, :posts].ravel().astype(np.int32)), orders, batch.column("h").take(pa.array(at)), packed(q).take(pa.array(at))], names=["pivot", "ord", "h", "q"])

    posted = p.classes.mapInArrow(post, "pivot int, ord array<smallint>, h bigint, q binary")
    # sizes come from a scan of the same rows: one small row per pivot
    sizes = {r["pivot"]: r["count"] for r in posted.groupBy("pivot").count().collect()}
    floor = -2.0 if least is None else float(least) - 1e-3

    def work(t: pa.Table) -> pa.Table:
        h = t.column("h").to_numpy()
        order = np.array(t.column("ord").to_pylist(), np.int16).reshape(len(h), -1)
        r, c, s = search_file(h, order, unpacked(t.column("q")), k, rerank, share)
        ok = s >= floor
        return pa.table({"h": pa.array(h[r[ok]]), "o": pa.array(h[c[ok]]), "c": pa.array(s[ok].astype(np.float32))})

    found = by_block(blocks(posted, "pivot", sizes), work, "h bigint, o bigint, c float")
    best = F.slice(F.sort_array(F.collect_set(F.struct("c", "o")), asc=False), 1, 3 * k)
    # the same pair from two files may differ in the last bit of its cosine: one entry per neighbour
    return found.groupBy("h", "o").agg(F.max("c").alias("c")).groupBy("h").agg(best.alias("near")).select("h", F.slice("near", 1, k).alias("near"))


def nearest(p: Prepared, k: int = K, least: float | None = None, rerank: int = RERANK, share: float = RERANK_SHARE) -> DataFrame:
    """One row (id, neighbours array<struct<id,cosine>>) per id, up to ``k`` ids, best first.

    With ``least``, only neighbours of at least that cosine; they are those of the full lists that reach it.
    """
    members = first_members(p.ids, k + 1)
    near = class_neighbours(p, k, least, rerank, share).select("h", F.posexplode("near").alias("rank", "x"))
    near = near.select("h", F.col("x.o").alias("o"), F.col("x.c").alias("c"))
    listed = near.join(members.select(F.col("h").alias("o"), "members"), "o")
    per = listed.groupBy("h").agg(F.collect_list(F.struct((-F.col("c")).alias("d"), "members", "o")).alias("l"))
    flat = F.flatten(F.transform(F.array_sort("l"), lambda e: F.transform(e["members"], lambda m: F.struct(m.alias("id"), (-e["d"]).cast("double").alias("cosine")))))
    per = per.select("h", F.slice(flat, 1, k).alias("others"))
    own = members.select("h", F.when(F.col("n_ids") > 1, F.col("members")).otherwise(F.expr("cast(array() as array<string>)")).alias("own"))
    full = p.ids.join(own, "h").join(per, "h", "left")
    same = F.transform(F.filter("own", lambda m: m != F.col("id")), lambda m: F.struct(m.alias("id"), F.lit(1.0).alias("cosine")))
    return full.select("id", F.slice(F.concat(same, F.coalesce("others", F.expr("cast(array() as array<struct<id:string,cosine:double>>)"))), 1, k).alias("neighbours"))
