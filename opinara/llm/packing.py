"""Filling containers of fixed capacity by vector best-fit.

An item is a whole text, or a piece of a text longer than the capacity: such a text is cut into full pieces and one
rest.  Every bin has three residual capacities: tokens; items, ``capacity / ITEM_TOKENS`` of them; and attention cost,
the sum of squared item lengths, ``ATTENTION_SHARE`` of the squared capacity (a single item always fits).  Items come
largest first; an item goes to the open bin, among all those that can take it under every constraint, with the
smallest weighted norm of what would be left of the three capacities.  Full pieces fill bins of their own.

Items are packed in independent shards of about ``SHARD_ITEMS`` items, chosen by a hash of the id, so that no shard
grows with the data; each shard leaves at most its last few bins partly filled.

Defined results: texts without tokens are left out; equal texts are separate items; a budget without a positive
capacity gets no bins; a budget table of more than ``BUDGET_LIMIT`` rows is refused; two items of equal length are
ordered by id, two equally good bins by age; columns beside the named ones are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_ITEMS = 10_000
ITEM_TOKENS = 16  # a bin takes one item for every so many tokens of its capacity
ATTENTION_SHARE = 0.85
WEIGHTS = (1.0, 0.1, 0.2)  # tokens, items, attention
BUDGET_LIMIT = 1000


def best_fit(sizes: np.ndarray, capacity: int, items: int | None = None, attention: float | None = None) -> np.ndarray:
    """Bin of each item; sizes are at most ``capacity`` and sorted from large to small."""
    items = max(1, capacity // ITEM_TOKENS) if items is None else items
    attention = ATTENTION_SHARE * float(capacity) ** 2 if attention is None else attention
    n, bins, m = len(sizes), 0, 0
    where = np.empty(n, np.int64)
    # the open bins, oldest first: residual tokens, items and attention, and number
    left, room, cost, name = (np.empty(64) for _ in range(4))
    wt, wi, wa = WEIGHTS[0] / capacity**2, WEIGHTS[1] / items**2, WEIGHTS[2] / attention**2
    smallest = float(sizes[-1]) if n else 0.0
    for i, size in enumerate(sizes.tolist()):
        square = float(size) * size
        t, a = left[:m] - size, cost[:m] - square
        value = np.where((t >= 0) & (a >= 0), wt * t * t + wi * (room[:m] - 1) ** 2 + wa * a * a, np.inf)
        k = int(value.argmin()) if m else 0
        if m == 0 or value[k] == np.inf:
            if m == len(left):
                left, room, cost, name = (np.concatenate([x, np.empty(m)]) for x in (left, room, cost, name))
            k, m = m, m + 1
            left[k], room[k], cost[k], name[k] = capacity, items, attention, bins
            bins += 1
        left[k] -= size
        room[k] -= 1
        cost[k] -= square
        where[i] = int(name[k])
        if left[k] < smallest or room[k] < 1 or cost[k] < smallest * smallest:
            for x in (left, room, cost, name):
                x[k : m - 1] = x[k + 1 : m]
            m -= 1
    return where


_SCHEMA = "budget_name string, capacity_tokens bigint, shard bigint, bin bigint, doc_id {id}, piece int, n_tokens bigint, bin_tokens bigint"


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
    where = best_fit(pdf["n_tokens"].to_numpy(np.int64), int(pdf["capacity_tokens"].iloc[0]))
    total = np.bincount(where, pdf["n_tokens"].to_numpy())
    return pdf.assign(bin=where, bin_tokens=total[where].astype(np.int64))


def pack(items: DataFrame, budgets: DataFrame, shards: int) -> DataFrame:
    """One row per piece: (budget_name, capacity_tokens, bin_id, doc_id, piece, n_tokens).

    ``items`` has (doc_id, n_tokens); ``budgets`` is a small table of (budget_name, capacity_tokens).
    """
    kind = dict(items.dtypes)["doc_id"]
    schema = _SCHEMA.format(id=kind)
    listed = budgets.where("capacity_tokens > 0").groupBy("budget_name").agg(F.max("capacity_tokens").alias("capacity_tokens")).orderBy("budget_name").limit(BUDGET_LIMIT + 1).collect()
    if len(listed) > BUDGET_LIMIT:
        raise ValueError(f"more than {BUDGET_LIMIT} budgets")
    each = F.array(*[F.struct(F.lit(b["budget_name"]).alias("budget_name"), F.lit(int(b["capacity_tokens"])).cast("bigint").alias("capacity_tokens")) for b in listed])
    both = items.where("n_tokens > 0").select("doc_id", "n_tokens", F.inline(each))
    whole = both.select("*", F.expr("cast(n_tokens div capacity_tokens as int)").alias("full"), F.expr("n_tokens % capacity_tokens").alias("rest"))
    full = whole.where("full > 0").select("budget_name", "capacity_tokens", F.lit(-1).cast("bigint").alias("shard"), F.lit(0).cast("bigint").alias("bin"), "doc_id", F.explode(F.sequence(F.lit(1), F.col("full"))).alias("piece"), F.col("capacity_tokens").alias("n_tokens"))
    rest = whole.where("rest > 0").select("budget_name", "capacity_tokens", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"), F.lit(0).cast("bigint").alias("bin"), "doc_id", (F.col("full") + 1).alias("piece"), F.col("rest").alias("n_tokens"), F.lit(0).cast("bigint").alias("bin_tokens"))
    packed = rest.groupBy("budget_name", "shard").applyInPandas(lambda pdf: _pack(pdf), schema)
    name = F.concat_ws(":", F.when(F.col("shard") < 0, F.concat_ws("-", F.lit("full"), "doc_id", "piece")).otherwise(F.col("shard").cast("string")), "bin")
    cols = ["budget_name", "capacity_tokens", name.alias("bin_id"), "doc_id", "piece", "n_tokens"]
    return packed.select(*cols).unionByName(full.select(*cols))
