"""Vectors prepared for search and clustering.

A usable vector has the wanted length, only finite values and a norm above zero.  It is scaled to unit length and kept
as 16-bit integers with the largest component at 32767, which changes a cosine by about 3e-6.  Copies that travel to
several blocks are packed to 12 bits a component, which changes a cosine by about 4e-5.  Equal unit vectors form
one class under a 64-bit hash of those integers; search and clustering work on classes, so that any number of copies
of one vector costs as much as one.  Of several different vectors under one id the class with the smallest hash counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.runtime import written

DIMENSION = 384
BLOCK_ROWS = 8192
SALTS = 32


def quantise(x: np.ndarray) -> np.ndarray:
    """Unit vectors as int16 rows; ``x`` has finite rows of positive norm."""
    top = np.abs(x).max(1, keepdims=True)
    return np.rint(x * (32767.0 / top)).astype(np.int16)


def unit(q: np.ndarray) -> np.ndarray:
    x = q.astype(np.float32)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def stacked(values: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A binary column of int16 rows as a matrix."""
    rows = values.to_pylist()
    return np.frombuffer(b"".join(rows), np.int16).reshape(len(rows), -1)


def packed(q: np.ndarray) -> pa.Array:
    """int16 rows as binary rows of 12 bits a component (an odd last component is paired with zero)."""
    v = (np.clip(np.rint(q / 16.0), -2047, 2047) + 2048).astype(np.uint16)
    if v.shape[1] % 2:
        v = np.hstack([v, np.full((len(v), 1), 2048, np.uint16)])
    a, b = v[:, 0::2], v[:, 1::2]
    out = np.stack([a & 255, (a >> 8) | ((b & 15) << 4), b >> 4], 2).astype(np.uint8)
    data, w = out.tobytes(), 3 * a.shape[1]
    return pa.array([data[i : i + w] for i in range(0, len(data), w)], pa.binary())


def unpacked(values: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit vectors of packed rows."""
    rows = values.to_pylist()
    x = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1, 3).astype(np.int16)
    out = np.empty((len(rows), 2 * x.shape[1]), np.float32)
    out[:, 0::2] = x[:, :, 0] | ((x[:, :, 1] & 15) << 8)
    out[:, 1::2] = (x[:, :, 1] >> 4) | (x[:, :, 2] << 4)
    out -= 2048
    out /= np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]
    return out


@dataclass
class Prepared:
    ids: DataFrame  # id, h
    classes: DataFrame  # h, q
    n: int  # classes


def prepared(rows: DataFrame, id_col: str = "id", vector_col: str = "vector", dimension: int = DIMENSION) -> Prepared:
    usable = rows.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where((F.size("v") == dimension) & F.col("id").isNotNull())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            v = batch.column("v")
            flat = v.flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(batch), dimension) if len(batch) else np.zeros((0, dimension))
            norm = np.sqrt((x * x).sum(1))
            good = np.flatnonzero(np.isfinite(norm) & (norm > 0))
            q = quantise(x[good] / norm[good][:, None])
            data = q.tobytes()
            w = dimension * 2
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(good)), pa.array([data[i : i + w] for i in range(0, len(data), w)], pa.binary())], names=["id", "q"])

    coded = usable.mapInArrow(run, "id string, q binary").withColumn("h", F.xxhash64("q"))
    classes = written(coded.groupBy("h").agg(F.first("q").alias("q")), "vector-classes")
    ids = written(coded.groupBy("id").agg(F.min("h").alias("h")), "vector-ids")
    n = classes.count()
    used = ids.select("h").distinct()
    if used.count() < n:  # vectors that no id kept
        classes = written(classes.join(used, "h", "left_semi"), "vector-used")
        n = classes.count()
    return Prepared(ids, classes, n)


def blocks(rows: DataFrame, cell: str, sizes: dict, most: int = BLOCK_ROWS) -> DataFrame:
    """Add ``block``: a cell of at most ``most`` rows is one block; a larger one is cut into chunks by the hash, and
    every pair of chunks becomes a block, so that every pair of rows of the cell meets in one."""
    big = {c: -(-n // (most // 2)) for c, n in sizes.items() if n > most}
    if not big:
        return rows.withColumn("block", F.concat_ws(":", F.col(cell).cast("string")))
    chunks = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in big.items() for x in kv]), F.col(cell)), F.lit(1))
    mine = F.pmod(F.xxhash64("h", F.lit(7)), chunks)
    other = F.explode(F.sequence(F.lit(0), (chunks - 1).cast("int")))
    out = rows.select("*", chunks.alias("_k"), mine.alias("_c")).select("*", other.alias("_o"))
    # with several chunks the block of a chunk with itself is part of its blocks with others
    out = out.where((F.col("_k") == 1) | (F.col("_c") != F.col("_o")))
    return out.withColumn("block", F.concat_ws(":", F.col(cell).cast("string"), F.least("_c", "_o"), F.greatest("_c", "_o"))).drop("_k", "_c", "_o")


def by_block(rows: DataFrame, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    return rows.groupBy("block").applyInArrow(lambda t: work(t), schema)


def first_members(ids: DataFrame, most: int) -> DataFrame:
    """Per class: its number of ids and its ``most`` smallest ids, gathered in salted steps of bounded size."""
    part = ids.groupBy("h", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")).agg(F.slice(F.array_sort(F.collect_list("id")), 1, most).alias("m"), F.count(F.lit(1)).alias("n"))
    return part.groupBy("h").agg(F.slice(F.array_sort(F.flatten(F.collect_list("m"))), 1, most).alias("members"), F.sum("n").alias("n_ids"))


def frame(table: pa.Table, names: list[str]) -> pd.DataFrame:
    return table.select(names).to_pandas()


def hashed_features(text: Column, dimension: int = DIMENSION) -> Column:
    """A text as a vector of hashed word weights: every word adds 1 + log of its count at the place its hash names,
    with the sign its hash names.  Null and empty texts give a vector of zeros, which is not usable."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")
    weighted = F.transform(F.array_distinct(words), lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(dimension)).alias("at"), (F.when(F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0) * (1 + F.log(F.size(F.filter(words, lambda x: x == w)).cast("double")))).alias("w")))
    return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.aggregate(F.filter(weighted, lambda x: x["at"] == i), F.lit(0.0), lambda a, x: a + x["w"]).cast("float"))
