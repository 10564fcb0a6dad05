"""Topics of documents: spherical k-means over hashed, weighted words.

The centroids are fitted on all documents: seeds are drawn among all of them with a probability in proportion to their
squared distance from the seeds so far, weighed by the documents nearest to them and reduced to the number of topics;
every round takes the means of all documents.  Every document is then given the nearest centroid.  A word weighs
``(1 + log count) * log(1 + documents / documents with it)`` at the place its hash names.  Words are read once, by
:func:`coded`; the passes go over the coded words.

Defined results: null and empty texts, and texts without a word of ``MIN_LETTERS`` letters, have the topic ``none``;
equal texts have equal topics; with no documents at all every text has the topic ``none``.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOPICS = 24
SEED_PASSES = 2
CHUNK_ROWS = 1_024
DIMENSION = 2_048
MIN_LETTERS = 4
ROUNDS = 8
_WORD = re.compile(rf"[^\W\d_]{{{MIN_LETTERS},}}")


def word_counts(text: str | None) -> dict[int, int]:
    """Place of every different word with its count."""
    return Counter(crc32(w.encode()) % DIMENSION for w in _WORD.findall((text or "").lower()))


def coded(text: str | None) -> bytes:
    """The places of a text's words in order, as 16-bit numbers, and their counts, as 32-bit numbers."""
    c = sorted(word_counts(text).items())
    return np.array([a for a, _ in c], np.uint16).tobytes() + np.array([n for _, n in c], np.uint32).tobytes()


def decoded(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and count of every different word of coded rows."""
    size = [len(r) // 6 for r in rows]
    at = np.frombuffer(b"".join(r[: 2 * n] for r, n in zip(rows, size)), np.uint16)
    return np.repeat(np.arange(len(rows)), size), at, np.frombuffer(b"".join(r[2 * n :] for r, n in zip(rows, size)), np.uint32)


@dataclass
class TopicModel:
    weight: np.ndarray
    centres: np.ndarray

    def vectors(self, counts: list[dict[int, int]]) -> np.ndarray:
        x = np.zeros((len(counts), DIMENSION), np.float32)
        for i, c in enumerate(counts):
            at = np.fromiter(c.keys(), np.int64, len(c))
            x[i, at] = (1 + np.log(np.fromiter(c.values(), float, len(c)))) * self.weight[at]
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def decoded_vectors(self, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit vectors of coded rows, and row and place of their components."""
        row, at, n = decoded(rows)
        x = np.zeros((len(rows), DIMENSION), np.float32)
        x[row, at] = (1 + np.log(n)) * self.weight[at]
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9), row, at

    def __call__(self, texts: list[str | None]) -> list[str]:
        out: list[str] = []
        for a in range(0, len(texts), 1024):
            x = self.vectors([word_counts(t) for t in texts[a : a + 1024]])
            near = (x @ self.centres.T).argmax(1) if len(self.centres) else np.zeros(len(x), int)
            out += [f"topic_{k:02d}" if v and len(self.centres) else "none" for k, v in zip(near, x.any(1))]
        return out


def fit(texts: list[str], topics: int = TOPICS) -> TopicModel:
    counts = [c for c in map(word_counts, sorted(set(texts))) if c]
    df = np.zeros(DIMENSION)
    for c in counts:
        df[list(c)] += 1
    model = TopicModel(np.log(1 + len(counts) / np.maximum(df, 1)).astype(np.float32), np.zeros((0, DIMENSION), np.float32))
    if not counts:
        return model
    x = model.vectors(counts)
    rng = np.random.default_rng(11)
    chosen = [int(rng.integers(len(x)))]
    far = 1 - x @ x[chosen[0]]
    while len(chosen) < topics and far.max() > 1e-6:
        mass = np.maximum(far, 0)
        chosen.append(int(rng.choice(len(x), p=mass / mass.sum())))
        far = np.minimum(far, 1 - x @ x[chosen[-1]])
    c = x[chosen]
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-9), c)
    model.centres = c.astype(np.float32)
    return model


def _chunks(parts):  # noqa: ANN001, ANN202
    for batch in parts:
        for a in range(0, len(batch), CHUNK_ROWS):
            yield batch.slice(a, CHUNK_ROWS)


def _added(words: DataFrame, partial) -> dict[int, tuple[np.ndarray, float]]:  # noqa: ANN001
    """Sums of vectors and numbers by centre over all documents: in every partition, then over the partitions."""

    def merge(t: pa.Table) -> pa.Table:
        s = np.frombuffer(b"".join(t.column("s").to_pylist()), np.float64).reshape(t.num_rows, -1).sum(0)
        return pa.table({"c": t.column("c").slice(0, 1), "s": pa.array([s.tobytes()], pa.binary()), "n": pa.array([float(sum(t.column("n").to_pylist()))])})

    def run(parts):  # noqa: ANN001, ANN202
        total, count = partial(parts)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([total[i].tobytes() for i in used], pa.binary()), pa.array(count[used].astype(np.float64))], names=["c", "s", "n"])

    rows = words.mapInArrow(run, "c int, s binary, n double").groupBy("c").applyInArrow(lambda t: merge(t), "c int, s binary, n double").collect()
    return {r["c"]: (np.frombuffer(r["s"], np.float64), r["n"]) for r in rows}


def _nearest_sums(words: DataFrame, model: TopicModel, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of the documents nearest to every centre."""
    shared = words.sparkSession.sparkContext.broadcast((model, centres))

    def partial(parts):  # noqa: ANN001, ANN202
        model, c = shared.value
        total, count = np.zeros((len(c), DIMENSION)), np.zeros(len(c))
        for batch in _chunks(parts):
            x, row, at = model.decoded_vectors(batch.column("words").to_pylist())
            near = (x @ c.T).argmax(1)
            total += np.bincount(near[row] * DIMENSION + at, x[row, at], total.size).reshape(total.shape)
            count += np.bincount(near, minlength=len(c))
        return total, count

    total, count = np.zeros(centres.shape), np.zeros(len(centres))
    for c, (s, n) in _added(words, partial).items():
        total[c], count[c] = s, n
    shared.unpersist()
    return total, count


def _seeds(words: DataFrame, model: TopicModel, topics: int) -> np.ndarray:
    coded_ = words.withColumn("h", F.xxhash64("words"))
    found = model.decoded_vectors([bytes(r["words"]) for r in coded_.orderBy("h", "words").limit(1).collect()])[0]
    draw = 2 * topics
    for step in range(SEED_PASSES):
        shared = words.sparkSession.sparkContext.broadcast((model, found))

        def keys(parts, step=step, shared=shared):  # noqa: ANN001, ANN202
            model, c = shared.value
            best: list[tuple[float, bytes]] = []
            for batch in _chunks(parts):
                rows = batch.column("words").to_pylist()
                far = np.maximum(1 - (model.decoded_vectors(rows)[0] @ c.T).max(1), 0)
                h = batch.column("h").to_numpy().astype(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15 * (step + 1) % 2**64)
                u = ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(11)).astype(np.float64) / 2**53
                key = -np.log(np.maximum(u, 1e-18)) / np.maximum(far, 1e-9)
                best = sorted({*best, *((float(key[i]), rows[i]) for i in np.flatnonzero(far > 1e-6)[np.argsort(key[far > 1e-6])[: 4 * draw]])})[:draw]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in best], pa.float64()), pa.array([w for _, w in best], pa.binary())], names=["key", "words"])

        more = coded_.mapInArrow(keys, "key double, words binary").distinct().orderBy("key", "words").limit(draw).collect()
        shared.unpersist()
        if more:
            found = np.unique(np.vstack([found, model.decoded_vectors([bytes(r["words"]) for r in more])[0]]), axis=0)
    if len(found) <= topics:
        return found
    weight = _nearest_sums(words, model, found)[1]
    rng = np.random.default_rng(11)
    chosen = [int(weight.argmax())]
    far = np.maximum(1 - found @ found[chosen[0]], 0)
    while len(chosen) < topics and (weight * far).sum() > 0:
        mass = weight * far
        chosen.append(int(rng.choice(len(found), p=mass / mass.sum())))
        far = np.minimum(far, np.maximum(1 - found @ found[chosen[-1]], 0))
    return found[chosen]


def fitted(words: DataFrame, topics: int = TOPICS) -> TopicModel:
    """The model of all documents, given their coded ``words``."""
    words = words.where(F.length("words") > 0)

    def documents(parts):  # noqa: ANN001, ANN202
        with_it, n = np.zeros((1, DIMENSION)), 0
        for batch in _chunks(parts):
            with_it[0] += np.bincount(decoded(batch.column("words").to_pylist())[1], minlength=DIMENSION)
            n += len(batch)
        return with_it, np.array([n])

    with_it, n = _added(words, documents).get(0, (np.zeros(DIMENSION), 0))
    model = TopicModel(np.log(1 + n / np.maximum(with_it, 1)).astype(np.float32), np.zeros((0, DIMENSION), np.float32))
    if not n:
        return model
    c = _seeds(words, model, topics)
    for _ in range(ROUNDS):
        total = _nearest_sums(words, model, c)[0]
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-9), c).astype(np.float32)
    model.centres = c
    return model


def labelled(docs: DataFrame, model: TopicModel) -> DataFrame:
    """Documents with their topic in place of their coded words."""
    kept = [c for c in docs.columns if c != "words"]
    types = dict(docs.dtypes)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # centroids of fixed number and size

    def run(parts):  # noqa: ANN001, ANN202
        model = shared.value
        for batch in _chunks(parts):
            rows = batch.column("words").to_pylist()
            near = (model.decoded_vectors(rows)[0] @ model.centres.T).argmax(1) if len(model.centres) else np.zeros(len(rows), int)
            topic = [f"topic_{k:02d}" if w and len(model.centres) else "none" for k, w in zip(near, rows)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(topic, pa.string())], names=[*kept, "topic"])

    return docs.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in kept) + ", topic string")
