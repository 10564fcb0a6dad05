"""Near-duplicates by min-hash bands, resolved first come first kept.

Equal shingle sets are collapsed first: all but the first are dropped, whatever their number.  Candidates are pairs of
representatives that share a band; of those, pairs with a Jaccard similarity of at least the threshold are links from
the earlier to the later text.  A text is dropped if an earlier kept text is linked to it; dropped texts drop nothing.

Most candidates are refused by their marks: every shingle sets one of ``MARKS`` bits, so bits that only one of two
texts has set bound their similarity from above.  The similarity of the others is counted from their shingles.

Defined results: texts with fewer than three characters after removing blanks are never duplicates; ties of the order
column go to the smaller key; null texts count as empty.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara import config
from opinara.functions import text as tx
from opinara.runtime import drop_written, spread, written

ROUNDS = 200
MARKS = 256
CHUNK_ROWS, CHUNK_PAIRS = 512, 65_536  # texts or pairs that are handled at once
_FACTORS = np.random.default_rng(5).integers(0, 2**32, (config.LSH_PERMUTATIONS, 2), dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def signature(parts, permutations: int = config.LSH_PERMUTATIONS):  # noqa: ANN001, ANN201
    """Minima of ``permutations`` hashes over a column of shingles in the published md5 form."""
    return F.transform(F.sequence(F.lit(0), F.lit(permutations - 1)), lambda i: F.array_min(F.transform(parts, lambda s: F.md5(F.concat(s, F.char(i))))))


def shingled(df: DataFrame, key: str, text: str, order: str) -> DataFrame:
    return df.select(F.col(key).alias("k"), F.col(order).alias("o"), tx.shingles(F.col(text)).alias("sh")).where(F.size("sh") > 0)


def resolve(links: DataFrame) -> DataFrame:
    """Keys that are dropped.  ``links`` are (early, late); a node is settled once all its earlier neighbours are."""
    links = written(links, "dedup-links")
    state = written(links.select(F.col("late").alias("k")).union(links.select("early")).distinct().withColumn("s", F.lit(None).cast("string")), "dedup-state")
    for _ in range(ROUNDS):
        seen = links.join(state.select(F.col("k").alias("early"), F.col("s").alias("es")), "early").groupBy("late").agg(
            F.max((F.col("es") == "kept").cast("int")).alias("hit"), F.max(F.col("es").isNull().cast("int")).alias("open")
        )
        new = state.join(seen.withColumnRenamed("late", "k"), "k", "left").select(
            "k", F.coalesce("s", F.when(F.coalesce("hit", F.lit(0)) == 1, "dropped").when(F.coalesce("open", F.lit(0)) == 0, "kept")).alias("s")
        )
        new = written(new, "dedup-state")
        drop_written(state)
        state = new
        if not state.where("s is null").take(1):
            return state.where("s = 'dropped'").select("k")
    raise RuntimeError("near-duplicate chains did not settle")


def shingle_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of texts without blanks, sorted inside every text, and the end of each text among them.

    A shingle is the number of its three code points of 21 bits, so equal numbers are equal shingles.
    """
    c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    many = np.maximum(size - config.SHINGLE + 1, 0)
    end = np.cumsum(many)
    row = np.repeat(np.arange(len(texts)), many)
    at = np.arange(len(row)) + (np.cumsum(size) - size - (end - many))[row]
    code = np.zeros(len(row), np.uint64)
    for i in range(config.SHINGLE):
        code = (code << np.uint64(21)) | c[at + i]
    for a, b in zip((end - many).tolist(), end.tolist()):
        code[a:b].sort()
    new = np.ones(len(row), bool)
    new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
    return code[new], np.cumsum(np.bincount(row[new], minlength=len(texts)))


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers scattered one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def band_keys(code: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One number a text and band: equal where all minima of the band are, and else hardly ever.  Every text has at
    least one shingle.

    Each of the hashes has its own pair of factors; with factors in nearly one ratio their minima would fall on the
    same shingle, and one shared shingle would make all bands equal.
    """
    x = _mixed(code)
    low, high = x.astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32)
    start = np.concatenate([[0], end[:-1]])
    rows = config.LSH_PERMUTATIONS // config.LSH_BANDS
    out = np.empty((len(end), config.LSH_BANDS), np.uint64)
    for band in range(config.LSH_BANDS):
        key = np.full(len(end), band + 1, np.uint64)
        for a, b in _FACTORS[band * rows : (band + 1) * rows]:
            key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(low * a + high * b, start))
        out[:, band] = key
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _marks(code: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The bits that the shingles of every text set."""
    bits = np.zeros((len(end), MARKS), bool)
    bits[np.repeat(np.arange(len(end)), np.diff(end, prepend=0)), _mixed(code ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(MARKS)] = True
    return np.packbits(bits, 1)


def _described(parts):  # noqa: ANN001, ANN202
    """Texts with a digest of their shingle set, its size and its marks."""
    for whole in parts:
        for a in range(0, len(whole), CHUNK_ROWS):
            batch = whole.slice(a, CHUNK_ROWS)
            code, end = shingle_codes(batch.column("flat").to_pylist())
            n = np.diff(end, prepend=0)
            data = code.tobytes()
            digests = [hashlib.blake2b(data[8 * (e - m) : 8 * e], digest_size=16).digest() for e, m in zip(end.tolist(), n.tolist())]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("k", "o", "flat")), pa.array(digests, pa.binary()), pa.array(n.astype(np.int32)), pa.array([m.tobytes() for m in _marks(code, end)], pa.binary())],
                names=["k", "o", "flat", "h", "n", "marks"],
            )


def _banded(parts):  # noqa: ANN001, ANN202
    """A row for every text and band."""
    for whole in parts:
        for a in range(0, len(whole), CHUNK_ROWS):
            batch = whole.slice(a, CHUNK_ROWS)
            keys = band_keys(*shingle_codes(batch.column("flat").to_pylist()))
            k = batch.column("k").take(pa.array(np.repeat(np.arange(len(batch)), config.LSH_BANDS)))
            yield pa.RecordBatch.from_arrays([k, pa.array(np.tile(np.arange(config.LSH_BANDS, dtype=np.int32), len(batch))), pa.array(keys.ravel())], names=["k", "b", "x"])


def _paired(parts):  # noqa: ANN001, ANN202
    """All pairs (a, b), a < b, of the keys of one band; rows come in the order of band and key."""
    rest = None

    def together(batch):  # noqa: ANN001, ANN202
        return (batch.column("b").to_numpy().astype(np.int64) << 32) + batch.column("x").to_numpy()

    def pairs(batch):  # noqa: ANN001, ANN202
        x, k = together(batch), batch.column("k")
        at, step, i, j, held = np.arange(len(x)), 0, [], [], 0
        while len(at):
            step += 1
            at = at[at + step < len(x)]
            at = at[x[at] == x[at + step]]
            for a in range(0, len(at), CHUNK_PAIRS):
                i.append(at[a : a + CHUNK_PAIRS])
                j.append(i[-1] + step)
                held += len(i[-1])
                if held >= CHUNK_PAIRS:
                    yield pa.RecordBatch.from_arrays([k.take(pa.array(np.concatenate(i))), k.take(pa.array(np.concatenate(j)))], names=["a", "b"])
                    i, j, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([k.take(pa.array(np.concatenate(i))), k.take(pa.array(np.concatenate(j)))], names=["a", "b"])

    for batch in parts:
        if rest is not None and len(rest):
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        x = together(batch)
        cuts = np.flatnonzero(x[1:] != x[:-1]) + 1
        whole = int(cuts[-1]) if len(cuts) else 0
        yield from pairs(batch.slice(0, whole))
        rest = batch.slice(whole)
    if rest is not None:
        yield from pairs(rest)


def _possible(batch: pa.RecordBatch, threshold: float) -> np.ndarray:
    """Whether sizes and marks of two texts allow the threshold."""
    n, m = (batch.column(c).to_numpy().astype(np.int64) for c in ("n", "m"))
    a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(len(n), -1) for c in ("marks", "other"))
    common = np.minimum(n - np.bitwise_count(a & ~b).sum(1, dtype=np.int64), m - np.bitwise_count(b & ~a).sum(1, dtype=np.int64))
    return common / (n + m - common) >= threshold


def _similar(batch: pa.RecordBatch, threshold: float) -> np.ndarray:
    """Whether two texts reach the threshold."""
    (a, ends), (b, others) = (shingle_codes(batch.column(c).to_pylist()) for c in ("flat", "other"))
    out = np.zeros(len(batch), bool)
    i = j = 0
    for at, (e, f) in enumerate(zip(ends.tolist(), others.tolist())):
        both = np.concatenate([a[i:e], b[j:f]])
        both.sort()
        common = int((both[1:] == both[:-1]).sum())
        out[at] = common / (len(both) - common) >= threshold
        i, j = e, f
    return out


def _checked(pairs: DataFrame, test, threshold: float) -> DataFrame:  # noqa: ANN001
    """Pairs that pass a test of their columns."""
    kind = dict(pairs.dtypes)["early"]

    def run(parts):  # noqa: ANN001, ANN202
        for whole in parts:
            for a in range(0, len(whole), CHUNK_ROWS * 4):
                batch = whole.slice(a, CHUNK_ROWS * 4)
                yield batch.select(["early", "late"]).filter(pa.array(test(batch, threshold)))

    return pairs.mapInArrow(run, f"early {kind}, late {kind}")


def near_duplicates(df: DataFrame, key: str, text: str, order: str, threshold: float = config.LSH_THRESHOLD) -> DataFrame:
    """(key, kept boolean) per row with at least one shingle."""
    # an order that is the key itself says nothing more
    time = F.lit(None).cast("int") if order == key else F.col(order)
    flat = df.select(F.col(key).alias("k"), time.alias("o"), tx.without_blanks(F.col(text)).alias("flat")).where(F.length("flat") >= config.SHINGLE)
    types = dict(flat.dtypes)
    sh = written(spread(flat, "k").mapInArrow(_described, f"k {types['k']}, o {types['o']}, flat string, h binary, n int, marks binary"), "dedup-shingles")
    # equal sets: the first is the representative
    first = written(sh.groupBy("h").agg(F.min(F.struct("o", "k")).alias("f")).select("h", F.col("f.k").alias("k")), "dedup-representatives")
    bands = sh.select("k", "flat").join(first.select("k"), "k", "left_semi").mapInArrow(_banded, f"k {types['k']}, b int, x int")
    pairs = bands.repartition("b", "x").sortWithinPartitions("b", "x", "k").mapInArrow(_paired, f"a {types['k']}, b {types['k']}").repartition("a").distinct()
    side = lambda k, o, n, m: sh.select(F.col("k").alias(k), F.col("o").alias(o), F.col("n").alias(n), F.col("marks").alias(m))
    both = pairs.join(side("a", "oa", "n", "marks"), "a").join(side("b", "ob", "m", "other"), "b")
    swap = F.coalesce(F.col("ob") < F.col("oa"), F.col("ob").isNull() & F.col("oa").isNotNull())  # of one time the smaller key is first
    both = both.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("early"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("late"), "n", "marks", "m", "other")
    near = _checked(both, _possible, threshold)
    # the texts are joined once: a row for either text of a pair, and the two rows (of different texts) put together
    ends = near.select(F.explode(F.array("early", "late")).alias("k"), "early", "late").join(sh.select("k", "flat"), "k")
    texts = ends.groupBy("early", "late").agg(F.min("flat").alias("flat"), F.max("flat").alias("other"))
    dropped = resolve(_checked(texts, _similar, threshold)).withColumn("lost", F.lit(True))
    out = sh.select("k", "h").join(first.select("h", F.col("k").alias("rep")), "h").join(dropped.withColumnRenamed("k", "rep"), "rep", "left")
    return out.select(F.col("k").alias(key), (F.col("lost").isNull() & (F.col("k") == F.col("rep"))).alias("kept"))
