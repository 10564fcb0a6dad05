"""Groups of mutually similar vectors, by distributed k-means with parallel oversampled seeding.

Seeding draws, in a few passes, batches of vectors with a probability in proportion to their squared distance from
the seeds so far, weighs the candidates by the vectors nearest to them and reduces them to ``k`` centroids.  Rounds of
spherical k-means follow.  Every vector is then assigned to its nearest cells: those of the ``CLOSE`` nearest whose
centroid is at least as similar as two linked vectors must be, or else the ``WIDE`` nearest.  Inside the cells vectors that surely have the
wanted cosine are linked; links are joined to components by alternating large and small stars.  Cells do not bring every
pair together, so an exact pass over all vectors joins the components that hold a linked pair.  It compares every vector
with the centres of all components, and by itself only with vectors that this does not refuse; its work grows with
vectors times components.

Defined results: unusable vectors and ids without one take no part; a repeated id counts once; equal vectors always
belong together; the first id of a cluster is its smallest; an empty table gives no clusters.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinara.llm.vectors import SALTS, Prepared, blocks, by_block, packed, stacked, unit, unpacked
from opinara.runtime import drop_written, parallelism, written

LINK = 0.60
CENTRES = (8, 32_768)
CENTRE_FACTOR = 4.0
SEED_PASSES = 3
ROUNDS = 2
CLOSE, WIDE = 2, 6
STAR_ROUNDS = 60
EXACT_ROWS = 2048
PART_ROWS = 16 * EXACT_ROWS  # vectors that go to every worker at once, by way of the driver: 24 MB, and 48 MB in a worker
CORE = 0.75
PAYS = 4  # vectors a group from which comparing with centres is cheaper than with all vectors
BOUND_TILE = 4_194_304  # bounds that a worker holds at once
SLACK = 1e-5  # of a bound, for its rounding
PACKED_MARGIN, MARGIN = 2e-4, 2e-6  # most that 12 and 16 bits a component change a cosine
TYPICAL = 5


def _matrix(rows: list) -> np.ndarray:
    return unit(np.frombuffer(b"".join(bytes(r) for r in rows), np.int16).reshape(len(rows), -1))


def seeds(p: Prepared, k: int) -> np.ndarray:
    """Centroids by oversampled seeding; the result of every pass is bounded by a multiple of ``k``."""
    spark = p.classes.sparkSession
    first = p.classes.orderBy("h").limit(1).collect()
    found = _matrix([r["q"] for r in first])
    splits = max(1, p.classes.rdd.getNumPartitions())
    draw = max(1, math.ceil(k / 2))
    quota = 4 * -(-draw // splits) + 16
    for step in range(SEED_PASSES):
        shared = spark.sparkContext.broadcast(found)

        def keys(parts, step=step, shared=shared):  # noqa: ANN001, ANN202
            best: list[tuple[float, int, bytes]] = []
            for batch in parts:
                if not len(batch):
                    continue
                h = batch.column("h").to_numpy()
                d = np.maximum(1 - (unit(stacked(batch.column("q"))) @ shared.value.T).max(1), 1e-9) ** 1
                u = ((h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step * 7919 + 1)) >> np.uint64(11)).astype(np.float64) / 2**53
                key = -np.log(np.maximum(u, 1e-18)) / d
                top = np.argsort(key)[:quota]
                qs = batch.column("q")
                best = sorted(best + [(float(key[i]), int(h[i]), qs[int(i)].as_py()) for i in top])[:quota]
            yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in best], pa.float64()), pa.array([b[2] for b in best], pa.binary())], names=["key", "q"])

        more = p.classes.mapInArrow(keys, "key double, q binary").orderBy("key", "q").limit(draw).collect()
        shared.unpersist()
        if more:
            found = np.unique(np.vstack([found, _matrix([r["q"] for r in more])]), axis=0)
    if len(found) <= k:
        return found
    weight = _sums(p, found)[1]
    rng = np.random.default_rng(17)
    chosen = [int(weight.argmax())]
    dist = np.maximum(1 - found @ found[chosen[0]], 0)
    while len(chosen) < k:
        mass = weight * dist
        if mass.sum() <= 0:
            break
        nxt = int(rng.choice(len(found), p=mass / mass.sum()))
        chosen.append(nxt)
        dist = np.minimum(dist, np.maximum(1 - found @ found[nxt], 0))
    return found[chosen]


def _sums(p: Prepared, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the vectors nearest to every centre, and their number; pre-aggregated in every partition."""
    shared = p.classes.sparkSession.sparkContext.broadcast(centres)  # at most CENTRES[1] + oversampled vectors

    def partial(parts):  # noqa: ANN001, ANN202
        c = shared.value
        total, count = np.zeros(c.shape, np.float64), np.zeros(len(c))
        for batch in parts:
            if len(batch):
                x = unit(stacked(batch.column("q")))
                near = (x @ c.T).argmax(1)
                order = np.argsort(near, kind="stable")
                cut = np.flatnonzero(np.diff(np.concatenate([[-1], near[order]])))
                total[near[order][cut]] += np.add.reduceat(x[order], cut, 0)
                count += np.bincount(near, minlength=len(c))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([total[i].astype(np.float32).tobytes() for i in used], pa.binary()), pa.array(count[used])], names=["c", "s", "n"])

    def merge(t: pa.Table) -> pa.Table:
        s = np.frombuffer(b"".join(t.column("s").to_pylist()), np.float32).reshape(t.num_rows, -1).sum(0, dtype=np.float64)
        return pa.table({"c": t.column("c").slice(0, 1), "s": pa.array([s.astype(np.float32).tobytes()], pa.binary()), "n": pa.array([sum(t.column("n").to_pylist())], pa.float64())})

    merged = p.classes.mapInArrow(partial, "c int, s binary, n double").groupBy("c").applyInArrow(lambda t: merge(t), "c int, s binary, n double").collect()
    total, count = np.zeros(centres.shape), np.zeros(len(centres))
    for r in merged:
        total[r["c"]] = np.frombuffer(r["s"], np.float32)
        count[r["c"]] = r["n"]
    return total, count


def centroids(p: Prepared) -> np.ndarray:
    k = int(min(CENTRES[1], max(CENTRES[0], math.ceil(CENTRE_FACTOR * math.sqrt(max(1, p.n))))))
    c = seeds(p, k)
    for _ in range(ROUNDS):
        total, count = _sums(p, c)
        norm = np.linalg.norm(total, axis=1)
        c = np.where((norm > 0)[:, None], total / np.maximum(norm, 1e-12)[:, None], c).astype(np.float32)
    return c.astype(np.float32)


def local_links(h: np.ndarray, x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(h, smallest h) for every row but the smallest of each component inside a block."""
    order = np.argsort(h, kind="stable")
    h, x = h[order], x[order]
    n = len(h)
    open_ = np.ones(n, bool)
    label = np.arange(n)
    for s in range(n):
        if not open_[s]:
            continue
        open_[s] = False
        front = np.array([s])
        while len(front):
            rest = np.flatnonzero(open_)
            if not len(rest):
                break
            hit = np.zeros(len(rest), bool)
            for a in range(0, len(front), 512):
                todo = np.flatnonzero(~hit)
                if not len(todo):
                    break
                hit[todo] = (x[front[a : a + 512]] @ x[rest[todo]].T).max(0) >= least
            front = rest[hit]
            open_[front] = False
            label[front] = s
    own = np.flatnonzero(label != np.arange(n))
    return h[own], h[label[own]]


def components(edges: DataFrame) -> DataFrame:
    """(h, label): the smallest node of the component of every node that has an edge; edges are (u, v), u > v.

    Large and small stars alternate until nothing changes.  Minima are aggregated before the join, so no node's
    neighbours are ever gathered in one place.
    """
    edges = written(edges.distinct(), "edges")
    state = None
    for _ in range(STAR_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every node of an edge (u > v) points at the least of the node's smaller neighbours
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        new = written(small, "edges")
        now = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_written(edges)
        edges = new
        if state == now:
            return edges.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("h"), "label")
        state = now
    raise RuntimeError("the components did not settle")


def tight(x: np.ndarray, label: np.ndarray, core: float) -> tuple[np.ndarray, np.ndarray]:
    """(order, sizes): rows of equal label as groups in which every row has at least the cosine ``core`` to the centre of
    its group; rows farther off are groups of their own."""
    order, sizes, single = [], [], []
    for rows in np.split(np.argsort(label, kind="stable"), np.cumsum(np.unique(label, return_counts=True)[1])[:-1]):
        while len(rows) > 1:
            total = x[rows].sum(0)
            far = x[rows] @ total < core * np.linalg.norm(total)
            if not far.any():
                break
            single.append(rows[far])
            rows = rows[~far]
        if len(rows):
            order.append(rows)
            sizes.append(len(rows))
    alone = np.concatenate([np.zeros(0, np.int64), *single])
    return np.concatenate([*order, alone]).astype(np.int64), np.array(sizes + [1] * len(alone), np.int32)


class Groups:
    """Groups of rows that follow each other.  A row ``x`` of the group with centre ``a`` is ``alpha a + rest``, the rest of length ``r`` and
    orthogonal to ``a``.  For a row ``y = beta b + rest`` of another group the cosine is at most
    ``alpha beta ab + alpha a.rest_y + beta b.rest_x + r_x r_y``, so that of a pair of at least ``least`` one row, say ``y``,
    has ``alpha a.(y - beta b / 2) + r_x r_y / 2`` of at least half of it.  The largest ``alpha`` and ``r`` of a group bound that
    for all its rows, as long as no ``r_x r_y`` exceeds ``least``: one product of ``half`` and ``whole`` refuses whole groups."""

    def __init__(self, x: np.ndarray, sizes: np.ndarray) -> None:
        self.x, self.sizes = x, sizes.astype(np.int64)
        self.start = np.cumsum(self.sizes) - self.sizes
        centre = np.add.reduceat(x, self.start, 0)
        centre /= np.sqrt(np.einsum("ij,ij->i", centre, centre))[:, None]
        self.of = np.repeat(np.arange(len(sizes)), self.sizes)
        self.alpha = np.einsum("ij,ij->i", x, centre[self.of])
        rest = x - self.alpha[:, None] * centre[self.of]
        self.r = np.sqrt(np.einsum("ij,ij->i", rest, rest))
        self.top, self.wide = np.maximum.reduceat(self.alpha, self.start), np.maximum.reduceat(self.r, self.start)
        self.half = np.hstack([rest + (self.alpha / 2)[:, None] * centre[self.of], (self.r / 2)[:, None]])
        self.whole = np.hstack([centre * self.top[:, None], self.wide[:, None]])


def linked(mine: Groups, label: np.ndarray, part: Groups, other: np.ndarray, least: float) -> np.ndarray:
    """Pairs of different labels of linked rows of ``mine`` and ``part``, of which the row of ``mine`` is the one the bound names."""
    found, floor = [np.zeros((0, 2), np.int64)], least / 2 - SLACK
    owner = other[part.start]
    step = max(1, BOUND_TILE // len(part.sizes))
    for a in range(0, len(label), step):
        s = mine.half[a : a + step] @ part.whole.T
        y, g = np.nonzero(s >= floor)
        s, y = s[y, g], y + a
        keep = label[y] != owner[g]
        s, y, g = s[keep], y[keep], g[keep]
        c = (s - mine.r[y] / 2 * part.wide[g]) / part.top[g]
        ends = np.cumsum(part.sizes[g])
        cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, BOUND_TILE // 4), "right"))
        for lo, hi in zip(cuts, [*cuts[1:], len(y)]):
            n = part.sizes[g[lo:hi]]
            at = np.repeat(np.arange(lo, hi), n)
            x = np.arange(len(at)) - np.repeat(np.cumsum(n) - n - part.start[g[lo:hi]], n)
            keep = c[at] * part.alpha[x] + mine.r[y[at]] / 2 * part.r[x] >= floor
            at, x = y[at[keep]], x[keep]
            for i in range(0, len(x), EXACT_ROWS):
                u, v = at[i : i + EXACT_ROWS], x[i : i + EXACT_ROWS]
                hit = np.einsum("ij,ij->i", mine.x[u], part.x[v]) >= least - MARGIN
                found.append(np.stack([label[u[hit]], other[v[hit]]], 1))
    return np.unique(np.sort(np.vstack(found), 1), axis=0)


def missed_links(p: Prepared, found: DataFrame, least: float) -> DataFrame:
    """(u, v): the labels, u > v, of linked vectors of different components, of all vectors at 16 bits.

    The vectors are cut into groups around the centres of their components, and every vector is compared with every centre;
    only pairs that :class:`Groups` cannot refuse are compared themselves.  Where there are too few vectors a group for
    that to pay, all pairs of blocks are compared.
    """
    spark = p.classes.sparkSession
    core = max(CORE, math.sqrt(max(0.0, 1 - least)) + 0.01)
    # joined the same way at every size: a broadcast of the labels would not be bounded
    rows = p.classes.join(found.hint("shuffle_hash"), "h", "left").select("h", F.coalesce("label", "h").alias("label"), "q")
    rows = rows.repartitionByRange("label", "h").sortWithinPartitions("label", "h")

    def gather(parts):  # noqa: ANN001, ANN202
        for batch in parts:
            for at in range(0, len(batch), EXACT_ROWS):  # a block is named by its first vector
                t = batch.slice(at, EXACT_ROWS)
                q, label = stacked(t.column("q")), t.column("label").to_numpy()
                order, sizes = tight(unit(q), label, core)
                yield pa.RecordBatch.from_arrays([t.column("h").slice(0, 1), pa.array([len(t)], pa.int32()), pa.array([len(sizes)], pa.int32()), pa.array([label[order].tobytes()], pa.binary()), pa.array([sizes.tobytes()], pa.binary()), pa.array([q[order].tobytes()], pa.binary())], names=["b", "n", "g", "labels", "sizes", "q"])

    whole = written(rows.mapInArrow(gather, "b bigint, n int, g int, labels binary, sizes binary, q binary"), "exact-blocks")
    counts = whole.select("b", "n", "g").orderBy("b").collect()
    if sum(r["g"] for r in counts) * PAYS > sum(r["n"] for r in counts):
        return _all_pairs(whole, least)
    per = max(1, PART_ROWS // EXACT_ROWS)
    bounds = [r["b"] for r in counts[::per]]

    def against(low: int, high: int | None) -> DataFrame:
        """Links of all blocks with those named from ``low`` to below ``high``, which go to every worker."""
        some = whole.where(F.col("b") >= low) if high is None else whole.where((F.col("b") >= low) & (F.col("b") < high))
        got = some.select("labels", "sizes", "q").collect()
        shared = spark.sparkContext.broadcast([[r[c] for r in got] for c in ("labels", "sizes", "q")])
        del got

        def compare(parts):  # noqa: ANN001, ANN202
            other, sizes, q = (np.frombuffer(b"".join(v), kind) for v, kind in zip(shared.value, (np.int64, np.int32, np.int16)))
            part = Groups(unit(q.reshape(len(other), -1)), sizes)
            for batch in parts:
                for labels, sizes, q in zip(*(batch.column(c).to_pylist() for c in ("labels", "sizes", "q"))):
                    label = np.frombuffer(labels, np.int64)
                    mine = Groups(unit(np.frombuffer(q, np.int16).reshape(len(label), -1)), np.frombuffer(sizes, np.int32))
                    pairs = linked(mine, label, part, other, least)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 1]), pa.array(pairs[:, 0])], names=["u", "v"])

        few = whole.select("labels", "sizes", "q").coalesce(2 * parallelism(spark))  # every task prepares the part
        links = written(few.mapInArrow(compare, "u bigint, v bigint").distinct(), "exact-links")
        shared.destroy()  # also the driver's copy
        return links

    out = None
    for low, high in zip(bounds, [*bounds[1:], None]):
        links = against(low, high)
        out = links if out is None else out.unionByName(links)
    return out


def _all_pairs(whole: DataFrame, least: float) -> DataFrame:
    one, two = (whole.select(*[F.col(c).alias(f"{c}{k}") for c in whole.columns]) for k in (1, 2))

    def compare(parts):  # noqa: ANN001, ANN202
        def read(batch: pa.RecordBatch, k: int, i: int) -> tuple[np.ndarray, np.ndarray]:
            label = np.frombuffer(batch.column(f"labels{k}")[i].as_py(), np.int64)
            return label, unit(np.frombuffer(batch.column(f"q{k}")[i].as_py(), np.int16).reshape(len(label), -1))

        last = None
        for batch in parts:
            for i, b in enumerate(batch.column("b1").to_pylist()):
                if b != last:
                    last, (label, x) = b, read(batch, 1, i)
                other, y = read(batch, 2, i)
                at, to = np.nonzero(x @ y.T >= least - MARGIN)
                pairs = np.stack([label[at], other[to]], 1)
                pairs = np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 1]), pa.array(pairs[:, 0])], names=["u", "v"])

    return one.join(two, F.col("b1") <= F.col("b2")).mapInArrow(compare, "u bigint, v bigint")


def labelled(p: Prepared, least: float = LINK) -> DataFrame:
    """(id, h, label): the cluster of every id; ids that are linked to no other have their own."""
    if p.n == 0:
        return p.ids.select("id", "h", F.col("h").alias("label"))
    c = centroids(p)
    shared = p.classes.sparkSession.sparkContext.broadcast(c)

    def assign(parts):  # noqa: ANN001, ANN202
        c = shared.value
        wide, close = min(WIDE, len(c)), min(CLOSE, len(c))
        for batch in parts:
            if not len(batch):
                continue
            q = stacked(batch.column("q"))
            s = unit(q) @ c.T
            top = np.argpartition(-s, wide - 1, 1)[:, :wide] if wide < len(c) else np.argsort(-s, 1)
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), 1, kind="stable"), 1)
            near = (np.take_along_axis(s, top[:, :close], 1) >= least).sum(1)
            n = np.where(near > 0, near, wide)
            keep = np.arange(wide)[None, :] < n[:, None]
            at = np.repeat(np.arange(len(batch)), n)
            yield pa.RecordBatch.from_arrays([pa.array(top[keep].astype(np.int32)), batch.column("h").take(pa.array(at)), packed(q).take(pa.array(at))], names=["cell", "h", "q"])

    cells = p.classes.mapInArrow(assign, "cell int, h bigint, q binary")
    sizes = {r["cell"]: r["count"] for r in cells.groupBy("cell").count().collect()}

    def work(t: pa.Table) -> pa.Table:
        u, v = local_links(t.column("h").to_numpy(), unpacked(t.column("q")), least + PACKED_MARGIN)
        return pa.table({"u": pa.array(u), "v": pa.array(v)})

    links = by_block(blocks(cells, "cell", sizes), work, "u bigint, v bigint")
    found = written(components(links), "found")
    joined = components(missed_links(p, found, least)).select(F.col("h").alias("label"), F.col("label").alias("root"))
    ids = p.ids.join(found, "h", "left").select("id", "h", F.coalesce("label", "h").alias("label"))
    return ids.join(joined, "label", "left").select("id", "h", F.coalesce("root", "label").alias("label"))


def cluster_members(p: Prepared, least: float = LINK, smallest: int = 3) -> DataFrame:
    """(first_id, member_id, size) of every id in a cluster of at least ``smallest`` ids."""
    ids = written(labelled(p, least), "labels")
    groups = ids.groupBy("label").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("size")).where(F.col("size") >= smallest)
    return ids.join(groups, "label").select("label", "first_id", F.col("id").alias("member_id"), "h", "size")


def describe_clusters(p: Prepared, least: float = LINK, smallest: int = 3) -> DataFrame:
    """Per cluster: first id, size, mean cosine to the centroid and the ids nearest to it."""
    members = written(cluster_members(p, least, smallest), "members")
    vectors = written(members.select("label", "h", "member_id").join(p.classes, "h"), "member-vectors")
    salted = vectors.withColumn("salt", F.pmod(F.xxhash64("member_id"), F.lit(SALTS)))

    def add_up(t: pa.Table) -> pa.Table:
        s = unit(stacked(t.column("q"))).sum(0, dtype=np.float64)
        return pa.table({"label": t.column("label").slice(0, 1), "s": pa.array([s.tobytes()], pa.binary())})

    def centre(t: pa.Table) -> pa.Table:
        s = np.frombuffer(b"".join(t.column("s").to_pylist()), np.float64).reshape(t.num_rows, -1).sum(0)
        norm = float(np.linalg.norm(s))
        return pa.table({"label": t.column("label").slice(0, 1), "g": pa.array([(s / norm if norm > 0 else s).astype(np.float32).tobytes()], pa.binary())})

    centres = salted.groupBy("label", "salt").applyInArrow(lambda t: add_up(t), "label bigint, s binary").groupBy("label").applyInArrow(lambda t: centre(t), "label bigint, g binary")

    def score(parts):  # noqa: ANN001, ANN202
        for batch in parts:
            if len(batch):
                g = np.frombuffer(b"".join(batch.column("g").to_pylist()), np.float32).reshape(len(batch), -1)
                sim = np.einsum("ij,ij->i", unit(stacked(batch.column("q"))), g)
                yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("member_id"), pa.array(sim.astype(np.float64))], names=["label", "member_id", "sim"])

    scored = vectors.join(centres, "label").select("label", "member_id", "q", "g").mapInArrow(score, "label bigint, member_id string, sim double")
    scored = written(scored, "member-scores")
    stats = scored.groupBy("label").agg(F.min("member_id").alias("first_id"), F.count(F.lit(1)).alias("size"), F.avg("sim").alias("mean_similarity"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("sim"), "member_id"))
    typical = scored.withColumn("r", rank).where(F.col("r") <= TYPICAL).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("r", "member_id"))).alias("t"))
    return stats.join(typical, "label").select("first_id", "size", "mean_similarity", F.transform("t", lambda x: x["member_id"]).alias("typical_ids"))
