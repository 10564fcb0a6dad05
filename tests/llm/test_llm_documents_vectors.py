import numpy as np
import pytest
from pyspark.sql import functions as F

from opinara.llm import clustering, neighbours, topics, vectors
from opinara.llm.mixing import margins, mix, rake, shares
from opinara.llm.packing import best_fit, pack
from opinara.llm.tokens import count_tokens


def test_best_fit_is_tight_and_whole():
    rng = np.random.default_rng(0)
    sizes = np.sort(rng.integers(1, 250, 3000))[::-1]
    where = best_fit(sizes, 256)
    used = np.bincount(where, sizes)
    assert used.max() <= 256 and used.sum() == sizes.sum() and used.mean() > 0.97 * 256
    many, attention = np.bincount(where), np.bincount(where, sizes.astype(float) ** 2)
    assert many.max() <= 16 and (attention[many > 1] <= 0.85 * 256**2).all()
    assert len(best_fit(np.zeros(0, int), 256)) == 0


def test_every_constraint_decides():
    """Each choice against all open bins by the definition; without a constraint the bins differ."""
    from opinara.llm.packing import WEIGHTS

    rng = np.random.default_rng(7)
    cap, items, attention = 100, 5, 0.5 * 100**2
    sizes = np.sort(rng.integers(1, 90, 400))[::-1]
    bins, want = [], []
    for n in sizes.tolist():
        fits = [(WEIGHTS[0] * ((t - n) / cap) ** 2 + WEIGHTS[1] * ((r - 1) / items) ** 2 + WEIGHTS[2] * ((a - n * n) / attention) ** 2, k) for k, (t, r, a) in enumerate(bins) if t >= n and r >= 1 and a >= n * n]
        if fits:
            k = min(fits)[1]
        else:
            k = len(bins)
            bins.append((cap, items, attention))
        t, r, a = bins[k]
        bins[k] = (t - n, r - 1, a - n * n)
        want.append(k)
    assert best_fit(sizes, cap, items, attention).tolist() == want
    for free in ((10**9, attention), (items, 1e18), (10**9, 1e18)):
        assert best_fit(sizes, cap, *free).max() < max(want)


def test_pack_round_trip(spark):
    items = spark.createDataFrame([(i, n) for i, n in enumerate([0, 1, 256, 257, 1000, 30, 30, 255])], "doc_id bigint, n_tokens bigint")
    budgets = spark.createDataFrame([("tiny", 256), ("none", 0)], "budget_name string, capacity_tokens bigint")
    got = pack(items, budgets, 2).toPandas()
    assert got.groupby("doc_id").n_tokens.sum().to_dict() == {1: 1, 2: 256, 3: 257, 4: 1000, 5: 30, 6: 30, 7: 255}
    assert got.groupby("bin_id").n_tokens.sum().max() <= 256
    assert (got[got.n_tokens < 256].groupby("doc_id").size() == 1).all()
    assert pack(items.limit(0), budgets, 1).count() == 0


def test_tokens(spark):
    pytest.importorskip("tiktoken")
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "word " * 20000)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in count_tokens(df).collect()}
    assert got[2] == got[3] == 0 and got[1] == 2 and got[4] > 19_000


def test_mix_reaches_shares(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [" A ", "b", "a-x", None][int(rng.choice(4, p=[0.6, 0.1, 0.2, 0.1]))], ["en", None, "de"][i % 3], int(rng.integers(0, 400))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_tokens bigint")
    targets = spark.createDataFrame([("m", "a", 0.3, 2), ("m", "B", 0.5, 3), ("m", "a_x", 0.2, 1), ("m", "missing", 0.0, 1)], "mix_name string, source_name string, target_share double, max_repeats int")
    sel = mix(docs, targets)
    got = {r["source_name"]: r for r in shares(sel, targets).collect()}
    for s in ("a", "b", "a_x"):
        assert abs(got[s]["actual_share"] - got[s]["target_share"]) < 0.005 and got[s]["most_times"] <= got[s]["max_repeats"]
    assert sel.groupBy("mix_name", "doc_id").count().where("count > 1").count() == 0


def test_topics(spark):
    texts = [f"guitar drums melody chorus {i}" for i in range(40)] + [f"invoice refund payment charge {i}" for i in range(40)]
    m = topics.fit(texts, 2)
    got = m(texts + ["", None, "a b c"])
    assert len(set(got[:40])) == len(set(got[40:80])) == 1 and got[0] != got[40] and got[80:] == ["none"] * 3
    assert topics.fit([])(["guitar"]) == ["none"]
    df = spark.createDataFrame([(i, "a", None, 10 + i, t) for i, t in enumerate(m(texts))], "doc_id int, source string, lang string, n_tokens int, topic string")
    targets = spark.createDataFrame([("m", "a", 1.0, 1)], "mix_name string, source_name string, target_share double, max_repeats int")
    rows = margins(mix(df, targets), df, targets).collect()
    assert {r["margin"] for r in rows} == {"lang", "topic"} and all(abs(r["pool_share"] - r["actual_share"]) < 0.02 for r in rows)


def test_topics_of_all_documents(spark):
    """Every document counts in the weights and centroids: more than 4,000 of them, once a limit."""
    texts = [f"guitar drums melody chorus {'solo' * (i % 3)}" for i in range(4500)] + [f"invoice refund payment charge {'late' * (i % 3)}" for i in range(1500)]
    docs = spark.createDataFrame([(i, topics.coded(t)) for i, t in enumerate([*texts, "", None, "a b"])], "doc_id int, words binary")
    m = topics.fitted(docs.select("words"), 2)
    place = list(topics.word_counts("refund"))[0]
    assert abs(m.weight[place] - np.log(1 + 6000 / 1500)) < 1e-6
    got = [r["topic"] for r in topics.labelled(docs, m).orderBy("doc_id").collect()]
    assert len(set(got[:4500])) == len(set(got[4500:6000])) == 1 and got[0] != got[4500] and got[6000:] == ["none"] * 3
    assert got[:6000:1000] == m(texts)[::1000]
    none = topics.fitted(docs.where("doc_id >= 6000").select("words"), 2)
    assert [r["topic"] for r in topics.labelled(docs.limit(2), none).collect()] == ["none"] * 2


def test_rake_margins():
    t = np.array([10.0, 20, 30, 40])
    w = rake(t, [np.array([50.0, 50]), np.array([40.0, 60])], [np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])], np.full(4, 9.0))
    assert np.allclose(np.bincount([0, 0, 1, 1], w * t), [50, 50])


def _data(spark, n=600, d=384, seed=0):
    rng = np.random.default_rng(seed)
    x = []
    for c in range(12):
        g = rng.normal(size=d)
        x += [g / np.linalg.norm(g) + rng.normal(size=d) * 0.03 for _ in range(n // 12)]
    x = np.array(x) * rng.uniform(0.1, 5, (len(x), 1))
    x[1::50] = x[0::50][: len(x[1::50])]  # copies
    rows = [(f"r{i:04d}", v.astype(np.float32).tolist(), "clash") for i, v in enumerate(x)]
    bad = [("n1", None, "k"), ("n2", [], "k"), ("n3", [1.0] * 256, "k"), ("n4", [0.0] * d, "k"), ("n5", [float("nan")] * d, "k"), (None, [1.0] * d, "k"), rows[3]]
    return x, spark.createDataFrame(rows + bad, "id string, vector array<float>, h string").select("id", "vector")


def test_packing_precision():
    x = np.random.default_rng(0).normal(size=(50, 384))
    q = vectors.quantise(x / np.linalg.norm(x, axis=1, keepdims=True))
    a, b = vectors.unit(q), vectors.unpacked(vectors.packed(q))
    assert np.abs(a @ a.T - b @ b.T).max() < 2e-4


def test_neighbours_recall(spark):
    x, df = _data(spark)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    kth = np.sort(s, 1)[:, -10]
    got = neighbours.nearest(vectors.prepared(df)).collect()
    assert len(got) == len(x)
    hits = sum(s[int(r["id"][1:]), int(o["id"][1:])] >= kth[int(r["id"][1:])] - 3e-4 for r in got for o in r["neighbours"])
    assert hits >= 0.9 * 10 * len(x)
    assert all(r["id"] not in {o["id"] for o in r["neighbours"]} and len(r["neighbours"]) <= 10 for r in got)


def test_footrule_decides():
    """Distances against the definition; in a file of more rows than are ranked again, only the nearest orders are."""
    rng = np.random.default_rng(2)
    n, m, width = 300, 30, 8
    order = np.array([rng.permutation(m)[:width] for _ in range(n)])
    ranks = neighbours.Footrule(order)

    def plain(a, b):
        place = lambda o, p: int(np.flatnonzero(o == p)[0]) if p in o else width
        return sum(abs(place(a, p) - place(b, p)) for p in set(a) | set(b))

    for i in (0, 7, 299):
        assert ranks.of(i).tolist() == [plain(order[i], o) for o in order]
    x = rng.normal(size=(n, 20)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r, c, s = neighbours.search_file(np.arange(n), order, x, 5, 40, 0.1)
    for i in range(0, n, 25):
        far = ranks.of(i)
        allowed = np.flatnonzero(far <= np.sort(far)[39])
        best = sorted((-float(x[i] @ x[j]), int(j)) for j in allowed if j != i)[:5]
        assert {int(j) for j in c[r == i]} == {j for _, j in best}
    full = neighbours.search_file(np.arange(n), order, x, 5, n, 1.0)
    assert (set(zip(r, c)) != set(zip(*full[:2]))) and len(full[0]) == 5 * n


def test_neighbours_recall_where_the_footrule_decides(spark):
    x, df = _data(spark, seed=5)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    kth = np.sort(s, 1)[:, -10]
    got = neighbours.nearest(vectors.prepared(df), rerank=30).collect()
    hits = sum(s[int(r["id"][1:]), int(o["id"][1:])] >= kth[int(r["id"][1:])] - 3e-4 for r in got for o in r["neighbours"])
    assert hits >= 0.9 * 10 * len(x)


def test_blocks_meet_all_pairs(spark):
    rows = spark.createDataFrame([(1, i) for i in range(40)] + [(2, 99)], "cell int, h bigint")
    got = vectors.blocks(rows, "cell", {1: 40, 2: 1}, most=16)
    by = {}
    for r in got.collect():
        by.setdefault(r["block"], set()).add(r["h"])
    assert all(any({a, b} <= m for m in by.values()) for a in range(40) for b in range(a))
    assert {99} in by.values()


def test_clusters_exact(spark):
    x, df = _data(spark, seed=3)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    label = list(range(len(x)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in zip(*np.nonzero(np.triu(s >= 0.6, 1))):
        a, b = find(int(i)), find(int(j))
        label[max(a, b)] = min(a, b)
    roots = [find(i) for i in range(len(x))]
    want = {(f"r{r:04d}", f"r{i:04d}") for i, r in enumerate(roots) if roots.count(r) >= 3}
    got = {(r["first_id"], r["member_id"]) for r in clustering.cluster_members(vectors.prepared(df)).collect()}
    assert got == want


def test_clusters_whose_vectors_share_no_cell(spark, monkeypatch):
    e = np.eye(384)
    c = 0.60001  # cosine of neighbours in the chain, a little above the threshold
    x = [e[0]]
    for i in (1, 2):
        x.append(c * x[-1] + np.sqrt(1 - c * c) * e[i])
    # two centroids closest to every vector: none is shared by two of them
    monkeypatch.setattr(clustering, "centroids", lambda p: np.array([v / np.linalg.norm(v) for u in x for v in (u + 0.05 * e[9], u - 0.05 * e[9])], np.float32))
    df = spark.createDataFrame([(f"r{i}", v.tolist()) for i, v in enumerate([*x, e[50]])], "id string, vector array<double>")
    got = {(r["first_id"], r["member_id"]) for r in clustering.cluster_members(vectors.prepared(df)).collect()}
    assert got == {("r0", "r0"), ("r0", "r1"), ("r0", "r2")}


def test_bound_of_groups_refuses_no_link():
    """Every linked pair is named by one of its rows, whatever the groups: correlated centres, loose rows, rows apart."""
    rng = np.random.default_rng(4)
    named = 0
    for noise in (0.2, 0.6, 0.9, 1.2):
        c = rng.normal(size=(30, 24)) + 1.5 * rng.normal(size=24)
        x = np.repeat(c / np.linalg.norm(c, axis=1, keepdims=True), 10, 0) + noise * rng.normal(size=(300, 24)) / np.sqrt(24)
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        label = np.repeat(np.arange(30), 10)
        order, sizes = clustering.tight(x, label, 0.75)
        assert sorted(order) == list(range(300)) and sizes.sum() == 300
        x, label = x[order], label[order]
        one = clustering.Groups(x, sizes)
        assert one.alpha.min() >= 0.75 - 1e-6
        got = {tuple(p) for p in clustering.linked(one, label, one, label, 0.6)}
        u, v = np.nonzero(x @ x.T >= 0.6)
        want = {(min(a, b), max(a, b)) for a, b in zip(label[u], label[v]) if a != b}
        assert got == want
        named += len(want)
    assert named > 100


def test_missed_links_in_parts(spark, monkeypatch):
    """Groups torn apart are joined again by comparing with centres, not all pairs; parts of one block each."""
    monkeypatch.setattr(clustering, "EXACT_ROWS", 64)
    monkeypatch.setattr(clustering, "PART_ROWS", 64)
    monkeypatch.setattr(clustering, "_all_pairs", None)
    rng = np.random.default_rng(6)
    c = rng.normal(size=(8, 384))
    x = np.repeat(c / np.linalg.norm(c, axis=1, keepdims=True), 40, 0) + 0.6 * rng.normal(size=(320, 384)) / np.sqrt(384)
    df = spark.createDataFrame([(f"r{i:03d}", v.tolist()) for i, v in enumerate(x)], "id string, vector array<double>")
    p = vectors.prepared(df)
    h = {r["id"]: r["h"] for r in p.ids.collect()}
    part = [i // 10 for i in range(320)]
    first = {k: min(h[f"r{i:03d}"] for i in range(320) if part[i] == k) for k in set(part)}
    found = spark.createDataFrame([(h[f"r{i:03d}"], first[part[i]]) for i in range(320)], "h bigint, label bigint")
    got = {(r["u"], r["v"]) for r in clustering.missed_links(p, found, 0.6).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(first[part[i]], first[part[j]]) for i, j in zip(*np.nonzero(u @ u.T >= 0.6)) if first[part[i]] > first[part[j]]}
    assert got == want and len(want) >= 8 * 3


def test_components_of_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(101, 100)], "u bigint, v bigint")
    got = {r["h"]: r["label"] for r in clustering.components(edges).collect()}
    assert set(got[i] for i in range(1, 61)) == {0} and got[101] == 100


def test_hashed_features(spark):
    df = spark.createDataFrame([("the cat the hat",), ("",), (None,)], "t string")
    v = [r[0] for r in df.select(vectors.hashed_features(F.col("t"), 16)).collect()]
    assert any(v[0]) and not any(v[1]) and not any(v[2])
