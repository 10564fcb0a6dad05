import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from opinara.functions import text as tx
from opinara.operators import metrics, records, routing, search
from opinara.operators.dedup import band_keys, near_duplicates, shingle_codes
from opinara.operators.evidence import filtered_packages, source_synergy
from opinara.operators.filters import ReviewFilter, preprocess, process_reviews
from opinara.operators.leader import Leaders, leader_follower, split_two
from opinara.operators.search import against
from opinara.operators.themes import term_weights


def test_upsert_keeps_and_resets(spark):
    old = spark.createDataFrame([("a", 1, "x", 1), ("b", 2, "y", 1)], "id string, rating int, source string, analysed int")
    new = spark.createDataFrame([("b", 5, "z", 1), ("c", 3, "w", 1)], "id string, rating int, source string, analysed int")
    got = {tuple(r) for r in records.upsert(old, new, "id", keep=("source",), reset={"analysed": 0}).collect()}
    assert got == {("a", 1, "x", 1), ("b", 5, "y", 0), ("c", 3, "w", 0)}
    assert records.insert_ignore(old, new, "id").count() == 3


def _brute(texts, t=0.8):
    sets = [{s[i : i + 3] for i in range(len(s) - 2)} for s in ("".join(x.lower().split()) for x in texts)]
    kept = []
    for i, a in enumerate(sets):
        if not a:
            continue
        if all(len(a & sets[j]) / len(a | sets[j]) < t for j in kept):
            kept.append(i)
    return set(kept)


def test_near_duplicates_match_brute_force(spark):
    random.seed(3)
    base = ["the shuffle keeps playing the same songs over and over again every single day", "my downloads vanish whenever i restart the phone and nobody answers at all", "ads are twice as loud as the music which makes me very sad indeed"]
    texts = []
    for i in range(60):
        t = base[i % 3]
        if i % 4 == 1:
            t = t.replace("same", "very same", 1) + "!"
        if i % 5 == 2:
            t = t + " " + random.choice(["x", "y", "z"]) * 2
        texts.append(t)
    texts += ["", "ab", base[0]] * 2
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "n int, t string, k string")
    got = {r["n"] for r in near_duplicates(df.drop("k"), "n", "t", "n").where("kept").collect()}
    assert got == _brute(texts)


def test_band_keys_are_independent():
    """Texts that share a third of their shingles hardly ever share a band (nearly proportional hashes made all bands equal)."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    texts = [t for _ in range(300) for c in [word(60)] for t in (c + word(62), c + word(62))]
    keys = band_keys(*shingle_codes(texts)).reshape(300, 2, -1)
    assert ((keys[:, 0] == keys[:, 1]).any(1)).mean() < 0.05
    code, end = shingle_codes(["abcabc", "ab", "xyz\U0001f600"])
    assert np.diff(end, prepend=0).tolist() == [3, 0, 2] and code[3] == (ord("x") << 42) + (ord("y") << 21) + ord("z")


def test_terms_and_synergy(spark):
    rows = [("c1", "alpha alpha beta the"), ("c2", "beta gamma the"), ("c3", None), (None, "delta")]
    got = {(r[0], r[1]): r[2] for r in term_weights(spark.createDataFrame(rows, "g string, t string"), "g", "t").select("g", "term", "weight").collect()}
    mean = (4 + 3) / 2
    assert abs(got["c1", "alpha"] - 2 * np.log(1 + mean / 1)) < 1e-9 and abs(got["c2", "beta"] - np.log(1 + mean / 2)) < 1e-9
    assert ("c1", "the") not in got
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "x")], "cluster_id string, source string")
    assert {r[0]: round(r[1], 9) for r in source_synergy(df).collect()} == {"a": 1.0, "b": 0.0}


def test_filters(spark):
    df = spark.createDataFrame([("google_play", "in", "2026-06-30T09:00", "r1"), ("reddit", None, "2026-07-02", "r2")], "source string, country string, published_at string, last_run_id string")
    assert ReviewFilter(country="us").apply(df).count() == 1
    assert ReviewFilter(end="2026-06-30").apply(df).count() == 1
    assert ReviewFilter(only_latest=True).apply(df).count() == 0
    assert ReviewFilter(only_latest=True, run_id="r2", country="us").apply(df).count() == 1


def test_preprocess_chain(spark):
    rows = [(1, "Good app", "en", "2026-08-01"), (2, "Smart Shuffle is bad", "en", "2026-08-01"), (3, "   ", "en", "2026-08-01"), (4, "old but long enough text here", "en", "2020-01-01"), (5, "ce texte est en français seulement", "fr", "2026-08-01"), (6, "ye app bahut achha hai bhai", "so", "bad date"), (7, "old with a zone and long enough", "en", "2020-01-01T10:00:00+05:30"), (8, "old without any zone but long enough", "en", "2020-01-01T10:00:00")]
    df = spark.createDataFrame(rows, "n int, raw_text string, detected_language string, published_at string")
    got = {r["n"]: r["detected_language"] for r in preprocess(df, F.lit("2026-08-31").cast("timestamp")).collect()}
    assert got == {2: "en", 4: "en", 6: "hinglish", 8: "en"}


def test_preprocess_cleans_once(spark):
    """The condition on the length does not repeat the cleaning of a text for every keyword."""
    df = spark.createDataFrame([("the shuffle keeps playing songs", "en", None)], "raw_text string, detected_language string, published_at string")
    plan = preprocess(df, F.lit("2026-08-31").cast("timestamp"))._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and all(line.count("https?://") <= 1 for line in filters)


def test_metrics_small(spark):
    df = spark.createDataFrame([("c1", 5), ("unrelated_ads", 1), (None, None), ("c1", 4)], "cluster_id string, rating int")
    r = metrics.split_ratio(df).first()
    assert (r["total"], r["discovery"], r["discovery_percent"]) == (4, 2, 50.0)
    assert {x["voice"]: x["n"] for x in metrics.share_of_voice(df).collect()} == {"discovery": 2, "ads": 1, "bugs": 0, "widgets": 0, "general": 1}
    assert metrics.split_ratio(df.limit(0)).first()["total"] == 0


def test_routing_and_names(spark):
    p = spark.createDataFrame([("cluster_1", ["shuffle", "loop"]), ("ads_2", [])], "cluster_id string, terms array<string>")
    assert {tuple(r) for r in routing.route_fixed(p).collect()} >= {("RQ2", "cluster_1"), ("RQ5", "cluster_1"), ("RQ7", "ads_2")}
    assert {r[0] for r in p.select(routing.fallback_name(F.col("terms"))).collect()} == {"Shuffle / Loop", "General Discovery"}


def test_leader_and_search(spark):
    x = np.array([[1, 0, 0], [0.9, 0.1, 0], [0, 0, 1]], np.float32)
    leaders = Leaders(0.7, 3)
    assert [leaders.add(v) for v in x] == [0, 0, 1]
    df = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(x)], "id string, vector array<float>")
    assert {r[0]: r[1] for r in leader_follower(df, "id", "vector", ["id"]).collect()} == {"0": "cluster_1", "1": "cluster_1", "2": "cluster_2"}
    near = against(df, df.withColumnRenamed("id", "o"), "id", "vector", "o", "vector", top=2)
    assert {(r["id"], r["other"]) for r in near.collect()} >= {("0", "1"), ("1", "0")}
    assert sorted(split_two(np.vstack([x, x]) / np.linalg.norm(np.vstack([x, x]), axis=1, keepdims=True)).tolist()) in ([0, 0, 0, 0, 1, 1], [0, 0, 1, 1, 1, 1])


def test_cooccurrence_brute(spark):
    pairs = [("t1", "a"), ("t2", "a"), ("t1", "b"), ("t3", "zz"), ("t1", "a")]
    got = {(r[0], r[1]): r[2] for r in metrics.cooccurrence(spark.createDataFrame(pairs, "theme_id string, review_id string"), spark.createDataFrame([("a",), ("b",), ("a",)], "id string")).collect()}
    sets = {t: {r for q, r in pairs if q == t and r in "ab"} for t, _ in pairs}
    want = {(a, b): len(sets[a] & sets[b]) for a, b in itertools.product(sets, sets) if sets[a] & sets[b]}
    assert got == want


def test_whole_record_chain(spark):
    long = " ".join(f"Sentence number {i} says that the shuffle repeats song {i * 7} again and again." for i in range(30))
    rows = [(1, "the shuffle keeps playing the same songs every day", "en"), (2, "The shuffle keeps playing the same songs every day!", "en"), (3, long, "en"), (4, None, "en"), (5, "", None)]
    df = spark.createDataFrame([(*r, None, "clash") for r in rows], "n int, raw_text string, detected_language string, published_at string, kept string")
    got = {r["n"]: r for r in process_reviews(df, F.lit("2026-08-31").cast("timestamp"), "n", "n").collect()}
    assert set(got) == {1, 3} and len(got[3]["cleaned_text"].split()) < 60 and got[1]["translated_text"] is None
    assert process_reviews(df.limit(0), F.lit("2026-08-31").cast("timestamp"), "n", "n").count() == 0


def test_small_side_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(30, 8)), rng.normal(size=(40, 8))
    big = spark.createDataFrame([(f"a{i}", v.tolist()) for i, v in enumerate(x)], "id string, v array<double>")
    small = spark.createDataFrame([(f"b{i}", v.tolist()) for i, v in enumerate(y)], "k string, w array<double>")
    rows = lambda **o: {(r[0], r[1], round(r[2], 9)) for r in against(big, small, "id", "v", "k", "w", **o).collect()}
    whole = rows(top=3), rows(least=0.2)
    monkeypatch.setattr(search, "SMALL_SIDE", 1000)
    assert (rows(top=3), rows(least=0.2)) == whole and len(whole[0]) == 90


def test_cosines_in_tiles(spark, monkeypatch):
    """A worker never holds the cosines of a whole batch of rows."""
    most = []
    monkeypatch.setattr(search, "TILE", 8 * 40 * 3)
    x, y = np.random.default_rng(1).normal(size=(30, 8)), np.random.default_rng(2).normal(size=(40, 8))
    big = pd.DataFrame({"id": np.arange(30), "v": list(x)})
    small = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "k bigint, w array<double>")

    class Big:
        sparkSession, dtypes = spark, [("id", "bigint"), ("v", "array<double>")]
        select = lambda self, *c: self

        def mapInPandas(self, run, schema):  # noqa: N802
            for pdf in run(iter([big])):
                most.append(len(pdf))

    search._against(Big(), small, "id", "v", "k", "w", None, -2.0)
    assert most == [3 * 40] * 10


def test_nearest_in_tiles(spark, monkeypatch):
    """The nearest centroid is found a few rows at a time, and of equal ones that with the smaller key."""
    monkeypatch.setattr(search, "TILE", 8 * 3 * 2)
    big = pd.DataFrame({"id": np.arange(5), "v": [np.array([1.0, i]) for i in range(5)]})
    small = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", [0.0, 1.0])], "k string, w array<double>")
    got = []

    class Big:
        sparkSession, dtypes = spark, [("id", "bigint"), ("v", "array<double>")]
        select = lambda self, *c: self

        def mapInPandas(self, run, schema):  # noqa: N802
            got.extend(pdf["other"].tolist() for pdf in run(iter([big])))

    search._against(Big(), small, "id", "v", "k", "w", 1, None)
    assert [len(x) for x in got] == [2, 2, 1] and sum(got, [])[::2] == ["a", "c", "c"]


@pytest.mark.parametrize("part", [1 << 26, 1 << 19])
def test_nearest_of_equal_centroids(spark, monkeypatch, part):
    """Of centroids with equal values that with the smallest key is nearest, wherever they stand, in one part and in several."""
    monkeypatch.setattr(search, "SMALL_SIDE", part)
    rng = np.random.default_rng(0)
    c = rng.normal(size=(900, 384)).astype(np.float32)
    which = rng.permutation(np.repeat(np.arange(900), 3))
    v = (c[rng.integers(0, 900, 2000)] + rng.normal(size=(2000, 384))).astype(np.float32)
    small = spark.createDataFrame(pd.DataFrame({"k": np.arange(2700), "w": list(c[which])}))
    big = spark.createDataFrame(pd.DataFrame({"id": np.arange(2000), "v": list(v)})).coalesce(1)
    got = {r["id"]: r["other"] for r in against(big, small, "id", "v", "k", "w", top=1).collect()}
    cosines = (v.astype(float) @ c.T) / np.linalg.norm(c.astype(float), axis=1)
    assert got == {i: int(np.argmax(which == k)) for i, k in enumerate(cosines.argmax(1))}


def test_gazetteer(spark):
    texts = ["Flew from Navi Mumbai to goa", "Goan food in tamil nadu", "delhi", "new delhi and Punjab", None, "", "mumbai-goa"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.location_one(F.col("t")), tx.location_all(F.col("t"))).collect()
    assert [r[0] for r in got] == ["Mumbai", "Tamil Nadu", "Delhi NCR", "Delhi NCR", None, None, "Mumbai"]
    assert [r[1] for r in got] == [["Goa", "Mumbai"], ["Tamil Nadu"], ["Delhi NCR"], ["Delhi NCR", "Punjab"], [], [], ["Goa", "Mumbai"]]


def test_filtered_packages(spark):
    """Window, sources and limit before all shares; ranked texts against a plain sort; a tag that anchors give."""
    rng = np.random.default_rng(1)
    rows, vecs = [], []
    for i in range(60):
        rows.append((f"r{i:02d}", f"c{i % 2}", "the shuffle repeats songs", None, 1 + i % 5, ["a", "b", "c"][i % 3], None, f"2026-03-{1 + i % 28:02d}"))
        vecs.append((f"r{i:02d}", rng.normal(size=4).tolist()))
    reviews = spark.createDataFrame(rows, "id string, cluster_id string, raw_text string, translated_text string, rating int, source string, metadata string, published_at string")
    vectors = spark.createDataFrame(vecs, "id string, vector array<float>")
    clusters = spark.createDataFrame([("c0", [1.0, 0.0, 0.0, 0.0], 0.9, 0.1, None)], "id string, centroid array<float>, mean_similarity double, variance double, last_updated timestamp")
    anchors = spark.createDataFrame([("churn_indicator", [1.0, 0.0])], "name string, vector array<double>")
    tag_vectors = spark.createDataFrame([("r00", [1.0, 0.1]), ("r03", [0.0, 1.0])], "id string, vector array<double>")
    got = filtered_packages(reviews, vectors, clusters, start="2026-03-01", end="2026-03-20", sources=["a", "b"], limit=25, anchors=anchors, tag_vectors=tag_vectors, dimension=4).collect()
    kept = sorted([r for r in rows if r[5] in "ab" and "2026-03-01" <= r[7] <= "2026-03-20"], key=lambda r: r[0])
    kept = sorted(kept, key=lambda r: r[7], reverse=True)[:25]
    assert sum(p["size"] for p in got) == 25 and [p["opportunity_score"] for p in got] == sorted((p["opportunity_score"] for p in got), reverse=True)
    by = {p["cluster_id"]: p for p in got}
    of = dict(vecs)
    ids = [r[0] for r in kept if r[1] == "c0"]
    sim = {i: of[i][0] / np.linalg.norm(of[i]) for i in ids}
    assert by["c0"]["size"] == len(ids) and [m["id"] for m in by["c0"]["medoids"]] == sorted(ids, key=lambda i: (-sim[i], i))[:5]
    assert {m["id"] for m in by["c0"]["outliers"]} == set(sorted(ids, key=lambda i: sim[i])[:3])
    full = filtered_packages(reviews, vectors, clusters, anchors=anchors, tag_vectors=tag_vectors, dimension=4).where("cluster_id = 'c0'").first()
    assert full["tag_distribution"] == {"churn_indicator": 1}
    assert filtered_packages(reviews, vectors, clusters, start="2027-01-01", dimension=4).count() == 0
