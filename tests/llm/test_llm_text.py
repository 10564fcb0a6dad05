import random
import string

from opinara.llm import language, moderation, privacy, quality
from opinara.llm.duplicates import copy_groups, one_per_group


def _brute_groups(rows):
    import re
    import unicodedata

    def strip(s):
        s = re.sub("[︀-️⃐-⃿]", "", s.lower().upper().lower())
        return "".join(c for c in s if unicodedata.category(c)[0] in "LMN")

    def key(t):
        parts = [strip(p) for p in re.split(r"[\n\r|;]+", t) if strip(p)]
        fields = [p for p in re.split(r"[\n\r|;]+", t) if strip(p)]
        if len(parts) >= 5 and all(":" in f and strip(f.split(":", 1)[0]) and strip(f.split(":", 1)[1]) for f in fields):
            return ("list", tuple(sorted(parts)))
        return ("text", strip(t))

    plain_of_list = {(strip(s or ""), strip(t)): key(t) for _, t, s in rows if t and key(t)[0] == "list"}
    groups = {}
    for i, t, s in rows:
        if not t or sum(c.isalnum() for c in strip(t)) < 20:
            continue
        k = plain_of_list.get((strip(s or ""), strip(t)), key(t))
        groups.setdefault((strip(s) if s is not None else None, k), []).append(i)
    return {i: min(g) for g in groups.values() if len(g) > 1 for i in g}


def test_copies_match_brute_force(spark):
    random.seed(1)
    base = ["The shuffle keeps playing the same songs", "Größe der Straße ist zu klein für mich", "गाड़ी चलाते समय गाना अचानक रुक जाता है", "Plan: free; Device: tv; Since: 3 days; Region: Goa; Issue: it stops"]
    rows = []
    for i in range(80):
        t = random.choice(base)
        if ";" in t and random.random() < 0.5:
            f = t.split("; ")
            random.shuffle(f)
            t = random.choice(["; ", "\n", " | "]).join(f)
        t = random.choice([t, t.upper(), f"  ({t})!! ", t.replace(" ", "  "), t + " ❤️"])
        rows.append((i, t, random.choice(["google_play", "Google-Play", "reddit", None])))
    rows += [(100, None, "reddit"), (101, "", "reddit"), (102, "short", "reddit"), (103, "short", "reddit"), (104, base[0].replace("same songs", "songs same"), "reddit"), (105, "x" * 50_000, "a"), (106, "X" * 50_000, "a")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "landing_id bigint, raw_text string, source string, k string")
    got = {r["record_id"]: r["first_id"] for r in copy_groups(df).collect()}
    assert got == _brute_groups(rows)
    assert one_per_group(df).count() == len(rows) - sum(a != b for a, b in got.items())
    assert copy_groups(df.limit(0)).count() == 0


def test_line_labels():
    m = quality.start_model()
    prose = "I was charged twice this month and nobody answers. The new layout hides my library behind two taps."
    for text, want in [
        (prose, True), (prose.upper(), True), (prose.replace(" ", "\n", 6), True), ("", False), (None, False), ("   \n ", False),
        ("\n".join(f"- Queue ({i})" for i in range(20)), False), ("\n".join(f"reddit\twest\t{i}.5\t{i * 7}\t5%" for i in range(12)), False),
        (prose + "\n- one\n- two\n" + prose * 4, True), ("$%^ &*( )_ #@! <> " * 30, False), ("free mp3 music download best app free music hits " * 20, False),
        ("It was fine.\n" + "\n".join(f"{i}. Track {i} - Artist  3:0{i}" for i in range(9)), False), (prose * 900, True),
    ]:
        assert quality.described(*quality.coded([text]), m)[0][-1] is want, text and text[:60]


def test_line_model_against_all_paths():
    """Viterbi and expected counts of several documents at once against every path of each."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(6)
    start, trans, emit = quality.start_model()
    widths = [n for _, n, _ in quality.EMISSIONS]
    sizes = np.array([3, 1, 4])
    bins = np.stack([rng.integers(0, w, sizes.sum()) for w in widths], 1).astype(np.uint8)
    path = quality.viterbi(bins, sizes, (start, trans, emit))
    counts = quality.expected(bins, sizes, (start, trans, emit))
    want = np.zeros_like(counts)
    for a, n in zip(np.cumsum(sizes) - sizes, sizes):
        obs = quality._emission(bins[a : a + n], emit)
        every = list(itertools.product(range(4), repeat=int(n)))
        logs = np.array([start[y[0]] + sum(obs[i, k] for i, k in enumerate(y)) + sum(trans[p, q] for p, q in zip(y[:-1], y[1:])) for y in every])
        assert tuple(path[a : a + n]) == every[int(logs.argmax())]
        for y, w in zip(every, np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum()):
            want[y[0]] += w
            for p, q in zip(y[:-1], y[1:]):
                want[4 + 4 * p + q] += w
            for i, k in enumerate(y):
                for f in range(len(widths)):
                    want[20 + (f * quality._BINS + bins[a + i, f]) * 4 + k] += w
    assert np.allclose(counts, want)


def test_quality_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "The cat sat on the mat and it was good. It is fine.", "x"), (3, "The cat sat on the mat and it was good. It is fine.", "x")], "doc_id bigint, text string, n_words string")
    got = quality.text_quality(df).collect()
    assert len(got) == 4 and {r["doc_id"]: r["is_prose"] for r in got} == {1: False, 2: False, 3: True}
    assert quality.text_quality(df.limit(0)).count() == 0


SAMPLES = [("en", s) for s in ("The price went up but nothing got better", "I cannot search inside my own playlists", "Ads are twice as loud as the music", "We listen together every Sunday on the phone", "Downloads vanish whenever I restart the handset", "nobody answers and I have tried everything")] + [
    ("de", s) for s in ("Der Ton setzt beim Autofahren ständig aus", "Es wird immer wieder dasselbe Lied gespielt", "Zwischen zwei Liedern kommt immer viel Werbung", "Meine heruntergeladenen Lieder sind plötzlich weg", "und niemand antwortet auf meine Frage")
] + [("hi", s) for s in ("नया अपडेट आने के बाद आवाज़ कट जाती है", "हर गाने के बाद विज्ञापन आ जाता है")]


def test_language_segments(spark):
    m = language.train(SAMPLES)
    b = language._Batch(m)
    texts = ["The price went up and nobody answers", "Der Ton setzt aus und niemand antwortet", "I cannot search inside my own playlists. Es wird immer wieder dasselbe Lied gespielt", "", None, "10/10 !!!", 'हर गाने के बाद "Songs from the City" विज्ञापन आ जाता है', "The price went up " * 3000]
    got = [[s[2] for s in f] for f in b(texts)]
    assert got == [["en"], ["de"], ["en", "de"], [], [], [], ["hi"], ["en"]]
    for t, f in zip(texts, b(texts)):  # the quick path and the search agree
        assert [s[2] for s in language.segments(t, m, {})] == [s[2] for s in f]
    df = spark.createDataFrame([(" EN ",), ("en-US",), ("hin",), ("hinglish (so)",), ("und",), ("",), (None,)], "l string")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(language.normal_label(F.col("l"))).collect()] == ["en", "en", "hi", "hinglish", None, None, None]


EXAMPLES = [("abusive", "You are a bunch of idiots."), ("hateful", "All foreigners are vermin and should be thrown out."), ("none", "The comedy show Four Idiots in a Van is back."), ("none", "I would kill for a working queue."), ("none", "This is the best music app.")]


def _coded(examples):
    return [(k, t, tuple(moderation.plain_words(t))) for k, t in examples]


def _cosines(ix, words):
    """All cosines of a window by the plain formula."""
    import numpy as np

    full = np.zeros((len(ix.terms), len(ix.kinds)))
    for t in range(len(ix.terms)):
        for cell in range(ix.block_at[t], ix.block_at[t + 1]):
            for p in range(ix.post_at[cell], ix.post_at[cell + 1]):
                full[t, ix.example[p]] = ix.weight[p]
    w, rest = np.zeros(len(ix.terms)), 0
    for t in words:
        if t in ix.terms:
            w[ix.terms[t]] += ix.idf[ix.terms[t]]
        else:
            rest += 1
    return (w / max(1e-9, float(np.sqrt(w @ w + rest * ix.unseen**2)))) @ full


def test_moderation_cosines_are_exact():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)]
    examples = [(rng.choice(["none", "abusive", "sexual"]), f"t{i}", tuple(rng.choices(vocabulary, k=rng.randint(1, 9)))) for i in range(300)]
    ix = moderation.build(examples, {w: rng.randint(0, 90) for w in vocabulary}, 100)
    found = [rng.choices(vocabulary + ["x", "y"], k=rng.randint(1, 12)) for _ in range(200)]
    window, example, sim = ix.neighbours(found)
    got = {(int(w), int(e)): s for w, e, s in zip(window, example, sim)}
    bad = [k in moderation.KINDS for k in ix.kinds]
    for i, words in enumerate(found):
        sims = _cosines(ix, words)
        want = {(i, j): s for j, s in enumerate(sims) if s >= moderation.MIN_SIMILARITY + 1e-9}
        if any(bad[j] for _, j in want):
            mine = {k: s for k, s in got.items() if k[0] == i}
            assert all(abs(mine[k] - s) < 1e-9 for k, s in want.items()) and len(mine) - len(want) in (0, 1)


def test_moderation_scores():
    ix = moderation.build(_coded(EXAMPLES), {"the": 50, "a": 60, "of": 40, "are": 30, "is": 50}, 100)
    texts = ["You are a bunch of idiots", "you are a bunch of i.d.i.o.t.s!", "You are a bunch of id*ots", "The comedy show Four Idiots in a Van is back.", "nice music", "", None, "word " * 5000 + "you are a bunch of idiots"]
    got = ix.score([moderation.read(t) for t in texts])
    share = [moderation.Index.votes(ix, moderation.windows(moderation.read(t)))[0].max(initial=0) for t in texts]
    assert min(share[0], share[1], share[2], share[7]) > 0.8 and max(share[3:7]) < 0.5
    assert got[0][1:3] == ("abusive", ["You are a bunch of idiots."]) and got[4] == got[5] == got[6] == (0.0, None, [], 0.0)
    assert moderation.build([], {}, 0).score(["x"]) == [(0.0, None, [], 0.0)]


def test_moderation_of_a_corpus(spark):
    """Every term of the index has its corpus frequency, also a word that only found sentences use."""
    reviews = [f"version {i % 7} plays the same songs" for i in range(300)] + ["You are a bunch of idiots"] * 3 + ["You are a bunch of dorknoses"] * 4 + ["The people in charge are dorknoses", "You are a bunch of idiots in version 8", None, "", "x" * 100_000]
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(reviews)], "landing_id bigint, raw_text string, score string")
    given = spark.createDataFrame(EXAMPLES + [("none", "plays the same songs"), ("abusive", "You are a bunch of liars."), (None, "x"), ("none", None)], "kind string, sample_text string")
    got = {r["landing_id"]: r for r in moderation.moderate(rows, given).collect()}
    assert len(got) == len(reviews) and all(got[i]["score"] == 0 for i, t in enumerate(reviews) if not t or "plays" in t)
    assert all(got[i]["score"] >= moderation.CASE for i, t in enumerate(reviews) if t and "bunch" in t)
    assert moderation.moderate(rows.limit(0), given).count() == 0
    assert moderation.moderate(rows, given.limit(0)).where("score > 0").count() == 0


def test_details():
    names = {"yalina": 0, "vennick": 1, "tarvik": 0, "dornwick": 2}
    random.seed(2)
    plain = ["the price went up but nothing got better", "i was charged twice this month", "the queue is gone again since the update"]
    train = [f"{random.choice(plain)}. My name is {random.choice(['Yalina', 'Tarvik'])} {random.choice(['Vennick', 'Vennick', 'Quorlan'])}." for _ in range(60)] + [f"{p}. version 8.{i}.{i}4567 here." for i in range(60) for p in plain]
    for i in range(40):
        train += [f"my mail is u{i}.x@mail.example.com", f"write to ab{i} dot cd at post dot test", f"call +44 7700 900 {100 + i} now", f"my SSN 90{i % 10}-65-4{100 + i}", f"I live at {i + 1} Mill Road, Dornwick 00{2100 + i}."]
    f = privacy.Finder(privacy.train(train, names))
    texts = ["my mail is a.b+c@mail.example.com", "write to yalina dot vennick at post dot test", "call +44 7700 900 775 now", "my SSN 908-65-4696", "I live at 12 Mill Road, Dornwick 002137.", "My name is Yalina Vennick.", "version 8.546.995745 here", "", None, "the price went up " * 4000]
    kinds = [{privacy.LABELS[k] for *_, k in r} for r in f(texts)]
    assert kinds == [{"email"}, {"email"}, {"phone"}, {"id_number"}, {"address"}, {"person_name"}, set(), set(), set(), set()]


def _random_model(rng, skip):
    return privacy.Model({}, {}, *[None] * 5, rng.normal(size=(6, 6)), skip)


def test_labels_are_the_best_of_all():
    """Decoding of many chains at once, with pruning, against all labellings of each chain."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    for trial in range(30):
        m = _random_model(rng, 0.0)
        sizes = rng.integers(1, 5, 6)
        starts = np.cumsum(sizes) - sizes
        unary = rng.normal(size=(sizes.sum(), 6)) * 2
        unary[:, 0] += rng.choice([0.0, 3.0, 9.0], sizes.sum())
        got = privacy.decode(unary, m, starts, sizes, lambda d: [], np.zeros(sizes.sum(), bool))
        for a, n in zip(starts, sizes):
            value = lambda y: sum(unary[a + i, k] for i, k in enumerate(y)) + sum(m.trans[p, q] for p, q in zip(y[:-1], y[1:]))
            assert abs(value(got[a : a + n]) - max(value(y) for y in itertools.product(range(6), repeat=int(n)))) < 1e-9


def test_marginals_against_all_labellings():
    import itertools

    import numpy as np

    rng = np.random.default_rng(5)
    unary, trans = rng.normal(size=(7, 6)), rng.normal(size=(6, 6))
    starts, sizes = np.array([0, 4]), np.array([4, 3])
    got, pair = privacy._marginals(unary, trans, privacy.by_position(starts, sizes))
    want, pairs = np.zeros((7, 6)), np.zeros((6, 6))
    for a, n in zip(starts, sizes):
        every = list(itertools.product(range(6), repeat=int(n)))
        w = np.exp([sum(unary[a + i, k] for i, k in enumerate(y)) + sum(trans[p, q] for p, q in zip(y[:-1], y[1:])) for y in every])
        for y, x in zip(every, w / w.sum()):
            for i, k in enumerate(y):
                want[a + i, k] += x
            for p, q in zip(y[:-1], y[1:]):
                pairs[p, q] += x
    assert np.allclose(got, want) and np.allclose(pair, pairs)


def test_skip_edges_carry_labels():
    import numpy as np

    unary = np.zeros((9, 6))
    unary[:, 0] = 8.0
    unary[1, privacy.NAME] = 16.0
    unary[7, privacy.NAME] = 7.5
    m = privacy.Model({}, {}, *[None] * 5, np.zeros((6, 6)), 1.5)
    every = np.ones(9, bool)
    assert privacy.decode(unary, m, np.array([0]), np.array([9]), lambda d: [], every)[7] == 0
    assert privacy.decode(unary, m, np.array([0]), np.array([9]), lambda d: [(1, 7)], every)[7] == privacy.NAME
    assert privacy.links(["Priya", "said", "that", "Priya’s", "PRÍYA"], [0, 50, 50, 6, 7], []) == [(0, 3)]


def test_details_beyond_the_patterns():
    """A number in a shape no pattern accepts is found by its characters and context."""
    rng = random.Random(8)
    plain = ["the price went up but nothing got better", "i was charged twice this month", "the queue is gone again since the update"]
    train = [f"{rng.choice(plain)}. version 8.{i}.{i}4567 here." for i in range(200)]
    for i in range(200):
        train += [f"please call {100 + i} 555 {1000 + 7 * i} now", f"please call +44 7700 900 {100 + i} now"]
    f = privacy.Finder(privacy.train(train, {}))
    text = "please call 44 555 900 now"
    assert not [k for *_, k in privacy.spans(text) if k == privacy.PHONE] and {privacy.LABELS[k] for *_, k in f([text])[0]} == {"phone"}


def test_names_in_letters():
    assert all(privacy.spans("".join(random.choices(string.printable, k=200))) is not None for _ in range(50))


def test_shape_checks_lose_nothing():
    p = privacy

    def ungated(text):
        found = []
        for pattern, flag in ((p._EMAIL, p.EMAIL), (p._HANDLE, p.QUOTED), (p._ADDRESS, p.ADDRESS), (p._ID, p.ID), (p._PHONE, p.PHONE), (p._QUOTE, p.QUOTED)):
            for m in pattern.finditer(text):
                if all(m.end() <= a or b <= m.start() for a, b, _ in found):
                    found.append((*m.span(), flag))
        return found

    texts = ["five five five oh five five", "oh oh oh oh oh oh", "nİne nine nine nine nine nine", "name\tat\tmail dot com", "12 Hill\u00a0st", "12 Hill ſtreet", "flat 4 Hill\nrd", "ABCDE1234F", "AB-12-123456", "x.555 123 4567"]
    for blank in ("", " ", "\t", "\n", "\u00a0", "\u2009"):
        texts += [f"mail name{blank}{a}{blank}at{blank}{b}{blank}mail.com now" for a, b in ("()", "[]", "{}", "{]")]
    for sep in (" ", "-", ".", "\t", "\n", "\u00a0", "\u2009"):
        texts += [f"call {sep.join(d)} now" for d in (["98765", "43210"], ["555", "123", "4567"], ["01234", "567890"], ["04321", "123", "456"], ["+91", "98765", "43210"], ["123", "45", "6789"], ["1234", "5678", "9012"], ["(020)", "123", "4567"])]
    for t in texts:
        assert sorted(p.spans(t)) == sorted(ungated(t)), t
    assert all(p.spans(t) for t in ("name{at}mail.com", "98765\u00a043210", "555\u00a0123\u00a04567", texts[0]))
