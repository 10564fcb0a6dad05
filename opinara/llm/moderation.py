"""Scores for abusive, hateful or sexual content by nearest labelled examples.

Texts are cut into windows of at most ``WINDOW`` words.  A window's neighbours are the examples with a TF-IDF cosine of
at least ``MIN_SIMILARITY``, at most ``NEIGHBOURS`` of them; each votes with the cube of its similarity.  The share of
offending votes is turned into a probability by a logistic curve fitted on the labelled examples, each scored without
itself and its near copies (cosine of ``HELD_OUT`` or more).  A text has the score of its worst window, with the
examples that gave it as evidence.

Words are read through common disguises (repeated letters, digits and signs for letters, spaced or starred letters).
Every text is read so once, into a table of words; the document frequencies are counted on that table, so they cover
all texts and every term of the index, whether it came from a labelled or from a found example.  Words used for
offence weigh up to ``BOOST`` times as much: at first those that only offending examples use, then by the share of
their uses in the corpus that lies in offending sentences (none up to ``BOOST_FROM``, all from ``BOOST_TO`` on).  A
capitalised word inside a sentence in ordinary case is a name or title and is left out unless offending examples use it.

The labelled examples (at most ``EXAMPLE_LIMIT``, with the general ones below) are extended in ``SELF_ROUNDS`` rounds by sentences of all texts:
those that score at least ``SELF_SCORE`` with a neighbour of ``SELF_NEAREST`` join their kind, those that score at most
``SELF_LOW`` and hold no word of which more than ``RISKY`` of the uses are offending join the harmless ones, at most
``SELF_LIMIT`` different ones of each, chosen by hash.  Words are counted over all sentences found.

The examples lie in a block-max inverted index: postings by term, cut into blocks of ``BLOCK`` examples sorted by kind,
with the largest weight of the term in each block.  A window first sums the largest weights over the offending
examples, then those of each block; only blocks whose sum reaches ``MIN_SIMILARITY`` have their postings read.  Both
sums are upper bounds, so the cosines are exact.

Defined results: null and blank texts score 0 without evidence; long texts are read whole; equal texts get equal
scores; an empty example table gives score 0 for every text; columns beside the named ones are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.runtime import spread, written

WINDOW, STRIDE = 12, 4
NEIGHBOURS = 8
BLOCK = 16
MIN_SIMILARITY = 0.35
PRIOR = 0.10
CASE = 0.5  # probability from which a text is a case
HELD_OUT = 0.8
EXAMPLE_LIMIT = 20_000
SELF_SCORE, SELF_NEAREST, SELF_LOW, SELF_ROUNDS, SELF_LIMIT = 0.8, 0.7, 0.15, 2, 3_000
BOOST, BOOST_FROM, BOOST_TO, RISKY = 1.7, 0.2, 0.4, 0.3
UNSEEN = 0.6
CHUNK = 4096
KINDS = ("abusive", "hateful", "sexual")
Example = tuple[str, str, tuple[str, ...]]  # kind, text, plain words
# Common insults and threats of the languages the engine reads, beside the labelled table, which may lack
# some languages altogether.
GENERAL = {
    "en": ("Shut up, you liar.", "You are ugly and stupid.", "Go to hell and rot there.", "Crawl back under your rock, you scum.", "Your mother should be ashamed of you.", "I will kill you.", "You are all lying crooks.", "You brainless losers."),
    "es": ("Eres un hijo de puta.", "Cállate, imbécil.", "Sois todos unos idiotas.", "Vete a la mierda, cabrón.", "Ojalá te mueras, inútil."),
    "fr": ("Ferme ta gueule, connard.", "Va te faire foutre, espèce d'abruti.", "Vous êtes tous des imbéciles.", "Crève, sale ordure."),
    "de": ("Halt die Fresse, du Arschloch.", "Ihr seid alle Idioten.", "Verpiss dich, du dumme Sau.", "Verrecke, du Dreckskerl."),
    "pt": ("Vocês são todos uns idiotas.", "Vão para o inferno, seus imbecis.", "Cala a boca, filho da puta.", "Vai à merda, bando de inúteis.", "Morre, seu lixo."),
    "id": ("Kalian semua goblok.", "Dasar tolol dan bodoh.", "Bajingan, bangsat, anjing kamu.", "Tutup mulutmu, otak kosong.", "Mati saja kau, brengsek."),
    "hi": ("तुम सब बेवकूफ हो", "कमीने, हरामी, कुत्ते", "साले गधे, निकम्मे", "भाड़ में जाओ, मूर्ख", "मर जाओ, नालायक"),
    "hinglish": ("Tum sab gadhe ho.", "Kamine, harami, kutte.", "Bhaad mein jao, bewakoof.", "Mar jao, nalayak."),
    "bn": ("তোরা সবাই গাধা", "হারামজাদা, কুত্তার বাচ্চা", "জাহান্নামে যা, শয়তান", "তোমরা বোকা আর অপদার্থ", "মর তুই, বেয়াদব"),
    "ta": ("நீங்கள் எல்லாரும் முட்டாள்கள்", "நாயே, பொறுக்கி", "செத்துப் போ, சனியனே", "மடையர்கள், உதவாக்கரை", "வாயை மூடு, அறிவில்லாதவனே"),
}

_MARKS = "̀-ͯऀ-ॣঁ-ৣஂ-ௗ"
_WORD = re.compile(rf"[^\W\d_][\w{_MARKS}]*")
_TOKEN = re.compile(rf"[^\W\d_](?:[\w{_MARKS}*$@!]*[\w{_MARKS}*$])?|[\w*$@]*[*$@][\w*$@]+")
_BREAK = re.compile(r"[.!?]+[\"”’»)\]]*(?=\s|$)|[।॥\n\r;|]+|\.{2,}")
_DOTTED = re.compile(r"\b(?:[^\W\d_][.\-_*]){3,}[^\W\d_]\b|\b(?:[^\W\d_] ){4,}[^\W\d_]\b")
_REPEATED = re.compile(r"(.)\1{2,}")
_SIGNS = str.maketrans("013457@$!", "oleastasi")


class _Plain(dict):
    """Token to lower-case word read through disguises; filled on demand."""

    def __missing__(self, token: str) -> str:
        if len(self) > 400_000:
            self.clear()
        w = token.lower()
        if not w.isalpha() and not w.isdigit():
            w = w.translate(_SIGNS)
        self[token] = w = _REPEATED.sub(r"\1", w)
        return w


_PLAIN = _Plain()


def plain_words(piece: str, names: frozenset[str] | None = None) -> list[str]:
    """Lower-case words of a sentence, read through disguises; ``*`` stays as a wildcard."""
    if _DOTTED.search(piece):
        piece = _DOTTED.sub(lambda m: re.sub(r"[ .\-_*]", "", m[0]), piece)
    found = _TOKEN.findall(piece)
    if names is not None and len(found) > 1 and not piece.islower():
        large = [w for w in found if w[0].isupper()]
        if len(large) > found[0][0].isupper() and 2 * sum(w[0].islower() for w in found) >= len(found):
            found = found[:1] + [w for w in found[1:] if not w[0].isupper() or w.lower() in names]
    return [_PLAIN[w] for w in found]


def read(text: str | None, names: frozenset[str] | None = None) -> str:
    """The sentences of a text as lines of plain words."""
    return "\n".join(" ".join(ws) for piece in _BREAK.split(text or "") if piece and (ws := plain_words(piece, names)))


def windows(plain: str) -> list[list[str]]:
    """Windows of a text as :func:`read` gives it: sentences, the long ones as overlapping windows."""
    out = []
    for line in plain.split("\n"):
        words = line.split(" ")
        if len(words) <= WINDOW + STRIDE:
            if words[0]:
                out.append(words)
        else:
            out += [words[i : i + WINDOW] for i in range(0, len(words) - WINDOW + STRIDE, STRIDE)]
    return out


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All positions of the ranges, in order."""
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(size)
    return np.arange(total) + np.repeat(start - np.concatenate([[0], ends[:-1]]), size)


@dataclass
class Index:
    terms: dict[str, int]
    idf: np.ndarray
    unseen: float
    largest: np.ndarray  # of every term: its largest weight in an offending example
    block_at: np.ndarray  # of every term: where its blocks begin
    block: np.ndarray  # the blocks of the terms, with the largest weight in each and where its postings begin
    block_top: np.ndarray
    post_at: np.ndarray
    example: np.ndarray  # postings
    weight: np.ndarray
    kinds: list[str]
    texts: list[str]
    starred: dict[str, int]
    slope: float = 1.0
    offset: float = 0.0

    def term(self, word: str) -> int | None:
        """Number of a word; a word with stars stands for the one term that fits it."""
        k = self.terms.get(word)
        if k is None and "*" in word:
            k = self.starred.get(word)
            if k is None:
                fit = re.compile(re.sub(r"\*+", lambda m: rf"\w{{1,{len(m[0]) + 1}}}", re.escape(word).replace(r"\*", "*")) + "$")
                k = self.starred[word] = max((i for t, i in self.terms.items() if fit.match(t)), key=lambda i: self.idf[i], default=-1)
            return k if k >= 0 else None
        return k

    def neighbours(self, found: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, example, cosine) of all pairs of at least ``MIN_SIMILARITY``, for windows that can reach it with an
        offending example."""
        parts = [self._neighbours(found[a : a + CHUNK], a) for a in range(0, len(found), CHUNK)]
        return tuple(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t) for k, t in enumerate((np.int64, np.int64, np.float64)))  # type: ignore[return-value]

    def _neighbours(self, found: list[list[str]], shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        ids, times, sizes, owner, others = [], [], [], [], []
        get = self.terms.get
        for i, words in enumerate(found):
            known = [k for w in words if (k := get(w)) is not None]
            if len(known) < len(words):
                known += [k for w in words if "*" in w and w not in self.terms and (k := self.term(w)) is not None]
            if not known:
                continue
            distinct = set(known)
            ids += distinct
            times += [1] * len(known) if len(distinct) == len(known) else [known.count(k) for k in distinct]
            sizes.append(len(distinct))
            owner.append(i)
            others.append(len(words) - len(known))
        if not ids or not self.kinds:
            return none
        ids, size = np.array(ids), np.array(sizes)
        starts = np.cumsum(size) - size
        w = np.array(times) * self.idf[ids]
        norm = np.sqrt(np.add.reduceat(w * w, starts) + np.array(others) * self.unseen**2)
        w = w / np.repeat(norm, size)
        hot = np.flatnonzero(np.add.reduceat(w * self.largest[ids], starts) >= MIN_SIMILARITY)
        if not len(hot):
            return none
        rows = _ranges(starts[hot], size[hot])
        ids, w, at = ids[rows], w[rows], np.repeat(np.arange(len(hot)), size[hot])
        # the bound of every block
        n_blocks = -(-len(self.kinds) // BLOCK)
        count = self.block_at[ids + 1] - self.block_at[ids]
        cell = _ranges(self.block_at[ids], count)
        at, w = np.repeat(at, count), np.repeat(w, count)
        key = at * n_blocks + self.block[cell]
        bound = np.bincount(key, w * self.block_top[cell], len(hot) * n_blocks)
        live = bound >= MIN_SIMILARITY - 1e-9
        place = np.cumsum(live) - 1
        take = live[key]
        cell, w, key = cell[take], w[take], place[key[take]]
        # postings of the blocks that can reach the wanted cosine
        count = self.post_at[cell + 1] - self.post_at[cell]
        post = _ranges(self.post_at[cell], count)
        slot = np.repeat(key, count) * BLOCK + self.example[post] % BLOCK
        sims = np.bincount(slot, np.repeat(w, count) * self.weight[post], int(live.sum()) * BLOCK)
        near = np.flatnonzero(sims >= MIN_SIMILARITY)
        pair = np.flatnonzero(live)[near // BLOCK]
        window = np.array(owner)[hot[pair // n_blocks]]
        return window + shift, (pair % n_blocks) * BLOCK + near % BLOCK, sims[near]

    def votes(self, found: list[list[str]], most: float = 2.0, skip: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """(score, nearest cosine, kind, three best offending examples) of every window; the share of offending votes
        is the score before calibration.  Neighbours above ``most`` do not vote."""
        n = len(found)
        share, nearest, kind, best = np.zeros(n), np.zeros(n), np.full(n, -1), np.full((n, 3), -1)
        window, example, sim = self.neighbours(found)
        if most < 2:
            ok = sim < most
            window, example, sim = window[ok], example[ok], sim[ok]
        if not len(window):
            return share, nearest, kind, best
        number = np.array([KINDS.index(k) if k in KINDS else -1 for k in self.kinds])
        order = np.lexsort((example, -sim, window))
        window, example, sim = window[order], example[order], sim[order]
        first = np.concatenate([[True], window[1:] != window[:-1]])
        rank = np.arange(len(window)) - np.maximum.accumulate(np.where(first, np.arange(len(window)), 0))
        ok = rank < NEIGHBOURS
        window, example, sim = window[ok], example[ok], sim[ok]
        vote, of = sim**3, number[example]
        total = np.bincount(window, vote, n)
        per = np.stack([np.bincount(window, vote * (of == k), n) for k in range(len(KINDS))], 1)
        bad = per.sum(1)
        share = bad / (total + PRIOR)
        kind = np.where(bad > 0, per.argmax(1), -1)
        window, example, sim = window[of >= 0], example[of >= 0], sim[of >= 0]
        if len(window):
            first = np.concatenate([[True], window[1:] != window[:-1]])
            rank = np.arange(len(window)) - np.maximum.accumulate(np.where(first, np.arange(len(window)), 0))
            nearest[window[first]] = sim[first]
            ok = rank < 3
            best[window[ok], rank[ok]] = example[ok]
        return share, nearest, kind, best

    def probability(self, share: np.ndarray) -> np.ndarray:
        return np.where(share > 0, 1 / (1 + np.exp(-np.clip(self.slope * share + self.offset, -30, 30))), 0.0)

    def score(self, plain: list[str | None]) -> list[tuple[float, str | None, list[str], float]]:
        """(score, kind, evidence, nearest cosine) of texts as :func:`read` gives them; an equal line is scored once."""
        out: list[tuple[float, str | None, list[str], float]] = [(0.0, None, [], 0.0)] * len(plain)
        lines: dict[str, list[int]] = {}
        for i, t in enumerate(plain):
            if t:
                for line in t.split("\n"):
                    lines.setdefault(line, []).append(i)
        found, owner = [], []
        for line, at in lines.items():
            ws = windows(line)
            found += ws
            owner += [at] * len(ws)
        share, nearest, kind, best = self.votes(found)
        hits = np.flatnonzero(kind >= 0)
        for j in hits[np.lexsort((nearest[hits], share[hits]))]:
            x = (float(self.probability(share[j])), KINDS[kind[j]], [self.texts[x] for x in best[j] if x >= 0], float(nearest[j]))
            for i in owner[j]:
                out[i] = x
        return out


def build(examples: list[Example], frequency: dict[str, int], n_docs: int, boost: dict[str, float] | None = None) -> Index:
    """The index of the different examples (kind, text, plain words).

    ``frequency`` counts the texts of the corpus with a term; ``common`` are words that are mostly used harmlessly.
    """
    distinct = sorted({(k not in KINDS, k, ws): t for k, t, ws in reversed(examples) if ws}.items())
    kinds, texts, words = [k for (_, k, _), _ in distinct], [t for _, t in distinct], [ws for (*_, ws), _ in distinct]
    terms = {w: i for i, w in enumerate(sorted({w for ws in words for w in ws if "*" not in w}))}
    harmless = {w for k, ws in zip(kinds, words) if k not in KINDS for w in ws}
    boost = boost or {}
    n = max(1, n_docs)
    idf = np.array([math.log(1 + n / (1 + frequency.get(w, 0))) * BOOST ** boost.get(w, 0.0 if w in harmless else 1.0) for w in terms])
    term, example, weight = [], [], []
    for j, ws in enumerate(words):
        mine = [terms[w] for w in ws if w in terms]
        ids = sorted(set(mine))
        x = np.array([mine.count(i) for i in ids]) * idf[ids] if ids else np.zeros(0)
        term += ids
        example += [j] * len(ids)
        weight += (x / max(1e-9, float(np.sqrt((x * x).sum())))).tolist()
    term, example, weight = np.array(term, np.int64), np.array(example, np.int64), np.array(weight)
    order = np.lexsort((example, term))
    term, example, weight = term[order], example[order], weight[order]
    bad = np.array([k in KINDS for k in kinds], bool)
    largest = np.zeros(len(terms) + 1)
    np.maximum.at(largest, term[bad[example]] if len(term) else term, weight[bad[example]] if len(term) else weight)
    cell = term * (len(kinds) // BLOCK + 1) + example // BLOCK
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
    top = np.maximum.reduceat(weight, first) if len(first) else np.zeros(0)
    block_at = np.searchsorted(term[first], np.arange(len(terms) + 1)) if len(first) else np.zeros(len(terms) + 1, np.int64)
    return Index(terms, idf, UNSEEN * float(np.median(idf)) if len(idf) else 1.0, largest[:-1], block_at, example[first] // BLOCK, top, np.concatenate([first, [len(term)]]).astype(np.int64), example, weight, kinds, texts, {})


def calibrate(index: Index, labelled: list[Example]) -> Index:
    """Fit the logistic curve on the different labelled examples, held out with their near copies."""
    cases = sorted({(k in KINDS, ws) for k, _, ws in labelled if ws})
    y = np.array([float(b) for b, _ in cases])
    if not 0 < y.sum() < len(y):
        return index
    x = index.votes([list(ws) for _, ws in cases], HELD_OUT)[0]
    up, down = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    weight = 1 / len(y)
    a, b = 4.0, -2.0
    for _ in range(100):  # Newton steps with a weak pull of the slope to its start
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        r, h = weight * (p - target), weight * p * (1 - p) + 1e-9
        ga, gb = (r * x).sum() + 1e-3 * (a - 4.0), r.sum()
        haa, hab, hbb = (h * x * x).sum() + 1e-3, (h * x).sum(), h.sum()
        det = haa * hbb - hab * hab
        if det < 1e-14:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - np.clip(da, -2, 2), b - np.clip(db, -2, 2)
        if abs(da) + abs(db) < 1e-8:
            break
    index.slope, index.offset = float(a), float(b)
    return index


SENTENCES = "sentence string, n bigint"


def offending_sentences(plain: DataFrame, index: Index) -> DataFrame:
    """(sentence, n): the different sentences of 3 to ``WINDOW`` words with an offending neighbour, and their number."""
    shared = plain.sparkSession.sparkContext.broadcast(index)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            lines = Counter(line for t in pdf["plain"] for line in t.split("\n") if 2 <= line.count(" ") < WINDOW)
            kept = list(lines)
            share = shared.value.votes([line.split(" ") for line in kept])[0]
            kept = [line for line, s in zip(kept, share) if s > 0]
            if kept:
                yield pd.DataFrame({"sentence": kept, "n": [lines[line] for line in kept]})

    return plain.select("plain").mapInPandas(run, SENTENCES).groupBy("sentence").agg(F.sum("n").alias("n"))


def extended(found: DataFrame, index: Index, labelled: list[Example], lookup: Callable[[set[str]], dict[str, int]], n_docs: int) -> Index:
    """The index after one round over the sentences found; everything collected is bounded by ``SELF_LIMIT`` sentences
    and the vocabulary of the examples."""
    spark = found.sparkSession
    shared = spark.sparkContext.broadcast(index)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            share, nearest, kind, _ = shared.value.votes([t.split(" ") for t in pdf["sentence"]])
            yield pdf.assign(share=share, nearest=nearest, kind=kind)

    scored = written(found.mapInPandas(run, SENTENCES + ", share double, nearest double, kind int"), "moderation-round")
    bad = scored.where((F.col("share") >= SELF_SCORE) & (F.col("nearest") >= SELF_NEAREST))
    take = lambda df: df.where(~F.col("sentence").contains("*")).orderBy(F.xxhash64("sentence"), "sentence").limit(SELF_LIMIT).collect()
    more = [(KINDS[r["kind"]], r["sentence"], tuple(r["sentence"].split(" "))) for r in take(bad)]
    frequency = lookup({w for *_, ws in labelled + more for w in ws})
    words = lambda df: df.select("sentence", "n", F.explode(F.array_distinct(F.split("sentence", " "))).alias("w"))
    known = spark.createDataFrame([(w,) for w in sorted(frequency)], "w string")
    uses = {r["w"]: r["n"] for r in words(bad).join(F.broadcast(known), "w").groupBy("w").agg(F.sum("n").alias("n")).collect()}
    share = {w: uses.get(w, 0) / max(1, n) for w, n in frequency.items()}
    boost = {w: min(1.0, max(0.0, (s - BOOST_FROM) / (BOOST_TO - BOOST_FROM))) for w, s in share.items()}
    risky = spark.createDataFrame([(w,) for w, s in sorted(share.items()) if s > RISKY], "w string")
    low = scored.where(F.col("share") < SELF_LOW)
    good = [("none", r["sentence"], tuple(r["sentence"].split(" "))) for r in take(low.join(words(low).join(F.broadcast(risky), "w").select("sentence"), "sentence", "left_anti"))]
    frequency |= lookup({w for *_, ws in good for w in ws} - set(frequency))
    return calibrate(build(labelled + more + good, frequency, n_docs, boost), labelled)


def moderate(rows: DataFrame, examples: DataFrame, id_col: str = "landing_id", text_col: str = "raw_text") -> DataFrame:
    """One row (id, score, kind, evidence) per text."""
    spark = rows.sparkSession
    given = examples.select("kind", "sample_text").distinct().orderBy(F.xxhash64("kind", "sample_text"), "kind", "sample_text").limit(EXAMPLE_LIMIT).collect()
    labelled = [(r[0], r[1], tuple(ws)) for r in given if r[0] and r[1] and (ws := plain_words(r[1]))]
    if any(k in KINDS for k, *_ in labelled):
        labelled += [("abusive", t, tuple(plain_words(t))) for texts in GENERAL.values() for t in texts]
    names = frozenset(w.lower() for k, t, _ in labelled if k in KINDS and not t.istitle() for w in _WORD.findall(t)[1:] if w[:1].isupper())
    kind = dict(rows.dtypes)[id_col]

    def words(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({id_col: pdf[id_col], "plain": [read(t, names) for t in pdf[text_col]]})

    plain = written(spread(rows.select(id_col, text_col), id_col).mapInPandas(words, f"{id_col} {kind}, plain string"), "moderation-words")
    n = plain.count()
    counts = plain.select(F.explode(F.array_distinct(F.split("plain", "[ \n]"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts, "moderation-frequencies")

    def lookup(vocabulary: set[str]) -> dict[str, int]:
        wanted = spark.createDataFrame([(w,) for w in sorted(vocabulary)], "w string")
        got = {r["w"]: r["n"] for r in counts.join(F.broadcast(wanted), "w").collect()}
        return {w: got.get(w, 0) for w in vocabulary}

    index = calibrate(build(labelled, lookup({w for *_, ws in labelled for w in ws}), n), labelled)
    if any(k in KINDS for k in index.kinds):
        found = written(offending_sentences(plain, index), "moderation-sentences")
        for _ in range(SELF_ROUNDS):
            index = extended(found, index, labelled, lookup, n)
    shared = spark.sparkContext.broadcast(index)  # bounded by EXAMPLE_LIMIT and SELF_LIMIT examples, as sparse postings

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            got = shared.value.score(pdf["plain"].tolist())
            yield pd.DataFrame({id_col: pdf[id_col], "score": [f[0] for f in got], "kind": [f[1] for f in got], "evidence": [f[2] for f in got]})

    return plain.mapInPandas(run, f"{id_col} {kind}, score double, kind string, evidence array<string>")
