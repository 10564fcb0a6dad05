"""Language of a text and of its segments by word-first backoff.

Known words are scored by their log frequency in each language; a word never seen falls back to the longest character
n-grams seen (five letters down to one), each step back costing a fixed penalty.  A Viterbi pass over the words of a
text with a cost for every change of language parts mixed texts into segments.  Words that say nothing about the
language of a sentence are left out before: quoted titles, e-mail addresses, handles, numbers, and capitalised runs
inside another script.

The model is trained on the labelled sample table (bounded: at most ``SAMPLE_LIMIT`` rows) and then once more with
those of at most ``SELF_SAMPLE`` texts whose own label agrees with a confident first reading.

Defined results: null and blank texts, and texts without a single letter, have language ``und`` with confidence 0 and
no segments; long texts are read whole; equal rows give equal results; columns beside the named ones are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.runtime import bounded_sample, spread

SAMPLE_LIMIT = 20_000
SELF_SAMPLE = 6_000
LANGUAGES = ("en", "hi", "hinglish", "es", "de", "fr", "pt", "id", "bn", "ta")
SWITCH_COST = 9.0
MIN_SEGMENT_WORDS = 4
MIN_MARGIN = 6.0
NGRAMS = (5, 4, 3, 2, 1)
BACKOFF = 0.7
FLOOR = -13.0

# Other spellings of a label.
LABEL_SPELLINGS = {
    "en": "en eng english", "hi": "hi hin hindi", "hinglish": "hinglish hi_latn hi-latn", "es": "es spa spanish", "de": "de deu ger german",
    "fr": "fr fra fre french", "pt": "pt por portuguese", "id": "id ind indonesian in", "bn": "bn ben bengali bangla", "ta": "ta tam tamil",
}
NO_LABEL = ("", "und", "unknown", "none", "null")

_QUOTED = re.compile(r"[\"“”„«»][^\"“”„«»\n]{1,80}[\"“”„«»]|(?<!\w)['‘][^'‘’\n]{3,80}['’](?!\w)")
_NOISE = re.compile(r"\S*[@#/\\\d_]\S*|\b\S+\.(?:com|org|net|test|invalid|example)\b")
# letters with the combining marks of the scripts at hand (Latin, Devanagari, Bengali, Tamil)
_WORD = re.compile(r"[^\W\d_][\w\u0300-\u036F\u0900-\u0963\u0981-\u09E3\u0B82-\u0BD7]*(?:['’][^\W\d_][\w\u0300-\u036F]*)*")
_SPELLED = frozenset("zero oh one two three four five six seven eight nine double at dot".split())  # fixed values


def normal_label(c: Column) -> Column:
    """The language code behind a label in another case, region, three letters or with a suffix in brackets; null if none."""
    base = F.lower(F.trim(F.regexp_replace(c, r"\(.*\)", "")))
    base = F.when(base.rlike(r"^hi[-_]latn"), F.lit("hinglish")).otherwise(F.regexp_replace(base, r"[-_].*$", ""))
    known = F.create_map(*[F.lit(x) for lang, names in LABEL_SPELLINGS.items() for n in names.split() for x in (n, lang)])
    return F.when(base.isin(*NO_LABEL), F.lit(None)).otherwise(F.coalesce(F.try_element_at(known, base), base))


@dataclass
class Model:
    words: dict[str, np.ndarray]
    grams: dict[str, np.ndarray]

    def score(self, word: str) -> tuple[np.ndarray, bool]:
        """Log score of a word in each language, and whether it is a known word."""
        known = self.words.get(word)
        if known is not None:
            return known, True
        padded, penalty = f"^{word}$", 0.0
        for n in NGRAMS:
            found = [self.grams[g] for i in range(len(padded) - n + 1) if (g := padded[i : i + n]) in self.grams]
            if found and len(found) >= max(1, (len(padded) - n + 1) // 2):
                return np.mean(found, 0) * (0.6 if n > 2 else 0.3) - penalty, False
            penalty += BACKOFF
        return np.full(len(LANGUAGES), FLOOR / 2), False


def _masked(text: str) -> str:
    return _NOISE.sub(lambda m: " " * len(m[0]), _QUOTED.sub(lambda m: " " * len(m[0]), text))


def tokens(text: str) -> list[tuple[int, int, str]]:
    """(start, end, lower-case word) of the words that tell the language."""
    return [(m.start(), m.end(), m[0].lower()) for m in _WORD.finditer(_masked(text))]


def train(rows: list[tuple[str, str]]) -> Model:
    words: dict[str, Counter] = defaultdict(Counter)
    grams: dict[str, Counter] = defaultdict(Counter)
    for lang, text in rows:
        if lang not in LANGUAGES:
            continue
        for _, _, w in tokens(text or ""):
            words[lang][w] += 1
    for lang, counts in words.items():
        for w, n in counts.items():
            padded = f"^{w}$"
            for k in NGRAMS:
                for i in range(len(padded) - k + 1):
                    grams[lang][padded[i : i + k]] += 1 + math.log(n)
    # English app terms stand inside sentences of every language: a word of English seen in a few others tells little
    totals = {lang: sum(words[lang].values()) or 1 for lang in LANGUAGES}
    score = {w: np.array([math.log((words[lang][w] + 0.003) / totals[lang]) for lang in LANGUAGES]).clip(FLOOR) for w in {w for c in words.values() for w in c}}
    by_size: dict[tuple[str, int], float] = defaultdict(float)
    for lang in LANGUAGES:
        for g, n in grams[lang].items():
            by_size[lang, len(g)] += n
    gram_score = {g: np.array([math.log((grams[lang][g] + 0.05) / (by_size[lang, len(g)] + 1)) for lang in LANGUAGES]).clip(FLOOR) for g in {g for c in grams.values() for g in c}}
    return Model(score, gram_score)


def _silent(words: list[str], known: list[bool]) -> list[bool]:
    """Words of titles and spelled-out numbers: one or two words between two unknown ones, four digits in words."""
    n, out = len(words), [False] * len(words)
    named = [i for i in range(n) if not known[i] and len(words[i]) >= 4]
    for a, b in zip(named[:-1], named[1:]):
        if 2 <= b - a <= 3:
            out[a : b + 1] = [True] * (b + 1 - a)
    i = 0
    while i < n:
        j = i
        while j < n and words[j] in _SPELLED:
            j += 1
        if j - i >= 4:
            out[i:j] = [True] * (j - i)
        i = max(j, i + 1)
    return out


def segments(text: str | None, model: Model, cache: dict) -> list[tuple[int, int, str, float, int]]:
    """(start, end, language, confidence, words) of every stretch of one language."""
    toks = tokens(text or "")
    if not toks:
        return []
    scored = []
    for _, _, w in toks:
        s = cache.get(w)
        if s is None:
            s = cache[w] = model.score(w)
        scored.append(s)
    silent = _silent([t[2] for t in toks], [s[1] for s in scored])
    if not all(silent):
        toks, scored = [t for t, x in zip(toks, silent) if not x], [s for s, x in zip(scored, silent) if not x]
    obs, known = np.array([s[0] for s in scored]), [s[1] for s in scored]
    n, k = obs.shape
    score, back = obs[0].copy(), np.zeros((n, k), np.int8)
    for i in range(1, n):
        best = int(score.argmax())
        jump = score[best] - SWITCH_COST
        stay = score >= jump
        back[i] = np.where(stay, np.arange(k), best)
        score = np.where(stay, score, jump) + obs[i]
    path = np.zeros(n, np.int64)
    path[-1] = score.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), n]
    out = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        total = obs[a:b].sum(0)
        order = np.argsort(total)[::-1]
        margin = float(total[order[0]] - total[order[1]])
        out.append([a, b, int(path[a]), margin, sum(known[a:b])])
    # a stretch too short or too weak to be a sentence joins its stronger neighbour
    while len(out) > 1:
        weak = [i for i, (a, b, lang, margin, kn) in enumerate(out) if b - a < MIN_SEGMENT_WORDS or kn < max(3, 0.4 * (b - a)) or margin < MIN_MARGIN]
        if not weak:
            break
        i = min(weak, key=lambda j: (out[j][1] - out[j][0], out[j][3]))
        j = i - 1 if i and (i + 1 == len(out) or out[i - 1][1] - out[i - 1][0] >= out[i + 1][1] - out[i + 1][0]) else i + 1
        lo, hi = min(i, j), max(i, j)
        lang = out[j][2]
        out[lo] = [out[lo][0], out[hi][1], lang, max(out[j][3], 0.0), out[lo][4] + out[hi][4]]
        del out[hi]
        if lo + 1 < len(out) and out[lo + 1][2] == lang:
            out[lo] = [out[lo][0], out[lo + 1][1], lang, out[lo][3] + out[lo + 1][3], out[lo][4] + out[lo + 1][4]]
            del out[lo + 1]
        if lo and out[lo - 1][2] == lang:
            out[lo - 1] = [out[lo - 1][0], out[lo][1], lang, out[lo - 1][3] + out[lo][3], out[lo - 1][4] + out[lo][4]]
            del out[lo]
    if len(out) == 1:
        total = obs.sum(0)
        order = np.argsort(total)[::-1]
        out = [[0, n, int(order[0]), float(total[order[0]] - total[order[1]]), sum(known)]]
    return [(toks[a][0], toks[b - 1][1], LANGUAGES[lang], 1 / (1 + math.exp(-min(50.0, margin / 4))), b - a) for a, b, lang, margin, _ in out]


RESULT = "segments array<struct<seg_start:int,seg_end:int,lang:string,confidence:double,n_words:int>>"
_NAMES = ("seg_start", "seg_end", "lang", "confidence", "n_words")


class _Batch:
    """Scores of all words of a batch of texts in one matrix.

    A segment has at least ``MIN_SEGMENT_WORDS`` words, so a text in which one language wins every run of that many
    words is of that language without a search; the rest goes through :func:`segments`.
    """

    def __init__(self, model: Model) -> None:
        self.model, self.cache, self.ids, self.rows, self.known = model, {}, {}, [], []

    def word(self, w: str) -> int:
        i = self.ids.get(w)
        if i is None:
            s = self.cache.get(w)
            if s is None:
                s = self.cache[w] = self.model.score(w)
            i = self.ids[w] = len(self.rows)
            self.rows.append(s[0])
            self.known.append(s[1])
        return i

    def __call__(self, texts: list[str | None]) -> list[list[tuple]]:
        if len(self.rows) > 300_000:  # words of earlier batches; scores are computed again when needed
            self.cache, self.ids, self.rows, self.known = {}, {}, [], []
        flat, sizes = [], []
        for t in texts:
            words = _WORD.findall(_masked(t).lower()) if t else []
            ids = [self.word(w) for w in words]
            known = [self.known[i] for i in ids]
            if known.count(False) >= 2 or sum(w in _SPELLED for w in words) >= 4:
                silent = _silent(words, known)
                if not all(silent):
                    ids = [i for i, x in zip(ids, silent) if not x]
            sizes.append(len(ids))
            flat += ids
        out: list[list[tuple]] = [[] for _ in texts]
        if not flat:
            return out
        obs = np.array(self.rows)[flat]
        size = np.array(sizes)
        full = np.flatnonzero(size)
        size = size[full]
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        total = np.add.reduceat(obs, starts, 0)
        order = np.argsort(total, 1)
        best = order[:, -1]
        margin = total[np.arange(len(full)), best] - total[np.arange(len(full)), order[:, -2]]
        k = MIN_SEGMENT_WORDS
        mixed = np.zeros(len(full), bool)
        if len(flat) >= k:
            sums = np.cumsum(np.vstack([np.zeros(obs.shape[1]), obs]), 0)
            winner = (sums[k:] - sums[:-k]).argmax(1)
            doc = np.repeat(np.arange(len(full)), size)
            inside = doc[: len(winner)] == doc[k - 1 :]
            np.logical_or.at(mixed, doc[: len(winner)][inside], (winner != best[doc[: len(winner)]])[inside])
        for j, i in enumerate(full.tolist()):
            t = texts[i]
            if mixed[j]:
                out[i] = segments(t, self.model, self.cache)
            else:
                out[i] = [(0, len(t), LANGUAGES[best[j]], 1 / (1 + math.exp(-min(50.0, margin[j] / 4))), int(size[j]))]
        return out


def identify(rows: DataFrame, samples: DataFrame, id_col: str = "landing_id", text_col: str = "raw_text", label_col: str | None = "detected_language") -> DataFrame:
    """One row per text: its language segments in order, each with a confidence."""
    labelled = [(r[0], r[1]) for r in samples.select("lang", "sample_text").orderBy(F.xxhash64("lang", "sample_text"), "lang", "sample_text").limit(SAMPLE_LIMIT).collect()]
    model, cache = train(labelled), {}
    if label_col:
        own = rows.select(F.struct(normal_label(F.col(label_col)).alias("lang"), F.col(text_col).alias("text")).alias("x")).where(F.col("x.lang").isin(*LANGUAGES) & (F.length("x.text") < 2000))
        for lang, text in bounded_sample(own, "x", SELF_SAMPLE):
            found = segments(text, model, cache)
            if len(found) == 1 and found[0][2] == lang and found[0][3] > 0.95:
                labelled.append((lang, text))
        model = train(labelled)
    shared = rows.sparkSession.sparkContext.broadcast(model)  # bounded by the vocabulary of the bounded samples
    kind = dict(rows.dtypes)[id_col]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch = _Batch(shared.value)
        for pdf in parts:
            found = batch(pdf[text_col].tolist())
            yield pd.DataFrame({id_col: pdf[id_col], "segments": [[dict(zip(_NAMES, s)) for s in f] for f in found]})

    return spread(rows.select(id_col, text_col), id_col).mapInPandas(run, f"{id_col} {kind}, {RESULT}")
