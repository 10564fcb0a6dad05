"""Personal details in free text, found by a skip-chain conditional random field and replaced by placeholders.

Labels: other, email, phone, id_number, address, person_name.  A token's potential sums weights of the token itself
(a frequent word, a kind of listed name, or the shape of its characters), its two left and one right neighbours and
the pattern it lies in; neighbouring tokens share transition weights.  Similar tokens of a document (equal once case,
accents, possessives, doubled letters and signs are folded) are linked by skip edges that favour equal labels, and
loopy max-product message passing makes the labels consistent over each document.

All weights are learnt here from at most ``SAMPLE`` windows of texts, which shape patterns and the name list label
(distant supervision): token and transition weights by gradient steps with forward-backward marginals, the weight of a
skip edge by its likelihood between those marginals.  In a third of the windows the patterns are hidden from the model,
so that it also learns the kinds from character shapes and context and finds details that no pattern matches.
The name list is incomplete, so an unlisted rare word is a name too where its left context is one of names: listed names
make up at least ``CONTEXT_SHARE`` of the rare words there.  The model of the first round labels the rest.

A token keeps "other" without search if that label leads by more than any transitions and skip edges can add; the
bounds are computed from the learnt weights (:meth:`Model.undecided`), so the search loses nothing.

Defined results: null and blank texts have no details and stay as they are; equal texts give equal results; long
texts are read whole; an empty name list leaves names to context; columns beside the named ones are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.chains import by_position
from opinara.runtime import spread

LABELS = ("other", "email", "phone", "id_number", "address", "person_name")
OTHER, EMAIL, PHONE, ID, ADDRESS, NAME = range(6)
QUOTED = 6
SAMPLE = 3_000
WINDOW = 2_000  # characters of a training window
NAME_LIMIT = 1_000_000
KNOWN_MIN = 4
ROUNDS, STEPS, RATE, DECAY = 2, 30, 0.5, 2e-5
HIDDEN = 3  # in one of so many training windows the patterns are hidden
PIECE = 48  # tokens of a training chain
CONTEXT_MIN, CONTEXT_SHARE = 4, 0.3
SKIP_MOST, SKIP_ROUNDS = 3.0, 3
PRUNINGS = 4

_TOKEN = re.compile(r"[^\W_](?:[\ẁ-ͯऀ-ॣঁ-ৣஂ-ௗ'’+\-]*[^\W_])?[̀-ͯऀ-ॣঁ-ৣஂ-ௗ]*|[^\s\w]|_")
_DIGIT_WORD = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine|double)"
# Shapes of e-mail addresses, phone numbers, official numbers and street addresses.
_LOCAL = r"[\w][\w.+\-]*"
_AT = r"(?:\s?@\s?|\s?[(\[{]\s?at\s?[)\]}]\s?|\s+at\s+)"
_DOT = r"(?:\.|\s?[(\[{]\s?dot\s?[)\]}]\s?|\s+dot\s+)"
_EMAIL = re.compile(rf"{_LOCAL}(?:\s+dot\s+[\w\-]+)*(?:\s?@\s?|\s?[(\[{{]\s?at\s?[)\]}}]\s?)[\w\-]+(?:{_DOT}[\w\-]+)+|{_LOCAL}(?:\s+dot\s+[\w\-]+)*\s+at\s+[\w\-]+(?:(?:\.(?=\w)|\s+dot\s+)[\w\-]+)+(?!\s?[@(\[{{])(?![\w.]*\s?[@(\[{{])", re.I)
_PHONE = re.compile(
    r"(?<![\w.])(?:\+\d{1,3}[\s.\-]?\(?\d{2,5}\)?(?:[\s.\-]?\d{2,5}){1,4}|\(\d{2,5}\)[\s.\-]?\d{3,4}[\s.\-]?\d{3,4}|\d{3}\.\d{3}\.\d{4}|\d{3}[\s\-]\d{3}[\s\-]\d{4}|0\d{3,4}[\s\-]\d{5,6}|0\d{4}[\s\-]?\d{3}[\s\-]?\d{3}|\d{5}[\s\-]\d{5}|\d{10})(?![\w]|[.\-]\d)"
    rf"|\b{_DIGIT_WORD}(?:[\s\-]+{_DIGIT_WORD}){{5,}}\b", re.I)  # fmt: skip
_ID = re.compile(r"(?<![\w.\-])(?:\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|\d{4}[ \-]\d{4}[ \-]\d{4}|\d{12}|\d{3}\.\d{3}\.\d{3}-\d{2}|\d{8}-?[A-Za-z]|[A-Za-z]\d{7,8}|[A-Za-z]{2}-\d{2}-\d{6,8}|[A-Za-z]{5}\d{4}[A-Za-z])(?![\w]|[.\-]\d)")
_STREET = r"(?:road|street|close|cross|drive|lane|avenue|marg|towers|court|square|way|boulevard|nagar|terrace|place|st|rd|ave)"
_NOT_NAME = r"(?!(?:on|in|of|the|at|my|and|to|for|from|a|an|times?|songs?|days?|weeks?|months?|years?|seconds?|stars?|hours?|minutes?|i)\b)"
_PART = rf"{_NOT_NAME}[^\W\d_][\w'’\-]*"
_TAIL = r"(?:,?\s+near\s+the\s+[\w]+\s+[\w]+)?(?:,\s*(?:\d{4,6}\s+)?[^\W\d_][\w\-]*(?:\s+[^\W\d_][\w\-]*)?(?:\s+\d{4,6})?)?"
_UNIT = r"(?:(?:apt|flat|apartment|unit|house)\.?\s*(?:no\.?\s*)?\d+\s?[a-z]?\b,?\s*)"
_ADDRESS = re.compile(
    rf"(?:{_UNIT}(?:{_PART}(?:\s+{_PART})?\s+towers,?\s*)?(?:\d+(?:/\d+)?\s+)?(?:{_PART}\s+){{1,3}}?{_STREET}\b|(?<![\w.,\-])\d{{1,4}}[a-z]?(?:/\d{{1,3}})?,?\s+(?:{_PART}\s+){{1,3}}?{_STREET}\b"
    rf"|[^\W\d_][\w\-]*(?:\s[^\W\d_][\w\-]*)?(?:stra(?:ß|ss)e|str\.|weg|platz|allee)\s+\d{{1,4}}|\d{{1,4}}(?:\s?bis)?,?\s+(?:rue|avenue|boulevard|impasse|chemin)\s+(?:de\s+|du\s+|des\s+)?{_PART}(?:\s+{_PART})?"
    rf"|\b(?:calle|avenida|plaza|rua|travessa|jalan|jl\.)\s+{_PART}(?:\s+{_PART})?,?\s*(?:no\.?\s*)?\d{{1,4}}(?:,?\s*\d{{1,2}}º?\s?[a-z]\b|,?\s*apto\.?\s*\d+)?){_TAIL}", re.I)  # fmt: skip
_QUOTE = re.compile(r"[\"“”„«»][^\"“”„«»\n]{1,80}[\"“”„«»]|(?<!\w)['‘][^'‘’\n]{3,80}['’](?!\w)")
_HANDLE = re.compile(r"(?<!\w)(?:@\w+|u/\w+)", re.I)
_HAS_DIGIT = re.compile(r"\d")
_HAS_QUOTE = re.compile(r"[\"“”„«»'‘]")
# Checks before the shapes; every one accepts all that the patterns behind it accept.
_STREET_WORD = re.compile(rf"\b(?:{_STREET[3:-1]}|rue|boulevard|impasse|chemin|calle|avenida|plaza|rua|travessa|jalan|jl)\b|stra(?:ß|ss)e\b|str\.|weg\b|platz\b|allee\b")
_HAS_AT = re.compile(r"[(\[{]\s?at\s?[)\]}]|\sat\s")
_NUMBER_SHAPE = re.compile(r"(?<!\d)\d{3,5}[\-.\s]\d|(?<=[+(])\d|\d{7}|(?<=[^\W\d_]{5})\d{4}|(?<=[^\W\d_]-)\d\d-")
_SPELLED = re.compile(rf"\b{_DIGIT_WORD}[\s\-]+{_DIGIT_WORD}[\s\-]+{_DIGIT_WORD}\b")
_NUMBER_HINTS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "double", "oh")


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, flag) of the shapes in a text; an earlier kind wins where two overlap."""
    found: list[tuple[int, int, int]] = []

    def add(pattern: re.Pattern, flag: int) -> None:
        for m in pattern.finditer(text):
            s, e = m.span()
            for a, b, _ in found:
                if s < b and a < e:
                    break
            else:
                found.append((s, e, flag))

    low = text.lower()
    if not low.isascii():  # letters that patterns without case take for s and i
        low = low.replace("ſ", "s").replace("i̇", "i").replace("ı", "i")
    sign = "@" in low
    if sign or _HAS_AT.search(low):
        add(_EMAIL, EMAIL)
    if sign or "u/" in low:
        add(_HANDLE, QUOTED)
    if _HAS_DIGIT.search(low):
        if _STREET_WORD.search(low):
            add(_ADDRESS, ADDRESS)
        if _NUMBER_SHAPE.search(low):
            add(_ID, ID)
            add(_PHONE, PHONE)
    if any(h in low for h in _NUMBER_HINTS) and _SPELLED.search(low):
        add(_PHONE, PHONE)
    if _HAS_QUOTE.search(low):
        add(_QUOTE, QUOTED)
    return found


@dataclass
class Model:
    known: dict[str, int]  # frequent words and shapes of tokens with digits
    names: dict[str, int]  # listed names: 0 given, 1 family, 2 town
    token: np.ndarray
    left: np.ndarray
    left2: np.ndarray
    right: np.ndarray
    flag: np.ndarray
    trans: np.ndarray
    skip: float

    def gains(self) -> tuple[np.ndarray, np.ndarray]:
        """Per label, the most that the transition to the left or the right neighbour changes in its favour against
        "other": row 0 if that neighbour is "other", row 1 whatever it is."""
        left = self.trans - self.trans[:, [OTHER]]
        right = (self.trans - self.trans[[OTHER]]).T
        return tuple(np.stack([x[OTHER], x.max(0)]) for x in (left, right))  # type: ignore[return-value]

    def undecided(self, unary: np.ndarray, head: np.ndarray, linkable: np.ndarray) -> np.ndarray:
        """The tokens that may have another label than "other"; the rest keep it whatever their neighbours are."""
        left, right = (g[:, 1:] for g in self.gains())
        slack = np.where(linkable, np.float32(2 * self.skip), np.float32(0))
        most = np.maximum(left[1], 0) + np.maximum(right[1], 0)
        live = np.zeros(len(unary), bool)
        for k in range(1, 6):
            live |= unary[:, OTHER] - unary[:, k] < slack + np.float32(most[k - 1])
        for _ in range(PRUNINGS):
            i = np.flatnonzero(live)
            edge = np.concatenate([head, [True]])
            before = np.where(edge[i], 2, live[i - 1])
            after = np.where(edge[i + 1], 2, live[np.minimum(i + 1, len(live) - 1)])
            gain = np.vstack([left, np.zeros(5)])[before] + np.vstack([right, np.zeros(5)])[after]
            drop = (unary[i][:, [OTHER]] - unary[i][:, 1:] >= gain + slack[i][:, None]).all(1)
            if not drop.any():
                break
            live[i[drop]] = False
        return live


_BUCKETS = 3 + 6 + 1 + 1  # listed names, shapes of rare words, text edge, rare small word in a text that uses capitals
_RUNS = re.compile(r"\d+|[^\W\d_]+|[^\w]+|_+")


def shape(word: str) -> str:
    """Runs of digits with their length, runs of letters as ``A`` or ``a``, signs as they are."""
    return " " + "".join(f"9{min(len(r), 13)}" if r[0].isdigit() else "A" if r.isupper() else "a" if r[0].isalpha() else r[0] for r in _RUNS.findall(word))


def _bucket(word: str, known: dict[str, int], names: dict[str, int]) -> int:
    low = word.lower()
    kind = names.get(low)
    if kind is not None:
        return kind
    k = known.get(low)
    if k is not None:
        return k
    if any(c.isdigit() for c in word):
        return known.get(shape(word), 3)
    if not word[0].isalpha():
        return 4
    if len(word) == 1:
        return 5
    return 6 if word[:1].isupper() and not word.isupper() else 7 if word.isupper() else 8


EDGE, SMALL = 9, 10


def similar(word: str) -> str:
    """What similar tokens have in common: the word without case, accents, possessive, doubled letters and signs."""
    low = word.lower()
    if low[-2:] in ("'s", "\u2019s"):
        low = low[:-2]
    if not low.isascii():
        low = "".join(c for c in unicodedata.normalize("NFKD", low) if not "\u0300" <= c <= "\u036f")
    return re.sub(r"(.)\1+", r"\1", re.sub(r"['\u2019+\-]", "", low))


class _Buckets(dict):
    """Token to id, filled on demand."""

    def __init__(self, known: dict[str, int], names: dict[str, int]) -> None:
        super().__init__()
        self.known, self.names = known, names

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        b = self[word] = _bucket(word, self.known, self.names)
        return b


class _Encoder:
    """Token ids, marked token ranges and words of texts."""

    def __init__(self, known: dict[str, int], names: dict[str, int]) -> None:
        self.buckets = _Buckets(known, names)

    def __call__(self, text: str) -> tuple[list[int], list[tuple[int, int, int]], list[str]]:
        words = _TOKEN.findall(text)
        buckets = self.buckets
        ids = [buckets[w] for w in words]
        if 8 in ids and not text.islower():
            heads = "".join([w[0] for w in words])
            small = sum(map(str.islower, heads))
            if small * 10 >= 4 * sum(map(str.isalpha, heads)) and any(w[0].isupper() and w[1:].islower() for w in words):
                ids = [SMALL if i == 8 else i for i in ids]
        marks: list[tuple[int, int, int]] = []
        found = spans(text)
        if found:
            at, pos = [], 0
            for w in words:
                pos = text.find(w, pos)
                at.append(pos)
                pos += len(w)
            for s, e, f in found:
                i, j = bisect_right(at, s) - 1, bisect_left(at, e)
                if i < 0 or at[i] + len(words[i]) <= s:
                    i += 1
                marks.append((i, j, f))
        return ids, marks, words


def _flags(marks: list[tuple[int, int, int]], n: int) -> list[int]:
    out = [0] * n
    for i, j, f in marks:
        out[i:j] = [f] * (j - i)
    return out


def _context(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the left, second left and right neighbour; text edges give ``EDGE``."""
    n = len(ids)
    left, left2, right = (np.full(n, EDGE, np.int32) for _ in range(3))
    left[1:], left2[2:], right[:-1] = ids[:-1], ids[:-2], ids[1:]
    first, second = starts, starts + 1
    left[first] = left2[first] = EDGE
    left2[second[second < n]] = EDGE
    right[ends - 1] = EDGE
    return left, left2, right


def _marginals(score: np.ndarray, trans: np.ndarray, chains: tuple[np.ndarray, list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Token marginals of all chains, and the summed pair marginals, by scaled forward-backward."""
    token, ranges = chains
    x = score[token]
    e = np.exp(x - x.max(1, keepdims=True))
    t, one = np.exp(trans), np.ones(6)
    fwd, bwd = e.copy(), np.ones_like(e)
    for i, (a, b) in enumerate(ranges):
        if i:
            p = ranges[i - 1][0]
            fwd[a:b] *= fwd[p : p + b - a] @ t
        fwd[a:b] /= (fwd[a:b] @ one)[:, None]
    pair = np.zeros_like(trans)
    for (p, _), (a, b) in zip(ranges[-2::-1], ranges[:0:-1]):
        right = bwd[a:b] * e[a:b]
        back = right @ t.T
        left = fwd[p : p + b - a]
        pair += ((left / ((left * back) @ one)[:, None]).T @ right) * t
        bwd[p : p + b - a] = back / (back @ one)[:, None]
    m = fwd * bwd
    m /= (m @ one)[:, None]
    out = np.empty_like(m)
    out[token] = m
    return out, pair


def _fit(feats: list[np.ndarray], y: np.ndarray, use: np.ndarray, size: int, starts: np.ndarray, sizes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Token and transition weights by adaptive gradient steps on the weighted likelihood of the labels, and the
    marginals they give."""
    dims = [size, size, size, size, 7]
    w = [np.zeros((d, 6)) for d in dims] + [np.zeros((6, 6))]
    g2 = [np.full(x.shape, 1e-8) for x in w]
    target = np.eye(6)[y]
    balance = (use * np.where(y == OTHER, 1.0, 2.0))[:, None]
    chains = by_position(starts, sizes)
    inner = np.ones(len(y), bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((6, 6))
    np.add.at(seen, (y[at - 1], y[at]), 1)
    for _ in range(STEPS):
        p, pair = _marginals(sum(wk[f] for wk, f in zip(w, feats)), w[-1], chains)
        err = (p - target) * balance
        grads = [np.stack([np.bincount(f, err[:, c], dims[k]) for c in range(6)], 1) / len(y) + DECAY * w[k] for k, f in enumerate(feats)]
        grads.append((pair - seen) / len(y) + DECAY * w[-1])
        for k, g in enumerate(grads):
            g2[k] += g * g
            w[k] -= RATE * g / np.sqrt(g2[k])
    return w[:-1], w[-1], _marginals(sum(wk[f] for wk, f in zip(w[:-1], feats)), w[-1], chains)[0]


def _skip_weight(p: np.ndarray, y: np.ndarray, pairs: np.ndarray) -> float:
    """The weight under which linked tokens have their labels most likely; ``p`` are chain marginals that do not know
    that a linked token is a listed name."""
    if not len(pairs):
        return 1.0
    i, j = pairs[:, 0], pairs[:, 1]
    base = np.clip((p[i] * p[j]).sum(1), 1e-6, 1 - 1e-6)
    same, w = y[i] == y[j], 0.0
    for _ in range(50):
        q = base * np.exp(w) / (base * np.exp(w) + 1 - base)
        w = float(np.clip(w + np.clip((same.mean() - q.mean()) / max(1e-6, float((q * (1 - q)).mean())), -1, 1), 0, SKIP_MOST))
    return w


def links(words: list[str], ids: list[int], marks: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Pairs of consecutive similar tokens of a text, among listed names and rare words outside of patterns."""
    where: dict[str, list[int]] = {}
    for i, k in enumerate(ids):
        if k < 2 or 6 <= k <= 8:
            where.setdefault(similar(words[i]), []).append(i)
    inside = {i for a, b, _ in marks for i in range(a, b)}
    where = {k: [i for i in at if i not in inside] for k, at in where.items() if len(at) > 1}
    return [(x, y) for at in where.values() for x, y in zip(at[:-1], at[1:]) if y - x > 1]


def train(texts: list[str], names: dict[str, int]) -> Model:
    counts, shapes = Counter(), Counter()
    for t in texts:
        for w in _TOKEN.findall(t):
            if any(c.isdigit() for c in w):
                shapes[shape(w)] += 1
            elif len(w) > 1 or not w.isalpha():
                counts[w.lower()] += 1
    listed_words = sorted(w for w, n in counts.items() if n >= KNOWN_MIN and w not in names) + sorted(w for w, n in shapes.items() if n >= KNOWN_MIN)
    known = {w: _BUCKETS + i for i, w in enumerate(listed_words)}
    # words as frequent as ordinary ones but seen only beside listed names or inside quotes stay rare words
    encode = _Encoder(known, names)
    near, total, capital = Counter(), Counter(), Counter()
    for ids, marks, words in map(encode, texts):
        flags = _flags(marks, len(ids))
        for i, w in enumerate(words):
            if ids[i] >= _BUCKETS and w[0].isalpha():
                low = w.lower()
                total[low] += 1
                beside = any(0 <= j < len(ids) and ids[j] < 2 for j in (i - 2, i - 1, i + 1, i + 2))
                near[low] += flags[i] == QUOTED or beside
                capital[low] += w[:1].isupper()
    for w, n in total.items():
        if near[w] >= 0.5 * n and capital[w] >= 0.5 * n:
            known.pop(w, None)
    encode = _Encoder(known, names)
    coded = [c for c in map(encode, texts) if c[0]]
    size = _BUCKETS + max([0, *known.values()]) + 1
    if not coded:
        return Model(known, names, *[np.zeros((d, 6), np.float32) for d in (size, size, size, size, 7)], np.zeros((6, 6)), 0.0)
    ids = np.array([i for c in coded for i in c[0]])
    flags = np.array([f for c in coded for f in _flags(c[1], len(c[0]))])
    sizes = np.array([len(c[0]) for c in coded])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    pairs = np.array([(s + i, s + j) for s, c in zip(starts.tolist(), coded) for i, j in links(c[2], c[0], c[1])], np.int64).reshape(-1, 2)
    ctx = _context(ids, starts, ends)
    listed = (ids < 2) & (flags == 0)
    y = np.where((flags > 0) & (flags < QUOTED), flags, np.where(listed, NAME, OTHER))
    rare = ((ids == 5) | (ids == 6) | (ids == 7) | (ids == 8)) & (flags == 0)
    beside = np.zeros(len(ids), bool)
    for k in (1, 2):
        beside[k:] |= listed[:-k]
        beside[:-k] |= listed[k:]
    # left contexts of names: the word before, or the two words before
    left, left2, _ = ctx
    in_context = np.zeros(len(ids), bool)
    open_ = (listed | rare) & (flags == 0)
    for key, least, share in ((left * size + left2, CONTEXT_MIN, CONTEXT_SHARE), (left, 4 * CONTEXT_MIN, 2.5 * CONTEXT_SHARE)):
        codes, inverse = np.unique(key, return_inverse=True)
        n_listed = np.bincount(inverse, listed, len(codes))
        n_open = np.bincount(inverse, open_, len(codes))
        good = (n_listed >= least) & (n_listed >= share * n_open)
        in_context |= good[inverse]
    named = rare & in_context
    y = np.where(named, NAME, y)
    hidden = np.repeat(np.arange(len(coded)) % HIDDEN == HIDDEN - 1, sizes)
    feats = [ids, *ctx, np.where(hidden & (flags < QUOTED), 0, flags)]
    # chains of at most PIECE tokens
    cut = [(s + a, min(PIECE, n - a)) for s, n in zip(starts.tolist(), sizes.tolist()) for a in range(0, n, PIECE)]
    at, length = np.array([c[0] for c in cut]), np.array([c[1] for c in cut])
    w, trans, p = _fit(feats, y, np.where(rare & beside & ~named, 0.1, 1.0), size, at, length)
    for _ in range(ROUNDS - 1):
        named = rare & (p[:, NAME] > p[:, OTHER])
        y = np.where(named, NAME, y)
        w, trans, p = _fit(feats, y, np.where(rare & beside & ~named, 0.3, 1.0), size, at, length)
    blind = ids.copy()
    blind[pairs.ravel()] = np.where(ids[pairs.ravel()] < 2, 6, ids[pairs.ravel()])
    p = _marginals(sum(wk[f] for wk, f in zip(w, [blind, *feats[1:]])), trans, by_position(at, length))[0]
    return Model(known, names, *[x.astype(np.float32) for x in w], trans, _skip_weight(p, y, pairs))


def beliefs(unary: np.ndarray, trans: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Max-marginals of all chains at once; tokens outside the chains get zeros."""
    token, ranges = by_position(starts, sizes)
    u = unary[token]
    fwd, bwd = u.copy(), np.zeros_like(u)
    for (p, _), (a, b) in zip(ranges[:-1], ranges[1:]):
        fwd[a:b] += (fwd[p : p + b - a][:, :, None] + trans).max(1)
    for (p, _), (a, b) in zip(ranges[-2::-1], ranges[:0:-1]):
        bwd[p : p + b - a] = ((u[a:b] + bwd[a:b])[:, None, :] + trans).max(2)
    out = np.zeros_like(unary)
    out[token] = fwd + bwd
    return out


def decode(unary: np.ndarray, model: Model, starts: np.ndarray, sizes: np.ndarray, edges: Callable[[int], list[tuple[int, int]]], linkable: np.ndarray) -> np.ndarray:
    """Labels of the tokens of many texts by max-product on the chains, with skip edges by loopy message passing.

    Tokens that surely keep "other" part the chains.  ``edges`` gives the links of a text, between ``linkable`` tokens.
    """
    trans = model.trans
    n = len(unary)
    out = np.zeros(n, np.int64)
    head = np.zeros(n, bool)
    head[starts] = True
    live = model.undecided(unary, head, linkable)
    if not live.any():
        return out
    doc = np.repeat(np.arange(len(starts)), sizes)
    first = np.flatnonzero(live & np.concatenate([[True], ~live[:-1]]) | live & head)
    last = np.flatnonzero(live & np.concatenate([~live[1:] | head[1:], [True]]))
    u = unary.astype(np.float64)
    before = ~head[first]
    u[first[before]] += trans[OTHER]
    tail = np.concatenate([head[1:], [True]])
    after = ~tail[last]
    u[last[after]] += trans[:, OTHER]
    length = last - first + 1
    belief = beliefs(u, trans, first, length)
    pairs = []
    if model.skip > 0:  # links matter where a linked token may change its label
        lead = belief[:, OTHER] - belief[:, 1:].max(1)
        open_ = live & linkable & (np.abs(lead) < 2 * model.skip)
        pairs = [(starts[d] + i, starts[d] + j) for d in np.unique(doc[open_]) for i, j in edges(int(d))]
    if pairs:
        pairs = np.array(pairs)
        pairs = pairs[live[pairs].any(1)]
    if len(pairs):
        # a token that keeps "other" sends and gets messages, too, but its own label stands
        a, b = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
        back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
        touched = np.zeros(len(starts), bool)
        touched[doc[a]] = True
        mine = touched[doc[first]]
        f, s = first[mine], length[mine]
        fixed = np.full(6, -50.0)
        fixed[OTHER] = 0.0
        msg = np.zeros((len(a), 6))
        now = belief.copy()
        now[~live] = fixed
        for _ in range(SKIP_ROUNDS):
            x = now[a] - msg[back]
            m = np.maximum(x + model.skip, x.max(1, keepdims=True))
            msg = 0.5 * msg + 0.5 * (m - m.max(1, keepdims=True))
            extra = u.copy()
            np.add.at(extra, b, msg)
            new = beliefs(extra, trans, f, s)
            now = np.where((touched[doc] & live)[:, None], new, now)
        belief = now
    out[live] = belief[live].argmax(1)
    return out


class Finder:
    def __init__(self, model: Model) -> None:
        self.m, self.encode = model, _Encoder(model.known, model.names)

    def __call__(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """(start, end, label) of the details of every text."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        coded, owner = [], []
        for i, t in enumerate(texts):
            if t:
                c = self.encode(t)
                if c[0]:
                    coded.append(c)
                    owner.append(i)
        if not coded:
            return out
        ends = np.cumsum([len(c[0]) for c in coded])
        starts = np.concatenate([[0], ends[:-1]])
        ids = np.fromiter(chain.from_iterable(c[0] for c in coded), np.int32, int(ends[-1]))
        flags = np.zeros(len(ids), np.int8)
        for a, c in zip(starts.tolist(), coded):
            for i, j, f in c[1]:
                flags[a + i : a + j] = f
        left, left2, right = _context(ids, starts, ends)
        m = self.m
        unary = m.token[ids] + m.left[left] + m.left2[left2] + m.right[right] + m.flag[flags]
        labels = decode(unary, m, starts, ends - starts, lambda d: links(coded[d][2], coded[d][0], coded[d][1]), (ids < 2) | (ids >= 6) & (ids <= 8))
        loud = np.flatnonzero(np.add.reduceat(labels, starts))
        for j in loud.tolist():
            a, b = int(starts[j]), int(ends[j])
            words, text, own = coded[j][2], texts[owner[j]], labels[a:b].tolist()
            at = [m.span() for m in _TOKEN.finditer(text)]
            i, n = 0, b - a
            while i < n:
                k = own[i]
                if k == OTHER:
                    i += 1
                    continue
                e = i
                while e + 1 < n and own[e + 1] == k:
                    e += 1
                s, t = at[i][0], at[e][1]
                if k != NAME or sum(w[0].isalpha() and len(w) > 1 for w in words[i : e + 1]):
                    while t > s and k == NAME and text[t - 1] in ".,;:!?":
                        t -= 1
                    out[owner[j]].append((s, t, int(k)))
                i = e + 1
        return out


RESULT = "masked string, details array<struct<kind:string,start:int,end:int>>"


def listed_names(names: DataFrame) -> dict[str, int]:
    """Parts of the listed names with their kind; at most ``NAME_LIMIT`` rows, chosen by hash."""
    kinds = {"given": 0, "family": 1, "town": 2}
    listed: dict[str, int] = {}
    for r in names.select("name", "name_kind").distinct().orderBy(F.xxhash64("name", "name_kind"), "name", "name_kind").limit(NAME_LIMIT).collect():
        for part in re.split(r"[\s\-]+", r["name"] or "") + [r["name"] or ""]:
            if len(part) > 2 and kinds.get(r["name_kind"]) is not None:
                listed[part.lower()] = min(kinds[r["name_kind"]], listed.get(part.lower(), 9))
    return listed


def training_windows(rows: DataFrame, listed: dict[str, int], text_col: str) -> list[str]:
    """At most ``SAMPLE`` windows of texts, chosen by hash: half of any texts, half of those with a listed person name
    among ``8 * SAMPLE`` texts.  A text longer than ``WINDOW`` gives the window its hash names."""
    h = F.xxhash64(text_col)
    part = F.pmod(h, F.lit(1 << 20))
    n = rows.where(part < (1 << 14)).count() * 64
    share = min(1 << 20, (8 * SAMPLE << 20) // n) if n > 16 * SAMPLE else 1 << 20
    start = F.when(F.length(text_col) > WINDOW, F.pmod(F.xxhash64(h), F.length(text_col) - WINDOW)).otherwise(0) + 1
    drawn = rows.where(part < share).select(F.substr(text_col, start.cast("int"), F.lit(WINDOW)).alias("t"), h.alias("h"))
    shared = rows.sparkSession.sparkContext.broadcast(frozenset(w for w, k in listed.items() if k < 2))

    def mark(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pdf.assign(named=[not shared.value.isdisjoint(w.lower() for w in _TOKEN.findall(t)) for t in pdf["t"]])

    marked = drawn.mapInPandas(mark, "t string, h bigint, named boolean")
    first = lambda df: [r["t"] for r in df.orderBy("h", "t").limit(SAMPLE // 2).collect()]
    return sorted({*first(marked), *first(marked.where("named"))})


def find_details(rows: DataFrame, names: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """Rows of (keys, text with placeholders, details found)."""
    listed = listed_names(names)
    texts = training_windows(rows.where(F.length(text_col) > 0), listed, text_col)
    model = train(texts, listed)
    shared = rows.sparkSession.sparkContext.broadcast(model)  # bounded by the vocabulary of SAMPLE texts and the name list
    types = dict(rows.dtypes)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(shared.value)
        for pdf in parts:
            texts = pdf[text_col].tolist()
            masked, details = [], []
            for t, found in zip(texts, finder(texts)):
                s = t
                for a, b, k in reversed(found):
                    s = f"{s[:a]}[{LABELS[k].upper()}]{s[b:]}"
                masked.append(s)
                details.append([{"kind": LABELS[k], "start": a, "end": b} for a, b, k in found])
            yield pd.concat([pdf[keys], pd.DataFrame({"masked": masked, "details": details}, index=pdf.index)], axis=1)

    return spread(rows.select(*keys, text_col), keys[0]).mapInPandas(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", " + RESULT)
