"""Per-document text statistics and line labels by a hidden Markov model.

Each line becomes a vector of binned statistics; a four-state model (prose, list, table, junk) with sticky
transitions labels the lines of a document by Viterbi.  The model starts from the tables below and is re-estimated by
``EM_ROUNDS`` rounds of expectation maximisation over all lines of all documents: every partition adds up its expected
counts, which Spark sums to one small table.  The tables below keep a fixed share of the weight.

The lines are read once; their bins are written to a compact table, on which the rounds and the labelling work.

Defined results: null and blank texts have zero words, no lines and are not prose; repeated documents each get their
row; texts of any length are read whole; columns beside the named ones are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.chains import by_position
from opinara.runtime import spread, written

STATES = ("prose", "list", "table", "junk")
DATA_SHARE = 0.5  # weight of the counts beside the tables, at every size of the input
EM_ROUNDS = 2

# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the a an and or but of to in on at for with from by is are was were be been it this that i you he she we they my your our their not no so as if when had has have do does did can will would",
    "es": "el la los las un una y o pero de del a en con por para es son fue que no se lo me mi su como cuando más muy hay todo cada desde aunque",
    "de": "der die das den dem ein eine einen und oder aber von zu in im auf mit für ist sind war nicht es ich du er sie wir ihr mein wie wenn noch auch zwischen obwohl immer wird nach",
    "fr": "le la les un une des et ou mais de du à au en dans avec pour par est sont ne pas que qui ce se je il elle nous vous mon ma mes dès depuis sur il y tout",
    "pt": "o a os as um uma e ou mas de do da em no na com por para é são não que se eu meu minha como quando mais muito todo todos desde mesmo ninguém",
    "id": "yang dan di ke dari untuk dengan ini itu tidak saya ada pada juga sudah bisa kalau karena padahal sejak semua akan lagi",
    "hinglish": "hai hain ka ki ke ko se mein par aur nahi bhi kya ye yeh wo jab tab ab tha thi ho mera meri mere mujhe kar raha koi toh",
    "hi": "है हैं का की के को से में पर और नहीं भी यह वह जब तो था थी हो मेरा मेरी मेरे मुझे कर रहा कोई अब",
    "bn": "এই আমি আর না কিন্তু থেকে এর জন্য করে হয় যায় আমার কেউ পর খুব এবং",
    "ta": "நான் இது என் இந்த மற்றும் ஒரு இல்லை ஆனால் இங்கே பிறகு முதல் மிகவும் இருந்து யாரும்",
}
_COMMON = frozenset(w for ws in FUNCTION_WORDS.values() for w in ws.split())

_WORD = re.compile("[^\\W\\d_][\\w\u0300-\u036f\u0900-\u0dff’'\\-]*")
_SYMBOL = re.compile("[^\\w.,!?'’\"“”«»।…\u0300-\u036f\u0900-\u0dff\\-]|_")
_DIGIT = re.compile(r"\d")
_OTHER = re.compile(r"[\W_]")
_SENTENCE = re.compile(r"[.!?।]+(?:\s|$)")
_BULLET = re.compile(r"^\s*(?:[-*•·‣▪◦–—+>]\s|\[[ xX]?\])")
_NUMBERED = re.compile(r"^\s*(?:\(?\d{1,4}[.)]\s|\(?[a-zA-Z][.)]\s|\d{1,2}:\d{2}(?::\d{2})?\s|\d{4}-\d\d-\d\d[ T])")
_COLUMNS = re.compile(r"\t|\||\S {2,}\S|;")
_RULE = re.compile(r"^[\s|:+\-=_]*-{2,}[\s|:+\-=_]*$")
_END = re.compile(r"[.!?…।॥。！？][\"'”’»)\]]*\s*$")
_SPEAKER = re.compile(r"^\s*[\w .]{1,25}:\s")
# bins of each feature, with P(bin | state) for prose, list, table, junk
EMISSIONS = (
    ("common", 4, ((0.04, 0.10, 0.26, 0.60), (0.50, 0.20, 0.20, 0.10), (0.90, 0.06, 0.03, 0.01), (0.90, 0.06, 0.03, 0.01))),
    ("symbols", 4, ((0.85, 0.13, 0.015, 0.005), (0.45, 0.35, 0.18, 0.02), (0.15, 0.40, 0.35, 0.10), (0.35, 0.10, 0.20, 0.35))),
    ("digits", 4, ((0.90, 0.09, 0.008, 0.002), (0.50, 0.25, 0.20, 0.05), (0.15, 0.30, 0.45, 0.10), (0.35, 0.10, 0.20, 0.35))),
    ("words", 4, ((0.04, 0.16, 0.40, 0.40), (0.35, 0.50, 0.13, 0.02), (0.45, 0.40, 0.13, 0.02), (0.45, 0.20, 0.15, 0.20))),
    ("marker", 3, ((0.985, 0.010, 0.005), (0.30, 0.40, 0.30), (0.94, 0.02, 0.04), (0.85, 0.01, 0.14))),
    ("columns", 3, ((0.93, 0.065, 0.005), (0.80, 0.18, 0.02), (0.03, 0.07, 0.90), (0.80, 0.12, 0.08))),
    ("ending", 2, ((0.35, 0.65), (0.85, 0.15), (0.98, 0.02), (0.93, 0.07))),
    ("same_shape", 2, ((0.97, 0.03), (0.45, 0.55), (0.30, 0.70), (0.45, 0.55))),
    ("variety", 3, ((0.94, 0.055, 0.005), (0.90, 0.08, 0.02), (0.85, 0.12, 0.03), (0.45, 0.25, 0.30))),
    ("long_token", 2, ((0.985, 0.015), (0.99, 0.01), (0.98, 0.02), (0.55, 0.45))),
    ("capitals", 2, ((0.90, 0.10), (0.45, 0.55), (0.85, 0.15), (0.55, 0.45))),
)
_BINS = max(n for _, n, _ in EMISSIONS)
_STAY = 0.88


def start_model() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log start, log transition, log emission[feature, bin, state]."""
    trans = np.full((4, 4), (1 - _STAY) / 3)
    np.fill_diagonal(trans, _STAY)
    emit = np.full((len(EMISSIONS), _BINS, 4), 1e-6)
    for f, (_, n, rows) in enumerate(EMISSIONS):
        emit[f, :n] = np.array(rows).T
    return np.log(np.array([0.55, 0.15, 0.15, 0.15])), np.log(trans), np.log(emit)


def _variety(words: list[str]) -> float:
    """Mean share of distinct words in windows of 30 words."""
    n = len(words)
    if n < 6:
        return 1.0
    shares = [len(set(words[i : i + 30])) / len(words[i : i + 30]) for i in range(0, n, 30) if i == 0 or n - i >= 6]
    return sum(shares) / len(shares)


def line_features(text: str) -> tuple[list[list[int]], list[tuple[int, int, int, int, int, int]]]:
    """Bins of every line with content; beside them (characters without blanks, sentences, words, letters of words,
    common words, letters and digits)."""
    bins, sizes, last = [], [], None
    for line in text.split("\n"):
        tokens = line.split()
        if not tokens:
            continue
        body = "".join(tokens)
        n = len(body)
        words = _WORD.findall(line.lower())
        nw = len(words)
        digits = len(_DIGIT.findall(body)) / n
        symbols = len(_SYMBOL.findall(body)) / n
        n_common = sum(map(_COMMON.__contains__, words))
        common = n_common / nw if nw else 0.0
        cells = 9 if "|" in line and _RULE.match(line) else len(_COLUMNS.findall(line))
        commas = line.count(",")
        if cells < 2 and commas >= 3 and nw <= 4 * (commas + 1) and nw / (commas + 1) <= 2 and common < 0.2:
            cells = 3
        caps = sum([t[0].isupper() for t in tokens]) / len(tokens)
        shape = (len(tokens) if len(tokens) < 4 else 4 + len(tokens) // 3, round(digits * 5), cells, bool(_BULLET.match(line)), bool(_NUMBERED.match(line)), tokens[-1][-1].isalnum())
        variety = _variety(words)
        longest = max(map(len, tokens))
        bins.append([
            0 if common == 0 else 1 if common <= 0.1 else 2 if common <= 0.25 else 3,
            0 if symbols < 0.04 else 1 if symbols < 0.12 else 2 if symbols < 0.35 else 3,
            0 if digits < 0.05 else 1 if digits < 0.2 else 2 if digits < 0.5 else 3,
            0 if nw <= 2 else 1 if nw <= 6 else 2 if nw <= 14 else 3,
            2 if shape[4] else 1 if shape[3] else 0,
            2 if cells >= 2 else min(cells, 1),
            1 if _END.search(line[-40:]) else 0,
            1 if shape == last else 0,
            0 if variety >= 0.72 else 1 if variety >= 0.5 else 2,
            1 if longest >= 25 and longest > 0.15 * n else 0,
            1 if caps >= 0.5 and len(tokens) >= 2 else 0,
        ])
        sizes.append((n, max(1, len(_SENTENCE.findall(line))), nw, sum(map(len, words)), n_common, n - len(_OTHER.findall(body))))
        last = shape
    return bins, sizes


Parameters = tuple[np.ndarray, np.ndarray, np.ndarray]


def _emission(bins: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Log likelihood of every line under every state."""
    out = np.zeros((len(bins), 4))
    for f in range(len(EMISSIONS)):
        out += emit[f][bins[:, f]]
    return out


def viterbi(bins: np.ndarray, sizes: np.ndarray, model: Parameters) -> np.ndarray:
    """The best state of every line of many documents at once; ``sizes`` are their numbers of lines."""
    start, trans, emit = model
    token, ranges = by_position(np.cumsum(sizes) - sizes, sizes)
    score = _emission(bins, emit)[token]
    back = np.zeros(score.shape, np.int8)
    for i, (a, b) in enumerate(ranges):
        if i:
            p = ranges[i - 1][0]
            through = score[p : p + b - a][:, :, None] + trans
            back[a:b] = through.argmax(1)
            score[a:b] += through.max(1)
        else:
            score[a:b] += start
    path = score.argmax(1).astype(np.int8)  # right for last lines; the others follow the line after them
    for (p, _), (a, b) in zip(ranges[-2::-1], ranges[:0:-1]):
        path[p : p + b - a] = back[np.arange(a, b), path[a:b]]
    out = np.empty(len(bins), np.int8)
    out[token] = path
    return out


def expected(bins: np.ndarray, sizes: np.ndarray, model: Parameters) -> np.ndarray:
    """Expected counts of starts, transitions and emissions of many documents, as one row."""
    start, trans, emit = model
    token, ranges = by_position(np.cumsum(sizes) - sizes, sizes)
    obs = _emission(bins, emit)[token]
    like = np.exp(obs - obs.max(1, keepdims=True))
    t, one = np.exp(trans), np.ones(4)
    fwd, bwd = like.copy(), np.ones_like(like)
    counts = np.zeros((4, 4))
    for i, (a, b) in enumerate(ranges):
        fwd[a:b] *= fwd[ranges[i - 1][0] : ranges[i - 1][0] + b - a] @ t if i else np.exp(start)
        fwd[a:b] /= (fwd[a:b] @ one)[:, None]
    for (p, _), (a, b) in zip(ranges[-2::-1], ranges[:0:-1]):
        right = bwd[a:b] * like[a:b]
        back = right @ t.T
        left = fwd[p : p + b - a]
        counts += ((left / ((left * back) @ one)[:, None]).T @ right) * t
        bwd[p : p + b - a] = back / (back @ one)[:, None]
    post = fwd * bwd
    post /= (post @ one)[:, None]
    seen = np.zeros((len(EMISSIONS), _BINS, 4))
    at = bins[token]
    for f in range(len(EMISSIONS)):
        for k in range(4):
            seen[f, :, k] = np.bincount(at[:, f], post[:, k], _BINS)
    first = post[: ranges[0][1]].sum(0) if ranges else np.zeros(4)
    return np.concatenate([first, counts.ravel(), seen.ravel()])


def updated(counts: np.ndarray) -> Parameters:
    """The parameters as a mixture of the tables and the shares of the expected counts."""
    parts = counts[:4], counts[4:20].reshape(4, 4), counts[20:].reshape(len(EMISSIONS), _BINS, 4)
    out = []
    for table, c, axis in zip(start_model(), parts, (0, 1, 1)):
        total = c.sum(axis, keepdims=True)
        p = np.exp(table) / np.exp(table).sum(axis, keepdims=True)
        out.append(np.log(np.where(total > 0, (1 - DATA_SHARE) * p + DATA_SHARE * c / np.maximum(total, 1e-12), p)))
    return out[0], out[1], out[2]


LINES = "bins binary, sizes array<int>"
RESULT = "n_words bigint, n_lines bigint, mean_word_length double, symbol_ratio double, ending_share double, common_share double, prose_share double, list_share double, table_share double, junk_share double, is_prose boolean"
_FIELDS = 6


def coded(texts: list[str | None]) -> tuple[list[bytes], list[np.ndarray]]:
    """The bins of the lines of every text, and the sizes of the lines one after another."""
    rows = [line_features(t or "") for t in texts]
    return [np.array(b, np.uint8).tobytes() for b, _ in rows], [np.array(s, np.int32).ravel() for _, s in rows]


def _stacked(bins: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    width = len(EMISSIONS)
    return np.frombuffer(b"".join(bins), np.uint8).reshape(-1, width), np.array([len(b) // width for b in bins], np.int64)


def described(bins: list[bytes], sizes: list[np.ndarray], model: Parameters) -> list[tuple]:
    """The statistics of documents, in the order of ``RESULT``."""
    flat, many = _stacked(bins)
    full = np.flatnonzero(many)
    path = viterbi(flat, many[full], model) if len(full) else np.zeros(0, np.int8)
    out: list[tuple] = [(0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, False)] * len(bins)
    ends = np.cumsum(many)
    for d in full.tolist():
        n = int(many[d])
        a = int(ends[d]) - n
        own, x = path[a : a + n], np.asarray(sizes[d]).reshape(n, _FIELDS)
        chars, _, words, letters, common, alnum = x.sum(0).tolist()
        share = np.bincount(own, x[:, 0], 4) / chars
        sentences, other = int(x[own == 0, 1].sum()), int((own != 0).sum())
        is_prose = bool(share[0] > 0.5 and not (sentences <= 1 and other >= 3))
        out[d] = (words, n, letters / max(1, words), 1 - alnum / max(1, chars), float(flat[a : a + n, 6].sum()) / n, common / max(1, words), *share.tolist(), is_prose)
    return out


def text_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its statistics, the share of its characters under each line label, and ``is_prose``."""
    kind = dict(docs.dtypes)[id_col]
    spark = docs.sparkSession

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            bins, sizes = coded(pdf[text_col].tolist())
            yield pd.DataFrame({id_col: pdf[id_col], "bins": bins, "sizes": sizes})

    lines = written(spread(docs.select(id_col, text_col), id_col).mapInPandas(read, f"{id_col} {kind}, {LINES}"), "document-lines")
    model = start_model()
    for _ in range(EM_ROUNDS):
        shared = spark.sparkContext.broadcast(model)

        def count(parts: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            total = None
            for pdf in parts:
                flat, many = _stacked(pdf["bins"].tolist())
                if many.any():
                    x = expected(flat, many[many > 0], shared.value)
                    total = x if total is None else total + x
            if total is not None:
                yield pd.DataFrame({"place": np.arange(len(total)), "n": total})

        sums = lines.select("bins").mapInPandas(count, "place int, n double").groupBy("place").agg(F.sum("n").alias("n")).collect()
        counts = np.zeros(20 + len(EMISSIONS) * _BINS * 4)
        for r in sums:
            counts[r["place"]] = r["n"]
        model = updated(counts)
    names = [c.split()[0] for c in RESULT.split(", ")]

    def label(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = pd.DataFrame(described(pdf["bins"].tolist(), pdf["sizes"].tolist(), model), columns=names, index=pdf.index)
            out.insert(0, id_col, pdf[id_col])
            yield out

    return lines.mapInPandas(label, f"{id_col} {kind}, {RESULT}")
