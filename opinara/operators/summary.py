"""Extractive summary of long texts: sentences ranked by a random walk over their word-count cosines."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from opinara import config

_STOP = frozenset(config.TERM_STOP_WORDS)
DAMPING, STEPS = 0.85, 15


def top_sentences(text: str, count: int = config.SUMMARY_SENTENCES) -> str:
    """The ``count`` best sentences in their order; texts with no more sentences stay as they are."""
    parts = [s for s in (p.strip() for p in re.split(r"(?<=[.!?])\s+", text.strip())) if s]
    if len(parts) <= count:
        return text
    bags = [Counter(w for w in re.findall(r"\w+", s.lower()) if w not in _STOP) for s in parts]
    index = {w: i for i, w in enumerate({w for b in bags for w in b})}
    if not index:
        return " ".join(parts[:count])
    m = np.zeros((len(parts), len(index)))
    for r, bag in enumerate(bags):
        for w, n in bag.items():
            m[r, index[w]] = n
    length = np.linalg.norm(m, axis=1, keepdims=True)
    m = np.divide(m, length, out=np.zeros_like(m), where=length > 0)
    link = m @ m.T
    np.fill_diagonal(link, 0.0)
    out = link.sum(1, keepdims=True)
    walk = np.divide(link, out, out=np.zeros_like(link), where=out > 0)
    rank = np.ones(len(parts))
    for _ in range(STEPS):
        rank = (1 - DAMPING) + DAMPING * (rank @ walk)
    best = sorted(np.argsort(rank, kind="stable")[-count:])
    return " ".join(parts[i] for i in best)


def _each(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else top_sentences(t))


def summarised(c: Column, words: int = config.SUMMARY_WORDS) -> Column:
    """Texts of more than ``words`` blank-separated words are summarised; null stays null."""
    summaries = F.pandas_udf(_each, StringType())
    # texts within the limit go to Python as null and cost nothing there
    long = F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")) > words
    return F.coalesce(summaries(F.when(long, c)), c)
