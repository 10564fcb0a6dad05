"""Hosted-model steps behind protocols, with deterministic offline defaults."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType


class Embedder(Protocol):
    def embed(self, text: Column) -> Column: ...


class HashedEmbedder:
    """Signed hashed word counts of unit length; a blank text is embedded as ``empty review``."""

    def __init__(self, dimension: int = 384) -> None:
        self.dimension = dimension

    def embed(self, text: Column) -> Column:
        d = self.dimension

        def run(texts: pd.Series) -> pd.Series:
            out = []
            for t in texts:
                words = [w for w in re.split(r"[\W_]+", (t or "").lower()) if w] or ["empty", "review"]
                v = np.zeros(d)
                for w in words:
                    h = xxhash.xxh64_intdigest(w)
                    v[h % d] += 1.0 if (h >> 32) & 1 else -1.0
                n = float(np.linalg.norm(v))
                out.append((v / n if n > 0 else v).astype(np.float32).tolist())
            return pd.Series(out)

        return F.pandas_udf(run, ArrayType(FloatType()))(text)


class Model(Protocol):
    """A hosted model: JSON out of a prompt."""

    def answer(self, task: str, prompt: str) -> dict: ...


class OfflineModel:
    """What every step gives without a key."""

    # Results of the steps without a key.
    EMPTY = {"decompose": {"sub_issues": []}, "name": {}, "answer": {"confidence_score": 0.0}, "refine": {"refined_themes": []}, "validate": {}}

    def answer(self, task: str, prompt: str) -> dict:
        return dict(self.EMPTY.get(task, {}))


def ask(df: DataFrame, prompt: str, task: str, model: Model, batch: int = 25) -> DataFrame:
    """Add ``answer`` (JSON text) by a model, ``batch`` prompts at a time inside each task."""
    import json

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for a in range(0, len(pdf), batch):
                piece = pdf.iloc[a : a + batch]
                yield piece.assign(answer=[json.dumps(model.answer(task, p)) for p in piece[prompt]])

    return df.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", answer string")


def translate_batches(df: DataFrame, text: str, lang: str, translate=None, batch: int = 20) -> DataFrame:  # noqa: ANN001
    """Add ``translated``: ``translate(list of texts, language)`` in batches of one language; identity by default.

    A failing batch keeps its texts.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = pdf[text].copy()
            for code, rows in pdf.groupby(lang, dropna=False):
                for a in range(0, len(rows), batch):
                    piece = rows.iloc[a : a + batch]
                    try:
                        if translate is not None:
                            out.loc[piece.index] = translate(piece[text].tolist(), code)
                    except Exception:  # noqa: BLE001
                        continue
            yield pdf.assign(translated=out)

    return df.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", translated string")


def fallback_theme(name: str) -> dict:
    """A configuration derived from a theme's name alone, for themes no model has described yet.

    The phrases are this engine's own and name nothing but the theme; anchors cover listening, finding, routines, joy,
    anger, wishes, faults and leaving.
    """
    key = name.lower().strip()
    slug = re.sub(r"[\s_-]+", "_", re.sub(r"[^\w\s-]", "", key)).strip("_")
    words = list(dict.fromkeys([key, *key.split()]))
    anchors = {
        "listening": f"playing and hearing {key}", "finding": f"looking for {key} and being shown something new", "routine": f"using {key} at home, at work or on the way",
        "joy": f"glad about {key}, works very well", "anger": f"annoyed by {key}, does not work", "wish": f"please add or change {key}",
        "fault": f"{key} shows an error, stops or is slow", "leaving": f"giving up because of {key}, moving to another service",
    }
    questions = {
        "TRQ1": (f"{name}: first steps", f"Where do people meet {key}, and what keeps them from using it?"),
        "TRQ2": (f"{name}: faults", f"Which faults of {key} are reported most, and on which devices?"),
        "TRQ3": (f"{name}: worth", f"What makes {key} worth its price, and what does not?"),
        "TRQ4": (f"{name}: leaving", f"Which gaps of {key} make people leave?"),
    }
    return {
        "theme": name, "theme_slug": slug,
        "scraping_elements": {"subreddits": [], "search_queries": [f"{w} {key}" for w in ("opinion", "trouble with")], "video_queries": [f"{key} test", f"{key} explained"], "forum_keywords": words},
        "level_0_config": {"priority_routing_keywords": words},
        "semantic_anchors": anchors,
        "research_questions": {k: {"title": t, "question": q} for k, (t, q) in questions.items()},
    }
