"""Token counts with a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.runtime import spread

#: Path of the rank file of a public tokenizer; the setting of this name in the session or environment overrides it.
PATH_SETTING = "opinara.tokenizer.path"
TOKENIZER_PATH = os.environ.get("OPINARA_TOKENIZER_PATH", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the published splitting pattern of the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

_encoders: dict = {}


def encoder(path: str):  # noqa: ANN201
    """The tokenizer of a rank file, loaded once a Python worker."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encoders[path] = tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), path: str | None = None, words: Callable[[str | None], bytes] | None = None) -> DataFrame:
    """Rows of (id, kept columns, n_tokens, and coded words where a coding is given); null and empty texts have 0 tokens."""
    types = dict(docs.dtypes)
    cols = [id_col, *keep]
    path = path or docs.sparkSession.conf.get(PATH_SETTING, TOKENIZER_PATH)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for pdf in parts:
            out = pdf[cols].assign(n_tokens=[len(enc.encode_ordinary(t)) if t else 0 for t in pdf[text_col]])
            yield out.assign(words=[words(t) for t in pdf[text_col]]) if words else out

    schema = ", ".join(f"{c} {types[c]}" for c in cols) + ", n_tokens bigint" + (", words binary" if words else "")
    return spread(docs.select(*cols, text_col), id_col).mapInPandas(run, schema)
