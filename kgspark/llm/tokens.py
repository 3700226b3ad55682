"""Sizes in tokens of a public tokenizer; the vocabulary file is a parameter and is never part of the repository."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_VOCABULARY = os.environ.get("KGSPARK_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the pre-tokenisation pattern that belongs to the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(vocabulary: str = DEFAULT_VOCABULARY):
    """The encoder of a rank file, loaded once per worker process."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str | None, vocabulary: str = DEFAULT_VOCABULARY) -> np.ndarray:
    """Token ids of a text; NULL and empty texts have none."""
    return np.asarray(encoding(vocabulary).encode_ordinary(text), dtype=np.int64) if text else np.empty(0, np.int64)


def token_count(vocabulary: str = DEFAULT_VOCABULARY):
    """Column function: size of a text in tokens (0 for NULL)."""

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        enc = encoding(vocabulary)
        return pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return count
