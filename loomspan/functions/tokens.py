"""Subword token counts by a public vocabulary; the path of its file of ranks is the caller's."""

from __future__ import annotations

import base64
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the split before merges that byte-level vocabularies of this kind were made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Most lines of a file of ranks.
MOST_RANKS = 1_000_000

_ENCODERS: dict = {}


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Ranks of byte sequences, from a file with one sequence in base64 and its rank a line, in any storage that Spark reads."""
    rows = spark.read.text(path).limit(MOST_RANKS + 1).collect()
    if len(rows) > MOST_RANKS:
        raise ValueError(f"{path} has more than {MOST_RANKS} ranks")
    return {base64.b64decode(a): int(b) for a, b in (r[0].split() for r in rows if r[0].strip())}


def _encoder(key: str, ranks: dict[bytes, int], pattern: str):
    """Built once in a worker."""
    if key not in _ENCODERS:
        import tiktoken

        _ENCODERS[key] = tiktoken.Encoding(key, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def subword_counter(spark: SparkSession, path: str, pattern: str = PATTERN) -> Callable[[Column], Column]:
    """A function from a text column to its number of tokens (null: 0); control strings in a text are ordinary text.

    The vocabulary is read once and broadcast; tasks take texts in Arrow batches. It may stand wherever :func:`text.n_tokens` does.
    """
    ranks = spark.sparkContext.broadcast(read_ranks(spark, path))

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        encoder = _encoder(f"{path} {pattern}", ranks.value, pattern)
        return pd.Series([len(encoder.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return count
