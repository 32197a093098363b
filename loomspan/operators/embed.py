"""A text embedder that needs no model: hashed words and letter n-grams, weighed by how few texts have them, projected at random.

It stands behind the interface of external encoders (:mod:`scorers`), so that retrieval can run from texts.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORD = re.compile(r"\w+|[^\w\s]")
#: Distinct words and n-grams whose features a worker keeps, and texts whose features are counted at a time.
KEPT_WORDS, KEPT_GRAMS, COUNTED_TEXTS = 100_000, 200_000, 8


def features(word: str, grams: int, buckets: int, of_gram: dict[str, int]) -> list[int]:
    """Buckets of a word and of its n-grams of letters, with marks at its ends."""
    marked = f"<{word}>"
    return [zlib.crc32(word.encode()) % buckets, *[of_gram[marked[i : i + grams]] for i in range(len(marked) - grams + 1)]]


class _Grams(dict):
    """Buckets of n-grams, each hashed once; these are few where words are many."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, gram: str) -> int:
        if len(self) > KEPT_GRAMS:
            self.clear()
        self[gram] = at = zlib.crc32(gram.encode()) % self.buckets
        return at


class Words:
    """Features of the words that a worker has met, and counts of them in texts."""

    def __init__(self, grams: int, buckets: int):
        self.grams, self.buckets, self.of_gram = grams, buckets, _Grams(buckets)
        self.seen = np.zeros(COUNTED_TEXTS * buckets, np.int32)  # where a text first has a bucket; only read where just written
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.sizes, self.starts, self.flat, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1 << 14, np.int32), 0

    def _learn(self, words: set[str]) -> None:
        each = [[b for part in _WORD.findall(w.lower()) for b in features(part, self.grams, self.buckets, self.of_gram)] for w in words]
        low, high = len(self.ids), len(self.ids) + len(each)
        self.ids.update(zip(words, range(low, high), strict=True))
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        end = self.used + int(sizes.sum())
        for name, most in (("sizes", high), ("starts", high), ("flat", end)):
            held = getattr(self, name)
            if most > len(held):
                setattr(self, name, np.concatenate([held, np.zeros(max(most - len(held), len(held)), held.dtype)]))
        self.sizes[low:high], self.starts[low:high] = sizes, self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : end] = np.fromiter(chain.from_iterable(each), np.int32, end - self.used)
        self.used = end

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which buckets occur in each of up to COUNTED_TEXTS texts and how often, as (text, bucket, times) in the order of first occurrence; words are lower-cased.

        What stands between white space is looked up as it is; it may be several words.
        """
        found = [(t or "").split() for t in texts]
        words = [w for x in found for w in x]
        if len(self.ids) > KEPT_WORDS:
            self._forget()
        if missing := set(words).difference(self.ids):
            self._learn(missing)
        ids = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        n = self.sizes[ids]
        bucket = self.flat[np.repeat(self.starts[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        key = np.repeat(np.repeat(np.arange(len(texts)) * self.buckets, [len(x) for x in found]), n) + bucket
        at = np.arange(len(key), dtype=np.int32)
        self.seen[key[::-1]] = at[::-1]  # the last one written is the first of the text
        of = self.seen[key]
        first = np.flatnonzero(of == at)
        return key[first] // self.buckets, bucket[first], np.bincount(of, minlength=len(of))[first]


@dataclass(frozen=True)
class Embedder:
    """Text vectors of ``dims`` numbers: sums over features of their projection, times log(1 + occurrences), times weight.

    ``weights`` has a number for each bucket, 0 where a feature is masked. A projection has ``ones`` entries of +1 or -1, drawn from the seed.
    """

    weights: np.ndarray
    dims: int
    grams: int
    ones: int
    seed: int

    @property
    def buckets(self) -> int:
        return len(self.weights)

    @property
    def fingerprint(self) -> str:
        """Of all that decides a vector, for caches."""
        return hashlib.md5(self.weights.tobytes() + repr((self.dims, self.grams, self.ones, self.seed)).encode()).hexdigest()

    @cached_property
    def projection(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and signs of each bucket's entries."""
        rng = np.random.default_rng(self.seed)
        return rng.integers(0, self.dims, (self.buckets, self.ones)), rng.choice([-1.0, 1.0], (self.buckets, self.ones))

    def vectors(self, texts: list[str | None], words: Words | None = None) -> np.ndarray:
        """A row for each text; of length one, or 0 where a text has no feature of any weight."""
        words, out = words or Words(self.grams, self.buckets), np.zeros((len(texts), self.dims))
        places, signs = self.projection
        for low in range(0, len(texts), COUNTED_TEXTS):
            part = texts[low : low + COUNTED_TEXTS]
            row, bucket, times = words.counts(part)
            values = (np.log1p(times.astype(np.float64)) * self.weights[bucket])[:, None] * signs[bucket]
            out[low : low + len(part)] = np.bincount((row[:, None] * self.dims + places[bucket]).ravel(), values.ravel(), len(part) * self.dims).reshape(len(part), self.dims)
        norms = np.sqrt((out * out).sum(axis=1))
        return out / np.where(norms > 0, norms, 1)[:, None]

    def embed(self, rows: DataFrame, text: str, vector: str = "vector") -> DataFrame:
        """Rows with a column of vectors; null texts are as empty ones."""
        schema = T.StructType([f for f in rows.schema.fields if f.name != vector] + [T.StructField(vector, T.ArrayType(T.DoubleType()))])
        kept = [f.name for f in schema.fields[:-1]]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = Words(self.grams, self.buckets)
            for batch in batches:
                made = self.vectors(batch.column(text).to_pylist(), words)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, made.size + 1, self.dims), pa.int32()), pa.array(made.ravel()))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], lists], names=schema.names)

        return rows.mapInArrow(run, schema)


def fit(texts: DataFrame, text: str, dims: int = 64, buckets: int = 1 << 16, grams: int = 3, ones: int = 8, most_share: float = 0.5, seed: int = 13) -> Embedder:
    """Weights by inverse document frequency, log(texts / texts that have it), from one aggregation over all texts.

    A feature of more than ``most_share`` of the texts, or of none, is masked. The table of frequencies has a row for each bucket,
    whatever the number of texts; tasks send theirs once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(grams, buckets)
        seen, n = np.zeros(buckets, np.int64), 0
        for batch in batches:
            given = batch.column(0).to_pylist()
            for low in range(0, len(given), COUNTED_TEXTS):
                seen += np.bincount(words.counts(given[low : low + COUNTED_TEXTS])[1], minlength=buckets)
            n += len(given)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *some], pa.int64()), pa.array([n, *seen[some]], pa.int64())], names=["bucket", "n"])

    table = texts.select(F.col(text).cast("string").alias("t")).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    found = dict(zip(table["bucket"].to_pylist(), table["n"].to_pylist(), strict=True))
    whole, weights = found.pop(-1, 0), np.zeros(buckets)
    for bucket, n in found.items():
        if n <= most_share * whole or whole == 1:
            weights[bucket] = np.log(whole / n) if n < whole else 1.0
    return Embedder(weights, dims, grams, ones, seed)
