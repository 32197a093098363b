"""Helpers shared by the operators of this subpackage: shared storage, words, shingles and hashes.

A word is a maximal run of characters other than space and U+0009 to U+000D. On UTF-8 bytes this is
exactly what ``bytes.split()`` does, and ``bytes.lower()`` lower-cases exactly A-Z.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.sources.scratch import Scratch as Scratch

#: Bytes of text that a Python worker turns into words at a time; bounds its memory.
CHUNK_BYTES = 2_000_000
#: Entries of a word-hash cache before it is emptied.
CACHE_WORDS = 100_000
#: Most rows of a table of numbers that is broadcast.
BROADCAST_ROWS = 300_000
#: White space inside and around words, as the contracts define it.
SPACES = " \t\n\x0b\x0c\r"


def small(table: DataFrame, rows: int) -> DataFrame:
    """To be broadcast if it has few rows (of two or three numbers each); else it is shuffled as any table."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def text_or_empty(name: str):
    """The text column, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch of about ``limit`` bytes of text each, with the texts as UTF-8 bytes (null: empty)."""
    at = batch.schema.get_field_index(column)
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    if not len(sizes):
        return
    marks = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), len(sizes)]
    for a, b in itertools.pairwise(cuts):
        part = batch.slice(a, b - a)
        yield part, [x or b"" for x in part.column(at).cast(pa.binary()).to_pylist()]
    pa.default_memory_pool().release_unused()  # else a worker keeps what its largest batch took


class WordHashes(dict):
    """64-bit hash of each word, kept for words met again; emptied when large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


#: Odd multipliers that give each place of a shingle its own mixing.
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)

_SALT = np.arange(1, 128, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values over all bits; a bijection."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def hash_words(words: list[list[bytes]], cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a chunk, and the offset at which each text begins (one more at the end)."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    offsets = np.concatenate([[0], np.cumsum(lens)])
    flat = np.fromiter(map(cache.__getitem__, itertools.chain.from_iterable(words)), np.uint64, int(offsets[-1]))
    return flat, offsets


def roll(flat: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words that start at each place (the last k - 1 places are meaningless)."""
    n = len(flat)
    out = np.zeros(n, np.uint64)
    if n >= k:
        acc = out[: n - k + 1]
        for j in range(k):
            acc += mix(flat[j : n - k + 1 + j] + _SALT[j % len(_SALT)]) * _PLACE[(j + 2) % 5]
        out[: n - k + 1] = mix(acc)
    return out


def shingles(flat: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text its k-word shingle hashes in order; a text of fewer words is one shingle, an empty one none."""
    rolled = roll(flat, k)
    out = []
    for a, b in itertools.pairwise(offsets.tolist()):
        if b - a >= k:
            out.append(rolled[a : b - k + 1])
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(flat[a:b].tobytes(), seed=b - a)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signed(x: np.ndarray) -> np.ndarray:
    """As Spark's bigint."""
    return np.ascontiguousarray(x).view(np.int64)


def payload(docs: DataFrame, *drop: str) -> F.Column:
    """All columns but those named, as one struct that no name inside an operator can clash with."""
    rest = [c for c in docs.columns if c not in drop]
    return F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(None).cast("string").alias("_none"))


def row_key(*columns) -> list:
    """Two independent 64-bit hashes of the columns: together a key for rows that are equal in them."""
    return [F.xxhash64(F.lit(11), *columns).alias("_key1"), F.xxhash64(F.lit(29), *columns).alias("_key2")]
