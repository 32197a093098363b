"""Containment search: MinHash bands over overlapping windows retrieve short texts that lie inside long ones.

Short texts are parted by size. For a part whose largest has n shingles, documents are cut into blocks of s = ceil(n / 2)
shingles and every three blocks in a row are a window, so each run of n shingles lies in one window as a whole.
Rows per band are the most for which a short text that is contained at the threshold is missed with a
probability of at most MISS; whatever is retrieved is then verified on the words themselves. With one row per band, which
is the rule, a text torn into pieces far apart is found as surely: each hash's least shingle lies in some window.

Before that an exact filter: a text of n shingles that is contained at the threshold can lack few of them, so one of its rarest ones,
as many as it can lack and one more, is in the document. Bands retrieve only texts with such a shingle there. So
a frame that thousands of short texts share, such as a question's, does not retrieve them all.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import WordHashes, chunks, hash_words, mix, payload, shingles, text_or_empty

HASHES, MISS, SHINGLE, THRESHOLD = 64, 2e-5, 5, 0.8
#: Shingles of retrieved short texts that a worker keeps for verification.
KNOWN_SHINGLES = 300_000
#: Largest number of shingles of each part; it goes on by a factor of 3 as far as there are short texts.
PART_BOUNDS = (2, 8, 24, 72, 216, 648, 1944)

_MULTIPLIERS = (mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)).astype(np.uint64)
_SALTS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_shingles(words: list[bytes], k: int = SHINGLE) -> list[tuple]:
    """Shingles in order; fewer than k words are one shingle, no words none."""
    if not words:
        return []
    return list(zip(*(words[i:] for i in range(k)))) if len(words) >= k else [tuple(words)]


def rows_per_band(similarity: float) -> int:
    """The most rows for which HASHES hashes miss a pair of that similarity with probability MISS at most."""
    best = 1
    for r in (2, 3, 4):
        if missed(similarity, r) <= MISS:
            best = r
    return best


def missed(similarity: float, rows: int) -> float:
    """The probability that no band of so many rows finds a pair of that similarity."""
    return (1 - similarity**rows) ** (HASHES // rows)


def part_bounds(largest: int) -> list[int]:
    """:data:`PART_BOUNDS`, carried on by a factor of 3 until one is no less than ``largest``."""
    bounds = list(PART_BOUNDS)
    while bounds[-1] < largest:
        bounds.append(3 * bounds[-1])
    return bounds


def hashed(x: np.ndarray, j: int) -> np.ndarray:
    """The j-th hash of each shingle, 32 bits."""
    return (((x ^ _SALTS[j]) * _MULTIPLIERS[j]) >> np.uint64(32)).astype(np.uint32)


@dataclass
class Part:
    """Short texts of about one size: band keys in order, and the text of each, numbered within the part; ``first`` is the index's number of the first."""

    stride: int
    rows: int
    ids: np.ndarray
    sizes: np.ndarray
    first: int = 0
    values: list[np.ndarray] = field(default_factory=list)
    order: list[np.ndarray] = field(default_factory=list)
    maybe: list[np.ndarray] = field(default_factory=list)

    def build(self, flat: np.ndarray) -> None:
        """From the shingle hashes of all texts, one text after the other."""
        begins = np.cumsum(self.sizes) - self.sizes
        for b in range(HASHES // self.rows):
            keys = band_key([np.minimum.reduceat(hashed(flat, j), begins) for j in range(b * self.rows, (b + 1) * self.rows)])
            order = np.argsort(keys, kind="stable")
            self.values.append(keys[order])
            self.order.append(order.astype(np.int32))
            some = np.zeros(1 << 16, bool)
            some[keys >> np.uint32(16)] = True
            self.maybe.append(some)


def band_key(minima: list[np.ndarray]) -> np.ndarray:
    if len(minima) == 1:
        return minima[0]
    acc = np.zeros(len(minima[0]), np.uint64)
    for m in minima:
        acc = mix(acc ^ m.astype(np.uint64))
    return (acc >> np.uint64(32)).astype(np.uint32)


class Rarest:
    """The shingles of short texts that at least one of must be in a document which contains the text at the threshold.

    Rare is what few of the texts have. ``values`` are these shingles' hashes in order; those of the k-th have ``texts[begins[k]:begins[k + 1]]``.
    """

    def __init__(self, hashes: list[np.ndarray], threshold: float):
        sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        of = np.repeat(np.arange(len(hashes)), sizes)
        _, at, shared = np.unique(flat, return_inverse=True, return_counts=True)
        order = np.lexsort((flat, shared[at], of))
        begins = np.cumsum(sizes) - sizes
        lacking = sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64)
        kept = order[np.arange(len(flat)) - begins[of] <= lacking[of]]
        kept = kept[np.argsort(flat[kept], kind="stable")]
        self.texts = of[kept].astype(np.int32)
        new = np.flatnonzero(np.concatenate([[True], flat[kept][1:] != flat[kept][:-1]])) if len(kept) else np.zeros(0, np.int64)
        self.values, self.begins = flat[kept][new], np.append(new, len(kept))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.values >> np.uint64(44)] = True

    def of(self, per_text: list[np.ndarray]) -> dict[int, np.ndarray]:
        """For each place of a document the numbers of the short texts, in order, that have one of their shingles there."""
        lens = np.fromiter(map(len, per_text), np.int64, len(per_text))
        flat = np.concatenate(per_text)
        near = np.flatnonzero(self.maybe[flat >> np.uint64(44)])
        if not len(near) or not len(self.values):
            return {}
        at = np.minimum(np.searchsorted(self.values, flat[near]), len(self.values) - 1)
        hit = self.values[at] == flat[near]
        doc = np.repeat(np.arange(len(lens)), lens)[near[hit]]
        pairs = np.unique(np.stack([doc, at[hit]], 1), axis=0)
        out: dict[int, list[np.ndarray]] = {}
        for d, k in pairs.tolist():
            out.setdefault(d, []).append(self.texts[self.begins[k] : self.begins[k + 1]])
        return {d: np.unique(np.concatenate(x)) for d, x in out.items()}


class WindowIndex:
    """An index of short texts, given as {id: words}; texts without words are in none of its parts.

    It holds 8 bytes a band and text, 12 for each shingle of the filter, and the words: shingles to verify with are made when a text is first retrieved.
    """

    def __init__(self, texts: dict[int, list[bytes]], threshold: float = THRESHOLD):
        self.threshold = threshold
        self.texts = {i: b" ".join(w) for i, w in texts.items() if w}
        self._known: dict[int, frozenset] = {}
        self._held = 0
        cache = WordHashes()
        hashes = {i: np.unique(shingles(*hash_words([texts[i]], cache), SHINGLE)[0]) for i in self.texts}
        largest = max(map(len, hashes.values()), default=0)
        self.parts, low = [], 0
        for high in part_bounds(largest):
            self._add(hashes, low, high)
            low = high
        self.ids, numbered = np.zeros(0, np.int64), []
        for part in self.parts:
            part.first = len(self.ids)
            self.ids = np.concatenate([self.ids, part.ids])
            numbered += [hashes[i] for i in part.ids.tolist()]
        self.rarest = Rarest(numbered, threshold)

    def _add(self, hashes: dict[int, np.ndarray], low: int, high: int) -> None:
        """Parts of the texts of more than ``low`` and at most ``high`` shingles, cut finer where one would miss more than MISS."""
        own = {i: h for i, h in hashes.items() if low < len(h) <= high}
        if not own:
            return
        least, stride = min(map(len, own.values())), -(-high // 2)
        held = np.ceil(self.threshold * least)
        similarity = held / (3 * stride + least - held)
        rows = rows_per_band(similarity)
        if missed(similarity, rows) > MISS:
            if high - low == 1:
                raise ValueError(f"{HASHES} hashes miss more than {MISS} of the texts of {high} shingles at a threshold of {self.threshold}")
            middle = max(low + 1, int((max(low, 1) * high) ** 0.5))
            self._add(hashes, low, middle)
            self._add(hashes, middle, high)
            return
        part = Part(stride, rows, np.array(list(own), np.int64), np.array([len(h) for h in own.values()], np.int64))
        part.build(np.concatenate(list(own.values())))
        self.parts.append(part)

    def shingles_of(self, i: int) -> frozenset:
        """The shingles of a text, kept for the next time within a bound."""
        known = self._known.get(i)
        if known is None:
            if self._held > KNOWN_SHINGLES:
                self._known.clear()
                self._held = 0
            known = self._known[i] = frozenset(word_shingles(self.texts[i].split(b" ")))
            self._held += len(known)
        return known

    def candidates(self, per_text: list[np.ndarray]) -> set[tuple[int, int]]:
        """(place of the text, id of the short text) that share a band in some window, and one of the short text's rarest shingles."""
        if not sum(map(len, per_text)):
            return set()
        able = self.rarest.of(per_text)
        if not able:
            return set()
        places = sorted(able)
        per_text = [per_text[p] for p in places]
        able_here = [able[p] for p in places]
        lens = np.fromiter(map(len, per_text), np.int64, len(per_text))
        flat, begins = np.concatenate(per_text), np.cumsum(lens) - lens
        grids, before = [], None
        for part in self.parts:
            count = -(-lens // part.stride)
            text = np.repeat(np.arange(len(lens)), count)
            place = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
            # blocks that hold whole blocks of the part before take the least of these
            nested = before is not None and part.stride % before[0] == 0
            first, step = (before[1], part.stride // before[0]) if nested else (begins, part.stride)
            at = np.repeat(first, count) + step * place
            last = np.cumsum(count)[count > 0] - 1
            grids.append((text, at, nested, last, np.cumsum(count)[count > 1] - 2))
            before = part.stride, np.cumsum(count) - count
        found: set[tuple[int, int]] = set()
        held: list[list[np.ndarray]] = [[] for _ in self.parts]
        for j in range(HASHES):
            h = hashed(flat, j)
            m = h
            for part, (text, at, nested, last, next_to_last), rows in zip(self.parts, grids, held, strict=True):
                m = np.minimum.reduceat(m if nested else h, at) if part.stride > 1 else h
                w = m.copy()  # of each block and the two after it, then mended where a text ends
                np.minimum(w[:-1], m[1:], out=w[:-1])
                np.minimum(w[:-2], m[2:], out=w[:-2])
                w[last] = m[last]
                w[next_to_last] = np.minimum(m[next_to_last], m[next_to_last + 1])
                rows.append(w)
                if len(rows) < part.rows:
                    continue
                band = j // part.rows
                if band < len(part.values):
                    keys = band_key(rows)
                    near = np.flatnonzero(part.maybe[band][keys >> np.uint32(16)])
                    if len(near):
                        values = part.values[band]
                        lo, hi = np.searchsorted(values, keys[near], "left"), np.searchsorted(values, keys[near], "right")
                        for k in np.flatnonzero(hi > lo):
                            t, same = int(text[near[k]]), part.order[band][lo[k] : hi[k]]  # in order
                            wanted = able_here[t] - part.first
                            wanted = wanted[(wanted >= same[0]) & (wanted <= same[-1])]
                            wanted = wanted[same[np.minimum(np.searchsorted(same, wanted), len(same) - 1)] == wanted]
                            found.update((places[t], o) for o in part.ids[wanted].tolist())
                rows.clear()
        return found

    def verified(self, words: list[bytes], ids: list[int]) -> list[tuple[int, int, int, int, int]]:
        """(id, its shingles, shared ones, first word, last word) of those contained at the threshold, by id."""
        places: dict[tuple, list[int]] = {}
        for p, s in enumerate(word_shingles(words)):
            if s in places:
                places[s][1] = p
            else:
                places[s] = [p, p]
        out = []
        for i in sorted(ids):
            own = self.shingles_of(i)
            shared = [places[s] for s in own if s in places]
            if len(shared) >= self.threshold * len(own) - 1e-9:
                out.append((i, len(own), len(shared), min(a for a, _ in shared), min(max(b for _, b in shared) + SHINGLE, len(words)) - 1))
        return out


MATCH = T.StructType([T.StructField(n, T.LongType()) for n in ("id", "n_shingles", "n_shared", "first_word", "last_word")])
_ARROW_MATCH = pa.list_(pa.struct([(n, pa.int64()) for n in MATCH.names]))


def search(docs: DataFrame, index: WindowIndex, split, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per input row: ``doc`` (all columns but the text), ``matches``, and the ``text`` if asked for.

    ``split`` makes words of UTF-8 bytes. The index goes to every executor, so it must be of bounded size.
    """
    source = docs.select(payload(docs, text_col).alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    fields = [source.schema["doc"], T.StructField("matches", T.ArrayType(MATCH)), *([T.StructField("text", T.StringType())] if keep_text else [])]

    def run(batches):
        cache = WordHashes()
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                words = [split(t) for t in texts]
                per_text = shingles(*hash_words(words, cache), SHINGLE)
                hits: dict[int, list[int]] = {}
                for t, i in index.candidates(per_text):
                    hits.setdefault(t, []).append(i)
                rows = [[dict(zip(MATCH.names, m)) for m in index.verified(words[t], hits[t])] if t in hits else [] for t in range(len(words))]
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(rows, _ARROW_MATCH), *([part.column("text")] if keep_text else [])], names=[f.name for f in fields])

    return source.mapInArrow(run, T.StructType(fields))
