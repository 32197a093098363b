"""Spelling variants: words of texts grouped with the more frequent words that differ from them by one letter.

A symmetric-delete join. Every word emits itself and its single deletions under hashed keys. Words with a common key and the same
deleted place differ by one replaced letter; a word whose own key is another's deletion differs from it by one inserted letter. Words are numbered by falling
frequency, so the best neighbour of a word is the smallest number in its groups, and counts and best neighbours of a group come from windows
over it: no pairs of a group are made. Each member is then compared, letter by letter, with the one it was grouped with.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, chunks, mix, signed, text_or_empty

#: Distinct words that a task counts before it passes them on, and letters whose keys it makes at a time.
COUNTED_WORDS, HELD_LETTERS = 300_000, 500_000
#: One occurrence in so many, by its hash, is read with a letter missing.
MISREAD_ONE_IN = 97

#: Characters from two bytes on, but for U+00C0 to U+00FF.
_OTHER = re.compile(rb"[\xc2\xc4-\xf4][\x80-\xbf]+")
_LETTERS = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))


def runs(text: bytes) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF of a text in UTF-8, A-Z lower-cased."""
    return _OTHER.sub(b" ", text.lower()).translate(_LETTERS).split()


def _misread(word: bytes, h: int) -> bytes:
    letters = word.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def _count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()

    def rows() -> pa.RecordBatch:
        out = [pa.array(found.keys(), pa.binary()).cast(pa.string()), pa.array(found.values(), pa.int64())]
        found.clear()
        return pa.RecordBatch.from_arrays(out, ["word", "n"])

    for batch in batches:
        for part, texts in chunks(batch, "text"):
            for doc, text in zip(part.column(0).to_pylist(), texts, strict=True):
                words = runs(text)
                hashes = np.fromiter(map(zlib.crc32, words, repeat(zlib.crc32(f"{doc}:".encode()))), np.int64, len(words))
                for k in np.flatnonzero(hashes % MISREAD_ONE_IN == 0).tolist():
                    words[k] = _misread(words[k], int(hashes[k]))
                found.update(words)
            if len(found) > COUNTED_WORDS:
                yield rows()
    yield rows()


def run_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the letter runs of all texts, with the contract's dropped letters, and how often each occurs."""
    texts = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), text_or_empty(f"`{text_col}`").alias("text"))
    return texts.mapInArrow(_count_runs, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes, the deleted place (-1: the whole word), the word's place in the list and ``fresh``, for each word and each of its letters.

    A hash is a sum over letters and their places, so that all deletions of a word cost its length. ``fresh`` is false where the
    letter before is the same: the deletion is one that was there already.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    begins = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(letters)) - begins[of]
    same = np.concatenate([[False], letters[1:] == letters[:-1]])[: len(letters)] & (at > 0)
    keys = []
    for seed in (0x51ED270B, 0x7F4A7C15):
        here = mix((letters << np.uint64(32)) + at.astype(np.uint64) + np.uint64(seed << 53 & 0xFFFFFFFFFFFFFFFF) + np.uint64(seed))
        moved = mix((letters << np.uint64(32)) + (at - 1).astype(np.uint64) + np.uint64(seed << 53 & 0xFFFFFFFFFFFFFFFF) + np.uint64(seed))
        before, after = np.concatenate([np.zeros(1, np.uint64), np.cumsum(here)]), np.concatenate([np.zeros(1, np.uint64), np.cumsum(moved)])
        whole = before[begins + sizes] - before[begins]
        cut = before[begins[of] + at] - before[begins][of] + after[(begins + sizes)[of]] - after[begins[of] + at + 1]
        keys.append(np.concatenate([whole, cut]))
    return keys[0], keys[1], np.concatenate([np.full(len(words), -1), at]), np.concatenate([np.arange(len(words)), of]), np.concatenate([np.ones(len(words), bool), ~same])


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, words = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        marks = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) // HELD_LETTERS
        for a, b in pairwise([0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), len(words)]):
            if b > a:
                k1, k2, at, of, fresh = deletion_keys(words[a:b])
                yield pa.RecordBatch.from_arrays([pa.array(signed(k1)), pa.array(signed(k2)), pa.array(at.astype(np.int32)), pa.array(ids[a:b][of]), pa.array(fresh)], ["k1", "k2", "at", "id", "fresh"])


def near_words(words: DataFrame) -> DataFrame:
    """id, n_near, best: of every word (id, word) with a near one, how many it has and the smallest id of them.

    A group of words that differ in one place has at most as many members as there are letters, and a word at most that many deletions of longer ones for
    each of its places; windows hold them on disk if need be.
    """
    keys = words.select("id", "word").mapInArrow(_emit_keys, "k1 long, k2 long, at int, id long, fresh boolean")
    whole, place = Window.partitionBy("k1", "k2"), Window.partitionBy("k1", "k2", "at")
    cut = (F.col("at") >= 0) & F.col("fresh")
    linked = keys.select("*", F.max(F.when(F.col("at") < 0, F.col("id"))).over(whole).alias("_shorter"), F.count(F.when(cut, 1)).over(whole).alias("_n_longer"), F.min(F.when(cut, F.col("id"))).over(whole).alias("_longer"))
    linked = linked.select("*", F.count(F.lit(1)).over(place).alias("_n_place"), F.min("id").over(place).alias("_first"), F.lead("id").over(place.orderBy("id")).alias("_next"))
    beside = F.when(F.col("at") < 0, F.lit(None)).when(F.col("id") == F.col("_first"), F.col("_next")).otherwise(F.col("_first"))
    linked = linked.select("id", "at", beside.alias("beside"), F.when(F.col("at") >= 0, F.col("_n_place") - 1).otherwise(F.lit(0)).alias("n_beside"), F.when(cut, F.col("_shorter")).alias("shorter"), F.when(F.col("at") < 0, F.col("_longer")).alias("longer"), F.when(F.col("at") < 0, F.col("_n_longer")).otherwise(F.lit(0)).alias("n_longer"))
    # A row for each claim: the word loses its letter at a place and is ``other`` then (shorter), or is ``other`` without its letter there (beside). What is longer is claimed by the longer one.
    claims = linked.filter(F.coalesce("beside", "shorter", "longer").isNotNull())
    checked = claims.join(words.select("id", "word"), "id")
    for name in ("beside", "shorter"):
        checked = checked.join(words.select(F.col("id").alias(name), F.col("word").alias(f"_{name}")), name, "left")
    rest = F.expr("concat(left(word, at), substring(word, at + 2))")
    right = F.coalesce(F.expr("concat(left(_beside, at), substring(_beside, at + 2))") == rest, F.lit(True)) & F.coalesce(F.col("_shorter") == rest, F.lit(True)) & F.coalesce(F.col("_beside") != F.col("word"), F.lit(True))
    n = F.col("n_beside") + F.col("n_longer") + F.col("shorter").isNotNull().cast("long")
    counted = checked.select("id", F.when(right, n).otherwise(F.raise_error(F.lit("two words of one 128-bit key are not at distance one")).cast("long")).alias("n"), F.least("beside", "shorter", "longer").alias("best"))
    return counted.groupBy("id").agg(F.sum("n").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """id, to: the last word that each word with a form (id, to) leads to, by doubling the steps of all in each round.

    Frequencies double at least from word to form, so chains have at most 63 steps, and there are seven rounds at most.
    """
    steps = scratch.save(forms.select("id", "to"), "steps")
    while True:
        on = steps.select(F.col("id").alias("to"), F.col("to").alias("_to"))
        further = scratch.save(steps.join(on, "to", "left").select("id", F.coalesce("_to", "to").alias("to"), F.col("_to").isNotNull().alias("moved")), "steps")
        scratch.drop(steps)
        steps = further
        if steps.filter("moved").isEmpty():
            return steps.select("id", "to")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 5, min_count: int = 3, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n: a row for every word of at least ``min_chars`` letters and ``min_count`` occurrences.

    ``form`` is the near word that is most frequent (ties: the smallest by code points) if it is at least ``ratio`` times as frequent as the word, else null; ``root`` is
    where forms lead to. Null texts have no words; an occurrence in a row without id is hashed with an empty one. Repeated
    rows count again. Empty tables and texts give no rows.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    counts = run_counts(docs, id_col, text_col).filter((F.col("n") >= min_count) & (F.length("word") >= min_chars))
    counts = scratch.save(counts, "counts")
    order = [F.desc("n"), F.asc("word")]
    words = scratch.save(counts.repartitionByRange(*order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    near = scratch.save(near_words(words), "near")
    named = words.select(F.col("id").alias("to"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    forms = words.join(near, "id").withColumnRenamed("best", "to").join(named, "to").filter(F.col("form_n") >= ratio * F.col("n")).select("id", "to", "form", "form_n")
    forms = scratch.save(forms, "forms")
    last = roots(forms, scratch).join(words.select(F.col("id").alias("to"), F.col("word").alias("root")), "to").select("id", "root")
    out = words.join(near.select("id", "n_near"), "id", "left").join(forms.select("id", "form", "form_n"), "id", "left").join(last, "id", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def spelling_query(spark, sf_dir: str) -> DataFrame:
    """op12: :func:`spelling_variants` of the whole of ``documents``."""
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), min_chars=5, min_count=3, ratio=2)


#: The checksum is worked out byte by byte from a table that the query makes itself.
SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc, r, count(*) AS m FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS r FROM documents) GROUP BY ALL
), hashed AS (
  SELECT r, m, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(doc || ':' || r, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195, unicode(x)::BIGINT - 64] END))),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h FROM runs, tab
), words AS (
  SELECT word, sum(m)::BIGINT AS n FROM (SELECT m, CASE WHEN h % 97 = 0 THEN left(r, h % length(r)) || substring(r, h % length(r) + 2) ELSE r END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(m) >= 3
), cut AS (
  SELECT word, i, left(word, i) || substring(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cut c JOIN words w ON w.word = c.rest
  UNION SELECT w.word, c.word FROM cut c JOIN words w ON w.word = c.rest
), best AS (
  SELECT near.word, count(*) AS n_near, arg_min(near.other, (-o.n, encode(near.other))) AS other FROM near JOIN words o ON o.word = near.other GROUP BY near.word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, f.word AS form, f.n AS form_n FROM words w LEFT JOIN best b ON b.word = w.word LEFT JOIN words f ON f.word = b.other AND f.n >= 2 * w.n
), steps AS (
  SELECT word, word AS root, form AS next FROM formed
  UNION ALL SELECT s.word, f.word, f.form FROM steps s JOIN formed f ON f.word = s.next
)
SELECT f.word, form, root, n, n_near, form_n FROM formed f JOIN steps s ON s.word = f.word AND s.next IS NULL
"""
