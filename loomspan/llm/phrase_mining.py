"""Phrase collocation mining by pivot partitioning: each phrase is counted where its rarest word is at home.

Three passes. Words are counted per language, combined in each task first. Then every text is rewritten: words that are too
rare for any phrase become gaps, and each occurrence of a word, the pivot, sends the run around it that holds no rarer word, and
to its left not the pivot either, so that a phrase is sent once for each of its occurrences. Last, the fragments of a bucket of pivots are mined by one
task, which reports only phrases whose rarest word is the pivot; so no phrase below the threshold leaves a task.

A pivot that occurs very often is split by the hash of its fragments; its phrases then come as partial counts and are summed.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, chunks, mix, small, text_or_empty

#: Distinct words that a task counts before it passes them on.
COUNTED_WORDS = 300_000
#: Most words whose numbers are broadcast, the most frequent ones; rarer ones are numbered by a join.
COMMON_WORDS = 1_000_000
#: Occurrences of one pivot beyond which its fragments are split, and of all pivots in a bucket, about.
PIVOT_OCCURRENCES, BUCKET_OCCURRENCES = 1_000_000, 500_000
#: Fragments that a task gathers, to combine equal ones, before it passes them on.
HELD_FRAGMENTS = 400_000
#: Candidates, about, that one task ranks before the languages are ranked as wholes.
RANKED_TOGETHER = 50_000

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_SPACED = bytes.maketrans(_BREAKS + b"\t", b" " * (len(_BREAKS) + 1))
_BROKEN = bytes.maketrans(_BREAKS + b"\t", b"\n" * len(_BREAKS) + b" ")
#: Stands for the end of a piece; no UTF-8 text has this byte.
_END = b"\xff"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), text_or_empty(f"`{text_col}`").alias("text"))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each language with their counts; the row without a word has the number of all."""
    found: dict[str, Counter] = defaultdict(Counter)

    def rows() -> pa.RecordBatch:
        langs = [lang for lang, words in found.items() for _ in range(len(words) + 1)]
        words = [w for c in found.values() for w in (None, *c)]
        counts = [n for c in found.values() for n in (c.total(), *c.values())]
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], ["lang", "word", "n"])

    for batch in batches:
        for part, texts in chunks(batch, "text"):
            for lang, text in zip(part.column(0).to_pylist(), texts, strict=True):
                found[lang].update(text.lower().translate(_SPACED).split())
            if sum(map(len, found.values())) > COUNTED_WORDS:
                yield rows()
    yield rows()


def word_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, word, n: every word of every language with its occurrences; the row with a null word has the sum of a language."""
    counted = _texts(docs, text_col, lang_col).mapInArrow(_count_words, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def grouped(rows: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a matrix of numbers, and the sums of their ``times``; equal hashes are compared number by number."""
    h = np.zeros(len(rows), np.uint64)
    for c in range(rows.shape[1]):
        h = (h ^ rows[:, c].astype(np.uint64)) * _FACTOR
        h ^= h >> np.uint64(29)
    order = np.argsort(h)
    h, rows, times = h[order], rows[order], times[order]
    new = np.ones(len(rows), bool)
    new[1:] = h[1:] != h[:-1]
    if (rows[1:][~new[1:]] != rows[:-1][~new[1:]]).any():  # two rows of one hash: order by the numbers themselves
        order = np.lexsort(rows.T)
        rows, times = rows[order], times[order]
        new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    first = np.flatnonzero(new)
    return rows[first], np.add.reduceat(times, first) if len(first) else times


def fragments(ids: np.ndarray, width: int) -> np.ndarray:
    """Rows of 2 * width - 1 numbers: a pivot in the middle, what it sends of its neighbours beside it, 0 where nothing.

    ``ids`` are the words of texts by rank, 1 the most frequent; 0 stands for gaps, the ends of pieces and of texts.
    """
    reach, n = width - 1, len(ids)
    padded = np.concatenate([np.zeros(reach, np.int64), ids, np.zeros(reach, np.int64)])
    out = np.zeros((n, 2 * width - 1), np.int64)
    out[:, reach] = ids
    left = right = ids > 0
    for j in range(1, width):
        near = padded[reach - j : reach - j + n]
        left = left & (near > 0) & (near < ids)
        out[:, reach - j] = np.where(left, near, 0)
        near = padded[reach + j : reach + j + n]
        right = right & (near > 0) & (near <= ids)
        out[:, reach + j] = np.where(right, near, 0)
    return out[(out[:, reach - 1] > 0) | (out[:, reach + 1] > 0)]


def _planes(x: np.ndarray) -> bytes:
    """Numbers with all their first bytes first, then the second ones, and so on: mostly zeros, which shuffles compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _from_planes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


_PACKED = "bucket long, shapes binary, times binary, words binary"


def _packed(rows: np.ndarray, splits: np.ndarray, buckets: int) -> pa.RecordBatch:
    """The fragments of each bucket as one row: sizes of both sides, how often, and the words one after the other."""
    rows, times = grouped(rows, np.ones(len(rows), np.int64))
    width = (rows.shape[1] + 1) // 2
    pivot = rows[:, width - 1]
    parts = np.where(pivot < len(splits), splits[np.minimum(pivot, len(splits) - 1)], 1).astype(np.uint64)
    h = mix((rows.astype(np.uint64) * np.arange(1, 4 * width - 1, 2, dtype=np.uint64) * _FACTOR).sum(axis=1, dtype=np.uint64))
    bucket = (mix(mix(pivot.astype(np.uint64)) + h % parts) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, rows, times = bucket[order], rows[order], times[order]
    shapes = ((rows[:, : width - 1] > 0).sum(axis=1) * width + (rows[:, width:] > 0).sum(axis=1)).astype(np.uint8)
    ends = np.cumsum((rows > 0).sum(axis=1))
    words = rows[rows > 0]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, np.int64)
    out: tuple[list, list, list, list] = ([], [], [], [])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        out[0].append(int(bucket[a]))
        out[1].append(shapes[a:b].tobytes())
        out[2].append(_planes(times[a:b]))
        out[3].append(_planes(words[(ends[a - 1] if a else 0) : ends[b - 1]]))
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *[pa.array(x, pa.binary()) for x in out[1:]]], ["bucket", "shapes", "times", "words"])


def _unpacked(shapes: bytes, times: bytes, words: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    shape = np.frombuffer(shapes, np.uint8).astype(np.int64)
    place = np.arange(2 * width - 1) - (width - 1)
    ids = _from_planes(words, "int64")
    rows = np.zeros((len(shape), 2 * width - 1), np.int32 if ids.max(initial=0) < 2**31 else np.int64)
    rows[(place >= -(shape // width)[:, None]) & (place <= (shape % width)[:, None])] = ids
    return rows, _from_planes(times, "int64")


def mined(rows: np.ndarray, times: np.ndarray, splits: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Phrases that the pivots in the middle own, and their counts: those of at least ``least``, or all of pivots that are split."""
    width = (rows.shape[1] + 1) // 2
    for n in range(2, width + 1):
        for before in range(n):
            a, b = width - 1 - before, width - 1 - before + n
            has = (rows[:, a] > 0) & (rows[:, b - 1] > 0)
            if has.any():
                phrases, counts = grouped(rows[has, a:b], times[has])
                pivot = phrases[:, before]
                kept = (counts >= least) | ((pivot < len(splits)) & (splits[np.minimum(pivot, len(splits) - 1)] > 1))
                yield phrases[kept], counts[kept]


def _mine_buckets(width: int, least: int, splits: np.ndarray):
    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def rows() -> Iterator[pa.RecordBatch]:
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            for phrases, counts in mined(*whole, splits, least):
                n = phrases.shape[1]
                ids = pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(phrases) + 1, n), pa.int32()), pa.array(phrases.reshape(-1).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(counts)], ["ids", "a"])

        for batch in batches:  # in the order of buckets
            for bucket, *packed in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if bucket != now and held:
                    yield from rows()
                now = bucket
                held.append(_unpacked(*packed, width))
        if held:
            yield from rows()

    return mine


class _Numbers(dict):
    """Numbers of words; 0 for those without one."""

    def __missing__(self, word: bytes) -> int:
        return 0


def _numbered(tokens: list[bytes], numbers: _Numbers) -> np.ndarray:
    return np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens))


def _tokens(text: bytes) -> list[bytes]:
    """Words of a text, and a mark at the end of each piece."""
    return (text.lower().translate(_BROKEN) + b"\n").replace(b"\n", b" \xff ").split()


def _tables(common) -> dict[str, _Numbers]:
    out: dict[str, _Numbers] = defaultdict(_Numbers)
    for k, (lang, word) in enumerate(common.value, 1):
        out[lang][word] = k
    return out


def _held(pieces: Iterator[np.ndarray], width: int, splits: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for ids in pieces:
        rows = fragments(ids, width)
        n += len(rows)
        held.append(rows)
        if n > HELD_FRAGMENTS:
            yield _packed(np.concatenate(held), splits, buckets)
            held, n = [], 0
    if n:
        yield _packed(np.concatenate(held), splits, buckets)


def _send_common(common, width: int, splits: np.ndarray, buckets: int):
    """Fragments of texts all of whose phrase words are broadcast."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _tables(common)

        def pieces() -> Iterator[np.ndarray]:
            for batch in batches:
                for part, texts in chunks(batch, "text", 500_000):
                    langs = part.column(0).to_pylist()
                    yield np.concatenate([_numbered(_tokens(t), numbers[lang]) for lang, t in zip(langs, texts, strict=True)])

        yield from _held(pieces(), width, splits, buckets)

    return send


def _leave_rare(common):
    """Texts as numbers, with the words that no broadcast number is known for and their places."""

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _tables(common)
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                out: list[list] = [[], [], []]
                for lang, text in zip(part.column(0).to_pylist(), texts, strict=True):
                    tokens = _tokens(text)
                    ids = _numbered(tokens, numbers[lang])
                    rare = [k for k in np.flatnonzero(ids == 0).tolist() if tokens[k] != _END]
                    for column, x in zip(out, (ids.tobytes(), [tokens[k] for k in rare], rare), strict=True):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out[0], pa.binary()), pa.array(out[1], pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array(out[2], pa.list_(pa.int32()))], ["lang", "ids", "words", "places"])

    return leave


def _send_numbered(width: int, splits: np.ndarray, buckets: int):
    """Fragments of texts as numbers, with the numbers of rarer words put in their places."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[np.ndarray]:
            for batch in batches:
                for ids, rare in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    text = np.frombuffer(ids, np.int64).copy()
                    for x in rare or ():
                        text[x["place"]] = x["id"]
                    yield text

        yield from _held(pieces(), width, splits, buckets)

    return send


def _fragments_of(texts: DataFrame, frequent: DataFrame, known: int, scratch: Scratch, width: int) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Packed fragments of all texts, the numbers of the words (id, lang, word, n), and the splits of the most frequent ones."""
    spark = texts.sparkSession
    order = [F.desc("n"), F.asc("lang"), F.asc("word")]
    common = frequent.orderBy(*order).limit(COMMON_WORDS).toArrow()  # at most COMMON_WORDS of them, whatever the corpus
    counts = common["n"].to_numpy()  # falling
    splits = np.concatenate([[1], -(-counts[counts > PIVOT_OCCURRENCES] // PIVOT_OCCURRENCES)])  # by number; the others are 1
    numbers = scratch.save(spark.createDataFrame(common.append_column("id", pa.array(range(1, len(common) + 1), pa.int64()))).select("id", "lang", "word", "n"), "common")
    total = frequent.agg(F.sum("n")).first()[0] or 0
    buckets = 1 + total // BUCKET_OCCURRENCES
    sent = spark.sparkContext.broadcast(list(zip(common["lang"].to_pylist(), common["word"].cast(pa.binary()).to_pylist(), strict=True)))
    if known <= COMMON_WORDS:
        return texts.mapInArrow(_send_common(sent, width, splits, buckets), _PACKED), numbers, splits
    # Rarer words get larger numbers in the same order, and reach their places by a join; none of them is frequent enough to be a hot key.
    rare = frequent.join(numbers.select("lang", "word"), ["lang", "word"], "left_anti").repartitionByRange(*order).sortWithinPartitions(*order)
    rare = scratch.save(rare.select((F.monotonically_increasing_id() + COMMON_WORDS + 1).alias("id"), "lang", "word", "n"), "rare")
    left = texts.mapInArrow(_leave_rare(sent), "lang string, ids binary, words array<string>, places array<int>")
    left = scratch.save(left.withColumn("row", F.monotonically_increasing_id()), "numbered")
    places = left.select("row", "lang", F.explode(F.arrays_zip("words", "places")).alias("x")).select("row", "lang", F.col("x.words").alias("word"), F.col("x.places").alias("place"))
    found = places.join(rare.select("id", "lang", "word"), ["lang", "word"]).groupBy("row").agg(F.collect_list(F.struct("place", "id")).alias("rare"))  # of one text
    put = left.select("row", "ids").join(found, "row", "left").select("ids", "rare")
    return put.mapInArrow(_send_numbered(width, splits, buckets), _PACKED), numbers.unionByName(rare), splits


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = 5, min_count: int = 100) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, size, a: every phrase of up to ``max_words`` words, single ones too, found ``min_count`` times or more; and lang, n: all words.

    A-Z are lower-cased; a null text is empty, a null language is ``und``. Phrases lie within pieces (between ``.,;:!?`` and line ends) and their
    occurrences may overlap. Repeated rows count as often as they are there. Empty tables and texts have no phrases.
    """
    scratch = Scratch(docs.sparkSession, "phrases")
    texts = _texts(docs, text_col, lang_col)
    counted = scratch.save(word_counts(docs, text_col, lang_col).filter(F.col("word").isNull() | (F.col("n") >= min_count)), "words")
    totals = counted.filter(F.col("word").isNull()).select("lang", "n")
    frequent = counted.filter(F.col("word").isNotNull())
    known = frequent.count()
    packed, numbers, splits = _fragments_of(texts, frequent, known, scratch, max_words)
    dealt = packed.repartition("bucket").sortWithinPartitions("bucket")
    found = dealt.mapInArrow(_mine_buckets(max_words, min_count, splits), "ids array<bigint>, a long")
    found = scratch.save(found.groupBy("ids").agg(F.sum("a").alias("a")).filter(F.col("a") >= min_count), "found")
    spelled = found.select("ids", "a", F.posexplode("ids").alias("at", "id")).join(small(numbers.select("id", "lang", "word"), known), "id")
    spelled = spelled.groupBy("ids").agg(F.first("lang").alias("lang"), F.first("a").alias("a"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("_w"))  # max_words of them
    phrases = spelled.select("lang", F.array_join(F.transform("_w", lambda x: x["word"]), " ").alias("phrase"), F.size("ids").alias("size"), "a")
    phrases = scratch.save(phrases.unionByName(frequent.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), F.col("n").alias("a"))), "phrases")
    return phrases, totals


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = 5, min_count: int = 100, top: int = 2000, absorb_percent: int = 100) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of two words or more by score.

    A phrase's score is that of its weakest cut in two, floor(1000 * a * n / (l * r)), in exact decimal arithmetic (38 digits). Phrases that a
    longer one absorbs, with ``absorb_percent`` hundredths of their count or more, are left out. A phrase inside a longer one is
    at least as frequent, so looking one word further is enough. Nulls, ties and empty inputs as in :func:`frequent_phrases`.
    """
    phrases, totals = frequent_phrases(docs, text_col, lang_col, max_words, min_count)
    candidates = phrases.filter("size > 1")
    longer = candidates.filter("size > 2").select("lang", F.explode(F.array(F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring_index(phrase, ' ', 1 - size)"))).alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    kept = candidates.join(longer, ["lang", "phrase"], "left").filter(F.coalesce(F.col("_longer") * 100 < F.col("a") * absorb_percent, F.lit(True)))
    cuts = kept.select("lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("_left"), F.expr("substring_index(phrase, ' ', k - size)").alias("_right"))
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("_left"), F.col("a").alias("l")), ["lang", "_left"]).join(phrases.select("lang", F.col("phrase").alias("_right"), F.col("a").alias("r")), ["lang", "_right"])
    cuts = cuts.join(totals, "lang").withColumn("score", F.expr("cast(1000 as decimal(4, 0)) * (cast(a as decimal(19, 0)) * cast(n as decimal(19, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"))
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("_c")).select("lang", "phrase", "a", "_c.l", "_c.r", "n", "_c.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(1 + candidates.count() // RANKED_TOGETHER))
    first = scored.withColumn("_part", part).withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("_rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocation_query(spark, sf_dir: str) -> DataFrame:
    """op13: :func:`collocations` of the whole of ``documents``."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"), max_words=5, min_count=100, top=2000, absorb_percent=100)


SQL = r"""
WITH pieces AS (
  SELECT lang, doc, row_number() OVER () AS piece, list_filter(string_split_regex(p, '[ \t]+'), lambda w: w <> '') AS w
  FROM (SELECT lang, doc, unnest(string_split_regex(text, '[.,;:!?\n\x0B\f\r]')) AS p FROM (
    SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents))
), places AS (
  SELECT lang, piece, w, unnest(range(1, len(w) + 1)) AS spot FROM pieces WHERE len(w) > 0
), grams AS (
  SELECT lang, m AS size, array_to_string(list_slice(w, spot, spot + m - 1), ' ') AS phrase FROM places, range(1, 6) AS t(m) WHERE spot + m - 1 <= len(w)
), f AS (
  SELECT lang, size, phrase, count(*) AS a FROM grams GROUP BY ALL
), total AS (
  SELECT lang, sum(a)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang
), c AS (
  SELECT * FROM f WHERE size > 1 AND a >= 100
), cuts AS (
  SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, n, (1000::HUGEINT * c.a * n // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, size)) AS k, string_split(phrase, ' ') AS w FROM c) c
  JOIN f l ON l.lang = c.lang AND l.size = k AND l.phrase = array_to_string(list_slice(w, 1, k), ' ')
  JOIN f r ON r.lang = c.lang AND r.size = c.size - k AND r.phrase = array_to_string(list_slice(w, k + 1, c.size), ' ')
  JOIN total ON total.lang = c.lang
), weakest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), absorbed AS (
  SELECT DISTINCT s.lang, s.phrase FROM c s JOIN c l ON l.lang = s.lang AND l.size > s.size AND 100 * l.a >= 100 * s.a
    AND contains(' ' || l.phrase || ' ', ' ' || s.phrase || ' ')
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM weakest ANTI JOIN absorbed USING (lang, phrase)
QUALIFY rank <= 2000
"""
