"""Substring dedup: every word inside a passage that recurs is removed.

A window is WINDOW consecutive words. Within it the smallest hash of its GRAM-word grams is its anchor, so equal
windows have equal anchors, wherever they are, and a document is a stream of pieces: runs of windows with one anchor
(up to 26 windows). All further work goes by anchor:

* an anchor that occurs once cannot lie in a recurring window: these, nearly all, are gone after one count;
* pieces go to the shard of their anchor, equal ones once, with the number of times they occur;
* in each shard windows are counted to confirm which passages recur, one copy of each passage is compiled into an
  Aho-Corasick automaton over words, and all pieces of the shard stream through it. What is removed is what the automaton
  locates, word by word, twice or more in all.

Sending a piece only to the shard that can hold its windows keeps the work in proportion to the text however many
shards there are. Equal pieces cost one stream, and anchors of very many different pieces are dealt anew by window.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Scratch, WordHashes, chunks, hash_words, mix, payload, row_key, signed, small, text_or_empty

WINDOW, GRAM = 35, 10
#: Different pieces that one automaton and its stream are meant for; anchors with more are dealt anew by window.
SHARD_PIECES = 4000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bits of a place that follow those of a hash where the two are packed into one number.
_PLACE_BITS = np.uint64(28)


class Rolling:
    """Hashes of runs of words of any length, from sums of powers modulo 2 ** 64."""

    def __init__(self, flat: np.ndarray):
        n = len(flat)
        power = np.ones(n + 1, np.uint64)
        back = np.ones(n + 1, np.uint64)
        power[1:], back[1:] = _BASE, _INVERSE
        power, self.back = np.multiply.accumulate(power), np.multiply.accumulate(back)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(flat) * power[:n], out=self.sums[1:])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words from start up to, not including, end."""
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def least_places(grams: np.ndarray, span: int) -> np.ndarray:
    """The place of the least hash (its leading bits) among each ``span`` in a row, the first of equal ones.

    Minima up to and from the ends of blocks of ``span`` give that of every run of ``span`` in two steps a number.
    """
    n = len(grams)
    packed = (grams >> _PLACE_BITS << _PLACE_BITS) | np.arange(n, dtype=np.uint64)
    blocks = np.full(-(-n // span) * span, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = packed
    blocks = blocks.reshape(-1, span)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[: n - span + 1], before[span - 1 : n])
    return (least & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)


def pieces(flat: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Of every text its pieces: text, first word in the text, windows, anchor and hash of the piece's words."""
    n, span = len(flat), window - gram + 1
    none = {k: np.zeros(0, np.int64) for k in ("text", "lo", "n", "anchor", "piece")}
    if n < window:
        return none
    if n >> int(_PLACE_BITS):
        raise ValueError("a text has more words than places can be told apart")
    rolling, at = Rolling(flat), np.arange(n - gram + 1)
    grams = rolling.at(at, at + gram)
    first = np.arange(n - window + 1)
    text = np.searchsorted(offsets, first, "right") - 1
    whole = first + window <= offsets[text + 1]
    first, text = first[whole], text[whole]
    if not len(first):
        return none
    place = least_places(grams, span)[whole]
    new = np.ones(len(first), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(first)))
    lo = first[begin]
    words = rolling.at(lo, lo + count + (window - 1))
    inside = (place[begin] - lo).astype(np.uint64)
    return {"text": text[begin], "lo": lo - offsets[text[begin]], "n": count, "anchor": signed(grams[place[begin]]), "piece": signed(mix(words ^ (inside * _BASE)))}


_PIECES = T.StructType([T.StructField(n, T.LongType()) for n in ("_key1", "_key2", "anchor", "piece")] + [T.StructField("lo", T.IntegerType()), T.StructField("n", T.IntegerType())])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> list:
    return row_key(F.col(f"`{id_col}`"), text_or_empty(f"`{text_col}`"))


def all_pieces(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """The pieces of every text."""
    source = docs.select(*_keyed(docs, id_col, text_col), text_or_empty(f"`{text_col}`").alias("text"))

    def run(batches):
        cache = WordHashes()
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                p = pieces(*hash_words([t.split() for t in texts], cache), window)
                keys = [part.column(k).to_numpy(zero_copy_only=False)[p["text"]] for k in ("_key1", "_key2")]
                yield pa.RecordBatch.from_arrays([*map(pa.array, keys), pa.array(p["anchor"]), pa.array(p["piece"]), pa.array(p["lo"].astype(np.int32)), pa.array(p["n"].astype(np.int32))], names=_PIECES.names)

    return source.mapInArrow(run, _PIECES)


def _again(table: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of a table of pieces whose anchors occur twice or more."""
    anchors = table.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2").select("anchor")
    anchors = scratch.save(anchors, "anchors")  # a table of its own, so that the join's hot anchors can be split
    out = scratch.save(table.join(anchors, "anchor"), "recurring")
    scratch.drop(table, anchors)
    return out


def _different(recurring: DataFrame, scratch: Scratch) -> DataFrame:
    """Each piece once: how many ``times`` it occurs, and one of its places (``at``)."""
    out = recurring.groupBy("anchor", "piece").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("_key1", "_key2", "lo", "n")).alias("at"))
    return scratch.save(out, "different")


def _cut(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, schema: T.StructType, rows_of) -> DataFrame:
    """Rows that ``rows_of(words, wanted places)`` makes of each document with places (structs) in ``wanted``."""
    lists = wanted.groupBy("_key1", "_key2").agg(F.collect_set("place").alias("_places"))
    source = docs.select(*_keyed(docs, id_col, text_col), text_or_empty(f"`{text_col}`").alias("text")).join(lists, ["_key1", "_key2"])
    types = [{T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string()}[f.dataType] for f in schema.fields]

    def run(batches):
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                rows: list[tuple] = []
                for k1, k2, text, places in zip(part.column("_key1").to_pylist(), part.column("_key2").to_pylist(), texts, part.column("_places").to_pylist(), strict=True):
                    rows += rows_of(k1, k2, text.split(), places)
                columns = list(zip(*rows, strict=True)) or [[]] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.names)

    return source.mapInArrow(run, schema)


def by_window(docs: DataFrame, crowded: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """The pieces in ``crowded`` as pieces of one window each, whose anchor is the window's hash."""

    def rows_of(k1, k2, words, places):
        flat, _ = hash_words([words], WordHashes())
        lo = np.concatenate([np.arange(p["lo"], p["lo"] + p["n"]) for p in places])
        h = signed(Rolling(flat).at(lo, lo + window)).tolist()
        return [(k1, k2, x, x, at, 1) for x, at in zip(h, lo.tolist(), strict=True)]

    return _cut(docs, crowded.select("_key1", "_key2", F.struct("lo", "n").alias("place")), id_col, text_col, _PIECES, rows_of)


_TEXTS = T.StructType([T.StructField(n, T.LongType()) for n in ("anchor", "piece", "times")] + [T.StructField("words", T.StringType())])


def piece_texts(docs: DataFrame, different: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """The words of each different piece, cut out of one document that has it."""

    def rows_of(k1, k2, words, places):
        return [(p["anchor"], p["piece"], p["times"], b" ".join(words[p["lo"] : p["lo"] + p["n"] + window - 1]).decode()) for p in places]

    place = F.struct("anchor", "piece", "times", F.col("at.lo").alias("lo"), F.col("at.n").alias("n"))
    return _cut(docs, different.select("at._key1", "at._key2", place.alias("place")), id_col, text_col, _TEXTS, rows_of)


def confirmed_passages(words: list[list[bytes]], times: np.ndarray, window: int) -> list[list[bytes]]:
    """One copy of every passage that recurs in pieces with these numbers of occurrences.

    A passage is a run of windows that always occur together: as often as each other and as the run of both. So each
    passage occurs as a whole wherever one of its windows does, and is one pattern.
    """
    flat, offsets = hash_words(words, WordHashes())
    count = np.diff(offsets) - (window - 1)
    piece = np.repeat(np.arange(len(words)), count)
    place = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[piece] + place
    rolling = Rolling(flat)

    def seen(hashes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        return np.bincount(inverse, weights=times[of])[inverse], first[inverse]

    total, first = seen(rolling.at(start, start + window), piece)
    with_next = np.flatnonzero(place + 1 < count[piece])
    both, _ = seen(rolling.at(start[with_next], start[with_next] + window + 1), piece[with_next])
    opens = np.ones(len(piece) + 1, bool)
    opens[with_next + 1] = (both != total[with_next]) | (both != total[with_next + 1])
    begin = np.flatnonzero(opens[:-1])
    end = np.append(begin[1:], len(piece))
    own = (total[begin] >= 2) & (first[begin] == begin)
    return [words[piece[a]][place[a] : place[b - 1] + window] for a, b in zip(begin[own].tolist(), end[own].tolist(), strict=True)]


class PassageAutomaton:
    """An Aho-Corasick automaton over words, compiled from passages."""

    def __init__(self, passages: list[list[bytes]]):
        self.ids: dict[bytes, int] = {}
        self.lengths = np.array([len(p) for p in passages], np.int64)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for i, p in enumerate(passages):
            self.automaton.add_word(tuple(self.ids.setdefault(w, len(self.ids) + 1) for w in p), i)
        if len(passages):
            self.automaton.make_automaton()

    def occurrences(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(last word, passage) of every occurrence in a text."""
        if not len(self.automaton):
            return []
        return list(self.automaton.iter(tuple(self.ids.get(w, 0) for w in words)))


def locate(words: list[list[bytes]], times: np.ndarray, window: int) -> list[list[tuple[int, int]]]:
    """For each piece the ranges (start, length) that recurring passages cover: what the automaton locates twice or more."""
    automaton = PassageAutomaton(confirmed_passages(words, times, window))
    hits = [(k, end, i) for k, w in enumerate(words) for end, i in automaton.occurrences(w)]
    out: list[list[tuple[int, int]]] = [[] for _ in words]
    if not hits:
        return out
    piece, end, passage = np.array(hits, np.int64).T
    often = np.bincount(passage, weights=times[piece])[passage] >= 2
    for k, start, length in zip(piece[often].tolist(), (end + 1 - automaton.lengths[passage])[often].tolist(), automaton.lengths[passage][often].tolist(), strict=True):
        if out[k] and start <= sum(out[k][-1]):  # passages come in the order of their ends
            a = min(out[k][-1][0], start)
            out[k][-1] = (a, max(sum(out[k][-1]), start + length) - a)
        else:
            out[k].append((start, length))
    return out


_RANGES = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("piece", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())])


def located_ranges(texts: DataFrame, shards: int, window: int) -> DataFrame:
    """Ranges of words of each different piece that recurring passages cover, from the automata of all shards."""

    def run(table: pa.Table) -> pa.Table:
        words = [w.split(b" ") for w in table.column("words").cast(pa.binary()).to_pylist()]
        got = locate(words, table.column("times").to_numpy(), window)
        of = np.repeat(np.arange(len(got)), [len(r) for r in got])
        ranges = np.array([x for r in got for x in r], np.int32).reshape(-1, 2)
        return pa.table([table.column("anchor").take(of), table.column("piece").take(of), pa.array(ranges[:, 0]), pa.array(ranges[:, 1])], names=_RANGES.names)

    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")
    return texts.select("anchor", "piece", "times", "words", shard).groupBy("shard").applyInArrow(run, _RANGES)


def covered_ranges(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Per row key (see ``row_key``) the ranges (``start``, ``length``) of words that recurring windows cover."""
    recurring = _again(scratch.save(all_pieces(docs, id_col, text_col, window), "pieces"), scratch)
    different = _different(recurring, scratch)
    crowded = scratch.save(different.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > shard_pieces).select("anchor"), "crowded")
    if n := crowded.count():
        # pieces of crowded anchors are dealt anew by window, which equal windows share too; as they were they have no ranges
        single = _again(scratch.save(by_window(docs, recurring.join(small(crowded, n), "anchor"), id_col, text_col, window), "windows"), scratch)
        others = _different(single, scratch)
        whole = different.join(small(crowded, n), "anchor", "left_anti").unionByName(others)
    else:
        single = others = None
        whole = different
    texts = scratch.save(piece_texts(docs, whole, id_col, text_col, window), "texts")
    scratch.drop(different, crowded, *([others] if others else []))
    ranges = scratch.save(located_ranges(texts, max(1, texts.count() // shard_pieces), window), "ranges")
    scratch.drop(texts)
    placed = recurring if single is None else recurring.unionByName(single)
    placed = placed.join(ranges, ["anchor", "piece"]).select("_key1", "_key2", (F.col("lo") + F.col("start")).alias("start"), "length")
    covered = scratch.save(placed.groupBy("_key1", "_key2").agg(F.collect_set(F.struct("start", "length")).alias("ranges")), "covered")
    scratch.drop(recurring, ranges, *([single] if single else []))
    return covered


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per input row: ``doc`` (all columns but the text), ``kept_text``, ``n_words``, ``n_removed``.

    Each word that lies in a window whose words also start anywhere else, in the same text included, is removed;
    kept words are joined by one space. Windows are judged on the input. Null and empty texts have no words; texts
    shorter than a window keep all; repeated rows are occurrences of each other's windows, so they lose all words
    from a window's length on. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "phrases")
    covered = covered_ranges(docs, scratch, id_col, text_col, window, shard_pieces)
    source = docs.select(*_keyed(docs, id_col, text_col), payload(docs, text_col).alias("doc"), text_or_empty(f"`{text_col}`").alias("text"))
    joined = source.join(covered, ["_key1", "_key2"], "left").select("doc", "text", "ranges")
    schema = T.StructType([source.schema["doc"], T.StructField("kept_text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def run(batches):
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                kept, total, gone = [], [], []
                for text, ranges in zip(texts, part.column("ranges").to_pylist(), strict=True):
                    words = text.split()
                    total.append(len(words))
                    if ranges:
                        step = np.zeros(len(words) + 1, np.int64)
                        np.add.at(step, [r["start"] for r in ranges], 1)
                        np.add.at(step, [r["start"] + r["length"] for r in ranges], -1)
                        words = [words[i] for i in np.flatnonzero(np.cumsum(step)[:-1] == 0)]
                    gone.append(total[-1] - len(words))
                    kept.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=schema.names)

    return joined.mapInArrow(run, schema)


def substring_query(spark, sf_dir: str) -> DataFrame:
    """op9: the digest columns of :func:`remove_repeated_passages` over the whole of ``documents``."""
    out = remove_repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(F.col("doc.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


SQL = rf"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (SELECT r, p, md5(array_to_string(w[p:p + {WINDOW - 1}], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS p FROM w WHERE len(w) >= {WINDOW})
), again AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1
), gone AS (SELECT DISTINCT r, unnest(range(p, p + {WINDOW})) AS i FROM win SEMI JOIN again USING (h)
), word AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM w
), kept AS (SELECT word.r, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone ON word.r = gone.r AND word.i = gone.i GROUP BY word.r
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (r)
"""
