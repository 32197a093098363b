"""N-gram Jaccard join: size-aware, with subsets enumerated for small sets and inverted lists scanned for large ones.

Sets of distinct word shingles link when their Jaccard similarity is at least PERCENT / 100. Sets of sizes a and b then
share at least c = ceil(PERCENT (a + b) / (100 + PERCENT)) shingles and differ in at most a + b - 2 c. Pairs whose smaller
set is below a boundary are found by enumerating the subsets of exactly those sizes, which two linked sets have in
common. For other pairs each set is parted by the shingles' hashes into more parts than linked sets can differ in; they have
a part in common, and inverted lists go by the content of parts. (Lists over single shingles are as exact, but in
growing corpora unrelated texts meet in ever more of them.) The boundary is where subsets begin to cost more than parts.

Equal sets are one node from the start. Links are never enumerated within a group of near copies: in each list every
node is held against one node of it, groups grow, and only pairs across groups are considered after that, until none
is left unverified. Long lists are cut into blocks there, and pairs of blocks are dealt over tasks. So no link between
different groups is lost, and the work follows the number of texts.
"""

from __future__ import annotations

import itertools
from functools import cache
from math import comb, exp

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Scratch, WordHashes, chunks, hash_words, mix, payload, row_key, shingles, signed, small, text_or_empty
from .window_search import word_shingles

WIDTH, PERCENT = 3, 90
#: Ratio of the bounds of size classes; sets of one class have equally many parts.
CLASS_RATIO = 1.5
STAR_ROUNDS, STAR_PICKS = 3, 4
#: Nodes of a list that are held against each other in one task; a longer list is cut into blocks, and each pair of blocks is a task's.
LIST_ROWS = 1000
#: 64-bit words of a set's sketch.
SKETCH = 16


def shared_least(a: int, b: int, percent: int = PERCENT) -> int:
    """The least overlap of linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


def subset_sizes(size: int, boundary: int, percent: int = PERCENT) -> list[int]:
    """Sizes of the subsets that a set enumerates: the least overlaps with partners, the smaller below the boundary."""
    partners = range(-(-percent * size // 100), 100 * size // percent + 1)
    return sorted({shared_least(size, b, percent) for b in partners if min(size, b) < boundary})


def most_different(high: int, percent: int = PERCENT) -> int:
    """The most shingles in which linked sets, both smaller than ``high``, can differ."""
    return 2 * (high - 1) * (100 - percent) // (100 + percent)


def boundary_by_cost(percent: int = PERCENT) -> int:
    """The least size for which enumerating subsets makes more keys than parting the set."""
    s = 1
    while sum(comb(s, c) for c in subset_sizes(s, s + 1, percent)) <= most_different(int(s * CLASS_RATIO) + 1, percent) + 3:
        s += 1
    return s


@cache
def size_class(i: int, boundary: int, percent: int) -> tuple[int, int, int, int]:
    """Of the i-th class of sizes: its bounds, the number of parts, and how many of them may be left out if empty.

    With ``spare`` parts more than needed, linked sets have more than ``spare`` parts in common; so a set with no more empty
    parts than that need not enter its empty parts in lists.
    """
    low = boundary
    for _ in range(i):
        low = int(low * CLASS_RATIO) + 1
    high = int(low * CLASS_RATIO) + 1
    needed = most_different(high, percent) + 1
    spare = 2 + int(1.5 * needed * exp(-low / needed))
    return low, high, needed + spare, spare


@cache
def _cuts(parts: int) -> np.ndarray:
    return np.array([(1 << 64) * i // parts for i in range(1, parts)], np.uint64)


def _sets(texts: list[bytes], hashes: WordHashes, width: int) -> list[np.ndarray]:
    return [np.unique(x) for x in shingles(*hash_words([t.lower().split() for t in texts], hashes), width)]


def entries(s: np.ndarray, boundary: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the lists that a set (sorted hashes) enters, and with each how many such lists a linked set has to share."""
    n = len(s)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    keys, needs, sums = [], [], np.zeros(n + 1, np.uint64)
    whole = mix(s)
    np.cumsum(whole, out=sums[1:])
    if -(-percent * n // 100) < boundary:
        for c in subset_sizes(n, boundary, percent):
            gone = n - c
            left = sums[n:] - (np.zeros(1, np.uint64) if gone == 0 else np.array([whole[list(i)].sum(dtype=np.uint64) for i in itertools.combinations(range(n), gone)], np.uint64))
            keys.append(mix(left ^ np.uint64(c * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)))
            needs.append(np.ones(len(left), np.int32))
    i, largest = 0, 100 * n // percent
    while size_class(i, boundary, percent)[1] <= n:
        i += 1
    while n >= boundary and size_class(i, boundary, percent)[0] <= largest:
        _, high, parts, spare = size_class(i, boundary, percent)
        own, empty = _part_keys(s, sums, parts, spare, i)
        partner = min(largest, high - 1)
        need = parts - (n + partner) * (100 - percent) // (100 + percent) - min(empty, spare)
        keys.append(own)
        needs.append(np.full(len(own), max(need, 1), np.int32))
        i += 1
    return (np.concatenate(keys), np.concatenate(needs)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int32))


def _part_keys(s: np.ndarray, sums: np.ndarray, parts: int, spare: int, i: int) -> tuple[np.ndarray, int]:
    """Keys of the parts, without the empty ones if they are few; and how many are empty."""
    ends = np.concatenate([[0], np.searchsorted(s, _cuts(parts)), [len(s)]])
    keys = mix((sums[ends[1:]] - sums[ends[:-1]]) ^ mix(np.arange(parts, dtype=np.uint64) + np.uint64((i + 1) << 32)))
    filled = ends[1:] > ends[:-1]
    empty = int(parts - filled.sum())
    return keys[filled] if empty <= spare else keys, empty


def _sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the numbers of shingles in 64 SKETCH cells: sketches differ in no more bits than sets in shingles."""
    odd = np.bincount((mix(s) >> np.uint64(58 - SKETCH.bit_length() + 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


_BITS = [f"p{i}" for i in range(SKETCH)]


def set_rows(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, boundary: int) -> DataFrame:
    """Per row: id, row key, digest of its set (null if empty), size, sketch and keys of lists."""
    source = docs.select(F.col(f"`{id_col}`").alias("id"), *row_key(F.col(f"`{id_col}`"), text_or_empty(f"`{text_col}`")), text_or_empty(f"`{text_col}`").alias("text"))
    schema = T.StructType([source.schema["id"], *[T.StructField(k, T.LongType()) for k in ("_key1", "_key2")], T.StructField("digest", T.BinaryType()), T.StructField("n", T.LongType()), *[T.StructField(p, T.LongType()) for p in _BITS], T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("needs", T.ArrayType(T.IntegerType()))])

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                sets = _sets(texts, hashes, width)
                found = [entries(s, boundary, percent) for s in sets]
                ends = pa.array(np.concatenate([[0], np.cumsum([len(k) for k, _ in found])]).astype(np.int32))
                bits = np.stack([_sketch(s) for s in sets])
                keys = pa.ListArray.from_arrays(ends, pa.array(signed(np.concatenate([k for k, _ in found]))))
                needs = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x for _, x in found])))
                digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("_key1"), part.column("_key2"), digests, pa.array([len(s) for s in sets], pa.int64()), *[pa.array(np.ascontiguousarray(bits[:, i])) for i in range(SKETCH)], keys, needs], names=schema.names)

    return source.mapInArrow(run, schema)


def _distance(a: str, b: str):
    """Bits in which two sketches differ."""
    return sum((F.bit_count(F.col(f"{a}.{p}").bitwiseXOR(F.col(f"{b}.{p}"))) for p in _BITS), F.lit(0))


def _may_link(a: str, b: str, percent: int):
    """What sizes and sketches leave possible; false only where sets cannot link."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    most = F.floor((na + nb) * F.lit(100 - percent) / F.lit(float(100 + percent)) + F.lit(1e-9))
    return (F.lit(100) * F.least(na, nb) >= F.lit(percent) * F.greatest(na, nb)) & (_distance(a, b) <= most)


class _Join:
    """State of one run: the tables in the shared folder."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, width: int, percent: int):
        self.docs, self.id_col, self.text_col, self.width, self.percent = docs, id_col, text_col, width, percent
        self.scratch, self.done = Scratch(docs.sparkSession, "jaccard"), []

    def groups(self) -> tuple[DataFrame, DataFrame]:
        """Rows (id, row key, digest, n) and nodes (digest, group, lowest id of the group)."""
        save, drop = self.scratch.save, self.scratch.drop
        sets = save(set_rows(self.docs, self.id_col, self.text_col, self.width, self.percent, boundary_by_cost(self.percent)).withColumn("row", F.monotonically_increasing_id()), "sets")
        rows = save(sets.select("row", "id", "_key1", "_key2", "digest", "n"), "rows")
        alike = sets.filter("n > 0").groupBy("digest").agg(F.min("id").alias("low"), F.min(F.struct("row", "_key1", "_key2")).alias("text_of"), *[F.any_value(c).alias(c) for c in ("n", *_BITS)])
        self.nodes = save(alike.withColumn("node", F.col("text_of.row")), "nodes")
        copies = save(rows.join(self.nodes.select("digest", "node"), "digest").filter("row != node").select("row"), "copies")
        first = sets.join(small(copies, copies.count()), "row", "left_anti")
        posted = first.select(F.col("row").alias("node"), F.explode(F.arrays_zip("keys", "needs")).alias("e")).select("node", F.col("e.keys").alias("key"), F.col("e.needs").alias("need"))
        shared = posted.groupBy("key").agg(F.count(F.lit(1)).alias("_m")).filter("_m > 1")
        shared = save(shared, "shared")  # a table of its own, so that the join's hot keys can be split
        drop()
        # Linked sets share at least ``need`` lists. Of those of a set the need - 1 fullest can be left: the emptiest shared one stays in both.
        fullest = F.row_number().over(Window.partitionBy("node", "need").orderBy(F.col("_m").desc(), "key"))
        kept = posted.join(shared, "key").withColumn("_at", fullest).filter(F.col("_at") >= F.col("need"))
        self.lists = save(kept.select("key", "node"), "lists")
        drop(sets, shared, copies)
        label = save(self.lists.select("node").distinct().withColumn("label", F.col("node")), "labels")
        tried = None
        for r in range(STAR_ROUNDS):
            pairs = save(self._stars(label, r, tried), "stars")
            if pairs.isEmpty():
                break
            label, tried = self._merge(label, pairs, tried)
        for nearest in (True, True, False):
            pairs = save(self._across(label, tried, nearest), "across")
            label, tried = self._merge(label, pairs, tried)
        named = self.nodes.select("digest", "node", "low").join(label, "node", "left").withColumn("group", F.coalesce("label", "node"))
        lowest = named.groupBy("group").agg(F.min("low").alias("lowest"))
        named = save(named.select("digest", "group").join(lowest, "group"), "named")
        drop(self.lists, self.nodes, label, *self.done)
        return rows, named

    def _labelled(self, label: DataFrame) -> DataFrame:
        """Entries of lists that hold more than one group, with their node's label; other lists never will again."""
        full = self.lists.select("key", "node").join(label, "node")
        split = full.groupBy("key").agg(F.min("label").alias("_a"), F.max("label").alias("_b")).filter("_a != _b").select("key")
        open_ = self.scratch.save(full.join(split, "key", "left_semi"), "open")
        self.scratch.drop(self.lists)
        self.lists = open_
        return open_

    def _stars(self, label: DataFrame, r: int, tried: DataFrame | None) -> DataFrame:
        """In each list every node with one node drawn by hash; of the STAR_PICKS of these with which it shares most lists, the nearest."""
        full = self._labelled(label) if r else self.lists.withColumn("label", F.col("node"))
        drawn = full.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(r)).alias("h"), "node", "label")).alias("a"))
        met = full.join(drawn, "key").filter(F.col("a.label") != F.col("label"))
        met = met.groupBy(F.col("a.node").alias("a"), F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("_m"))
        turn = F.row_number().over(Window.partitionBy("b").orderBy(F.col("_m").desc(), "a"))
        most = met.withColumn("_t", turn).filter(F.col("_t") <= STAR_PICKS + 1)
        pairs = self._untried(most, tried).withColumn("_t", turn).filter(F.col("_t") <= STAR_PICKS).select("a", "b")
        for side in ("a", "b"):
            known = self.nodes.select(F.col("node").alias(side), F.struct("n", *_BITS).alias(f"s{side}"))
            pairs = pairs.join(known, side)
        near = pairs.filter(_may_link("sa", "sb", self.percent)).groupBy("b").agg(F.min_by("a", F.struct(_distance("sa", "sb").alias("d"), "a")).alias("a"))
        return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def _across(self, label: DataFrame, tried: DataFrame | None, nearest: bool) -> DataFrame:
        """Pairs of different groups that share a list and may link: all nodes against those outside the list's largest group.

        With ``nearest`` only the nearest untried one for each node and other group, which mostly joins them.
        """
        full = self._labelled(label).join(self.nodes.select("node", "n", *_BITS), "node")
        sizes = full.groupBy("key", "label").agg(F.count(F.lit(1)).alias("_m"))
        largest = self.scratch.save(sizes.groupBy("key").agg(F.max_by("label", F.struct("_m", "label")).alias("_main"), F.ceil(F.sum("_m") / LIST_ROWS).cast("int").alias("_blocks")), "largest")
        self.done.append(largest)
        one = full.select("key", F.struct("node", "label", "n", *_BITS).alias("b"))
        other = full.join(largest, "key").filter(F.col("label") != F.col("_main")).select("key", F.struct("node", "label", "n", *_BITS).alias("a"))
        cut = largest.filter("_blocks > 1").select("key", "_blocks")
        n, by = cut.count(), ["key"]
        if n:
            one, other, by = self._in_blocks(one, "b", small(cut, n)), self._in_blocks(other, "a", small(cut, n)), ["key", "_x", "_y"]
        pairs = one.join(other, by).filter((F.col("a.label") != F.col("b.label")) & _may_link("a", "b", self.percent))
        if nearest:
            met = pairs.select(F.col("a.node").alias("a"), F.col("b.node").alias("b"), F.col("b.label").alias("l"), _distance("a", "b").alias("d"))
            turn = F.row_number().over(Window.partitionBy("a", "l").orderBy("d", "b"))
            met = met.groupBy("a", "b", "l").agg(F.min("d").alias("d")).withColumn("_t", turn).filter(F.col("_t") <= 3)
            pairs = self._untried(met, tried).groupBy("a", "l").agg(F.min_by("b", F.struct("d", "b")).alias("b"))
            return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = pairs.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()
        return self._untried(pairs, tried)

    @staticmethod
    def _in_blocks(side: DataFrame, name: str, cut: DataFrame) -> DataFrame:
        """A side of the join of lists, long lists cut into blocks of nodes: (``_x``, ``_y``) are the blocks of a and of b."""
        own, other = ("_x", "_y") if name == "a" else ("_y", "_x")
        blocks = F.coalesce("_blocks", F.lit(1))
        dealt = side.join(cut, "key", "left").withColumn(own, F.pmod(F.xxhash64(F.lit(3), f"{name}.node"), blocks).cast("int"))
        return dealt.withColumn(other, F.explode(F.sequence(F.lit(0), blocks - 1))).drop("_blocks")

    def _untried(self, pairs: DataFrame, tried: DataFrame | None) -> DataFrame:
        if tried is None:
            return pairs
        known = pairs.withColumns({"_x": F.least("a", "b"), "_y": F.greatest("a", "b")})
        return known.join(tried.select(F.col("a").alias("_x"), F.col("b").alias("_y")), ["_x", "_y"], "left_anti").drop("_x", "_y")

    def _texts(self, pairs: DataFrame) -> DataFrame:
        """The text of every node in ``pairs``."""
        used = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = self.scratch.save(used.join(self.nodes.select("node", "text_of"), "node").select("node", F.col("text_of._key1").alias("_key1"), F.col("text_of._key2").alias("_key2")), "wanted")
        n = wanted.count()
        wanted = small(wanted, n)
        text = text_or_empty(f"`{self.text_col}`")
        source = self.docs.select(*row_key(F.col(f"`{self.id_col}`"), text), text.alias("text"))
        texts = self.texts = self.scratch.save(source.join(wanted, ["_key1", "_key2"]).select("node", "text"), "texts")
        return texts.dropDuplicates(["node"]) if texts.count() > n else texts  # rows may be repeated

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """Pairs with ``linked``, from the words of both texts."""
        texts = self._texts(pairs)
        width, percent = self.width, self.percent
        one = texts.withColumnsRenamed({"node": "a", "text": "text_a"}).join(small(pairs, pairs.count()), "a")
        both = one.join(texts.withColumnsRenamed({"node": "b", "text": "text_b"}), "b")

        def run(batches):
            last: dict[str, tuple] = {}

            def of(side: str, node: int, text: str) -> frozenset:
                if last.get(side, (None,))[0] != node:
                    last[side] = (node, frozenset(word_shingles(text.encode().lower().split(), width)))
                return last[side][1]

            for batch in batches:
                linked = []
                for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True):
                    one, two = of("a", a, x), of("b", b, y)
                    both_n = len(one & two)
                    linked.append(100 * both_n >= percent * (len(one) + len(two) - both_n))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

        return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint, linked boolean")

    def _merge(self, label: DataFrame, pairs: DataFrame, tried: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Verifies the pairs and joins the groups of those that link; returns labels and all pairs tried so far."""
        if pairs.isEmpty():
            return label, tried if tried is not None else pairs.withColumn("linked", F.lit(False))
        done = self.scratch.save(self._verified(pairs), "verified")
        linked = done.filter("linked")
        at = label.withColumnsRenamed({"node": "_n", "label": "_l"})
        edges = linked.join(at, F.col("a") == F.col("_n")).select(F.col("_l").alias("x"), "b").join(at, F.col("b") == F.col("_n")).select("x", F.col("_l").alias("y")).filter("x != y").distinct()
        renamed = components(edges, self.scratch)
        new = label.join(renamed, label["label"] == renamed["v"], "left").select("node", F.coalesce("c", "label").alias("label"))
        new = self.scratch.save(new, "labels")
        self.done += [done, pairs]
        self.scratch.drop(label, renamed, self.texts)
        return new, done if tried is None else tried.unionByName(done)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, c): for each vertex of the edges (x, y) the least vertex of its component.

    Every round takes the least label among neighbours and then the label's own label, so long chains shorten fast.
    """
    both = scratch.save(edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    state = scratch.save(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("c")).select(F.col("x").alias("v"), "c"), "components")
    while True:
        now = state.select("v", "c")
        near = both.join(now, both["y"] == now["v"]).groupBy("x").agg(F.min("c").alias("m"))
        lower = now.join(near, now["v"] == near["x"]).select("v", F.col("c").alias("was"), F.least("c", "m").alias("c"))
        jump = now.select(F.col("v").alias("_v"), F.col("c").alias("_c"))
        new = scratch.save(lower.join(jump, lower["c"] == jump["_v"]).select("v", "was", F.least("c", "_c").alias("c")), "components")
        scratch.drop(state)
        state = new
        if new.filter("c != was").isEmpty():
            scratch.drop(both)
            return state


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per input row: ``id``, ``_key1``, ``_key2`` (row key), ``n_shingles``, ``group`` and ``component_id``.

    A-Z are lower-cased; a text of fewer than ``width`` words is one shingle; null and empty texts have none, link with
    nothing and have a null ``group`` and their own id as ``component_id``. Otherwise that is the smallest id that links
    reach, null ids left aside. Repeated rows are equal sets, hence of one group. An empty table gives no rows.
    """
    rows, nodes = _Join(docs, id_col, text_col, width, percent).groups()
    out = rows.join(nodes, "digest", "left")
    return out.select("id", "_key1", "_key2", F.col("n").alias("n_shingles"), "group", F.when(F.col("n") > 0, F.col("lowest")).otherwise(F.col("id")).alias("component_id"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` with all columns, of every group only one: texts without words, in no group, all stay.

    The one is that with the smallest id, a null id only if all are null; of different texts under one id, that with the
    smaller hash; of rows equal in id and text, one whose other columns, written as JSON, come first. An empty table stays empty.
    """
    found = jaccard_groups(docs, id_col, text_col, width, percent)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "_key1", "_key2")
    first = found.filter("n_shingles > 0").groupBy("group").agg(F.min(order).alias("k")).select("k._key1", "k._key2")
    text = text_or_empty(f"`{text_col}`")
    base = docs.select(*row_key(F.col(f"`{id_col}`"), text), payload(docs, text_col).alias("doc"), F.col(f"`{text_col}`").alias("_text"))
    kept = base.join(first, ["_key1", "_key2"], "left_semi").groupBy("_key1", "_key2").agg(F.min_by(F.struct("doc", "_text"), F.to_json("doc")).alias("_row")).select("_key1", "_key2", "_row.*")
    wordless = base.filter(~F.coalesce(F.col("_text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return kept.unionByName(wordless).select(*[F.col("_text").alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in docs.columns])


def jaccard_query(spark, sf_dir: str) -> DataFrame:
    """op5: the digest columns of :func:`jaccard_groups` over the whole of ``documents``."""
    out = jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), e AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b USING (s) JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  WHERE 100 * least(na.n, nb.n) >= 90 * greatest(na.n, nb.n) GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 90 * (na.n + nb.n - count(*))
), r AS (SELECT doc_id AS x, doc_id AS c FROM w UNION SELECT e.y, r.c FROM r JOIN e USING (x) WHERE r.c < e.y
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(c) AS c FROM r GROUP BY x) m ON m.x = w.doc_id
"""
