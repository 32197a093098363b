"""Exact top-k search by inner product, with vectors in buckets of similar length.

Buckets go from long vectors to short ones and are cut into slices of bounded size. Every query first meets the slices of the longest vectors, which
gives it a score that its k-th best must reach. A score over both lengths is a cosine, so in a bucket that score is a local cosine threshold: above 1
the bucket is skipped, and with it all shorter ones; where it is high, only vectors whose largest coordinates lie in the
interval that such a cosine allows are looked at; where it is low, vectors are scanned by falling length. What remains is multiplied out exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

#: Vectors of a bucket are at least so long, as a part of its upper bound.
LENGTH_RATIO = 0.9
#: Numbers in a slice of vectors, and in a block of queries, about: they bound what a task holds.
SLICE_NUMBERS, BLOCK_NUMBERS = 512_000, 1_000_000
#: From this local cosine threshold on coordinates prune, below it lengths; and the coordinates looked at.
COORDINATE_COSINE, FOCUS = 0.75, 3
#: Queries and vectors that are multiplied at a time.
QUERY_TILE, VECTOR_TILE = 256, 4096

_LEAST, _MOST = -(2**63), 2**63 - 1
#: Room for rounding in bounds on lengths and cosines, which are doubles.
_SLACK = 1e-9
_FOUND = "query long, query_id long, vec_id long, score long"


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """id, v, length: floor(scale * x) of every component x as doubles, and the Euclidean length.

    Rows with a null id or vector, or with a component that is null or not finite (scaled neither), are left out.
    """
    scaled = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double") * F.lit(scale))
    v = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), scaled.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    v = v.filter(F.forall("v", lambda x: F.coalesce(F.abs(x) < F.lit(math.inf), F.lit(False))))
    v = v.select("id", F.transform("v", lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)).alias("v"))
    most = F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0.0))
    sum_of_squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / F.col("_most")) * (x / F.col("_most")))
    return v.withColumn("_most", most).select("id", "v", F.when(F.col("_most") > 0, F.col("_most") * F.sqrt(sum_of_squares)).otherwise(F.lit(0.0)).alias("length"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of numbers as rows; shorter ones are filled with zeros."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width))
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def products(q: np.ndarray, c: np.ndarray, exact: bool) -> np.ndarray:
    """All inner products as 64-bit integers; ``exact``: no sum of a product reaches 2**53. Larger ones are added as Python's integers and kept within 64 bits."""
    if exact:
        return (q @ c.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(q) @ whole(c).T, _LEAST + 1, _MOST).astype(np.int64) if q.size and c.size else np.zeros((len(q), len(c)), np.int64)


class Best:
    """The k best of each query so far, and the score that others must reach (ties go to the smaller id)."""

    def __init__(self, k: int, least: np.ndarray):
        self.k, self.least = k, least.copy()
        self.query, self.id, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        query, ids, score = (np.concatenate(x) for x in ((self.query, query), (self.id, ids), (self.score, score)))
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
        rank = np.arange(len(query)) - np.repeat(first, np.diff([*first, len(query)]))
        full = rank == self.k - 1
        self.least[query[full]] = np.maximum(self.least[query[full]], score[full])
        kept = rank < self.k
        self.query, self.id, self.score = query[kept], ids[kept], score[kept]


def _by_length(rows: np.ndarray, q, ids_q, len_q, c, ids_c, len_c, best: Best, exact: bool) -> None:
    """Vectors by falling length, as far as a query's threshold reaches."""
    for a in range(0, len(c), VECTOR_TILE):
        tile = slice(a, a + VECTOR_TILE)
        rows = rows[len_q[rows] * len_c[a] * (1 + _SLACK) >= best.least[rows]]
        for at in range(0, len(rows), QUERY_TILE):
            part = rows[at : at + QUERY_TILE]
            scores = products(q[part], c[tile], exact)
            own = ids_q[part][:, None] == ids_c[tile][None, :]
            scores[own] = _LEAST
            needed = best.least[part]
            if scores.shape[1] > best.k:
                needed = np.maximum(needed, np.partition(scores, -best.k, axis=1)[:, -best.k])
            x, y = np.nonzero((scores >= needed[:, None]) & ~own)
            best.add(part[x], ids_c[tile][y], scores[x, y])


def _by_coordinates(rows: np.ndarray, cosine: np.ndarray, q, ids_q, len_q, c, ids_c, len_c, best: Best, exact: bool) -> None:
    """For each query the vectors whose values in its largest coordinates a cosine of at least ``cosine`` allows."""
    unit = c / np.where(len_c > 0, len_c, 1)[:, None]
    lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r, t in zip(rows.tolist(), cosine.tolist(), strict=True):
        own = q[r] / len_q[r]
        focus = np.argsort(-np.abs(own))[:FOCUS].tolist()
        ranges = []
        for f in focus:
            if f not in lists:
                order = np.argsort(unit[:, f], kind="stable")
                lists[f] = order, unit[order, f]
            x = min(1.0, max(-1.0, own[f]))
            spread = math.sqrt(max(0.0, (1 - t * t) * (1 - x * x)))
            low = -1.0 if -x >= t else x * t - spread
            high = 1.0 if x >= t else x * t + spread
            ranges.append((f, low - _SLACK, high + _SLACK, *np.searchsorted(lists[f][1], [low - _SLACK, high + _SLACK]).tolist()))
        f, _, _, a, b = min(ranges, key=lambda x: x[4] - x[3])
        found = lists[f][0][a:b]
        for g, low, high, _, _ in ranges:
            if g != f:
                found = found[(unit[found, g] >= low) & (unit[found, g] <= high)]
        found = found[(len_q[r] * len_c[found] * (1 + _SLACK) >= best.least[r]) & (ids_c[found] != ids_q[r])]
        scores = products(q[r : r + 1], c[found], exact)[0]
        kept = scores >= best.least[r]
        best.add(np.full(int(kept.sum()), r), ids_c[found[kept]], scores[kept])


def best_of_cell(q, ids_q, len_q, least, c, ids_c, len_c, k: int) -> Best:
    """The k best vectors of a slice for each query of a block, of those that reach the score ``least`` that it has already."""
    order = np.argsort(-len_c, kind="stable")
    c, ids_c, len_c = c[order], ids_c[order], len_c[order]
    best = Best(k, least)
    if len(c) and len(q):
        exact = float(len_q.max() * len_c[0]) < 2.0**53 / (1 + _SLACK)
        longest = len_q * len_c[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where((least > 0) & (longest > 0) & np.isfinite(longest), least / longest, 0.0)
        open_ = longest * (1 + _SLACK) >= least
        narrow = (cosine > 0) & (cosine * (1 - _SLACK) >= COORDINATE_COSINE)
        _by_coordinates(np.flatnonzero(open_ & narrow), np.minimum(cosine[open_ & narrow] * (1 - _SLACK), 1.0), q, ids_q, len_q, c, ids_c, len_c, best, exact)
        _by_length(np.flatnonzero(open_ & ~narrow), q, ids_q, len_q, c, ids_c, len_c, best, exact)
    return best


def _search(k: int, width: int):
    def cell(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        ids_q = queries["id"].to_numpy()
        best = best_of_cell(_matrix(queries["v"], width), ids_q, queries["length"].to_numpy(), queries["least"].to_numpy(), _matrix(vectors["v"], width), vectors["id"].to_numpy(), vectors["length"].to_numpy(), k) if len(ids_q) and len(vectors) else Best(k, np.zeros(0, np.int64))
        return pa.table([pa.array(queries["row"].to_numpy()[best.query]), pa.array(ids_q[best.query]), pa.array(best.id), pa.array(best.score)], names=["query", "query_id", "vec_id", "score"])

    return cell


def _first_where(pairs: list[tuple[float, int]], holds, default: int):
    """The largest number of the pairs whose bound ``holds``, or the default."""
    if not pairs:
        return F.lit(default)
    bounds = F.array(*[F.struct(F.lit(float(b)).alias("bound"), F.lit(int(n)).alias("n")) for b, n in pairs])
    return F.coalesce(F.array_max(F.transform(F.filter(bounds, lambda p: holds(p["bound"])), lambda p: p["n"])), F.lit(default))


def _cells(queries: DataFrame, vectors: DataFrame, groups: list[tuple[int, int]], per_block: int, k: int, width: int, begin: int) -> DataFrame:
    """Searches slices ``begin`` and on, of each query up to ``upto``: one task for each block of queries and slice that meet.

    ``groups`` counts the queries by ``upto``, from the largest: its blocks hold queries of one ``upto``, so both the slices of a block and
    the blocks of a slice are a beginning of the row of numbers.
    """
    starts, blocks = {}, 0
    reach: list[tuple[float, int]] = []
    for upto, n in sorted(groups, reverse=True):
        starts[upto] = blocks, max(1, -(-n // per_block))
        blocks += starts[upto][1]
        reach.append((upto, blocks))
    base = _first_where([(u, s) for u, (s, _) in starts.items()], lambda u: u == F.col("upto"), 0)
    count = _first_where([(u, m) for u, (_, m) in starts.items()], lambda u: u == F.col("upto"), 1)
    block = base + F.pmod(F.xxhash64("row"), count)
    # Both sides' keys are of one type: equal numbers of different types have different hashes, so cells would not meet.
    block = block.cast("int")
    left = queries.filter(F.col("upto") > begin).select("row", "id", "v", "length", "least", block.alias("block"), F.explode(F.sequence(F.lit(begin), F.col("upto") - 1)).alias("slice"))
    meeting = _first_where(reach, lambda u: u > F.col("slice"), 0)
    right = vectors.filter(F.col("slice") >= begin).withColumn("_blocks", meeting).filter("_blocks > 0").select("id", "v", "length", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("block"), "slice")
    return left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice")).applyInArrow(_search(k, width), _FOUND)


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of ``vectors`` with the largest inner product for each row of ``queries``, ties to the smaller id.

    Both tables have the same columns; rows with a query's id are not its candidates. Components become floor(scale * x); vectors of different
    dimensions are compared as if filled with zeros. Repeated rows of ``vectors`` each take a place; equal queries are answered
    once, queries of one id but different vectors each for itself. See :func:`integer_vectors` for nulls; empty tables give no rows. Scores beyond 64 bits
    are kept at the largest or smallest such number.
    """
    scratch = Scratch(vectors.sparkSession, "products")
    bucket = F.when(F.col("length") > 0, F.floor(F.log("length") / F.lit(-math.log(LENGTH_RATIO))).cast("int")).otherwise(F.lit(-1))
    v = scratch.save(integer_vectors(vectors, id_col, vector_col, scale).select(F.monotonically_increasing_id().alias("row"), "id", "v", "length", bucket.alias("bucket")), "vectors")
    q = scratch.save(integer_vectors(queries, id_col, vector_col, scale).dropDuplicates(["id", "v"]).select(F.monotonically_increasing_id().alias("row"), "id", "v", "length"), "queries")
    # A row for each power of the ratio that lengths reach, about seven for each doubling: few, whatever the number of vectors.
    sizes = sorted(v.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("top"), F.max(F.size("v")).alias("width")).collect(), key=lambda r: -r.bucket)
    asked = q.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    width = max([1, asked.width or 0, *(r.width for r in sizes)])
    per_slice, per_block = max(1, SLICE_NUMBERS // width), max(1, BLOCK_NUMBERS // width)
    slices, ends, seeds, seen = {}, [], 0, 0
    total = 0
    for r in sizes:
        slices[r.bucket] = total, -(-r.n // per_slice)
        total += slices[r.bucket][1]
        ends.append((r.top, total))
        while seeds < total and seen < max(per_slice // 2, 2 * k + 1):  # the first slices that are large enough together
            seen, seeds = seen + r.n // slices[r.bucket][1], seeds + 1
    base = _first_where([(b, s) for b, (s, _) in slices.items()], lambda b: b == F.col("bucket"), 0)
    count = _first_where([(b, m) for b, (_, m) in slices.items()], lambda b: b == F.col("bucket"), 1)
    v = v.select("id", "v", "length", (base + F.pmod(F.col("row"), count)).cast("int").alias("slice"))
    start = q.withColumn("least", F.lit(_LEAST).cast("long")).withColumn("upto", F.lit(seeds))
    first = scratch.save(_cells(start, v.filter(F.col("slice") < seeds), [(seeds, asked.n)], per_block, k, width, 0), "first")
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("vec_id"))
    first_best = first.withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") <= k)
    least = first_best.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    upto = _first_where(ends, lambda top: top * F.col("length") * (1 + _SLACK) >= F.col("least"), 0)
    open_ = q.join(least.select(F.col("query").alias("row"), "least"), "row", "left").withColumn("least", F.coalesce("least", F.lit(_LEAST).cast("long"))).withColumn("upto", upto.cast("int"))
    open_ = scratch.save(open_.filter(F.col("upto") > seeds), "open")
    groups = [(r.upto, r["count"]) for r in open_.groupBy("upto").count().collect()]  # as few as buckets
    found = first_best.drop("_rank")
    if groups:
        found = found.unionByName(_cells(open_, v, groups, per_block, k, width, seeds))
    best = found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def search_query(spark, sf_dir: str) -> DataFrame:
    """op11: the five best of all other rows of ``embeddings`` for every row whose id is divisible by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_products(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)
SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, c.v) DESC, c.vec_id)::INTEGER AS rank, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
QUALIFY rank <= 5
"""
