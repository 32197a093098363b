"""Block retrieval: which candidate is nearest to a query, in nested pools, and what the errors are.

``queries``: group columns, ``block_id``, ``vector``. ``candidates``: group columns, ``pool_idx``, ``block_id``, ``kind`` (true or
perturbed), ``category``, ``position``, ``variant``, ``vector``. The nearest is the one of greatest similarity, the lowest
pool_idx among ties, so a gold block wins a tie against its own negatives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.functions.numeric import dot, unit
from loomspan.sources.scratch import Scratch


#: Candidates of one slice and queries of one block: what a task holds, and queries whose similarities to a slice it holds at a time.
SLICE_CANDIDATES, BLOCK_QUERIES, TILE_QUERIES = 2_000, 4_000, 256
#: Slices of all groups together, at least.
LEAST_CELLS = 16
#: Similarities nearer to the best than this are taken again, number by number, before ties are decided.
NEAR = 1e-9
#: Of the search for a better candidate: blocks of a slice, queries of a part, queries and representatives whose similarities a task holds at a time.
SEARCH_BLOCKS, SEARCH_QUERIES, SEARCH_TILE = 100_000, 300_000, (256, 4096)
#: How far from its gold a negative may be that the gold stands for, and how much similarities of vectors rounded to half precision may be wrong.
STANDS_FOR, ROUGH = 0.35, 1.2e-3


def own_similarities(queries: DataFrame, candidates: DataFrame, group: list[str]) -> DataFrame:
    """Similarity of each query to the candidates of its own block, with the gold's beside every negative: ``gold``, ``sim``."""
    q = queries.select(*group, "block_id", unit(F.col("vector")).alias("_q"))
    pairs = q.join(candidates, [*group, "block_id"]).withColumn("sim", dot(F.col("_q"), unit(F.col("vector")))).drop("_q", "vector")
    gold = pairs.filter("kind = 'true'").select(*group, "block_id", F.col("sim").alias("gold"))
    return pairs.filter("kind = 'perturbed'").join(gold, [*group, "block_id"])


def _codes(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """Numbers of values, the same in all columns."""
    lists = [c.to_pylist() for c in columns]
    names = {v: i for i, v in enumerate(dict.fromkeys(v for x in lists for v in x))}
    return [np.fromiter((names[v] for v in x), np.int64, len(x)) for x in lists]


def _rows_of(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy().reshape(len(flat), -1)


def _exact_dots(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Row by row, adding in the order of the components, so that equal vectors have equal similarities."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * c[:, j]
    return out


def tile_bests(q: np.ndarray, c: np.ndarray, mine: np.ndarray, classes: list[tuple[np.ndarray, bool]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(queries, candidates, similarities) of the best candidate of each class for each query that has any, the first one of ties.

    ``mine`` marks pairs of one block; a class is the candidates it may come from, and whether these must be of the query's block or of others.
    """
    sims, out = q @ c.T, []
    for columns, own in classes:
        allowed = mine[:, columns] == own
        part = np.where(allowed, sims[:, columns], -np.inf)
        best = part.max(axis=1, initial=-np.inf)
        x, y = np.nonzero((part >= best[:, None] - NEAR) & allowed)
        exact = _exact_dots(q[x], c[columns[y]])
        order = np.lexsort((columns[y], -exact, x))
        first = order[np.flatnonzero(np.concatenate([[True], np.diff(x[order]) > 0]))] if len(order) else order
        out.append((x[first], columns[y[first]], exact[first]))
    return out


def class_bests(queries: DataFrame, candidates: DataFrame, group: list[str], slices: int | None = None) -> DataFrame:
    """For each query the best candidate among: its gold, other true blocks, and negatives by category and by whose they are.

    Every query meets every candidate of its group, in cells of a block of queries and a slice of candidates. A cell is a task's: it multiplies
    tiles of TILE_QUERIES queries by the slice, and only the best of each class leaves it. Slices and blocks follow the numbers of candidates and queries of each group;
    each row is copied to as many cells as the other side has parts. Vectors must have one dimension; rows without one are left out.
    """
    queries, candidates = queries.filter("vector IS NOT NULL"), candidates.filter("vector IS NOT NULL")
    names = [F.col(x).alias(x) for x in (*group, "block_id")]  # columns of their own on each side, should both come from one table
    key = F.struct(*group) if group else F.lit(0)
    sizes = candidates.groupBy(key.alias("_g")).agg(F.count(F.lit(1)).alias("_c")).join(queries.groupBy(key.alias("_g")).agg(F.count(F.lit(1)).alias("_q")), "_g")
    few = F.lit(1 + LEAST_CELLS // max(1, sizes.count())) if slices is None else F.lit(slices)  # so that few groups still spread over tasks
    cut = F.greatest(F.ceil(F.col("_c") / SLICE_CANDIDATES), few) if slices is None else few
    sizes = sizes.select("_g", cut.cast("bigint").alias("_slices"), F.ceil(F.col("_q") / BLOCK_QUERIES).cast("bigint").alias("_blocks"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    c = candidates.select(*names, "pool_idx", "kind", "category", unit(F.col("vector")).alias("_v"), key.alias("_g")).join(sizes, "_g").withColumn("_s", F.pmod(F.xxhash64("pool_idx"), F.col("_slices"))).withColumn("_b", each("_blocks")).drop("_g", "_slices", "_blocks")
    q = queries.select(*names, unit(F.col("vector")).alias("_v"), key.alias("_g")).join(sizes, "_g").withColumn("_b", F.pmod(F.xxhash64("block_id"), F.col("_blocks"))).withColumn("_s", each("_slices")).drop("_g", "_slices", "_blocks")
    schema = T.StructType([*[q.schema[g] for g in group], q.schema["block_id"], T.StructField("kind", T.StringType()), T.StructField("category", T.StringType()), T.StructField("sim", T.DoubleType()), T.StructField("pool_idx", T.LongType())])

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[pa.Table] = []
        if len(left) and len(right):
            right = right.sort_by("pool_idx")
            block_q, block_c = _codes(left["block_id"], right["block_id"])
            vq, vc, idx = _rows_of(left["_v"]), _rows_of(right["_v"]), right["pool_idx"].to_numpy()
            true = np.array([k == "true" for k in right["kind"].to_pylist()], bool)
            categories = np.array(right["category"].to_pylist(), object)
            classes = [(np.flatnonzero(true), True, "gold", None), (np.flatnonzero(true), False, "other", None)]
            for name in dict.fromkeys(categories[~true].tolist()):
                at = np.flatnonzero(~true & (categories == name))
                classes += [(at, True, "own", name), (at, False, "foreign", name)]
            for a in range(0, len(vq), TILE_QUERIES):
                tile = slice(a, a + TILE_QUERIES)
                mine = block_q[tile, None] == block_c[None, :]
                for (_, _, kind, name), (x, y, sim) in zip(classes, tile_bests(vq[tile], vc, mine, [k[:2] for k in classes]), strict=True):
                    own = left.select([*group, "block_id"]).take(pa.array(x + a))
                    found.append(pa.table([*own.columns, pa.array([kind] * len(x), pa.string()), pa.array([name] * len(x), pa.string()), pa.array(sim), pa.array(idx[y], pa.int64())], names=schema.names))
        empty = pa.table([*[left[g].slice(0, 0) for g in (*group, "block_id")], pa.array([], pa.string()), pa.array([], pa.string()), pa.array([], pa.float64()), pa.array([], pa.int64())], names=schema.names)
        return pa.concat_tables([empty, *found])

    cells = [*group, "_s", "_b"]
    met = q.groupBy(*cells).cogroup(c.groupBy(*cells)).applyInArrow(cell, schema)
    best = F.max(F.struct("sim", (-F.col("pool_idx")).alias("_i")))
    found = met.groupBy(*group, "block_id", "kind", "category").agg(best.alias("b"))
    return found.select(*group, "block_id", "kind", "category", F.col("b.sim").alias("sim"), (-F.col("b._i")).alias("pool_idx"))


def _winner(bests: DataFrame, group: list[str], keep) -> DataFrame:
    chosen = bests.filter(keep).groupBy(*group, "block_id").agg(F.max(F.struct("sim", (-F.col("pool_idx")).alias("_i"), "kind", "category")).alias("w"))
    return chosen.select(*group, "block_id", F.col("w.sim").alias("sim"), (-F.col("w._i")).alias("pool_idx"), F.col("w.kind").alias("kind"), F.col("w.category").alias("category"))


def pool_errors(bests: DataFrame, group: list[str]) -> DataFrame:
    """Error rates of the four pools: true blocks; true and perturbed; gold and all perturbed; gold and own perturbed.

    The last counts only blocks that have negatives of their own.
    """
    kind = F.col("kind")
    pools = {"true_only": kind.isin("gold", "other"), "full": F.lit(True), "hard": kind != "other", "own": kind.isin("gold", "own")}
    have = bests.filter("kind = 'own'").select(*group, "block_id").distinct()
    out = None
    for name, keep in pools.items():
        base = bests.join(have, [*group, "block_id"], "left_semi") if name == "own" else bests
        won = _winner(base, group, keep).groupBy(*group).agg(F.avg((F.col("kind") != "gold").cast("double")).alias("error"), F.count(F.lit(1)).alias("n_blocks")).withColumn("pool", F.lit(name))
        out = won if out is None else out.unionByName(won)
    return out


def _exact_units(v: np.ndarray) -> np.ndarray:
    """Row by row as :func:`unit` makes them."""
    norms = np.zeros(len(v))
    for j in range(v.shape[1]):
        norms += v[:, j] * v[:, j]
    return v / np.maximum(np.sqrt(norms), 1e-12)[:, None]


def _rough(v: np.ndarray) -> list[bytes]:
    return [x.tobytes() for x in v.astype(np.float16)]


def _unrough(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(-1, dims).astype(np.float32)


class _Slice:
    """Candidates of some blocks, ready to be searched: golds, negatives that these stand for, and other negatives, which stand for themselves."""

    def __init__(self, blocks: np.ndarray, idx: np.ndarray, vectors: np.ndarray, of: np.ndarray, dims: int):
        """``blocks`` of the golds; of all candidates ``idx``, ``vectors`` and the place of their block ``of``; a block's gold is the first of its candidates."""
        gold = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        true = np.zeros(len(of), bool)
        true[gold] = True
        apart = np.sqrt(((vectors - vectors[gold][of]) ** 2).sum(axis=1))
        near = np.flatnonzero(~true & (apart <= STANDS_FOR))
        far = np.flatnonzero(~true & (apart > STANDS_FOR))
        reach = np.zeros(len(gold), np.float32)
        np.maximum.at(reach, of[near], apart[near].astype(np.float32))
        self.idx, self.vectors, self.block = idx, vectors, blocks[of]
        self.reps, self.golds = np.concatenate([gold, far]), len(gold)
        self.reach = np.concatenate([reach, np.zeros(len(far), np.float32)])
        self.near, self.first = near, np.searchsorted(of[near], np.arange(len(gold) + 1))

    def hits(self, q: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(queries, candidates) of at least a query's similarity; what is less by more than rounding is left out."""
        left = np.concatenate([q, np.ones((len(q), 1), np.float32), -least[:, None].astype(np.float32)], axis=1)
        for low in range(0, len(self.reps), SEARCH_TILE[1]):
            reps = self.reps[low : low + SEARCH_TILE[1]]
            right = np.concatenate([self.vectors[reps], self.reach[low : low + len(reps), None], np.ones((len(reps), 1), np.float32)], axis=1)
            x, r = np.divmod(np.flatnonzero((left @ right.T).ravel() >= -2 * ROUGH), len(reps))
            r += low
            stands = r < self.golds
            n = np.where(stands, self.first[np.minimum(r, self.golds - 1) + 1] - self.first[np.minimum(r, self.golds - 1)], 0)
            more = np.repeat(self.first[np.minimum(r, self.golds - 1)] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield np.concatenate([x, np.repeat(x, n)]), np.concatenate([self.reps[r], self.near[more]])


def searched_errors(blocks: DataFrame, group: list[str], vectors: Callable, dims: int) -> DataFrame:
    """The errors of :func:`pool_errors`, of queries whose own block is among the candidates, without the best candidates themselves.

    ``blocks``: group columns, ``block_id``, and what ``vectors`` needs; a saved table, for it is read three times. ``vectors`` takes batches of blocks and gives for each
    the vectors of its queries and of its candidates (gold first, block by block), their pool_idx and their block's place. The query of a block errs in a pool if some candidate there
    is nearer than its gold, or as near with a lower pool_idx. Own candidates are compared where vectors are made. The others are searched in cells, of a slice of
    blocks and a part of queries each: a gold stands for its negatives up to their distance from it, so most are never compared. Vectors go there in half
    precision, and pairs that this leaves open, of queries with no certain error, are compared again in doubles. The work is still that of all queries by all golds.
    """
    spark, scratch = blocks.sparkSession, Scratch(blocks.sparkSession, "search")
    key = F.struct(*group) if group else F.lit(0)
    sizes = blocks.groupBy(key.alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("_g", F.ceil(F.col("_n") / SEARCH_BLOCKS).cast("int").alias("_slices"), F.ceil(F.col("_n") / SEARCH_QUERIES).cast("int").alias("_parts"))
    fields = [*[blocks.schema[g] for g in group], blocks.schema["block_id"]]
    made = T.StructType([*fields, T.StructField("_gold", T.DoubleType()), T.StructField("_own", T.IntegerType()), T.StructField("_query", T.BinaryType()), T.StructField("_idx", T.BinaryType()), T.StructField("_vectors", T.BinaryType())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, c, idx, of, batch in vectors(batches):
            q, c = _exact_units(q), _exact_units(c)
            first = np.searchsorted(of, np.arange(len(q)))
            sims = _exact_dots(q[of], c)
            gold = sims[first]
            negative = np.arange(len(of)) != first[of]
            lost = negative & ((sims > gold[of]) | ((sims == gold[of]) & (idx < idx[first][of])))
            own = np.zeros(len(q), np.int32)  # 0 no negatives, 1 none is nearer, 2 one is
            np.maximum.at(own, of[negative], 1 + lost[negative])
            ends = [*first.tolist(), len(of)]
            rough = c.astype(np.float16)
            lists = [[x[a:b].tobytes() for a, b in zip(ends, ends[1:])] for x in (idx.astype(np.int64), rough)]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in fields], pa.array(gold), pa.array(own), pa.array(_rough(q), pa.binary()), *[pa.array(x, pa.binary()) for x in lists]], names=made.names)

    placed = blocks.mapInArrow(make, made).withColumn("_g", key).join(F.broadcast(sizes), "_g")
    hashed = F.xxhash64("block_id")
    slice_, part = F.pmod(hashed, F.col("_slices")).cast("int"), F.pmod(F.shiftright(hashed, 20), F.col("_parts")).cast("int")
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    as_query = F.transform(each("_slices"), lambda s: F.struct(F.lit(True).alias("q"), s.alias("s"), part.alias("p")))
    as_candidate = F.transform(each("_parts"), lambda p: F.struct(F.lit(False).alias("q"), slice_.alias("s"), p.alias("p")))
    dealt = placed.withColumn("_c", F.explode(F.concat(as_query, as_candidate))).select(
        *group, "block_id", "_gold", "_own", F.col("_c.q").alias("_is_query"), F.col("_c.s").alias("_s"), F.col("_c.p").alias("_p"), F.when(F.col("_c.q"), F.col("_query")).alias("_query"),
        F.when(~F.col("_c.q"), F.col("_idx")).alias("_idx"), F.when(~F.col("_c.q"), F.col("_vectors")).alias("_vectors"))
    found = T.StructType([*fields, T.StructField("_own", T.IntegerType()), T.StructField("_true", T.BooleanType()), T.StructField("_negative", T.BooleanType()), T.StructField("_with", fields[-1].dataType), T.StructField("_at", T.LongType())])

    def cell(table: pa.Table) -> pa.Table:
        queries, c = table.filter(table.column("_is_query")), table.filter(pc.invert(table.column("_is_query")))
        out = [queries.select([*group, "block_id", "_own"]).append_column("_true", pa.array(np.zeros(len(queries), bool))).append_column("_negative", pa.array(np.zeros(len(queries), bool)))]
        if len(queries) and len(c):
            idx = [np.frombuffer(x, np.int64) for x in c.column("_idx").to_pylist()]
            q, ids_q, ids_c = _unrough(queries.column("_query"), dims), *_codes(queries.column("block_id"), c.column("block_id"))
            slice_ = _Slice(ids_c, np.concatenate(idx), _unrough(c.column("_vectors"), dims), np.repeat(np.arange(len(c)), [len(x) for x in idx]), dims)
            is_gold = np.zeros(len(slice_.idx), bool)
            is_gold[slice_.reps[: slice_.golds]] = True
            name_of = dict(zip(ids_c.tolist(), c.column("block_id").to_pylist()))
            gold, own = queries.column("_gold").to_numpy(), queries.column("_own").to_numpy()
            lost, unsure = np.zeros((2, len(q)), bool), []
            lost[1] = own == 2  # which says enough about negatives
            for a in range(0, len(q), SEARCH_TILE[0]):
                tile = slice(a, a + SEARCH_TILE[0])
                for x, y in slice_.hits(q[tile], gold[tile]):
                    x = x + a
                    keep = (slice_.block[y] != ids_q[x]) & ~lost[1 - is_gold[y], x]
                    x, y = x[keep], y[keep]
                    above = (q[x] * slice_.vectors[y]).sum(axis=1, dtype=np.float64) - gold[x]
                    sure = above > ROUGH
                    lost[1 - is_gold[y[sure]], x[sure]] = True
                    open_ = np.flatnonzero(~sure & (above >= -ROUGH))
                    unsure.append(np.stack([x[open_], y[open_]]))
            x, y = np.concatenate(unsure, axis=1)
            keep = ~lost[1 - is_gold[y], x]
            x, y = x[keep], y[keep]
            out[0] = out[0].drop_columns(["_true", "_negative"]).append_column("_true", pa.array(lost[0])).append_column("_negative", pa.array(lost[1]))
            pairs = queries.select([*group, "block_id", "_own"]).take(pa.array(x)).append_column("_true", pa.array(is_gold[y])).append_column("_negative", pa.array(~is_gold[y]))
            out.append(pairs.append_column("_with", pa.array([name_of[b] for b in slice_.block[y].tolist()], table.schema.field("block_id").type)).append_column("_at", pa.array(slice_.idx[y])))
        out[0] = out[0].append_column("_with", pa.nulls(len(queries), table.schema.field("block_id").type)).append_column("_at", pa.nulls(len(queries), pa.int64()))
        return pa.concat_tables(out).cast(pa.schema([table.schema.field(f.name) if f.name in table.schema.names else pa.field(f.name, {"_true": pa.bool_(), "_negative": pa.bool_(), "_with": table.schema.field("block_id").type, "_at": pa.int64()}[f.name]) for f in found]))

    searched = scratch.save(dealt.groupBy(*group, "_s", "_p").applyInArrow(cell, found), "searched")
    names = [f.name for f in fields]
    sure = searched.filter("_at IS NULL").groupBy(*names).agg(F.max("_own").alias("_own"), F.max("_true").alias("_true"), F.max("_negative").alias("_negative"))
    id_of = lambda c: F.struct(*group, c.alias("block_id"))
    known = sure.select(id_of(F.col("block_id")).alias("_me"), F.col("_true").alias("_t"), F.col("_negative").alias("_m"))
    unsure = searched.filter("_at IS NOT NULL").withColumn("_me", id_of(F.col("block_id"))).join(known, "_me").filter(~F.when(F.col("_true"), F.col("_t")).otherwise(F.col("_m")))
    unsure = scratch.save(unsure.select("_me", id_of(F.col("_with")).alias("_other"), "_true", "_at"), "unsure")
    wanted = unsure.select(F.col("_me").alias("_k")).unionByName(unsure.select(F.col("_other").alias("_k"))).distinct()
    again = scratch.save(blocks.withColumn("_k", id_of(F.col("block_id"))).join(wanted, "_k", "left_semi").drop("_k"), "again")
    exact = T.StructType([*fields, T.StructField("_at", T.LongType()), T.StructField("_v", T.ArrayType(T.DoubleType())), T.StructField("_q", T.ArrayType(T.DoubleType())), T.StructField("_gold", T.DoubleType()), T.StructField("_first", T.LongType())])

    def remake(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = lambda v: pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, dims), pa.int32()), pa.array(v.ravel()))
        for q, c, idx, of, batch in vectors(batches):
            q, c, first = _exact_units(q), _exact_units(c), np.searchsorted(of, np.arange(len(q)))
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name).take(pa.array(of)) for f in fields], pa.array(idx), rows(c), rows(q[of]), pa.array(_exact_dots(q, c[first])[of]), pa.array(idx[first][of])], names=exact.names)

    vectors_ = again.mapInArrow(remake, exact).withColumn("_k", id_of(F.col("block_id")))
    mine = vectors_.filter(F.col("_at") == F.col("_first")).select(F.col("_k").alias("_me"), "_q", "_gold", "_first")
    theirs = vectors_.select(F.col("_k").alias("_other"), "_at", "_v")
    sim = dot(F.col("_q"), F.col("_v"))
    lost = unsure.join(theirs, ["_other", "_at"]).join(mine, "_me").filter((sim > F.col("_gold")) | ((sim == F.col("_gold")) & (F.col("_at") < F.col("_first"))))
    lost = lost.groupBy("_me").agg(F.max("_true").alias("_t"), F.max(~F.col("_true")).alias("_m"))
    each_query = scratch.save(sure.withColumn("_me", id_of(F.col("block_id"))).join(lost, "_me", "left").select(*group, "_own", (F.col("_true") | F.coalesce("_t", F.lit(False))).alias("_true"), (F.col("_negative") | F.coalesce("_m", F.lit(False))).alias("_negative")), "queries")
    out = None
    for name, rows, wrong in (("true_only", each_query, F.col("_true")), ("full", each_query, F.col("_true") | F.col("_negative")), ("hard", each_query, F.col("_negative")), ("own", each_query.filter("_own > 0"), F.col("_own") == 2)):
        pool = rows.groupBy(*group).agg(F.avg(wrong.cast("double")).alias("error"), F.count(F.lit(1)).alias("n_blocks")).withColumn("pool", F.lit(name))
        out = pool if out is None else out.unionByName(pool)
    return out


def error_typology(bests: DataFrame, group: list[str]) -> DataFrame:
    """On the full pool: correct, misaligned (another block or its negative), or lost to an own negative's category."""
    won = _winner(bests, group, F.lit(True))
    outcome = F.when(F.col("kind") == "gold", "correct").when(F.col("kind") == "own", F.concat(F.lit("own:"), "category")).otherwise("misaligned")
    counted = won.groupBy(*group, outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    return counted


def category_pools(bests: DataFrame, group: list[str], categories: list[str]) -> DataFrame:
    """Error rate over true blocks plus the negatives of each combination of categories."""
    subsets = [c for r in range(1, len(categories) + 1) for c in combinations(sorted(categories), r)]
    made = F.explode(F.array(*[F.struct(F.lit("+".join(s)).alias("name"), F.array(*map(F.lit, s)).alias("members")) for s in subsets]))
    rows = bests.withColumn("_s", made).filter(F.col("category").isNull() | F.array_contains("_s.members", F.col("category"))).withColumn("pool", F.col("_s.name"))
    won = _winner(rows, [*group, "pool"], F.lit(True))
    return won.groupBy(*group, "pool").agg(F.avg((F.col("kind") != "gold").cast("double")).alias("error"), F.count(F.lit(1)).alias("n_blocks"))


def own_by_category(own: DataFrame, group: list[str]) -> DataFrame:
    """Own pool of one category at a time: error (ties go to gold, which comes first) and blocks that have it."""
    hardest = own.groupBy(*group, "block_id", "category").agg(F.max("sim").alias("_m"), F.any_value("gold").alias("gold"))
    return hardest.groupBy(*group, "category").agg(F.avg((F.col("_m") > F.col("gold")).cast("double")).alias("error"), F.count(F.lit(1)).alias("n_blocks"))


def own_breakdown(own: DataFrame, group: list[str]) -> DataFrame:
    """Share of blocks that win their own pool, or lose it to each category."""
    best = own.groupBy(*group, "block_id").agg(F.max(F.struct("sim", (-F.col("pool_idx")).alias("_i"), "category")).alias("w"), F.any_value("gold").alias("gold"))
    outcome = F.when(F.col("gold") >= F.col("w.sim"), "correct").otherwise(F.col("w.category"))
    total = best.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    return best.groupBy(*group, outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n")).join(total, group).withColumn("share", F.col("n") / F.col("_n")).drop("_n")


def chance_error(own: DataFrame, group: list[str]) -> DataFrame:
    """What choosing at random would err: the mean of m / (m + 1) over blocks with m negatives."""
    m = own.groupBy(*group, "block_id").agg(F.count(F.lit(1)).alias("m"))
    return m.groupBy(*group).agg(F.avg(F.col("m") / (F.col("m") + 1)).alias("chance"), F.avg("m").alias("mean_negatives"), F.count(F.lit(1)).alias("n_blocks"))


def detection(own: DataFrame, group: list[str]) -> DataFrame:
    """Share of own negatives below the gold, a tie being a loss: in all, by category and by position, in one pass."""
    win = F.avg((F.col("gold") > F.col("sim")).cast("double")).alias("detection")
    sets = own.groupingSets([[*map(F.col, group)], [*map(F.col, group), F.col("category")], [*map(F.col, group), F.col("position")]], *map(F.col, group), F.col("category"), F.col("position"))
    return sets.agg(win, F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g")).withColumn("by", F.when(F.col("category").isNotNull(), "category").when(F.col("position").isNotNull(), "position").otherwise("all")).drop("_g")


def margins(bests: DataFrame, group: list[str]) -> DataFrame:
    """Mean of gold minus the best other candidate, and minus the best own negative."""
    per = bests.groupBy(*group, "block_id").agg(F.max(F.when(F.col("kind") == "gold", F.col("sim"))).alias("_g"), F.max(F.when(F.col("kind") != "gold", F.col("sim"))).alias("_o"), F.max(F.when(F.col("kind") == "own", F.col("sim"))).alias("_n"))
    return per.groupBy(*group).agg(F.avg(F.col("_g") - F.col("_o")).alias("margin"), F.avg(F.col("_g") - F.col("_n")).alias("own_margin"))
