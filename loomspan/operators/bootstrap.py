"""Resampling of documents, never of rows: paired tau differences, weighted means, intervals."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.sources.scratch import Scratch

from .correlate import cells_of, kendall, weighted_tau_b
from .order import cumulative

#: Documents in a leaf of the tree that deals out draws, and resamples that are made at a time.
LEAF, DRAW_BLOCK = 1024, 50
#: Rows of a group whose taus one task computes for all resamples; larger groups are counted for each resample by all tasks.
TAU_ROWS = 200_000
#: Distinct pairs of values up to which a larger group is counted in cells; weights of documents, or of cells, under a block of resamples, and rows that a task
#: holds before it passes on its counts.
TAU_CELLS, HELD_COUNTS, HELD_LINES = 100_000, 60_000_000, 6_000_000
#: Rows of a cell that are summed in one piece, and pieces that are summed at a time.
PIECE_ROWS, PIECES = 1024, 8192
#: Rows or groups that a task multiplies at a time, and groups whose sums it holds before it passes them on.
HELD_ROWS, HELD_GROUPS = 256, 1000


def units(rows: DataFrame, group: str, doc: str, order: str, values: list[str]) -> DataFrame:
    """One row per (group, document) with its values in row order."""
    packed = F.array_sort(F.collect_list(F.struct(order, *values)))
    return rows.groupBy(group, doc).agg(packed.alias("_v")).select(group, doc, *[F.col(f"_v.{v}").alias(v) for v in values])


@dataclass
class Resamples:
    """``draws`` resamples of ``n`` documents, numbered from 0, with replacement: made in any task from the seed alone, always the same.

    The n draws of a resample are shared out down a binary tree over leaves of ``per_leaf`` documents: a seeded binomial says how many fall on the left half
    of a node. So a leaf gets its exact multinomial counts from the nodes above it, and nobody needs those of other leaves.
    """

    n: int
    draws: int
    seed: int
    per_leaf: int = LEAF
    per_block: int = DRAW_BLOCK
    _known: dict = field(default_factory=dict, repr=False)

    @property
    def blocks(self) -> int:
        return -(-self.draws // self.per_block)

    def _size(self, block: int) -> int:
        return min(self.per_block, self.draws - block * self.per_block)

    def _falls(self, block: int, low: int, high: int, leaf: int) -> np.ndarray:
        """How many draws of each resample of a block fall on a leaf, from the node of leaves [low, high)."""
        m = np.full(self._size(block), self.n, np.int64)
        while high - low > 1:
            middle = (low + high) // 2
            key = (block, low, high)
            if key not in self._known:
                if len(self._known) > 4096:
                    self._known.clear()
                left, whole = (min(x * self.per_leaf, self.n) - low * self.per_leaf for x in (middle, high))
                self._known[key] = np.random.default_rng([self.seed, *key]).binomial(m, left / whole)
            on_left = self._known[key]
            if leaf < middle:
                m, high = on_left, middle
            else:
                m, low = m - on_left, middle
        return m

    def leaf(self, block: int, leaf: int) -> np.ndarray:
        """Counts of a leaf's documents in each resample of a block: a row per resample."""
        size = min(self.per_leaf, self.n - leaf * self.per_leaf)
        m = self._falls(block, 0, -(-self.n // self.per_leaf), leaf)
        drawn = np.random.default_rng([self.seed, block, leaf]).integers(0, size, int(m.sum()))
        return np.bincount(np.repeat(np.arange(len(m)), m) * size + drawn, minlength=len(m) * size).reshape(len(m), size)

    def times(self, block: int, index: np.ndarray) -> np.ndarray:
        """How often each of the documents is in each resample of a block."""
        out = np.zeros((self._size(block), len(index)), np.int64)
        order = np.argsort(index // self.per_leaf, kind="stable")
        leaves = (index // self.per_leaf)[order]
        for a, b in _runs(leaves):
            out[:, order[a:b]] = self.leaf(block, int(leaves[a]))[:, index[order[a:b]] - int(leaves[a]) * self.per_leaf]
        return out


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where runs of equal values begin and end."""
    return pairwise([0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]) if len(values) else iter(())


def numbered(rows: DataFrame, doc: str) -> tuple[DataFrame, int]:
    """Rows with ``_doc``, their document's number from 0 in the order of a hash, and how many documents there are."""
    scratch = Scratch(rows.sparkSession, "numbers")
    keys = scratch.save(rows.select(F.struct(F.col(doc)).alias("_d")).distinct().withColumn("_h", F.xxhash64("_d")), "keys")
    counts = scratch.save(keys.groupBy("_h").agg(F.count(F.lit(1)).alias("n")), "counts")  # read several times
    placed = cumulative(counts.withColumn("_all", F.lit(0)), ["_all"], "_h").select("_h", "before")
    inside = F.row_number().over(Window.partitionBy("_h").orderBy("_d")) - 1  # 0, but for equal hashes
    placed = keys.withColumn("_in", inside).join(placed, "_h").select("_d", (F.col("before") + F.col("_in")).alias("_doc"))
    return rows.withColumn("_d", F.struct(F.col(doc))).join(placed, "_d").drop("_d"), keys.count()


def _tasks(rows: DataFrame) -> int:
    """As many as the cluster has cores: few bytes are much work here, so partitions must not be merged by their size."""
    return rows.sparkSession.sparkContext.defaultParallelism


def weighted_means(units_: DataFrame, doc: str, group: str, value: str, draws: int, seed: int) -> DataFrame:
    """Per resample (``b``): mean over groups of the group's mean weighted by draws; groups without weight are left out.

    Values are summed by document and group first. Tasks then go through their leaves of documents in order, so each leaf's draws are made
    once, and multiplied once for HELD_ROWS groups, and a task holds one leaf and the sums of about HELD_GROUPS groups, whatever its share of the data.
    """
    known = units_.filter(F.col(value).isNotNull()).select(doc, group, F.col(value).cast("double").alias("_v"))
    summed = known.groupBy(doc, group).agg(F.sum("_v").alias("_s"), F.count(F.lit(1)).cast("double").alias("_n"))
    rows, n = numbered(Scratch(units_.sparkSession, "means").save(summed, "sums"), doc)
    drawn, kind = Resamples(n, draws, seed, LEAF, DRAW_BLOCK), rows.schema[group].dataType
    schema = T.StructType([T.StructField("b", T.LongType()), T.StructField(group, kind), T.StructField("_s", T.DoubleType()), T.StructField("_w", T.DoubleType())])

    def run(batches):
        held: dict = {}

        def rows_of(labels: pa.DataType) -> Iterator[pa.RecordBatch]:
            for g, (s, w) in held.items():
                some = np.flatnonzero(w)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([g] * len(some), labels), pa.array(s[some]), pa.array(w[some])], names=schema.names)
            held.clear()

        now, weights = None, None
        for batch in batches:  # in the order of leaves
            index, groups, s, c = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for begin, end in _runs(index // drawn.per_leaf):
                leaf = int(index[begin]) // drawn.per_leaf
                if leaf != now:
                    now, weights = leaf, np.concatenate([drawn.leaf(block, leaf) for block in range(drawn.blocks)]).T.astype(np.float64)
                names = {g: k for k, g in enumerate(dict.fromkeys(groups[begin:end]))}
                of, own = np.fromiter((names[g] for g in groups[begin:end]), np.int64, end - begin), index[begin:end] - leaf * drawn.per_leaf
                for low in range(0, len(names), HELD_ROWS):
                    some = list(names)[low : low + HELD_ROWS]
                    mine = np.flatnonzero((of >= low) & (of < low + len(some)))
                    at = np.zeros((len(some), 2, len(weights)))
                    at[of[mine] - low, 0, own[mine]], at[of[mine] - low, 1, own[mine]] = s[begin:end][mine], c[begin:end][mine]
                    sums = (at.reshape(-1, len(weights)) @ weights).reshape(len(some), 2, -1)
                    for k, g in enumerate(some):
                        x, w = held.get(g) or (0.0, 0.0)
                        held[g] = x + sums[k, 0], w + sums[k, 1]
                    if len(held) > HELD_GROUPS:
                        yield from rows_of(batch.column(1).type)
        if held:
            yield from rows_of(batch.column(1).type)

    leaves = max(1, -(-n // drawn.per_leaf))
    parts = min(leaves, 4 * _tasks(rows))
    near = max(1, min(64, leaves // (16 * parts)))  # leaves next to each other have most nodes of the tree in common
    spread = rows.select("_doc", group, "_s", "_n").repartition(parts, F.floor(F.col("_doc") / (near * drawn.per_leaf))).sortWithinPartitions("_doc")
    cell = spread.mapInArrow(run, schema).groupBy("b", group).agg((F.sum("_s") / F.sum("_w")).alias("m"))
    return cell.groupBy("b").agg(F.avg("m").alias("value"))


def interval(values: DataFrame, value: str = "value", low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile interval, and whether it leaves out 0."""
    cut = values.agg(F.avg(value).alias("mean"), F.percentile(value, F.lit(low)).alias("low"), F.percentile(value, F.lit(high)).alias("high"), F.count(value).alias("draws"))
    return cut.withColumn("significant", (F.col("low") > 0) | (F.col("high") < 0))


def tau_delta(rows: DataFrame, group: str, doc: str, gold: str, a: str, b: str, draws: int, seed: int) -> DataFrame:
    """Per resample: mean over groups of tau-b of ``a`` minus that of ``b``, on the same documents.

    Groups with two rows or fewer, or without variance, are left out of a resample. A group of up to TAU_ROWS rows goes to as many tasks as there are
    blocks of DRAW_BLOCK resamples. Of a larger one with up to TAU_CELLS distinct (gold, a) and (gold, b) each, tasks count the cells under all resamples at once;
    others are weighed row by row for each resample, and their taus come from :func:`correlate.kendall`, which no task holds whole. All give the same numbers.
    """
    scratch = Scratch(rows.sparkSession, "taus")
    full, n = numbered(rows.select(F.struct(F.col(group)).alias("_g"), doc, *[F.col(c).cast("double").alias(x) for c, x in ((gold, "_gold"), (a, "_one"), (b, "_two"))]), doc)
    full = scratch.save(full.na.drop(subset=["_gold", "_one", "_two"]).select("_g", "_doc", "_gold", "_one", "_two"), "rows")
    drawn = Resamples(n, draws, seed, LEAF, DRAW_BLOCK)
    sizes = full.groupBy("_g").agg((F.count(F.lit(1)) > TAU_ROWS).alias("_large"))
    parts = [full]
    if not sizes.filter("_large").isEmpty():
        keyed = full.join(sizes, "_g")
        cells = [cells_of(keyed.filter("_large"), ["_g"], "_gold", c).groupBy("_g").agg((F.count(F.lit(1)) <= TAU_CELLS).alias(f"_few{c}")) for c in ("_one", "_two")]
        kinds = scratch.save(cells[0].join(cells[1], "_g").select("_g", (F.col("_few_one") & F.col("_few_two")).alias("_few")), "kinds")
        parts = [keyed.filter(~F.col("_large")).drop("_large"), *[full.join(kinds.filter(F.col("_few") == few), "_g").drop("_few") if not kinds.filter(F.col("_few") == few).isEmpty() else None for few in (True, False)]]
    blocks = F.explode(F.sequence(F.lit(0), F.lit(drawn.blocks - 1))).alias("_block")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        index, g, x, y = (table.column(c).to_numpy() for c in ("_doc", "_gold", "_one", "_two"))
        tau_one, tau_two = weighted_tau_b(g, x), weighted_tau_b(g, y)
        block, out = key[1].as_py(), []
        for w in drawn.times(block, index):
            one, two = tau_one(w), tau_two(w)
            out.append(one - two if int(w.sum()) > 2 and one is not None and two is not None else None)
        first = drawn.per_block * block
        return pa.table({"b": pa.array(range(first, first + len(out)), pa.int64()), "delta": pa.array(out, pa.float64())})

    spread = parts[0].select("_g", "_doc", "_gold", "_one", "_two", blocks).repartition(_tasks(rows), "_g", "_block")
    deltas = spread.groupBy("_g", "_block").applyInArrow(run, "b bigint, delta double")
    for part, way in zip(parts[1:], (_counted_deltas, _large_deltas), strict=False):
        deltas = deltas if part is None else deltas.unionByName(way(part, drawn))
    return deltas.groupBy("b").agg(F.avg("delta").alias("value"))


def _packed(cells: pa.RecordBatch) -> bytes:
    """As compressed bytes, since Spark's own compression leaves counts as they are."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, cells.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(cells)
    return sink.getvalue().to_pybytes()


class _Cells:
    """Places of rows ordered by their cells, so that the weights of each cell are summed under many resamples by few passes over all cells."""

    def __init__(self, places: np.ndarray, cells: np.ndarray, n: int):
        """``places`` of the rows' documents among weights, and which of ``n`` cells the rows are of; each cell has some."""
        self.places = places[np.argsort(cells, kind="stable")]
        sizes = np.bincount(cells, minlength=n)
        pieces = -(-sizes // PIECE_ROWS)
        self.pieces = np.cumsum(pieces) - pieces  # the first of each cell
        begin = np.repeat(np.cumsum(sizes) - sizes, pieces) + PIECE_ROWS * (np.arange(pieces.sum()) - np.repeat(self.pieces, pieces))
        length = np.minimum(begin + PIECE_ROWS, np.repeat(np.cumsum(sizes), pieces)) - begin
        by = np.argsort(-length, kind="stable")
        self.begin, self.shorter, self.back = begin[by], -length[by], np.empty_like(by)
        self.back[by] = np.arange(len(by))

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """Of the weights (a row per place, a column per resample) by cell."""
        out = np.zeros((len(self.begin), weights.shape[1]), np.uint16 if int(weights.max(initial=0)) * PIECE_ROWS < 1 << 16 else np.int64)
        for low in range(0, len(out), PIECES):
            begin, shorter, part = (x[low : low + PIECES] for x in (self.begin, self.shorter, out))
            for j in range(-int(shorter[0])):  # the j-th row of all pieces that have one
                more = int(np.searchsorted(shorter, -j, "left"))
                part[:more] += weights.take(self.places[begin[:more] + j], axis=0)
        out = out[self.back]
        return out if len(out) == len(self.pieces) else np.add.reduceat(out, self.pieces, axis=0, dtype=np.int64)


def _counted_deltas(rows: DataFrame, drawn: Resamples) -> DataFrame:
    """``b``, ``delta``: of groups of any size that have few distinct (gold, one) and (gold, two), from counts of these cells under every resample.

    Tasks go through documents in order of leaves and hold their rows as numbers of documents and cells, until these or the weights of a block of resamples
    become too many. Then they sum the weights by cell, one block after the other. What leaves a task is a compressed table for each block, group and side, with
    a row for each cell, so it does not follow the number of rows until that passes HELD_LINES or that of weights passes HELD_COUNTS.
    """
    schema = T.StructType([rows.schema["_g"], T.StructField("_side", T.LongType()), T.StructField("_block", T.LongType()), T.StructField("_cells", T.BinaryType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[dict, dict] = ({}, {})  # by side: the cells of each group, and their numbers
        used, held, leaves, kind = [0, 0], [], 0, None

        def passed_on() -> Iterator[pa.RecordBatch]:
            index = np.concatenate([x[0] for x in held])
            own, at = np.unique(index // drawn.per_leaf, return_inverse=True)
            places = at * drawn.per_leaf + index % drawn.per_leaf
            cells = [_Cells(places, np.concatenate([x[1][side] for x in held]), used[side]) for side in (0, 1)]
            held.clear()
            values: list = [{g: np.array(list(x), np.complex128) for g, x in known[side].items()} for side in (0, 1)]
            order = [{g: np.argsort(v, kind="stable") for g, v in values[side].items()} for side in (0, 1)]
            slots = [{g: np.fromiter(x.values(), np.int64, len(x))[order[side][g]] for g, x in known[side].items()} for side in (0, 1)]
            for block in range(drawn.blocks):
                weights = np.zeros((len(own) * drawn.per_leaf, drawn._size(block)), np.uint8)
                for k, leaf in enumerate(own.tolist()):
                    made = drawn.leaf(block, leaf)
                    if made.max(initial=0) > np.iinfo(weights.dtype).max:
                        weights = weights.astype(np.int64)
                    weights[k * drawn.per_leaf :][: made.shape[1]] = made.T
                for side in (0, 1):
                    sums = cells[side].sums(weights)
                    for g, of in slots[side].items():
                        v, part = values[side][g][order[side][g]], sums[of]
                        part = part.astype(np.min_scalar_type(int(part.max(initial=0)))).T.copy()
                        table = pa.RecordBatch.from_arrays([pa.array(v.real.copy()), pa.array(v.imag.copy()), *map(pa.array, part)], names=["x", "y", *map(str, range(len(part)))])
                        yield pa.RecordBatch.from_arrays([pa.array([{kind.field(0).name: g}], kind), pa.array([side], pa.int64()), pa.array([block], pa.int64()), pa.array([_packed(table)], pa.binary())], names=schema.names)
            for side in (0, 1):
                known[side].clear()
                used[side] = 0

        last = None
        for batch in batches:  # in the order of leaves
            kind, index = batch.column("_g").type, batch.column("_doc").to_numpy()
            labels = batch.column("_g").field(0).dictionary_encode("encode")
            codes, numbers = labels.indices.to_numpy(), np.zeros((2, len(index)), np.int32)
            for code, g in enumerate(labels.dictionary.to_pylist()):
                mine = np.flatnonzero(codes == code)
                for side, column in enumerate(("_one", "_two")):
                    pair = np.stack([batch.column("_gold").to_numpy()[mine], batch.column(column).to_numpy()[mine]], axis=1).view(np.complex128)[:, 0]
                    distinct, inverse = np.unique(pair, return_inverse=True)
                    at, own = known[side].setdefault(g, {}), []
                    for v in distinct.tolist():
                        if v not in at:
                            at[v], used[side] = used[side], used[side] + 1
                        own.append(at[v])
                    numbers[side, mine] = np.array(own, np.int32)[inverse]
            held.append((index.copy(), numbers))
            touched = np.unique(index // drawn.per_leaf)
            leaves += len(touched) - int(len(touched) and touched[0] == last)
            last = touched[-1] if len(touched) else last
            if max(leaves * drawn.per_leaf, *used) * drawn.per_block > HELD_COUNTS or sum(len(x[0]) for x in held) > HELD_LINES:
                yield from passed_on()
                leaves, last = 0, None
        if held:
            yield from passed_on()

    def taus(key: tuple, table: pa.Table) -> pa.Table:
        block, sides, found = key[1].as_py(), table.column("_side").to_numpy(), []
        size = drawn._size(block)
        for side in (0, 1):
            parts = [pa.ipc.open_stream(x.as_buffer()).read_all() for x in table.column("_cells").filter(pa.array(sides == side))]
            pairs = np.concatenate([np.stack([p.column("x").to_numpy(), p.column("y").to_numpy()], axis=1).view(np.complex128)[:, 0] for p in parts])
            values, inverse = np.unique(pairs, return_inverse=True)
            w, begin = np.zeros((size, len(values)), np.int64), 0
            for p in parts:  # a cell is in a part once
                at = inverse[begin : begin + len(p)]
                begin += len(p)
                for i in range(size):
                    w[i, at] += p.column(str(i)).to_numpy()
            tau = weighted_tau_b(values.real.copy(), values.imag.copy())
            found.append([tau(x) if int(x.sum()) > 2 else None for x in w])
        out = [one - two if one is not None and two is not None else None for one, two in zip(*found, strict=True)]
        first = drawn.per_block * block
        return pa.table({"b": pa.array(range(first, first + size), pa.int64()), "delta": pa.array(out, pa.float64())})

    parts = max(1, min(-(-drawn.n // drawn.per_leaf), _tasks(rows)))
    spread = rows.select("_g", "_doc", "_gold", "_one", "_two").repartition(parts, F.floor(F.col("_doc") / drawn.per_leaf)).sortWithinPartitions("_doc")
    return spread.mapInArrow(count, schema).groupBy("_g", "_block").applyInArrow(taus, "b bigint, delta double")


def _large_deltas(rows: DataFrame, drawn: Resamples) -> DataFrame:
    """``b``, ``delta``: of groups that no task holds, from rows weighed under every resample."""
    schema = T.StructType([*rows.schema.fields, T.StructField("b", T.LongType()), T.StructField("_w", T.LongType())])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in range(drawn.blocks):
                for i, w in enumerate(drawn.times(block, batch.column("_doc").to_numpy())):
                    some = np.flatnonzero(w)
                    part = batch.take(pa.array(some))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(some), block * drawn.per_block + i)), pa.array(w[some])], names=schema.names)

    weighed = rows.repartition(F.floor(F.col("_doc") / drawn.per_leaf)).sortWithinPartitions("_doc").mapInArrow(weigh, schema)
    sizes = weighed.groupBy("_g", "b").agg(F.sum("_w").alias("_n"))
    one, two = (kendall(weighed, ["_g", "b"], "_gold", c, weight="_w").withColumnRenamed("kendall", c) for c in ("_one", "_two"))
    both = one.join(two, ["_g", "b"]).join(sizes, ["_g", "b"])
    return both.select("b", F.when(F.col("_n") > 2, F.col("_one") - F.col("_two")).alias("delta"))


def slope_per_doubling(rows: DataFrame, group: list[str], length: str, value: str) -> DataFrame:
    """Least-squares slope of a value on the binary logarithm of a length."""
    return rows.groupBy(*group).agg(F.regr_slope(F.col(value), F.log2(F.col(length))).alias("slope"), F.count(F.lit(1)).alias("n"))
