"""Correlations by group: Pearson, Spearman, Kendall tau-b; and means of the cells."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.sources.scratch import Scratch

from .order import cumulative

#: Distinct pairs of values of a group that one task counts at a time, and that are held against each other.
SLICE_CELLS, PAIRED_CELLS = 200_000, 5_000


def pearson(x: str, y: str) -> Column:
    """Null for constant columns, where ``corr`` would abort the query."""
    sd = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(sd > 1e-15, F.covar_pop(x, y) / F.nullif(sd, F.lit(0.0)))


def cells_of(rows: DataFrame, group: list[str], gold: str, pred: str, weight: str | None = None) -> DataFrame:
    """Distinct pairs of values (``_x``, ``_y``) per group, without nulls, and how often each occurs (``_c``)."""
    full = rows.filter(F.col(gold).isNotNull() & F.col(pred).isNotNull())
    count = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return full.groupBy(*group, F.col(gold).alias("_x"), F.col(pred).alias("_y")).agg(count.alias("_c"))


def spearman(cells: DataFrame, group: list[str]) -> DataFrame:
    """Per group n and the correlation of average ranks (ties at their mean), null if n < 3 or a side is constant.

    Ranks come from :func:`order.cumulative`, so a group is spread over tasks. They are taken from their mean, (n + 1) / 2.
    """
    sizes = cells.groupBy(F.struct(*group).alias("_key")).agg(F.sum("_c").alias("n"))
    ranked = cells.withColumn("_key", F.struct(*group)).join(sizes, "_key")
    for side in ("_x", "_y"):
        counts = cells.groupBy(*group, side).agg(F.sum("_c").alias("n"))
        ranks = cumulative(counts, group, side).select(F.struct(*group).alias("_key"), side, (F.col("before") + (F.col("n") + 1) / 2).alias(f"_r{side}"))
        ranked = ranked.join(ranks, ["_key", side]).withColumn(f"_r{side}", F.col(f"_r{side}") - (F.col("n") + 1) / 2)
    weight = F.col("_c")
    sums = ranked.groupBy("_key", "n").agg(*[F.sum(weight * F.col(a) * F.col(b)).alias(name) for name, a, b in (("_xy", "_r_x", "_r_y"), ("_xx", "_r_x", "_r_x"), ("_yy", "_r_y", "_r_y"))])
    below = F.sqrt("_xx") * F.sqrt("_yy")
    value = F.when((F.col("n") >= 3) & (below > 0), F.col("_xy") / F.nullif(below, F.lit(0.0)))
    return sums.select(*[F.col("_key").getField(g).alias(g) for g in group], "n", value.alias("spearman"))


def correlations(rows: DataFrame, group: list[str], gold: str, pred: str) -> DataFrame:
    """n, pearson, spearman and kendall per group; the three are null if n < 3 or a side is constant.

    Rows with a null on either side are left out.
    """
    full = rows.filter(F.col(gold).isNotNull() & F.col(pred).isNotNull())
    key = F.struct(*group).alias("_key")
    linear = full.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= 3, pearson(gold, pred)).alias("pearson"))
    ranks = spearman(cells_of(rows, group, gold, pred), group).select(key, "spearman")
    taus = kendall(full, group, gold, pred).select(key, "kendall")
    whole = linear.join(ranks, "_key", "left").join(taus, "_key", "left")
    tau = F.when((F.col("n") >= 3) & F.col("pearson").isNotNull(), F.col("kendall"))
    return whole.select(*[F.col("_key").getField(g).alias(g) for g in group], "n", "pearson", "spearman", tau.alias("kendall"))


def _by_size(cells: DataFrame, group: list[str], most: int) -> tuple[DataFrame, DataFrame | None]:
    """Cells of groups of up to ``most``, and those of larger ones (None if there are none)."""
    sizes = cells.groupBy(F.struct(*group).alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    if sizes.filter(F.col("_n") > most).isEmpty():
        return cells, None
    keyed = cells.withColumn("_of", F.struct(*group)).join(sizes, "_of").drop("_of")
    return keyed.filter(F.col("_n") <= most).drop("_n"), keyed.filter(F.col("_n") > most).drop("_n")


def kendall_pairs(rows: DataFrame, group: list[str], gold: str, pred: str, most: int = PAIRED_CELLS) -> DataFrame:
    """Tau-b from pairs of distinct (gold, pred) cells with their counts: for discrete values, where cells are few.

    The work is the square of a group's cells; groups of more than ``most`` are counted as in :func:`kendall`.
    """
    cells, more = _by_size(cells_of(rows, group, gold, pred), group, most)
    other = cells.withColumnsRenamed({"_x": "_x2", "_y": "_y2", "_c": "_c2"}).withColumn("_key", F.struct(*group)).drop(*group)
    pairs = cells.withColumn("_key", F.struct(*group)).join(other, "_key")
    sx, sy, w = F.signum(F.col("_x") - F.col("_x2")), F.signum(F.col("_y") - F.col("_y2")), F.col("_c") * F.col("_c2")
    sums = pairs.groupBy(*group).agg(F.sum(sx * sy * w).alias("_s"), F.sum(F.abs(sx) * w).alias("_a"), F.sum(F.abs(sy) * w).alias("_b"))
    below = F.sqrt(F.col("_a") * F.col("_b"))
    taus = sums.select(*group, F.when(below > 0, F.col("_s") / F.nullif(below, F.lit(0.0))).alias("kendall"))
    return taus if more is None else taus.unionByName(kendall(more, group, "_x", "_y", weight="_c"))


def tau_b(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> float | None:
    """Kendall's tau-b in n log n, rows counted ``weight`` times; None if a side is constant or there are under two rows."""
    w = np.ones(len(x), np.int64) if weight is None else np.asarray(weight, np.int64)
    keep = w > 0
    x, y, w = np.unique(x[keep], return_inverse=True)[1], np.unique(y[keep], return_inverse=True)[1], w[keep]
    n = int(w.sum())
    if n < 2:
        return None
    pairs = lambda c: int((c * (c - 1) // 2).sum())
    tx, ty = np.bincount(x, weights=w).astype(np.int64), np.bincount(y, weights=w).astype(np.int64)
    cells = np.unique(x * (int(y.max()) + 1) + y, return_inverse=True)[1]
    both = np.bincount(cells, weights=w).astype(np.int64)
    total, same_x, same_y, same = n * (n - 1) // 2, pairs(tx), pairs(ty), pairs(both)
    if same_x == total or same_y == total:
        return None
    order = np.lexsort((y, x))
    discordant = _inversions(y[order], w[order])
    concordant_minus = total - same_x - same_y + same - 2 * discordant
    return concordant_minus / np.sqrt(float(total - same_x) * float(total - same_y))


def weighted_tau_b(x: np.ndarray, y: np.ndarray) -> Callable[[np.ndarray], float | None]:
    """:func:`tau_b` of x and y as a function of the weights, for many weights of the same rows.

    Where the grid of distinct values is small, concordant pairs are counted by sums over it.
    """
    xs, ys = np.unique(x, return_inverse=True)[1], np.unique(y, return_inverse=True)[1]
    wide, high = int(xs.max(initial=-1)) + 1, int(ys.max(initial=-1)) + 1
    if wide * high > max(4 * len(xs), 1):
        return lambda w: tau_b(xs, ys, w)
    at = xs * high + ys

    def tau(w: np.ndarray) -> float | None:
        grid = np.bincount(at, weights=w, minlength=wide * high).reshape(wide, high)
        pairs = lambda c: float((c * (c - 1) / 2).sum())
        total, same_x, same_y, same = pairs(grid.sum(keepdims=True)), pairs(grid.sum(axis=1)), pairs(grid.sum(axis=0)), pairs(grid)
        if total == 0 or same_x == total or same_y == total:
            return None
        concordant = float((grid[1:, 1:] * grid.cumsum(axis=0).cumsum(axis=1)[:-1, :-1]).sum())
        discordant = total - same_x - same_y + same - concordant
        return (concordant - discordant) / np.sqrt((total - same_x) * (total - same_y))

    return tau


def _inversions(values: np.ndarray, weight: np.ndarray) -> int:
    """Weighted pairs i < j with values[i] > values[j], by merging halves."""
    if len(values) < 2:
        return 0
    if len(values) <= 64:
        later = np.triu(values[:, None] > values[None, :], 1)
        return int((later * (weight[:, None] * weight[None, :])).sum())
    half = len(values) // 2
    total = _inversions(values[:half], weight[:half]) + _inversions(values[half:], weight[half:])
    order = np.argsort(values[:half], kind="stable")
    left, sums = values[:half][order], np.concatenate([[0], np.cumsum(weight[:half][order])])
    above = sums[-1] - sums[np.searchsorted(left, values[half:], "right")]
    return total + int((above * weight[half:]).sum())


def kendall(rows: DataFrame, group: list[str], gold: str, pred: str, most: int | None = None, weight: str | None = None) -> DataFrame:
    """Tau-b per group in n log n, null if a side is constant; rows count ``weight`` times.

    Equal (gold, pred) cells are counted before they are shuffled. Groups of up to ``most`` (SLICE_CELLS) cells are each counted by one task, larger
    ones in slices by :func:`_sliced_taus`.
    """
    most = SLICE_CELLS if most is None else most
    cells = cells_of(rows.withColumns({gold: F.col(gold).cast("double"), pred: F.col(pred).cast("double")}), group, gold, pred, weight)
    cells, more = _by_size(cells, group, most)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        tau = tau_b(*(table.column(c).to_numpy() for c in ("_x", "_y", "_c")))
        return pa.table({**{g: pa.array([k.as_py()], table.schema.field(g).type) for g, k in zip(group, key, strict=True)}, "kendall": pa.array([tau], pa.float64())})

    taus = cells.groupBy(*group).applyInArrow(run, cells.select(*group).schema.add("kendall", "double"))
    return taus if more is None else taus.unionByName(_sliced_taus(more, group, most))


def _exact(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(38, 0)")


def _pairs_in(column: str) -> Column:
    n = F.col(column).cast("decimal(19, 0)")
    return _exact(n * (n - 1) / 2)


def _sliced(cells: DataFrame, side: str) -> DataFrame:
    """Adds ``_s`` and the side's name: the number of a slice of about ``_size`` cells in the order of the side's values.

    Equal values share a slice. Slices with even numbers hold up to twice ``_size`` cells; a value with more than ``_size`` has a slice, with an odd number, for itself.
    """
    values = cells.groupBy("_key", "_size", side).agg(F.count(F.lit(1)).alias("n"))
    number = 2 * F.floor(F.col("before") / F.col("_size")) + (F.col("n") > F.col("_size")).cast("long")
    placed = cumulative(values.withColumnRenamed("_key", "_group"), ["_group"], side).withColumnRenamed("_group", "_key").select(F.struct("_key", side).alias("_at"), number.alias(f"_s{side}"))
    return cells.withColumn("_at", F.struct("_key", side)).join(placed, "_at").drop("_at")


def _discordant(cells: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """``_key``, ``_d``: weighted pairs of cells of each group that x and y order in opposite ways, as rows to be summed.

    Pairs in one x-slice are counted there, pairs in one y-slice but different x-slices there, and all others between cells of the
    grid of slices: the same task again, on a quarter of the cells at most, since slices have at least four times the root of their number.
    """
    sizes = cells.groupBy("_key").agg(F.greatest(F.lit(float(most)), F.ceil(4 * F.sqrt(F.count(F.lit(1))))).alias("_size"))
    cut = scratch.save(_sliced(_sliced(cells.join(sizes, "_key"), "_x"), "_y"), "slices")
    inside = T.StructType([cut.schema["_key"], T.StructField("_d", T.DecimalType(38, 0))])

    def within(first: str):
        def run(key: tuple, table: pa.Table) -> pa.Table:
            x, y, w = (table.column(c).to_numpy() for c in (first, "_y", "_c"))
            order = np.lexsort((y, x))
            return pa.table({"_key": table.column("_key")[:1], "_d": pa.array([_inversions(y[order], w[order])], pa.decimal128(38, 0))})

        return run

    by_x = cut.filter(F.col("_s_x") % 2 == 0).groupBy("_key", "_s_x").applyInArrow(within("_x"), inside)
    by_y = cut.filter(F.col("_s_y") % 2 == 0).groupBy("_key", "_s_y").applyInArrow(within("_s_x"), inside)
    grid = scratch.save(cut.groupBy("_key", F.col("_s_x").cast("double").alias("_x"), F.col("_s_y").cast("double").alias("_y")).agg(F.sum("_c").alias("_c")), "grid")
    small, large = _by_size(grid, ["_key"], most)
    found = by_x.unionByName(by_y).unionByName(small.groupBy("_key").applyInArrow(within("_x"), inside))
    return found if large is None else found.unionByName(_discordant(large, most, scratch))


def _sliced_taus(cells: DataFrame, group: list[str], most: int) -> DataFrame:
    """Tau-b of groups that no task holds, from counts of ties and of discordant pairs in slices; sums are exact decimals."""
    scratch = Scratch(cells.sparkSession, "kendall")
    keyed = scratch.save(cells.select(F.struct(*group).alias("_key"), "_x", "_y", F.col("_c").cast("long").alias("_c")), "cells")

    def ties(*by: str) -> DataFrame:
        return keyed.groupBy("_key", *by).agg(F.sum("_c").alias("_c")).groupBy("_key").agg(F.sum(_pairs_in("_c")).alias("".join(["_t", *by])))

    sums = ties().join(ties("_x"), "_key").join(ties("_y"), "_key").join(ties("_x", "_y"), "_key")
    sums = sums.join(_discordant(keyed, most, scratch).groupBy("_key").agg(F.sum("_d").alias("_d")), "_key")
    above = _exact("_t") - F.col("_t_x") - F.col("_t_y") + F.col("_t_x_y") - 2 * F.col("_d")
    below = F.sqrt((F.col("_t") - F.col("_t_x")).cast("double")) * F.sqrt((F.col("_t") - F.col("_t_y")).cast("double"))
    return sums.select(*[F.col("_key").getField(g).alias(g) for g in group], F.when(below > 0, above.cast("double") / F.nullif(below, F.lit(0.0))).alias("kendall"))


def macro_mean(cells: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Mean of the defined cells over files."""
    return cells.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics])


def over_languages(cells: DataFrame, by: list[str], counts: list[str], rates: list[str]) -> DataFrame:
    """Counts are summed over languages, rates averaged; undefined cells are skipped."""
    return cells.groupBy(*by).agg(*[F.sum(c).alias(c) for c in counts], *[F.avg(r).alias(r) for r in rates])
