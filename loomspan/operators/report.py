"""Tables of reports: comparisons with a baseline, regimes, coverage, mismatches; JSON as a sink format."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def against_baseline(cells: DataFrame, keys: list[str], arm: str, base: str, value: str) -> DataFrame:
    """Each arm's value beside its baseline's, with the difference; a missing side stays null, 0 is a value."""
    at = cells.filter(F.col(arm) == base).select(*keys, F.col(value).alias("base"))
    return cells.join(at, keys, "left").withColumn("delta", F.col(value) - F.col("base"))


def comparison_table(cells: DataFrame, rows: list[str], k: str, ks: list[int], value: str) -> DataFrame:
    """One column per k."""
    return cells.groupBy(*rows).pivot(k, ks).agg(F.first(value)).withColumnsRenamed({str(x): f"k{x}" for x in ks})


def arms_table(cells: DataFrame, family: str, mix: str, frozen: str, k: str, value: str, ks: list[int], contaminated: list[str], order: list[str]) -> DataFrame:
    """A row per arm (family, mix, frozen): a column per k, the gain at the first k over the family's base, and where it is shown.

    The base is the mix "base". ``contaminated`` marks arms whose training data hold evaluation rows: their values are
    memory, not agreement. ``place`` numbers the arms of a family by the order of mixes (others after them), then trained before frozen,
    then by name.
    """
    wide = comparison_table(cells, [family, mix, frozen], k, ks, value)
    first = f"k{ks[0]}"
    base = wide.filter(F.col(mix) == "base").groupBy(family).agg(F.max(first).alias("_base"))
    told = wide.join(base, family, "left").withColumns({"delta": F.col(first) - F.col("_base"), "contaminated": F.col(mix).isin(*contaminated)})
    return display_order(told.drop("_base"), [family], mix, frozen, order)


def display_order(arms: DataFrame, group: list[str], mix: str, frozen: str, order: list[str], name: str = "place") -> DataFrame:
    """Adds the place (from 1) of each arm of a group."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(mix)).cast("int")
    known = F.when(rank > 0, rank).otherwise(len(order) + 1)
    return arms.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(known, frozen, mix)))


def movement(delta: str, least: float = 0.004):
    """up, down or flat."""
    d = F.col(delta)
    return F.when(d >= least, "up").when(d <= -least, "down").when(d.isNotNull(), "flat")


def regimes(cells: DataFrame, by: list[str], k: str, value: str) -> DataFrame:
    """Means over single segments (k = 1), windows (2, 3, 4, 6) and documents (k = 0)."""
    c, v = F.col(k), F.col(value)
    return cells.groupBy(*by).agg(F.avg(F.when(c == 1, v)).alias("single"), F.avg(F.when(c.isin(2, 3, 4, 6), v)).alias("windows"), F.avg(F.when(c == 0, v)).alias("document"))


def drop_thin(cells: DataFrame, counts: DataFrame, keys: list[str], n: str, least: int = 100) -> DataFrame:
    """Cells whose baseline has at least so many rows."""
    return cells.join(counts.filter(F.col(n) >= least).select(*keys), keys, "left_semi")


def mismatches(measured: DataFrame, told: DataFrame, key: str, n: str) -> DataFrame:
    """Keys whose measured and advertised counts differ, or that one side lacks."""
    both = measured.select(key, F.col(n).alias("measured")).join(told.select(key, F.col(n).alias("advertised")), key, "full")
    return both.filter(~F.col("measured").eqNullSafe(F.col("advertised")))


def counts_by_level(rows: DataFrame, levels: list[list[str]]) -> DataFrame:
    """Counts at several levels in one pass; ``level`` names the columns that a row is counted by."""
    columns = list(dict.fromkeys(c for level in levels for c in level))
    name = F.concat_ws("+", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in columns])
    return rows.groupingSets([[F.col(c) for c in level] for level in levels], *map(F.col, columns)).agg(F.count(F.lit(1)).alias("n"), name.alias("level"))


def category_shares(windows: DataFrame, categories: str, least: list[int]) -> tuple[DataFrame, DataFrame]:
    """Share of each category over all edits, and share of windows with at least so many distractors."""
    edits = windows.select(F.explode(F.flatten(categories)).alias("category"))
    total = edits.agg(F.count(F.lit(1)).alias("_n"))
    shares = edits.groupBy("category").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_n")).drop("_n")
    coverage = windows.withColumn("d", F.explode(F.array(*map(F.lit, least)))).groupBy("d").agg(F.avg((F.size(categories) >= F.col("d")).cast("double")).alias("coverage"))
    return shares, coverage


def nested_json(cells: DataFrame, model: str, file: str, k: str, metrics: list[str]) -> DataFrame:
    """model -> file -> k (as a string) -> cell, as one JSON string per model."""
    inner = cells.groupBy(model, file).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(k).cast("string").alias("key"), F.struct(*metrics).alias("value"))))).alias("m"))
    outer = inner.groupBy(model).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(file).alias("key"), F.to_json("m").alias("value"))))).alias("m"))
    return outer.select(model, F.to_json("m").alias("json"))


def best_of(rows: DataFrame, by: list[str], value: str, key: str) -> DataFrame:
    """The row of the greatest (value, key) of each group: peaks of curves, best checkpoints."""
    return rows.groupBy(*by).agg(F.max(F.struct(value, key)).alias("_b")).select(*by, F.col(f"_b.{value}").alias(value), F.col(f"_b.{key}").alias(key))


def heat_map(cells: DataFrame, row: str, column: str, columns: list[str], value: str) -> DataFrame:
    """Rows by columns, with the row's mean over its defined cells."""
    wide = cells.groupBy(row).pivot(column, columns).agg(F.avg(value))
    mean = cells.groupBy(row).agg(F.avg(value).alias("row_mean"))
    return wide.join(mean, row)
