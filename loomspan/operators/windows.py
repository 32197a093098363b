"""Sequence operators: contiguous windows, blocks, prefixes and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def windows(segments: DataFrame, group: list[str], seg: str, k: int, stride: int, texts: list[str], score: str | None = None) -> DataFrame:
    """Full windows of k consecutive segments of each group, at starts 0, stride, 2 stride, ... in segment order.

    A gap in the segment numbers yields no window across it, and does not move the starts. Texts are joined by one
    space, the score is the mean. Segments must be unique in their group.
    """
    if k < 1 or stride < 1:
        raise ValueError("k and stride are at least 1")
    order = Window.partitionBy(*group).orderBy(seg)
    frame = order.rowsBetween(0, k - 1)
    rows = segments.withColumns({"_at": F.row_number().over(order) - 1, "_last": F.max(seg).over(frame), "_size": F.count(F.lit(1)).over(frame), **{f"_{t}": F.collect_list(t).over(frame) for t in texts}, **({"_score": F.avg(score).over(frame)} if score else {})})
    kept = rows.filter((F.col("_size") == k) & (F.col("_last") - F.col(seg) == k - 1) & (F.col("_at") % stride == 0))
    return kept.select(*group, F.col(seg).alias("seg_start"), F.lit(k).alias("k"), *[F.array_join(f"_{t}", " ").alias(t) for t in texts], *([F.col("_score").alias(score)] if score else []))


def slide(segments: DataFrame, group: list[str], seg: str, w: int, texts: list[str], score: str | None = None) -> DataFrame:
    """All stride-1 windows of w segments by position; a group of w or fewer is one window."""
    order = Window.partitionBy(*group).orderBy(seg)
    frame = order.rowsBetween(0, w - 1)
    whole = Window.partitionBy(*group)
    rows = segments.withColumns({"_at": F.row_number().over(order) - 1, "_n": F.count(F.lit(1)).over(whole), **{f"_{t}": F.collect_list(t).over(frame) for t in texts}, **({"_score": F.avg(score).over(frame)} if score else {})})
    kept = rows.filter(F.col("_at") <= F.greatest(F.col("_n") - w, F.lit(0)))
    return kept.select(*group, F.col("_at").cast("int").alias("start"), F.least(F.col("_n"), F.lit(w)).cast("int").alias("size"), *[F.array_join(F.filter(F.transform(f"_{t}", lambda x: F.trim(x)), lambda x: F.length(x) > 0), " ").alias(t) for t in texts], *([F.col("_score").alias(score)] if score else []))


def document_means(windows_: DataFrame, group: list[str], scores: list[str]) -> DataFrame:
    """Mean of each score over a document's windows."""
    return windows_.groupBy(*group).agg(*[F.avg(s).alias(s) for s in scores], F.count(F.lit(1)).alias("n_windows"))


def runs(sentences: DataFrame, part: list[str], key: str, row: str) -> DataFrame:
    """Adds ``run`` and ``at``: maximal runs of consecutive rows with one key, and the place in the run.

    Consecutive rows of one key have a constant difference of row number and rank, so no window needs more than the
    rows of one key.
    """
    order = Window.partitionBy(*part, key).orderBy(row)
    marked = sentences.withColumn("run", F.col(row) - F.row_number().over(order))
    return marked.withColumn("at", F.row_number().over(Window.partitionBy(*part, key, "run").orderBy(row)) - 1)


def build_blocks(sentences: DataFrame, sizes: list[int], part: list[str], key: str, row: str, carry: list[Column] | None = None) -> DataFrame:
    """Blocks of k consecutive rows of one key, for every k at once; the rest of a run is dropped.

    Returns part, key, ``k``, ``first_row``, ``rows`` (in order) and the collected columns of ``carry`` in row order.
    """
    if not sizes or min(sizes) < 1:
        raise ValueError("block sizes are at least 1")
    placed = runs(sentences, part, key, row).withColumn("k", F.explode(F.array(*map(F.lit, sizes))))
    placed = placed.withColumn("chunk", F.floor(F.col("at") / F.col("k")).cast("int"))
    carried = carry or []
    packed = F.array_sort(F.collect_list(F.struct(F.col(row).alias("_row"), *carried)))
    blocks = placed.groupBy(*part, key, "run", "k", "chunk").agg(packed.alias("_b")).filter(F.size("_b") == F.col("k"))
    names = [n for n in blocks.schema["_b"].dataType.elementType.names if n != "_row"]
    return blocks.select(*part, key, "k", F.get("_b._row", F.lit(0)).alias("first_row"), F.col("_b._row").alias("rows"), *[F.col(f"_b.{n}").alias(n) for n in names])


def prefix_blocks(windows_: DataFrame, rows: str, sizes: list[int]) -> DataFrame:
    """Of each window of the largest size its first k rows, for every k: blocks of one window nest."""
    return windows_.withColumn("k", F.explode(F.array(*map(F.lit, sizes)))).withColumn(rows, F.slice(rows, F.lit(1), F.col("k")))


def row_position(rows: DataFrame, group: list[str], order: list[str], name: str = "position") -> DataFrame:
    """1-based position in the group."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def prefix_distinct(rows: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value differs from the values of all earlier rows of the group."""
    at = F.row_number().over(Window.partitionBy(*group, value).orderBy(order))
    return rows.withColumn("_at", at).filter("_at = 1").drop("_at")


def global_ids(rows: DataFrame, part: str, row: str, name: str = "window_id", slice_rows: int = 100_000) -> DataFrame:
    """Consecutive ids from 0 over ordered parts and, inside each, row numbers; no task sorts more than a slice of them.

    Numbers of rows per slice, a small table, shift each slice's own ranks.
    """
    sliced = rows.withColumn("_slice", F.floor(F.col(row) / F.lit(slice_rows)))
    sizes = sliced.groupBy(part, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy(part, "_slice")) - F.col("_n")).select(part, "_slice", "_before")
    own = F.row_number().over(Window.partitionBy(part, "_slice").orderBy(row))
    return sliced.withColumn("_own", own).join(before, [part, "_slice"]).withColumn(name, F.col("_before") + F.col("_own") - 1).drop("_slice", "_own", "_before")
