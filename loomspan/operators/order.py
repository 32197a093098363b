"""Positions in the order of a value, for groups of any size: no task sorts a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Slices that a group's values are cut into, and the accuracy of the cuts; both only balance the work.
SLICES, ACCURACY = 64, 1000


def cumulative(counts: DataFrame, group: list[str], value: str, n: str = "n") -> DataFrame:
    """Adds ``before``, the sum of ``n`` over the smaller values of the group, to rows of distinct (group, value).

    Approximate quantiles cut each group into slices in the order of values; sums per slice, a small table, shift the
    sums inside each slice. Any cuts give the same result. Null groups are groups; values must not be null.
    """
    keyed = counts.withColumn("_key", F.struct(*group))
    marks = [F.lit(i / SLICES) for i in range(1, SLICES)]
    cuts = keyed.groupBy("_key").agg(F.percentile_approx(value, F.array(*marks), ACCURACY).alias("_cuts"))
    sliced = keyed.join(cuts, "_key").withColumn("_slice", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    sums = sliced.groupBy("_key", "_slice").agg(F.sum(n).alias("_sum"))
    shift = sums.select("_key", "_slice", (F.sum("_sum").over(Window.partitionBy("_key").orderBy("_slice")) - F.col("_sum")).alias("_shift"))
    inside = F.sum(n).over(Window.partitionBy("_key", "_slice").orderBy(value)) - F.col(n)
    return sliced.withColumn("_inside", inside).join(shift, ["_key", "_slice"]).withColumn("before", F.col("_shift") + F.col("_inside")).drop("_key", "_slice", "_inside", "_shift")


def percentiles(rows: DataFrame, group: list[str], value: str, shares: list[float]) -> DataFrame:
    """Per group the exact percentiles of a value, linear between ranks, as an array ``q`` in the order of ``shares``."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.select(F.struct(*group).alias("_key"), "n").groupBy("_key").agg(F.sum("n").alias("_all"))
    placed = cumulative(counts, group, value).withColumn("_key", F.struct(*group)).join(sizes, "_key")
    at = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("_all") - 1)).alias("at")) for i, p in enumerate(shares)])
    ends = F.flatten(F.transform(at, lambda x: F.array(F.struct(x["i"].alias("i"), F.lit(0).alias("side"), F.floor(x["at"]).alias("k"), x["at"].alias("at")), F.struct(x["i"].alias("i"), F.lit(1).alias("side"), F.ceil(x["at"]).alias("k"), x["at"].alias("at")))))
    hits = placed.select("_key", F.col(value).cast("double").alias("_v"), F.explode(F.filter(ends, lambda x: (x["k"] >= F.col("before")) & (x["k"] < F.col("before") + F.col("n")))).alias("h"))

    def quantile(i: int):
        low, high = (F.max(F.when((F.col("h.i") == i) & (F.col("h.side") == s), F.col("_v"))) for s in (0, 1))
        part = F.max(F.when(F.col("h.i") == i, F.col("h.at") - F.floor("h.at")))
        return F.when(part > 0, low + part * (high - low)).otherwise(low)

    found = hits.groupBy("_key").agg(F.array(*[quantile(i) for i in range(len(shares))]).alias("q"))
    return found.select(*[F.col("_key").getField(g).alias(g) for g in group], "q")
