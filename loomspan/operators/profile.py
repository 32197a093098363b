"""Score profiles: distributions, histograms, token bins, pooled quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.numeric import HISTOGRAM, PERCENTILES, histogram_bin, token_bin

from .correlate import correlations
from .order import percentiles


def describe(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """n, mean, sample deviation (0 for one row), extremes, exact percentiles and interquartile range of finite values."""
    v = F.col(value)
    finite = rows.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    names = [f"p{round(p * 100):02d}" for p in PERCENTILES]
    cells = finite.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("sd"), F.min(v).alias("low"), F.max(v).alias("high"), F.count_if(v < HISTOGRAM[0]).alias("under"), F.count_if(v > HISTOGRAM[1]).alias("over"))
    key = F.struct(*group)
    found = percentiles(finite, group, value, list(PERCENTILES)).select(key.alias("_key"), "q")
    out = cells.withColumn("_key", key).join(found, "_key").withColumns({n: F.get("q", F.lit(i)) for i, n in enumerate(names)}).drop("q", "_key")
    return out.withColumn("iqr", F.col("p75") - F.col("p25"))


def histogram(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Counts in all bins of the grid, empty ones included; what lies outside is in none."""
    counted = rows.withColumn("bin", histogram_bin(F.col(value))).filter("bin IS NOT NULL").groupBy(*group, "bin").agg(F.count(F.lit(1)).alias("n"))
    bins = rows.select(*group).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(HISTOGRAM[2] - 1))))
    return bins.join(counted, [*group, "bin"], "left").na.fill(0, ["n"])


def token_bins(rows: DataFrame, group: list[str], counts: list[str], gold: str, pred: str) -> DataFrame:
    """By length bin of each count column: n, means of both scores, medians, token mean and median."""
    long = rows.withColumn("_f", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n_tok")) for c in counts])))
    binned = long.withColumns({"field": F.col("_f.field"), "n_tok": F.col("_f.n_tok"), "bin": token_bin(F.col("_f.n_tok"))})
    return binned.groupBy(*group, "field", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(gold).alias("gold_mean"), F.avg(pred).alias("pred_mean"), F.avg("n_tok").alias("tok_mean"), F.percentile("n_tok", F.lit(0.5)).alias("tok_median"))


def profile_cells(rows: DataFrame, group: list[str], gold: str, pred: str, tokens: str) -> DataFrame:
    """Distribution of predictions joined with the gold's mean, correlations, and token mean and median."""
    side = rows.groupBy(*group).agg(F.avg(gold).alias("gold_mean"), F.avg(tokens).alias("tok_mean"), F.percentile(tokens, F.lit(0.5)).alias("tok_median"))
    return describe(rows, group, pred).join(side, group).join(correlations(rows, group, gold, pred).drop("n"), group)


def spread_ratio(cells: DataFrame, group: list[str], k: str = "k", base: int = 1) -> DataFrame:
    """Interquartile range over that of the base; null where the base is missing or not positive."""
    at = cells.filter(F.col(k) == base).select(*group, F.col("iqr").alias("_base"))
    return cells.join(at, group, "left").withColumn("ratio", F.when(F.col("_base") > 0, F.col("iqr") / F.nullif(F.col("_base"), F.lit(0.0)))).drop("_base")


def pooled_quantiles(hist: DataFrame, group: list[str], quantiles: list[float]) -> DataFrame:
    """Quantiles of histograms summed over files: linear between bin centres, held at the ends; and the pooled mean."""
    low, high, n = HISTOGRAM
    width = (high - low) / n
    pooled = hist.groupBy(*group, "bin").agg(F.sum("n").alias("n"))
    order = Window.partitionBy(*group).orderBy("bin")
    centre = F.lit(low) + (F.col("bin") + 0.5) * F.lit(width)
    cdf = F.sum("n").over(order) / F.nullif(F.sum("n").over(Window.partitionBy(*group)), F.lit(0))
    curve = pooled.withColumns({"centre": centre, "cdf": cdf}).withColumns({"c0": F.lag("centre").over(order), "f0": F.lag("cdf").over(order)})
    mean = pooled.groupBy(*group).agg((F.sum(F.col("n") * centre) / F.nullif(F.sum("n"), F.lit(0))).alias("mean"))
    asked = curve.withColumn("q", F.explode(F.array(*map(F.lit, quantiles))))
    inside = F.col("c0") + (F.col("q") - F.col("f0")) / F.nullif(F.col("cdf") - F.col("f0"), F.lit(0.0)) * (F.col("centre") - F.col("c0"))
    value = F.when(F.col("f0").isNull() | (F.col("cdf") == F.col("f0")), F.col("centre")).otherwise(inside)
    first = asked.filter(F.col("cdf") >= F.col("q")).groupBy(*group, "q").agg(F.min_by(value, "bin").alias("value"))
    return first.join(mean, group)
