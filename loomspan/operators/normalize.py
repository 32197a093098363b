"""Score normalisation: z-score and sigmoid by group. The three variants differ in what they fit on and in constant groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.numeric import sigmoid


def fit_on_train(rows: DataFrame, group: list[str], score: str, is_train: str) -> DataFrame:
    """Mean and sample deviation of the train rows of each group, applied to all its rows.

    A deviation that is null (one row) or 0 counts as 1. Groups without train rows abort the query.
    """
    fitted = rows.filter(is_train).groupBy(*group).agg(F.avg(score).alias("_mu"), F.stddev_samp(score).alias("_sd"))
    joined = rows.join(fitted, group, "left")
    mu = F.when(F.col("_mu").isNull(), F.raise_error(F.lit("a group has no train rows")).cast("double")).otherwise(F.col("_mu"))
    z = (F.col(score) - mu) / F.coalesce(F.nullif(F.col("_sd"), F.lit(0.0)), F.lit(1.0))
    return joined.withColumn(score, sigmoid(z)).drop("_mu", "_sd")


def unfitted_groups(rows: DataFrame, group: list[str], is_train: str) -> DataFrame:
    """Groups with rows but no train rows."""
    return rows.filter(f"NOT {is_train}").select(*group).distinct().join(rows.filter(is_train).select(*group).distinct(), group, "left_anti")


def _with_stats(rows: DataFrame, group: list[str], stats: list) -> DataFrame:
    """Rows joined with aggregates of their group (null groups included); the group is never held in one task."""
    found = rows.groupBy(F.struct(*group).alias("_key")).agg(*stats)
    return rows.withColumn("_key", F.struct(*group)).join(found, "_key").drop("_key")


def fit_on_self(rows: DataFrame, group: list[str], score: str, only_outside: list[str] | None = None) -> DataFrame:
    """Each group fitted on itself; with ``only_outside``, only in files (these columns) whose scores leave [0, 1]."""
    columns = rows.columns
    z = (F.col(score) - F.col("_mu")) / F.coalesce(F.nullif("_sd", F.lit(0.0)), F.lit(1.0))
    fitted = _with_stats(rows, group, [F.avg(score).alias("_mu"), F.stddev_samp(score).alias("_sd")])
    value = sigmoid(z)
    if only_outside is not None:
        fitted = _with_stats(fitted, only_outside, [F.min(score).alias("_low"), F.max(score).alias("_high")])
        value = F.when((F.col("_low") < 0) | (F.col("_high") > 1), value).otherwise(F.col(score))
    return fitted.withColumn(score, value).select(*columns)


def constant_half(rows: DataFrame, group: list[str], score: str) -> DataFrame:
    """Fitted on all rows of the group; a constant group gives 0.5, a group of one row gives null."""
    fitted = _with_stats(rows, group, [F.avg(score).alias("_mu"), F.stddev_samp(score).alias("_sd")])
    z = (F.col(score) - F.col("_mu")) / F.nullif("_sd", F.lit(0.0))
    return fitted.withColumn(score, F.when(F.col("_sd") == 0, F.lit(0.5)).otherwise(sigmoid(z))).select(*rows.columns)
