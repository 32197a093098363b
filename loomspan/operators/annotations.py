"""Annotation roll-ups: duplicate ratings, annotators, error weights; and checks on scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_by(column: str, order: list[str]) -> Column:
    """The first non-null value in an order of rows; deterministic, unlike ``first``."""
    return F.min_by(column, F.when(F.col(column).isNotNull(), F.struct(*order)))


def average_ratings(rows: DataFrame, keys: list[str], score: str, firsts: list[str], order: list[str]) -> DataFrame:
    """One row per segment: mean score over raters, and the first texts."""
    return rows.groupBy(*keys).agg(F.avg(score).alias(score), *[first_by(c, order).alias(c) for c in firsts])


def error_weight(severity: Column, category: Column) -> Column:
    """Major 5, or 25 for non-translation; minor 1, or 0.1 for fluency/punctuation; anything else 0."""
    s, c = F.lower(F.trim(F.coalesce(severity, F.lit("")))), F.lower(F.trim(F.coalesce(category, F.lit(""))))
    minor = F.when(c.contains("fluency") & c.contains("punctuation"), 0.1).otherwise(1.0)
    return F.when(s == "major", F.when(c.contains("non-translation"), 25.0).otherwise(5.0)).when(s == "minor", minor).otherwise(0.0)


def two_level_rollup(errors: DataFrame, keys: list[str], rater: str, weight: str, score: str = "score", first: str | None = None) -> DataFrame:
    """Errors are summed per rater, averaged over raters and negated; raters without weight count as 0. ``first`` is a column whose smallest value goes along."""
    least = [F.min(first).alias(first)] if first else []
    per_rater = errors.groupBy(*keys, rater).agg(F.sum(weight).alias("_w"), *least)
    return per_rater.groupBy(*keys).agg((F.lit(0.0) - F.avg("_w")).alias(score), *least)


def severity_penalty(severity: Column) -> Column:
    """Minor -1, major -5, critical -25, no error and neutral 0; unknown or missing -1."""
    s = F.lower(F.trim(F.coalesce(severity, F.lit("minor"))))
    return F.when(s == "major", -5.0).when(s == "critical", -25.0).when(s.isin("no-error", "neutral"), 0.0).otherwise(-1.0)


def penalties(errors: Column) -> Column:
    """Sum of penalties over an array of errors with a ``severity``."""
    return F.aggregate(F.coalesce(errors, F.array().cast("array<struct<severity:string>>")), F.lit(0.0), lambda a, e: a + severity_penalty(e["severity"]))


NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def numeric_only(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose columns all are decimal numbers, white space around them aside, cast to double."""
    cast = rows.withColumns({c: F.when(F.col(c).cast("string").rlike(NUMBER), F.col(c).try_cast("double")) for c in columns})
    return cast.na.drop(subset=columns)


def checked_range(column: str, low: float | None, high: float | None) -> Column:
    """The column, aborting the query where it lies outside the range."""
    c = F.col(column)
    bad = F.lit(False)
    if low is not None:
        bad = bad | (c < low)
    if high is not None:
        bad = bad | (c > high)
    return F.when(bad, F.raise_error(F.concat(F.lit(f"{column} out of range: "), c.cast("string"))).cast("double")).otherwise(c)
