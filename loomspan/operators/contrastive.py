"""Contrastive accuracy: original against perturbed documents, window by window."""

from __future__ import annotations

from math import exp, lgamma, log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import slide

# Kinds of perturbation, those that keep the quality (their accuracy is a false-positive rate), and sparse ones.
STRUCTURAL = ("sentence_removal", "sentence_repetition", "sentence_shuffling", "sentence_splitting")
LEXICAL = ("conjunction_substitution", "tense_consistency", "lexical_consistency", "pronoun_swap_singular", "pronoun_swap_plural")
QUALITY_PRESERVING = ("sentence_splitting",)
SPARSE = ("pronoun_swap_singular", "pronoun_swap_plural")


def accuracy(diffs: DataFrame, group: list[str], diff: str = "diff") -> DataFrame:
    """n, share above 0, ties, mean, and the t statistic of a one-sample test (null if n < 2 or no spread)."""
    d = F.col(diff)
    cells = diffs.groupBy(*group).agg(F.count(d).alias("n"), F.avg((d > 0).cast("double")).alias("accuracy"), F.count_if(d == 0).alias("ties"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("_sd"))
    t = F.when((F.col("n") >= 2) & (F.col("_sd") > 0), F.col("mean_diff") / F.nullif(F.col("_sd") / F.sqrt("n"), F.lit(0.0)))
    return cells.withColumn("t", t).drop("_sd")


def micro_accuracy(diffs: DataFrame, cell: list[str], pooled: list[str], diff: str = "diff") -> DataFrame:
    """Accuracy per cell and pooled over the columns that ``pooled`` lacks, in one pass."""
    d = F.col(diff)
    sets = diffs.groupingSets([[*map(F.col, cell)], [*map(F.col, pooled)]], *map(F.col, cell))
    return sets.agg(F.count(d).alias("n"), F.avg((d > 0).cast("double")).alias("accuracy"), F.count_if(d == 0).alias("ties"), F.avg(d).alias("mean_diff"))


def with_p_value(cells: DataFrame) -> DataFrame:
    """Adds the two-sided p-value of ``t`` with n - 1 degrees of freedom; cells are few, t may be null."""

    @F.pandas_udf("double")
    def p(t, n):
        import pandas as pd

        return pd.Series([None if x != x else student_p(x, m - 1) for x, m in zip(t, n, strict=True)], dtype="float64")

    return cells.withColumn("p", p("t", "n"))


def student_p(t: float, df: int) -> float:
    """Two-sided tail of Student's t, by the regularised incomplete beta function."""
    return _beta(df / 2, 0.5, df / (df + t * t))


def _beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    if x >= (a + 1) / (a + b + 2):
        return 1 - front * _fraction(b, a, 1 - x) / b
    return front * _fraction(a, b, x) / a


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / ((1 + num * d) or tiny), (1 + num / c) or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-13:
            break
    return h


def document_diffs(segments: DataFrame, group: list[str], seg: str, w: int, original: str, perturbed: str) -> DataFrame:
    """Per document the mean score of its windows, original minus perturbed; scores are per segment, a window's their mean."""
    scored = segments.withColumn("_d", F.col(original) - F.col(perturbed))
    return slide(scored, group, seg, w, [], "_d").groupBy(*group).agg(F.avg("_d").alias("diff"), F.count(F.lit(1)).alias("n_windows"))


def with_meaning(cells: DataFrame, kind: str = "perturbation") -> DataFrame:
    """Adds ``family`` and ``false_positive_rate``: accuracy on a perturbation that keeps the quality is the latter."""
    k = F.col(kind)
    return cells.withColumns({"family": F.when(k.isin(*STRUCTURAL), "structural").when(k.isin(*LEXICAL), "lexical"), "false_positive_rate": F.when(k.isin(*QUALITY_PRESERVING), F.col("accuracy"))})


def lexical_mean(cells: DataFrame, by: list[str], kind: str = "perturbation", value: str = "accuracy") -> DataFrame:
    """Mean accuracy over the lexical kinds that are not sparse."""
    return cells.filter(F.col(kind).isin(*[x for x in LEXICAL if x not in SPARSE])).groupBy(*by).agg(F.avg(value).alias(value))
