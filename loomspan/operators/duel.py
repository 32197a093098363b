"""Duels of a fixed number of negatives in closed form, shortlists, and the every-sentence protocol.

Ties: a duel or a shortlist hit needs the gold strictly above; a shortlist's rank does not count ties, the
every-sentence rank does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.hashing import draw
from loomspan.functions.numeric import success


def first_variants(candidates: DataFrame) -> DataFrame:
    """Negatives of a duel: the first variant of every position and category."""
    return candidates.filter("kind = 'perturbed' AND variant = 0")


def wins(own: DataFrame, group: list[str]) -> DataFrame:
    """Per block: ``w`` negatives strictly below the gold, ``m`` in all, ``ties``."""
    return own.groupBy(*group, "block_id").agg(F.count_if(F.col("sim") < F.col("gold")).alias("w"), F.count(F.lit(1)).alias("m"), F.count_if(F.col("sim") == F.col("gold")).alias("ties"))


def duels(won: DataFrame, group: list[str], sizes: list[int]) -> DataFrame:
    """For each number of negatives D: success, error, coverage, blocks used and skipped, mean rank 1 + D (m - w) / m."""
    each = won.withColumn("d", F.explode(F.array(*map(F.lit, sizes))))
    use = F.col("m") >= F.col("d")
    p = success(F.col("w"), F.col("m"), F.col("d"))
    rank = F.when(use, 1 + F.col("d") * (F.col("m") - F.col("w")) / F.col("m"))
    out = each.groupBy(*group, "d").agg(F.avg(p).alias("success"), F.avg(use.cast("double")).alias("coverage"), F.count_if(use).alias("n_used"), F.count_if(~use).alias("n_skipped"), F.avg(rank).alias("mean_rank"))
    return out.withColumn("error", 1 - F.col("success"))


def all_negatives(won: DataFrame, group: list[str]) -> DataFrame:
    """Error of beating all negatives, mean number of them, and pairwise win rate."""
    return won.groupBy(*group).agg((1 - F.avg((F.col("w") == F.col("m")).cast("double"))).alias("error_all"), F.avg("m").alias("mean_m"), F.avg(F.col("w") / F.col("m")).alias("pairwise"), F.sum("ties").alias("ties"), F.count(F.lit(1)).alias("n"))


def one_on_one(own: DataFrame, group: list[str]) -> DataFrame:
    """1-vs-1 accuracy with ties, in all, by category and by position."""
    cols = [*map(F.col, group)]
    sets = own.groupingSets([cols, [*cols, F.col("category")], [*cols, F.col("position")]], *cols, F.col("category"), F.col("position"))
    return sets.agg(F.avg((F.col("gold") > F.col("sim")).cast("double")).alias("accuracy"), F.count_if(F.col("gold") == F.col("sim")).alias("ties"), F.count(F.lit(1)).alias("n"))


def balanced_negatives(negatives: DataFrame, group: list[str], n: int, seed: int) -> DataFrame:
    """At most n negatives of each block, drawn round robin over its categories in a hashed order."""
    key = F.xxhash64(F.lit(seed), "block_id", "pool_idx")
    turn = F.row_number().over(Window.partitionBy(*group, "block_id", "category").orderBy(key, "pool_idx"))
    ranked = negatives.withColumn("_t", turn).withColumn("_r", F.row_number().over(Window.partitionBy(*group, "block_id").orderBy("_t", "category", "pool_idx")))
    return ranked.filter(F.col("_r") <= n).drop("_t", "_r")


def shortlists(own: DataFrame, group: list[str], size: int) -> DataFrame:
    """The gold and the first size - 1 negatives of each block: accuracy, mean rank, share beaten, coverage.

    Blocks with fewer negatives are skipped and counted. Coverage pools: lists over blocks.
    """
    at = F.row_number().over(Window.partitionBy(*group, "block_id").orderBy("pool_idx"))
    short = own.withColumn("_at", at).filter(F.col("_at") < size)
    per = short.groupBy(*group, "block_id").agg(F.count(F.lit(1)).alias("_m"), F.max("sim").alias("_max"), F.any_value("gold").alias("gold"), F.count_if(F.col("sim") > F.col("gold")).alias("_above"), F.avg((F.col("gold") > F.col("sim")).cast("double")).alias("_beaten"))
    full = F.col("_m") == size - 1
    return per.groupBy(*group).agg(F.avg(F.when(full, (F.col("gold") > F.col("_max")).cast("double"))).alias("accuracy"), F.avg(F.when(full, 1 + F.col("_above"))).alias("mean_rank"), F.avg(F.when(full, F.col("_beaten"))).alias("beaten"), F.count_if(full).alias("n_lists"), F.count(F.lit(1)).alias("n_blocks"), F.avg(full.cast("double")).alias("coverage"))


def reconstructed_rank(d, pairwise):
    """Mean rank among d negatives from the pairwise win rate: 1 + d (1 - p)."""
    return 1 + d * (1 - pairwise)


def one_negative(negatives: DataFrame, group: list[str], seed: int) -> DataFrame:
    """One negative of each block, drawn by hash."""
    w = Window.partitionBy(*group, "block_id")
    ranked = negatives.withColumns({"_r": F.row_number().over(w.orderBy("pool_idx")) - 1, "_n": F.count(F.lit(1)).over(w)})
    return ranked.filter(F.col("_r") == draw(F.col("_n"), seed, F.col("block_id"))).drop("_r", "_n")


def pooled_coverage(cells: DataFrame, by: list[str]) -> DataFrame:
    """Lists over blocks, summed over languages first: not a mean of ratios."""
    return cells.groupBy(*by).agg(F.sum("n_lists").alias("n_lists"), F.sum("n_blocks").alias("n_blocks")).withColumn("coverage", F.col("n_lists") / F.col("n_blocks"))
