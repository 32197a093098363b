"""Selecting rows: splits, coverage, frequency, budgets, changed documents; joins by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.hashing import held_out
from loomspan.functions.text import n_tokens


def split_by_document(rows: DataFrame, doc: str, share: float = 0.10, name: str = "split") -> DataFrame:
    """train or val, by the document's hash."""
    return rows.withColumn(name, F.when(held_out(F.col(doc), share), "val").otherwise("train"))


def split_by_map(rows: DataFrame, assigned: DataFrame, keys: list[str], names: dict[str, str]) -> DataFrame:
    """Predefined splits: rows of listed documents, their split renamed; others go."""
    named = assigned.filter(F.col("split").isin(*names)).withColumn("split", F.coalesce(*[F.when(F.col("split") == a, b) for a, b in names.items()]))
    return rows.join(named, keys)


def frequent_groups(rows: DataFrame, group: list[str], least: int) -> DataFrame:
    """Rows of groups that have at least so many."""
    often = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select(*group)
    return rows.join(often, group, "left_semi")


def token_budget(rows: DataFrame, texts: list[str], pair: tuple[str, str], most: int, most_pair: int, counter: Callable[[Column], Column] = n_tokens) -> DataFrame:
    """Rows whose every text has at most ``most`` tokens and whose pair has at most ``most_pair`` together."""
    counted = rows.withColumns({f"n_{t}": counter(F.col(t)) for t in texts})
    fits = F.lit(True)
    for t in texts:
        fits = fits & (F.col(f"n_{t}") <= most)
    return counted.filter(fits & (F.col(f"n_{pair[0]}") + F.col(f"n_{pair[1]}") <= most_pair))


def shared_keys(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Keys that every table has."""
    named = [df.select(key).distinct().withColumn("_t", F.lit(name)) for name, df in tables.items()]
    out = named[0]
    for df in named[1:]:
        out = out.unionByName(df)
    return out.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == len(tables)).select(key)


def complete_ids(rows: DataFrame, key: list[str], lang: str, n_langs: int) -> DataFrame:
    """Rows whose key occurs in all languages."""
    whole = rows.groupBy(*key).agg(F.count_distinct(lang).alias("_n")).filter(F.col("_n") == n_langs).select(*key)
    return rows.join(whole, key, "left_semi")


def id_order(column: str) -> list:
    """Numeric ids first and by number, others after them by text."""
    c = F.col(column)
    return [F.when(c.rlike(r"^\d+$"), 0).otherwise(1), c.try_cast("bigint"), c]


def first_ids(rows: DataFrame, column: str, n: int) -> DataFrame:
    """Rows of the first n distinct ids in that order."""
    first = rows.select(column).distinct().orderBy(*id_order(column)).limit(n)
    return rows.join(first, column, "left_semi")


def first_per_group(rows: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn("_at", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("_at") <= n).drop("_at")


def with_references(rows: DataFrame, refs: DataFrame, keys: list[str], ref: str, order: list[str], keep_missing: bool = False) -> DataFrame:
    """Adds the reference of each row's key, the last of several; rows without one, or with an empty one, go unless kept."""
    last = refs.groupBy(*keys).agg(F.max_by(ref, F.struct(*order)).alias(ref))
    joined = rows.join(last, keys, "left" if keep_missing else "inner")
    return joined if keep_missing else joined.filter((F.col(ref).isNotNull()) & (F.col(ref) != ""))


def changed_documents(rows: DataFrame, group: list[str], before: str, after: str) -> DataFrame:
    """Rows of groups of which at least one row's text changed; a null and a text differ, two nulls do not."""
    changed = rows.filter(~F.col(before).eqNullSafe(F.col(after))).select(F.struct(*group).alias("_key")).distinct()
    return rows.withColumn("_key", F.struct(*group)).join(changed, "_key", "left_semi").drop("_key")


def assert_paired(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that one side lacks: empty when both have the same."""
    left, right = a.select(*keys).distinct(), b.select(*keys).distinct()
    return left.join(right, keys, "left_anti").withColumn("missing_in", F.lit("b")).unionByName(right.join(left, keys, "left_anti").withColumn("missing_in", F.lit("a")))


def splice_first(longer: DataFrame, single: DataFrame, keys: list[str], texts: str, reference: str) -> DataFrame:
    """Single-edit control: variants of the one-segment block, continued by the rest of the longer block's reference.

    ``single`` has the reference of the first segment and its variants; ``longer`` the whole reference. Each variant
    gets what follows the first segment in the whole reference.
    """
    one = single.select(*keys, F.col(reference).alias("_first"), F.col(texts).alias("_variants"))
    rest = F.substring(F.col(reference), F.length("_first") + 1, F.length(reference))
    return longer.join(one, keys).withColumn(texts, F.transform("_variants", lambda v: F.concat(v, rest))).drop("_first", "_variants")
