"""Lemmas by suffix rules that are induced from pairs of form and lemma: the longest known ending of a word decides.

A rule says what a form that ends in ``suffix`` loses at its end and gets instead. Rules are nodes of a trie over reversed suffixes, kept as a
table; a word meets it by joining its own endings, so neither words nor rules need fit a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of the longest ending that a rule has, the mark of a word's beginning included.
MOST_LETTERS = 10
#: Stands before the first letter, so that a whole word may be an ending.
BEGIN = "^"


def _endings(word, least):
    """All endings of a word with its mark, as (suffix, size), of at most MOST_LETTERS; and a longer word as a whole."""
    marked = F.concat(F.lit(BEGIN), word)
    sizes = F.sequence(least, F.greatest(F.least(F.length(marked), F.lit(MOST_LETTERS)), F.lit(1)))
    whole = F.when(F.length(marked) > MOST_LETTERS, F.array(F.struct(marked.alias("suffix"), F.length(marked).alias("size"))))
    each = F.transform(sizes, lambda n: F.struct(F.right(marked, n).alias("suffix"), n.alias("size")))
    return F.concat(each, F.coalesce(whole, F.array().cast("array<struct<suffix:string,size:int>>")))


def induce(pairs: DataFrame, form: str = "form", lemma: str = "lemma", least: int = 2) -> DataFrame:
    """Rules (``suffix``, ``cut``, ``put``, ``n``) from pairs of form and lemma, lower-cased; nulls and empty forms are left out.

    Each pair votes for its change at every ending of its form that holds what is cut. An ending takes the change with most votes (ties: the
    shortest cut, then by order) if it has ``least`` or is a whole word; endings that say what the next shorter one says are left out.
    """
    p = pairs.select(F.lower(form).alias("f"), F.lower(lemma).alias("l")).filter("f IS NOT NULL AND l IS NOT NULL AND f <> ''").distinct()
    common = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.least(F.length("f"), F.length("l")), F.lit(1))), lambda i: (F.left(F.col("f"), i) == F.left(F.col("l"), i)) & (i <= F.length("l"))))
    changed = p.withColumn("_p", common).select("f", F.expr("substring(f, _p + 1)").alias("cut"), F.expr("substring(l, _p + 1)").alias("put"))
    votes = changed.select("cut", "put", F.explode(_endings(F.col("f"), F.greatest(F.length("cut"), F.lit(1)))).alias("e")).groupBy("e.suffix", "cut", "put").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("suffix").agg(F.min(F.struct((-F.col("n")).alias("m"), F.length("cut").alias("s"), "cut", "put")).alias("b"))
    rules = best.select("suffix", "b.cut", "b.put", (-F.col("b.m")).alias("n")).filter((F.col("n") >= least) | F.col("suffix").startswith(BEGIN))
    shorter = rules.select(F.col("suffix").alias("_s"), F.struct("cut", "put").alias("_c"))
    kept = rules.join(shorter, F.expr("substring(suffix, 2)") == F.col("_s"), "left")
    return kept.filter(~F.struct("cut", "put").eqNullSafe(F.col("_c"))).select("suffix", "cut", "put", "n")


def lemmas(words: DataFrame, rules: DataFrame, word: str = "word") -> DataFrame:
    """``word`` and ``lemma`` of every distinct word, lower-cased, by the longest ending that has a rule; a word without one is its own lemma."""
    w = words.select(F.lower(word).alias("word")).filter(F.col("word").isNotNull()).distinct()
    hits = w.select("word", F.explode(_endings(F.col("word"), F.lit(1))).alias("e")).join(rules.select("suffix", "cut", "put"), F.col("e.suffix") == F.col("suffix"))
    found = hits.groupBy("word").agg(F.max(F.struct("e.size", "cut", "put")).alias("r"))
    made = F.concat(F.expr("left(word, length(word) - length(r.cut))"), F.col("r.put"))
    return w.join(found, "word", "left").select("word", F.coalesce(F.nullif(made, F.lit("")), F.col("word")).alias("lemma"))
