"""The corpus pipeline: quality rules, line dedup, near-duplicate join, decontamination, and the mix of sources.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All stages but the last return the columns of ``documents``, others that come with them too. An empty
table gives an empty one at every stage, and nulls are allowed in every column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.decontaminate import drop_contaminated
from loomspan.llm.line_dedup import dedup_lines
from loomspan.llm.ngram_join import one_of_each_group
from loomspan.llm.shared import Scratch
from loomspan.llm.source_mix import default_catalogue, mix_sources
from loomspan.llm.weak_rules import quality_rules

#: Near duplicates in the pipeline: words in a shingle, and hundredths of similarity.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def _with_text(rows: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The columns of ``documents`` with another text, and its length where they hold one."""

    def column(c: str):
        if c == "text":
            return F.col(text).alias(c)
        if c == "n_chars":
            return F.length(text).cast("long").alias(c)
        return F.col("doc").getField(c).alias(c)

    return rows.select(*map(column, columns))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules judge good, as they were; null, empty and short texts go, repeated rows go or stay together."""
    good = quality_rules(docs).filter("kept")
    return good.select(*[F.col("text") if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that recur in ten documents or more, each row once; ``n_chars`` follows the text, a null text becomes empty.

    A document that loses all its lines stays, with an empty text; rows without an id count as one document.
    """
    return _with_text(dedup_lines(docs), docs.columns, "kept_text")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id (see :func:`one_of_each_group` for ties and nulls); texts without words stay."""
    return one_of_each_group(docs, width=NEAR_WORDS, percent=NEAR_PERCENT)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, as they were; items without words are none, documents without text stay."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The readings of documents that make up the mix, without their texts: a row for each, ties of the drawn order by number of tokens."""
    return mix_sources(docs, catalogue=default_catalogue(spark))


STAGES = [
    ("quality_rules", keep_good),
    ("line_dedup", drop_lines),
    ("ngram_jaccard", drop_near_copies),
    ("decontaminate", drop_benchmark),
    ("source_mix", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: Expectation-maximisation and the groups of near copies have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None
