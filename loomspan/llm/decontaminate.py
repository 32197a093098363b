"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, small, text_or_empty
from .window_search import HASHES, THRESHOLD, WindowIndex, search

#: Bytes of the index of one pass over the documents: bounds what the driver holds and sends, whatever the number of items.
PASS_BYTES = 128 << 20
_ITEM_BYTES = 8 * HASHES + 200


def split(text: bytes) -> list[bytes]:
    """Words, A-Z lower-cased."""
    return text.lower().split()


class Passes:
    """The distinct texts of a table of items, each under a key of its own, as indexes of bounded size, one at a time.

    Ids, of any type and null too, stay in the table; texts without words are in no index.
    """

    def __init__(self, items: DataFrame, item_id: str | None, text_col: str, threshold: float, pass_bytes: int = PASS_BYTES):
        self.scratch, self.threshold = Scratch(items.sparkSession, "items"), threshold
        ids = [F.col(f"`{item_id}`").alias("_id")] if item_id else []
        rows = items.select(*ids, text_or_empty(f"`{text_col}`").alias("_text")).filter(F.col("_text").rlike(r"[^\x20\x09-\x0D]")).distinct()
        self.table = self.scratch.save(rows.withColumn("_key", F.monotonically_increasing_id()), "items")
        size = self.table.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("_text")), F.lit(0)).alias("b")).head()
        self.items, self.passes = size["n"], -(-(3 * size["b"] // 2 + size["n"] * _ITEM_BYTES) // pass_bytes)

    def __iter__(self):
        for p in range(self.passes):
            part = self.table.filter(F.pmod(F.xxhash64("_key"), F.lit(self.passes)) == p).select("_key", "_text").toArrow()
            texts = dict(zip(part.column("_key").to_pylist(), part.column("_text").to_pylist(), strict=True))
            yield WindowIndex({k: split(t.encode()) for k, t in texts.items()}, self.threshold)


def find_items(docs: DataFrame, items: DataFrame, item_id: str = "item_id", threshold: float = THRESHOLD, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """A row per document row and item of which it holds the share ``threshold`` of distinct 5-word shingles or more.

    Columns: ``doc`` (all columns but the text), ``item_id`` (as it is, null included), ``n_shingles`` of the item,
    ``n_shared``, ``containment``. An item is a distinct pair of id and text: an id given with two texts is two items, each
    with rows of its own, and equal rows of ``items`` are one. Items of fewer than 5 words are one shingle and match documents of
    just these words. Null and empty texts match nothing, on either side; repeated documents match each. Each pass
    takes a block of items against all documents; with several, each is written before the next is built.
    """
    passes, found = Passes(items, item_id, "text", threshold, pass_bytes), []
    for index in passes:
        hits = search(docs, index, split).select("doc", F.explode("matches").alias("m"))
        found.append(hits if passes.passes == 1 else passes.scratch.save(hits, "hits"))
    if not found:
        found = [search(docs, WindowIndex({}), split).select("doc", F.explode("matches").alias("m"))]
    ids = passes.table.select(F.col("_key"), F.col("_id").alias("item_id"))
    rows = reduce(DataFrame.unionByName, found).join(small(ids, passes.items), F.col("m.id") == F.col("_key"))
    return rows.select("doc", "item_id", F.col("m.n_shingles").alias("n_shingles"), F.col("m.n_shared").alias("n_shared"), (F.col("m.n_shared") / F.col("m.n_shingles")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns as they were, that hold no text of ``items`` at the threshold.

    Each distinct text is an item, whatever its id and whether it has one; null and empty ones are none, so an empty
    table of items drops nothing. Documents with a null or empty text stay, repeated ones stay or go together.
    """
    columns = docs.columns
    passes = Passes(items, None, "text", threshold, pass_bytes)
    for index in passes:
        clean = search(docs, index, split, keep_text=True).filter(F.size("matches") == 0)
        docs = clean.select(*[F.col("text") if c == "text" else F.col("doc").getField(c).alias(c) for c in columns])
        if passes.passes > 1:
            docs = passes.scratch.save(docs, "clean")
    return docs


def decontaminate_query(spark, sf_dir: str) -> DataFrame:
    """op10: all items of ``benchmark`` against all ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("doc.doc_id").alias("doc_id"), "item_id", "n_shingles", "n_shared", "containment")


def shingle_sql(table: str, key: str, words: str) -> str:
    """Distinct 5-word shingles of each row of a table, as SQL; ``words`` is SQL for the list of words."""
    return f"""(SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM (SELECT {key}, {words} AS w FROM {table}))"""


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
SQL = f"""
WITH b AS (SELECT row_number() OVER () AS k, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)), d AS {shingle_sql("documents", "doc_id", _WORDS)}, i AS {shingle_sql("b", "k", _WORDS)}, n AS (SELECT k, count(*) AS n_shingles FROM i GROUP BY k)
SELECT doc_id, item_id, n_shingles, count(*) AS n_shared, count(*) / n_shingles::DOUBLE AS containment
FROM d JOIN i USING (s) JOIN n USING (k) JOIN b USING (k) GROUP BY doc_id, k, item_id, n_shingles HAVING count(*) >= {THRESHOLD} * n_shingles - 1e-9
"""
