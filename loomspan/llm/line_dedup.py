"""Line dedup: lines that recur in many documents lose all their copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SPACES, Scratch, payload, row_key, small, text_or_empty

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line):
    """A line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACES)), _UPPER, _LOWER)


def frequent_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """Hashes (_h1, _h2) of the line keys found in at least ``min_docs`` documents.

    Two aggregations, each combined on the map side: one row per line and document, then documents per line; so
    a line that a third of all documents hold reaches its reducer as one row per map task.
    """
    lines = docs.select(F.col(f"`{id_col}`").alias("_doc"), F.explode(F.split(text_or_empty(f"`{text_col}`"), "\n", -1)).alias("_line"))
    keys = lines.select("_doc", line_key(F.col("_line")).alias("_k")).filter(F.length("_k") >= min_chars)
    pairs = keys.select("_doc", *_hashes(F.col("_k"))).distinct()
    return pairs.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_docs).select("_h1", "_h2")


def _hashes(key) -> list:
    return [F.xxhash64(F.lit(3), key).alias("_h1"), F.xxhash64(F.lit(5), key).alias("_h2")]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1, min_docs: int = 10) -> DataFrame:
    """One row per input row: ``doc`` (all columns but the text), ``kept_text``, ``n_lines``, ``n_dropped``.

    The text is split at every newline; a null or empty text is one empty line. Lines whose key has at least
    ``min_chars`` code points and occurs in at least ``min_docs`` different documents are dropped everywhere. Rows
    with a null id count as one document together. Repeated rows are each returned, with the same result. If every line is dropped the kept text is empty.

    Dropped places are found by joining hashes only; the texts move once, to be rebuilt by position. The frequent
    lines are written as a table of their own: if a count shows that they are few, they are broadcast and no line moves; else
    the join has a row per line on that side and the skew join of adaptive execution can split a hot line.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    text = text_or_empty(f"`{text_col}`")
    base = docs.select(*row_key(F.col(f"`{id_col}`"), text), payload(docs, text_col).alias("doc"), F.split(text, "\n", -1).alias("_lines"))
    placed = docs.select(*row_key(F.col(f"`{id_col}`"), text), F.posexplode(F.split(text, "\n", -1)).alias("_pos", "_line"))
    placed = placed.select("_key1", "_key2", "_pos", line_key(F.col("_line")).alias("_k")).filter(F.length("_k") >= min_chars)
    placed = placed.select("_key1", "_key2", "_pos", *_hashes(F.col("_k")))
    frequent = scratch.save(frequent_lines(docs, id_col, text_col, min_chars, min_docs), "frequent")
    gone = placed.join(small(frequent, frequent.count()), ["_h1", "_h2"], "left_semi").groupBy("_key1", "_key2").agg(F.collect_set("_pos").alias("_gone"))
    joined = base.join(gone, ["_key1", "_key2"], "left")
    places = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.coalesce("_gone", F.array().cast("array<int>")))
    kept = F.transform(places, lambda i: F.get(F.col("_lines"), i))
    return joined.select("doc", F.array_join(kept, "\n").alias("kept_text"), F.size("_lines").cast("long").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"))


def line_dedup_query(spark, sf_dir: str) -> DataFrame:
    """op4: the digest columns of :func:`dedup_lines` over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs, min_chars=1, min_docs=10)
    return out.select(F.col("doc.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, ord, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS ord FROM documents)
), often AS (
  SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE o.k IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY ord) FILTER (WHERE o.k IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN often o USING (k) GROUP BY doc_id
"""
