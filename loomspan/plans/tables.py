"""The engine's tables built from the driver's, each with the SQL that makes the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.operators.annotations import average_ratings


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sentences(spark, sf_dir):
    """Lines of documents: doc_id, lang, source, row, text."""
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", "lang", "source", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("row", "text"))


SENTENCES = "sent AS (SELECT doc_id, lang, source, (generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1)::INTEGER AS row, unnest(string_split(coalesce(text, ''), chr(10))) AS text FROM documents)"


def segments(spark, sf_dir):
    """Order lines as rated segments, averaged over repeated ones: doc_id, seg_id, mt, score, disc."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("seg_id"), F.concat("l_returnflag", "l_linestatus").alias("mt"), F.col("l_quantity").alias("score"), F.col("l_discount").alias("disc"))
    return average_ratings(rows, ["doc_id", "seg_id"], "score", ["mt", "disc"], ["mt", "disc"])


SEGMENTS = """raw AS (SELECT l_orderkey AS doc_id, l_linenumber AS seg_id, l_returnflag || l_linestatus AS mt, l_quantity AS score, l_discount AS disc FROM lineitem),
seg AS (SELECT doc_id, seg_id, avg(score) AS score, min(mt) AS mt, (min(struct_pack(a := mt, b := disc))).b AS disc FROM raw GROUP BY doc_id, seg_id)"""


def rated(spark, sf_dir):
    """Order lines as gold and predicted scores: lp (return flag), k (line number), grp (supplier bucket), gold, pred, doc_id, n_tok."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("lp"), F.col("l_linenumber").alias("k"), F.col("l_linestatus").alias("file"), F.col("l_quantity").alias("gold"), (F.round(F.col("l_extendedprice") / 1000) + F.lit(0.0)).alias("pred"), F.col("l_orderkey").alias("doc_id"), F.pmod("l_partkey", F.lit(600)).alias("n_tok"), (F.col("l_discount") * 16 - 0.1).alias("unit"))


RATED = "rated AS (SELECT l_returnflag AS lp, l_linenumber AS k, l_linestatus AS file, l_quantity AS gold, round(l_extendedprice / 1000) AS pred, l_orderkey AS doc_id, l_partkey % 600 AS n_tok, l_discount * 16 - 0.1::DOUBLE AS unit FROM lineitem)"


def pool(spark, sf_dir):
    """Vectors as blocks of five: the first is the gold, three are negatives by category, the last is the query."""
    e = read(spark, sf_dir, "embeddings").select(F.expr("vec_id div 5").alias("block_id"), F.pmod("vec_id", F.lit(5)).alias("_o"), F.col("embedding").alias("vector"), F.pmod("label", F.lit(2)).alias("lang"), F.col("vec_id").alias("pool_idx"), F.col("label").alias("position"))
    lang = e.filter("_o = 0").select("block_id", "lang")
    e = e.drop("lang").join(lang, "block_id")
    category = F.when(F.col("_o") == 1, "number").when(F.col("_o") == 2, "entity").when(F.col("_o") == 3, "causality")
    queries = e.filter("_o = 4").select("lang", "block_id", "vector")
    candidates = e.filter("_o < 4").select("lang", "pool_idx", "block_id", F.when(F.col("_o") == 0, "true").otherwise("perturbed").alias("kind"), category.alias("category"), "position", F.lit(0).alias("variant"), "vector")
    return queries, candidates


POOL = """e AS (SELECT vec_id // 5 AS block_id, vec_id % 5 AS o, embedding::DOUBLE[] AS v, vec_id AS pool_idx, label AS position FROM embeddings),
l AS (SELECT vec_id // 5 AS block_id, label % 2 AS lang FROM embeddings WHERE vec_id % 5 = 0),
q AS (SELECT lang, block_id, v FROM e JOIN l USING (block_id) WHERE o = 4),
c AS (SELECT lang, block_id, pool_idx, CASE WHEN o = 0 THEN 'true' ELSE 'perturbed' END AS kind, CASE o WHEN 1 THEN 'number' WHEN 2 THEN 'entity' WHEN 3 THEN 'causality' END AS category, position, v FROM e JOIN l USING (block_id) WHERE o < 4)"""
OWN = POOL + """, own0 AS (SELECT q.lang, q.block_id, pool_idx, kind, category, position, list_cosine_similarity(q.v, c.v) AS sim FROM q JOIN c ON q.block_id = c.block_id AND q.lang = c.lang),
own AS (SELECT a.*, g.sim AS gold FROM own0 a JOIN own0 g ON a.block_id = g.block_id AND g.kind = 'true' WHERE a.kind = 'perturbed'),
won AS (SELECT lang, block_id, count(*) FILTER (WHERE sim < gold) AS w, count(*) AS m, count(*) FILTER (WHERE sim = gold) AS ties FROM own GROUP BY lang, block_id)"""
FULL = POOL + """, sim AS (SELECT q.lang, q.block_id, c.block_id = q.block_id AS mine, pool_idx, kind, category, list_cosine_similarity(q.v, c.v) AS sim FROM q JOIN c ON q.lang = c.lang)"""


def rounded(df, *columns, digits=6):
    """Doubles rounded, and never a negative zero."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def r6(sql: str) -> str:
    return f"round({sql}, 6) + 0.0"
