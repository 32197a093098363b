"""Queries that go from texts to subword counts and to vectors. Vocabularies and hashed features have no SQL; tests hold them against plain versions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from loomspan.functions.tokens import subword_counter
from loomspan.operators import embed, perturb, prepare, retrieval, tagger  # noqa: F401  (the tagger adds a backend)
from loomspan.sources.scratch import Scratch

from .pools import candidate_pool
from .tables import read, rounded, sentences

QUERIES, SQL = {}, {}

#: The ranks of a public byte-level vocabulary; callers name their own file.
VOCABULARY = "file:///opt/tokenizers/byte_bpe_50k.tiktoken"


def subword_lengths(spark, sf_dir, vocabulary: str = VOCABULARY):
    """Lines of documents by language and number of subword tokens, in bins of 20."""
    t = sentences(spark, sf_dir).select("lang", subword_counter(spark, vocabulary)(F.col("text")).alias("n"))
    return t.groupBy("lang", F.expr("n div 20").alias("bin")).agg(F.count(F.lit(1)).alias("n_rows"))


QUERIES["subword_lengths"] = subword_lengths


def subword_budget(spark, sf_dir, vocabulary: str = VOCABULARY):
    """Documents of at most 480 subword tokens, and of 400 together with their language's name."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return prepare.token_budget(rows, ["text", "lang"], ("text", "lang"), 480, 400, subword_counter(spark, vocabulary)).select("doc_id", "n_text", "n_lang")


QUERIES["subword_budget"] = subword_budget


def text_pools(spark, sf_dir):
    """Queries and candidates as texts: blocks of two lines without every third word, and the whole blocks with their negatives."""
    block = (F.col("doc_id") * 100_000 + F.col("first_row")).alias("block_id")
    made = candidate_pool(spark, sf_dir).join(read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    candidates = made.select("lang", "source", block, ((F.col("doc_id") * 100_000 + F.col("first_row")) * 1000 + F.col("in_block")).alias("pool_idx"), "kind", "category", "position", "variant", "text")
    queries = candidates.filter("kind = 'true'").select("lang", "source", "block_id", F.array_join(F.filter(F.split("text", " "), lambda w, i: i % 3 != 2), " ").alias("text"))
    return queries, candidates


def retrieval_texts(spark, sf_dir):
    """Errors of the four pools by language and source, from texts: an embedder fitted on all lines makes the vectors."""
    scratch, embedder = Scratch(spark, "texts"), embed.fit(sentences(spark, sf_dir), "text")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("in_block", "text"))), lambda x: x["text"])
    blocks = candidate_pool(spark, sf_dir).groupBy("doc_id", "first_row").agg(texts.alias("texts")).join(read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    blocks = scratch.save(blocks.select("lang", "source", (F.col("doc_id") * 100_000 + F.col("first_row")).alias("block_id"), "texts"), "blocks")

    def vectors(batches):
        words = embed.Words(embedder.grams, embedder.buckets)
        for whole in batches:
            for low in range(0, len(whole), 1000):
                batch = whole.slice(low, 1000)
                each, ids = batch.column("texts").to_pylist(), batch.column("block_id").to_numpy()
                n = np.array([len(x) for x in each], np.int64)
                of = np.repeat(np.arange(len(each)), n)
                idx = ids[of] * 1000 + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                made = embedder.vectors([*[" ".join(w for i, w in enumerate(x[0].split(" ")) if i % 3 != 2) for x in each], *[t for x in each for t in x]], words)
                yield made[: len(each)], made[len(each) :], idx, of, batch

    return rounded(retrieval.searched_errors(blocks, ["lang", "source"], vectors, embedder.dims), "error")


QUERIES["retrieval_texts"] = retrieval_texts


def tagged_variants(spark, sf_dir):
    """Variants of all lines by the backend that tags sentences: English negations stand at finite verbs."""
    _, make = perturb.backend("tagged")
    rows = sentences(spark, sf_dir).select("doc_id", "row", "lang", "text")
    return make(rows, ["doc_id", "row"], 2, 3)


QUERIES["tagged_variants"] = tagged_variants
