import importlib.util
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomspan.llm import queries

from .brute import lower, shingles, words

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before and after each stage."""
    base = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, DATA)
        after.write.parquet(str(base / name))
        read = spark.read.parquet(str(base / name))
        out.append((name, docs, read))
        docs = read
    return {n: (a, b) for n, a, b in out}


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard", "decontaminate", "source_mix"]
    assert importlib.util.find_spec("loomspan.llm") and len(queries.QUERIES) == 13


def test_columns_stay(stages):
    for name, (before, after) in stages.items():
        if name != "source_mix":
            assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_keeps_rows_whole(stages):
    before, after = ({r["doc_id"]: r for r in x.collect()} for x in stages["quality_rules"])
    assert 0 < len(after) < len(before) and all(after[i] == before[i] for i in after)


def test_lines(stages):
    before, after = ({r["doc_id"]: r["text"] for r in x.collect()} for x in stages["line_dedup"])
    seen = defaultdict(set)
    for i, t in before.items():
        for x in t.split("\n"):
            seen[lower(x.strip())].add(i)
    assert after == {i: "\n".join(x for x in t.split("\n") if not (lower(x.strip()) and len(seen[lower(x.strip())]) >= 10)) for i, t in before.items()}


def test_near_copies(stages):
    before, after = (sorted((r["doc_id"], r["text"]) for r in x.collect()) for x in stages["ngram_jaccard"])
    sets = [shingles(words(lower(t)), corpus_pipeline.NEAR_WORDS) for _, t in before]
    label = list(range(len(before)))

    def find(i):
        return i if label[i] == i else find(label[i])

    for i in range(len(before)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= corpus_pipeline.NEAR_PERCENT * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                label[b] = a
    assert after == [before[i] for i in range(len(before)) if find(i) == i]


def test_no_benchmark_is_left(stages, spark):
    before, after = ({r["doc_id"]: r["text"] for r in x.collect()} for x in stages["decontaminate"])
    items = [shingles(words(lower(r["text"])), 5) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    leaks = {i for i, t in before.items() if any(len(x & shingles(words(lower(t)), 5)) >= 0.8 * len(x) for x in items)}
    assert set(after) == set(before) - leaks and all(after[i] == before[i] for i in after)


def test_mix_and_run(stages, spark):
    _, mixed = stages["source_mix"]
    assert Counter(map(tuple, mixed.collect())) == Counter(map(tuple, corpus_pipeline.run(spark, DATA).select(mixed.columns).collect()))


def test_stages_take_empty_tables_and_nulls(spark):
    schema = spark.read.parquet(f"{DATA}/documents.parquet").schema
    for rows in ([], [(None, None, None, None, None), (1, "", None, None, 0), (1, "", None, None, 0)]):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, spark.createDataFrame(rows, schema), DATA).collect()


def test_the_queries_sql_agrees(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    for name, sql in queries.SQL.items():
        got = queries.QUERIES[name](spark, DATA)
        want = con.execute(sql).fetchall()
        columns = [d[0] for d in con.description]
        assert Counter(map(tuple, got.select(columns).collect())) == Counter(want), name
