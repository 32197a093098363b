"""Subword counts, the embedder, tiles of similarities and error files against plain versions."""

import base64
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from loomspan.functions import tokens
from loomspan.operators import embed, prepare, retrieval
from loomspan.plans import texts as plans
from loomspan.sources import readers

VOCABULARY = plans.VOCABULARY.removeprefix("file://")
HOSTILE = ["", None, "hello world", "  two  spaces \n\n", "don't we'll I'VE", "naïve Ünïcödé", "日本語テキスト", "😀👩‍👩‍👧 zwj", "\u0000\u0001", "a" * 300, "1234567 89", "<|endoftext|> is text", "​﻿", "é vs é", "\r\n\t x", "ﷺ ༒"]


def merged(word, ranks):
    """Merges of neighbours, the lowest rank first, as long as there is one."""
    parts = [bytes([b]) for b in word]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], math.inf))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


def subwords(text, ranks):
    return sum(len(merged(w.encode(), ranks)) for w in regex.findall(tokens.PATTERN, text or ""))


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="the vocabulary is not there")
def test_subword_counts_against_plain_merges(spark):
    ranks = tokens.read_ranks(spark, VOCABULARY)
    assert len(ranks) > 50_000 and ranks[b"!"] == 0
    df = spark.createDataFrame(list(enumerate(HOSTILE)), "i int, t string")
    got = {r["i"]: r["n"] for r in df.select("i", tokens.subword_counter(spark, VOCABULARY)(F.col("t")).alias("n")).collect()}
    assert got == {i: subwords(t, ranks) for i, t in enumerate(HOSTILE)}
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {(i, subwords(t, ranks), subwords(g, ranks)) for i, t, g in docs}
    assert {tuple(r) for r in plans.subword_budget(spark, sf).collect()} == {x for x in want if x[1] <= 480 and x[1] + x[2] <= 400}
    lines = Counter((g, subwords(line, ranks) // 20) for _, t, g in docs for line in (t or "").split("\n"))
    assert {(r["lang"], r["bin"]): r["n_rows"] for r in plans.subword_lengths(spark, sf).collect()} == lines


def test_a_small_vocabulary(spark, tmp_path):
    """Ranks decide the order of merges, not the length of what they make."""
    pieces = [*(bytes([b]) for b in range(256)), b"bc", b"ab", b"abc", b"bcd"]
    (tmp_path / "ranks").write_text("".join(f"{base64.b64encode(p).decode()} {i}\n" for i, p in enumerate(pieces)))
    count = tokens.subword_counter(spark, str(tmp_path / "ranks"))
    got = [r["n"] for r in spark.createDataFrame([(0, "abc"), (1, "abcd"), (2, "ab bc"), (3, "cba")], "i int, t string").orderBy("i").select(count(F.col("t")).alias("n")).collect()]
    assert got == [1, 2, 3, 3]  # abc; a bcd; ab " " bc
    rows = spark.createDataFrame([("abc", "x"), ("abcd", "xyz")], "text string, lang string")
    assert [r["n_text"] for r in prepare.token_budget(rows, ["text", "lang"], ("text", "lang"), 2, 3, count).collect()] == [1]


def plain_vectors(texts, given, dims=16, buckets=512, grams=3, ones=8, most=0.5, seed=13):
    """Vectors of ``given`` by loops, with weights from ``texts``."""

    def bag(t):
        out = Counter()
        for w in regex.findall(r"\w+|[^\w\s]", (t or "").lower()):
            marked = f"<{w}>"
            for f in [w] + [marked[i : i + grams] for i in range(len(marked) - grams + 1)]:
                out[zlib.crc32(f.encode()) % buckets] += 1
        return out

    df = Counter(b for t in texts for b in bag(t))
    rng = np.random.default_rng(seed)
    places, signs = rng.integers(0, dims, (buckets, ones)), rng.choice([-1.0, 1.0], (buckets, ones))
    out = []
    for t in given:
        v = np.zeros(dims)
        for b, n in bag(t).items():
            if 0 < df[b] <= most * len(texts):
                for p, s in zip(places[b], signs[b], strict=True):
                    v[p] += s * math.log(1 + n) * math.log(len(texts) / df[b])
        out.append(v / np.linalg.norm(v) if np.linalg.norm(v) else v)
    return np.array(out)


def test_embedder_against_loops(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["red", "Green", "blue", "naïve", "日本", "x-y", "the"]) for _ in range(rng.randint(0, 9))) + " the" for _ in range(60)] + ["", "...", "日 é"]
    given = [*texts, None, "unseen words only", "THE the the"]
    fitted = embed.fit(spark.createDataFrame([(t,) for t in texts], "t string").repartition(5), "t", dims=16, buckets=512)
    df = spark.createDataFrame(list(enumerate(given)), "i int, t string").withColumn("extra", F.array(F.lit(1)))
    got = {r["i"]: r for r in fitted.embed(df, "t").collect()}
    want = plain_vectors(texts, given)
    for i in range(len(given)):
        assert got[i]["vector"] == pytest.approx(want[i].tolist(), abs=1e-12) and got[i]["extra"] == [1] and got[i]["t"] == given[i]
    assert np.abs(want[texts.index("...")]).sum() > 0 and not any(got[len(texts)]["vector"])  # a null text has no feature
    again = embed.fit(spark.createDataFrame([(t,) for t in reversed(texts)], "t string"), "t", dims=16, buckets=512)
    assert again.fingerprint == fitted.fingerprint != embed.fit(df.limit(3), "t", dims=16, buckets=512).fingerprint
    assert embed.fit(df.limit(0), "t", dims=16, buckets=512).embed(df.limit(0), "t").count() == 0


def plain_bests(queries, candidates):
    out = {}
    for lang, block, q in queries:
        for g, idx, own, kind, category, c in candidates:
            if g == lang:
                sim = 0.0
                for x, y in zip(q, c, strict=True):
                    sim += x * y
                k = ("gold" if own == block else "other") if kind == "true" else "own" if own == block else "foreign"
                key = (lang, block, k, None if kind == "true" else category)
                out[key] = max(out.get(key, (-9.0, 0)), (sim, -idx))
    return {k: (s, -i) for k, (s, i) in out.items()}


@pytest.mark.parametrize(("slices", "block", "tile"), [(None, 4000, 256), (3, 7, 256), (1, 4000, 256)])
def test_tiles_against_loops(spark, monkeypatch, slices, block, tile):
    """Ties of equal vectors, between blocks, kinds and slices, go to the lowest index."""
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", block)
    rng = np.random.default_rng(3)
    few = [x / np.linalg.norm(x) for x in rng.normal(size=(9, 7))]
    unit = lambda x: [v / math.sqrt(sum(y * y for y in x)) for v in x]
    vector = lambda: [float(v) for v in few[rng.integers(0, 9)]] if rng.random() < 0.7 else [float(v) for v in rng.normal(size=7)]
    candidates, queries = [], []
    for b in range(60):
        lang = "xy"[b % 2]
        queries.append((lang, b, vector()))
        for k in range(int(rng.integers(0, 4)) + 1):
            kind = "true" if k == 0 else "perturbed"
            candidates.append((lang, 10 * b + k, b, kind, None if k == 0 else ["number", "entity", None][k % 3], vector()))
    queries.append(("z", 999, vector()))  # a group without candidates
    q = spark.createDataFrame([*queries, ("x", 1000, None)], "lang string, block_id long, vector array<double>")
    c = spark.createDataFrame([(*r[:5], 0, 0, r[5]) for r in candidates], "lang string, pool_idx long, block_id long, kind string, category string, position int, variant int, vector array<double>")
    got = {(r["lang"], r["block_id"], r["kind"], r["category"]): (r["sim"], r["pool_idx"]) for r in retrieval.class_bests(q, c, ["lang"], slices).collect()}
    want = plain_bests([(g, b, unit(v)) for g, b, v in queries], [(*r[:5], unit(r[5])) for r in candidates])
    assert set(got) == set(want)
    for k in want:
        assert got[k][0] == pytest.approx(want[k][0], abs=1e-12) and got[k][1] == want[k][1], k


def test_retrieval_from_texts_against_loops(spark):
    sf = "/root/testdata/sf0.001"
    queries, candidates = (df.filter("source IN ('src1', 'src2', 'src3')").collect() for df in plans.text_pools(spark, sf))
    lines = [line for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for line in (r.text or "").split("\n")]
    options = {"dims": 64, "buckets": 1 << 16}
    qv, cv = plain_vectors(lines, [r.text for r in queries], **options), plain_vectors(lines, [r.text for r in candidates], **options)
    wrong = defaultdict(list)
    for r, v in zip(queries, qv, strict=True):
        of = [k for k, c in enumerate(candidates) if (c.lang, c.source) == (r.lang, r.source)]
        best = max(of, key=lambda k: (round(float(v @ cv[k]), 9), -candidates[k].pool_idx))
        wrong[r.lang, r.source].append(candidates[best].kind != "true" or candidates[best].block_id != r.block_id)
    got = {(r["lang"], r["source"]): (r["error"], r["n_blocks"]) for r in plans.retrieval_texts(spark, sf).filter("pool = 'full'").collect()}
    for key, x in wrong.items():
        assert got[key][1] == len(x) and got[key][0] == pytest.approx(np.mean(x), abs=0.02), key
    assert len(wrong) > 2


def test_search_for_a_better_candidate_against_all_bests(spark, monkeypatch):
    """The errors of :func:`pool_errors` from all pairs: ties of equal vectors and of nearly equal ones, blocks without negatives, null groups, many cells."""
    monkeypatch.setattr(retrieval, "SEARCH_BLOCKS", 9)
    monkeypatch.setattr(retrieval, "SEARCH_QUERIES", 14)
    rng = np.random.default_rng(5)
    few = rng.normal(size=(12, 8))
    rows = []
    for b in range(90):
        gold = few[rng.integers(0, 12)] * (1 if b % 3 else 3) + (rng.normal(size=8) * 10.0 ** -int(rng.integers(1, 18)) if b % 2 else 0)
        some = [gold + rng.normal(size=8) * rng.choice([0, 1e-15, 0.01, 0.1, 1.0]) for _ in range(int(rng.integers(0, 4)))]
        rows.append((("x", "y", None)[b % 7 % 3], 1000 - b, (gold + rng.normal(size=8) * rng.choice([1e-4, 0.1, 0.5])).tolist(), [v.tolist() for v in (gold, *some)]))
    blocks = spark.createDataFrame(rows, "lang string, block_id long, q array<double>, c array<array<double>>").repartition(5)

    def vectors(batches):
        for batch in batches:
            each, ids = batch.column("c").to_pylist(), batch.column("block_id").to_numpy()
            idx = [10 * i + k for i, x in zip(ids.tolist(), each, strict=True) for k in range(len(x))]
            yield np.array(batch.column("q").to_pylist()), np.array([v for x in each for v in x]), np.array(idx), np.repeat(np.arange(len(each)), [len(x) for x in each]), batch

    got = {(r["lang"], r["pool"]): (r["error"], r["n_blocks"]) for r in retrieval.searched_errors(blocks, ["lang"], vectors, 8).collect()}
    c = spark.createDataFrame([(g, b, 10 * b + k, "perturbed" if k else "true", "number" if k else None, v) for g, b, _, x in rows for k, v in enumerate(x)], "lang string, block_id long, pool_idx long, kind string, category string, vector array<double>")
    bests = retrieval.class_bests(blocks.select("lang", "block_id", F.col("q").alias("vector")), c, ["lang"])
    want = {(r["lang"], r["pool"]): (r["error"], r["n_blocks"]) for r in retrieval.pool_errors(bests.na.fill("null", ["lang"]), ["lang"]).collect()}
    assert {(g or "null", p): v for (g, p), v in got.items()} == want and len(want) == 12
    assert len({e for e, _ in want.values()}) > 4


def test_golds_stand_for_their_negatives(monkeypatch):
    """Every candidate at least as near as a query asks is found, though few are compared."""
    monkeypatch.setattr(retrieval, "SEARCH_TILE", (16, 7))
    rng = np.random.default_rng(1)
    unit = lambda v: v / np.linalg.norm(v, axis=1)[:, None]
    golds, n = unit(rng.normal(size=(40, 8))), rng.integers(0, 5, 40)
    of = np.repeat(np.arange(40), n + 1)
    first = np.concatenate([[True], of[1:] != of[:-1]])
    c = unit(np.where(first[:, None], golds[of], golds[of] + rng.normal(size=(len(of), 8)) * rng.choice([0.02, 0.08, 0.5], len(of))[:, None])).astype(np.float32)
    q, least = unit(rng.normal(size=(20, 8))).astype(np.float32), rng.uniform(0.3, 0.9, 20)
    parts = retrieval._Slice(np.arange(40), np.arange(len(of)), c, of, 8)
    found = {(int(a), int(b)) for x, y in parts.hits(q, least) for a, b in zip(x, y, strict=True)}
    assert found >= {(int(a), int(b)) for a, b in zip(*np.nonzero(q @ c.T >= least[:, None]), strict=True)} and len(parts.reps) < len(of)


def test_retrieval_from_texts_makes_its_texts_once(spark, monkeypatch):
    """The same errors as from the bests of all pairs, which are not listed."""
    sf = "/root/testdata/sf0.001"
    e = embed.fit(plans.sentences(spark, sf), "text")
    bests = retrieval.class_bests(*(e.embed(t, "text") for t in plans.text_pools(spark, sf)), ["lang", "source"])
    want = {(r["lang"], r["source"], r["pool"]): (pytest.approx(r["error"], abs=1e-6), r["n_blocks"]) for r in retrieval.pool_errors(bests, ["lang", "source"]).collect()}
    made = []
    monkeypatch.setattr(plans, "candidate_pool", lambda *a, f=plans.candidate_pool: made.append(1) or f(*a))
    monkeypatch.setattr(retrieval, "class_bests", None)
    got = {(r["lang"], r["source"], r["pool"]): (r["error"], r["n_blocks"]) for r in plans.retrieval_texts(spark, sf).collect()}
    assert got == want and len(made) == 1


def test_error_files_keep_full_rows(spark, tmp_path):
    """Empty fields stay, short lines and canaries go; the first texts of a segment are those of its first line."""
    lines = ["system\t doc\tseg_id\trater\tsource\ttarget\tcategory\tseverity", "A\td\t1\tr1\tsrc\tmt\tFluency/Punctuation\tMinor", 'A\td\t1\tr1\tlater\t"later\tAccuracy\tmajor', "A\td\t1\tr2\tsrc\tmt\t\t", "A\td\t2\tr1\t\t\tNon-translation!\tMajor", "B\td\t1\tr1\tCANARY x\ty\tAccuracy\tmajor", "B\td\t1\tr1\tshort", ""]
    (tmp_path / "e.tsv").write_text("\n".join(lines) + "\n")
    errors = readers.read_errors(spark, str(tmp_path / "e.tsv"))
    assert errors.count() == 4
    got = {(r["system"], r["doc"], r["seg"]): (r["source"], r["target"], r["score"]) for r in readers.error_segments(errors).collect()}
    assert got == {("A", "d", "1"): ("src", "mt", pytest.approx(-2.55)), ("A", "d", "2"): ("", "", -25.0)}
    (tmp_path / "s.tsv").write_text("docSegId\tseg_id\tsource\ttarget\n\t1\ta\tb\n7\t\tc\t\n")
    assert sorted((r["seg"], r["source"], r["target"]) for r in readers.read_errors(spark, str(tmp_path / "s.tsv")).collect()) == [("", "a", "b"), ("7", "c", "")]


def test_segments_of_errors_are_dealt_by_their_number(spark, monkeypatch):
    """A task's share is bounded: twenty times the rows come in as many more tasks, and segments without a key go."""
    monkeypatch.setattr(readers, "SEGMENT_ROWS", 50)
    rows = [(i, "a" if i % 2 else None, f"d{i // 10}", "0", f"r{i % 3}", f"s{i}", "", "", "minor") for i in range(1000)]
    errors = spark.createDataFrame(rows, "line long, system string, doc string, seg string, rater string, source string, target string, category string, severity string")
    got = readers.error_segments(errors).withColumn("task", F.spark_partition_id()).collect()
    assert len({r["task"] for r in got}) > 10
    assert {(r["doc"], r["source"], round(r["score"], 6)) for r in got} == {(f"d{i}", f"s{10 * i + 1}", round(-5 / 3, 6)) for i in range(100)}
