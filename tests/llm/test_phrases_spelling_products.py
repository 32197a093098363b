"""Phrase mining, spelling variants and exact search against plain versions."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import phrase_mining, product_search, spelling_variants

from .brute import SCHEMA, corpus, lower

# Phrases


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower(text))]


def phrases_of(rows, width):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        for ws in pieces(text):
            n[lang] += len(ws)
            for m in range(1, width + 1):
                for a in range(len(ws) - m + 1):
                    f[lang, tuple(ws[a : a + m])] += 1
    return f, n


def collocations_of(rows, width, least, top, absorb):
    f, n = phrases_of(rows, width)
    found = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    absorbed = set()
    for (lang, p), a in found.items():
        for m in range(2, len(p)):
            for at in range(len(p) - m + 1):
                if 100 * a >= absorb * f[lang, p[at : at + m]]:
                    absorbed.add((lang, p[at : at + m]))
    out = defaultdict(list)
    for (lang, p), a in found.items():
        if (lang, p) not in absorbed:
            s, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out[lang].append((-s, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i, p.decode(), -a, x, y, n[lang], -s) for lang, rows_ in out.items() for i, (s, a, p, x, y) in enumerate(sorted(rows_)[:top], 1)}


def phrase_rows(seed, n=80):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "b", "of", "é", "É", "the", "😀", "x-y", "w"] + [f"r{i}" for i in range(30)]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    texts = []
    for _ in range(n):
        ws = rng.choices(vocabulary, weights, k=rng.choice([0, 1, 2, 7, 40]))
        texts.append("".join(w + rng.choice([" ", " ", " ", "\t", ", ", ".", "\n", "  ", "\x0b", "!? "]) for w in ws))
    texts += ["a a a a a a a a a", "b of b of b of b of", None, "", " \t", ".,;", "x", "the the. the the"] + ["one hot passage of the text"] * 40
    return [(t, rng.choice(["en", "en", "fr", None, "und"])) for t in texts]


@pytest.mark.parametrize(("common", "split", "bucket", "absorb"), [(10**6, 10**5, 10**5, 100), (10**6, 7, 50, 100), (5, 7, 50, 60), (0, 10**5, 300, 100)])
@pytest.mark.parametrize("held", [1, 10**5])
def test_collocations_against_brute_force(spark, monkeypatch, common, split, bucket, absorb, held):
    monkeypatch.setattr(phrase_mining, "COMMON_WORDS", common)
    monkeypatch.setattr(phrase_mining, "PIVOT_OCCURRENCES", split)
    monkeypatch.setattr(phrase_mining, "BUCKET_OCCURRENCES", bucket)
    monkeypatch.setattr(phrase_mining, "RANKED_TOGETHER", 20)
    rows = phrase_rows(3)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    least = 3 if held == 1 else 6
    got = {tuple(r) for r in phrase_mining.collocations(docs, max_words=5, min_count=least, top=30, absorb_percent=absorb).collect()}
    assert got == collocations_of(rows, 5, least, 30, absorb)


def test_all_phrases_of_hostile_documents(spark):
    rows = [(r[1], r[2]) for r in corpus()]
    docs = spark.createDataFrame(corpus(), SCHEMA).withColumn("word", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("ids", F.lit(1))
    phrases, totals = phrase_mining.frequent_phrases(docs, max_words=4, min_count=2)
    f, n = phrases_of(rows, 4)
    assert {(r.lang, r.phrase, r["size"], r.a) for r in phrases.collect()} == {(lang, " ".join(p), len(p), a) for (lang, p), a in f.items() if a >= 2}
    assert {(r.lang, r.n) for r in totals.collect() if r.n} == {(k, v) for k, v in n.items() if v}


def test_no_phrases(spark):
    assert phrase_mining.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
    assert phrase_mining.collocations(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")).collect() == []


def test_score_is_exact_beyond_64_bits(spark, monkeypatch):
    a, n, left, right = 9 * 10**12, 7 * 10**15, 9 * 10**12 + 7, 10**13 + 1
    phrases = spark.createDataFrame([("en", "x y", 2, a), ("en", "x", 1, left), ("en", "y", 1, right)], "lang string, phrase string, size int, a long")
    monkeypatch.setattr(phrase_mining, "frequent_phrases", lambda *_: (phrases, spark.createDataFrame([("en", n)], "lang string, n long")))
    assert phrase_mining.collocations(phrases).first().score == 1000 * a * n // (left * right)


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(phrase_mining, "_FACTOR", np.uint64(0))
    rows, times = phrase_mining.grouped(np.array([[1, 2], [3, 4], [1, 2], [2, 1]]), np.array([1, 5, 2, 1]))
    assert {(*r, t) for r, t in zip(rows.tolist(), times.tolist(), strict=True)} == {(1, 2, 3), (3, 4, 5), (2, 1, 1)}


# Spelling


def spelled(rows, min_chars, min_count, ratio=2, one_in=97):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % one_in == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if c >= min_count and len(w) >= min_chars}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    by = {w: [x for x in n if abs(len(x) - len(w)) < 2 and near(w, x)] for w in n}
    form = {}
    for w, others in by.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(by[w]), n[form[w]] if form[w] else None))
    return out


def misspelt(seed, n=200):
    rng = random.Random(seed)
    words = ["banana", "aaaaab", "abab", "Über", "straße", "naïve", "lettering", "ÿÿÿÿÿ", "×÷×÷×", "a" * 300]
    rows = []
    for i in range(n):
        out = []
        for _ in range(rng.randint(0, 12)):
            w = rng.choice(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at, kind = rng.randrange(len(w) + 1), rng.randrange(3)
                w = w[:at] + (rng.choice("abé") if kind else "") + w[at + (kind != 1) :]
            out.append(rng.choice([w, w.upper(), w]) if w else "x")
        rows.append((i if i % 9 else None, " ".join(out) if i % 7 else "Āa" + "-日".join(out)))
    return rows + [(3, None), (4, ""), (5, "😀ß9é_x"), rows[5], rows[5]]


@pytest.mark.parametrize(("seed", "min_chars", "min_count", "letters"), [(1, 5, 3, 500_000), (2, 2, 1, 10)])
def test_spelling_against_brute_force(spark, monkeypatch, seed, min_chars, min_count, letters):
    monkeypatch.setattr(spelling_variants, "HELD_LETTERS", letters)
    monkeypatch.setattr(spelling_variants, "COUNTED_WORDS", 20)
    rows = misspelt(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("word", F.lit(1)).repartition(3)
    got = [tuple(r) for r in spelling_variants.spelling_variants(docs, min_chars=min_chars, min_count=min_count).collect()]
    assert len(got) == len(set(got))
    assert set(got) == spelled(rows, min_chars, min_count)


def test_spelling_query_against_brute_force(spark):
    """The production parameters on the whole smallest table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {tuple(r) for r in spelling_variants.spelling_query(spark, "/root/testdata/sf0.001").collect()}
    assert got == spelled(rows, 5, 3)


def test_long_chain_of_forms(spark):
    """Each word is twice as frequent as the one before, one letter away: roots take several rounds."""
    text = " ".join(("abcdefghij"[:k] + "z" * (10 - k) + " ") * 2**k for k in range(11))
    rows = [(1, text)]
    got = {tuple(r) for r in spelling_variants.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"), min_count=1).collect()}
    assert got == spelled(rows, 5, 1)
    assert {r[2] for r in got if r[3] > 2} == {"abcdefghij"}


def test_very_long_runs(spark):
    long = "acgt" * 30_000
    rows = [(i, t) for i, t in enumerate([long, long, long[:-1], long + "a", long[:500] + "c" + long[501:]])]
    got = {r.word: (r.n, r.n_near) for r in spelling_variants.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"), min_count=1).collect()}
    assert got[long] == (2, 3)
    assert got[long[:-1]] == (1, 1)


def test_no_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling_variants.spelling_variants(empty).collect() == []


# Products


def best_products(rows, k, step):
    kept = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) and math.isfinite(256.0 * x) for x in v):
            kept.append((i, [math.floor(256 * x) for x in v]))
    clip = lambda x: max(-(2**63) + 1, min(2**63 - 1, x))
    out, asked = Counter(), set()
    for i, q in kept:
        if i % step == 0 and (i, tuple(q)) not in asked:
            asked.add((i, tuple(q)))
            scores = sorted((-clip(sum(a * b for a, b in zip(q, c, strict=False))), j) for j, c in kept if j != i)[:k]
            out.update((i, r, j, -s) for r, (s, j) in enumerate(scores, 1))
    return out


def vector_rows(seed, n=400, d=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    v = centres[rng.integers(0, 12, n)] + 0.05 * rng.normal(size=(n, d))
    v *= np.exp(rng.normal(size=(n, 1)))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(n + i, rows[7][1]) for i in range(40)]  # one vector many times, so ties
    rows += [(-5, [0.0] * d), (-10, [0.0] * d), (-15, None), (-20, [1.0, None] + [0.0] * (d - 2)), (-25, [float("nan")] * d), (-30, [float("inf")] * d), (None, [1.0] * d), (-35, [1.0]), (-40, []), rows[3], rows[3], (10, rows[3][1]), rows[10]]
    return rows


@pytest.mark.parametrize(("slice_", "block", "tiles", "switch"), [(10**6, 10**6, (256, 4096), 0.75), (120, 60, (3, 7), 0.0), (120, 10**6, (256, 5), 0.75), (60, 100, (2, 16), 2.0)])
def test_products_against_brute_force(spark, monkeypatch, slice_, block, tiles, switch):
    for name, value in {"SLICE_NUMBERS": slice_, "BLOCK_NUMBERS": block, "QUERY_TILE": tiles[0], "VECTOR_TILE": tiles[1], "COORDINATE_COSINE": switch}.items():
        monkeypatch.setattr(product_search, name, value)
    rows = vector_rows(1)
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("row", F.lit("clash")).withColumn("length", F.lit(None)).repartition(4)
    got = Counter(tuple(r) for r in product_search.top_products(v, v.filter("vec_id % 5 = 0"), 5).collect())
    assert got == best_products(rows, 5, 5)


def test_cells_meet_in_every_partition(spark, monkeypatch):
    """Shuffle partitions stay apart, as they do on large tables: a block and a slice still meet, whichever partition they fall into."""
    for name, value in {"SLICE_NUMBERS": 120, "BLOCK_NUMBERS": 60}.items():
        monkeypatch.setattr(product_search, name, value)
    rows = vector_rows(3)
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = Counter(tuple(r) for r in product_search.top_products(v, v.filter("vec_id % 5 = 0"), 5).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == best_products(rows, 5, 5)


def test_huge_components(spark):
    rows = [(i, [x, -x / 3, 1.0]) for i, x in enumerate([1e30, 1e15, 3e9, 2.0, -1e15, -1e30, 1e306, 5e8])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = Counter(tuple(r) for r in product_search.top_products(v, v, 3).collect())
    assert got == best_products(rows, 3, 1)


def test_both_prunings_leave_out_and_miss_nothing():
    """A cell with a high threshold looks at few vectors and still finds all that reach it."""
    rng = np.random.default_rng(2)
    norms = lambda x: np.linalg.norm(x, axis=1)
    c = rng.normal(size=(3000, 16))
    c = np.floor(1024 * c / norms(c)[:, None])  # one bucket: all of about one length
    q = c[:40] + np.floor(20 * rng.normal(size=(40, 16)))
    q[20:] = np.floor(256 * rng.normal(size=(20, 16)))  # these have no vector near them
    scores = (q @ c.T).astype(np.int64)
    least = np.sort(scores, axis=1)[:, -1]
    looked = []
    real = product_search.products
    product_search.products = lambda a, b, exact: looked.append(len(a) * len(b)) or real(a, b, exact)
    try:
        best = product_search.best_of_cell(q, np.full(40, -1), norms(q), least, c, np.arange(3000), norms(c), 3)
    finally:
        product_search.products = real
    assert sum(looked) < 0.6 * scores.size
    for r in range(40):
        assert best.score[best.query == r].tolist() == [scores[r].max()]


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert product_search.top_products(empty, empty).collect() == []
    some = spark.createDataFrame([(1, [1.0]), (2, None)], "vec_id long, embedding array<float>")
    assert product_search.top_products(some, empty).collect() == []
    assert product_search.top_products(empty, some).collect() == []
    assert product_search.top_products(some, some).collect() == []


@pytest.mark.parametrize("switch", [0.0, 0.75, 2.0])
@pytest.mark.parametrize("tiles", [(256, 4096), (3, 7), (1, 1)])
def test_a_cell_against_all_products(monkeypatch, switch, tiles):
    """Tiles and prunings of every kind, with ties, own rows, zeros and thresholds that are already there."""
    for name, value in {"QUERY_TILE": tiles[0], "VECTOR_TILE": tiles[1], "COORDINATE_COSINE": switch}.items():
        monkeypatch.setattr(product_search, name, value)
    rng = np.random.default_rng(5)
    c = np.floor(40 * rng.normal(size=(120, 4)) * np.exp(rng.normal(size=(120, 1))))
    c[30:60], c[60:63] = c[29], 0  # ties and zeros
    ids = rng.permutation(120)
    q = np.concatenate([c[:12] + 1, c[60:62], np.floor(30 * rng.normal(size=(6, 4)))])
    own = np.concatenate([ids[:12], ids[60:62], np.arange(500, 506)])
    norms = lambda x: np.sqrt((x * x).sum(axis=1))
    scores = (q @ c.T).astype(np.int64)
    for k in (1, 5):
        allowed = [[(-int(s), int(i)) for s, i in zip(row, ids, strict=True) if i != o] for row, o in zip(scores, own, strict=True)]
        best = [sorted(a)[:k] for a in allowed]
        for least in (np.full(len(q), product_search._LEAST), np.array([-b[-1][0] for b in best])):
            found = product_search.best_of_cell(q, own, norms(q), least, c, ids, norms(c), k)
            for r in range(len(q)):
                mine = found.query == r
                assert sorted(zip((-found.score[mine]).tolist(), found.id[mine].tolist(), strict=True)) == best[r]


def test_deletion_keys_are_those_of_the_words_that_are_left():
    """A deletion's key is the key of the word that it leaves, wherever the word stands and in whatever batch."""
    words = ["banana", "a", "aab", "ÿ×é", "banan", "bnana", "x" * 50]
    k1, k2, at, of, fresh = spelling_variants.deletion_keys(words)
    left = [words[o] if a < 0 else words[o][:a] + words[o][a + 1 :] for a, o in zip(at.tolist(), of.tolist(), strict=True)]
    keys = {}
    for w, x, y in zip(left, k1.tolist(), k2.tolist(), strict=True):
        assert keys.setdefault(w, (x, y)) == (x, y)
    assert len(set(keys.values())) == len(keys)
    for w in words:
        one = spelling_variants.deletion_keys([w])
        assert (int(one[0][0]), int(one[1][0])) == keys[w]
        assert sum(one[4][1:]) == len({w[:i] + w[i + 1 :] for i in range(len(w))})  # each distinct deletion is fresh once
