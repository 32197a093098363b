import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import fm_quality, source_mix, weak_rules

from .brute import SCHEMA, corpus, words


def test_rule_statistics_against_brute_force(spark):
    rows = corpus(5)
    got = {}
    for r in weak_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect():
        got[r["doc"]["doc_id"]] = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
        assert not (r["base_failed"] and r["kept"])
    for i, text, *_ in rows:
        t, ws = text or "", words(text)
        lines = [x for x in t.split("\n") if words(x)]
        c = Counter(zip(ws, ws[1:], ws[2:]))
        rep = {j for k in range(len(ws) - 2) if c[tuple(ws[k : k + 3])] > 1 for j in range(k, k + 3)}
        failed = len(ws) < 50 or 100 * len(rep) > 50 * len(ws)
        assert got[i] == (len(ws), sum(map(len, ws)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(rep), failed)


def test_rules_learn_from_agreement_and_keep_clean_text(spark):
    rng = random.Random(3)
    prose = lambda: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) + rng.choice(["", "", ","]) for _ in range(80)) + "."
    rows = [(i, prose()) for i in range(200)] + [(1000 + i, " ".join(w + "###" for w in prose().split())) for i in range(20)] + [(2000 + i, " ".join(w.upper() + "!!" for w in prose().split())) for i in range(20)]
    got = weak_rules.quality_rules(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    kept = {r["doc"]["doc_id"]: r["kept"] for r in got}
    assert all(kept[i] for i in range(200)) and not any(kept[1000 + i] for i in range(20))
    empty = spark.createDataFrame([], "doc_id int, text string")
    assert weak_rules.quality_rules(empty).count() == 0
    odd = spark.createDataFrame([(1, None, 2, "v"), (1, "", 2, "v")], "doc_id int, text string, n_words int, votes string").withColumn("doc", F.lit(1))
    assert [r["kept"] for r in weak_rules.quality_rules(odd).collect()] == [False, False]


def test_posterior_is_bayes():
    right = np.array([[0.9, 0.6]] * len(weak_rules.RULES))
    votes = np.array([[1] * 2 + [2] * (len(weak_rules.RULES) - 2), [0] * 2 + [2] * (len(weak_rules.RULES) - 2)])
    p = weak_rules.posterior(votes, 0.7, right)
    assert p[0] == pytest.approx(0.7 * 0.81 / (0.7 * 0.81 + 0.3 * 0.16)) and p[1] == pytest.approx(0.7 * 0.01 / (0.7 * 0.01 + 0.3 * 0.36))


def test_the_fit_and_the_verdicts_are_those_of_plain_em(spark):
    """A plain expectation-maximisation, document by document, gives the operator's posterior and verdict."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = weak_rules.quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    votes = [[int(c) for c in r["votes"]] for r in got if not r["base_failed"]]
    m, k = len(votes), len(weak_rules.RULES)
    right = [list(weak_rules.PRIOR_RIGHT) for _ in range(k)]
    share, strength = weak_rules.PRIOR_GOOD, max(4.0, 0.001 * m)

    def belief(v):
        good, bad = share, 1 - share
        for j, x in enumerate(v):
            if x != weak_rules.ABSTAIN:
                good *= right[j][0] if x == weak_rules.GOOD else 1 - right[j][0]
                bad *= right[j][1] if x == weak_rules.BAD else 1 - right[j][1]
        return good / (good + bad)

    for _ in range(200):
        p = [belief(v) for v in votes]
        new = []
        for j in range(k):
            said = [(q, v[j]) for q, v in zip(p, votes) if v[j] != weak_rules.ABSTAIN]
            of_good = (sum(q for q, x in said if x == weak_rules.GOOD) + weak_rules.PRIOR_RIGHT[0] * strength) / (sum(q for q, _ in said) + strength)
            of_bad = (sum(1 - q for q, x in said if x == weak_rules.BAD) + weak_rules.PRIOR_RIGHT[1] * strength) / (sum(1 - q for q, _ in said) + strength)
            new.append([min(max(x, 0.005), 0.998) for x in (of_good, of_bad)])
        share = min(max((sum(p) + weak_rules.PRIOR_GOOD * strength) / (m + strength), 0.05), 0.98)
        moved = max(abs(a - b) for x, y in zip(new, right) for a, b in zip(x, y))
        right = new
        if moved < 1e-10:
            break
    for r in got:
        want = belief([int(c) for c in r["votes"]])
        assert r["quality"] == pytest.approx(want, abs=1e-6)
        assert r["kept"] == (not r["base_failed"] and want >= weak_rules.KEEP_FROM) or abs(want - weak_rules.KEEP_FROM) < 1e-6


def test_pairwise_terms_use_the_sum_of_squares():
    rng = np.random.default_rng(0)
    x, m = rng.normal(size=(4, 12)), fm_quality.Machine(rng.normal(size=12), rng.normal(size=(12, 3)))
    want = [sum(m.linear * r) + sum(m.factors[i] @ m.factors[j] * r[i] * r[j] for i in range(12) for j in range(i + 1, 12)) for r in x]
    assert np.allclose(m.margin(x), want)


def test_classifier_is_right_on_held_out_rows_and_sees_no_others(spark):
    d = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = fm_quality.quality_query(spark, d).collect()
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([a == b for a, b in held]) > 0.95
    docs = spark.read.parquet(f"{d}/documents.parquet")
    table = spark.read.parquet(f"{d}/labels.parquet")
    flipped = table.withColumn("quality", F.when(fm_quality.fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = fm_quality.train(docs, table), fm_quality.train(docs, flipped)
    assert np.array_equal(a.linear, b.linear) and np.array_equal(a.factors, b.factors)


def test_metadata_is_learnt(spark):
    """Texts that say nothing and a column that says all."""
    rows = [(i, "same words here", "good" if i % 2 else "bad", 2.0**i) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, site string, size double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id int, quality int")
    machine = fm_quality.train(docs, labels, metadata=("site",))
    got = fm_quality.score(docs, machine, metadata=("site",)).collect()
    assert all(r["predicted"] == r["doc"]["doc_id"] % 2 for r in got)
    assert docs.select(fm_quality.terms(docs, ("site", "size"))).head()[0] == ["site=bad", "size=1"]
    assert fm_quality.score(docs.withColumn("site", F.lit(None).cast("string")), machine, metadata=("site",)).count() == 100


def test_classifier_edges(spark):
    rows = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "x " * 30000)], "doc_id int, text string").withColumns({c: F.lit(1) for c in ("doc", "score", "features", "predicted")})
    machine = fm_quality.train(rows.select("doc_id", "text"), spark.createDataFrame([], "doc_id int, quality int"))
    got = fm_quality.score(rows, machine).collect()
    assert len(got) == 4 and {r["score"] for r in got} == {0.5}
    assert fm_quality.score(rows.limit(0), machine).count() == 0


def fill(budget, children):
    left, weights, out = budget, sum(w for _, w in children.values()), {}
    for name, (cap, w) in sorted(children.items(), key=lambda kv: (kv[1][0] / kv[1][1] if kv[1][1] else float("inf"), kv[0])):
        if w and left * w >= cap * weights:
            out[name], left, weights = cap, left - cap, weights - w
        else:
            break
    for name, (_, w) in children.items():
        if name not in out:
            out[name] = left * w // weights if weights else 0
    return out


def mix_of(rows, percent, epochs, domain_of=None, weights=None):
    """The mix by plain loops."""
    weights = weights or {}
    leaf, docs = defaultdict(int), defaultdict(list)
    for i, text, lang, source in rows:
        domain = (domain_of or {}).get(source or "", "")
        key = (domain, lang or "", source or "")
        leaf[key] += len(words(text))
        docs[key].append((i, len(words(text))))
    tree = lambda *path: {k: epochs * v for k, v in leaf.items() if k[: len(path)] == path}
    weigh = lambda table, k: table.get(k, 1)
    budget = sum(leaf.values()) * percent // 100
    out = Counter()
    top = fill(budget, {d: (sum(tree(d).values()), weigh(source_mix.DOMAIN_WEIGHTS, d)) for d in {k[0] for k in leaf}})
    for d, bd in top.items():
        for g, bg in fill(bd, {g: (sum(tree(d, g).values()), weigh(source_mix.LANGUAGE_WEIGHTS, g)) for g in {k[1] for k in tree(d)}}).items():
            for s, bs in fill(bg, {s: (epochs * leaf[(d, g, s)], weights.get(s, 1)) for s in {k[2] for k in tree(d, g)}}).items():
                before = 0
                for e in range(epochs):
                    for i, n in sorted(docs[(d, g, s)], key=lambda x: (hashlib.md5(f"17|{e}|{'' if x[0] is None else x[0]}".encode()).hexdigest(), x[1])):
                        if before < bs:
                            out[(i, d, g, s, e, n)] += 1
                        before += n
    return out


@pytest.mark.parametrize(("percent", "epochs"), [(60, 2), (30, 1), (170, 3)])
def test_mix_against_loops(spark, percent, epochs):
    rng = random.Random(percent)
    rows = [(i if i % 11 else None, " ".join("w" * rng.randint(0, 60)), rng.choice(["en", "fr", "xx", None]), rng.choice(["src0", "src1", "src2", "src3", "odd", None])) for i in range(1, 200)] + [(300, None, "en", "src1")]
    df = spark.createDataFrame([*rows, rows[4]], "doc_id int, text string, lang string, source string").withColumns({c: F.lit(1) for c in ("epoch", "domain", "budget", "_key")})
    got = Counter(map(tuple, source_mix.mix_sources(df, percent, epochs).collect()))
    assert got == mix_of([*rows, rows[4]], percent, epochs)
    assert source_mix.mix_sources(df.limit(0)).count() == 0
    listed = {s: d for d, sources in source_mix.CATALOGUE.items() for s in sources}
    weights = {s: w for sources in source_mix.CATALOGUE.values() for s, w in sources.items()}
    got = Counter(map(tuple, source_mix.mix_sources(df, percent, epochs, catalogue=source_mix.default_catalogue(spark)).collect()))
    assert got == mix_of([*rows, rows[4]], percent, epochs, listed, weights)


@pytest.mark.parametrize("weight", [None, -1])
def test_weights_must_be_numbers_of_parts(spark, weight):
    df = spark.createDataFrame([(1, "a b", "en", "x"), (2, "c d", "en", "y")], "doc_id int, text string, lang string, source string")
    catalogue = spark.createDataFrame([("x", "web", weight), ("y", "web", 2)], "source string, domain string, weight int")
    if weight is None:  # a source without a weight has the default one
        assert source_mix.mix_sources(df, 100, 1, catalogue=catalogue).count() == 2
    else:
        with pytest.raises(Exception, match="the weight of x is -1"):
            source_mix.mix_sources(df, 100, 1, catalogue=catalogue).collect()
    with pytest.raises(Exception, match="the weight of en"):
        source_mix.mix_sources(df, 100, 1, language_weights={"en": -3}).collect()


def test_a_catalogue_names_domains_and_weights(spark):
    rng = random.Random(8)
    rows = [(i, " ".join("w" * rng.randint(0, 60)), rng.choice(["en", "fr"]), rng.choice(["a", "b", "c", "d", None])) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string, source string").withColumn("weight", F.lit("x"))
    table = [("a", "web", 3), ("b", "web", 1), ("c", "books", 0), (None, "books", 2)]
    catalogue = spark.createDataFrame([*table, table[0]], "source string, domain string, weight int")
    got = Counter(map(tuple, source_mix.mix_sources(df, 40, 2, catalogue=catalogue, domain_weights={"web": 5, "books": 9}, language_weights={"fr": 0}).collect()))
    names, weights = {s or "": d for s, d, _ in table}, {s or "": w for s, _, w in table}
    old = source_mix.DOMAIN_WEIGHTS, source_mix.LANGUAGE_WEIGHTS
    source_mix.DOMAIN_WEIGHTS, source_mix.LANGUAGE_WEIGHTS = {"web": 5, "books": 9}, {"fr": 0}
    try:
        assert got == mix_of(rows, 40, 2, names, weights)
    finally:
        source_mix.DOMAIN_WEIGHTS, source_mix.LANGUAGE_WEIGHTS = old
    assert {k[2] for k in got} == {"en"} and "c" not in {k[3] for k in got}  # a weight of 0 is no share


def test_slices_do_not_change_the_mix(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = Counter(map(tuple, source_mix.mix_sources(df).collect()))
    monkeypatch.setattr(source_mix, "SLICE_ROWS", 1)
    assert one == Counter(map(tuple, source_mix.mix_sources(df).collect()))


def test_shortages_go_to_siblings_first():
    assert fill(100, {"a": (10, 1), "b": (90, 1), "c": (90, 1)}) == {"a": 10, "b": 45, "c": 45}
    assert duckdb.sql("SELECT 7 // 2").fetchall() == [(3,)]


def test_very_long_texts(spark):
    """A text of half a million words goes through the rules, the classifier and the mix."""
    text = " ".join(f"word{i % 9973}," if i % 9 else f"end{i}.\n" for i in range(500_000))
    df = spark.createDataFrame([(1, text, "en", "src1"), (2, "short", "en", "src1")], "doc_id bigint, text string, lang string, source string")
    judged = {r["doc"]["doc_id"]: r for r in weak_rules.quality_rules(df).collect()}
    assert judged[1]["n_words"] == 500_000 and judged[1]["word_chars"] == len(text) - text.count(" ") - text.count("\n") and judged[2]["base_failed"]
    machine = fm_quality.train(df, spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int"))
    assert fm_quality.score(df, machine).count() == 2
    assert {r["n_tokens"] for r in source_mix.mix_sources(df, 100, 1).collect()} == {1, 500_000}
