import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import phrase_dedup, shared
from loomspan.llm.line_dedup import dedup_lines
from loomspan.llm.phrase_dedup import remove_repeated_passages

from .brute import SCHEMA, corpus, lower, words


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


def key(line):
    return lower(line.strip(" \t\n\x0b\x0c\r"))


@pytest.mark.parametrize(("least", "few"), [(2, 0), (2, 300_000), (10, 300_000)])
def test_lines_against_brute_force(docs, monkeypatch, least, few):
    monkeypatch.setattr(shared, "BROADCAST_ROWS", few)
    rows = corpus()
    seen = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            seen[key(line)].add(r[0])
    want = Counter()
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if not (key(x) and len(seen[key(x)]) >= least)]
        want[(r[0], "\n".join(kept), len(lines), len(lines) - len(kept))] += 1
    got = Counter((r["doc"]["doc_id"], r["kept_text"], r["n_lines"], r["n_dropped"]) for r in dedup_lines(docs, min_docs=least).collect())
    assert got == want


def test_lines_of_very_long_texts(spark):
    """A text of 200,000 lines and one line of a million words."""
    rows = [(1, "\n".join(f"line {i % 70000}" for i in range(200_000))), (2, "line 5\n" + "word " * 1_000_000), (3, "line 5")]
    got = {r["doc"]["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in dedup_lines(spark.createDataFrame(rows, "doc_id int, text string"), min_docs=3).collect()}
    assert got == {1: (200_000, 3), 2: (2, 1), 3: (1, 1)}


def test_lines_of_null_ids_empty_tables_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (1, "a")], "doc_id int, text string")
    assert {r["n_dropped"] for r in dedup_lines(df, min_docs=2).collect()} == {1}
    assert {r["n_dropped"] for r in dedup_lines(df, min_docs=3).collect()} == {0}  # null ids are one document
    assert dedup_lines(df.limit(0)).count() == 0
    odd = df.withColumns({c: F.lit("x") for c in ("_h1", "_key1", "_pos", "doc", "n_lines", "_line", "_gone")})
    assert dedup_lines(odd, min_docs=2).select("doc._h1", "doc.n_lines").head()[0] == "x"


def plain_passages(rows, window):
    tokens = [words(r[1]) for r in rows]
    count = Counter(tuple(t[i : i + window]) for t in tokens for i in range(len(t) - window + 1))
    want = Counter()
    for r, t in zip(rows, tokens):
        gone = set()
        for i in range(len(t) - window + 1):
            if count[tuple(t[i : i + window])] > 1:
                gone.update(range(i, i + window))
        want[(r[0], " ".join(w for i, w in enumerate(t) if i not in gone), len(t), len(gone))] += 1
    return want


def passages(found):
    return Counter((r["doc"]["doc_id"], r["kept_text"], r["n_words"], r["n_removed"]) for r in found.collect())


@pytest.mark.parametrize("window", [12, 35])
def test_passages_against_brute_force(docs, window):
    got = passages(remove_repeated_passages(docs, window=window))
    assert got == plain_passages(corpus(), window)
    assert sum(x[3] for x in got) > 0


def test_phrases_in_many_contexts(spark):
    """One 20-word phrase in hundreds of contexts, some of which recur: its anchors are dealt anew by window."""
    rng = random.Random(6)
    phrase = [f"p{i}" for i in range(20)]
    rows = []
    for i in range(300):
        rows.append((i, " ".join([f"a{rng.randrange(10**6)}" for _ in range(30)] + phrase + [f"b{rng.randrange(10**6)}" for _ in range(30)])))
    rows += [(400 + i, " ".join(words(rows[i][1])[5 + i : 70])) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    for most in (10, 4000):
        assert passages(remove_repeated_passages(df, shard_pieces=most)) == plain_passages(rows, 35)


def test_only_the_automaton_locates(spark, monkeypatch):
    """Without its occurrences nothing is removed, and passages are compiled from one copy only."""
    p = [f"p{i}".encode() for i in range(40)]
    others = [[b"x", *p], p[:37], [*p[2:], b"y"]]
    made = phrase_dedup.confirmed_passages(others, np.ones(3, np.int64), 35)
    assert sorted(map(len, made)) == [35, 36, 37]
    assert phrase_dedup.locate(others, np.ones(3, np.int64), 35) == [[(1, 40)], [(0, 37)], [(0, 38)]]
    monkeypatch.setattr(phrase_dedup.PassageAutomaton, "occurrences", lambda self, words: [])
    assert phrase_dedup.locate(others, np.ones(3, np.int64), 35) == [[], [], []]


def test_passages_inside_one_text_and_in_long_texts(spark):
    p = " ".join(f"p{i}" for i in range(35))
    df = spark.createDataFrame([(1, f"{p} x {p}"), (2, "a " * 5000), (3, p[:-1])], "doc_id int, text string")
    got = {r["doc"]["doc_id"]: (r["kept_text"], r["n_removed"]) for r in remove_repeated_passages(df).collect()}
    assert got[1] == ("x", 70) and got[2] == ("", 5000) and got[3][1] == 0
    assert remove_repeated_passages(df.limit(0)).count() == 0
    odd = df.withColumns({c: F.lit(1) for c in ("anchor", "lo", "words", "_key1", "ranges", "doc", "seen")})
    assert {r["n_removed"] for r in remove_repeated_passages(odd).collect()} == {70, 5000, 0}


def test_digest_of_an_empty_rest():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
