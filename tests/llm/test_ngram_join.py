import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspan.llm import ngram_join as nj

from .brute import SCHEMA, corpus, lower, shingles, words


def groups(rows, width, percent):
    sets = [shingles(words(lower(r[1])), width) for r in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j]:
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                label[b] = a
    low = {}
    for i, r in enumerate(rows):
        low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted((r[0], len(sets[i]), low[find(i)] if sets[i] else r[0]) for i, r in enumerate(rows))


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (1, 60)])
def test_groups_against_all_pairs_in_blocks(spark, monkeypatch, width, percent):
    """Every list of more than two nodes is long."""
    monkeypatch.setattr(nj, "LIST_ROWS", 2)
    rows = corpus(4)
    got = nj.jaccard_groups(spark.createDataFrame(rows, SCHEMA), width=width, percent=percent).collect()
    assert sorted((r["id"], r["n_shingles"], r["component_id"]) for r in got) == groups(rows, width, percent)


def test_near_misses_of_one_template(spark, monkeypatch):
    """Texts that are mutually just below the threshold stay apart, and those above link, whichever blocks they are in."""
    monkeypatch.setattr(nj, "LIST_ROWS", 40)
    rng = random.Random(5)
    base, rows = [f"t{i}" for i in range(200)], []
    for i in range(150):
        ws = list(base)
        for _ in range(rng.choice([2, 5, 5, 6])):
            ws[rng.randrange(200)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(ws)))
    got = nj.jaccard_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["id"], r["n_shingles"], r["component_id"]) for r in got) == groups(rows, 3, 90)


def test_one_of_each_group_with_ties_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text, "a"), (1, text, "z"), (1, text, "b"), (2, text, "a"), (None, "other words " * 9, "n"), (None, "", "e"), (3, None, "f")]
    df = spark.createDataFrame(rows, "doc_id int, text string, note string")
    got = sorted((str(r["doc_id"]), r["note"]) for r in nj.one_of_each_group(df).collect())
    assert got == [("1", "b"), ("3", "f"), ("None", "e"), ("None", "n")]


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (1, 60)])
def test_groups_against_all_pairs(spark, width, percent):
    rows = corpus(3)
    got = nj.jaccard_groups(spark.createDataFrame(rows, SCHEMA), width=width, percent=percent).collect()
    assert sorted((r["id"], r["n_shingles"], r["component_id"]) for r in got) == groups(rows, width, percent)


def test_many_near_copies_and_chains(spark):
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(40):  # each a word further from the first: a chain of links
        t = base[:]
        t[:i] = [f"c{j}" for j in range(i)]
        rows.append((100 - i, " ".join(t), "en", "s", 0))
    got = nj.jaccard_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["id"], r["n_shingles"], r["component_id"]) for r in got) == groups(rows, 3, 90)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 120), st.integers(0, 8), st.integers(0, 8), st.sampled_from([60, 80, 90]), st.integers(0, 10**6))
def test_linked_sets_share_a_list(n, more_a, more_b, percent, seed):
    rng = np.random.default_rng(seed)
    pool = np.unique(rng.integers(0, 2**63, n + more_a + more_b, dtype=np.uint64))
    common, rest = pool[: max(len(pool) - more_a - more_b, 1)], pool[max(len(pool) - more_a - more_b, 1) :]
    a, b = np.sort(np.concatenate([common, rest[:more_a]])), np.sort(np.concatenate([common, rest[more_a:]]))
    both = len(np.intersect1d(a, b))
    if 100 * both >= percent * (len(a) + len(b) - both):
        boundary = nj.boundary_by_cost(percent)
        one, two = (dict(zip(*map(np.ndarray.tolist, nj.entries(x, boundary, percent)))) for x in (a, b))
        shared = set(one) & set(two)
        assert shared and any(len(shared) >= max(one[k], two[k]) for k in shared)
        bits = bin(int.from_bytes(nj._sketch(a).tobytes(), "little") ^ int.from_bytes(nj._sketch(b).tobytes(), "little")).count("1")
        assert bits <= len(a) + len(b) - 2 * both


def test_costs_choose_subsets_for_small_sets_only():
    assert 5 <= nj.boundary_by_cost(90) <= 15
    assert nj.shared_least(19, 20) == 19 and nj.subset_sizes(9, 100) == [9]


def test_edges_of_the_input(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert nj.jaccard_groups(empty).count() == 0 and nj.one_of_each_group(empty).columns == ["doc_id", "text", "lang", "source", "n_chars"]
    odd = spark.createDataFrame(corpus(2, 12), SCHEMA).withColumns({c: F.lit(7) for c in ("node", "label", "key", "digest", "group", "low", "p0", "_key1", "id", "a", "b")})
    kept = nj.one_of_each_group(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.filter("text RLIKE '[a-z]'").collect()]
    assert len(ids) == len(set(ids))
    assert kept.filter("text IS NULL OR trim(text) = ''").count() == odd.filter("text IS NULL OR trim(text) = ''").count()


def test_components_of_long_chains(spark, tmp_path):
    from loomspan.llm.shared import Scratch

    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101)], "x bigint, y bigint")
    got = {r["v"]: r["c"] for r in nj.components(edges, Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}


def test_very_long_texts_link(spark):
    rng = random.Random(1)
    long = [f"w{rng.randrange(10**6)}" for _ in range(200_000)]
    near = [w if i % 400 else "changed" for i, w in enumerate(long)]
    far = [w if i % 20 else "changed" for i, w in enumerate(long)]
    rows = [(4, " ".join(long)), (5, " ".join(near)), (6, " ".join(far)), (7, "a b c")]
    got = {r["id"]: r["component_id"] for r in nj.jaccard_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {4: 4, 5: 4, 6: 6, 7: 7}
