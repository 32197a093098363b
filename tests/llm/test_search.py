import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import decontaminate, license_scan, window_search
from loomspan.llm.shared import WordHashes, hash_words
from loomspan.llm.shared import shingles as hashed

from .brute import corpus, lower, shingles, words


def plain(docs, items):
    """(document, item, shingles, shared) of every document row and distinct item."""
    out = []
    for i, x in set(items):
        own = shingles(words(lower(x)), 5)
        out += [(d, i, len(own), len(own & shingles(words(lower(t)), 5))) for d, t in docs if own and len(own & shingles(words(lower(t)), 5)) >= 0.8 * len(own)]
    return sorted(out, key=str)


def rows(found):
    return sorted(((r["doc"]["doc_id"], r["item_id"], r["n_shingles"], r["n_shared"]) for r in found.collect()), key=str)


def test_items_against_brute_force(spark):
    rng = random.Random(4)
    make = lambda k: [f"v{rng.randrange(3000)}" for _ in range(k)]
    items = [(i, " ".join(make(k))) for i, k in enumerate([1, 3, 5, 6, 7, 9, 14, 30, 60, 200])] + [(90, ""), (91, None), (None, "a b c d e f")]
    docs = []
    for i in range(40):
        body = make(rng.choice([0, 5, 200, 2000]))
        item = items[i % 10][1].split(" ")
        if i % 3:
            item = item[: max(1, int(len(item) * rng.choice([0.7, 0.9, 1.0])))]
            at = rng.randint(0, len(body))
            body[at:at] = item
        docs.append((i, " ".join(body).upper() if i % 2 else "\n".join(body)))
    docs += [(99, None), (98, ""), docs[1], docs[1], (97, "q a b c d e f q")]
    want = plain(docs, items)
    df = spark.createDataFrame(docs, "doc_id int, text string").withColumns({c: F.lit(1) for c in ("doc", "matches", "m", "id", "item_id", "_key")})
    table = spark.createDataFrame(items, "item_id bigint, text string")
    assert rows(decontaminate.find_items(df, table)) == want and len(want) > 5
    assert rows(decontaminate.find_items(df, table, pass_bytes=3000)) == want  # several passes
    dirty = {w[0] for w in want}
    for size in (decontaminate.PASS_BYTES, 3000):
        clean = decontaminate.drop_contaminated(df, table, pass_bytes=size)
        assert clean.columns == df.columns and sorted(r["doc_id"] for r in clean.collect()) == sorted(d for d, _ in docs if d not in dirty)
    assert decontaminate.find_items(df, table.limit(0)).count() == 0 and decontaminate.find_items(df.limit(0), table).count() == 0
    assert decontaminate.drop_contaminated(df, table.limit(0)).count() == len(docs)


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_hostile_ids(spark, kind):
    """Ids that are null, repeated with the same and with other texts, and no numbers."""
    long, short, other = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("z", 40), ("a", 20), ("m", 30)))
    seven = 7 if kind == "bigint" else "seven"
    items = [(seven, long), (seven, short), (seven, short), (None, other), (None, long)]
    table = spark.createDataFrame(items, f"item_id {kind}, text string")
    docs = [(1, f"x y {short} q"), (2, f"x y {other} q"), (3, f"x y {long} q {short}"), (4, "x y q"), (5, f"x y {long} q")]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    assert [r["doc_id"] for r in decontaminate.drop_contaminated(df, table).collect()] == [4]
    got = rows(decontaminate.find_items(df, table))
    assert got == plain(docs, items) and {g[0] for g in got} == {1, 2, 3, 5}


def test_items_of_all_sizes(spark):
    """Items of 1 to 60,000 words, each held to four fifths and a bit more, beside one another."""
    rng = random.Random(9)
    items = [(n, " ".join(f"u{n}_{rng.randrange(10 * n)}" for _ in range(n))) for n in (5, 11, 40, 170, 700, 2000, 2100, 9000, 60_000)]
    docs = [(n, "x " * 50 + " ".join(t.split(" ")[: int(0.84 * n) + 4]) + " y" * 300) for n, t in items]
    df, table = spark.createDataFrame(docs, "doc_id int, text string").repartition(4), spark.createDataFrame(items, "item_id bigint, text string")
    got = rows(decontaminate.find_items(df, table))
    assert got == plain(docs, items) and len(got) == len(items)


def test_scattered_items_are_found():
    """Recall of items torn into ten pieces that lie far apart in long documents, and of long ones beside a longer one."""
    rng = random.Random(2)
    texts = {i: [f"s{i}_{j}".encode() for j in range(rng.choice([60, 100, 250, 2000]))] for i in range(120)}
    texts[999] = [f"big{j}".encode() for j in range(60_000)]
    index = window_search.WindowIndex(texts)
    docs, expected = [], 0
    for i in range(120):
        own, body = texts[i], [b"f%d" % rng.randrange(50_000) for _ in range(9000)]
        step = -(-len(own) // 10)
        for k in range(10):
            body[900 * k : 900 * k] = own[k * step : (k + 1) * step]
        docs.append(body)
        expected += len(shingles(own, 5) & shingles(body, 5)) >= 0.8 * len(shingles(own, 5))
    hashes = [hashed(*hash_words([d], WordHashes()), 5)[0] for d in docs]
    found = sum((0, i) in index.candidates([h]) and bool(index.verified(docs[i], [i])) for i, h in enumerate(hashes))
    assert expected > 50 and found >= 0.99 * expected


def test_bands_find_what_they_should():
    for part in window_search.WindowIndex({1: [f"x{i}".encode() for i in range(60)]}).parts:
        held = np.ceil(0.8 * 56)
        j = held / (3 * part.stride + 56 - held)
        assert (1 - j**part.rows) ** (window_search.HASHES // part.rows) <= window_search.MISS


def test_one_very_long_item_leaves_the_others_their_bound():
    index = window_search.WindowIndex({n: [f"x{n}_{i}".encode() for i in range(n + 4)] for n in (60, 1945, 7000, 20_000, 50_000)})
    assert sorted(n for p in index.parts for n in p.sizes) == [60, 1945, 7000, 20_000, 50_000]
    for part in index.parts:
        least = min(part.sizes)
        held = np.ceil(0.8 * least)
        j = held / (3 * part.stride + least - held)
        assert (1 - j**part.rows) ** (window_search.HASHES // part.rows) <= window_search.MISS
    with pytest.raises(ValueError):
        window_search.WindowIndex({1: [f"x{i}".encode() for i in range(100)]}, 0.2)


def test_licenses(spark):
    texts = ["x y\nReleased under the MIT License. z", "licensed under the apache license version 2 0", "Released under the MIT", None, "", "word " * 20000 + "Licensed under CC BY-NC 4.0."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])], "doc_id int, text string")
    got = sorted((r["doc"]["doc_id"], r["license"], r["first_word"], r["last_word"]) for r in license_scan.scan_licenses(df).collect())
    assert got == [(0, "MIT", 2, 6), (0, "MIT", 2, 6), (1, "Apache-2.0", 0, 7), (5, "CC-BY-NC-4.0", 20000, 20006)]
    assert license_scan.scan_licenses(df.limit(0)).count() == 0


@pytest.mark.parametrize("i", range(len(license_scan.TEMPLATES)))
def test_each_template_finds_itself(i):
    index = window_search.WindowIndex({n: license_scan.split(t.encode()) for n, _, t in license_scan.TEMPLATES})
    number, _, text = license_scan.TEMPLATES[i]
    ws = license_scan.split(("lorem ipsum dolor " * 90 + text + " sit amet" * 50).encode())
    found = index.candidates(hashed(*hash_words([ws], WordHashes()), 5))
    assert (0, number) in found and number in [v[0] for v in index.verified(ws, [number])]


def test_corpus_is_deterministic():
    assert corpus() == corpus()


def test_licenses_beside_clashing_columns(spark):
    text = "x " * 300_000 + "Released under the MIT License."
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string").withColumns({c: F.lit("mine") for c in ("doc", "m", "matches", "license", "template_id", "first_word", "id")})
    got = license_scan.scan_licenses(df).collect()
    assert [(r["doc"]["doc_id"], r["doc"]["license"], r["license"], r["last_word"]) for r in got] == [(1, "mine", "MIT", 300_004)]


def test_whole_licenses_with_small_changes(spark):
    rng = random.Random(3)
    rows = []
    for i, name, text in license_scan.WHOLE_TEXTS:
        ws = text.split(" ")
        for _ in range(len(ws) // 60):
            ws[rng.randrange(len(ws))] = "changed"
        rows.append((i, "word " * 500 + "\nCopyright 2020 Somebody\n" + " ".join(ws) + " tail" * 300))
    got = {(r["doc"]["doc_id"], r["template_id"]) for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert {(i, i) for i, _ in rows} <= got


def test_a_frame_that_many_items_share_retrieves_few_of_them():
    """Twenty thousand questions of one form: only those that are there are retrieved, and all of them are."""
    rng = random.Random(6)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(30_000))
    frame = "which of the following statements about the {} {} is true ? answer : {}"
    items = {i: frame.format(word(), word(), word()).encode().split() for i in range(20_000)}
    index = window_search.WindowIndex(items)
    held = rng.sample(range(20_000), 40)
    texts = [b" ".join(b"x%d" % rng.randrange(99) for _ in range(60)) + b" " + b" ".join(items[i]) + b" and so on" for i in held]
    texts += [frame.format("never", "asked", "before").encode()] * 20
    split = [t.split() for t in texts]
    per_text = hashed(*hash_words(split, WordHashes()), 5)
    began = time.perf_counter()
    found = index.candidates(per_text)
    took = time.perf_counter() - began
    assert took < 0.05 * len(texts), took
    assert {(t, i) for t, i in found} >= {(t, i) for t, i in enumerate(held)} and len(found) < 200
    sets = {i: set(window_search.word_shingles(w)) for i, w in items.items()}
    for t, w in enumerate(split):
        own = set(window_search.word_shingles(w))
        want = [i for i in items if len(sets[i] & own) >= 0.8 * len(sets[i]) - 1e-9]
        assert [m[0] for m in index.verified(w, [i for p, i in found if p == t])] == want


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_the_rarest_shingles_lose_nothing(threshold):
    """Items that overlap, repeat and are cut short, in texts that hold them whole or in part: every contained one passes the filter."""
    rng = random.Random(int(10 * threshold))
    vocabulary = [b"w%d" % i for i in range(60)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 40))] for _ in range(120)]
    items = dict(enumerate(base + [b[: len(b) // 2] for b in base] + base[:20]))
    hashes = [np.unique(hashed(*hash_words([w], WordHashes()), 5)[0]) for w in items.values()]
    split = []
    for _ in range(80):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        split.append([rng.choice(vocabulary) for _ in range(9)] + w + [rng.choice(vocabulary) for _ in range(9)])
    able = window_search.Rarest(hashes, threshold).of(hashed(*hash_words(split, WordHashes()), 5))
    sets = [set(window_search.word_shingles(w)) for w in items.values()]
    contained = 0
    for t, w in enumerate(split):
        own = set(window_search.word_shingles(w))
        for i, s in enumerate(sets):
            if s and len(s & own) >= threshold * len(s) - 1e-9:
                contained += 1
                assert i in able[t].tolist()
    assert contained > 20
