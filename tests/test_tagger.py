"""The tagger against all tag sequences, on sentences that it has not seen, and the negations that follow from it."""

import itertools

import numpy as np
import pytest

from loomspan.operators import perturb, tagger
from loomspan.operators.lemmas import induce, lemmas


@pytest.fixture(scope="module")
def model(spark):
    return tagger.trained(spark)


def test_viterbi_against_all_sequences():
    rng = np.random.default_rng(1)
    k = len(tagger.TAGS)
    for _ in range(5):
        words = {w: np.log(rng.dirichlet(np.ones(k))) for w in "abc"}
        t = tagger.Tagger(np.log(rng.dirichlet(np.ones(k))), np.log(rng.dirichlet(np.ones(k), k)), words, {"": np.log(rng.dirichlet(np.ones(k)))}, np.log(rng.dirichlet(np.ones(k))))
        sentence = list(rng.choice(list("abcd"), 4))
        emitted = np.array([t.emission(w) for w in sentence])
        best = max(itertools.product(range(k), repeat=4), key=lambda s: t.first[s[0]] + sum(emitted[i, x] for i, x in enumerate(s)) + sum(t.after[a, b] for a, b in itertools.pairwise(s)))
        assert t.tags(sentence) == [tagger.TAGS[i] for i in best]
    assert t.tags([]) == []


def test_unseen_sentences(spark, model):
    held = tagger.training_sentences(400, 99)
    right = [(a, b) for words, tags in held for a, b in zip(model.tags(words), tags, strict=True)]
    finite = [(a, b) for a, b in right if b in ("FIN", "AUX")]
    print(np.mean([a == b for a, b in right]), np.mean([a == b for a, b in finite]))
    assert np.mean([a == b for a, b in right]) > 0.93 and np.mean([a == b for a, b in finite]) > 0.9
    df = spark.createDataFrame([(i, w) for i, (w, _) in enumerate(held[:50])] + [(99, []), (100, None)], "i int, words array<string>")
    got = {r["i"]: r["tags"] for r in tagger.tag(df, "words", model).collect()}
    assert got[99] == [] and got[100] is None and all(got[i] == model.tags(held[i][0]) for i in range(50))


def test_counts_decide(spark):
    """A model of three sentences by hand."""
    df = spark.createDataFrame([(["the", "Dog", "walked"], ["DET", "NOUN", "FIN"]), (["the", "cat", "talked"], ["DET", "NOUN", "FIN"]), (["x"], ["nonsense"])], "words array<string>, tags array<string>")
    m = tagger.fit(df, smooth=0.01)
    assert m.tags(["the", "dog", "balked"]) == ["DET", "NOUN", "FIN"] and m.tags(["x"]) == ["OTHER"]
    assert np.exp(m.first).sum() == pytest.approx(1) and np.exp(m.after).sum(axis=1) == pytest.approx(np.ones(len(tagger.TAGS)))
    assert m.first.argmax() == tagger.TAGS.index("DET")


def test_negation_goes_to_the_finite_verb(spark, model):
    rules = induce(spark.createDataFrame(tagger.verb_pairs(), "form string, lemma string"))
    cases = {
        "The teacher opened the window.": {"The teacher did not open the window."},
        "She walks to the market.": {"She does not walk to the market."},
        "They can answer the letter.": {"They can not answer the letter."},
        "The old house was painted.": {"The old house was not painted."},
        "He has not visited the city.": {"He has visited the city."},
        "The river is long, and the children play.": {"The river is not long, and the children play.", "The river is long, and the children do not play."},
        "The garden": set(),
    }
    df = spark.createDataFrame([("en", t) for t in cases] + [("de", "Er kommt."), ("en", None), (None, "He walked.")], "lang string, text string")
    got = {r["text"]: set(r["negated"]) for r in tagger.negated(df, model, rules).collect()}
    assert got == {t: w for t, w in cases.items() if w}


def test_the_backend(spark, model):
    rules = induce(spark.createDataFrame(tagger.verb_pairs(), "form string, lemma string"))
    assert lemmas(spark.createDataFrame([("went",), ("carried",)], "word string"), rules).count() == 2
    assert perturb.backend("tagged")[1] is tagger.tagged_variants and perturb.backend("auto")[0] == "tables"
    df = spark.createDataFrame([(1, "en", "The teacher opened the narrow road."), (2, "de", "Er kommt."), (3, None, "x"), (4, "en", None), (1, "en", "The teacher opened the narrow road.")], "i int, lang string, text string")
    got = tagger.tagged_variants(df, ["i"], 4, 7, tagger=model, rules=rules).collect()
    assert sorted(r["text"] for r in got if r["i"] == 1 and r["category"] == "causality") == sorted(2 * ["The teacher did not open the narrow road.", "The teacher opened the wide road."])
    assert [r["text"] for r in got if r["i"] == 2 and r["category"] == "causality"] == ["Er kommt nicht."]
    assert {r["i"] for r in got} <= {1, 2}
