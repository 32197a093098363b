"""A sequence tagger of our own: a hidden Markov model whose emissions know words and, for others, their endings.

It tells finite verbs and auxiliaries from the rest, so that a negation can go where a parser would put it. Counts come from tagged sentences by
aggregations; decoding is Viterbi's, a sentence at a time. A seeded grammar of English makes sentences to train on where nobody brings any.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import perturb
from .lemmas import BEGIN, induce

#: Auxiliaries and modals, finite verbs, other verb forms, nouns, determiners, adjectives, prepositions, adverbs, conjunctions, pronouns, all else.
TAGS = ("AUX", "FIN", "VERB", "NOUN", "DET", "ADJ", "PREP", "ADV", "CONJ", "PRON", "OTHER")
#: Letters of the longest ending that counts, words that are known, and sentences that a model is fitted on, at most.
MOST_LETTERS, KNOWN_WORDS, SAMPLE_SENTENCES = 4, 50_000, 20_000
#: Suffix rules that tasks are given, at most.
MOST_RULES = 100_000


def _shape(word: str) -> str:
    """What stands for a word that has no letters."""
    return "" if word[:1].isalpha() else "#" if word[:1].isdigit() else "."


@dataclass(frozen=True)
class Tagger:
    """Log probabilities: of the first tag, of a tag after another, and of tags given a word or an ending."""

    first: np.ndarray
    after: np.ndarray  # tag before x tag
    words: dict[str, np.ndarray]
    endings: dict[str, np.ndarray]
    prior: np.ndarray

    def emission(self, word: str) -> np.ndarray:
        """log P(tag | word) - log P(tag), up to a constant the log of P(word | tag); of the longest known ending for other words."""
        word = _shape(word) or word.lower()
        if word in self.words:
            return self.words[word] - self.prior
        for n in range(min(len(word), MOST_LETTERS), -1, -1):
            known = self.endings.get(word[len(word) - n :])
            if known is not None:
                return known - self.prior
        return np.zeros(len(TAGS))

    def tags(self, words: list[str]) -> list[str]:
        """The most likely tags of a sentence."""
        if not words:
            return []
        score, back = self.first + self.emission(words[0]), []
        for w in words[1:]:
            paths = score[:, None] + self.after
            back.append(paths.argmax(axis=0))
            score = paths.max(axis=0) + self.emission(w)
        at = int(score.argmax())
        out = [at]
        for b in reversed(back):
            at = int(b[at])
            out.append(at)
        return [TAGS[t] for t in reversed(out)]


def fit(sentences: DataFrame, words: str = "words", tags: str = "tags", smooth: float = 0.1) -> Tagger:
    """From tagged sentences (two arrays of one length), counted by Spark; unknown tags count as OTHER.

    Of more than SAMPLE_SENTENCES a sample by hash is used. The tables that come back are bounded by tags, endings and KNOWN_WORDS. Each
    ending's distribution leans on that of the next shorter one.
    """
    n = sentences.count()
    kept = sentences if n <= SAMPLE_SENTENCES else sentences.filter(F.pmod(F.xxhash64(words), F.lit(n)) < SAMPLE_SENTENCES)
    pairs = kept.select(F.arrays_zip(F.col(words).alias("w"), F.col(tags).alias("t")).alias("z")).filter(F.size("z") > 0)
    seen = pairs.select(F.posexplode("z").alias("at", "x"), "z").select("at", F.lower("x.w").alias("w"), F.col("x.t").alias("t"), F.when(F.col("at") > 0, F.get("z", F.col("at") - 1)["t"]).alias("before"))
    number = {t: i for i, t in enumerate(TAGS)}
    code = lambda t: number.get(t, number["OTHER"])
    k = len(TAGS)
    first, after = np.full(k, smooth), np.full((k, k), smooth)
    for r in seen.groupBy("before", "t").count().collect():
        if r["before"] is None:
            first[code(r["t"])] += r["count"]
        else:
            after[code(r["before"]), code(r["t"])] += r["count"]
    known = {w for (w,) in seen.groupBy("w").count().orderBy(F.desc("count"), "w").limit(KNOWN_WORDS).select("w").collect()}
    by_word: dict[str, np.ndarray] = {}
    for r in seen.groupBy("w", "t").count().join(F.broadcast(seen.groupBy("w").count().orderBy(F.desc("count"), "w").limit(KNOWN_WORDS).select("w")), "w").collect():
        by_word.setdefault(_shape(r["w"]) or r["w"], np.zeros(k))[code(r["t"])] += r["count"]
    letters = F.filter(F.transform(F.sequence(F.lit(0), F.lit(MOST_LETTERS)), lambda i: F.when(i <= F.length("w"), F.right(F.col("w"), i))), lambda e: e.isNotNull())
    by_end: dict[str, np.ndarray] = {}
    open_words = seen.filter(F.col("w").rlike(r"^\p{L}")).select("w", "t").distinct()  # types, so that frequent words do not decide for unknown ones
    for r in open_words.select(F.explode(letters).alias("e"), "t").groupBy("e", "t").count().collect():
        by_end.setdefault(r["e"], np.zeros(k))[code(r["t"])] += r["count"]
    total = sum(by_word.values(), np.full(k, smooth))
    prior = np.log(total / total.sum())
    endings: dict[str, np.ndarray] = {}
    for e in sorted(by_end, key=len):
        above = np.exp(endings[e[1:]]) if e else np.full(k, 1 / k)
        endings[e] = np.log((by_end[e] + above) / (by_end[e].sum() + 1))
    ends = lambda w: endings.get(w[max(0, len(w) - MOST_LETTERS) :], np.log(np.full(k, 1 / k)))
    words_ = {w: np.log((c + smooth * np.exp(ends(w))) / (c.sum() + smooth)) for w, c in by_word.items() if w in known or not w[:1].isalpha()}
    return Tagger(np.log(first / first.sum()), np.log(after / after.sum(axis=1, keepdims=True)), words_, endings, prior)


def tag(rows: DataFrame, words: str, tagger: Tagger, out: str = "tags") -> DataFrame:
    """Rows with the tags of an array of words; of a null one none."""
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if w is None else tagger.tags(w) for w in batch.column(words).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], names=schema.names)

    return rows.mapInArrow(run, schema)


# --- sentences to train on -------------------------------------------------------------------------------------

_CLOSED = {
    "DET": "the a an this that these those every some any no each its their his her our my your".split(),
    "PREP": "in on at under over from to with by for of near after before during without".split(),
    "CONJ": "and but or because while if although".split(),
    "PRON": "he she it they we you i".split(),
    "ADV": "often never rarely now then here soon always again quietly".split(),
}
_STEMS = "walk open visit talk play learn paint clean rain lift repeat order watch help start look form mark answer travel gather".split()
_NOUNS = "river house road teacher market song winter engine letter garden doctor window child city paper bridge train field story friend".split()
_BE = {"now": {"one": "is", "many": "are", "i": "am"}, "then": {"one": "was", "many": "were", "i": "was"}}
_MODALS = "can could may might must shall should will would".split()


def past(v: str) -> str:
    """A regular verb's past form."""
    return v + "d" if v.endswith("e") else v[:-1] + "ied" if v.endswith("y") and v[-2] not in "aeou" else v + "ed"


def third(v: str) -> str:
    """A verb's third person."""
    return v[:-1] + "ies" if v.endswith("y") and v[-2] not in "aeou" else v + ("es" if v.endswith(("sh", "ch", "s", "x")) else "s")


_HEADS, _TAILS = "ba cor de fun gra lim pro sta tre vo".split(), "lish vert nate rize fy mend sider tain pose duct".split()


def verb_pairs() -> list[tuple[str, str]]:
    """(form, lemma) of the verbs of :func:`training_sentences`, and of the commonest irregular ones."""
    verbs = [*_STEMS, *(a + b for a in _HEADS for b in _TAILS), "want"]
    odd = "went go, came come, saw see, took take, made make, gave give, found find, got get, said say, knew know, thought think, told tell, left leave, kept keep, held hold, wrote write, ran run, began begin, brought bring, bought buy, met meet, led lead, lost lose, won win, built build, sent send, spoke speak, stood stand, fell fall, grew grow, became become, goes go, does do"
    return [x for v in verbs for x in ((third(v), v), (past(v), v), (v, v))] + [tuple(x.split(" ")) for x in odd.split(", ")]


def training_sentences(n: int, seed: int) -> list[tuple[list[str], list[str]]]:
    """Words and tags of seeded English sentences: noun phrases, then a verb group of every kind, then more phrases."""
    rng, out = random.Random(seed), []
    pick = rng.choice

    def stem() -> str:
        return pick(_STEMS) if rng.random() < 0.5 else pick(_HEADS) + pick(_TAILS)

    def noun() -> str:
        return pick(_NOUNS) if rng.random() < 0.5 else pick(["pro", "con", "re", "in", "ex", "sta", "mo", "pa"]) + pick(["tion", "ment", "ness", "ity", "er", "ance", "ship", "ism"])

    def adjective() -> str:
        return pick("old new small red quiet long early great".split()) if rng.random() < 0.4 else pick(["glo", "fam", "nat", "cri", "act", "use"]) + pick(["ous", "al", "ive", "ful", "less", "able", "ic"])

    def phrase(subject: bool) -> tuple[list[tuple[str, str]], str]:
        roll = rng.random()
        if subject and roll < 0.3:
            p = pick(_CLOSED["PRON"])
            return [(p, "PRON")], "i" if p == "i" else "one" if p in ("he", "she", "it") else "many"
        if roll < 0.42:
            return [(pick(["Oslo", "Maria", "Tamsin", "Quill", "Norwood", "Lena"]), "NOUN")], "one"
        many = rng.random() < 0.35
        words = [(pick(["the", "these", "some", "their", "no", "our"] if many else _CLOSED["DET"]), "DET")] if rng.random() < 0.85 or not many else []
        words += [(adjective(), "ADJ")] if rng.random() < 0.35 else []
        words += [(str(rng.randint(2, 900)), "OTHER")] if many and rng.random() < 0.2 else []
        words.append((noun() + ("s" if many else ""), "NOUN"))
        if rng.random() < 0.2:
            words += [(pick(_CLOSED["PREP"]), "PREP"), (pick(["the", "a", "its"]), "DET"), (noun(), "NOUN")]
        return words, "many" if many else "one"

    def group(number: str) -> list[tuple[str, str]]:
        v, roll = stem(), rng.random()
        ing, adverb = (v[:-1] if v.endswith("e") else v) + "ing", [(pick(_CLOSED["ADV"]), "ADV")] if rng.random() < 0.15 else []
        if roll < 0.3:
            return [*adverb, (third(v) if number == "one" else v, "FIN")]
        if roll < 0.5:
            return [*adverb, (past(v), "FIN")]
        if roll < 0.62:
            return [(pick(_MODALS), "AUX"), *adverb, (v, "VERB")]
        if roll < 0.74:
            return [(_BE[pick(["now", "then"])][number], "AUX"), *adverb, (pick([ing, past(v)]), "VERB")]
        if roll < 0.84:
            return [(pick(["has", "had"]) if number == "one" else pick(["have", "had"]), "AUX"), *adverb, (past(v), "VERB")]
        if roll < 0.9:
            return [(_BE[pick(["now", "then"])][number], "AUX"), *adverb, (adjective(), "ADJ")]
        if roll < 0.94:
            return [(pick(["does"] if number == "one" else ["do"]) if rng.random() < 0.5 else "did", "AUX"), ("not", "ADV"), (v, "VERB")]
        return [(pick(["wants", "wanted"]) if number == "one" else pick(["want", "wanted"]), "FIN"), ("to", "PREP"), (v, "VERB")]

    def clause() -> list[tuple[str, str]]:
        lead = [(pick(_CLOSED["PREP"]), "PREP"), ("the", "DET"), (noun(), "NOUN"), (",", "OTHER")] if rng.random() < 0.15 else []
        subject, number = phrase(True)
        rest = phrase(False)[0] if rng.random() < 0.7 else []
        tail = [(pick(_CLOSED["PREP"]), "PREP"), *phrase(False)[0]] if rng.random() < 0.35 else []
        return [*lead, *subject, *group(number), *rest, *tail]

    for _ in range(n):
        words = clause()
        if rng.random() < 0.25:
            words += [*([(",", "OTHER")] if rng.random() < 0.4 else []), (pick(_CLOSED["CONJ"]), "CONJ"), *clause()]
        words.append((pick([".", ".", "!", "?"]), "OTHER"))
        words[0] = words[0][0][:1].upper() + words[0][0][1:], words[0][1]
        out.append(([w for w, _ in words], [t for _, t in words]))
    return out


def trained(spark, n: int = 4000, seed: int = 5) -> Tagger:
    """A model of English from :func:`training_sentences`."""
    return fit(spark.createDataFrame(training_sentences(n, seed), "words array<string>, tags array<string>"))


# --- negation at the finite verb -------------------------------------------------------------------------------

_SPAN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+|[^\s\w]|_")


def negations(text: str, tagger: Tagger, lemma) -> list[str]:
    """The sentence negated at each of its finite verbs in turn: after an auxiliary, or by "do" and the verb's ``lemma``.

    A negation that stands after an auxiliary is taken away instead.
    """
    spans = list(_SPAN.finditer(text))
    words = [m[0] for m in spans]
    out = []
    for i, (m, t) in enumerate(zip(spans, tagger.tags(words), strict=True)):
        low = m[0].lower()
        if t == "AUX":
            nxt = spans[i + 1] if i + 1 < len(spans) else None
            if nxt is not None and nxt[0].lower() in ("not", "never"):
                out.append(text[: m.end()] + text[nxt.end() :])
            elif not re.search(r"n['’]t$|^cannot$", low):
                out.append(text[: m.end()] + " not" + text[m.end() :])
        elif t == "FIN":
            base = lemma(low)
            do = "did" if low.endswith("ed") else "does" if low != base and low.endswith("s") else "do"
            out.append(text[: m.start()] + do + " not " + base + text[m.end() :])
    return out


def negated(sentences: DataFrame, tagger: Tagger, rules: DataFrame) -> DataFrame:
    """``lang``, ``text`` and ``negated``, an array of :func:`negations`, of every distinct English sentence that has any.

    ``rules`` are suffix rules of English (:func:`lemmas.induce`), a table of endings that goes to every task.
    """
    known = {r["suffix"]: (r["cut"], r["put"]) for r in rules.limit(MOST_RULES).collect()}

    def lemma(word: str) -> str:
        marked = BEGIN + word
        for n in range(len(marked), 0, -1):
            if marked[-n:] in known:
                cut, put = known[marked[-n:]]
                return word[: len(word) - len(cut)] + put or word
        return word

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [negations(t, tagger, lemma) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.string()))], names=["lang", "text", "negated"])

    english = sentences.filter("lang = 'en' AND text IS NOT NULL").select("lang", "text").distinct()
    return english.mapInArrow(run, "lang string, text string, negated array<string>").filter(F.size("negated") > 0)


def tagged_variants(sentences: DataFrame | None = None, carry: list[str] = (), n: int = 2, seed: int = 0, tables: DataFrame | None = None, tagger: Tagger | None = None, rules: DataFrame | None = None) -> DataFrame:
    """As :func:`perturb.sentence_variants`, but English is negated at the finite verbs that the tagger finds and not by word tables.

    Negations and other causal edits take turns; which comes first is drawn from the sentence. It knows English alone, so it is taken
    only by its name: called without arguments it raises an ImportError.
    """
    if sentences is None:
        raise ImportError("this backend is asked for by name")
    spark = sentences.sparkSession
    tagger = trained(spark) if tagger is None else tagger
    rules = induce(spark.createDataFrame(verb_pairs(), "form string, lemma string")) if rules is None else rules
    tables = perturb.lexicon(spark) if tables is None else tables
    tables = tables.filter("NOT (lang = 'en' AND way IN ('particle', 'opener', 'closer', 'auxiliary'))")
    lists = perturb.with_variants(sentences, [*carry, "lang", "text"], n, seed, tables)
    keyed = lists.withColumn("_g", F.coalesce("lang", F.lit("")))
    own = negated(sentences, tagger, rules).select(F.col("lang").alias("_g"), "text", "negated")
    both = keyed.join(own, ["_g", "text"], "left").withColumn("negated", F.coalesce("negated", F.array().cast("array<string>")))
    turns = lambda array, late: F.transform(array, lambda t, i: F.struct((2 * i + late).alias("k"), t.alias("t")))
    late = F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(2)).cast("int")
    mixed = F.transform(F.array_sort(F.concat(turns(F.col("causality"), late), turns(F.col("negated"), 1 - late))), lambda x: x["t"])
    made = both.withColumn("causality", F.slice(F.array_distinct(F.filter(mixed, lambda t: t != F.col("text"))), 1, n))
    each = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("made")) for c in perturb.CATEGORIES])
    return made.select(*carry, F.explode(each).alias("_c")).select(*carry, "_c.category", F.posexplode("_c.made").alias("variant", "text"))


perturb.BACKENDS["tagged"] = tagged_variants
