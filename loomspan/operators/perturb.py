"""Hard negatives by small edits of a sentence: numbers, entities, causality (antonyms, modals, negation).

All possible edits of a sentence are listed and the first of them in the order of an md5 are taken, so a variant depends on
the seed and the sentence alone. A sentence is a row of units (words, runs of digits, or table entries where no spaces
are written) and the gaps between them; an edit puts something in the place of one or two units. Word tables are joined, so
are the corpus's lower-case words and its bank of entities, whatever their size. Equal sentences are worked on once.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.text import UNSPACED, collapse, joiner, match_case

from loomspan.sources.scratch import Scratch

from . import lexicons
from .lemmas import lemmas
from .order import cumulative

CATEGORIES = ("causality", "entity", "number")
#: Rows of word tables up to which they are broadcast.
BROADCAST_ROWS = 100_000
#: Distinct words of word tables up to which units are compared with all of them before they are joined.
LISTED_WORDS = 5_000
#: A word with at least one in FREQUENT_SHARE of a language's words is a common one, if the language has FREQUENT_WORDS or more.
FREQUENT_SHARE, FREQUENT_WORDS = 200, 10_000
_WORDS = r"\p{Nd}+|[a-zA-Z\p{L}\p{M}_]+(?:['’][a-zA-Z\p{L}\p{M}]+)*"
_ENTRIES = r"\p{Nd}+|" + "|".join(sorted({re.escape(w) for lang, w, *_ in lexicons.rows() if lang in UNSPACED}, key=lambda w: (-len(w), w)))
_AT_END = -2


def lexicon(spark, database: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """The word tables (``lang``, ``word``, ``way``, ``put``).

    ``database`` adds antonyms of a lexical database, given as (``lang``, ``word``, ``lemma``, ``sense``, ``antonym``): of
    words that are their own lemma, and of their two first senses (from 0). Without a column ``lemma``, lemmas come from suffix ``rules``
    (:func:`lemmas.induce`), which are those of one language.
    """
    own = spark.createDataFrame(lexicons.rows(), "lang string, word string, way string, put string")
    if database is None:
        return own
    named = database.withColumn("word", F.lower("word"))
    if "lemma" not in database.columns:
        named = named.join(lemmas(named, rules), "word")
    more = named.filter((F.col("word") == F.lower("lemma")) & (F.col("sense") < 2))
    return own.unionByName(more.select("lang", "word", F.lit("antonym").alias("way"), F.col("antonym").alias("put")).distinct())


def units_of(text, lang):
    """(units, gaps) of a sentence; there is one gap more than there are units."""
    unspaced = lang.isin(*UNSPACED)
    units = F.when(unspaced, F.regexp_extract_all(text, F.lit(_ENTRIES), F.lit(0))).otherwise(F.regexp_extract_all(text, F.lit(_WORDS), F.lit(0)))
    return units, F.when(unspaced, F.split(text, _ENTRIES, -1)).otherwise(F.split(text, _WORDS, -1))


def _let(value, use):
    """What ``use`` makes of a value that is computed once, also inside the functions of arrays, which repeat what they name."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _edit(at, put, way, at2=None, put2=None):
    return F.struct(F.lit(at).cast("int").alias("at") if isinstance(at, int) else at.cast("int").alias("at"), put.alias("put"), (F.lit(-1) if at2 is None else at2).cast("int").alias("at2"), (F.lit("") if put2 is None else put2).alias("put2"), (F.lit(way) if isinstance(way, str) else way).alias("way"))


def edited(text, units, gaps, edit):
    """The sentence with one or two units replaced; what a removal leaves of spaces is tidied."""
    valid = F.make_valid_utf8(text)  # what units and gaps are made of
    start = lambda at: F.length(F.array_join(F.slice(gaps, F.lit(1), at + 1), "")) + F.length(F.array_join(F.slice(units, F.lit(1), at), ""))
    upto = lambda at: F.substring(valid, F.lit(1), start(at))
    after = lambda at: F.substring(valid, start(at + 1) - F.length(F.get(gaps, at + 1)) + 1, F.length(valid))
    between = F.substring(after(edit["at"]), F.lit(1), start(edit["at2"]) - start(edit["at"]) - F.length(F.get(units, edit["at"])))
    rest = F.when(edit["at2"] >= 0, F.concat(between, edit["put2"], after(edit["at2"]))).otherwise(after(edit["at"]))
    whole = F.concat(upto(edit["at"]), edit["put"], rest)
    gone = (edit["put"] == "") | (edit["at2"] >= 0)
    last = F.concat(F.regexp_extract(text, r"(?s)^(.*?)([.!?]*\s*)$", 1), F.lit(" "), edit["put"], F.regexp_extract(text, r"(?s)^(.*?)([.!?]*\s*)$", 2))
    return F.when(edit["at"] == _AT_END, last).when(gone, F.regexp_replace(collapse(whole), r" +([.,;:!?»])", "$1")).otherwise(whole)


def _key(seed: int, *parts):
    return F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *parts).cast("binary"))


def number_edits(hits, seed: int, lang, text, n: int):
    """Digit runs as other runs of their width, without a leading zero that was not there; ordinals as other ordinals."""

    def digits(h, d):
        width = F.length(h["unit"])
        drawn = F.translate(_key(seed, lang, F.lit("digits"), text, h["at"].cast("string"), d.cast("string")), "abcdef", "012345")

        def number(long):
            first = F.when((width > 1) & ~h["unit"].startswith("0"), F.translate(F.substring(long, 1, 1), "0", "8")).otherwise(F.substring(long, 1, 1))
            return F.concat(first, F.substring(long, F.lit(2), width))

        return _let(F.substring(F.repeat(drawn, F.ceil(width / 32).cast("int")), F.lit(1), width), number)

    runs = F.transform(F.filter(hits, lambda h: h["way"] == "digits"), lambda h: F.transform(F.array_distinct(F.filter(F.transform(F.sequence(F.lit(0), F.lit(6 * n)), lambda d: digits(h, d)), lambda x: x != h["unit"])), lambda x: _edit(h["at"], x, "number")))
    ordinals = F.transform(F.filter(hits, lambda h: h["way"] == "ordinal"), lambda h: _edit(h["at"], match_case(h["put"], h["unit"]), "number"))
    return F.concat(F.flatten(runs), ordinals)


def negation_edits(hits, lang):
    """The first of these that a sentence allows: a negation in two parts goes, one of one part goes, one is put in.

    It is put after an auxiliary, or before the end of the sentence, where the language has one of these.
    """
    closers = F.filter(hits, lambda h: h["way"] == "closer")
    openers = F.filter(hits, lambda h: h["way"] == "opener")
    pairs = F.transform(openers, lambda o: F.struct(o.alias("o"), F.get(F.filter(closers, lambda c: c["at"] > o["at"]), 0).alias("c")))
    pairs = F.transform(F.filter(pairs, lambda p: p["c"].isNotNull()), lambda p: _edit(p["o"]["at"], p["o"]["put"], "negate", p["c"]["at"], F.lit("")))
    particles = F.transform(F.filter(hits, lambda h: h["way"] == "particle"), lambda h: _edit(h["at"], match_case(h["put"], h["unit"]), "negate"))
    after = F.transform(F.filter(hits, lambda h: h["way"] == "auxiliary"), lambda h: _edit(h["at"], F.concat(h["unit"], F.lit(" "), h["put"]), "negate"))
    end = F.lit(None).cast("string")
    for g, word in lexicons.AT_END.items():
        end = F.when(lang == g, F.lit(word)).otherwise(end)
    at_end = F.filter(F.array(_edit(_AT_END, end, "negate")), lambda e: e["put"].isNotNull())
    return F.when(F.size(pairs) > 0, F.slice(pairs, 1, 1)).when(F.size(particles) > 0, particles).when(F.size(after) > 0, after).otherwise(at_end)


def causality_edits(hits, lang, seed: int, text):
    """Antonyms, modals and negation, each in its own drawn order, taken in turn so that no way crowds out the others."""

    def ordered(edits, way: str, others):
        keyed = F.sort_array(F.transform(edits, lambda e: F.struct(_key(seed, lang, F.lit("causality"), text, F.lit(way), e["at"].cast("string"), e["put"]).alias("k"), e.alias("e"))))
        return F.transform(keyed, lambda x, i: F.struct(i.alias("turn"), F.when(others, _key(seed, lang, text, F.lit(way))).alias("k"), x["e"].alias("e")))

    def of(way: str):
        return F.transform(F.filter(hits, lambda h: h["way"] == way), lambda h: _edit(h["at"], match_case(h["put"], h["unit"]), way))

    def turns(x):
        several = (F.size(x["antonym"]) > 0).cast("int") + (F.size(x["modal"]) > 0).cast("int") + (F.size(x["negate"]) > 0).cast("int") > 1  # one way alone needs no turns
        return F.transform(F.sort_array(F.concat(*[ordered(x[w], w, several) for w in ("antonym", "modal", "negate")])), lambda x: x["e"])

    return _let(F.struct(of("antonym").alias("antonym"), of("modal").alias("modal"), negation_edits(hits, lang).alias("negate")), turns)


def _first(items, make, text, n: int):
    """The first n distinct sentences that differ from the text, made of items in order; none is made after the n-th."""

    def step(out, item):
        added = _let(make(item), lambda t: F.when(t.isNull() | (t == text) | F.array_contains(out, t), out).otherwise(F.concat(out, F.array(t))))
        return F.when(F.size(out) >= n, out).otherwise(added)

    return F.aggregate(items, F.array().cast("array<string>"), step)


def _made(text, units, gaps, edits, n: int):
    """The first n distinct sentences that differ from the text, of edits in order."""
    return _first(F.slice(edits, 1, 3 * n), lambda e: edited(text, units, gaps, e), text, n)


# --- entities --------------------------------------------------------------------------------------------------


def _lead(token):
    return F.regexp_extract(token, r"^\p{P}*", 0)


def _tail(token):
    return F.regexp_extract(token, r"\p{P}*$", 0)


def _core(token):
    """A token without the punctuation at its ends."""
    return F.regexp_replace(token, r"^\p{P}+|\p{P}+$", "")


def vocabulary(sentences: DataFrame) -> DataFrame:
    """(``lang``, ``_t``, ``_m``, ``_core``): the tokens between single spaces, how often each occurs, and what it is without punctuation at its ends."""
    tokens = sentences.select("lang", F.explode(F.split("text", " ")).alias("_t")).groupBy("lang", "_t").agg(F.count(F.lit(1)).alias("_m"))
    return tokens.withColumn("_core", _core(F.col("_t")))


def common_words(sentences: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """(``lang``, ``word``, lower-cased): what the corpus itself shows to be no names.

    These are the words that it has with a small first letter anywhere, and those that make up a large share of a language. ``tokens`` is
    its :func:`vocabulary`, where that is known.
    """
    tokens = vocabulary(sentences) if tokens is None else tokens
    words = tokens.select("lang", F.col("_core").alias("_w"), "_m").filter(F.col("_w") != "")
    counts = words.groupBy("lang", F.lower("_w").alias("word")).agg(F.sum("_m").alias("_n"), F.max(F.col("_w").rlike(r"^\p{Ll}")).alias("_small"))
    totals = words.groupBy("lang").agg(F.sum("_m").alias("_all"))
    frequent = (F.col("_all") >= FREQUENT_WORDS) & (F.col("_n") * FREQUENT_SHARE >= F.col("_all"))
    return counts.join(F.broadcast(totals), "lang").filter(F.col("_small") | frequent).select("lang", "word")


def entity_spans(sentences: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``spans`` (token ``a`` up to, not including, ``b``, and ``surface``) by sentence key: maximal runs of entity tokens.

    An entity token has two characters or more without punctuation, its first letter is a capital, and it is none of the
    corpus's :func:`common_words`. Languages without spaces have none. Which tokens these are is decided once for each distinct one.
    """
    scratch = Scratch(sentences.sparkSession, "entities") if scratch is None else scratch
    capital = r"^[^\p{L}\p{Nd}]*\p{Lu}"
    able = ~F.col("_t").between("a", "zzz") & F.col("_t").rlike(capital)  # the pattern is not asked where a small letter comes first
    known = scratch.save(vocabulary(sentences), "vocabulary")
    names = known.filter(~F.col("lang").isin(*UNSPACED) & able).select("lang", "_t", F.col("_core").alias("core"))
    names = names.filter((F.length("core") >= 2) & F.col("core").rlike(capital)).withColumn("word", F.lower("core"))
    names = scratch.save(names.join(common_words(sentences, known), ["lang", "word"], "left_anti").select("lang", "_t", "core"), "names")
    tokens = sentences.filter(~F.col("lang").isin(*UNSPACED)).select("_k1", "_k2", "lang", F.posexplode(F.split("text", " ")).alias("pos", "_t"))
    named = tokens.filter(able).join(names, ["lang", "_t"])
    per = named.groupBy("_k1", "_k2").agg(F.sort_array(F.collect_list(F.struct("pos", "core"))).alias("_all"))
    runs = F.transform("_all", lambda x, i: F.struct((x["pos"] - i).alias("run"), x["pos"].alias("pos"), x["core"].alias("core")))

    def span(run):
        own = F.filter(runs, lambda x: x["run"] == run)
        return F.struct(F.get(own, 0)["pos"].alias("a"), (F.element_at(own, -1)["pos"] + 1).alias("b"), F.array_join(F.transform(own, lambda x: x["core"]), " ").alias("surface"))

    return per.select("_k1", "_k2", F.transform(F.array_distinct(F.transform(runs, lambda x: x["run"])), span).alias("spans"))


def entity_bank(spans: DataFrame) -> DataFrame:
    """(``lang``, ``width``, ``place``, ``surface``): all entity surfaces by number of tokens, and as width 0 all of a language.

    Places count from 0 in the order of a hash; no task sorts a language.
    """
    each = spans.select("lang", F.explode("spans").alias("s")).select("lang", (F.col("s.b") - F.col("s.a")).alias("width"), F.col("s.surface").alias("surface")).distinct()
    both = each.unionByName(each.withColumn("width", F.lit(0))).distinct().withColumn("_h", F.xxhash64("surface"))
    placed = cumulative(both.groupBy("lang", "width", "_h").agg(F.count(F.lit(1)).alias("n")), ["lang", "width"], "_h")
    inside = F.row_number().over(Window.partitionBy("lang", "width", "_h").orderBy("surface"))  # one, but for equal hashes
    return both.withColumn("_at", inside).join(placed, ["lang", "width", "_h"]).select("lang", "width", (F.col("before") + F.col("_at") - 1).alias("place"), "surface")


def entity_variants(sentences: DataFrame, n: int, seed: int) -> DataFrame:
    """``made``: by sentence key at most n sentences with one run of entity tokens replaced by another entity.

    The other is drawn from those of as many tokens, or from all if there is none; punctuation at the ends of the run stays.
    """
    scratch = Scratch(sentences.sparkSession, "entities")
    spans = scratch.save(sentences.select("_k1", "_k2", "lang", "text").join(entity_spans(sentences, scratch), ["_k1", "_k2"]), "spans")
    bank = scratch.save(entity_bank(spans), "bank")
    counts = bank.groupBy("lang", "width").agg(F.count(F.lit(1)).alias("_size"))
    sizes = counts.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("width", "_size"))).alias("_sizes"))
    draws = F.flatten(F.transform("spans", lambda s: F.transform(F.sequence(F.lit(0), F.lit(6 * n)), lambda d: F.struct(_key(seed, F.col("lang"), F.lit("entity"), F.col("text"), s["a"].cast("string"), d.cast("string")).alias("k"), s["a"].alias("a"), (s["b"] - s["a"]).alias("own")))))
    wanted = spans.join(F.broadcast(sizes), "lang").select("_k1", "_k2", "lang", "_sizes", F.posexplode(F.slice(F.sort_array(draws), 1, 6 * n)).alias("i", "d"))
    width = F.when(F.element_at("_sizes", F.col("d.own")) > 1, F.col("d.own")).otherwise(0)
    wanted = wanted.select("_k1", "_k2", "lang", "i", "d.a", width.alias("width"), F.pmod(F.xxhash64("d.k"), F.element_at("_sizes", width)).alias("place"))
    listed = wanted.join(bank, ["lang", "width", "place"]).groupBy("_k1", "_k2").agg(F.sort_array(F.collect_list(F.struct("i", "a", "surface"))).alias("_all"))
    rows = spans.join(listed, ["_k1", "_k2"]).withColumn("_tokens", F.split("text", " "))
    tokens = F.col("_tokens")

    def put(x):
        def inside(s):
            edges = F.concat(_lead(F.get(tokens, s["a"])), x["surface"], _tail(F.get(tokens, s["b"] - 1)))
            return F.when(x["surface"] != s["surface"], F.array_join(F.concat(F.slice(tokens, F.lit(1), s["a"]), F.array(edges), F.slice(tokens, s["b"] + 1, F.size(tokens))), " "))

        return _let(F.get(F.filter("spans", lambda s: s["a"] == x["a"]), F.lit(0)), inside)

    return rows.select("_k1", "_k2", _first(F.col("_all"), put, F.col("text"), n).alias("entity"))


# --- all categories --------------------------------------------------------------------------------------------


def hits_of(whole: DataFrame, tables: DataFrame) -> DataFrame:
    """``_hits`` by sentence key: the units that a table has, with what each way puts there, and the runs of digits.

    Sentences are split once: a unit meets what the table has for its word and for the opener that it begins with.
    """
    few = tables.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    listed = [r["word"] for r in tables.select("word").distinct().limit(LISTED_WORDS + 1).collect()]
    words = tables.groupBy("lang", "word").agg(F.collect_list(F.struct("way", "put")).alias("_own"))
    openers = tables.filter("way = 'opener'").groupBy("lang", F.col("word").alias("_lead")).agg(F.collect_list("way").alias("_opened"))
    split = whole.select("_k1", "_k2", "lang", F.posexplode(units_of(F.col("text"), F.col("lang"))[0]).alias("at", "unit")).withColumn("word", F.lower("unit"))
    number = ~F.col("unit").between("A", "zzz") & F.col("unit").rlike(r"^\p{Nd}")  # the pattern is not asked where an ASCII letter comes first
    marked = F.col("word").contains("'") | F.col("word").contains("’")
    if len(listed) <= LISTED_WORDS:  # most units go before the joins
        split = split.filter(F.col("word").isin(listed) | marked | number)
    # an opener that leads a word, as n' in n'est, is met as a word that starts with it
    lead = F.when(marked, F.nullif(F.regexp_extract("word", r"^(\p{L}+['’])\p{L}", 1), F.lit("")))
    met = split.withColumn("_lead", lead).join(F.broadcast(words) if few else words, ["lang", "word"], "left").join(F.broadcast(openers) if few else openers, ["lang", "_lead"], "left")

    def made(array, way, put):
        return F.coalesce(F.transform(array, lambda x: F.struct(F.col("at"), F.col("unit"), way(x).alias("way"), put(x).alias("put"))), F.array().cast("array<struct<at:int,unit:string,way:string,put:string>>"))

    own = made(F.col("_own"), lambda x: x["way"], lambda x: x["put"])
    opened = made(F.col("_opened"), lambda x: x, lambda x: F.substring("unit", F.length("_lead") + 1, F.length("unit")))
    digits = made(F.when(number, F.array(F.lit("digits"))), lambda x: x, lambda x: F.lit(""))
    hits = met.filter(F.col("_own").isNotNull() | F.col("_opened").isNotNull() | number).select("_k1", "_k2", F.concat(own, opened, digits).alias("_h"))
    return hits.groupBy("_k1", "_k2").agg(F.sort_array(F.flatten(F.collect_list("_h"))).alias("_hits"))


def distinct_sentences(sentences: DataFrame) -> DataFrame:
    """``_k1``, ``_k2``, ``lang``, ``text`` of each; null languages are "", null and blank texts are left out."""
    whole = sentences.select(F.coalesce("lang", F.lit("")).alias("lang"), "text").filter(F.col("text").rlike(r"\S")).distinct()
    return whole.select(F.xxhash64(F.lit(11), "lang", "text").alias("_k1"), F.xxhash64(F.lit(29), "lang", "text").alias("_k2"), "lang", "text")


def listed_edits(sentences: DataFrame, ways: tuple[str, ...], n: int = 0, seed: int = 0, tables: DataFrame | None = None) -> DataFrame:
    """``lang``, ``text``, ``at``, ``way``, ``made``: every edit of every distinct sentence by word pairs (antonym, modal) or by numbers.

    Numbers are drawn as for ``n`` variants: each run of digits gets the different ones of 6 n + 1 draws.
    """
    whole, lang, text = distinct_sentences(sentences), F.col("lang"), F.col("text")
    tables = lexicon(sentences.sparkSession) if tables is None else tables
    rows = whole.join(hits_of(whole, tables), ["_k1", "_k2"])
    units, gaps = units_of(text, lang)
    pairs = F.transform(F.filter("_hits", lambda h: h["way"].isin("antonym", "modal")), lambda h: _edit(h["at"], match_case(h["put"], h["unit"]), h["way"]))
    listed = F.concat(pairs, number_edits(F.col("_hits"), seed, lang, text, n)) if "number" in ways else pairs
    edits = rows.select("lang", "text", units.alias("_units"), gaps.alias("_gaps"), F.explode(F.filter(listed, lambda e: e["way"].isin(*ways))).alias("_e"))
    return edits.select("lang", "text", "_e.at", "_e.way", edited(text, F.col("_units"), F.col("_gaps"), F.col("_e")).alias("made"))


def variant_lists(sentences: DataFrame, n: int, seed: int, tables: DataFrame | None = None) -> DataFrame:
    """Per distinct sentence (``_k1``, ``_k2``, ``lang``, ``text``) the arrays ``causality``, ``entity`` and ``number`` of at most n variants.

    ``sentences`` has ``lang`` and ``text``; null languages are "" and null or blank texts are left out.
    """
    lang, text = F.col("lang"), F.col("text")
    whole = Scratch(sentences.sparkSession, "variants").save(distinct_sentences(sentences), "sentences")
    listed = hits_of(whole, lexicon(sentences.sparkSession) if tables is None else tables)
    rows = whole.join(listed, ["_k1", "_k2"], "left").join(entity_variants(whole, n, seed), ["_k1", "_k2"], "left")
    units, gaps = units_of(text, lang)
    met = F.col("_hits").isNotNull()
    rows = rows.withColumns({"_units": F.when(met, units), "_gaps": F.when(met, gaps), "_hits": F.coalesce("_hits", F.array().cast("array<struct<at:int,unit:string,way:string,put:string>>"))})
    numbers = F.sort_array(F.transform(number_edits(F.col("_hits"), seed, lang, text, n), lambda e: F.struct(_key(seed, lang, F.lit("number"), text, e["at"].cast("string"), e["put"]).alias("k"), e.alias("e"))))
    numbers = F.transform(numbers, lambda x: x["e"])
    causes = causality_edits(F.col("_hits"), lang, seed, text)
    return rows.select(
        "_k1",
        "_k2",
        "lang",
        "text",
        _made(text, F.col("_units"), F.col("_gaps"), causes, n).alias("causality"),
        F.coalesce("entity", F.array().cast("array<string>")).alias("entity"),
        _made(text, F.col("_units"), F.col("_gaps"), numbers, n).alias("number"),
    )


def with_variants(sentences: DataFrame, carry: list[str], n: int, seed: int, tables: DataFrame | None = None, lang: str = "lang", text: str = "text") -> DataFrame:
    """The carried columns of every sentence with its ``causality``, ``entity`` and ``number`` arrays (empty for blank texts)."""
    given = sentences.select(*carry, F.coalesce(F.col(lang), F.lit("")).alias("_lang"), F.col(text).alias("_text"))
    lists = variant_lists(given.select(F.col("_lang").alias("lang"), F.col("_text").alias("text")), n, seed, tables).drop("lang", "text")
    keyed = given.select(*carry, F.xxhash64(F.lit(11), "_lang", "_text").alias("_k1"), F.xxhash64(F.lit(29), "_lang", "_text").alias("_k2"))
    empty = F.array().cast("array<string>")
    return keyed.join(lists, ["_k1", "_k2"], "left").select(*carry, *[F.coalesce(c, empty).alias(c) for c in CATEGORIES])


def sentence_variants(sentences: DataFrame, carry: list[str], n: int, seed: int, tables: DataFrame | None = None) -> DataFrame:
    """A row for every variant of every sentence: the carried columns, ``category``, ``variant`` (from 0) and its ``text``."""
    lists = with_variants(sentences, carry, n, seed, tables)
    each = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("made")) for c in CATEGORIES])
    return lists.select(*carry, F.explode(each).alias("_c")).select(*carry, "_c.category", F.posexplode("_c.made").alias("variant", "text"))


def distractors(options, size: int):
    """``size`` distractors or fewer of a window, each an array of (``category``, ``text``), one per sentence.

    ``options`` is an array of structs with the variants of each sentence by category. At sentence j distractor d begins
    with category (d + j) mod 3; edits that another distractor has at that sentence are passed over, then the next category
    is tried; when nothing fresh is left an edit is shared. None if some sentence has no variant at all; and of
    distractors that begin with the same text only the first stays.
    """

    def named(o, c: str):
        return F.transform(o[c], lambda t: F.struct(F.lit(c).alias("category"), t.alias("text")))

    def column(o, j):
        a, b, c = (named(o, x) for x in CATEGORIES)

        def chosen(turns):
            def step(out, d):
                def one(order):
                    fresh = F.filter(order, lambda x: ~F.exists(out, lambda t: t["text"] == x["text"]))
                    return F.coalesce(F.get(fresh, 0), F.get(order, 0))

                return F.concat(out, F.array(_let(F.get(turns, F.pmod(d + j, F.lit(3))), one)))

            return F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), F.array().cast("array<struct<category:string,text:string>>"), step)

        turned = _let(F.struct(a.alias("a"), b.alias("b"), c.alias("c")), lambda x: F.array(*[F.concat(*[x[i] for i in t]) for t in ("abc", "bca", "cab")]))
        return _let(turned, chosen)

    def own_starts(whole):
        return F.filter(whole, lambda x, i: ~F.exists(F.slice(whole, F.lit(1), i), lambda y: F.get(y, 0)["text"] == F.get(x, 0)["text"]))

    able = F.forall(options, lambda o: F.size(o["causality"]) + F.size(o["entity"]) + F.size(o["number"]) > 0)
    whole = _let(F.transform(options, column), lambda columns: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda d: F.transform(columns, lambda x: F.get(x, d))))
    whole = _let(whole, own_starts)
    return F.when(able & (F.size(options) > 0), whole).otherwise(F.array().cast("array<array<struct<category:string,text:string>>>"))


def candidate_pool(blocks: DataFrame, variants_: DataFrame, key: tuple[str, ...] = ("block_id",)) -> DataFrame:
    """Candidates of blocks (``key``, ``lang``, ``sentences``): the gold, then every variant of every sentence in place.

    ``variants_`` has the key, position, category, variant and text. ``in_block`` orders a block's candidates: the gold first, then by
    position, category and variant; it is block-major. Sentences are joined as the language writes them.
    """
    each = F.struct("position", "category", "variant", F.col("text").alias("_new"))
    listed = variants_.groupBy(*key).agg(F.array_sort(F.collect_list(each)).alias("_all"))
    gold = F.array(F.struct(F.lit(-1).alias("position"), F.lit(None).cast("string").alias("category"), F.lit(0).alias("variant"), F.lit(None).cast("string").alias("_new")))
    all_ = F.concat(gold, F.coalesce(F.col("_all"), F.array().cast("array<struct<position:int,category:string,variant:int,_new:string>>")))
    rows = blocks.select(*key, "lang", "sentences").join(listed, list(key), "left").select(*key, "lang", "sentences", F.posexplode(all_).alias("in_block", "_v"))
    parts = F.transform("sentences", lambda x, i: F.when(i == F.col("_v.position"), F.col("_v._new")).otherwise(x))
    put = F.when(joiner("lang") == "", F.array_join(parts, "")).otherwise(F.array_join(parts, " "))
    return rows.select(*key, F.when(F.col("in_block") == 0, "true").otherwise("perturbed").alias("kind"), "_v.category", "_v.position", "_v.variant", put.alias("text"), "in_block")


# --- backends --------------------------------------------------------------------------------------------------

#: Ways to make variants, by name: functions of (sentences, carry, n, seed) as :func:`sentence_variants`. Callers add parsers.
BACKENDS: dict[str, Callable[..., DataFrame]] = {"tables": sentence_variants}


def backend(name: str = "auto") -> tuple[str, Callable[..., DataFrame]]:
    """The backend of a name; "auto" is the last one added that says it is there, else "tables".

    A backend says so by not raising an ImportError when called without arguments.
    """
    if name != "auto":
        return name, BACKENDS[name]
    for known in reversed([b for b in BACKENDS if b != "tables"]):
        try:
            BACKENDS[known]()
        except ImportError:
            continue
        return known, BACKENDS[known]
    return "tables", BACKENDS["tables"]
