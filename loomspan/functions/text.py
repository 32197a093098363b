"""Text expressions: joining, normalising, parsing ids and labels. All are Column functions without Python at run time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages written without spaces between sentences.
UNSPACED = ("zh", "ja", "th")


def joiner(lang: Column | str) -> Column:
    """Empty for languages that are written without spaces, else one space."""
    return F.when((F.col(lang) if isinstance(lang, str) else lang).isin(*UNSPACED), "").otherwise(" ")


def join_with(texts: Column, separator: Column) -> Column:
    """Array of texts joined by a separator that may differ by row."""
    return F.aggregate(F.slice(texts, 2, F.greatest(F.size(texts) - 1, F.lit(0))), F.coalesce(F.get(texts, 0), F.lit("")), lambda a, x: F.concat(a, separator, x))


#: White space of any script, for both engines' regular expressions.
SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]+"


def collapse(text: Column) -> Column:
    """White space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def tidy(text: Column) -> Column:
    """Collapsed, and without space before punctuation."""
    return F.regexp_replace(collapse(text), r" +([,.;:!?])", "$1")


def strip_markup(text: Column) -> Column:
    """Without the marks <v> and </v> of error spans, with nothing in their place; a literal backslash-n and white space runs become one space."""
    bare = F.replace(F.replace(text, F.lit("<v>")), F.lit("</v>"))
    return collapse(F.replace(bare, F.lit("\\n"), F.lit(" ")))


def join_nonblank(texts: Column, separator: str = " ") -> Column:
    """Trimmed parts joined, blank ones left out."""
    return F.array_join(F.filter(F.transform(texts, lambda x: F.trim(x)), lambda x: F.length(x) > 0), separator)


def strip_punctuation(word: Column) -> Column:
    return F.btrim(word, F.lit(".,;:!?\"'()[]"))


def has_capital(word: Column) -> Column:
    """Its first letter, after anything else but digits, is a capital."""
    return word.rlike(r"^[^\p{L}\p{N}]*\p{Lu}")


def match_case(word: Column, like: Column) -> Column:
    """``word`` with the case of ``like``: all capitals, first capital, or as it is."""
    return F.when((F.length(like) > 1) & (like == F.upper(like)) & (like != F.lower(like)), F.upper(word)).when(has_capital(like), F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, F.lit(2), F.length(word)))).otherwise(word)


def n_tokens(text: Column) -> Column:
    """Default token counter: words and punctuation marks, without a tokenizer."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[A-Za-z0-9À-ÿ]+|[^A-Za-z0-9À-ÿ \t\n\x0B\f\r]")), F.lit(0)).cast("bigint")


def pair_of(doc_id: Column) -> Column:
    """Language pair of an id such as cs-de_DE_#_news_#_1: cs-de."""
    return F.substring_index(F.substring_index(doc_id, "_#_", 1), "_", 1)


def domain_of(doc_id: Column) -> Column:
    return F.split_part(doc_id, F.lit("_#_"), F.lit(2))


def window_id(lang: Column, window: Column, k: Column) -> Column:
    return F.format_string("%s-w%03d-k%d", lang, window, k)


def arm_to_label(family: Column, mix: Column, frozen: Column) -> Column:
    """family-mix[-frozen]"""
    return F.concat(family, F.lit("-"), mix, F.when(frozen, "-frozen").otherwise(""))


def arm_to_file(family: Column, mix: Column, frozen: Column) -> Column:
    """[kiwi-]mix-<mix>[-frozen]; the reference-free family carries the prefix."""
    return F.concat(F.when(family == "qe", "kiwi-").otherwise(""), F.lit("mix-"), mix, F.when(frozen, "-frozen").otherwise(""))


def file_to_arm(name: Column) -> Column:
    """The inverse of :func:`arm_to_file`, as a struct (family, mix, frozen)."""
    return F.struct(F.when(name.startswith("kiwi-"), "qe").otherwise("ref").alias("family"), F.regexp_replace(F.regexp_extract(name, r"^(?:kiwi-)?mix-(.*)$", 1), "-frozen$", "").alias("mix"), name.endswith("-frozen").alias("frozen"))
