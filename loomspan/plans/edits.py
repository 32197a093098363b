"""Queries on the edits of sentences that SQL can list as well: word pairs and numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.operators import lexicons, perturb

from .tables import SENTENCES, sentences

QUERIES, SQL = {}, {}


def query(name, sql):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def _words(*ways: str) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return "words(lang, word, way, put) AS (VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in lexicons.rows() if r[2] in ways) + ")"


_PATTERN = r"'\p{Nd}+|[\p{L}\p{M}_]+(?:[''’][\p{L}\p{M}]+)*'"
_UNITS = f"""{SENTENCES}, t AS (SELECT DISTINCT coalesce(lang, '') AS lang, text FROM sent WHERE regexp_matches(text, '\\S')),
u AS (SELECT lang, text, regexp_extract_all(text, {_PATTERN}) AS units, string_split_regex(text, {_PATTERN}) AS gaps FROM t),
e AS (SELECT lang, text, units, gaps, unnest(range(1, len(units) + 1)) AS i FROM u)"""
_CASED = r"CASE WHEN length(units[i]) > 1 AND units[i] = upper(units[i]) AND units[i] <> lower(units[i]) THEN upper(put) WHEN regexp_matches(units[i], '^[^\p{L}\p{N}]*\p{Lu}') THEN upper(put[1:1]) || put[2:] ELSE put END"
_MADE = "md5(array_to_string(list_transform(range(1, len(units) + 1), lambda k: gaps[k] || CASE WHEN k = i THEN put ELSE units[k] END), '') || gaps[len(gaps)]) AS made"


def _hashed(edits):
    return edits.select("lang", F.md5(F.col("text").cast("binary")).alias("text"), F.col("at").cast("bigint").alias("at"), "way", F.md5(F.col("made").cast("binary")).alias("made"))


@query("word_edits", f"WITH {_words('antonym', 'modal')}, {_UNITS}, h AS (SELECT e.*, way, {_CASED} AS put FROM e JOIN words w ON w.lang = e.lang AND w.word = lower(units[i])) SELECT lang, md5(text) AS text, i - 1 AS at, way, {_MADE} FROM h")
def word_edits(spark, sf_dir):
    """Every sentence with one of its words replaced by its opposite, or a weak claim made firm."""
    return _hashed(perturb.listed_edits(sentences(spark, sf_dir), ("antonym", "modal")))


_DIGITS = """d AS (SELECT lang, text, units, gaps, i, translate(md5(concat_ws(chr(31), '5', lang, 'digits', text, i - 1, d)), 'abcdef', '012345') AS x FROM e, range(0, 7) AS r(d) WHERE regexp_matches(units[i], '^\\p{Nd}')),
l AS (SELECT *, repeat(x, ceil(length(units[i]) / 32)::INTEGER)[1 : length(units[i])] AS y FROM d),
v AS (SELECT DISTINCT lang, text, units, gaps, i, CASE WHEN length(units[i]) > 1 AND units[i][1:1] <> '0' THEN translate(y[1:1], '0', '8') ELSE y[1:1] END || y[2:] AS put FROM l)"""


@query("number_edits", f"WITH {_words('ordinal')}, {_UNITS}, {_DIGITS}, h AS (SELECT * FROM v WHERE put <> units[i] UNION ALL SELECT e.*, {_CASED} AS put FROM e JOIN words w ON w.lang = e.lang AND w.word = lower(units[i])) SELECT lang, md5(text) AS text, i - 1 AS at, 'number' AS way, {_MADE} FROM h")
def number_edits(spark, sf_dir):
    """Every sentence with one run of digits replaced by those drawn for a variant, or one ordinal by the others."""
    return _hashed(perturb.listed_edits(sentences(spark, sf_dir), ("number",), 1, 5))
