"""Quality rules: rules vote or abstain, expectation-maximisation weighs them, and a posterior decides."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import CACHE_WORDS, SPACES, Scratch, chunks, payload, text_or_empty

GOOD, BAD, ABSTAIN = 1, 0, 2
#: Rules in the order of their votes. Each is (name, votes bad when, votes good when) in terms of the statistics.
RULES = ("symbols", "plain_words", "odd_characters", "repeats", "echoes", "variety", "duplicate_lines", "capitals", "shouted_words", "exclamations", "word_length", "sentence_ends")
MIN_WORDS = 50
#: Before any data: share of good documents, and right votes of a rule given good and given bad.
PRIOR_GOOD, PRIOR_RIGHT = 0.85, (0.97, 0.4)
#: Probability of "good" from which a document is kept.
KEEP_FROM = 0.5

_SYMBOLS = "#*$%&|<>"
_NOT_CAPITAL = re.compile(rb"[^A-Z]")
_ORDINARY = re.compile(r"[\w\s.,;:!?'\"()\-]+")


def repeated_words(words: list[bytes]) -> int:
    """Words covered by 3-word windows that the text has at least twice."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    n = len(ids)
    if n < 2_000_000:
        code = (w[:-2] * n + w[1:-1]) * n + w[2:]
    else:  # pairs first, so that codes stay exact
        _, pair = np.unique(w[:-2] * n + w[1:-1], return_inverse=True)
        code = pair * n + w[2:]
    order = np.argsort(code, kind="stable")
    s = code[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(s), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = order[twice]
    covered = np.zeros(len(w), bool)
    for j in range(3):
        covered[at + j] = True
    return int(covered.sum())


class WordKinds(dict):
    """Of each word: 1 if it is letters within ordinary punctuation, plus 1024 if it is shouted (two capitals or more, no small letter)."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        core = word.decode("utf-8").strip(".,;:!?\"'()-\u201c\u201d\u2018\u2019\u00bf\u00a1")
        plain = core.replace("-", "").replace("'", "").replace("\u2019", "").isalpha()
        k = self[word] = plain + 1024 * (len(core) > 1 and core.isupper())
        return k


def statistics(text: bytes, kinds: WordKinds) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the rules' votes of one text."""
    words = text.split()
    n = len(words)
    string = text.decode("utf-8")
    chars = len(string) - sum(string.count(c) for c in SPACES)
    symbols = sum(string.count(c) for c in _SYMBOLS)
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    rep = repeated_words(words)
    failed = n < MIN_WORDS or 100 * rep > 50 * n
    m = max(n, 1)
    capitals = len(_NOT_CAPITAL.sub(b"", text)) / max(chars, 1)
    kind = np.fromiter(map(kinds.__getitem__, words), np.int64, n)
    plain, shouted = int((kind % 1024).sum()) / m, int((kind // 1024).sum()) / m
    odd = len(_ORDINARY.sub("", string)) / max(chars, 1)
    echoes = sum(a == b for a, b in zip(words, words[1:])) / m
    variety = len(set(words)) / m
    exclaims = string.count("!") / m
    ends = sum(x.rstrip()[-1:] in b".!?:\"'" for x in lines) / max(len(lines), 1)

    def vote(bad: bool, good: bool) -> int:
        return BAD if bad else GOOD if good else ABSTAIN

    votes = (
        vote(symbols > 0.1 * m, symbols < 0.02 * m),
        vote(plain < 0.7, plain > 0.9),
        vote(odd > 0.1, odd < 0.03),
        vote(rep > 0.2 * m, rep < 0.05 * m),
        vote(echoes > 0.1, echoes < 0.02),
        vote(variety < 0.25 and n < 1000, variety > 0.5),
        vote(len(lines) >= 4 and dup > 0.3 * len(lines), len(lines) >= 2 and dup == 0),
        vote(capitals > 0.3, capitals < 0.1),
        vote(shouted > 0.3, shouted < 0.1),
        vote(exclaims > 0.2, exclaims < 0.02),
        vote(chars > 12 * m or chars < 2.5 * m, 3 * m <= chars <= 10 * m),
        vote(len(lines) > 0 and ends < 0.2, ends > 0.6),
    )
    return n, chars, symbols, dup, rep, failed, "".join(map(str, votes))


_STATS = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [T.StructField("base_failed", T.BooleanType()), T.StructField("votes", T.StringType())])


def rule_votes(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``doc`` (all columns but the text), ``text`` if it is kept, statistics and one vote per rule, of whole texts."""
    source = docs.select(payload(docs, text_col).alias("doc"), text_or_empty(f"`{text_col}`").alias("text"))
    schema = T.StructType([source.schema["doc"], *([T.StructField("text", T.StringType())] if keep_text else []), *_STATS.fields])

    def run(batches):
        kinds = WordKinds()
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                columns = list(zip(*(statistics(t, kinds) for t in texts), strict=True))
                yield pa.RecordBatch.from_arrays([part.column("doc"), *([part.column("text")] if keep_text else []), *[pa.array(c, pa.bool_() if i == 5 else pa.string() if i == 6 else pa.int64()) for i, c in enumerate(columns)]], names=schema.names)

    return source.mapInArrow(run, schema)


def fit_votes(patterns: list[tuple[str, int]], rounds: int = 200) -> tuple[float, np.ndarray]:
    """Expectation-maximisation over vote patterns and how many documents have each.

    Returns the share of good documents and, per rule, the probabilities of its right vote given good and given
    bad. Abstaining says nothing. Rules look for different faults, so one is expected to see a bad document as bad
    4 times in 10 and a good one as good nearly always; a prior of that, worth a thousandth of the documents,
    keeps the classes from changing names and rules that seldom vote from certainty.
    """
    expected = np.tile(PRIOR_RIGHT, (len(RULES), 1))
    if not patterns:
        return PRIOR_GOOD, expected
    votes = np.array([[int(c) for c in p] for p, _ in patterns])
    weight = np.array([n for _, n in patterns], float)
    said, good = votes != ABSTAIN, votes == GOOD
    right, share, strength = expected.copy(), PRIOR_GOOD, max(4.0, 0.001 * weight.sum())
    for _ in range(rounds):
        p = posterior(votes, share, right)
        new = np.empty_like(right)
        for k, belief, hit in ((0, p, good), (1, 1 - p, said & ~good)):
            new[:, k] = ((weight * belief) @ hit + expected[:, k] * strength) / ((weight * belief) @ said + strength)
        new = new.clip(0.005, 0.998)
        share = float(np.clip((weight @ p + PRIOR_GOOD * strength) / (weight.sum() + strength), 0.05, 0.98))
        moved, right = np.abs(new - right).max(), new
        if moved < 1e-10:
            break
    return share, right


def posterior(votes: np.ndarray, share: float, right: np.ndarray) -> np.ndarray:
    """Probability that a document is good, by pattern of votes."""
    good, bad = votes == GOOD, votes == BAD
    ratio = np.log(share / (1 - share)) + good @ np.log(right[:, 0] / (1 - right[:, 1])) + bad @ np.log((1 - right[:, 0]) / right[:, 1])
    return 1 / (1 + np.exp(-ratio))


def judge(voted: DataFrame) -> DataFrame:
    """Adds ``quality`` (posterior) and ``kept`` to the rows of :func:`rule_votes`.

    The rules' accuracies are learnt from the vote patterns of all rows that pass the base: at most
    3 ** len(RULES) patterns reach the driver, whatever the input's size.
    """
    counted = voted.filter(~F.col("base_failed")).groupBy("votes").count().collect()
    patterns = sorted((r["votes"], r["count"]) for r in counted)
    share, right = fit_votes(patterns)
    base = np.log(share / (1 - share))
    score = F.lit(float(base))
    for j in range(len(RULES)):
        vote = F.substring("votes", j + 1, 1)
        score = score + F.when(vote == str(GOOD), float(np.log(right[j, 0] / (1 - right[j, 1])))).when(vote == str(BAD), float(np.log((1 - right[j, 0]) / right[j, 1]))).otherwise(0.0)
    quality = F.lit(1.0) / (F.lit(1.0) + F.exp(-score))
    return voted.withColumn("quality", quality).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_FROM))


def quality_rules(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Rows of ``docs`` with statistics, votes, posterior quality and verdict.

    Returns ``doc`` (all columns but the text), ``text`` if it is kept, the statistics, ``base_failed``, ``votes``,
    ``quality`` and ``kept``. A null text is empty; it fails the base (under 50 words). Repeated rows get the same
    verdict; an empty table gives an empty result. The rules read the texts once; their votes are kept in the shared
    folder (beside the texts if these are kept) while the accuracies are learnt.
    """
    return judge(Scratch(docs.sparkSession, "rules").save(rule_votes(docs, text_col, keep_text), "votes"))


def quality_rules_query(spark, sf_dir: str) -> DataFrame:
    """op8: the digest columns over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = quality_rules(docs, keep_text=False)
    return out.select(F.col("doc.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
