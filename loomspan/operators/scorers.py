"""External scorers behind an interface, and their caches. Models are not part of the engine."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scorer:
    """Scores pairs of texts in batches; ``fingerprint`` identifies the weights, so that caches cannot mix models."""

    name: str
    fingerprint: str
    score: Callable[[list[str], list[str]], list[float]]
    needs_reference: bool = False


_SPEC = re.compile(r"^(?P<kind>comet|hf-mean|xlmr|labse|e5)(?::(?P<id>.+))?$")
_REGISTRY: dict[str, Callable[[str | None], Scorer]] = {}


def parse_spec(spec: str) -> tuple[str, str | None]:
    """Kind and model id of a specification such as e5:base or labse."""
    m = _SPEC.match(spec)
    if not m:
        raise ValueError(f"no such kind of encoder: {spec}")
    kind = "hf-mean" if m["kind"] == "xlmr" else m["kind"]
    if kind in ("comet", "hf-mean") and m["id"] is None and m["kind"] != "xlmr":
        raise ValueError(f"{kind} needs a model")
    return kind, m["id"]


def label_of(spec: str) -> str:
    """A short name, without loading anything."""
    kind, model = parse_spec(spec)
    return kind if model is None else f"{kind}-{model.rstrip('/').split('/')[-1].removesuffix('.ckpt')}"


def register(kind: str, make: Callable[[str | None], Scorer]) -> None:
    _REGISTRY[kind] = make


def load(spec: str) -> Scorer:
    kind, model = parse_spec(spec)
    if kind not in _REGISTRY:
        raise LookupError(f"{kind} is an external model; register a factory for it")
    return _REGISTRY[kind](model)


def pair_key(a: str, b: str):
    """Key of a pair of texts; each is hashed by itself, so no separator can occur in a text."""
    return F.md5(F.concat(F.md5(F.col(a).cast("binary")), F.md5(F.col(b).cast("binary"))).cast("binary"))


def own_cache(cache: DataFrame, scorer: Scorer) -> DataFrame:
    """The cache, stopped with an error if it holds this scorer's name with another fingerprint: scores of other weights."""
    foreign = (F.col("scorer") == scorer.name) & (F.col("fingerprint") != scorer.fingerprint)
    stop = F.raise_error(F.concat(F.lit(f"the cache has scores of {scorer.name} by other weights: "), F.col("fingerprint")))
    return cache.withColumn("fingerprint", F.when(foreign, stop.cast("string")).otherwise(F.col("fingerprint")))


def unscored(pairs: DataFrame, cache: DataFrame, scorer: Scorer, a: str, b: str) -> DataFrame:
    """Distinct pairs that the cache lacks for this scorer."""
    known = cache.filter((F.col("scorer") == scorer.name) & (F.col("fingerprint") == scorer.fingerprint)).select("pair")
    return pairs.select(a, b).dropDuplicates().withColumn("pair", pair_key(a, b)).join(known, "pair", "left_anti")


def score_pairs(pairs: DataFrame, scorer: Scorer, a: str, b: str) -> DataFrame:
    """Cache rows (scorer, fingerprint, pair, score) of the pairs given, scored batch by batch."""
    if scorer.needs_reference:
        raise ValueError("pairs have no reference")
    name, mark, score = scorer.name, scorer.fingerprint, scorer.score

    def run(frames):
        for f in frames:
            f["score"] = [float(x) for x in score(f[a].tolist(), f[b].tolist())]
            f["scorer"], f["fingerprint"] = name, mark
            yield f[["scorer", "fingerprint", "pair", "score"]]

    return pairs.select("pair", a, b).mapInPandas(run, "scorer string, fingerprint string, pair string, score double")


def with_scores(rows: DataFrame, cache: DataFrame, scorer: Scorer, a: str, b: str) -> DataFrame:
    """Rows with the scorer's ``score`` from the cache; null where it is missing."""
    known = cache.filter((F.col("scorer") == scorer.name) & (F.col("fingerprint") == scorer.fingerprint)).select("pair", "score").dropDuplicates(["pair"])
    return rows.withColumn("pair", pair_key(a, b)).join(known, "pair", "left").drop("pair")
