"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import CACHE_WORDS, SPACES, chunks, payload, text_or_empty

#: Hash buckets of words, and the width of the low-rank interactions.
BUCKETS, RANK = 1024, 8
#: Hash buckets of metadata terms.
META = 64
#: At most so many labelled rows are fitted; those with the smallest hashes of their ids, over all rows.
SAMPLE_ROWS = 6_000
#: Words of a text of a sampled row that are moved to the driver are counted, never the text itself.
THRESHOLD = 0.3
_STRUCTURE = ("bias", "log_words", "symbols", "capitals", "digits", "word_length", "variety", "repeats", "dup_lines", "stops", "exclaims", "pipes", "bullets", "line_words", "log_chars", "non_ascii", "short_text", "ends")
FEATURES = BUCKETS + META + len(_STRUCTURE)


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        b = self[word] = zlib.crc32(word.strip(b".,;:!?\"'()").lower()) % BUCKETS
        return b


def terms(docs: DataFrame, metadata: tuple[str, ...]):
    """Metadata columns as an array of terms ``name=value``; numbers by their order of magnitude in powers of two."""
    numbers = {f.name for f in docs.schema if isinstance(f.dataType, T.NumericType)}

    def value(c: str):
        column = F.col(f"`{c}`")
        return F.floor(F.log2(F.abs(column.cast("double")) + 1)).cast("string") if c in numbers else column.cast("string")

    return F.array(*[F.concat(F.lit(f"{c}="), F.coalesce(value(c), F.lit(""))) for c in metadata]).cast("array<string>")


def features(texts: list[bytes], buckets: dict, metadata: list[list[str]] | None = None) -> np.ndarray:
    """A row of FEATURES numbers for each whole text: square roots of word shares by bucket, metadata terms, then structure."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for i, found in enumerate(metadata or ()):
        for term in found:
            out[i, BUCKETS + zlib.crc32(term.encode()) % META] = 1
    for i, t in enumerate(texts):
        words = t.split()
        n = len(words)
        m = max(n, 1)
        s = t.decode("utf-8")
        chars = max(len(s) - sum(s.count(c) for c in SPACES), 1)
        row = out[i]
        distinct = len(set(words))
        if n:
            share = np.bincount(np.fromiter(map(buckets.__getitem__, words), np.int64, n), minlength=BUCKETS) / n
            row[:BUCKETS] = np.sqrt(share)
        lines = [x for x in t.split(b"\n") if x.strip()]
        k = max(len(lines), 1)
        raw = np.frombuffer(t, np.uint8)
        upper = int(((raw >= 65) & (raw <= 90)).sum())
        digit = int(((raw >= 48) & (raw <= 57)).sum())
        repeats = sum(a == b for a, b in zip(words, words[1:]))
        row[BUCKETS + META :] = (
            1.0,
            np.log1p(n) / 8,
            min(sum(s.count(c) for c in "#*$%&|<>") / m, 3.0),
            upper / chars,
            digit / chars,
            min(chars / m / 10, 3.0),
            distinct / m,
            repeats / m,
            (len(lines) - len(set(lines))) / k,
            min((s.count(".") + s.count(",")) / m, 1.0),
            min(s.count("!") / m, 2.0),
            min(s.count("|") / m, 1.0),
            sum(x.lstrip()[:1] in (b"-", b"*", b"#", b">") for x in lines) / k,
            np.log1p(m / k) / 6,
            np.log1p(len(s)) / 10,
            min(len(t) / max(len(s), 1) - 1, 1.0),
            1.0 if n < 50 else 0.0,
            sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / k,
        )
    return out


@dataclass
class Machine:
    """Weights of a fitted factorisation machine: linear, and one RANK-vector per feature."""

    linear: np.ndarray
    factors: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Linear part and all pairwise interactions, in time linear in the features.

        sum over i < j of <v_i, v_j> x_i x_j = 1/2 sum over f of ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)
        """
        return x @ self.linear + 0.5 * ((x @ self.factors) ** 2 - (x**2) @ (self.factors**2)).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 0.03, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Logistic loss, Adam, seeded batches. Without rows the score is 0.5 everywhere; the same rows give the same machine."""
    rng = np.random.default_rng(seed)
    at = [np.zeros(FEATURES, np.float32), (rng.normal(0, 0.01, (FEATURES, RANK))).astype(np.float32)]
    if not len(y):
        return Machine(at[0], np.zeros_like(at[1]))
    mean, var, step = [np.zeros_like(a) for a in at], [np.zeros_like(a) for a in at], 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // 256)):
            xb, machine = x[part], Machine(*at)
            g = (machine.score(xb) - y[part]) / len(part)
            inner = xb @ at[1]
            grads = [xb.T @ g + decay * at[0], xb.T @ (g[:, None] * inner) - at[1] * ((xb**2).T @ g)[:, None] + decay * at[1]]
            step += 1
            for i, grad in enumerate(grads):
                mean[i] = 0.9 * mean[i] + 0.1 * grad
                var[i] = 0.999 * var[i] + 0.001 * grad**2
                at[i] = at[i] - rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(var[i] / (1 - 0.999**step)) + 1e-8)
    return Machine(*at)


def fold(doc_id):
    """crc32 of the id as text, modulo 5; null ids fall in fold 1, and so are never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(1))


def _feature_rows(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The columns in ``carry`` and ``features`` of ``text`` and ``_terms``."""
    schema = T.StructType([docs.schema[c] for c in carry] + [T.StructField("features", T.ArrayType(T.FloatType()))])

    def run(batches):
        buckets = _Buckets()
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                x = features(texts, buckets, part.column("_terms").to_pylist())
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, FEATURES, dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in carry], flat], names=[*carry, "features"])

    return docs.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = SAMPLE_ROWS, metadata: tuple[str, ...] = ()) -> Machine:
    """Fits on at most ``rows`` labelled documents outside the held-out fold, chosen by hash over all of them.

    ``metadata`` names columns of ``docs`` whose values are features too; labels, ids and what stands for them must not be there.
    ``labels`` has doc_id and the label; null labels are left out, and of an id labelled twice the larger label counts.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    known = known.groupBy("doc_id").agg(F.max(F.col(label_col).cast("int")).alias("_y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # bounded: so it may be broadcast
    told = docs.select("doc_id", text_or_empty("text").alias("text"), terms(docs, metadata).alias("_terms")).join(F.broadcast(chosen), "doc_id")
    sample = _feature_rows(told, ["doc_id", "_y"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).toArrow()
    x = sample.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
    return fit(x, sample.column("_y").to_numpy().astype(np.float32))


def score(docs: DataFrame, machine: Machine, text_col: str = "text", threshold: float = THRESHOLD, metadata: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: ``doc`` (all columns but the text), ``score`` in 0 to 1 and ``predicted``.

    ``metadata`` names the columns that the machine was fitted with. A null there is a value of its own. A null text is empty and scored as such; repeated rows get equal scores; an empty table stays empty.
    """
    source = docs.select(payload(docs, text_col).alias("doc"), text_or_empty(f"`{text_col}`").alias("text"), terms(docs, metadata).alias("_terms"))
    schema = T.StructType([source.schema["doc"], T.StructField("score", T.DoubleType())])

    def run(batches):
        buckets = _Buckets()
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(machine.score(features(texts, buckets, part.column("_terms").to_pylist())).astype(np.float64))], names=["doc", "score"])

    return source.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality_query(spark, sf_dir: str) -> DataFrame:
    """op6: scores all ``documents``; labels are learnt from outside the held-out fold only. The length is the only metadata."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    out = score(docs, train(docs, labels, metadata=("n_chars",)), metadata=("n_chars",))
    doc_id = F.col("doc.doc_id")
    return out.select(doc_id.alias("doc_id"), (fold(doc_id) == 0).alias("held_out"), "score", "predicted")
