"""Deterministic choices from hashes of keys: never from the state of a generator or the order of partitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_bucket(key: Column, buckets: int = 10_000) -> Column:
    """The md5 of the key, read as one 128-bit number, modulo ``buckets``."""
    digest = F.md5(key.cast("string").cast("binary"))

    def half(start: int) -> Column:
        return F.pmod(F.conv(F.substring(digest, start, 16), 16, 10).cast("decimal(20,0)"), F.lit(buckets).cast("decimal(20,0)")).cast("bigint")

    return F.pmod(half(1) * F.lit(2**64 % buckets) + half(17), F.lit(buckets))


def held_out(doc_id: Column, share: float = 0.10) -> Column:
    """Whether a document belongs to validation: all rows of a document fall on one side."""
    return md5_bucket(doc_id) < F.lit(share * 10_000)


def draw(n: int | Column, *key) -> Column:
    """A number from 0 to n - 1 that depends on the key only."""
    return F.pmod(F.xxhash64(*[F.lit(k) if isinstance(k, (str, int)) else k for k in key]), n if isinstance(n, Column) else F.lit(n))


def order_key(seed: str, *key: Column) -> Column:
    """A seeded order that both engines can compute: md5 of the seed and the key."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in key]).cast("binary"))


def content_digest(*columns: Column) -> Column:
    """Aggregate digest of a set of rows, whatever their order: the sum of the rows' hashes, wrapped into 10 ** 18."""
    return F.sum(F.pmod(F.xxhash64(*columns), F.lit(10**9)).cast("decimal(38,0)")).cast("string")
