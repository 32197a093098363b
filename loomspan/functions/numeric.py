"""Numeric expressions: sigmoid, combinatorial ratios, percentiles, bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PERCENTILES = (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)
#: Edges of token-length bins; the last is open.
TOKEN_EDGES = (0, 32, 64, 96, 128, 192, 256, 320, 384, 448, 512)
HISTOGRAM = (-0.2, 1.4, 64)


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def success(w: Column, m: Column, d: Column) -> Column:
    """C(w, d) / C(m, d): chance that d negatives drawn of m are all among the w beaten; null if m < d."""
    product = F.aggregate(F.sequence(F.lit(0), d - 1), F.lit(1.0), lambda p, i: p * (w - i) / (m - i))
    return F.when(m < d, F.lit(None).cast("double")).when(w >= d, product).otherwise(F.lit(0.0))


def histogram_bin(x: Column, low: float = HISTOGRAM[0], high: float = HISTOGRAM[1], n: int = HISTOGRAM[2]) -> Column:
    """Bin from 0; the last bin is closed; null outside."""
    bin_ = F.floor((x - F.lit(low)) / F.lit((high - low) / n)).cast("int")
    return F.when((x >= low) & (x <= high), F.least(bin_, F.lit(n - 1)))


def token_bin(n: Column, edges=TOKEN_EDGES) -> Column:
    """Label of the half-open bin; below the first edge counts as the first, beyond the last as open."""
    out = F.lit(f"{edges[-1]}+")
    for lo, hi in reversed(list(zip(edges, edges[1:]))):
        out = F.when(n < hi, F.lit(f"{lo}-{hi}")).otherwise(out)
    return out


def cosine(a: Column, b: Column) -> Column:
    """Of two vectors; norms are at least 1e-12."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / (F.greatest(F.sqrt(dot(a, a)), F.lit(1e-12)) * F.greatest(F.sqrt(dot(b, b)), F.lit(1e-12)))


def unit(a: Column) -> Column:
    """The vector at length one, as doubles."""
    x = F.transform(a, lambda v: v.cast("double"))
    norm = F.greatest(F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)), F.lit(1e-12))
    return F.transform(x, lambda v: v / norm)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
