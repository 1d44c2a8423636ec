"""Vector functions as column expressions over array<float>; sums are in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    pairs = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """Cosine similarity, 0 where a vector has no length."""
    below = norm(a) * norm(b)
    return F.when(below > 0, dot(a, b) / below).otherwise(0.0)


def clamp(x, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _c(x)))


def unit(a) -> Column:
    """The vector at length 1; a zero vector stays."""
    n = norm(a)
    return F.transform(_c(a), lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")).cast("float"))


def answer_similarity(a, b) -> Column:
    """(cosine + 1) / 2, cosine held within [-1, 1]; 0 where a vector has no length."""
    below = norm(a) * norm(b)
    return F.when(below > 0, (clamp(dot(a, b) / below, -1.0, 1.0) + 1) / 2).otherwise(0.0)


def density(nodes, edges) -> Column:
    """Share of possible undirected edges, 4 digits; 0 for one node or none."""
    n, m = _c(nodes).cast("double"), _c(edges)
    return F.when(n > 1, F.round(2 * m / (n * (n - 1)), 4)).otherwise(0.0)


def text_similarity(text_a, text_b, a, b) -> Column:
    """`answer_similarity` of the vectors of two texts: 1 if both texts are blank, 0 if one of them is."""
    blank = lambda x: F.trim(F.coalesce(_c(x), F.lit(""))) == ""
    return F.when(blank(text_a) & blank(text_b), 1.0).when(blank(text_a) | blank(text_b), 0.0).otherwise(answer_similarity(a, b))
