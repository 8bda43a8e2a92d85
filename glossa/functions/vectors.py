"""Vector functions on arrays of numbers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(u: Column, v: Column) -> Column:
    return F.aggregate(F.zip_with(u.cast("array<double>"), v.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)


def norm(u: Column) -> Column:
    return F.sqrt(dot(u, u))


def cosine(u: Column, v: Column) -> Column:
    """Cosine, 0 where a norm is 0."""
    size = norm(u) * norm(v)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(u, v) / size)


def l2_normalised(u: Column) -> Column:
    """Unit length; a zero vector stays."""
    size = norm(u)
    return F.transform(u.cast("array<double>"), lambda x: F.when(size == 0, x).otherwise(x / size))


def pair_features(u: Column, v: Column) -> Column:
    """[u, v, |u - v|, u * v, cos] of normalised vectors."""
    a, b = l2_normalised(u), l2_normalised(v)
    return F.concat(a, b, F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.zip_with(a, b, lambda x, y: x * y), F.array(dot(a, b)))


def top_k(logits: Column, k: int) -> Column:
    """Logits below the k-th largest as minus infinity."""
    least = F.element_at(F.array_sort(logits), -k)
    return logits if k <= 0 else F.when(F.size(logits) <= k, logits).otherwise(F.transform(logits, lambda x: F.when(x < least, F.lit(float("-inf"))).otherwise(x)))


def repetition_penalty(logits: Column, seen: Column, penalty: float) -> Column:
    """Positive logits of seen ids divided, others multiplied; each id once."""
    if penalty <= 1:
        return logits
    return F.transform(logits, lambda x, i: F.when(F.array_contains(seen, i), F.when(x > 0, x / penalty).otherwise(x * penalty)).otherwise(x))


def blocked_ids(ids: Column, n: int) -> Column:
    """Ids that would repeat an n-gram of the generated ids."""
    last = F.slice(ids, -(n - 1), n - 1) if n > 1 else F.slice(ids, 1, 0)
    starts = F.sequence(F.lit(1), F.size(ids) - n + 1)
    hits = F.filter(starts, lambda i: F.slice(ids, i, n - 1) == last) if n > 1 else starts
    return F.when(F.size(ids) >= n, F.array_distinct(F.transform(hits, lambda i: F.element_at(ids, i + n - 1)))).otherwise(F.slice(ids, 1, 0))
