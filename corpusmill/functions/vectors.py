"""Expressions over arrays of doubles (topic distributions, embeddings)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it inside `body`."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def literal_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where either vector is zero."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale).otherwise(F.lit(0.0))


def _half_divergence(x: Column, y: Column) -> Column:
    return F.when(x > 0, x * F.ln(2 * x / (x + y))).otherwise(F.lit(0.0))


def js_term(x: Column, y: Column) -> Column:
    """One coordinate's share of the Jensen-Shannon divergence (natural log)."""
    return (_half_divergence(x, y) + _half_divergence(y, x)) / 2


def js_distance(a: Column, b: Column) -> Column:
    """Square root of the Jensen-Shannon divergence of two distributions."""
    divergence = total(F.zip_with(a, b, js_term))
    return F.sqrt(F.greatest(divergence, F.lit(0.0)))


def scaled_to_one(v: Column) -> Column:
    return let(total(v), lambda mass: F.transform(v, lambda x: x / mass))


def js_similarity(a: Column, b: Column) -> Column:
    return 1 - js_distance(scaled_to_one(a), scaled_to_one(b))


def argmax(v: Column) -> Column:
    """Position of the largest element; the first one wins a tie."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")
