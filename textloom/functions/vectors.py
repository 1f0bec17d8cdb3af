"""Vector functions on ``array<double>`` columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector is 0."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def softmax(v: Column) -> Column:
    top = F.array_max(v)
    e = F.transform(v, lambda x: F.exp(x - top))
    held = F.array(F.struct(e.alias("e"), total(e).alias("sum")))  # a lambda's argument, so that the sum is taken once
    return F.get(F.transform(held, lambda h: F.transform(h["e"], lambda x: x / h["sum"])), 0)


def temperature_scale(v: Column, temperature: float) -> Column:
    """Logits divided by a positive temperature; the order of classes stays."""
    if temperature <= 0:
        raise ValueError("the temperature has to be positive")
    return F.transform(v, lambda x: x / float(temperature))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def linear(v: Column, weights: Sequence[Sequence[float]], bias: Sequence[float]) -> Column:
    """One row of ``weights`` per output; no activation."""
    rows = [dot(v, F.array(*map(F.lit, map(float, w)))) + float(b) for w, b in zip(weights, bias, strict=True)]
    return F.array(*rows)


def argmax(v: Column) -> Column:
    """The index (from 0) of the first largest value."""
    return F.array_position(v, F.array_max(v)) - 1


#: How a text's vector is taken from its tokens' vectors.
STRATEGIES = ("per_token", "cls_token", "reduce_mean", "reduce_max")


def extracted(tokens: Column, strategy: str, mask: Column | None = None) -> Column:
    """A text's vectors from an array of a vector per token; ``mask`` is 0 at tokens that are padding.

    ``per_token`` gives all that are left, ``cls_token`` the first one, the others the mean or the maximum of each dimension; null of none.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"no strategy {strategy!r}; there are {STRATEGIES}")
    held = tokens if mask is None else F.transform(F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda x: x["m"] != 0), lambda x: x["t"])
    if strategy == "per_token":
        return held
    first = F.get(held, F.lit(0))
    if strategy == "cls_token":
        return first
    step = (lambda a, v: F.zip_with(a, v, lambda x, y: F.greatest(x, y))) if strategy == "reduce_max" else (lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    folded = F.aggregate(F.slice(held, 2, 1 << 30), first, step)
    return folded if strategy == "reduce_max" else F.transform(folded, lambda x: x / F.size(held))


def mean_of(column: str, size: int) -> list[Column]:
    """Aggregates for the mean of each dimension of an array column."""
    return [F.avg(F.get(column, F.lit(i))).alias(f"d{i}") for i in range(size)]
