"""Expressions over feature arrays (``x array<double>``)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack(features: Sequence[str]) -> Column:
    """Feature columns as one array of doubles."""
    return F.array(*[F.col(f).cast("double") for f in features])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    An expression used inside a lambda is otherwise computed again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda u, v: u * v))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)))


def take(x: Column, indices: Column) -> Column:
    """Elements of ``x`` at 0-based ``indices`` (repeats allowed)."""
    return F.transform(indices, lambda i: F.get(x, i))


def lower_bound(ascending: Column, value: Column, longest: int) -> Column:
    """How many elements of ``ascending`` (at most ``longest``) lie below ``value``, by halving."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, longest.bit_length())))])

    def step(at: Column, jump: Column) -> Column:
        return F.when(F.get(ascending, at + jump - 1) < value, at + jump).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def half_even(value: Column) -> Column:
    """Round half to even, as a bigint."""
    return F.bround(value, 0).cast("bigint")
