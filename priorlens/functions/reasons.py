"""Reasons as data: every guard yields codes, decisions follow from the codes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once: an expression that names it often stays small, and so do plan and code."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def codes(*rules: tuple[Column, str | Column]) -> Column:
    """The codes whose condition is true, in order, each once."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(c, F.lit(r) if isinstance(r, str) else r) for c, r in rules]))) if rules else F.expr("cast(array() as array<string>)")


def merged(*arrays: Column) -> Column:
    """Arrays of codes joined in order, each code once; null arrays count as empty."""
    none = F.expr("cast(array() as array<string>)")
    return F.array_distinct(F.concat(*[F.coalesce(a, none) for a in arrays]))


def first(*rules: tuple[Column, str | Column]) -> Column:
    """The code of the first true condition, or null."""
    return F.coalesce(*[F.when(c, F.lit(r) if isinstance(r, str) else r) for c, r in rules])


def equal3(a: Column, b: Column) -> Column:
    """True, false, or null if either side is unknown."""
    return a == b
