"""Two-valued predicates: an unknown comparison is false, also under IN, BETWEEN and their negations.

Only NOT turns such a false into true. A filter drops unknown rows anyway, so top-level conjuncts
are better left as plain comparisons, which are pushed into the scan; these forms are for what
stands under NOT or in a projection.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def holds(p: Column) -> Column:
    return F.coalesce(p, F.lit(False))


def negated(p: Column) -> Column:
    """NOT p: true where p is false or unknown."""
    return ~holds(p)


def is_in(x: Column, *candidates: Column) -> Column:
    """Null candidates are skipped."""
    return reduce(lambda a, b: a | b, [holds(x == c) for c in candidates], F.lit(False))


def not_in(x: Column, *candidates: Column) -> Column:
    """False for a null x, unlike negated(is_in(...))."""
    return x.isNotNull() & ~is_in(x, *candidates)


def between(x: Column, low: Column, high: Column) -> Column:
    return holds(x.between(low, high))


def not_between(x: Column, low: Column, high: Column) -> Column:
    known = x.isNotNull() & low.isNotNull() & high.isNotNull()
    return known & ~holds(x.between(low, high))


def truthy(x: Column, kind: str) -> Column:
    """A bare expression as a predicate: kind is boolean, number, text or other."""
    by = {"boolean": lambda: x, "number": lambda: x != 0, "text": lambda: x != ""}
    return holds(by[kind]()) if kind in by else x.isNotNull()
