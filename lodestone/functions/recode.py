"""Recoding with survey-package semantics: a missing value is larger than every number."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def above(c: Column, k: float) -> Column:
    return (c > k) | c.isNull()


def at_least(c: Column, k: float) -> Column:
    return (c >= k) | c.isNull()


def flag(condition: Column) -> Column:
    """A generated 0/1 variable: an unknown condition is 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def replace_all(start: Column | None, rules: Sequence[tuple[Column, object]]) -> Column:
    """Statements run one after another: the last one that holds wins."""
    out = None
    for condition, value in reversed(list(rules)):
        held = F.coalesce(condition, F.lit(False))
        out = F.when(held, value) if out is None else out.when(held, value)
    return out.otherwise(start if start is not None else F.lit(None))


def recode(c: Column, rules: Sequence[tuple[float | None, float | None, object]], missing: object | None = None) -> Column:
    """First rule wins, both ends closed, values in no range stay. A rule is (low, high, new); None leaves an end open."""
    def inside(low, high):
        tests = [c >= low] * (low is not None) + [c <= high] * (high is not None)
        return reduce(lambda a, b: a & b, tests)
    out = F.when(c.isNull(), F.lit(missing))
    for low, high, new in rules:
        out = out.when(inside(low, high), F.lit(new))
    return out.otherwise(c)


def cut(c: Column, breaks: Sequence[float]) -> Column:
    """Left-closed, right-open bands named by their left break; null outside."""
    out = None
    for low, high in zip(breaks, breaks[1:], strict=False):
        test = (c >= low) & (c < high)
        out = F.when(test, F.lit(low)) if out is None else out.when(test, F.lit(low))
    return out


def bands(c: Column, ends: Sequence[float], missing_last: bool = True) -> Column:
    """1 up to the first end, 2 up to the second, ...; beyond all ends, and missing, the last band."""
    out = None
    for i, end in enumerate(ends):
        out = F.when(c <= end, i + 1) if out is None else out.when(c <= end, i + 1)
    return out.otherwise(len(ends) + 1) if missing_last else out.when(c.isNotNull(), len(ends) + 1)


def any_of(columns: Sequence[Column], values: Sequence[object]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(c.isin(*values), F.lit(False)) for c in columns])


def lookup(c: Column, names: dict[str, str]) -> Column:
    """A literal dictionary; keys it lacks give null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), c)
