"""Expressions over arrays that Catalyst has no function for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once for a row, as the only element of an array; an expression that a lambda mentions is computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sums_to_end(numbers: Column) -> Column:
    """For each place of an array the sum from there to its end, in n log n steps: each round takes in what stands 1, 2, 4, ... places after."""
    far = F.filter(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.pow(F.lit(2), k).cast("int")), lambda d: d < F.size(numbers))
    return bound(numbers, lambda a: F.aggregate(far, a, lambda sums, d: F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i + d), F.lit(0)))))
