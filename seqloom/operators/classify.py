"""Rules that name a result from its aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_of(signals: list[tuple[Column, str]], none: str, mixed: str) -> Column:
    """The label of the one signal that holds, ``mixed`` for several, ``none`` for none."""
    n = sum((F.coalesce(c, F.lit(False)).cast("int") for c, _ in signals), F.lit(0))
    out = F.when(n == 0, none).when(n > 1, mixed)
    for c, label in signals:
        out = out.when(c, label)
    return out


def graded(signals: list[Column], names: list[str]) -> Column:
    """The name for how many signals hold; the last one for more."""
    n = sum((F.coalesce(c, F.lit(False)).cast("int") for c in signals), F.lit(0))
    out = F.when(n == 0, names[0])
    for i, name in enumerate(names[1:-1], 1):
        out = out.when(n == i, name)
    return out.otherwise(names[-1])


def first_of(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """The label of the first rule that holds."""
    out = F.when(F.coalesce(rules[0][0], F.lit(False)), rules[0][1])
    for c, label in rules[1:]:
        out = out.when(F.coalesce(c, F.lit(False)), label)
    return out.otherwise(otherwise)


def outside(value: Column, low: Column, high: Column) -> Column:
    return (value < low) | (value > high)
