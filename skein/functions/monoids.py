"""Named aggregates for keyed reductions.

Each one is a function ``Column -> Column`` that Catalyst splits into a partial (map-side) and a
final aggregate, so a hot key costs one row per map task in the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Monoid = Callable[[Column], Column]


def _sorted_set(value: Column) -> Column:
    return F.array_sort(F.collect_set(value))


MONOIDS: dict[str, Monoid] = {
    "sum": F.sum,
    "count": lambda value: F.count(F.lit(1)),
    "min": F.min,
    "max": F.max,
    "avg": F.avg,
    "any": F.bool_or,
    "all": F.bool_and,
    "set": _sorted_set,
    "list": lambda value: F.transform(F.collect_list(F.struct(value.alias("v"))), lambda s: s["v"]),
}


def monoid(how: str | Monoid) -> Monoid:
    """The aggregate called ``how``; a callable is taken as it is."""
    if callable(how):
        return how
    if how not in MONOIDS:
        raise ValueError(f"unknown aggregate {how!r}; known: {', '.join(sorted(MONOIDS))}")
    return MONOIDS[how]
