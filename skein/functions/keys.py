"""Key helpers. Keys compare null-safely: null equals null, NaN equals NaN, 0.0 equals -0.0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame


def same_key(left: DataFrame, right: DataFrame, keys: list[str], nullable: bool = True) -> Column:
    """Join condition on ``keys``; ``nullable=False`` gives a plain equality, which is cheaper."""
    def one(key: str) -> Column:
        return left[key].eqNullSafe(right[key]) if nullable else left[key] == right[key]

    return reduce(lambda a, b: a & b, map(one, keys))
