"""Bag union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union(*frames: DataFrame) -> DataFrame:
    """All rows of all inputs, duplicates included; columns match by name."""
    if not frames:
        raise ValueError("union needs an input at least")
    return reduce(DataFrame.unionByName, frames)
