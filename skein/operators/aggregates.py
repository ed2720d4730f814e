"""Whole-dataset aggregates. The frame forms give one row; empty input gives null (count: 0)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from skein.functions.monoids import Monoid, monoid


def reduce_frame(df: DataFrame, how: str | Monoid, value: Column | str, name: str = "v") -> DataFrame:
    return df.agg(monoid(how)(F.col(value) if isinstance(value, str) else value).alias(name))


def fold_frame(df: DataFrame, zero: Column, merge: Callable[[Column, Column], Column], value: str, order: list[str], name: str = "v") -> DataFrame:
    """Ordered left fold of a whole (small) dataset in one task; for folds that aren't monoids."""
    rows = F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("__v"))))
    return df.agg(F.aggregate(rows, zero, lambda acc, row: merge(acc, row["__v"])).alias(name))


def reduce_partials(df: DataFrame, fn: Callable[[Any, Any], Any], value: str) -> Any:
    """Any Python function of two values: a left fold per partition, then one over the partials in the order of partitions.

    A task holds one value, the driver one partial per partition. Rows are folded in the order of ``df``. No
    rows give None.
    """
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc, some = None, False
        for b in batches:
            for v in b.column(0).to_pylist():
                acc, some = (fn(acc, v), True) if some else (v, True)
        if some:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([cloudpickle.dumps(acc)], pa.binary())], names=["pid", "part"])

    parts = sorted((r["pid"], r["part"]) for r in df.select(value).mapInArrow(fold, "pid int, part binary").collect())
    return reduce(fn, [cloudpickle.loads(p) for _, p in parts]) if parts else None


def max_by(df: DataFrame, key: Column, order: list[str] = (), largest: bool = True) -> DataFrame:
    """The row with the largest (or smallest) ``key``; of ties the last in ``order``."""
    rank = F.struct(key.alias("__k"), *[F.col(c) for c in order])
    if largest:
        return df.agg(F.max_by(F.struct("*"), rank).alias("r")).where("r is not null").select("r.*")
    best = df.agg(F.min(key).alias("__best"))
    ties = df.join(F.broadcast(best), key == F.col("__best")).drop("__best")
    rank = F.struct(*[F.col(c) for c in order]) if order else F.lit(0)
    return ties.agg(F.max_by(F.struct(*df.columns), rank).alias("r")).where("r is not null").select("r.*")


def count_frame(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def collect(df: DataFrame) -> list[Row]:
    return df.collect()
