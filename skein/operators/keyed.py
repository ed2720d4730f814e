"""Keyed aggregation, grouping and joins. Pair datasets have columns ``k`` and ``v`` by default."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.monoids import Monoid, monoid
from skein.operators import placement


def _grouped(df: DataFrame, key: str, aggregates: list[Column], partitions: int | None, place: Column | None) -> DataFrame:
    """``groupBy(key).agg(...)`` dealt as asked.

    With ``place`` (a partition number from the key's columns) rows go straight to their partition and are
    reduced there: one exchange, and the result stays where it was placed. With ``partitions`` alone,
    values combine before the shuffle and the rows per key are dealt by key.
    """
    if place is not None:
        placed = placement.by_hash_of(df, partitions or placement.default_partitions(df), place)
        return placed.groupBy(placement.PLACE, key).agg(*aggregates).drop(placement.PLACE)
    out = df.groupBy(key).agg(*aggregates)
    return out.repartition(placement.positive(partitions), key) if partitions is not None else out


def reduce_by_key(df: DataFrame, how: str | Monoid, key: str = "k", value: str = "v", partitions: int | None = None, place: Column | None = None) -> DataFrame:
    """One row per key with the reduced value; null is a key like any other."""
    return _grouped(df, key, [monoid(how)(F.col(value)).alias(value)], partitions, place)


def combine_by_key(df: DataFrame, combiners: dict[str, str | Monoid | Column], key: str = "k", value: str = "v", finish: dict[str, Column] | None = None, partitions: int | None = None, place: Column | None = None) -> DataFrame:
    """Several combiners over one shuffle; ``finish`` derives the output columns from them."""
    made = [(c if isinstance(c, Column) else monoid(c)(F.col(value))).alias(name) for name, c in combiners.items()]
    out = _grouped(df, key, made, partitions, place)
    return out if finish is None else out.select(key, *[c.alias(name) for name, c in finish.items()])


def fold_by_key(df: DataFrame, zero: Column, merge: Callable[[Column, Column], Column], order: list[str], key: str = "k", value: str = "v", finish: Callable[[Column], Column] | None = None) -> DataFrame:
    """Left fold of each key's values in the order of ``order``, for folds that aren't monoids.

    Runs in the JVM over a sorted list, so one key's values have to fit in a task's memory.
    """
    rows = F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("__v"))))
    step = lambda acc, row: merge(acc, row["__v"])
    listed = df.groupBy(key).agg(rows.alias("__rows"))
    folded = F.aggregate("__rows", zero, step, finish) if finish else F.aggregate("__rows", zero, step)
    return listed.select(key, folded.alias(value))


def combine_by_key_python(df: DataFrame, create: Callable[[Any], Any], merge_value: Callable[[Any, Any], Any], merge_combiners: Callable[[Any, Any], Any], value_type: T.DataType, key: str = "k", value: str = "v", partitions: int | None = None) -> DataFrame:
    """The three-function form with Python callables; opt-in slow path.

    Values combine inside each map partition first, so only one pickled combiner per key and
    partition is shuffled, and a key's combiners merge pairwise as they stream in.
    """
    key_type = df.schema[key].dataType
    part_schema = T.StructType([T.StructField("k", key_type), T.StructField("c", T.BinaryType())])
    out_schema = T.StructType([T.StructField(key, key_type), T.StructField(value, value_type)])

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            for k, v in zip(batch["k"].astype(object).where(batch["k"].notna(), None), batch["v"].astype(object).where(batch["v"].notna(), None), strict=True):
                held[k] = merge_value(held[k], v) if k in held else create(v)
        yield pd.DataFrame({"k": pd.Series(list(held), dtype=object), "c": pd.Series([pickle.dumps(c) for c in held.values()], dtype=object)})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            for k, c in zip(batch["k"].astype(object).where(batch["k"].notna(), None), batch["c"], strict=True):
                c = pickle.loads(c)
                held[k] = merge_combiners(held[k], c) if k in held else c
        yield pd.DataFrame({key: pd.Series(list(held), dtype=object), value: pd.Series(list(held.values()), dtype=object)})

    parts = df.select(F.col(key).alias("k"), F.col(value).alias("v")).mapInPandas(local, part_schema)
    dealt = parts.repartition(partitions, "k") if partitions else parts.repartition("k")
    return dealt.mapInPandas(merge, out_schema)


def distinct(df: DataFrame, columns: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """Each different row once (nulls, 0, '' and false are values like any other); ``partitions`` deals the result by row."""
    out = df.dropDuplicates(columns) if columns else df.distinct()
    return out.repartition(placement.positive(partitions), *(columns or out.columns)) if partitions is not None else out


def cogroup(frames: list[DataFrame], key: str = "k", value: str = "v", names: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """A row per key of any input, with one array of values per input (``[]`` where it has none).

    One exchange for all inputs: tagged rows are united and collected by key. Null values stay,
    since each is wrapped in a struct while it is collected. A key's values make up one row, which
    is what the operator means; use the joins below where a key can be very large.
    """
    names = names or [f"v{i}" for i in range(len(frames))]
    tagged = [f.select(F.col(key), F.lit(i).alias("__side"), *[(F.struct(F.col(value).alias("v")) if i == j else F.lit(None)).alias(f"__v{j}") for j in range(len(frames))]) for i, f in enumerate(frames)]
    typed = [f.select(key, "__side", *[F.col(f"__v{j}").cast(T.StructType([T.StructField("v", frames[j].schema[value].dataType)])).alias(f"__v{j}") for j in range(len(frames))]) for f in tagged]
    united = reduce(DataFrame.unionByName, typed)
    if partitions is not None:  # lists don't get smaller by combining first, so the one exchange is this
        united = united.repartition(placement.positive(partitions), key)
    lists = [F.transform(F.collect_list(f"__v{j}"), lambda s: s["v"]).alias(name) for j, name in enumerate(names)]
    return united.groupBy(key).agg(*lists)


group_with = cogroup


def join(left: DataFrame, right: DataFrame, how: str = "inner", key: str = "k", left_value: str = "v", right_value: str = "v", names: tuple[str, str] = ("v", "v1"), nullable: bool = True, partitions: int | None = None) -> DataFrame:
    """``inner``, ``left``, ``right`` or ``full`` join on a null-safe key; an unmatched side is null.

    ``nullable=False`` says that no key is null and lets Spark use a plain equality. ``partitions`` deals
    both sides over so many partitions by the very expressions that the join compares.
    """
    if how not in ("inner", "left", "right", "full"):
        raise ValueError(f"how must be inner, left, right or full, not {how!r}")
    a = left.select(F.col(key).alias("__ka"), F.col(left_value).alias("__l"))
    b = right.select(F.col(key).alias("__kb"), F.col(right_value).alias("__r"))
    if partitions is not None:
        a, b = (placement.by_key(d, placement.positive(partitions), c, nullable) for d, c in ((a, "__ka"), (b, "__kb")))
    x, y = F.col("__ka"), F.col("__kb")
    k = {"inner": x, "left": x, "right": y, "full": F.coalesce(x, y)}[how]
    return a.join(b, x.eqNullSafe(y) if nullable else x == y, how).select(k.alias(key), F.col("__l").alias(names[0]), F.col("__r").alias(names[1]))
