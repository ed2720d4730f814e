"""Row-wise and partition-wise transforms. None of them shuffles, except ``glom``'s final gather."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PartitionFn = Callable[[Iterator[pa.RecordBatch], int], Iterator[pa.RecordBatch]]


def map_rows(df: DataFrame, **columns: Column) -> DataFrame:
    """One output row per input row, with just the given columns."""
    return df.select([c.alias(name) for name, c in columns.items()])


def flat_map(df: DataFrame, items: Column, name: str = "v", position: str | None = None, keep: list[str] = ()) -> DataFrame:
    """A row for each element of the array ``items``; null and empty arrays give no row."""
    item = F.posexplode(items).alias(position, name) if position else F.explode(items).alias(name)
    return df.select(*keep, item)


def filter_rows(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which ``predicate`` is true; null counts as false."""
    return df.filter(predicate)


def map_partitions(df: DataFrame, fn: PartitionFn, schema: str | T.StructType) -> DataFrame:
    """``fn(batches, partition_id)`` for every partition, empty ones too (Arrow batches in and out)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(batches, TaskContext.get().partitionId())

    return df.mapInArrow(run, schema)


def glom(df: DataFrame, order: list[str] = (), name: str = "rows") -> DataFrame:
    """One row per partition (``pid``, array of its rows); an empty partition gives ``[]``.

    Ordered by ``order`` inside a partition where given. A partition has to fit in memory, which is
    what the operator means.
    """
    n = df.rdd.getNumPartitions()
    row = F.struct(*[F.col(c) for c in [*order, *[c for c in df.columns if c not in order]]])
    lists = df.select(F.spark_partition_id().alias("pid"), row.alias("r")).groupBy("pid").agg(F.sort_array(F.collect_list("r")).alias(name))
    ids = df.sparkSession.range(n).select(F.col("id").cast("int").alias("pid"))
    empty = F.array().cast(lists.schema[name].dataType)
    return ids.join(lists, "pid", "left").select("pid", F.coalesce(name, empty).alias(name))
