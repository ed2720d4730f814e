"""Element order: dense positions, stable sorts, take, top-k."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sort_by(df: DataFrame, key: Column | str, ascending: bool = True, order: list[str] = ()) -> DataFrame:
    """Stable distributed sort: ties keep the order of ``order`` in either direction.

    ``order`` also lets the range partitioning split a heavy key over several tasks.
    """
    key = F.col(key) if isinstance(key, str) else key
    return df.orderBy(key.asc_nulls_first() if ascending else key.desc_nulls_last(), *[F.col(c).asc() for c in order])


def with_position(df: DataFrame, by: list[Column], name: str = "pos", partitions: int | None = None, total: str | None = None) -> DataFrame:
    """Adds each row's dense 0-based rank in the order of ``by`` without a one-task window.

    Rows are range-partitioned and sorted; every partition is counted; a row's position is the
    rows of the partitions before it plus its place in its own. Only one count per partition leaves
    the executors. The sorted rows are persisted, since both passes must see the same partitions;
    ``spark.catalog.clearCache()`` frees them. ``total`` names a column for the number of rows.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = df.repartitionByRange(n, *by).sortWithinPartitions(*by).select("*", F.spark_partition_id().alias("__pid"), F.monotonically_increasing_id().alias("__mid")).persist(StorageLevel.MEMORY_AND_DISK)
    counts = held.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = counts.select("__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"), F.sum("__n").over(whole).alias("__all"))  # a row per partition
    place = F.col("__mid") - F.shiftleft(F.col("__pid").cast("long"), 33)
    return held.join(F.broadcast(starts), "__pid").select(*df.columns, (F.col("__start") + place).alias(name), *([F.col("__all").alias(total)] if total else []))


def with_block_position(df: DataFrame, place: str = "__ord", name: str = "pos") -> DataFrame:
    """``with_position`` of rows that carry their place as ``files.ordered_lines`` makes it, without a shuffle or sort of the rows.

    Blocks are counted; a row's position is the rows of the blocks before it plus its place in its own.
    All rows of every block must be there. They are persisted, since both passes must see the same blocks.
    """
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    path, at, row = (F.col(f"{place}.{c}") for c in ("path", "at", "row"))
    counts = held.groupBy(path.alias("__path"), at.alias("__at")).agg(F.count(F.lit(1)).alias("__n"), F.min(row).alias("__low"))
    before = Window.orderBy("__path", "__at").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__path", "__at", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__low")).alias("__start"))  # a row per block
    return held.join(F.broadcast(starts), (path == F.col("__path")) & (at == F.col("__at"))).select(*df.columns, (F.col("__start") + row).alias(name))


def take(df: DataFrame, n: int, by: list[Column] = ()) -> DataFrame:
    """The first ``n`` rows in the order of ``by`` (any ``n`` without it)."""
    if n < 0:
        raise ValueError("n must not be negative")
    return df.orderBy(*by).limit(n) if by else df.limit(n)


def top(df: DataFrame, n: int, key: str, ascending: bool = False, order: list[str] = ()) -> DataFrame:
    """``sort_by`` and ``take`` in one: each task keeps its best ``n`` rows only."""
    return sort_by(df, key, ascending, order).limit(n)
