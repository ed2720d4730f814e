"""Which row goes to which partition."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators.ordering import with_position


#: the column that holds a row's chosen partition, as a number whose hash leads there
PLACE = "__place"


def positive(n: int) -> int:
    if n <= 0:
        raise ValueError("the number of partitions must be positive")
    return n


def partition_by(df: DataFrame, n: int, target: Column, strict: bool = False) -> DataFrame:
    """Row goes to partition ``target``; ids outside 0..n-1 fail if ``strict``, else wrap around."""
    target = target.cast("int")
    if strict:
        inside = target.isNotNull() & (target >= 0) & (target < n)
        target = F.when(inside, target).otherwise(F.raise_error(F.lit(f"a row's partition isn't in 0..{n - 1}")).cast("int"))
    return df.repartitionById(positive(n), target)


def default_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def by_hash_of(df: DataFrame, n: int, target: Column) -> DataFrame:
    """Row goes to partition ``target`` modulo ``n``, by hash partitioning of the added column ``PLACE``.

    Spark knows hash partitioning, so a grouping by ``PLACE`` and further columns needs no exchange of
    its own. ``PLACE`` holds, for each partition, the first number whose hash modulo ``n`` is that partition.
    """
    numbers = df.sparkSession.range(0, positive(n) * 64).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p"))
    found = dict(numbers.groupBy("p").agg(F.min("id")).collect())  # a row per partition
    while len(found) < n:  # by chance a partition has none among the first ones
        more = df.sparkSession.range(n * 64, n * 4096).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p"))
        found |= {p: i for p, i in more.groupBy("p").agg(F.min("id")).collect() if p not in found}
    places = F.array(*[F.lit(found[p]).cast("long") for p in range(n)])
    return df.withColumn(PLACE, F.get(places, F.pmod(target.cast("long"), F.lit(n)).cast("int"))).repartition(n, PLACE)


def by_key(df: DataFrame, n: int, key: str, nullable: bool) -> DataFrame:
    """Dealt by ``key`` as a join on it wants it, so that the join adds no exchange.

    A null-safe join compares the key, with the type's zero in place of null, and whether it is null.
    """
    kind = df.schema[key].dataType
    if not nullable or not isinstance(kind, (T.NumericType, T.StringType)):
        return df.repartition(n, key)
    zero = F.lit("") if isinstance(kind, T.StringType) else F.lit(0).cast(kind)
    return df.repartition(n, F.coalesce(F.col(key), zero), F.col(key).isNull())


def repartition(df: DataFrame, n: int) -> DataFrame:
    """Even spread over ``n`` partitions, without a key."""
    return df.repartition(positive(n))


def coalesce(df: DataFrame, n: int, order: list[str], position: str | None = None) -> DataFrame:
    """Contiguous, order-keeping split into ``n`` parts whose sizes differ by one at most.

    ``n`` may be larger than now. ``position`` names a column that already holds 0..count-1, which
    saves the pass that ranks the rows.
    """
    positive(n)
    columns = df.columns
    if position is None:
        position, total = "__pos", F.col("__total")
        df = with_position(df, [F.col(c) for c in order], position, total="__total")
        if df.isEmpty():
            return df.select(columns).repartition(n)
    else:
        total = F.lit(df.count())
    target = F.call_function("div", F.col(position).cast("decimal(20,0)") * F.lit(n), total.cast("decimal(20,0)")).cast("int")
    return df.repartitionById(n, target).sortWithinPartitions(position).select(columns)


def cache(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> DataFrame:
    """Computes once and keeps; ``unpersist()`` on the result frees it."""
    return df.persist(level)


def num_partitions(df: DataFrame) -> int:
    return df.rdd.getNumPartitions()
