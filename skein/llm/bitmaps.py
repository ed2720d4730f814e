"""A filter of fixed size in front of a shuffle: bitmaps over hashes, made and asked with built-in functions.

A filter has ``1 << BITS`` bits (4 MB) whatever the data, so broadcasting it is safe; a value that was put
in is never missed. Values that weren't pass by chance, the more the fuller it is: they only cost shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, ROW_BITS = 25, 15  # a row of the filter is a bitmap of 32,768 bits


def _bit(value: Column) -> Column:
    return F.xxhash64(value).bitwiseAND(F.lit((1 << BITS) - 1).cast("long"))


def filter_of(df: DataFrame, column: str) -> DataFrame:
    """``__at, __bits``: ``1 << (BITS - ROW_BITS)`` rows at most."""
    bit = df.select(_bit(F.col(column)).alias("bit"))
    return bit.groupBy(F.shiftright("bit", ROW_BITS).alias("__at")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit((1 << ROW_BITS) - 1).cast("long"))).alias("__bits"))


def split(df: DataFrame, column: str, by: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``column`` may be in the filter ``by``, and rows whose ``column`` isn't."""
    bit = _bit(F.col(column))
    place = bit.bitwiseAND(F.lit((1 << ROW_BITS) - 1).cast("long")).cast("int")
    met = df.withColumn("__bit", place).join(F.broadcast(by), F.shiftright(bit, ROW_BITS) == F.col("__at"), "left")
    byte = F.conv(F.hex(F.expr("substring(__bits, shiftright(__bit, 3) + 1, 1)")), 16, 10).cast("int")
    inside = F.coalesce(F.expr("shiftright(__byte, __bit & 7) & 1 = 1"), F.lit(False))
    asked = met.withColumn("__byte", byte)
    return asked.filter(inside).select(df.columns), asked.filter(~inside).select(df.columns)


def without(df: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``column``, never null, isn't in the only column of ``gone``; just those that may be in it are shuffled."""
    gone = gone.toDF("__gone")
    asked, clear = split(df, column, filter_of(gone, "__gone"))
    return asked.join(gone, F.col(column) == F.col("__gone"), "left_anti").unionByName(clear)
