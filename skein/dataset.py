"""Fluent, immutable form of the operators: a DataFrame plus the columns that give its order.

``order`` names the columns whose ascending order is the elements' order, or is None. Columns whose
names start with ``__`` carry that order and aren't part of the data.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.monoids import Monoid
from skein.operators import aggregates, keyed, narrow, ordering, placement
from skein.sources import files

if TYPE_CHECKING:
    from skein.session import Context


class Dataset:
    def __init__(self, df: DataFrame, ctx: Context, order: list[str] | None = None):
        self.df, self.ctx, self.order = df, ctx, order

    # -- data and order
    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith("__")]

    def to_df(self) -> DataFrame:
        """The data without order columns."""
        return self.df.select(self.columns)

    def with_order(self, *columns: str) -> Dataset:
        return Dataset(self.df, self.ctx, list(columns))

    def _hidden(self) -> list[str]:
        return [c for c in self.order or [] if c.startswith("__")]

    def _by(self) -> list[Column]:
        if not self.order:
            raise ValueError("this operator needs an order: use with_order() or sort_by() first")
        return [F.col(c).asc() for c in self.order]

    def _new(self, df: DataFrame, order: list[str] | None = None) -> Dataset:
        return Dataset(df, self.ctx, order)

    def transform(self, fn: Callable[[DataFrame], DataFrame]) -> Dataset:
        """Any DataFrame function as an operator."""
        return self._new(fn(self.to_df()))

    # -- narrow
    def map(self, **columns: Column) -> Dataset:
        kept = [F.col(c) for c in self._hidden()]
        visible = [c for c in self.order or [] if not c.startswith("__")]
        extra = [F.col(c).alias(f"__o_{c}") for c in visible]
        order = [c if c.startswith("__") else f"__o_{c}" for c in self.order] if self.order else None
        return self._new(self.df.select(*[c.alias(n) for n, c in columns.items()], *kept, *extra), order)

    def flat_map(self, items: Column, name: str = "value") -> Dataset:
        if not self.order:
            return self._new(narrow.flat_map(self.df, items, name))
        exploded = self.df.select(F.struct(*self.order).alias("__o"), F.posexplode(items).alias("__p", name))
        return self._new(exploded.select(name, F.struct("__o", "__p").alias("__ord")), ["__ord"])

    def filter(self, predicate: Column) -> Dataset:
        return self._new(narrow.filter_rows(self.df, predicate), self.order)

    def map_partitions(self, fn: narrow.PartitionFn, schema: str | T.StructType) -> Dataset:
        return self._new(narrow.map_partitions(self.to_df(), fn, schema))

    def glom(self) -> Dataset:
        return self._new(narrow.glom(self.df, self.order or []), ["pid"])

    # -- keyed (columns k and v)
    def key_by(self, key: Column, value: Column) -> Dataset:
        return self.map(k=key, v=value)

    def reduce_by_key(self, how: str | Monoid, partitions: int | None = None, place: Column | None = None) -> Dataset:
        """``place``: the partition that a key's row goes to, a number from the columns k."""
        return self._new(keyed.reduce_by_key(self.df, how, partitions=partitions, place=place))

    def combine_by_key(self, combiners: dict[str, str | Monoid | Column], finish: dict[str, Column] | None = None, partitions: int | None = None, place: Column | None = None) -> Dataset:
        return self._new(keyed.combine_by_key(self.df, combiners, finish=finish, partitions=partitions, place=place))

    def fold_by_key(self, zero: Column, merge: Callable[[Column, Column], Column], finish: Callable[[Column], Column] | None = None) -> Dataset:
        self._by()
        return self._new(keyed.fold_by_key(self.df, zero, merge, self.order, finish=finish))

    def combine_by_key_python(self, create: Callable, merge_value: Callable, merge_combiners: Callable, value_type: T.DataType, partitions: int | None = None) -> Dataset:
        return self._new(keyed.combine_by_key_python(self.df, create, merge_value, merge_combiners, value_type, partitions=partitions))

    def group_with(self, *others: Dataset, partitions: int | None = None) -> Dataset:
        return self._new(keyed.cogroup([self.df, *[o.df for o in others]], partitions=partitions))

    def cogroup(self, other: Dataset, partitions: int | None = None) -> Dataset:
        return self.group_with(other, partitions=partitions)

    def join(self, other: Dataset, nullable: bool = True, partitions: int | None = None) -> Dataset:
        return self._new(keyed.join(self.df, other.df, "inner", nullable=nullable, partitions=partitions))

    def left_outer_join(self, other: Dataset, nullable: bool = True, partitions: int | None = None) -> Dataset:
        return self._new(keyed.join(self.df, other.df, "left", nullable=nullable, partitions=partitions))

    def right_outer_join(self, other: Dataset, nullable: bool = True, partitions: int | None = None) -> Dataset:
        return self._new(keyed.join(self.df, other.df, "right", nullable=nullable, partitions=partitions))

    def full_outer_join(self, other: Dataset, nullable: bool = True, partitions: int | None = None) -> Dataset:
        return self._new(keyed.join(self.df, other.df, "full", nullable=nullable, partitions=partitions))

    def distinct(self, partitions: int | None = None) -> Dataset:
        return self._new(keyed.distinct(self.to_df(), partitions=partitions))

    def union(self, *others: Dataset) -> Dataset:
        return self.ctx.union(self, *others)

    # -- placement
    def partition_by(self, n: int, target: Column, strict: bool = False) -> Dataset:
        return self._new(placement.partition_by(self.df, n, target, strict), self.order)

    def repartition(self, n: int) -> Dataset:
        return self._new(placement.repartition(self.df, n), self.order)

    def coalesce(self, n: int) -> Dataset:
        self._by()
        return self._new(placement.coalesce(self.df, n, self.order), self.order)

    def cache(self) -> Dataset:
        return self._new(placement.cache(self.df), self.order)

    persist = cache

    def unpersist(self) -> Dataset:
        self.df.unpersist()
        return self

    def num_partitions(self) -> int:
        return placement.num_partitions(self.df)

    # -- order
    def sort_by(self, key: Column, ascending: bool = True, partitions: int | None = None) -> Dataset:
        """Stable; the result keeps (key, old order) as its order."""
        by = [key.asc_nulls_first() if ascending else key.desc_nulls_last(), *([F.col(c).asc() for c in self.order or []])]
        df = ordering.with_position(self.df, by, "__pos", partitions)
        return self._new(df.drop(*self._hidden()) if self._hidden() else df, ["__pos"])

    def sort(self, ascending: bool = True, partitions: int | None = None) -> Dataset:
        first = F.col(self.columns[0]) if len(self.columns) == 1 else F.struct(*self.columns)
        return self.sort_by(first, ascending, partitions)

    def take(self, n: int) -> list[Row]:
        return ordering.take(self.df, n, self._by() if self.order else []).select(self.columns).collect()

    # -- actions
    def reduce(self, how: str | Monoid, column: str | None = None) -> Any:
        return aggregates.reduce_frame(self.df, how, column or self.columns[0]).first()[0]

    def fold(self, zero: Column, merge: Callable[[Column, Column], Column], column: str | None = None) -> Any:
        self._by()
        return aggregates.fold_frame(self.df, zero, merge, column or self.columns[0], self.order).first()[0]

    def reduce_with(self, fn: Callable[[Any, Any], Any], column: str | None = None) -> Any:
        """Any Python function of two values, folded per partition and then over the partials; None if empty."""
        df = self.df.orderBy(*self._by()) if self.order else self.df
        return aggregates.reduce_partials(df, fn, column or self.columns[0])

    def max(self, key: Column | None = None, compare: Callable[[Any, Any], float] | None = None) -> Any:
        """By a key, or by a Python comparison of two values of the first column: above 0 if the first is larger."""
        return self.reduce_with(lambda a, b: b if compare(b, a) >= 0 else a) if compare else self._extreme(key, True)

    def min(self, key: Column | None = None, compare: Callable[[Any, Any], float] | None = None) -> Any:
        return self.reduce_with(lambda a, b: b if compare(b, a) <= 0 else a) if compare else self._extreme(key, False)

    def _extreme(self, key: Column | None, largest: bool) -> Any:
        if key is None:
            return self.reduce("max" if largest else "min")
        rows = aggregates.max_by(self.df, key, self.order or [], largest).select(self.columns).collect()
        return rows[0] if rows else None

    def count(self) -> int:
        return self.df.count()

    def collect(self) -> list[Row]:
        df = self.df.orderBy(*self._by()) if self.order else self.df
        return df.select(self.columns).collect()

    # -- sinks
    def save_as_text(self, url: str, overwrite: bool = True, compression: str | None = None) -> None:
        files.save_text(self.df, url, overwrite, compression, self.columns[0])

    def save_as_text_parts(self, url: str, overwrite: bool = True, **options: Any) -> None:
        files.save_text_parts(self.df, url, overwrite, column=self.columns[0], **options)
