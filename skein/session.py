"""Entry point: makes datasets from rows, ranges and files."""

from __future__ import annotations

import codecs
import math
from collections.abc import Callable, Iterable
from functools import reduce
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.dataset import Dataset
from skein.operators.setops import union
from skein.sources import files
from skein.sources.registry import Connector, Registry


class Context:
    """Wraps a session. ``partitions`` is the default count; else the session's own settings hold."""

    def __init__(self, spark: SparkSession | None = None, partitions: int | None = None, file_connector: bool = True):
        self.spark = spark or SparkSession.builder.getOrCreate()
        self.partitions = partitions
        self.registry = Registry()
        if file_connector:
            self.registry.register(Connector(lambda url: files.local_path(url) is not None, files.all_files, lambda ds, url, options: files.save_text_parts(ds, url, **options)))

    def _n(self, n: int | None) -> int:
        n = self.spark.sparkContext.defaultParallelism if n is None and self.partitions is None else (n if n is not None else self.partitions)
        if n <= 0:
            raise ValueError("the number of partitions must be positive")
        return n

    def parallelize(self, rows: Iterable[Any], schema: str | T.StructType | T.DataType | None = None, partitions: int | None = None) -> Dataset:
        """Local rows, in order and in contiguous slices; scalars become column ``value``."""
        rows = list(rows)
        if not rows and schema is None:
            raise ValueError("an empty dataset needs a schema")
        if isinstance(schema, str) and ":" not in schema and " " not in schema:
            schema = T._parse_datatype_string(schema)
        made = self.spark.createDataFrame([r if isinstance(r, (tuple, dict, T.Row)) else (r,) for r in rows], schema if not isinstance(schema, T.DataType) or isinstance(schema, T.StructType) else T.StructType([T.StructField("value", schema)])) if rows else self.spark.createDataFrame([], schema)
        if schema is None and made.columns == ["_1"]:
            made = made.toDF("value")
        # a local relation's slices are contiguous, so ids by partition follow the order of the rows
        made = made.coalesce(1).withColumn("__ord", F.monotonically_increasing_id())
        n, total = self._n(partitions), max(len(rows), 1)
        small, extra = divmod(total, n)
        cut = extra * (small + 1)
        target = F.when(F.col("__ord") < cut, F.floor(F.col("__ord") / (small + 1))).otherwise(extra + F.floor((F.col("__ord") - cut) / max(small, 1))).cast("int")
        return Dataset(made.repartitionById(n, target), self, ["__ord"])

    def range(self, start: float, end: float | None = None, step: float = 1, partitions: int | None = None) -> Dataset:
        """Half-open sequence in column ``id``; negative and fractional steps work."""
        start, end = (0, start) if end is None else (start, end)
        if step == 0:
            raise ValueError("step must not be 0")
        n = self._n(partitions)
        if all(isinstance(x, int) for x in (start, end, step)):
            df = self.spark.range(start, end, step, n)
            order = "id" if step > 0 else "__ord"
            return Dataset(df if step > 0 else df.withColumn("__ord", -F.col("id")), self, [order])
        count = max(0, math.ceil((end - start) / step))
        base = self.spark.range(0, count, 1, n)
        return Dataset(base.select((F.col("id") * F.lit(float(step)) + F.lit(float(start))).alias("id"), F.col("id").alias("__ord")), self, ["__ord"])

    def empty(self, schema: str | T.StructType) -> Dataset:
        return Dataset(self.spark.createDataFrame([], schema), self, None)

    def union(self, *datasets: Dataset) -> Dataset:
        """Bag union; elements of an earlier input come before those of a later one."""
        if all(d.order for d in datasets):
            framed = [d.df.select(*d.columns, F.struct(F.lit(i).alias("i"), F.struct(*d.order).alias("o")).alias("__ord")) for i, d in enumerate(datasets)]
            if len({f.schema["__ord"].dataType.simpleString() for f in framed}) == 1:
                return Dataset(reduce(lambda a, b: a.unionByName(b), framed), self, ["__ord"])
        return Dataset(union(*[d.to_df() for d in datasets]), self, None)

    def register_connector(self, connector: Connector) -> None:
        self.registry.register(connector)

    def _plain_files(self, url: str) -> bool:
        """Whether ``url`` is read by the built-in readers: the file connector's, or Spark's where no connector accepts it."""
        try:
            return self.registry.find(url).read is files.all_files
        except ValueError:
            return True

    def binary_files(self, url: str, recursive: bool = False) -> Dataset:
        """``path, content`` of every file. Other stores than mounted ones go by Spark's own source."""
        try:
            df = self.registry.find(url).read(self.spark, url, recursive)
        except ValueError:
            df = files.hadoop_files(self.spark, url, recursive)
        return Dataset(df, self, ["path"])

    def whole_text_files(self, url: str, encoding: str = "utf-8", recursive: bool = False, decompressor: Callable[[bytes, str], bytes] | None = None) -> Dataset:
        df = self.binary_files(url, recursive).to_df()
        df = files.decompress(df, decompressor) if decompressor else df
        return Dataset(df.select("path", files.decode(F.col("content"), encoding).alias("text")), self, ["path"])

    def text_file(self, url: str, encoding: str = "utf-8", recursive: bool = False, decompressor: Callable[[bytes, str], bytes] | None = None, strip_cr: bool = False) -> Dataset:
        """``value``: lines in the order of (path, place); a large file is read by many tasks.

        A decompressor, a connector of one's own, or an encoding whose newlines aren't single bytes takes whole files.
        """
        single = {"utf-8": "UTF-8", "ascii": "US-ASCII", "iso8859-1": "ISO-8859-1"}.get(codecs.lookup(encoding).name)
        if decompressor is None and single and self._plain_files(url):
            lines = files.ordered_lines(self.spark, url, recursive, single).withColumnRenamed("place", "__ord")
            lines = lines.withColumn("value", F.regexp_replace("value", "\r$", "")) if strip_cr else lines
            return Dataset(lines, self, ["__ord"])
        texts = self.whole_text_files(url, encoding, recursive, decompressor).to_df()
        lines = files.lines_of(texts, strip_cr).select("value", F.struct("path", "line").alias("__ord"))
        return Dataset(lines, self, ["__ord"])

    def text_lines(self, url: str, recursive: bool = False) -> Dataset:
        """``value``: lines without an order, by Spark's splittable reader."""
        return Dataset(files.text_lines(self.spark, url, recursive), self, None)

    def execute(self, fn: Callable[[Callable], Any]) -> Any:
        """Runs ``fn(dispatch)`` here; ``dispatch(task, args)`` runs ``task`` on executors for each arg."""
        sc = self.spark.sparkContext

        def dispatch(task: Callable[[Any], Any], args: Iterable[Any]) -> list[Any]:
            args = list(args)
            return sc.parallelize(args, max(1, len(args))).map(task).collect() if args else []

        return fn(dispatch)
