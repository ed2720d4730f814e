"""Queries over the driver's tables and their oracle SQL, side by side.

Money is summed in whole cents, so that sums don't depend on the order of the rows.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.keys import same_key
from skein.operators import aggregates, keyed, narrow, ordering, placement, setops
from skein.session import Context
from skein.sources import files
from skein.sources.registry import Connector

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(column: str):
    return F.round(F.col(column) * 100).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder under the one the cluster shares; a local one only where none is set and Spark is local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "skein")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


# -- flagship


@query("""
SELECT n_name, CAST(SUM(CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT)) AS BIGINT) AS revenue_cents
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE l_returnflag = 'R' GROUP BY n_name ORDER BY revenue_cents DESC, n_name LIMIT 10""")
def flagship_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue of returned items by nation, the best ten."""
    line = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("long").alias("v"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = line.join(orders, line.l_orderkey == orders.o_orderkey).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    by_nation = keyed.reduce_by_key(rows, "sum", "n_name", "v").withColumnRenamed("v", "revenue_cents")
    return ordering.top(by_nation, 10, "revenue_cents", order=["n_name"])


# -- sources


@query("SELECT range AS id FROM range(0, 1000)")
def src_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Context(spark).range(1000).to_df()


@query("SELECT 100 - 7 * range AS id FROM range(0, 15)")
def src_range_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Context(spark).range(100, 0, -7).to_df()


@query("SELECT CAST(range AS DOUBLE) * 0.25 AS id FROM range(0, 40)")
def src_range_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Context(spark).range(0, 10, 0.25).to_df()


@query("SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL), (3, NULL), (NULL, 'e')) t(k, v)")
def src_parallelize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Context(spark).parallelize([(1, "a"), (2, "b"), (3, None), (3, None), (None, "e")], "k int, v string").to_df()


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM region")
def src_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = Context(spark)
    some = table(spark, sf_dir, "region").select("r_name")
    return aggregates.count_frame(setops.union(ctx.empty("r_name string").to_df(), some))


@query("""
WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL),
q AS (SELECT doc_id, CASE WHEN a[len(a)] = '' THEN a[1:len(a) - 1] ELSE a END AS a FROM p)
SELECT doc_id, CAST(unnest(range(0, len(a))) AS INTEGER) AS line, unnest(a) AS value FROM q""")
def src_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    return files.lines_of(texts).withColumnRenamed("path", "doc_id")


def _saved(ctx: Context, df: DataFrame, column: str, **options) -> str:
    """Rows of ``column`` as text files in a fresh shared folder: exact parts where it is mounted, Spark's otherwise."""
    out, rows = shared_folder(ctx.spark), ctx.empty("value string").transform(lambda _: df.select(F.col(column).cast("string").alias("value")))
    if files.local_path(out) is None:
        rows.save_as_text(out)
    else:
        rows.save_as_text_parts(out, **options)
    return out


@query("SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS pos, CAST(o_orderkey AS VARCHAR) AS value FROM orders")
def src_text_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys in order as text, a part per task, read back in order of parts and lines."""
    ctx = Context(spark)
    out = _saved(ctx, table(spark, sf_dir, "orders").orderBy("o_orderkey"), "o_orderkey", in_order=True)
    return ordering.with_block_position(ctx.text_file(out).df).select("pos", "value")


@query("SELECT r_name AS value, CAST(1 AS BIGINT) AS n FROM region")
def src_whole_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per row is written, read back whole and counted by content."""
    ctx = Context(spark)
    out = _saved(ctx, table(spark, sf_dir, "region").select("r_name", "r_regionkey").repartitionById(5, F.col("r_regionkey").cast("int")), "r_name")
    texts = ctx.whole_text_files(out).to_df().where("text <> ''")
    return texts.select(F.explode(F.split(F.regexp_replace("text", "\n$", ""), "\n")).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(SUM(strlen(n_name)) AS BIGINT) AS bytes FROM nation")
def src_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of nations as files; names and the bytes of all files but newlines are counted."""
    ctx = Context(spark)
    out = _saved(ctx, table(spark, sf_dir, "nation"), "n_name")
    found = ctx.binary_files(out).to_df().where("octet_length(content) > 0")
    words = found.select(F.octet_length("content").alias("b"), F.filter(F.split(F.decode("content", "utf-8"), "\n"), lambda w: w != "").alias("w"), (F.length(F.decode("content", "utf-8")) - F.length(F.replace(F.decode("content", "utf-8"), F.lit("\n"), F.lit("")))).alias("ends"))
    return words.agg(F.sum(F.size("w")).cast("long").alias("n"), F.sum(F.col("b") - F.col("ends")).cast("long").alias("bytes"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(SUM(o_orderkey) AS BIGINT) AS total, CAST(MIN(o_orderkey) AS BIGINT) AS low, CAST(MAX(o_orderkey) AS BIGINT) AS high FROM orders")
def sink_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys as gzip text and back."""
    out = shared_folder(spark)
    files.save_text(table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("value")), out, compression="gzip")
    v = F.col("value").cast("long")
    return files.text_lines(spark, out, True).agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"), F.min(v).alias("low"), F.max(v).alias("high"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(SUM(p_partkey) AS BIGINT) AS total FROM part")
def sink_text_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys as exact part files and back."""
    ctx = Context(spark)
    v = F.col("value").cast("long")
    return ctx.text_file(_saved(ctx, table(spark, sf_dir, "part"), "p_partkey")).df.agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"))


@query("SELECT 'nation' AS path, n_name AS value FROM nation UNION ALL SELECT 'region', r_name FROM region")
def src_connector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A connector of one's own serves its URLs: here ``table:<name>``, a table's names as one text."""
    def read(session: SparkSession, url: str, recursive: bool) -> DataFrame:
        name = url.removeprefix("table:")
        text = F.array_join(F.sort_array(F.collect_list(f"{name[0]}_name")), "\n")
        return table(session, sf_dir, name).agg(text.cast("binary").alias("content")).select(F.lit(url).alias("path"), "content")

    ctx = Context(spark, file_connector=False)
    ctx.register_connector(Connector(lambda url: url.startswith("table:"), read))
    lines = [ctx.text_file(f"table:{n}").df.select(F.lit(n).alias("path"), "value") for n in ("nation", "region")]
    return setops.union(*lines)


# -- narrow


@query("SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem")
def map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narrow.map_rows(table(spark, sf_dir, "lineitem"), l_orderkey=F.col("l_orderkey"), l_linenumber=F.col("l_linenumber"), cents=cents("l_extendedprice"))


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def flat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narrow.flat_map(table(spark, sf_dir, "part"), F.split("p_name", " "), "word", keep=["p_partkey"])


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000")
def filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narrow.filter_rows(table(spark, sf_dir, "orders"), (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 1000)).select("o_orderkey", "o_orderpriority")


@query("SELECT CAST(o_orderkey % 7 AS INTEGER) AS pid, CAST(count(*) AS BIGINT) AS n, CAST(SUM(o_custkey) AS BIGINT) AS total FROM orders GROUP BY 1")
def map_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per partition, from Arrow batches."""
    dealt = placement.partition_by(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 7, F.col("o_orderkey") % 7)

    def totals(batches, pid):
        n = total = 0
        for b in batches:
            n, total = n + b.num_rows, total + (pc.sum(b["o_custkey"]).as_py() or 0)
        yield pa.record_batch([pa.array([pid], pa.int32()), pa.array([n], pa.int64()), pa.array([total], pa.int64())], names=["pid", "n", "total"])

    return narrow.map_partitions(dealt, totals, "pid int, n long, total long")


@query("SELECT CAST(p_partkey % 6 AS INTEGER) AS pid, CAST(count(*) AS BIGINT) AS n, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS keys FROM part GROUP BY 1")
def glom(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = placement.partition_by(table(spark, sf_dir, "part").select("p_partkey"), 6, F.col("p_partkey") % 6)
    rows = narrow.glom(dealt, ["p_partkey"])
    return rows.select("pid", F.size("rows").cast("long").alias("n"), F.array_join(F.transform("rows", lambda r: r["p_partkey"].cast("string")), ",").alias("keys"))


# -- keyed aggregation


@query("SELECT c_nationkey, CAST(SUM(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS n, CAST(SUM(CAST(round(c_acctbal * 100) AS BIGINT)) AS DOUBLE) / count(*) AS mean FROM customer GROUP BY c_nationkey")
def combine_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_nationkey", cents("c_acctbal").alias("v"))
    return keyed.combine_by_key(rows, {"total": "sum", "n": "count"}, "c_nationkey", finish={"total": F.col("total"), "n": F.col("n"), "mean": F.col("total").cast("double") / F.col("n")})


@query("SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS keys FROM orders GROUP BY o_custkey")
def combine_by_key_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = keyed.combine_by_key(table(spark, sf_dir, "orders"), {"keys": "list"}, "o_custkey", "o_orderkey")
    return lists.select("o_custkey", F.array_join(F.transform(F.array_sort("keys"), lambda k: k.cast("string")), ",").alias("keys"))


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS kinds FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id")
def combine_by_key_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = keyed.combine_by_key(table(spark, sf_dir, "events"), {"kinds": "set"}, "user_id", "event_type")
    return sets.select("user_id", F.array_join("kinds", ",").alias("kinds"))


@query("SELECT s_nationkey, CAST(SUM(s_suppkey) AS BIGINT) AS v FROM supplier GROUP BY s_nationkey")
def combine_by_key_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three-function form with Python callables."""
    from pyspark.sql.types import LongType

    return keyed.combine_by_key_python(table(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "v"), lambda v: int(v), lambda a, v: a + int(v), lambda a, b: a + b, LongType(), "s_nationkey", "v")


@query("SELECT o_custkey, CAST(SUM(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS v FROM orders GROUP BY o_custkey")
def reduce_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.reduce_by_key(table(spark, sf_dir, "orders").select("o_custkey", cents("o_totalprice").alias("v")), "sum", "o_custkey")


@query("SELECT o_custkey, string_agg(o_orderstatus, '>' ORDER BY o_orderkey) AS v FROM orders GROUP BY o_custkey")
def fold_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordered fold that is no monoid."""
    merge = lambda acc, v: F.when(acc == "", v).otherwise(F.concat(acc, F.lit(">"), v))
    return keyed.fold_by_key(table(spark, sf_dir, "orders"), F.lit(""), merge, ["o_orderkey"], "o_custkey", "o_orderstatus").withColumnRenamed("o_orderstatus", "v")


@query("SELECT DISTINCT user_id, event_type FROM events")
def distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.distinct(table(spark, sf_dir, "events").select("user_id", "event_type"))


@query("SELECT DISTINCT nullif(o_custkey % 5, 3) AS a, CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN NULL ELSE 'x' END AS b FROM orders")
def distinct_falsy(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.when(F.col("o_orderkey") % 3 == 0, "").when(F.col("o_orderkey") % 3 == 2, "x")
    return keyed.distinct(table(spark, sf_dir, "orders").select(F.expr("nullif(o_custkey % 5, 3)").alias("a"), b.alias("b")))


@query("SELECT CAST(o_custkey % 5 AS INTEGER) AS pid, o_custkey, CAST(SUM(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS v FROM orders GROUP BY ALL")
def reduce_by_key_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key's row lies in the partition that was chosen for it."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", cents("o_totalprice").alias("v"))
    return keyed.reduce_by_key(rows, "sum", "o_custkey", partitions=5, place=F.col("o_custkey") % 5).select(F.spark_partition_id().alias("pid"), "o_custkey", "v")


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n, CAST(MAX(event_id) AS BIGINT) AS last FROM events GROUP BY user_id")
def combine_by_key_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.combine_by_key(table(spark, sf_dir, "events"), {"n": "count", "last": "max"}, "user_id", "event_id", partitions=12)


@query("SELECT DISTINCT l_returnflag, l_linenumber FROM lineitem")
def distinct_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.distinct(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linenumber"), partitions=3)


# -- whole-dataset aggregates


@query("SELECT CAST(SUM(o_orderkey * (1 + o_custkey % 3)) % 1000003 AS BIGINT) AS v FROM orders")
def reduce_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python function, folded per partition and over the partials."""
    weighted = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * (1 + F.col("o_custkey") % 3) % 1000003).alias("v"))
    total = aggregates.reduce_partials(weighted, lambda a, b: (a + b) % 1000003, "v")
    return spark.createDataFrame([(total,)], "v long")


@query("SELECT CAST(SUM(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS v FROM lineitem")
def reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.reduce_frame(table(spark, sf_dir, "lineitem"), "sum", cents("l_extendedprice"))


@query("SELECT MAX(l_extendedprice) AS v FROM lineitem")
def max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.reduce_frame(table(spark, sf_dir, "lineitem"), "max", "l_extendedprice")


@query("SELECT MIN(l_extendedprice) AS v FROM lineitem")
def min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.reduce_frame(table(spark, sf_dir, "lineitem"), "min", "l_extendedprice")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY length(o_orderpriority) DESC, o_orderkey DESC LIMIT 1")
def max_by_cmp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.max_by(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), F.length("o_orderpriority"), ["o_orderkey"]).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY length(o_orderpriority), o_orderkey DESC LIMIT 1")
def min_by_cmp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.max_by(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), F.length("o_orderpriority"), ["o_orderkey"], largest=False).select("o_orderkey", "o_custkey")


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM lineitem")
def count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.count_frame(table(spark, sf_dir, "lineitem"))


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 30")
def take(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.take(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 30, [F.col("o_orderkey").asc()])


# -- grouping and joins


@query("""
WITH o AS (SELECT o_custkey AS k, count(*) AS n, SUM(o_orderkey) AS s FROM orders GROUP BY 1), e AS (SELECT user_id AS k, count(*) AS n, SUM(event_id) AS s FROM events GROUP BY 1),
c AS (SELECT c_custkey AS k, count(*) AS n, SUM(c_nationkey) AS s FROM customer GROUP BY 1)
SELECT k, CAST(coalesce(c.n, 0) AS BIGINT) AS n0, CAST(coalesce(o.n, 0) AS BIGINT) AS n1, CAST(coalesce(e.n, 0) AS BIGINT) AS n2, CAST(coalesce(c.s, 0) AS BIGINT) AS s0, CAST(coalesce(o.s, 0) AS BIGINT) AS s1, CAST(coalesce(e.s, 0) AS BIGINT) AS s2
FROM c FULL JOIN o USING (k) FULL JOIN e USING (k)""")
def group_with3(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("long").alias("v"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("v"))
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, v: a + v)
    grouped = keyed.group_with([c, o, e])
    return grouped.select("k", *[F.size(f"v{i}").cast("long").alias(f"n{i}") for i in range(3)], *[add(f"v{i}").alias(f"s{i}") for i in range(3)])


@query("""
WITH a AS (SELECT n_regionkey AS k, string_agg(n_name, ',' ORDER BY n_name) AS x FROM nation GROUP BY 1), b AS (SELECT s_nationkey AS k, string_agg(s_name, ',' ORDER BY s_name) AS y FROM supplier GROUP BY 1)
SELECT k, coalesce(x, '') AS x, coalesce(y, '') AS y FROM a FULL JOIN b USING (k)""")
def cogroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("k"), F.col("n_name").alias("v"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("v"))
    return keyed.cogroup([a, b], names=["x", "y"], partitions=6).select("k", *[F.array_join(F.array_sort(c), ",").alias(c) for c in "xy"])


def _pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers, and parts by number: neither side's keys all have a match."""
    customers = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("k"), F.col("c_nationkey").alias("v"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_orderkey").alias("v"))
    return customers, lines


_JOIN = "SELECT k, o.v AS v, l.v AS v1 FROM (SELECT c_custkey * 2 AS k, c_nationkey AS v FROM customer) o {} JOIN (SELECT l_partkey AS k, l_orderkey AS v FROM lineitem) l USING (k)"


@query(_JOIN.format("INNER"))
def join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.join(*_pairs(spark, sf_dir), "inner", nullable=False)


@query(_JOIN.format("LEFT"))
def left_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.join(*_pairs(spark, sf_dir), "left", nullable=False)


@query(_JOIN.format("RIGHT"))
def right_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.join(*_pairs(spark, sf_dir), "right", nullable=False)


@query(_JOIN.format("FULL"))
def full_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.join(*_pairs(spark, sf_dir), "full", nullable=False)


def _null_keys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = table(spark, sf_dir, "nation").select(F.expr("nullif(n_nationkey, 0)").alias("k"), F.col("n_name").alias("v"))
    b = table(spark, sf_dir, "supplier").select(F.expr("if(s_nationkey = 3, 99, nullif(s_nationkey % 9, 0))").alias("k"), F.col("s_name").alias("v"))
    return a, b


_NULLS = "SELECT coalesce(a.k, b.k) AS k, a.v AS v, b.v AS v1 FROM (SELECT nullif(n_nationkey, 0) AS k, n_name AS v FROM nation) a {} JOIN (SELECT CASE WHEN s_nationkey = 3 THEN 99 ELSE nullif(s_nationkey % 9, 0) END AS k, s_name AS v FROM supplier) b ON a.k IS NOT DISTINCT FROM b.k"


@query(_NULLS.format("INNER"))
def join_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.join(*_null_keys(spark, sf_dir), "inner")


@query(_NULLS.format("LEFT"))
def left_join_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.join(*_null_keys(spark, sf_dir), "left")


@query(_NULLS.format("RIGHT"))
def right_join_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.join(*_null_keys(spark, sf_dir), "right")


@query(_NULLS.format("FULL"))
def full_join_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.join(*_null_keys(spark, sf_dir), "full")


# -- placement


def _by_partition(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.spark_partition_id().alias("pid")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))


@query("SELECT CAST(o_orderkey % 3 AS INTEGER) AS pid, CAST(count(*) AS BIGINT) AS n, MIN(o_orderkey) AS low, MAX(o_orderkey) AS high FROM orders GROUP BY 1")
def partition_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_partition(placement.partition_by(table(spark, sf_dir, "orders").select("o_orderkey"), 3, F.col("o_orderkey") % 3, strict=True), "o_orderkey")


@query("SELECT CAST(count(*) AS BIGINT) AS n, MIN(o_orderkey) AS low, MAX(o_orderkey) AS high, CAST(SUM(o_orderkey) AS BIGINT) AS total FROM orders")
def repartition(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = placement.repartition(table(spark, sf_dir, "orders").select("o_orderkey"), 16)
    return out.agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"), F.sum("o_orderkey").alias("total"))


@query("""
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS total FROM orders)
SELECT CAST(pos * 5 // total AS INTEGER) AS pid, CAST(count(*) AS BIGINT) AS n, MIN(o_orderkey) AS low, MAX(o_orderkey) AS high FROM r GROUP BY 1""")
def coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_partition(placement.coalesce(table(spark, sf_dir, "orders").select("o_orderkey"), 5, ["o_orderkey"]), "o_orderkey")


@query("SELECT CAST(count(*) AS BIGINT) AS n, o_orderstatus AS status, CAST(SUM(o_custkey) AS BIGINT) AS total FROM orders WHERE o_totalprice > 500 GROUP BY 2 UNION ALL SELECT CAST(count(*) AS BIGINT), NULL, CAST(SUM(o_custkey) AS BIGINT) FROM orders WHERE o_totalprice > 500")
def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two branches read one cached dataset."""
    kept = placement.cache(table(spark, sf_dir, "orders").filter("o_totalprice > 500").select("o_orderstatus", "o_custkey"))
    by = kept.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("total"))
    return setops.union(by, kept.agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("string").alias("status"), F.sum("o_custkey").alias("total"))).select("n", "status", "total")


# -- order


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderpriority, o_orderkey) - 1 AS BIGINT) AS pos FROM orders")
def sort_asc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Context(spark).range(0).transform(lambda _: table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")).with_order("o_orderkey").sort_by(F.col("o_orderpriority")).df.select("o_orderkey", F.col("__pos").alias("pos"))


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderpriority DESC, o_orderkey) - 1 AS BIGINT) AS pos FROM orders")
def sort_desc_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.with_position(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), [F.col("o_orderpriority").desc_nulls_last(), F.col("o_orderkey").asc()]).select("o_orderkey", "pos")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.top(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 25, "o_totalprice", order=["o_orderkey"])


# -- union, Arrow functions


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setops.union(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier UNION ALL SELECT n_nationkey FROM nation UNION ALL SELECT n_nationkey FROM nation")
def union_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    return setops.union(union(spark, sf_dir), nation, nation)


@query("SELECT p_partkey, p_size * 2 + 1 AS size2 FROM part")
def udf_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python function on Arrow batches, for what Columns can't say."""
    def double(batches, pid):
        for b in batches:
            yield pa.record_batch([b["p_partkey"], pc.add(pc.multiply(b["p_size"], pa.scalar(2, pa.int32())), pa.scalar(1, pa.int32()))], names=["p_partkey", "size2"])

    return narrow.map_partitions(table(spark, sf_dir, "part").select("p_partkey", "p_size"), double, "p_partkey long, size2 int")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey = 1)")
def dataframe_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A custom operator is any function of DataFrames."""
    nation = table(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return table(spark, sf_dir, "customer").transform(lambda d: d.join(nation, same_key(d, nation, ["c_nationkey"], nullable=False), "left_semi")).select("c_custkey", "c_name")
