"""Operators on small inputs: expected results, empty inputs, null keys, order and placement."""

from __future__ import annotations

import gzip
import os

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein import Context
from skein.operators import keyed, ordering, placement
from skein.sources import files
from skein.sources.registry import Connector


@pytest.fixture(scope="module")
def ctx(spark):
    return Context(spark, partitions=4)


def values(ds):
    return [r[0] for r in ds.collect()]


def sizes(df, n):
    counts = dict(df.groupBy(F.spark_partition_id().alias("p")).count().collect())
    return [counts.get(i, 0) for i in range(n)]


KV = "k string, v int"


# -- sources and actions


def test_range(ctx):
    assert values(ctx.range(100)) == list(range(100))
    assert values(ctx.range(0, 100, 4)) == list(range(0, 100, 4))
    assert values(ctx.range(10, 0, -3)) == [10, 7, 4, 1] and values(ctx.range(5, 1)) == []
    assert values(ctx.range(0, 1, 0.25)) == [0, 0.25, 0.5, 0.75]
    with pytest.raises(ValueError):
        ctx.range(0, 1, 0)
    with pytest.raises(ValueError):
        ctx.range(0, 9, 1, partitions=0)


def test_parallelize(ctx):
    ds = ctx.parallelize(list(range(10)))
    assert values(ds) == list(range(10)) and sizes(ds.df, 4) == [3, 3, 2, 2]
    assert sizes(ctx.parallelize([1, 2], partitions=4).df, 4) == [1, 1, 0, 0]
    assert ctx.parallelize([], "v int").collect() == [] and ctx.empty("v int").count() == 0
    with pytest.raises(ValueError):
        ctx.parallelize([])


def test_union_keeps_order(ctx):
    assert values(ctx.union(ctx.range(10), ctx.range(10, 20), ctx.range(20, 30))) == list(range(30))
    assert values(ctx.range(3).union(ctx.range(3))) == [0, 1, 2, 0, 1, 2]


def test_take(ctx):
    assert [r[0] for r in ctx.range(100).take(30)] == list(range(30))
    assert len(ctx.range(10).take(30)) == 10 and ctx.range(0).take(30) == []
    with pytest.raises(ValueError):
        ctx.range(3).take(-1)


def test_max_min(ctx):
    assert ctx.range(1000).max() == 999 and ctx.range(0).max() is None and ctx.range(400).union(ctx.range(0)).max() == 399
    assert ctx.range(120, 1000).min() == 120 and ctx.range(0).min() is None
    rows = ctx.parallelize([(1, "a"), (2, "b"), (2, "c"), (1, "d")], "k int, v string")
    assert rows.max(F.col("k")).v == "c" and rows.min(F.col("k")).v == "d"


def test_map_flat_map_filter(ctx):
    four = 4
    assert values(ctx.range(1000).map(v=F.lit(four))) == [4] * 1000 and values(ctx.range(0).map(v=F.lit(4))) == []
    assert values(ctx.range(100).flat_map(F.array_repeat(F.lit(1), 10))) == [1] * 1000
    sign = F.when(F.col("id") % 2 == 0, F.array(F.lit(-1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    assert values(ctx.range(120).flat_map(sign)) == [-1] * 120
    assert values(ctx.range(1000).filter(F.col("id") < 100)) == list(range(100))
    assert values(ctx.range(1000).filter(F.lit(None).cast("boolean"))) == [] == values(ctx.range(0).filter(F.lit(True)))


def test_reduce_and_fold(ctx):
    ones = ctx.range(10000).map(v=F.lit(1))
    assert ones.reduce("sum") == 10000 and ctx.range(1).map(v=F.lit(1)).reduce("sum") == 1 and ctx.range(0).reduce("sum") is None
    with pytest.raises(ValueError):
        ones.reduce("median-ish")
    assert ctx.range(5).fold(F.lit(""), lambda a, v: F.concat(a, v.cast("string"))) == "01234"


def test_map_partitions_and_glom(ctx):
    def minus(batches, pid):
        for b in batches:
            yield pa.record_batch([pa.array([-1] * b.num_rows, pa.int64())], names=["v"])

    assert values(ctx.range(10000).map_partitions(minus, "v long")) == [-1] * 10000
    assert values(ctx.range(0).map_partitions(minus, "v long")) == []

    def ids(batches, pid):
        list(batches)
        yield pa.record_batch([pa.array([pid], pa.int32())], names=["v"])

    assert sorted(values(ctx.parallelize([1, 2]).map_partitions(ids, "v int"))) == [0, 1, 2, 3]
    rows = ctx.parallelize([7, 8, 9], partitions=5).glom().collect()
    assert [[x["value"] for x in r.rows] for r in rows] == [[7], [8], [9], [], []]


# -- keyed


def test_combine_and_reduce_by_key(ctx):
    pairs = ctx.range(1000).key_by((F.col("id") % 4).cast("int"), F.col("id"))
    lists = {r.k: sorted(r.all) for r in pairs.combine_by_key({"all": "list"}).collect()}
    assert lists == {k: list(range(k, 1000, 4)) for k in range(4)}
    assert {r.k: r.v for r in pairs.map(k=F.col("k"), v=F.lit(1)).reduce_by_key("sum").collect()} == dict.fromkeys(range(4), 250)
    made = pairs.combine_by_key({"s": "sum", "n": "count"}, {"mean": F.col("s") / F.col("n")}).collect()
    assert {r.k: r.mean for r in made} == {k: 498.0 + k for k in range(4)}
    sets = pairs.combine_by_key_python(lambda v: {v}, lambda s, v: s | {v}, lambda a, b: a | b, T.ArrayType(T.LongType()), 3)
    assert {r.k: len(r.v) for r in sets.transform(lambda d: d).collect()} == dict.fromkeys(range(4), 250)
    folded = pairs.fold_by_key(F.lit(0).cast("long"), lambda a, v: a * 2 % 1009 + v % 7).collect()
    for r in folded:
        acc = 0
        for v in range(r.k, 1000, 4):
            acc = acc * 2 % 1009 + v % 7
        assert r.v == acc


def test_python_combiner_keeps_null_keys(ctx):
    rows = ctx.parallelize([("a", 1), (None, 2), (None, 3)], KV)
    got = rows.combine_by_key_python(lambda v: int(v), lambda a, v: a + int(v), lambda a, b: a + b, T.LongType()).collect()
    assert sorted((r.k or "", r.v) for r in got) == [("", 5), ("a", 1)]


def test_distinct(ctx):
    assert values(ctx.range(10000).map(v=F.lit(1)).distinct()) == [1]
    rows = [(0, ""), (0, ""), (None, ""), (None, ""), (0, None), (1, "x")]
    assert ctx.parallelize(rows, "a int, b string").distinct().count() == 4
    odd = ctx.parallelize([float("nan"), float("nan"), 0.0, -0.0], T.DoubleType())
    assert odd.distinct().count() == 2


def test_group_with_and_cogroup(ctx):
    inputs = [[("a", 5), ("a", 7), ("b", 6)], [("a", 1), ("b", 4)], [("a", 2)], [("b", 42), ("b", 66)], []]
    first, *rest = [ctx.parallelize(x, KV) for x in inputs]
    got = {r.k: [sorted(r[f"v{i}"]) for i in range(5)] for r in first.group_with(*rest).collect()}
    assert got == {"a": [[5, 7], [1], [2], [], []], "b": [[6], [4], [], [42, 66], []]}
    two = ctx.parallelize([("a", None), (None, 4)], KV).cogroup(ctx.parallelize([(None, 2)], KV))
    assert {r.k: (r.v0, r.v1) for r in two.collect()} == {"a": ([None], []), None: ([4], [2])}


LEFT, RIGHTS = [("a", 1), ("b", 4), ("c", 654)], [[("a", 2), ("z", 999)], [("a", 2), ("a", 25)], []]


@pytest.mark.parametrize("right", RIGHTS)
@pytest.mark.parametrize("how", ["join", "left_outer_join", "right_outer_join", "full_outer_join"])
def test_joins(ctx, how, right):
    got = sorted(((r.k, r.v, r.v1) for r in getattr(ctx.parallelize(LEFT, KV), how)(ctx.parallelize(right, KV)).collect()), key=str)
    pairs = [(k, v, w) for k, v in LEFT for k2, w in right if k == k2]
    if how in ("left_outer_join", "full_outer_join"):
        pairs += [(k, v, None) for k, v in LEFT if k not in dict(right)]
    if how in ("right_outer_join", "full_outer_join"):
        pairs += [(k, None, w) for k, w in right if k not in dict(LEFT)]
    assert got == sorted(pairs, key=str)


def test_joins_match_null_keys(ctx):
    a, b = ctx.parallelize([(None, 1), ("x", 2)], KV), ctx.parallelize([(None, 3), (None, 4)], KV)
    assert sorted((r.v, r.v1) for r in a.join(b).collect()) == [(1, 3), (1, 4)]
    assert a.full_outer_join(b).count() == 3 and ctx.empty(KV).full_outer_join(ctx.empty(KV)).count() == 0
    with pytest.raises(ValueError):
        keyed.join(a.df, b.df, "cross")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 5)), max_size=8), st.lists(st.tuples(st.sampled_from(["a", "c", None]), st.integers(0, 5)), max_size=8))
def test_join_is_cogroup_exploded(ctx, left, right):
    a, b = ctx.parallelize(left, KV), ctx.parallelize(right, KV)
    grouped = a.cogroup(b).collect()
    want = sorted(((r.k, x, y) for r in grouped for x in r.v0 for y in r.v1), key=str)
    assert sorted(((r.k, r.v, r.v1) for r in a.join(b).collect()), key=str) == want


# -- placement and order


def test_partition_by(ctx):
    ds = ctx.range(10000).partition_by(3, F.col("id") % 3)
    parts = ds.df.select(F.spark_partition_id().alias("p"), "id").collect()
    assert all(r.p == r.id % 3 for r in parts) and len(parts) == 10000
    with pytest.raises(Exception, match="partition"):
        ctx.range(10).partition_by(3, F.col("id"), strict=True).collect()
    with pytest.raises(ValueError):
        ctx.range(10).partition_by(0, F.col("id"))


@pytest.mark.parametrize(("rows", "n"), [(10000, 5), (10000, 3), (10000, 1), (3, 8), (0, 4)])
def test_coalesce_is_even_and_keeps_order(ctx, rows, n):
    ds = ctx.range(rows).coalesce(n)
    got = sizes(ds.df, n)
    assert sum(got) == rows and max(got) - min(got) <= 1 and ds.num_partitions() == n
    lists = [[x["id"] for x in r.rows] for r in ds.glom().collect()]
    assert [x for part in lists for x in part] == list(range(rows))


def test_repartition_chain_and_cache(ctx):
    a, b = ctx.range(10000).repartition(8).repartition(4), ctx.range(2500).repartition(8).repartition(4)
    ds = a.union(b).repartition(32).cache()
    assert (ds.count(), ds.max(), ds.min(), ds.reduce("sum")) == (12500, 9999, 0, 53118750)
    assert ds.df.is_cached and not ds.unpersist().df.is_cached


def test_sort(ctx):
    assert values(ctx.parallelize([1, 5, 2, 4, 6, 9, 0, 8, 7, 3]).sort()) == list(range(10))
    assert values(ctx.parallelize([1, 5, 2]).sort(ascending=False)) == [5, 2, 1]
    pairs = ctx.parallelize([(1, 1), (2, 1), (1, 2), (2, 2), (1, 3), (2, 3)], "k int, v int")
    assert [tuple(r) for r in pairs.sort_by(F.col("k")).collect()] == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3)]
    assert [tuple(r) for r in pairs.sort_by(F.col("k"), False).collect()] == [(2, 1), (2, 2), (2, 3), (1, 1), (1, 2), (1, 3)]


def test_partition_counts_and_places(ctx, spark):
    pairs = ctx.range(1000).key_by(F.when(F.col("id") % 10 > 0, F.col("id") % 10), F.col("id"))
    for ds in (pairs.reduce_by_key("sum", partitions=5), pairs.distinct(partitions=5), pairs.cogroup(pairs, partitions=5), pairs.combine_by_key({"n": "count"}, partitions=5)):
        assert ds.num_partitions() == 5
    few = pairs.reduce_by_key("max")
    for how in ("join", "left_outer_join", "right_outer_join", "full_outer_join"):
        joined = getattr(pairs, how)(few, partitions=5)
        assert joined.count() == 1000 and joined.df.filter("k is null").count() == 100
    place = F.when(F.col("k").isNull(), 2).otherwise(F.col("k") % 3)
    placed = pairs.reduce_by_key("sum", partitions=4, place=place).df.select("k", "v", F.spark_partition_id().alias("p"))
    assert {r.k: (r.v, r.p) for r in placed.collect()} == {k or None: (sum(range(k, 1000, 10)), 2 if k == 0 else k % 3) for k in range(10)}
    plan = pairs.reduce_by_key("sum", partitions=4, place=place).df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = ctx.parallelize([("a", 1)], KV).join(ctx.parallelize([("a", 2)], KV), partitions=5).df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2  # one a side
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(ValueError):
        pairs.distinct(partitions=0)


def test_reduce_with_python_functions(ctx):
    ordered = ctx.range(200).map(v=F.col("id").cast("string"))
    assert ordered.reduce_with(lambda a, b: f"{a},{b}") == ",".join(map(str, range(200)))
    assert ctx.range(0).reduce_with(lambda a, b: a + b) is None
    by_tens = lambda a, b: a // 10 - b // 10
    assert ctx.range(35).max(compare=by_tens) == 34 and ctx.range(35).min(compare=by_tens) == 9 and ctx.range(0).max(compare=by_tens) is None


def test_positions_of_one_heavy_key(spark):
    df = spark.range(5000).select(F.lit(1).alias("k"), (F.col("id") * 7 % 5000).alias("o"))
    got = ordering.with_position(df, [F.col("k").asc(), F.col("o").asc()]).select("o", "pos").collect()
    assert all(r.o == r.pos for r in got) and len(got) == 5000
    assert [r.o for r in ordering.top(df, 3, "k", order=["o"]).collect()] == [0, 1, 2]
    with pytest.raises(ValueError):
        placement.repartition(df, 0)


# -- files and functions


def test_text_round_trips(ctx, tmp_path):
    parts = [ctx.range(1000).map(value=F.col("id").cast("string")).repartition(10) for _ in range(3)]
    for i, ds in enumerate(parts):
        ds.save_as_text_parts(f"{tmp_path}/all/{i}", extension="gz", compressor=gzip.compress)
    back = ctx.text_file(f"{tmp_path}/all", recursive=True, decompressor=lambda data, name: gzip.decompress(data))
    total = back.df.agg(F.count("*"), F.sum(F.col("value").cast("long"))).first()
    assert tuple(total) == (3000, 3 * 499500)
    parts[0].save_as_text(f"file://{tmp_path}/spark", compression="gzip")
    assert ctx.text_lines(f"file://{tmp_path}/spark").count() == 1000
    with pytest.raises(FileExistsError):
        parts[0].save_as_text_parts(f"{tmp_path}/all/0", overwrite=False)
    parts[0].save_as_text_parts(f"{tmp_path}/all/0")
    assert sorted(os.listdir(f"{tmp_path}/all/0"))[0] == "part-0.txt" and len(os.listdir(f"{tmp_path}/all/0")) == 10


def test_listing_lines_and_odd_names(ctx, tmp_path):
    for name, data in {"a.txt": b"x\r\ny\n", ".hidden": b"h", "_under": b"u\n\n", "empty": b"", "s p#1.txt": b"1\n\n2\n\n", "sub/deep.txt": b"d\n"}.items():
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    flat = ctx.binary_files(str(tmp_path))
    assert sorted(os.path.basename(r.path) for r in flat.collect()) == [".hidden", "_under", "a.txt", "empty", "s p#1.txt"]
    assert ctx.binary_files(str(tmp_path), recursive=True).count() == 6
    assert values(ctx.text_file(str(tmp_path / "a.txt"))) == ["x\r", "y"]
    assert values(ctx.text_file(str(tmp_path / "a.txt"), strip_cr=True)) == ["x", "y"]
    assert values(ctx.text_file(str(tmp_path / "s p#1.txt"))) == ["1", "", "2", ""]
    assert values(ctx.text_file(str(tmp_path / "empty"))) == []
    assert ctx.whole_text_files(str(tmp_path / "sub")).collect()[0].text == "d\n"
    assert files.to_url("/x/y") == files.to_url("file:/x/y") == "file:///x/y"


def test_lines_of_split_files(ctx, spark, tmp_path, monkeypatch):
    lines = {"a": ["", "é" * 30, "x", "", "long " * 50, "end"], "b": [f"line {i}" for i in range(200)], "_c": ["no newline at the end"]}
    for name, ls in lines.items():
        (tmp_path / name).write_text("\n".join(ls) + ("\n" if name != "_c" else ""), encoding="utf-8")
    want = [x for name in sorted(lines) for x in lines[name]]
    for block in (33, 500, 1 << 20):
        got = files.ordered_lines(spark, str(tmp_path), block=block)
        assert [r.value for r in got.orderBy("place").collect()] == want
    assert values(ctx.text_file(str(tmp_path))) == want and values(ctx.text_file(str(tmp_path / "b"), encoding="latin-1")) == lines["b"]
    monkeypatch.setattr(files, "local_path", lambda url: None)  # as in other stores
    other = files.ordered_lines(spark, f"file://{tmp_path}/b")
    assert [r.value for r in other.orderBy("place").collect()] == lines["b"]


def test_block_positions_are_those_of_the_text(spark, tmp_path, monkeypatch):
    lines = {"part-10": [f"line {i}" for i in range(100)], "part-2": ["", "é" * 30, "", "long " * 50, "end"], "part-3": []}
    for name, ls in lines.items():
        (tmp_path / name).write_text("".join(x + "\n" for x in ls), encoding="utf-8")
    want = list(enumerate(x for name in sorted(lines) for x in lines[name]))
    for block in (33, 500, 1 << 20):
        got = ordering.with_block_position(files.ordered_lines(spark, str(tmp_path), block=block), "place").select("pos", "value")
        assert sorted(map(tuple, got.collect())) == want
        assert "rangepartitioning" not in got._jdf.queryExecution().toString()
        spark.catalog.clearCache()
    monkeypatch.setattr(files, "local_path", lambda url: None)  # as in other stores
    other = ordering.with_block_position(files.ordered_lines(spark, f"file://{tmp_path}"), "place")
    assert sorted((r.pos, r.value) for r in other.collect()) == want


def test_lines_of_pieces(monkeypatch, tmp_path):
    monkeypatch.setattr(files, "LINE_ROWS", 3)
    for size in (1, 2, 7, 1 << 20):
        monkeypatch.setattr(files, "LINE_BYTES", size)
        for data in (b"", b"\n", b"\n\n", b"a", b"a\n", b"a\n\nbcd\r\n\n", b"\xff\x00\n" + b"x" * 40 + b"\ny\nz", b"q\n" * 20):
            (tmp_path / "f").write_bytes(data)
            for block in (1, 3, 8, 1000):
                reader = files._LinesReader({"path": str(tmp_path), "block": str(block)})
                parts = [[r for b in reader.read(p) for r in b.to_pylist()] for p in reader.partitions()]
                assert [r["line"] for p in parts for r in p] == (data.split(b"\n")[:-1] if data.endswith(b"\n") or not data else data.split(b"\n"))
                assert all([r["row"] for r in p] == list(range(len(p))) for p in parts)


def test_parts_by_batches_encodings_and_order(ctx, spark, tmp_path):
    texts = ["", "a", None, "é", "", "b\nc", "z", ""]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = ctx.parallelize([(t,) for t in texts], "value string", 1)
        for encoding in ("utf-8", "UTF8", "utf-16", "utf-7", "latin-1"):
            rows.save_as_text_parts(f"{tmp_path}/one", encoding=encoding)
            assert (tmp_path / "one" / "part-0.txt").read_bytes() == "\n".join(t or "" for t in texts).encode(encoding)
        rows.save_as_text_parts(f"{tmp_path}/one", extension="gz", compressor=gzip.compress)
        assert gzip.decompress((tmp_path / "one" / "part-0.gz").read_bytes()) == "\n".join(t or "" for t in texts).encode()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    numbers = ctx.range(0, 24, 1, 12).map(value=F.col("id").cast("string"))
    numbers.save_as_text_parts(f"{tmp_path}/many", in_order=True)
    assert sorted(os.listdir(tmp_path / "many")) == [f"part-{i:02}.txt" for i in range(12)]
    assert values(ctx.text_file(f"{tmp_path}/many")) == [str(i) for i in range(24)]
    numbers.save_as_text_parts(f"{tmp_path}/many")
    assert set(os.listdir(tmp_path / "many")) == {f"part-{i}.txt" for i in range(12)}


def test_part_files_of_a_crashed_write_dont_come_back(ctx, tmp_path):
    rows = ctx.range(4).map(value=F.col("id").cast("string"))
    os.makedirs(f"{tmp_path}/out.__staging-dead")
    (tmp_path / "out.__staging-dead" / "part-9.txt").write_text("stale")
    os.makedirs(f"{tmp_path}/out.__staging")
    (tmp_path / "out.__staging" / "part-9.txt").write_text("stale")
    rows.repartition(2).save_as_text_parts(f"{tmp_path}/out")
    assert sorted(os.listdir(tmp_path / "out")) == ["part-0.txt", "part-1.txt"]
    rows.repartition(1).save_as_text_parts(f"{tmp_path}/out")
    assert os.listdir(tmp_path / "out") == ["part-0.txt"] and not [n for n in os.listdir(tmp_path) if n.endswith(("-old", "-ready"))]


def test_connectors(ctx, spark):
    own = Context(spark, file_connector=False)
    own.register_connector(Connector(lambda url: url.startswith("mem:"), lambda s, url, recursive: s.createDataFrame([(url, b"hi\nyou")], files.SCHEMA)))
    assert values(own.text_file("mem:a")) == ["hi", "you"]
    with pytest.raises(ValueError):
        own.registry.find("other:b")


def test_task_errors_and_execute(ctx):
    def fail(batches, pid):
        raise RuntimeError("boom in a task")
        yield

    with pytest.raises(Exception, match="boom in a task"):
        ctx.range(0, 100, 4).map_partitions(fail, "v long").collect()
    factor = 3
    assert ctx.execute(lambda dispatch: sum(dispatch(lambda x: x * factor, range(10)))) == 135
