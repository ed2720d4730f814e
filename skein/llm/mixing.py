"""Mixing sources to target weights: hierarchical budgets, then seeded token-prefixes of each leaf.

A tree domain - language - source has a weight per node. A node's budget goes to its children by
weight; a child that holds less than its share gives the rest to its siblings (by weight again), and
only what all siblings together can't use goes to the ancestors' other children. A node of weight 0
gets nothing, and what lies under it counts as no capacity, from the leaves up, so the budgets add up
to the smaller of the target and the usable capacity. Whole numbers throughout. Each leaf then takes the documents whose running token count, in the seeded order of
an epoch, stays within its budget; the next epoch starts where the leaf is used up.

The tree has a node per (domain, language, source), as many as there are; budgets are window sums in
Spark. The order of documents is that of a hash; running counts come from sums per hash range first, so a leaf
with a third of all documents isn't counted in one task.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import cut

#: a tree of more leaves is joined by shuffle
BROADCAST_LEAVES = 100_000
BUCKETS = 4096


@dataclass(frozen=True)
class Mix:
    """``weights``: path (1 to 3 names) -> whole weight; others weigh 1. ``share``: percent of all tokens."""

    weights: dict[tuple, int] = field(default_factory=dict)
    share: int = 80
    epochs: int = 2
    seed: int = 7


#: the mix of the registered query: unequal domains, English and German ahead, the hot source held back
PRODUCTION = Mix(weights={("domain0",): 4, ("domain1",): 3, ("domain2",): 2, ("domain3",): 2, **{(f"domain{d}", "en"): 3 for d in range(4)}, **{(f"domain{d}", "de"): 2 for d in range(4)}, ("domain0", "en", "src4"): 2}, share=80, epochs=2, seed=7)


def water_fill(budget: int, children: list[tuple[int, int]]) -> list[int]:
    """Splits ``budget`` over (weight, capacity) children; a full child's rest goes to its siblings.

    Children are settled by capacity per weight. What rounding leaves goes to children with room, in
    their order, so the sum is min(budget, total capacity).
    """
    out = [0] * len(children)
    left, weight = budget, sum(w for w, _ in children)
    open_ = sorted(range(len(children)), key=lambda i: (children[i][1] / children[i][0] if children[i][0] else float("inf"), i))
    for i in list(open_):
        w, cap = children[i]
        if w and cap * weight <= left * w:
            out[i], left, weight = cap, left - cap, weight - w
            open_.remove(i)
        else:
            break
    if weight:
        for i in open_:
            out[i] = min(children[i][1], left * children[i][0] // weight)
    rest = budget - sum(out)
    for i, (w, cap) in enumerate(children):
        if w and rest > 0:
            add = min(rest, cap - out[i])
            out[i], rest = out[i] + add, rest - add
    return out


def leaf_budgets(leaves: dict[tuple, int], mix: Mix) -> dict[tuple, int]:
    """Token budget per leaf from tokens per leaf; a leaf's capacity is its tokens times the epochs, 0 under a weight of 0."""
    capacity: dict[tuple, int] = defaultdict(int)
    children: dict[tuple, set] = defaultdict(set)
    for leaf, tokens in leaves.items():
        usable = tokens * mix.epochs if all(mix.weights.get(leaf[:d], 1) for d in range(1, len(leaf) + 1)) else 0
        for depth in range(len(leaf) + 1):
            capacity[leaf[:depth]] += usable
            if depth:
                children[leaf[: depth - 1]].add(leaf[:depth])
    budgets = {(): min(capacity[()], sum(leaves.values()) * mix.share // 100)}
    queue = [()]
    while queue:
        node = queue.pop()
        kids = sorted(children[node], key=lambda k: tuple((x is not None, x or "") for x in k))
        for kid, got in zip(kids, water_fill(budgets[node], [(mix.weights.get(k, 1), capacity[k]) for k in kids]), strict=True):
            budgets[kid] = got
            if len(kid) < 3:
                queue.append(kid)
    return {leaf: budgets[leaf] for leaf in leaves}


def domain_of(source: Column) -> Column:
    """The domain that a source belongs to where no column says it: four groups by its number."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"(\d{1,9})$", 1)
    return F.concat(F.lit("domain"), (F.when(number == "", 0).otherwise(number.cast("long")) % 4).cast("string"))


def token_count(text: Column) -> Column:
    """Tokens: words between ASCII white space; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def order_key(key: Column, epoch: int, seed: int) -> Column:
    """A document's place in an epoch: 60 bits of MD5, which SQL engines agree on."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{epoch}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def _fill(nodes: DataFrame, names: list[str]) -> DataFrame:
    """``water_fill`` of all parents of one level at once: adds ``budget`` to ``names, cap, w, b`` (the parent's)."""
    siblings = Window.partitionBy(*names[:-1]) if names[:-1] else Window.partitionBy(F.lit(0))
    by_name = [F.col(n).asc_nulls_first() for n in names]
    by_fill = siblings.orderBy(F.expr("CASE WHEN w > 0 THEN CAST(cap AS DOUBLE) / w END").asc_nulls_last(), *by_name)
    before, until = (Window.unboundedPreceding, -1), (Window.unboundedPreceding, 0)
    dec = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    seen = nodes.withColumns({"tw": F.sum("w").over(siblings), "pw": F.coalesce(F.sum("w").over(by_fill.rowsBetween(*before)), F.lit(0)), "pc": F.coalesce(F.sum("cap").over(by_fill.rowsBetween(*before)), F.lit(0))})
    fits = F.expr(f"w > 0 AND {dec('cap')} * {dec('tw - pw')} <= {dec('b - pc')} * {dec('w')}")
    full = seen.withColumn("full", F.bool_and(fits).over(by_fill.rowsBetween(*until)))
    rest = full.withColumns({"rest": F.col("b") - F.sum(F.expr("if(full, cap, 0L)")).over(siblings), "rw": F.col("tw") - F.sum(F.expr("if(full, w, 0L)")).over(siblings)})
    got = rest.withColumn("got", F.expr(f"CASE WHEN full THEN cap WHEN rw > 0 THEN least(cap, {dec('rest')} * {dec('w')} div {dec('greatest(rw, 1L)')}) ELSE 0L END"))
    room = F.sum(F.expr("if(w > 0, cap - got, 0L)")).over(siblings.orderBy(*by_name).rowsBetween(*before))
    over = got.withColumns({"over": F.col("b") - F.sum("got").over(siblings), "room": F.coalesce(room, F.lit(0))})
    return over.withColumn("budget", F.expr("got + if(w > 0, greatest(0L, least(cap - got, over - room)), 0L)"))


def _same(names: list[str], suffix: str) -> Column:
    return reduce(and_, [F.col(n).eqNullSafe(F.col(n + suffix)) for n in names])


def _weighted(nodes: DataFrame, names: list[str], weights: dict[tuple, int], out: str) -> DataFrame:
    """Adds the weight of the node ``names``, 1 where the mix names none; the mix is a parameter, so small."""
    if not weights:
        return nodes.withColumn(out, F.lit(1).cast("long"))
    given = nodes.sparkSession.createDataFrame([(*path, w) for path, w in weights.items()], ", ".join(f"{c}4 string" for c in names) + ", given long")
    return nodes.join(F.broadcast(given), _same(names, "4"), "left").select(*nodes.columns, F.coalesce("given", F.lit(1).cast("long")).alias(out))


def budgets_frame(counted: DataFrame, mix: Mix) -> tuple[DataFrame, int]:
    """``domain, lang, source, tokens, budget``, one row per leaf, and the number of leaves.

    ``leaf_budgets`` in Spark, level by level. A node's children, a row each, are sorted in one task.
    """
    names = ["domain", "lang", "source"]
    leaves = counted.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"))
    for level in (1, 2, 3):
        leaves = _weighted(leaves, names[:level], {p: w for p, w in mix.weights.items() if len(p) == level}, f"w{level}")
    leaves = cut(leaves.withColumn("usable", F.when((F.col("w1") > 0) & (F.col("w2") > 0) & (F.col("w3") > 0), F.col("tokens") * mix.epochs).otherwise(0)))
    n, total, usable = leaves.agg(F.count(F.lit(1)), F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("usable"), F.lit(0))).first()
    up = None
    for level in (1, 2, 3):
        node = names[:level]
        nodes = leaves.groupBy(*node).agg(F.sum("tokens").alias("tokens"), F.sum("usable").alias("cap"), F.first(f"w{level}").alias("w"))
        if up is None:
            nodes = nodes.withColumn("b", F.lit(min(usable, total * mix.share // 100)).cast("long"))
        else:
            parents = up.select(*[F.col(c).alias(f"{c}5") for c in node[:-1]], F.col("budget").alias("b"))
            nodes = nodes.join(parents, _same(node[:-1], "5")).select(*node, "tokens", "cap", "w", "b")
        up = _fill(nodes, node).select(*node, "tokens", "budget")
    return cut(up), n


def mix_sources(docs: DataFrame, mix: Mix = Mix(), key: str = "doc_id", text: str = "text", domain: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``key, domain, lang, source, n_tokens, epoch``: a row per selected document and epoch.

    In an epoch, a leaf's documents follow each other by ``order_key`` (ties: key); those whose
    running count stays within what is left of the budget are selected. Documents without tokens, null
    and empty texts too, count nothing and go along where they lie within the prefix. Rows that repeat
    a key, or have none, are documents each (the null key orders like an empty one); null domains, languages and
    sources are values. ``keep`` names columns that go along. An empty table gives no rows.
    """
    held = F.struct(F.lit(0).alias("__"), *[F.col(c).alias(f"x{i}") for i, c in enumerate(keep)])
    counted = cut(docs.select(F.monotonically_increasing_id().alias("__row"), F.col(key).alias("key"), (domain_of(F.col("source")) if domain is None else domain).alias("domain"), F.col("lang"), F.col("source"), token_count(F.col(text)).alias("n_tokens"), held.alias("__x")))
    leaves, n = budgets_frame(counted, mix)
    leaves = leaves.withColumnsRenamed({c: f"{c}2" for c in ("domain", "lang", "source")})
    planned = counted.drop("__x").join(F.broadcast(leaves) if n <= BROADCAST_LEAVES else leaves, _same(["domain", "lang", "source"], "2")).drop("domain2", "lang2", "source2")
    epochs = F.array(*[F.struct(F.lit(e).alias("epoch"), order_key(F.col("key"), e, mix.seed).alias("place")) for e in range(mix.epochs)])
    placed = planned.select("*", F.explode(epochs).alias("e")).select("__row", "key", "domain", "lang", "source", "n_tokens", "tokens", F.col("e.epoch").alias("epoch"), F.col("e.place").alias("place"), (F.col("budget") - F.col("e.epoch") * F.col("tokens")).alias("left"))
    placed = placed.filter((F.col("left") > 0) | (F.col("epoch") == 0)).withColumn("bucket", F.shiftright("place", 48))
    leaf = ["domain", "lang", "source", "epoch"]
    sums = placed.groupBy(*leaf, "bucket").agg(F.sum("n_tokens").alias("sum"))
    before = F.sum("sum").over(Window.partitionBy(*leaf).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(*[F.col(c).alias(f"{c}3") for c in (*leaf, "bucket")], F.coalesce(before, F.lit(0)).alias("before"), "sum")
    on = [F.col(c).eqNullSafe(F.col(f"{c}3")) for c in (*leaf, "bucket")]
    joined = placed.join(starts, on).filter(F.col("before") <= F.col("left")).drop(*[f"{c}3" for c in (*leaf, "bucket")])
    running = F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*leaf, "bucket").orderBy("place", "key", "n_tokens", "__row").rowsBetween(Window.unboundedPreceding, 0))
    taken = joined.withColumn("running", running).filter(F.col("running") <= F.col("left"))
    if not keep:
        return taken.select(F.col("key").alias(key), "domain", "lang", "source", "n_tokens", "epoch")
    rows = counted.select(F.col("__row").alias("__row2"), "__x")
    chosen = taken.join(rows, F.col("__row") == F.col("__row2"))
    return chosen.select(F.col("key").alias(key), "domain", "lang", "source", "n_tokens", "epoch", *[F.col(f"__x.x{i}").alias(c) for i, c in enumerate(keep)])
