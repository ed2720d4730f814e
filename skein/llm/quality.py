"""Quality rules with thresholds learned per language and source. DataFrame functions only.

Fixed rules (``base_failed``): too few words, or too many words inside repeated 3-word windows.
Learned rules: every (language, source) has a quantile sketch of each ratio over all documents that pass
the fixed rules. A sketch is a histogram over logarithmic bins (the leading ``SKETCH_BITS`` bits of the
ratio in millionths, so a relative error below 1/32); sketches merge by adding counts, give the same
whatever the order, and a source with a third of all rows costs one sketch per map task.

A document goes if a ratio exceeds the median of its group by ``SPREADS`` times the group's spread. The
spread is the distance from the tenth percentile to the median, which documents that stand out upwards
don't widen, plus the ratio's resolution: one word of the shortest document that passes, or one line of
ten. Quantiles of small groups are drawn towards the language's, and those towards the corpus', as
if ``PRIOR`` further documents had them; a group of six is judged by its language, one of thousands by
itself. No ratio has a fixed cutoff: a source in which symbols are usual keeps what another one loses.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import barrier, cut, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: ratio -> its resolution in millionths
RULES = {"symbol_ratio": 1_000_000 // MIN_WORDS, "shout_ratio": 1_000_000 // MIN_WORDS, "dup_line_ratio": 100_000}
SPREADS, PRIOR, SKETCH_BITS = 6, 50, 6
LOW, MIDDLE = 10, 50  # percentiles


#: a place takes the low bits of a sorted number, the window's hash the others
PLACE_BITS = 24


def windows(tokens: Column) -> Column:
    """The 3-word windows of ``tokens`` in order, as structs a, b, c."""
    n = F.size(tokens)
    rest = lambda k: F.slice(tokens, k, F.greatest(n, F.lit(1)))
    return F.slice(F.arrays_zip(tokens.alias("a"), rest(2).alias("b"), rest(3).alias("c")), 1, F.greatest(n - 2, F.lit(0)))


def numbered(own: Column) -> Column:
    """Windows as sorted plain numbers, hash bits over place: n log n, without objects."""
    mask = F.lit(-(1 << PLACE_BITS)).cast("long")
    return F.sort_array(F.transform(own, lambda w, i: F.xxhash64(w["a"], w["b"], w["c"]).bitwiseAND(mask).bitwiseOR(i.cast("long"))))


def hash_pairs(numbers: Column) -> Column:
    """(x, y): places of neighbours among the numbers whose hash bits are equal."""
    mask = F.lit(-(1 << PLACE_BITS)).cast("long")
    place = lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1).cast("long")).cast("int")
    pair = lambda x, y: F.when(x.bitwiseXOR(y).bitwiseAND(mask) == 0, F.struct(place(x).alias("x"), place(y).alias("y")))
    return F.filter(F.zip_with(numbers, F.slice(numbers, 2, F.greatest(F.size(numbers), F.lit(1))), pair), lambda p: p.isNotNull())


def places_of(pairs: Column) -> Column:
    """The words that pairs of equal windows cover."""
    return F.array_distinct(F.flatten(F.transform(pairs, lambda p: F.array(*[p[z] + k for z in "xy" for k in range(3)]))))


def exact_pairs(own: Column) -> Column:
    """Like ``hash_pairs`` for any length and any clash of hashes: windows sorted by their words."""
    full = F.sort_array(F.transform(own, lambda w, i: F.struct(w["a"].alias("a"), w["b"].alias("b"), w["c"].alias("c"), i.alias("i"))))
    same = lambda x, y: F.when((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.struct(x["i"].alias("x"), y["i"].alias("y")))
    pairs = F.zip_with(full, F.slice(full, 2, F.greatest(F.size(full), F.lit(1))), same)
    return F.filter(pairs, lambda p: p.isNotNull())


def metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_shout_words.

    Null texts count as empty: every metric is 0. Nothing is shuffled; no metric looks at a prefix.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    tokens = barrier(docs, __w=words(F.col(text)), __l=lines)
    own = barrier(tokens, __v=windows(F.col("__w")))
    held = barrier(own, __s=numbered(F.col("__v")))
    found = barrier(held, __p=hash_pairs(F.col("__s")))
    # equal hash bits with other words, or more windows than places fit: sort the words themselves
    clash = (F.size("__v") >= 1 << PLACE_BITS) | F.exists("__p", lambda p: F.element_at("__v", p["x"] + 1) != F.element_at("__v", p["y"] + 1))
    places = F.when(F.size("__v") == 0, 0).when(clash, F.size(places_of(exact_pairs(F.col("__v"))))).otherwise(F.size(places_of(F.col("__p"))))
    return found.select(
        *docs.columns,
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count(body, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.size("__l").cast("long").alias("n_lines"),
        places.cast("long").alias("n_repeat_words"),
        F.regexp_count(body, F.lit(r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D]{2})[^\x20\x09-\x0D\p{Ll}]*\p{Lu}[^\x20\x09-\x0D\p{Ll}]*(?![^\x20\x09-\x0D])")).cast("long").alias("n_shout_words"),
    )


def sketches(rated: DataFrame, levels: list[tuple[str, ...]], rules: dict) -> list[DataFrame]:
    """Per level, finest first: its columns, ``rule, bin, n``. Rows combine before the shuffle."""
    x = "greatest(length(bin(v)) - {}, 0)".format(SKETCH_BITS)
    each = rated.select(*levels[0], F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"__{k}").alias("v")) for k in rules])).alias("r")).select(*levels[0], "r.rule", "r.v")
    out = [each.withColumn("bin", F.expr(f"shiftleft(shiftright(v, {x}), {x})")).groupBy(*levels[0], "rule", "bin").agg(F.count(F.lit(1)).alias("n"))]
    for level in levels[1:]:
        out.append(out[0].groupBy(*level, "rule", "bin").agg(F.sum("n").alias("n")))
    return out


def quantiles(sketch: DataFrame, level: tuple[str, ...]) -> DataFrame:
    """``rule, n, low, middle`` per group: the first bin that reaches the percentile."""
    group = Window.partitionBy(*level, "rule")
    seen = sketch.select("*", F.sum("n").over(group.orderBy("bin")).alias("upto"), F.sum("n").over(group).alias("total"))
    at = lambda p: F.min(F.when(100 * F.col("upto") >= p * F.col("total"), F.col("bin")))
    return seen.groupBy(*level, "rule").agg(F.first("total").alias("n"), at(LOW).alias("low"), at(MIDDLE).alias("middle"))


def thresholds(rated: DataFrame, groups: tuple[str, ...], rules: dict = RULES) -> DataFrame:
    """``__g_<group>`` and ``__max_<rule>`` (millionths), a row per group with a document among ``rated``."""
    levels = [groups[:i] for i in range(len(groups), -1, -1)]
    above = None
    for level, sketch in list(zip(levels, sketches(rated, levels, rules), strict=True))[::-1]:
        own = quantiles(sketch, level)
        if above is None:
            above = own
            continue
        up = above.select(*[F.col(c).alias(f"__u_{c}") for c in level[:-1]], F.col("rule").alias("__u_rule"), F.col("low").alias("__u_low"), F.col("middle").alias("__u_middle"))
        met = own.join(up, reduce(and_, [F.col(c).eqNullSafe(F.col(f"__u_{c}")) for c in (*level[:-1], "rule")]))
        drawn = lambda q: F.expr(f"(n * {q} + {PRIOR} * __u_{q}) div (n + {PRIOR})").alias(q)
        above = met.select(*level, "rule", "n", drawn("low"), drawn("middle"))
    limit = lambda k: F.max(F.when(F.col("rule") == k, F.col("middle") + SPREADS * (F.col("middle") - F.col("low") + rules[k]))).alias(f"__max_{k}")
    return above.groupBy(*[F.col(g).alias(f"__g_{g}") for g in groups]).agg(*[limit(k) for k in rules])


def judge(measured: DataFrame, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT, groups: tuple[str, ...] = ("lang", "source"), rules: dict = RULES) -> DataFrame:
    """Adds base_failed, adaptive_failed and kept; a verdict per row, whatever its key.

    Groups are null-safe: documents without language or source form a group of their own. Where all
    of a group fail the fixed rules, ``adaptive_failed`` is false.
    """
    n = F.greatest(F.col("n_words"), F.lit(1))
    parts = {"symbol_ratio": (F.col("n_symbols"), n), "shout_ratio": (F.col("n_shout_words"), n), "dup_line_ratio": (F.col("n_dup_lines"), F.greatest(F.col("n_lines"), F.lit(1)))}
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    ratios = [F.floor(F.lit(1_000_000).cast("long") * x / y).alias(f"__{k}") for k, (x, y) in parts.items() if k in rules]
    rated = measured.select("*", failed.alias("base_failed"), *ratios)
    limits = thresholds(rated.filter(~F.col("base_failed")), groups, rules)
    joined = rated.join(limits, reduce(and_, [F.col(g).eqNullSafe(F.col(f"__g_{g}")) for g in groups]), "left")
    bad = reduce(or_, [F.coalesce(F.col(f"__{k}") > F.col(f"__max_{k}"), F.lit(False)) for k in rules])
    return joined.select(*measured.columns, "base_failed", bad.alias("adaptive_failed"), (~F.col("base_failed") & ~bad).alias("kept"))


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", groups: tuple[str, ...] = ("lang", "source"), keep: tuple[str, ...] = (), **options) -> DataFrame:
    """One row per input row: ``key``, the groups, ``keep``, the metrics and the verdict.

    Null texts are empty ones, and fail the fixed rules. Rows that repeat a key, or have none, are
    measured and judged each for itself, and all count in the sketches. An empty table gives no rows.
    Just ``key``, ``text``, ``groups`` and ``keep`` are read, so further columns can have any names.
    What is measured is cut into the shared folder, since both the sketches and the join read it;
    the texts go with it only if ``keep`` names them.
    """
    held = F.struct(F.lit(0).alias("__"), *[F.col(c).alias(f"x{i}") for i, c in enumerate(keep)]).alias("__x")
    narrow = cut(metrics(docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"), *[F.col(g).alias(f"__in{i}") for i, g in enumerate(groups)], held), "__text").drop("__text"))
    judged = judge(narrow.withColumnsRenamed({f"__in{i}": g for i, g in enumerate(groups)}), groups=groups, **options)
    more = [c for c in judged.columns if not c.startswith("__") and c not in groups]
    return judged.select(F.col("__key").alias(key), *groups, *more, *[F.col(f"__x.x{i}").alias(c) for i, c in enumerate(keep) if c not in (key, *groups)])
