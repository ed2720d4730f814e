"""Secret scans with multipart credential linking. DataFrame functions only.

Base finds (always reported): assignments of secrets, access identifiers, long hex runs. Weak finds
(short identifiers, bare mixed-case tokens, endpoints) are reported only where the complementary
parts of one credential lie within ``reach`` code points of each other in the same document; an
interval join on (document, stretch of text) decides that. It is a semi-join: it gives out no pairs.

Spans are (start, kind, end) in code points, end exclusive. Null and empty texts have none. Every row is
a document of its own, by a row number given before lineage is cut, so rows that repeat a key or have
none are scanned and linked each for itself. Only the key and the text of a document are read, so
further columns can have any names. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import barrier, cut

#: kinds in the order in which spans with equal starts are listed
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
#: kind -> (pattern, least code points of the match or of its group, group)
BASE = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 1),
    "access": (r"AKIA[A-Z0-9]+", 18, 0),
    "hex": (r"[0-9a-f]{16,}", 16, 0),  # shorter runs fail anyway, and runs are maximal either way
}
WEAK = {
    "weak_id": (r"\b(?:(?:A3T|ASIA|AGPA|AIDA|AROA|ANPA)[A-Z0-9]{8,}|AKIA[A-Z0-9]{8,13})\b", 11, 0),  # longer AKIA ones are base
    "weak_secret": (r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*[0-9])(?=[A-Z0-9+/]*[a-z])(?=[a-z0-9+/]*[A-Z])[A-Za-z0-9+/]{20,}(?![A-Za-z0-9+/])", 20, 0),
    "endpoint": (r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9._~/-]*)?", 10, 0),
}
IDS, SECRETS = ("access", "weak_id"), ("assign", "hex", "weak_secret")
#: weak kind -> the groups of kinds that all have to be near
NEEDS = {"weak_id": (SECRETS,), "weak_secret": (IDS,), "endpoint": (IDS, SECRETS)}
REACH = 400
_SPAN = "struct<start:bigint,kind:int,end:bigint>"
_BLOCK = 256


def find(text: Column, kind: str, pattern: str, least: int, group: int) -> Column:
    """Spans of the leftmost non-overlapping matches with ``least`` code points (of ``group``).

    Spark gives matches without their places, which follow from lengths: the text between matches
    and the matches alternate. One fold adds the lengths up; finds gather in blocks, so that a text
    with very many of them isn't copied again and again.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"), F.transform(found, F.length).alias("len"), F.transform(value, F.length).alias("value"))
    none, blocks = F.array().cast(f"array<{_SPAN}>"), F.array().cast(f"array<array<{_SPAN}>>")

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        end = start + F.coalesce(p["len"], F.lit(0))
        span = F.array(F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end")))
        full = F.size(acc["now"]) >= _BLOCK
        now = F.when(p["value"] >= least, F.concat(F.when(full, none).otherwise(acc["now"]), span)).otherwise(acc["now"])
        done = F.when((p["value"] >= least) & full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"])
        return F.struct(end.alias("at"), now.alias("now"), done.alias("done"))

    zero = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("now"), blocks.alias("done"))
    spans = F.aggregate(parts, zero, step, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["now"]))))
    return F.when(text.rlike(pattern), spans).otherwise(none)


def scan(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``__row``, ``key``, ``base`` and ``weak`` spans per row; a weak find that touches a base one is left out."""
    body = F.coalesce(F.col(text), F.lit(""))
    base = F.sort_array(F.concat(*[find(F.col("__t"), k, *p) for k, p in BASE.items()]))
    weak = F.sort_array(F.concat(*[find(F.col("__t"), k, *p) for k, p in WEAK.items()]))
    held = barrier(barrier(docs.select(F.monotonically_increasing_id().alias("__row"), F.col(key).alias("__k"), body.alias("__t")), base=base), weak=weak)
    clear = F.filter("weak", lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    return held.select("__row", F.col("__k").alias(key), "base", F.when(F.size("weak") > 0, clear).otherwise(F.col("weak")).alias("weak"))


def link(scanned: DataFrame, reach: int = REACH) -> DataFrame:
    """Weak spans whose complementary parts are near: ``__row2, linked`` (sorted spans).

    Both sides are dealt by row and stretches of ``reach`` code points; a stretch holds few finds
    whatever the document's length, and a find is compared with those of three stretches.
    """
    parts = scanned.filter(F.size("weak") > 0).select("__row", F.explode(F.concat("base", "weak")).alias("s")).select("__row", "s.*")
    at = lambda kinds: parts.filter(F.col("kind").isin([KINDS.index(k) for k in kinds]))
    found = []
    for kind, needs in NEEDS.items():
        weak = at((kind,))
        for group in needs:
            near = at(group).select(F.col("__row").alias("r2"), F.col("start").alias("s2"), F.col("end").alias("e2"), F.explode(F.sequence(F.floor(F.col("start") / reach), F.floor(F.col("end") / reach))).alias("cell2"))
            probes = weak.select("*", F.explode(F.sequence(F.floor(F.col("start") / reach) - 1, F.floor(F.col("end") / reach) + 1)).alias("cell"))
            close = (F.col("s2") - F.col("end") <= reach) & (F.col("start") - F.col("e2") <= reach) & (F.col("s2") != F.col("start"))
            weak = probes.join(near, (F.col("__row") == F.col("r2")) & (F.col("cell") == F.col("cell2")) & close, "left_semi").select("__row", "start", "kind", "end").distinct()
        found.append(weak)
    spans = reduce(DataFrame.unionByName, found)
    return spans.groupBy(F.col("__row").alias("__row2")).agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("linked"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """One row per input row: ``key``, ``base`` and ``linked`` span arrays."""
    scanned = cut(scan(docs, key, text))
    joined = scanned.join(link(scanned, reach), F.col("__row") == F.col("__row2"), "left")
    return joined.select(key, "base", F.coalesce("linked", F.array().cast(f"array<{_SPAN}>")).alias("linked"))
