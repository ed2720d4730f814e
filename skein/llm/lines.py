"""Line dedup over content-defined chunks of lines. DataFrame functions only.

A rolling hash runs over every two neighbouring lines' hashes. Of each two neighbouring windows the one with
the smaller hash is a boundary: which windows are chosen depends on their lines and the next ones only, so
boundaries survive shifts, and any three lines shared by two texts hold one that both choose. A chunk lies around a
boundary: its two lines, and the line before and after where those agree as well. Lines inside a longer
repeated passage all belong to some chunk, so a passage goes to its ends.

A chunk of ``MIN_CHARS`` characters or more whose bytes occur before, in the order of document and place, anywhere
in the corpus is removed after its bytes are compared with those of the first occurrence. Texts are
judged on the input, not on what is left; the earliest place of a line always stays.

Null texts are empty; a text of one line has no chunk; blank lines are lines. Rows that repeat a key, or have none,
are documents each, told apart by a row number; null keys come first. Just the named columns are read, so
further ones can have any names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.bitmaps import filter_of, split
from skein.llm.common import barrier, written

MIN_CHARS, MULTIPLIER, PRIME = 80, 31, 1_000_003


def line_hash(line: Column) -> Column:
    """28 bits of the line's MD5, which SQL engines agree on."""
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def chunked(docs: DataFrame, key: str, text: str, keep: tuple[str, ...] = (), min_chars: int = MIN_CHARS) -> DataFrame:
    """``__row, __k, __x, lines, chosen``: a document's lines, and (place, digest) of its boundaries.

    The place is that of the window's second line, from 0. ``__x`` holds the columns ``keep``.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.monotonically_increasing_id().alias("__row"), F.col(key).alias("__k"), F.struct(F.lit(0).alias("__"), *[F.col(c).alias(f"x{i}") for i, c in enumerate(keep)]).alias("__x"), body.alias("__t"))
    lines = barrier(base, lines=F.split("__t", "\n", -1)).drop("__t")
    rest = lambda c: F.slice(c, 2, F.greatest(F.size(c), F.lit(1)))
    hashed = barrier(lines, __h=F.transform("lines", lambda x: line_hash(x)))
    rolled = barrier(hashed, __r=F.slice(F.zip_with("__h", rest(F.col("__h")), lambda a, b: (MULTIPLIER * a + b) % PRIME), 1, F.size("__h") - 1))
    # the smaller of each two neighbours, the first of equal ones
    least = F.array_distinct(F.slice(F.transform(F.zip_with("__r", rest(F.col("__r")), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda z, i: F.when(z["b"] < z["a"], i + 1).otherwise(i)), 1, F.greatest(F.size("__r") - 1, F.lit(0))))
    places = F.when(F.size("__r") == 1, F.array(F.lit(0))).otherwise(least)
    at = barrier(rolled, __p=places)
    window = lambda i: F.concat_ws("\n", F.get("lines", i), F.get("lines", i + 1))
    long_ = F.filter("__p", lambda i: F.length(F.get("lines", i)) + F.length(F.get("lines", i + 1)) + 1 >= min_chars)
    return at.select("__row", "__k", "__x", "lines", F.transform(long_, lambda i: F.struct((i + 1).alias("place"), F.unhex(F.md5(window(i))).alias("digest"))).alias("chosen"))


def repeated(parted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``digest, first_row, first_place`` of digests with several places, and all places ``__row, __k, place, digest``.

    Digests are counted before anything else moves, combined before the shuffle: one that a third of
    all documents share costs a row per task.
    """
    each = parted.select("__row", "__k", F.explode("chosen").alias("c")).select("__row", "__k", "c.place", "c.digest")
    first = F.min(F.struct("__k", "__row", "place"))
    counted = each.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), first.alias("first")).filter("n > 1")
    return counted.select("digest", F.col("first.__row").alias("first_row"), F.col("first.place").alias("first_place"), "first"), each


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, keep: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the columns ``keep``, ``kept_text, n_lines, n_removed_lines, n_removed_chunks`` per row.

    ``n_removed_chunks`` counts maximal runs of removed lines. Texts are cut into chunks once and written. Bytes are
    fetched for repeated digests only, and only documents with something to compare meet them; filters of
    fixed size hold the others back from the shuffles. The join with a hot digest is one that adaptive
    execution splits, since both its sides come from exchanges.
    """
    parted = written(chunked(docs, key, text, keep, min_chars), "lines")
    counted, each = repeated(parted)
    several = written(counted, "lines-repeated")
    # the bytes of first occurrences, with a line more on either side
    sources, _ = split(parted.select("__row", "lines"), "__row", filter_of(several, "first_row"))
    told = sources.join(several.select("digest", "first_row", "first_place", "first"), F.col("__row") == F.col("first_row"))
    at = lambda d: F.get("lines", F.col("first_place") + d)
    bodies = written(told.select(F.col("digest").alias("d2"), "first", at(-2).alias("before"), at(-1).alias("one"), at(0).alias("two"), at(1).alias("after")), "lines-bodies")
    possible, _ = split(each, "digest", filter_of(several, "digest"))
    later = possible.join(bodies, F.col("digest") == F.col("d2")).filter(F.struct("__k", "__row", "place") > F.col("first"))
    chunk = F.struct("place", "before", "one", "two", "after")
    per_doc = written(later.groupBy(F.col("__row").alias("__row2")).agg(F.collect_list(chunk).alias("cand")), "lines-later")
    touched, clean = split(parted.select("__row", "__k", "__x", "lines"), "__row", filter_of(per_doc, "__row2"))
    met = touched.join(per_doc, F.col("__row") == F.col("__row2"), "left").select("__k", "__x", "lines", F.coalesce("cand", F.array().cast(per_doc.schema["cand"].dataType)).alias("cand"))
    # the comparison of bytes: a chunk goes only if it is the first occurrence's text, not just its digest
    line = lambda c, d: F.get("lines", c["place"] + d)
    same = F.filter("cand", lambda c: (line(c, -1) == c["one"]) & (line(c, 0) == c["two"]))
    more = lambda c, d, name: F.when(F.coalesce(line(c, d) == c[name], F.lit(False)), c["place"] + d)
    gone = F.flatten(F.transform(same, lambda c: F.array(c["place"] - 1, c["place"], more(c, -2, "before"), more(c, 1, "after"))))
    found = barrier(met.select("__k", "__x", "lines", F.array_sort(F.array_distinct(F.filter(gone, lambda p: p.isNotNull()))).alias("gone")), gone=F.col("gone"))
    starts = F.filter("gone", lambda p, i: (i == 0) | (F.get("gone", i - 1) < p - 1))
    ends = F.filter("gone", lambda p, i: (i == F.size("gone") - 1) | (F.get("gone", i + 1) > p + 1))
    runs = barrier(found, starts=starts, ends=ends)
    stops = F.concat(F.array(F.lit(0)), F.transform("ends", lambda e: e + 1))
    nexts = F.concat(F.col("starts"), F.array(F.size("lines")))
    kept = F.flatten(F.zip_with(stops, nexts, lambda a, b: F.slice(F.col("lines"), a + 1, F.greatest(b - a, F.lit(0)))))
    names = [F.col("__k").alias(key), *[F.col(f"__x.x{i}").alias(c) for i, c in enumerate(keep)]]
    cleaned = runs.select(*names, F.array_join(kept, "\n").alias("kept_text"), F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed_lines"), F.size("starts").cast("long").alias("n_removed_chunks"))
    untouched = clean.select(*names, F.array_join("lines", "\n").alias("kept_text"), F.size("lines").cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed_lines"), F.lit(0).cast("long").alias("n_removed_chunks"))
    return cleaned.unionByName(untouched)
