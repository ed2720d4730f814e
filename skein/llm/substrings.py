"""Suffix-array dedup of repeated byte strings across documents, exact for every position.

Every byte covered by a string of ``LENGTH`` bytes that also starts in a document with a smaller key
is marked. Strings don't cross documents and are judged on the input.

Sorting all suffixes would move ``LENGTH`` times the corpus, so suffixes are grouped first. Of the
grams in a string's window, the one with the smallest hash is its anchor: equal strings have equal
anchors at equal offsets. Consecutive strings with one anchor form a run of up to W strings.

1. Map: runs as (leading tokens: the bytes of the anchor gram, with which the run's suffixes begin; context: a
   hash of the whole run). Runs equal to one of a smaller key in the same task are settled there; a text that a
   third of all rows share leaves a task once.
2. Splitters sampled from the suffixes range-partition runs by (leading bytes, context) into cells. A task takes
   one cell after another and sorts it by multikey quicksort, with characters of 8 bytes. Equal runs: all but those
   of the smallest key are covered. Runs that share leading bytes but not the context can share a string only if
   the half before or the half after the gram agrees too; a run carries 16 bits of a hash of each (its sides), and
   those with a side that another key has go on.
3. Their bytes are fetched; in the same ranges, the suffixes of runs with the same leading bytes are sorted byte
   by byte by multikey quicksort, and equal strings next to each other are compared. Leading bytes that
   lie across a boundary, or have more than ``LIMIT`` contexts, are compared across cells instead: their sides
   meet first, and the strings of runs that share one are dealt by all of their bytes, settled before and after.
4. Spans meet their documents, which are cut. A filter of fixed size holds documents without spans back from the
   shuffle, here and where bytes are fetched.

The files of a step's shuffles go when the step is written, runs and bytes when the spans are.

A cell's runs come from about ``CELL_BYTES`` of text; beyond ``MANY_CELLS`` cells they grow with the square root of
the corpus, so that neither the cells in memory nor the pieces a task sends get out of hand. Contexts are 64-bit
hashes within equal 16 leading bytes; strings that differ only in part are compared by their bytes. Rows with a null
key neither remove nor lose anything; null texts are empty. Repeated rows of a key don't count against each other, and
each gets its own spans. Just key and text are read, so further columns can have any names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.bitmaps import filter_of, split
from skein.llm.common import removed, sampled, shuffle_partitions, step, step_folder

LENGTH = 50
LIMIT = 8_000
#: bytes hashed at once (which takes about 90 times as much), bytes gathered before runs are sorted and sent, longest piece of a text
CHUNK, GATHER, PIECE = 1 << 18, 1 << 23, 1 << 18
#: bytes that a task hands over at once
SENT = 1 << 20
CELL_BYTES, MANY_CELLS = 1 << 23, 16_384
#: runs whose strings are laid out at once
STRINGS = 4_000
SAMPLE_DOCS = 2_000
_RANDOM = np.random.default_rng(20240101)
_TABLE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RANDOM.integers(1 << 40, 1 << 62)) * 8 + 5
_LOW = np.uint64((1 << 24) - 1)


def gram_size(length: int) -> int:
    """At most 16: a gram's bytes are two characters of 8."""
    return min(16, max(4, length * 9 // 25))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _window_hashes(data: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Polynomial hashes (mod 2^64, over random byte values) of all windows of each size, by doubling."""
    powers: dict[int, np.ndarray] = {1: _TABLE[data]}
    n = 1
    while n * 2 <= max(sizes):
        c = powers[n]
        powers[2 * n] = c[: len(c) - n] * np.uint64(pow(_BASE, n, 1 << 64)) + c[n:]
        n *= 2
    out = []
    for size in sizes:
        total, done = None, 0
        for p in sorted((p for p in powers if size & p), reverse=True):
            c = powers[p]
            keep = len(data) - size + 1
            part = c[done : done + keep]
            total = part.copy() if total is None else total[:keep] * np.uint64(pow(_BASE, p, 1 << 64)) + part
            done += p
        out.append(total[: len(data) - size + 1])
    return out


def _runs_of(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs in joined texts: (leading bytes, the next 8, context, first string, number of strings, sides).

    ``ends`` gives for each byte the end of its text; strings that cross an end don't count.
    """
    size = gram_size(length)
    wide = length - size + 1
    half = (length - size + 1) // 2
    none = (*(np.empty(0, np.uint64) for _ in range(3)), *(np.empty(0, np.int64) for _ in range(2)), np.empty(0, np.uint32))
    if len(data) < length:
        return none
    grams, whole, halves = _window_hashes(data, (size, length, max(1, half)))
    mixed = _mix(grams)
    least = (mixed & ~_LOW) | np.arange(len(mixed), dtype=np.uint64)
    n = 1
    while n * 2 <= wide:
        least = np.minimum(least[: len(least) - n], least[n:])
        n *= 2
    if n < wide:
        least = np.minimum(least[: len(least) - (wide - n)], least[wide - n :])
    starts = np.nonzero(np.arange(len(least)) + length <= ends[: len(least)])[0]
    if not len(starts):
        return none
    anchor = (least[starts] & _LOW).astype(np.int64)
    first = np.nonzero(np.diff(anchor, prepend=-1))[0]
    last = np.append(first[1:], len(starts)) - 1
    a, s0, s1 = anchor[first], starts[first], starts[last]
    shape = ((a - s0) * 256 + (s1 - s0)).astype(np.uint64)
    context = _mix(whole[s0] * np.uint64(0x9E3779B97F4A7C15) + _mix(whole[s1]) + shape * np.uint64(0xC2B2AE3D27D4EB4F))
    lead = np.zeros((len(a), 16), np.uint8)
    lead[:, :size] = np.lib.stride_tricks.sliding_window_view(data, size)[a]
    chars = lead.view(">u8").astype(np.uint64)
    # a string has ``half`` bytes or more before its gram or after it; where no string of the run has, the side is 0
    before, after = (np.where(ok, _side(halves[np.where(ok, at, 0)]), 0) for ok, at in ((a - s0 >= half, a - half), (s1 + length - a - size >= half, a + size if half else a)))
    return chars[:, 0].copy(), chars[:, 1].copy(), context, s0, s1 - s0 + 1, (before << 16 | after).astype(np.uint32)


def _side(hashes: np.ndarray) -> np.ndarray:
    """16 bits, never 0."""
    return np.maximum(_mix(hashes) >> np.uint64(48), np.uint64(1)).astype(np.int64)


class _Gatherer:
    """Collects the runs of many texts: arrays lead, next, context, key, crc, start, count, sides."""

    def __init__(self, length: int):
        self.length = length
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.bytes = 0
        self.pending: list[tuple[int, int, int, bytes]] = []
        self.pending_bytes = 0

    def add(self, key: int, text: str | None) -> None:
        data = (text or "").encode("utf-8", "surrogatepass")
        if len(data) < self.length:
            return
        crc = zlib.crc32(data)
        for at in range(0, max(1, len(data) - self.length + 1), PIECE):
            piece = data[at : at + PIECE + self.length - 1]
            self.pending.append((key, crc, at, piece))
            self.pending_bytes += len(piece)
        self.bytes += len(data)
        if self.pending_bytes >= CHUNK:
            self.hash()

    def hash(self) -> None:
        if not self.pending:
            return
        todo: list[tuple[int, int, int, bytes]] = []
        size = 0
        for piece in self.pending:
            if todo and size + len(piece[3]) > CHUNK + self.length - 1:
                self._hash(todo)
                todo, size = [], 0
            todo.append(piece)
            size += len(piece[3])
        self._hash(todo)
        self.pending, self.pending_bytes = [], 0

    def _hash(self, pieces: list[tuple[int, int, int, bytes]]) -> None:
        data = np.frombuffer(b"".join(p[3] for p in pieces), np.uint8)
        lens = np.array([len(p[3]) for p in pieces])
        stops = np.cumsum(lens)
        lead, then, context, start, count, sides = _runs_of(data, np.repeat(stops, lens), self.length)
        which = np.searchsorted(stops, start, "right")
        keys, crcs, offsets = (np.array([p[i] for p in pieces], np.int64) for i in range(3))
        self.parts.append((lead, then, context, keys[which], crcs[which], start - (stops - lens)[which] + offsets[which], count.astype(np.int64), sides))

    def take(self) -> tuple[np.ndarray, ...]:
        self.hash()
        parts, self.parts, self.bytes = self.parts, [], 0
        if not parts:
            return (*(np.empty(0, np.uint64) for _ in range(3)), *(np.empty(0, np.int64) for _ in range(4)), np.empty(0, np.uint32))
        columns = list(zip(*parts, strict=True))[::-1]
        del parts
        return tuple(np.concatenate(columns.pop()) for _ in range(len(columns)))  # each column's parts go as it is joined


def _planes(a: np.ndarray) -> bytes:
    """Bytes of equal weight together, so that empty ones compress away."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def _unplanes(b: bytes, n: int, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(np.dtype(kind).itemsize, n).T).reshape(-1).view(kind)


def pack(runs: tuple[np.ndarray, ...]) -> bytes:
    """Sorted runs as one compressed value; keys and checksums once per text."""
    lead, then, context, key, crc, start, count, sides = runs
    n = len(lead)
    texts, which = np.unique(np.stack([key, crc], axis=1), axis=0, return_inverse=True) if n else (np.empty((0, 2), np.int64), np.empty(0, np.int64))
    body = b"".join([
        struct.pack("<qq", n, len(texts)), _planes(np.diff(lead, prepend=np.uint64(0))), _planes(then), _planes(context), _planes(which.reshape(-1).astype(np.uint32)), _planes(start.astype(np.int64)), count.astype(np.uint8).tobytes(),
        _planes(np.diff(texts[:, 0], prepend=0)), _planes(texts[:, 1].astype(np.uint32)), _planes(sides),
    ])
    return zstandard.ZstdCompressor(level=1).compress(body)


def unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    body = zstandard.ZstdDecompressor().decompress(blob)
    n, m = struct.unpack_from("<qq", body)
    at = 16

    def read(width: int, rows: int, kind: type) -> np.ndarray:
        nonlocal at
        out = _unplanes(body[at : at + width * rows], rows, kind)
        at += width * rows
        return out

    lead = np.cumsum(read(8, n, np.uint64), dtype=np.uint64)
    then, context, which, start = read(8, n, np.uint64), read(8, n, np.uint64), read(4, n, np.uint32), read(8, n, np.int64)
    count = np.frombuffer(body, np.uint8, n, at).astype(np.int64)
    at += n
    key = np.cumsum(read(8, m, np.int64), dtype=np.int64)
    crc = read(4, m, np.uint32).astype(np.int64)
    return lead, then, context, key[which], crc[which], start, count, read(4, n, np.uint32)


def _pick(runs: tuple[np.ndarray, ...], where: np.ndarray) -> tuple[np.ndarray, ...]:
    return tuple(c[where] for c in runs)


def multikey(chars: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorts rows of 8-byte characters: (order, whether each sorted row differs from the one before).

    Multikey quicksort: rows are parted by one character, and only rows that are equal so far go on to
    the next.
    """
    n = len(chars[0])
    order = np.argsort(chars[0], kind="quicksort")
    new = np.ones(n, bool)
    new[1:] = chars[0][order[1:]] != chars[0][order[:-1]]
    for c in chars[1:]:
        begins = np.nonzero(new)[0]
        sizes = np.diff(np.append(begins, n))
        group = np.repeat(np.arange(len(begins)), sizes)
        tied = np.nonzero(np.repeat(sizes > 1, sizes))[0]
        if not len(tied):
            break
        rows = order[tied]
        inner = np.lexsort((c[rows], group[tied]))
        order[tied] = rows[inner]
        values = c[order[tied]]
        differs = np.ones(len(tied), bool)
        differs[1:] = (values[1:] != values[:-1]) | (group[tied][1:] != group[tied][:-1])
        new[tied] |= differs
    return order, new


def _order(runs: tuple[np.ndarray, ...]) -> np.ndarray:
    """Order by leading bytes, context, key."""
    return multikey([runs[0], runs[1], runs[2], runs[3].view(np.uint64) ^ np.uint64(1 << 63)])[0] if len(runs[0]) else np.empty(0, np.int64)


def settle_equal(runs: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """For sorted runs: which have an equal run of a smaller key, and where contexts begin."""
    lead, then, context, key = runs[:4]
    fresh = np.ones(len(lead), bool)
    fresh[1:] = (lead[1:] != lead[:-1]) | (then[1:] != then[:-1]) | (context[1:] != context[:-1])
    smallest = key[np.nonzero(fresh)[0]][np.cumsum(fresh) - 1] if len(lead) else key
    return key > smallest, fresh


def n_cells(total: int, least: int) -> int:
    """How many ranges for ``total`` bytes of text."""
    n = total / CELL_BYTES
    return max(least, int(n if n <= MANY_CELLS else MANY_CELLS * math.sqrt(n / MANY_CELLS)))


def splitters(docs: DataFrame, rows: int, cells: int, length: int) -> np.ndarray:
    """``cells - 1`` sorted (leading bytes, next, context) rows from the suffixes of about ``SAMPLE_DOCS`` texts.

    They balance cells; results don't depend on them. A boundary lies where its leading bytes begin (context
    0), but for bytes so frequent that several boundaries fall on them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Gatherer(length)
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held.add(k, t.as_py())
                if held.bytes >= GATHER:
                    yield thin(held.take())
        yield thin(held.take())

    def thin(runs: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        chosen = _mix(runs[0] ^ (runs[2] << np.uint64(7))) % np.uint64(16) == 0 if len(runs[0]) > 50_000 else np.ones(len(runs[0]), bool)
        return pa.record_batch([pa.array(c[chosen].view(np.int64)) for c in runs[:3]], names=["lead", "then", "context"])

    keys = docs.filter(sampled(F.col("key"), SAMPLE_DOCS / max(1, rows))).mapInArrow(run, "lead long, then long, context long")
    found = keys.orderBy(F.xxhash64("lead", "then", "context")).limit(100_000).toArrow()
    columns = [found[c].to_numpy().view(np.uint64) for c in ("lead", "then", "context")]
    if not len(columns[0]):
        return np.empty((0, 3), np.uint64)
    order = np.lexsort(columns[::-1])
    cuts = np.stack(columns, axis=1)[order[(np.arange(1, cells) * len(order)) // cells]]
    again = np.zeros(len(cuts), bool)
    again[1:] = (cuts[1:, :2] == cuts[:-1, :2]).all(axis=1)
    cuts[~again, 2] = 0
    return cuts


def cell_starts(runs: tuple[np.ndarray, ...], cuts: np.ndarray) -> np.ndarray:
    """Where each cell begins among sorted runs: a run belongs to the last splitter at or below it."""
    out = np.zeros(len(cuts) + 2, np.int64)
    out[-1] = len(runs[0])
    low, high = np.searchsorted(runs[0], cuts[:, 0], "left"), np.searchsorted(runs[0], cuts[:, 0], "right")
    for i in np.nonzero(high > low)[0].tolist():
        a, b = low[i], high[i]
        for c in (1, 2):
            a, b = a + np.searchsorted(runs[c][a:b], cuts[i, c], "left"), a + np.searchsorted(runs[c][a:b], cuts[i, c], "right")
        low[i] = a
    out[1:-1] = low
    return out


_OUT = "kind int, key long, crc long, start long, count int, cell int, lead long, then long"
_NAMES = ["kind", "key", "crc", "start", "count", "cell", "lead", "then"]


def _rows(kind: int, key: np.ndarray, crc: np.ndarray, start: np.ndarray, count: np.ndarray, cell: int = 0, lead: np.ndarray | None = None, then: np.ndarray | None = None) -> pa.RecordBatch:
    none = np.zeros(len(key), np.int64)
    given = [none if x is None else x.view(np.int64) for x in (lead, then)]
    return pa.record_batch([pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(crc), pa.array(start), pa.array(count.astype(np.int32)), pa.array(np.full(len(key), cell, np.int32)), *map(pa.array, given)], names=_NAMES)


def _sided(rows: pa.RecordBatch, sides: np.ndarray | None = None) -> pa.RecordBatch:
    """``_rows`` and ``sides``, which only runs that meet across cells need."""
    return rows.append_column("sides", pa.array(np.zeros(rows.num_rows, np.int64) if sides is None else sides.astype(np.int64)))


def sharing(runs: tuple[np.ndarray, ...], group: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Which of the runs ``free`` have a side in common with one of another key in their ``group``."""
    key, sides = runs[3], runs[7].astype(np.int64)
    out = np.zeros(len(key), bool)
    for side in (sides >> 16, sides & 0xFFFF):
        own = np.nonzero(free & (side > 0))[0]
        if not len(own):
            continue
        code = group[own] << 16 | side[own]
        order = np.argsort(code, kind="stable")
        own, code = own[order], code[order]
        fresh = np.ones(len(own), bool)
        fresh[1:] = code[1:] != code[:-1]
        at = np.nonzero(fresh)[0]
        several = np.minimum.reduceat(key[own], at) < np.maximum.reduceat(key[own], at)
        out[own[several[np.cumsum(fresh) - 1]]] = True
    return out


COVERED, OPEN, WIDE = 0, 1, 2  # settled spans; runs to compare in a cell; runs to compare across cells


def find_runs(docs: DataFrame, length: int, limit: int, cells: int, rows: int) -> DataFrame:
    """Steps 1 and 2 over ``key, text``: rows of ``_OUT`` and ``sides``."""
    n = shuffle_partitions(docs.sparkSession)
    cuts = splitters(docs, rows, cells, length)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Gatherer(length)
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held.add(k, t.as_py())
                if held.bytes >= GATHER:
                    yield from batched(deal(held.take()))
        yield from batched(deal(held.take()))

    def deal(runs: tuple[np.ndarray, ...]) -> Iterator[tuple[int, int, bytes]]:
        runs = _pick(runs, _order(runs))
        covered, _ = settle_equal(runs)
        done = np.nonzero(covered)[0]
        for at in range(0, len(done), 100_000):
            part = done[at : at + 100_000]
            yield int(runs[3][part[0]]) % n, -1, pack(_pick(runs, part))
        runs = _pick(runs, ~covered)
        starts = cell_starts(runs, cuts)
        for i in np.nonzero(np.diff(starts))[0].tolist():
            yield i * n // cells, i, pack(tuple(c[starts[i] : starts[i + 1]] for c in runs))

    def batched(pieces: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, bytes]] = []
        size = 0
        for piece in pieces:
            out.append(piece)
            size += len(piece[2])
            if size >= SENT or len(out) >= 64:
                yield batch(out)
                out, size = [], 0
        if out:
            yield batch(out)

    def batch(out: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        ids, numbers, blobs = zip(*out, strict=True)
        return pa.record_batch([pa.array(ids, pa.int32()), pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "cell", "blob"])

    across = {(int(a), int(b)) for a, b, c in cuts if c}

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        now = -1
        for b in batches:
            for cell, blob in zip(b["cell"].to_pylist(), b["blob"], strict=True):
                if cell < 0:  # spans that a task settled by itself
                    runs = unpack(blob.as_py())
                    yield _sided(_rows(COVERED, *runs[3:7]))
                    continue
                if cell != now:
                    yield from settle(now, parts)
                    now, parts = cell, []
                parts.append(blob.as_py())
        yield from settle(now, parts)

    def settle(cell: int, parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        runs = tuple(np.concatenate(c) for c in zip(*map(unpack, parts), strict=True))
        runs = _pick(runs, _order(runs))
        covered, fresh = settle_equal(runs)
        lead, then = runs[:2]
        first = np.ones(len(lead), bool)
        first[1:] = (lead[1:] != lead[:-1]) | (then[1:] != then[:-1])
        at = np.nonzero(first)[0]
        which = np.cumsum(first) - 1
        shared = sharing(runs, which, ~covered & (np.diff(np.append(at, len(lead))) > 1)[which])
        contexts = np.add.reduceat((fresh & shared).astype(np.int64), at)
        wide = np.zeros(len(at), bool)
        if across:
            near = np.nonzero(np.isin(lead[at], np.fromiter((a for a, _ in across), np.uint64, len(across))))[0]
            wide[near] = [(int(lead[at[i]]), int(then[at[i]])) in across for i in near]
        kind = np.where(wide[which] | (shared & (contexts > limit)[which]), WIDE, np.where(shared, OPEN, -1))
        kind[covered] = COVERED
        for k in (COVERED, OPEN, WIDE):
            some = np.nonzero(kind == k)[0]
            for i in range(0, len(some), 100_000):
                got = _pick(runs, some[i : i + 100_000])
                yield _sided(_rows(k, *got[3:7], cell, got[0], got[1]), got[7] if k == WIDE else None)

    sent = docs.mapInArrow(send, "bucket int, cell int, blob binary")
    return sent.repartitionById(n, F.col("bucket")).sortWithinPartitions("cell").mapInArrow(meet, f"{_OUT}, sides long")


def meeting(runs: DataFrame) -> DataFrame:
    """Of the WIDE rows of ``find_runs``, those with a side that a run of another key shares, wherever it is; rows of ``_OUT``."""
    own = F.explode(F.array(F.struct(F.lit(0).alias("n"), F.shiftright("sides", 16).alias("value")), F.struct(F.lit(1).alias("n"), F.col("sides").bitwiseAND(F.lit(0xFFFF).cast("long")).alias("value"))))
    each = runs.withColumn("side", own).filter("side.value <> 0").withColumn("part", F.xxhash64("lead", "then", "side"))
    parts = each.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low < high").select("part")
    asked, _ = split(each, "part", filter_of(parts, "part"))
    return asked.join(parts, "part", "left_semi").select(*_NAMES).distinct()


def multikey_order(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``multikey`` of rows of bytes."""
    n, width = strings.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = strings
    chars = padded.view(">u8").astype(np.uint64)
    return multikey(list(chars.T)) if n else (np.empty(0, np.int64), np.empty(0, bool))


def _bytes_hash(strings: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of bytes."""
    padded = np.zeros((len(strings), -(-strings.shape[1] // 8) * 8), np.uint8)
    padded[:, : strings.shape[1]] = strings
    out = np.zeros(len(strings), np.uint64)
    for c in padded.view(np.uint64).T:
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + c)
    return out


def _suffixes(runs: list[bytes], counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All strings of the runs: (bytes, run, place in the run)."""
    data = np.frombuffer(b"".join(runs), np.uint8)
    lens = np.array([len(r) for r in runs])
    begin = np.cumsum(lens) - lens
    which = np.repeat(np.arange(len(runs)), counts)
    place = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = begin[which] + place
    return np.lib.stride_tricks.sliding_window_view(data, length)[at], which, place


def _settle_strings(strings: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which strings a smaller key has too, and the order in which equal ones are neighbours."""
    order, new = multikey_order(strings)
    sorted_ = owner[order]
    covered = np.zeros(len(owner), bool)
    if len(owner):
        least = np.minimum.reduceat(sorted_, np.nonzero(new)[0])[np.cumsum(new) - 1]
        covered[order] = sorted_ > least
    return covered, order


def _spans(key: np.ndarray, crc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Covered strings as spans: those that start one byte after another become one."""
    order = np.lexsort((start, crc, key))
    key, crc, start = key[order], crc[order], start[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (crc[1:] != crc[:-1]) | (start[1:] - start[:-1] > 1)
    at = np.nonzero(fresh)[0]
    end = start[np.append(at[1:], len(key)) - 1] if len(at) else at
    return key[at], crc[at], start[at], end - start[at] + 1


def _covered_rows(key: np.ndarray, crc: np.ndarray, start: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(key):
        k, c, s, n = _spans(key, crc, start)
        yield _rows(COVERED, k, c, s, n)


def _strings_of(t: pa.Table, length: int) -> tuple[np.ndarray, ...]:
    """All strings of a table of runs: (bytes, key, crc, start)."""
    strings, which, place = _suffixes(t["bytes"].to_pylist(), t["count"].to_numpy().astype(np.int64), length)
    return strings, t["key"].to_numpy()[which], t["crc"].to_numpy()[which], t["start"].to_numpy()[which] + place


def compare_open(runs: DataFrame, length: int, cells: int) -> DataFrame:
    """Step 3 in cells, over runs with their bytes: covered spans (COVERED rows)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= STRINGS:
                t = pa.Table.from_batches(held).combine_chunks()
                lead, then = t["lead"].to_numpy(), t["then"].to_numpy()
                other = np.nonzero((lead != lead[-1]) | (then != then[-1]))[0]
                whole = int(other[-1]) + 1 if len(other) else 0  # the last leading bytes may go on
                if whole:
                    yield from settle(t.slice(0, whole))
                    t = t.slice(whole)
                held, rows = t.to_batches(), t.num_rows
        if rows:
            yield from settle(pa.Table.from_batches(held))

    def settle(t: pa.Table) -> Iterator[pa.RecordBatch]:
        strings, key, crc, start = _strings_of(t, length)
        hit, _ = _settle_strings(strings, key)
        yield from _covered_rows(key[hit], crc[hit], start[hit])

    n = shuffle_partitions(runs.sparkSession)
    return runs.repartitionById(n, F.floor(F.col("cell").cast("long") * n / cells).cast("int")).sortWithinPartitions("cell", "lead", "then").mapInArrow(run, _OUT)


def compare_wide(runs: DataFrame, length: int) -> DataFrame:
    """Step 3 across buckets, for leading tokens that no bucket can hold alone.

    Strings are dealt by a hash of all their bytes, so only equal ones have to meet; a task first
    settles its own, and sends a string once per smallest key. Exact, whatever the group's size.
    """
    n = shuffle_partitions(runs.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= STRINGS:
                yield from deal(pa.Table.from_batches(held))
                held, rows = [], 0
        if rows:
            yield from deal(pa.Table.from_batches(held))

    def deal(t: pa.Table) -> Iterator[pa.RecordBatch]:
        strings, key, crc, start = _strings_of(t, length)
        hit, order = _settle_strings(strings, key)
        bucket = _bytes_hash(strings) % np.uint64(n)
        order = order[~hit[order]]
        order = order[np.argsort(bucket[order], kind="stable")]
        limits = np.searchsorted(bucket[order], np.arange(n + 1, dtype=np.uint64))
        for i in range(n):
            some = order[limits[i] : limits[i + 1]]
            if len(some):
                yield blob(i, False, strings[some].tobytes(), key[some], crc[some], start[some])
        if hit.any():
            k, c, s, counts = _spans(key[hit], crc[hit], start[hit])
            yield blob(int(k[0]) % n, True, counts.astype(np.int64).tobytes(), k, c, s)

    def blob(bucket: int, done: bool, head: bytes, *columns: np.ndarray) -> pa.RecordBatch:
        body = struct.pack("<q", len(columns[0])) + b"".join(_planes(c.astype(np.int64)) for c in columns) + head
        return pa.record_batch([pa.array([bucket], pa.int32()), pa.array([done]), pa.array([zstandard.ZstdCompressor(level=1).compress(body)], pa.binary())], names=["bucket", "done", "blob"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for b in batches:
            for done, x in zip(b["done"].to_pylist(), b["blob"], strict=True):
                body = zstandard.ZstdDecompressor().decompress(x.as_py())
                (m,) = struct.unpack_from("<q", body)
                key, crc, start = (_unplanes(body[8 + 8 * m * i : 8 + 8 * m * (i + 1)], m, np.int64) for i in range(3))
                rest = body[8 + 24 * m :]
                if done:
                    yield _rows(COVERED, key, crc, start, np.frombuffer(rest, np.int64))
                else:
                    parts.append((np.frombuffer(rest, np.uint8).reshape(m, length), key, crc, start))
        if parts:
            strings, key, crc, start = (np.concatenate(c) for c in zip(*parts, strict=True))
            hit, _ = _settle_strings(strings, key)
            yield from _covered_rows(key[hit], crc[hit], start[hit])

    return runs.mapInArrow(send, "bucket int, done boolean, blob binary").repartitionById(n, F.col("bucket")).mapInArrow(meet, _OUT)


def fetch(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of runs: ``_OUT`` and ``bytes``; lists are by text, so bounded by it."""
    lists = wanted.groupBy("key", "crc").agg(F.collect_list(F.struct("kind", "start", "count", "cell", "lead", "then")).alias("runs")).withColumnsRenamed({"key": "k2", "crc": "c2"})
    asked, _ = split(docs.filter("key is not null"), "key", filter_of(wanted, "key"))
    met = asked.withColumn("crc", F.crc32(F.col("text").cast("binary"))).join(lists, (F.col("key") == F.col("k2")) & (F.col("crc") == F.col("c2")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                data = b["text"][i].as_py().encode("utf-8", "surrogatepass")
                runs = b["runs"][i].values
                start, count = runs.field("start").to_numpy(), runs.field("count").to_numpy()
                taken = [data[s : s + c + length - 1] for s, c in zip(start.tolist(), count.tolist(), strict=True)]
                m = len(taken)
                own = {"key": pa.array(np.full(m, b["key"][i].as_py(), np.int64)), "crc": pa.array(np.full(m, b["crc"][i].as_py(), np.int64))}
                yield pa.record_batch([own[c] if c in own else runs.field(c) for c in _NAMES] + [pa.array(taken, pa.binary())], names=[*_NAMES, "bytes"])

    return met.select("key", "crc", "text", "runs").mapInArrow(run, f"{_OUT}, bytes binary")


def cover(spans: np.ndarray, size: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed intervals from (first string, number of strings) rows."""
    if not len(spans):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    begin, end = spans[:, 0], spans[:, 0] + spans[:, 1] + length - 1
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.minimum(np.maximum.accumulate(end[order]), size)
    fresh = np.ones(len(begin), bool)
    fresh[1:] = begin[1:] > end[:-1]
    first = np.nonzero(fresh)[0]
    return begin[first], end[np.append(first[1:], len(begin)) - 1]


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, limit: int = LIMIT, with_kept: bool = False) -> DataFrame:
    """One row per document: ``key, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept``, the bytes left).

    ``key`` has to be an integer column; its order says which document keeps a string.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = rows.filter("key is not null")
    n, total = keyed.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    cells = n_cells(total, shuffle_partitions(docs.sparkSession))
    spark = docs.sparkSession
    kept_runs, kept_bytes = step_folder(spark, "substrings-runs"), step_folder(spark, "substrings-bytes")
    found = step(find_runs(keyed, length, limit, cells, n), kept_runs)
    wanted = found.filter(f"kind = {OPEN}").select(*_NAMES).unionByName(meeting(found.filter(f"kind = {WIDE}")))
    bytes_ = step(fetch(rows, wanted, length), kept_bytes)
    near = compare_open(bytes_.filter(f"kind = {OPEN}"), length, cells)
    far = compare_wide(bytes_.filter(f"kind = {WIDE}"), length)
    spans = found.filter(f"kind = {COVERED}").select(*_NAMES).unionByName(near).unionByName(far)
    lists = spans.groupBy(F.col("key").alias("k2"), F.col("crc").alias("c2")).agg(F.collect_list(F.struct("start", "count")).alias("spans"))
    lists = step(lists, step_folder(spark, "substrings-spans"))
    removed(spark, kept_runs, kept_bytes)
    touched, clean = split(rows, "key", filter_of(lists, "k2"))
    cut_ = touched.withColumn("crc", F.crc32(F.col("text").cast("binary"))).join(lists, (F.col("key") == F.col("k2")) & (F.col("crc") == F.col("c2")), "left")
    met = cut_.select("key", "text", "spans").unionByName(clean.select("key", "text", F.lit(None).cast(lists.schema["spans"].dataType).alias("spans")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for t, s in zip(b["text"], b["spans"], strict=True):
                data = t.as_py().encode("utf-8", "surrogatepass")
                if s.is_valid:
                    got = s.values
                    begin, end = cover(np.stack([got.field("start").to_numpy(), got.field("count").to_numpy().astype(np.int64)], axis=1), len(data), length)
                    edges = [0, *np.stack([begin, end], axis=1).ravel().tolist(), len(data)]
                    left = b"".join(data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                    out.append((len(data), len(data) - len(left), len(begin), hashlib.sha256(left).hexdigest(), left if with_kept else None))
                else:
                    out.append((len(data), 0, 0, hashlib.sha256(data).hexdigest(), data if with_kept else None))
            columns = list(zip(*out, strict=True)) or [()] * 5
            arrays = [b["key"], *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())]
            yield pa.record_batch([*arrays, *([pa.array(columns[4], pa.binary())] if with_kept else [])], names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_kept else [])])

    schema = "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_kept else "")
    return met.select("key", "text", "spans").mapInArrow(run, schema).withColumnRenamed("key", key)
