"""SimHash near-duplicates: pigeonhole blocks, Hamming check, components.

A fingerprint has 64 bits: bit b is 1 if it is set in over half the XXH64 hashes (seed 42) of a
text's word shingles, repeats included. Links join fingerprints that differ in 3 bits or fewer.

Finding links: 64 bits split into 6 blocks; of two linked fingerprints at least 3 blocks are equal,
so each of the 20 choices of 3 blocks is a key of 31 to 33 bits. Equal fingerprints are one node
from the start, so exact copies never meet in a key. Inside a key fingerprints are compared in
vectors, and what comes out are at most two edges a fingerprint, never all pairs. A key with more
than ``LIMIT`` fingerprints isn't compared at all: those go the way of ``dense_edges``, which costs a
fixed number of rows per fingerprint and is exact too.

Null and empty texts have fingerprint 0, linked like any other. Texts are read whole. Rows that repeat a key
are labelled each by their own text. An empty table gives no rows; just key and text are read.

At 3 of 64 bits only texts that are nearly equal meet, and fingerprints of 64 bits can't be split for 10
differing bits without keys that match by chance. ``similar_documents`` therefore takes longer
fingerprints for a similarity of 0.8 on five-word shingles: ``PLACES`` numbers of 16 bits, each from the least of
a text's shingle hashes under one of as many permutations, so the share of equal places estimates the Jaccard
similarity. The way is the same: of two fingerprints that differ in ``MOST`` of 128 places or fewer, one of ``MOST`` + 1
blocks is equal; fingerprints join on blocks, and the differing places are counted. ``MOST`` leaves the
estimate three standard deviations below 0.8. What is linked so far makes up clusters, and inside a cluster the
similarity of the shingle sets themselves decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.bitmaps import filter_of, split
from skein.llm.common import cut, shuffle_partitions, written
from skein.llm.graph import components

SEED = 42
BITS = 3
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
MASKS = [sum(((1 << n) - 1) << at for at, n in chosen) for chosen in combinations(BLOCKS, 3)]
LIMIT = 4096
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, size: int = 3) -> int:
    """Unsigned fingerprint of one text. Bits are counted 255 hashes at a time in bytes."""
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # bytes split at ASCII white space only
    if not tokens:
        return 0
    if len(tokens) < size:
        shingles = [b" ".join(tokens)]
    else:
        shingles = [b" ".join(s) for s in zip(*(tokens[i:] for i in range(size)), strict=False)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, len(shingles))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    on = 2 * counts > len(hashes)
    return int(np.packbits(on, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """``key, fp``: a signed 64-bit fingerprint per document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), size) for t in b.column(1)), np.uint64, b.num_rows).view(np.int64)
            yield pa.record_batch([b.column(0), pa.array(fps)], names=["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, fp long")


def _vector_edges(keys: np.ndarray, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges among rows sorted by key: a spanning set of the links inside each key.

    Neighbours at growing distance are compared as long as keys match. A row that is already linked
    to an earlier row of its key keeps that one edge, and every later link of it is still looked at:
    an edge goes out only where both ends aren't joined yet.
    """
    n = len(keys)
    fps = fps.view(np.uint64)  # of signed values, bitwise_count counts the bits of the absolute value
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    step = 1
    alive = np.arange(n)
    while True:
        alive = alive[alive + step < n]
        alive = alive[keys[alive] == keys[alive + step]]
        if not len(alive):
            break
        near = np.bitwise_count(fps[alive] ^ fps[alive + step]) <= bits
        left.append(alive[near])
        right.append(alive[near] + step)
        step += 1
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = np.concatenate(left), np.concatenate(right)
    if len(a) <= n:
        return a, b
    parent = list(range(n))
    kept = []
    for e, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(e)
    return a[kept], b[kept]


def block_edges(nodes: DataFrame, bits: int = BITS, limit: int = LIMIT) -> DataFrame:
    """``u, v, dense`` of distinct fingerprints ``fp``: edges, and (dense) fingerprints of keys over ``limit``."""
    keyed = nodes.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long")).alias("block")) for i, m in enumerate(MASKS)])).alias("b"))
    keyed = keyed.select("fp", F.xxhash64("b.i", "b.block").alias("key"))
    n = shuffle_partitions(nodes.sparkSession)

    def out(u: np.ndarray, v: np.ndarray, dense: bool) -> pa.RecordBatch:
        return pa.record_batch([pa.array(u), pa.array(v), pa.array(np.full(len(u), dense))], names=["u", "v", "dense"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f, over = np.empty(0, np.int64), np.empty(0, np.int64), None
        for b in batches:
            k = np.concatenate([held_k, b.column(0).to_numpy()])
            f = np.concatenate([held_f, b.column(1).to_numpy()])
            if over is not None:  # the key that is too large goes on
                mine = np.searchsorted(k, over, "right")
                if mine:
                    yield out(f[:mine], f[:mine], True)
                k, f = k[mine:], f[mine:]
                if not len(k):
                    held_k, held_f = k, f
                    continue
                over = None
            last = np.searchsorted(k, k[-1], "left")
            yield from settle(k[:last], f[:last])
            held_k, held_f = k[last:], f[last:]
            if len(held_k) > limit:
                yield out(held_f, held_f, True)
                over, held_k, held_f = held_k[0], held_k[:0], held_f[:0]
        yield from settle(held_k, held_f)

    def settle(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(k):
            return
        _, inverse, sizes = np.unique(k, return_inverse=True, return_counts=True)
        big = sizes[inverse] > limit
        if big.any():
            yield out(f[big], f[big], True)
        k, f = k[~big], f[~big]
        a, b = _vector_edges(k, f, bits)
        if len(a):
            yield out(f[a], f[b], False)

    return keyed.repartition(n, "key").sortWithinPartitions("key").select("key", "fp").mapInArrow(run, "u long, v long, dense boolean")


def dense_edges(fps: DataFrame) -> DataFrame:
    """Links of 3 bits or fewer among ``fps`` (column fp) by shared neighbours, rows linear in the input.

    x and y differ in 3 bits or fewer just if some z lies within 1 of one and within 2 of the other.
    Every fingerprint gives out its 65 values within 1 and its 2016 at 2 exactly. Around a z all
    values within 1 are linked with each other, and each at 2 with each within 1: a star from the
    smallest of the near ones covers them.
    """
    bit = "shiftleft(1L, {})"
    one = fps.select("fp", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("i"))
    near = one.select(F.expr(f"if(i < 0, fp, fp ^ {bit.format('i')})").alias("z"), "fp")
    two = one.filter("i between 0 and 62").select("fp", "i", F.explode(F.sequence(F.col("i") + 1, F.lit(63))).alias("j"))
    far = two.select(F.expr(f"fp ^ {bit.format('i')} ^ {bit.format('j')}").alias("z"), "fp")
    hubs = near.groupBy("z").agg(F.min("fp").alias("hub"))
    met = near.unionByName(far).join(hubs.select(F.col("z").alias("z2"), "hub"), F.col("z") == F.col("z2"))
    return met.filter("fp <> hub").select(F.col("fp").alias("u"), F.col("hub").alias("v")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, limit: int = LIMIT) -> DataFrame:
    """One row per document: ``key, fp, component``, the smallest key reachable over links.

    Components are found among distinct fingerprints; each stands for its smallest document.
    """
    fps = cut(fingerprints(docs, key, text, size))
    nodes = cut(fps.groupBy("fp").agg(F.min("key").alias("first")))
    found = cut(block_edges(nodes.select("fp"), limit=limit).distinct())
    edges = found.filter("not dense").select("u", "v")
    dense = found.filter("dense").select(F.col("u").alias("fp")).distinct()
    if not dense.isEmpty():
        edges = edges.unionByName(dense_edges(dense))
    joined = components(edges).select(F.col("u").alias("fp2"), F.col("component").alias("root"))
    rooted = nodes.join(joined, F.col("fp") == F.col("fp2"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component")).withColumnRenamed("root", "root2")
    labelled = rooted.join(least, F.col("root") == F.col("root2")).select(F.col("fp").alias("fp3"), "component")
    return fps.join(labelled, F.col("fp") == F.col("fp3")).select(F.col("key").alias(key), "fp", "component")


PLACES, SIMILARITY, MOST = 128, 0.8, 38
#: rows of a block, and of a cluster with its shingles, that one task compares at once
TILE, SET_TILE = 16_384, 2048
_PERMUTE = np.random.default_rng(20240601).integers(0, 1 << 32, (2, PLACES), dtype=np.uint32) | np.array([[1], [0]], np.uint32)


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """32-bit hashes of a text's different word shingles, sorted; a shorter text counts whole, one without words has none."""
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not tokens:
        return np.empty(0, np.uint32)
    digest = xxhash.xxh64_intdigest
    words = np.fromiter((digest(w, SEED) for w in tokens), np.uint64, len(tokens))
    n = max(1, len(words) - size + 1)
    mixed = np.zeros(n, np.uint64)
    for j in range(min(size, len(words))):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
    return np.unique(((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)).astype(np.uint32))


def signature(shingles: np.ndarray) -> bytes:
    """``PLACES`` 16-bit numbers of one set; zeros for the empty one."""
    if not len(shingles):
        return bytes(2 * PLACES)
    least = np.full(PLACES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles), 4096):
        least = np.minimum(least, (shingles[at : at + 4096, None] * _PERMUTE[0] + _PERMUTE[1]).min(axis=0))
    return (least * np.uint32(0x9E3779B1) >> np.uint32(16)).astype("<u2").tobytes()


def signatures(rows: DataFrame, size: int) -> DataFrame:
    """``row, key, sig, whole`` of ``row, key, text``; ``whole`` is a hash of the shingle set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            sets = [shingle_set(t.as_py(), size) for t in b["text"]]
            whole = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            yield pa.record_batch([b["row"], b["key"], pa.array(map(signature, sets), pa.binary()), pa.array(whole)], names=["row", "key", "sig", "whole"])

    return rows.mapInArrow(run, f"row long, key {rows.schema['key'].dataType.simpleString()}, sig binary, whole long")


def similar(x: np.ndarray, others: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of the sets ``others`` have a Jaccard similarity of ``similarity`` or more with ``x``; empty sets are equal."""
    sizes = np.array([len(o) for o in others])
    if not len(x):
        return sizes == 0
    joined = np.concatenate([*others, np.zeros(1, np.uint32)])
    place = np.minimum(np.searchsorted(x, joined), len(x) - 1)
    same = np.concatenate([[0], np.cumsum(x[place] == joined)])
    ends = np.cumsum(sizes)
    both = same[ends] - same[ends - sizes]
    return both >= similarity * (len(x) + sizes - both) - 1e-9


def linked_within(sigs: np.ndarray, most: int, sets: list[np.ndarray] | None = None, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the components of rows with ``most`` differing places or fewer (and similar ``sets``, if given).

    Exact, without all pairs: from row to row, each is compared with those that no component has yet; a
    group of copies is done after its first row.
    """
    free = np.arange(len(sigs))
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    while len(free) > 1:
        queue, free = [free[0]], free[1:]
        while queue and len(free):
            x = queue.pop()
            near = np.concatenate([(sigs[free[i : i + 65536]] != sigs[x]).sum(axis=1) <= most for i in range(0, len(free), 65536)])
            if sets is not None and near.any():
                near[near] = similar(sets[x], [sets[i] for i in free[near].tolist()], similarity)
            if near.any():
                found = free[near]
                left.append(np.full(len(found), x))
                right.append(found)
                queue.extend(found.tolist())
                free = free[~near]
    none = np.empty(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def group_edges(rows: DataFrame, counts: DataFrame, most: int, tile: int, similarity: float) -> DataFrame:
    """``u, v``: edges inside the groups of ``node, key, sig`` and maybe ``shingles``; ``counts``: key, n.

    A group with more than ``tile`` rows is dealt in tiles, and every two tiles meet: exact, and no task
    holds more than two of them for a group.
    """
    large = counts.filter(F.col("n") > tile).select(F.col("key").alias("key2"), F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    hot, cool = split(rows, "key", filter_of(large, "key2"))
    one = F.coalesce("tiles", F.lit(1))
    dealt = hot.join(large, F.col("key") == F.col("key2"), "left").withColumn("own", F.pmod(F.xxhash64("node"), one).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), one - 1)))
    pair = F.when(F.col("tiles").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    every = cool.unionByName(dealt.withColumn("key", pair).select(rows.columns))
    with_sets = "shingles" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, bytes]] = []
        now = None
        for b in batches:
            for i, key in enumerate(b["key"].to_pylist()):
                if key != now:
                    yield from settle(held)
                    now, held = key, []
                held.append((b["node"][i].as_py(), b["sig"][i].as_py(), b["shingles"][i].as_py() if with_sets else b""))
        yield from settle(held)

    def settle(held: list[tuple[int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        if len(held) > 1:
            ids = np.array([h[0] for h in held], np.int64)
            sigs = np.frombuffer(b"".join(h[1] for h in held), "<u2").reshape(-1, PLACES)
            u, v = linked_within(sigs, most, [np.frombuffer(h[2], np.uint32) for h in held] if with_sets else None, similarity)
            if len(u):
                yield pa.record_batch([pa.array(ids[u]), pa.array(ids[v])], names=["u", "v"])

    return every.repartition(shuffle_partitions(rows.sparkSession), "key").sortWithinPartitions("key").mapInArrow(run, "u long, v long").distinct()


def block_clusters(nodes: DataFrame, most: int, tile: int, similarity: float) -> DataFrame:
    """``node2, root`` of ``node, sig``: clusters at ``most`` differing places or fewer, without those of one node.

    Only blocks that several fingerprints share move with their numbers.
    """
    n_blocks = most + 1
    edges = [2 * (PLACES * i // n_blocks) for i in range(n_blocks + 1)]
    key = F.array(*[F.xxhash64(F.lit(i), F.substring("sig", a + 1, b - a)) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))])
    keyed = nodes.select("node", "sig", F.explode(key).alias("key"))
    several = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    shared, _ = split(keyed, "key", filter_of(several, "key"))
    found = components(group_edges(shared, several, most, tile, similarity)).select(F.col("u").alias("node2"), F.col("component").alias("root"))
    return cut(found.unionByName(found.select(F.col("root").alias("node2"), "root").distinct()))


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, similarity: float = SIMILARITY, most: int = MOST, tile: int = TILE, set_tile: int = SET_TILE, row: str | None = None) -> DataFrame:
    """``row, key, component, first``: per row the component's smallest key, and whether this row stays for it.

    Rows have the distinct numbers of the column ``row``, or get some. Links: sets of word shingles with a similarity of
    ``similarity`` or more, among those whose fingerprints differ in ``most`` places or fewer. The row with
    the smallest key stays (null is the smallest; of equal keys, the smallest row). Texts without words are
    equal to each other.
    """
    read = docs.select((F.monotonically_increasing_id() if row is None else F.col(row)).alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    rows = written(read, "similar-rows") if row is None else read
    sigs = cut(signatures(rows, size))
    nodes = cut(sigs.groupBy("sig", "whole").agg(F.min(F.struct("key", "row")).alias("least")).select("sig", "whole", F.col("least.row").alias("node"), "least"))
    clusters = block_clusters(nodes.select("node", "sig"), most, tile, similarity)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b["node"], b["key"], b["sig"], pa.array([shingle_set(t.as_py(), size).tobytes() for t in b["text"]], pa.binary())], names=["node", "key", "sig", "shingles"])

    inside, _ = split(rows.select("row", "text"), "row", filter_of(clusters, "node2"))
    told = inside.join(clusters, F.col("row") == F.col("node2")).join(nodes.select("node", "sig"), F.col("row") == F.col("node"))
    sets = told.select("node", F.col("root").alias("key"), "sig", "text").mapInArrow(encode, "node long, key long, sig binary, shingles binary")
    counts = clusters.groupBy(F.col("root").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    joined = components(group_edges(sets, counts, most, set_tile, similarity)).select(F.col("u").alias("node2"), F.col("component").alias("root"))
    rooted = nodes.join(joined, F.col("node") == F.col("node2"), "left").select("sig", "whole", "least", F.coalesce("root", "node").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("stays")).withColumnRenamed("root", "root2")
    labelled = cut(rooted.join(smallest, F.col("root") == F.col("root2")).select(F.col("sig").alias("sig2"), F.col("whole").alias("whole2"), "stays"))
    met = sigs.join(labelled, (F.col("sig") == F.col("sig2")) & (F.col("whole") == F.col("whole2")))
    return met.select("row", F.col("key").alias(key), F.col("stays.key").alias("component"), (F.col("row") == F.col("stays.row")).alias("first"))
