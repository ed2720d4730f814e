from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from skein.llm import simhash as S
from skein.llm.queries import QUERIES
from tests.conftest import TESTDATA

SF = f"{TESTDATA}/sf0.01"


def fp(t, size=3):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    sh = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    keys = sorted(fps)
    parent = {k: k for k in keys}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = np.array([fps[k] for k in keys], np.uint64)
    for i, k in enumerate(keys):
        for j in np.nonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 3)[0]:
            a, b = root(k), root(keys[i + 1 + j])
            if a != b:
                parent[max(a, b)] = min(a, b)
    return {k: root(k) for k in keys}


def test_simhash_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want_fp = {k: fp(t) for k, t in docs.items()}
    want = brute_components(want_fp)
    got = QUERIES["op3_simhash"](spark, SF).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {k: f"{v:016x}" for k, v in want_fp.items()}
    assert {r.doc_id: r.component_id for r in got} == want
    assert sum(k != v for k, v in want.items()) > 20


def near_group(n, seed=1):
    rnd = random.Random(seed)
    base = rnd.getrandbits(64)
    out = {base}
    while len(out) < n:
        x = rnd.choice(list(out)) if rnd.random() < 0.02 else base
        for _ in range(rnd.randint(1, 3)):
            x ^= 1 << rnd.randrange(64)
        out.add(x)
    return [x - (1 << 64) if x >> 63 else x for x in out]


def test_dense_groups_lose_no_link(spark):
    values = near_group(400) + near_group(30, 2) + [random.Random(3).getrandbits(63) for _ in range(300)]
    nodes = spark.createDataFrame([(v,) for v in set(values)], "fp long")
    want = brute_components({v: np.uint64(v % (1 << 64)) for v in set(values)})
    for limit in (4096, 20):
        found = S.block_edges(nodes, limit=limit)
        edges = found.filter("not dense").select("u", "v")
        dense = found.filter("dense").selectExpr("u as fp").distinct()
        assert dense.isEmpty() == (limit == 4096)
        if limit == 20:
            edges = edges.union(S.dense_edges(dense))
        pairs = [tuple(r) for r in edges.collect()]
        assert all(np.bitwise_count(np.uint64((a ^ b) % (1 << 64))) <= 3 for a, b in pairs)
        parent = {v: v for v in want}

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        assert {v: root(v) for v in want} == want


def test_isolated_pairs_that_differ_in_bit_63_are_linked(spark):
    rnd = random.Random(5)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    want = set()
    for n in range(3):
        for others in combinations(range(63), n):
            x = rnd.getrandbits(64)
            y = x ^ 1 << 63 ^ sum(1 << b for b in others)
            want.add((min(signed(x), signed(y)), max(signed(x), signed(y))))
    assert len(want) == 1 + 63 + 1953
    nodes = spark.createDataFrame([(v,) for pair in want for v in pair], "fp long")
    found = S.block_edges(nodes).filter("not dense").collect()
    assert {(min(r.u, r.v), max(r.u, r.v)) for r in found} == want


def test_simhash_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(40000))
    rows = [(4, None), (2, ""), (9, " \n\t"), (1, "Only two"), (7, "only TWO"), (5, long), (6, long + " x"), (8, "é ü ñ ß"), (8, "é ü ñ ß")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as key", "3 as u")
    got = S.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.component) for r in got) == [(1, 1), (2, 2), (4, 2), (5, 5), (6, 5), (7, 1), (8, 8), (8, 8), (9, 2)]
    assert S.near_duplicates(docs.limit(0)).collect() == []


def jaccard(a, b, size=5):
    sets = [{tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_signatures_estimate_the_similarity():
    rnd = random.Random(3)
    for _ in range(30):
        words = [f"w{rnd.randint(0, 10**6)}" for _ in range(rnd.choice([60, 300, 9000]))]
        other = [w if rnd.random() > 0.03 else "x" for w in words]
        a, b = (np.frombuffer(S.signature(S.shingle_set(" ".join(x))), np.uint16) for x in (words, other))
        assert abs((a == b).mean() - jaccard(" ".join(words), " ".join(other))) < 0.17
    assert S.signature(S.shingle_set(None)) == S.signature(S.shingle_set(" \n")) == bytes(2 * S.PLACES)
    assert S.shingle_set("A b").tolist() == S.shingle_set("a B").tolist()


@pytest.mark.parametrize("tile", [S.TILE, 7])
def test_similar_documents_equal_brute_force(spark, tile):
    rnd = random.Random(21)
    fill = lambda n: [f"w{rnd.randint(0, 3000)}" for _ in range(n)]
    rows = [(None, None), (None, ""), (1, " \t")]
    for g in range(25):
        base = fill(rnd.randint(20, 400))
        for _ in range(rnd.choice([1, 2, 3, 40])):
            edited = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4, 8])):
                edited[rnd.randrange(len(edited))] = f"n{rnd.randint(0, 9)}"
            rows.append((rnd.choice([None, rnd.randint(0, 900)]), " ".join(edited)))
    rnd.shuffle(rows)
    got = S.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).selectExpr("*", "1 as row", "2 as sig"), tile=tile, set_tile=tile).collect()
    assert sorted(r.row for r in got) == list(range(len(rows)))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(rows[i][1] or "", rows[j][1] or "") >= 0.8:
                parent[root(i)] = root(j)
    members = {}
    for i in range(len(rows)):
        members.setdefault(root(i), []).append(((rows[i][0] is not None, rows[i][0] or 0), i))
    stays = {i: min(m) for m in members.values() for _, i in m}
    for r in got:
        assert r.first == (stays[r.row][1] == r.row) and r.component == rows[stays[r.row][1]][0] and r.doc_id == rows[r.row][0]
    assert sum(r.first for r in got) == len(members) < len(rows)
    assert S.similar_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
