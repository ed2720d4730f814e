from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from skein.llm import substrings as S
from skein.llm.queries import QUERIES
from tests.conftest import TESTDATA


def brute(rows, length=50):
    least = {}
    for k, t in rows:
        b = (t or "").encode()
        if k is not None:
            for i in range(len(b) - length + 1):
                s = b[i : i + length]
                least[s] = min(least.get(s, k), k)
    out = []
    for k, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        if k is not None:
            for i in range(len(b) - length + 1):
                if least[b[i : i + length]] < k:
                    gone[i : i + length] = True
        left = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((k, len(b), len(b) - len(left), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return Counter(out)


def test_equals_brute_force(spark):
    sf = f"{TESTDATA}/sf0.001"
    got = Counter(map(tuple, QUERIES["op1_suffix_dedup"](spark, sf).collect()))
    assert got == brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


@pytest.mark.parametrize(("limit", "cell"), [(S.LIMIT, S.CELL_BYTES), (3, S.CELL_BYTES), (S.LIMIT, 200)])
def test_shared_lines_in_changing_surroundings(spark, limit, cell, monkeypatch):
    monkeypatch.setattr(S, "CELL_BYTES", cell)
    rnd = random.Random(limit)
    word = lambda: "".join(rnd.choices("abcdeé", k=rnd.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    line, passage = text(9), text(60)
    rows = []
    for k in rnd.sample(range(1000), 160):
        parts = [text(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 3)):
            cut = rnd.randint(0, len(passage) - 1)
            parts += [rnd.choice([line, passage, passage[cut:], passage[:cut]]), text(rnd.randint(0, 20))]
        rows.append((k, rnd.choice([" ", "\n"]).join(parts)))
    rows += [(k + 2000, t) for k, t in rows[:20]] + rows[20:25] + [(5000, "ab" * 400), (5001, "ab" * 300), (5002, "ab" * 20), (5000, text(50)), (None, passage), (7000, None), (7001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as crc", "3 as spans")
    got = Counter(map(tuple, S.dedup_substrings(docs, limit=limit).collect()))
    assert got == brute(rows), (list((got - brute(rows)).items())[:3], list((brute(rows) - got).items())[:3])
    kept = {r.doc_id: r for r in S.dedup_substrings(docs.filter("doc_id < 100"), with_kept=True).collect()}
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in kept.values())


def test_long_text_and_empty_table(spark, monkeypatch):
    rnd = random.Random(9)
    monkeypatch.setattr(S, "PIECE", 1000)
    monkeypatch.setattr(S, "CHUNK", 3000)
    monkeypatch.setattr(S, "GATHER", 8000)
    held = S._Gatherer(50)
    long = "".join(rnd.choices("abcdefgh ", k=20_000))
    held.add(1, long)
    runs = held.take()
    covered = sorted((s, s + c) for s, c in zip(runs[5].tolist(), runs[6].tolist(), strict=True))
    assert covered[0][0] == 0 and covered[-1][1] == 20_000 - 49 and all(a[1] == b[0] for a, b in zip(covered, covered[1:], strict=False))
    packed = S.unpack(S.pack(S._pick(runs, S._order(runs))))
    assert all((a == b).all() for a, b in zip(packed, S._pick(runs, S._order(runs)), strict=True))
    assert S.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_multikey_order():
    rnd = np.random.default_rng(4)
    rows = rnd.integers(97, 99, (500, 13), dtype=np.uint8)
    rows[250:] = rows[:250]
    order, new = S.multikey_order(rows)
    got = [rows[i].tobytes() for i in order]
    assert got == sorted(r.tobytes() for r in rows)
    assert new.tolist() == [i == 0 or got[i] != got[i - 1] for i in range(500)]


def test_runs_are_sorted_by_their_bytes_and_cells_are_ranges():
    rnd = random.Random(4)
    held = S._Gatherer(50)
    for k in range(40):
        held.add(k - 20, " ".join(rnd.choices(["alpha", "beta", "gamma", "delta"], k=200)))
    runs = held.take()
    runs = S._pick(runs, S._order(runs))
    rows = list(zip(*(c.tolist() for c in runs[:4]), strict=True))
    assert rows == sorted(rows)
    lead = b"".join(int(x).to_bytes(8, "big") for x in rows[0][:2])
    assert len(lead.split()) >= 2  # the bytes of a text
    picks = sorted(rnd.sample(range(len(rows)), 30))
    cuts = np.array([rows[i][:3] for i in picks] + [(2**63, 0, 0), (2**63, 0, 5)], np.uint64)
    starts = S.cell_starts(runs, cuts)
    assert starts.tolist() == [0, *[sum(r[:3] < tuple(map(int, c)) for r in rows) for c in cuts], len(rows)]


def test_cells_and_samples_of_any_corpus():
    assert S.n_cells(0, 8) == 8 and S.n_cells(1 << 33, 8) == 1024
    assert S.n_cells(100 << 40, 8) < 10**6 and (100 << 40) / S.n_cells(100 << 40, 8) < 1 << 28
    for rows in (10**9, 10**11, 10**13):
        assert 0.99 < int(S.SAMPLE_DOCS / rows * (1 << 64)) / 2**64 * rows / S.SAMPLE_DOCS <= 1.01


def test_runs_that_share_just_a_gram_dont_go_on(spark):
    rnd = random.Random(11)
    text = lambda n: "".join(rnd.choices("abcdefghijklmnop", k=n))
    gram, shared = "0123456789ABCDEF", text(60)
    apart = [(k, text(40) + gram + text(40)) for k in range(80)]
    for rows, some in ((apart, False), ([*apart, (90, text(30) + shared + text(30)), (91, text(33) + shared + text(20))], True)):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        found = S.find_runs(docs.toDF("key", "text"), 50, S.LIMIT, 8, len(rows)).cache()
        going = found.filter(f"kind = {S.OPEN}").select("key").union(S.meeting(found.filter(f"kind = {S.WIDE}")).select("key"))
        assert {r.key for r in going.collect()} == ({90, 91} if some else set())
        assert Counter(map(tuple, S.dedup_substrings(docs).collect())) == brute(rows)


def test_steps_leave_no_shuffles_and_only_spans(spark):
    import glob
    import time

    from skein.llm.common import shared_folder, step, step_folder

    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").count("shuffle_")
    before = files()
    rows = step(spark.range(9999).repartition(7, "id"), step_folder(spark, "substrings-test"))
    began = time.time()
    while files() > before and time.time() - began < 20:
        time.sleep(0.2)
    assert files() <= before and rows.count() == 9999
    folder = shared_folder(spark).removeprefix("file://").removeprefix("file:")
    old = set(glob.glob(f"{folder}/substrings-*"))
    got = S.dedup_substrings(spark.createDataFrame([(1, "ab" * 90), (2, "cd" + "ab" * 80)], "doc_id long, text string"))
    assert {p.split("/")[-1].rsplit("-", 1)[0] for p in set(glob.glob(f"{folder}/substrings-*")) - old} == {"substrings-spans"}
    assert got.count() == 2


def test_memory_of_hashing_does_not_grow_with_texts():
    import tracemalloc

    rnd = np.random.default_rng(3)
    text = lambda n: rnd.integers(97, 123, n, dtype=np.uint8).tobytes().decode()
    for texts in ([text(3000) for _ in range(700)], [text(2_100_000)]):
        held = S._Gatherer(50)
        tracemalloc.start()
        for k, t in enumerate(texts):
            held.add(k, t)
        runs = held.take()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 64 << 20
        assert runs[6].sum() == sum(len(t) - 49 for t in texts)  # each string once


def test_steps_hand_texts_over_by_bytes(spark):
    import pyarrow as pa

    from skein.llm.common import step, step_folder

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    texts = spark.range(0, 300, 1, 1).selectExpr("id", "repeat(cast(id as string), 50000) as text")
    got = step(texts.mapInArrow(sizes, "n long, size long"), step_folder(spark, "substrings-test")).collect()
    assert sum(r.n for r in got) == 300 and max(r.size for r in got) < 5 << 20
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None
