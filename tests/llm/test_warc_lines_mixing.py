from __future__ import annotations

import base64
import hashlib
import random
from collections import Counter, defaultdict

from skein.llm import lines as L
from skein.llm import mixing as M
from skein.llm import warc
from skein.llm.queries import ORACLE, QUERIES
from tests.conftest import TESTDATA
from tests.oracle import compare

SF = f"{TESTDATA}/sf0.01"


def test_warc_equals_sql(spark):
    compare(QUERIES["op2_warc"](spark, SF), ORACLE["op2_warc"], SF)


def test_warc_round_trip_and_odd_rows(spark, tmp_path):
    rows = [(5, "u\r\nx", "same"), (3, None, "same"), (9, "u", "same"), (1, "a", None), (2, "b", ""), (7, "c", "é" * 50000), (8, "d", "z"), (8, "d", "z"), (None, "n", "null key")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as address", "2 as key", "3 as payload")
    folder = f"file://{tmp_path}/a"
    warc.write_archive(pages, folder)
    index = warc.read_index(spark, folder).collect()
    assert len(index) == len(rows) and all(r.sound for r in index)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = Counter((k, digest(t), len((t or "").encode())) for k, _, t in rows)
    assert Counter((r.key, r.digest, r.n_bytes) for r in index) == want
    types = {r.key: (r.record_type, r.refers_to_key) for r in index}
    assert types[3] == ("response", None) and types[5] == ("revisit", 3) and types[9] == ("revisit", 3) and types[2] == ("revisit", 1) and types[8] == ("response", None)
    full = {r.key: bytes(r.record) for r in warc.records(spark, folder).collect()}
    head, _, body = full[3].partition(b"\r\n\r\n")
    assert body == b"same\r\n\r\n" and b"\r\nContent-Length: 4" in head and head.startswith(b"WARC/1.1\r\n")
    assert full[5].endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n") and b"WARC-Target-URI: u  x\r\n" in full[5]
    assert full[7].partition(b"\r\n\r\n")[2] == ("é" * 50000).encode() + b"\r\n\r\n"
    assert spark.read.parquet(f"{folder}/payloads").count() == len({(t or "") for _, _, t in rows})
    for k, record in full.items():
        fields, block = warc.parse(record)
        assert fields["warc-type"] == types[k][0] and len(block) == int(fields["content-length"])
    ids = {warc.parse(r)[0]["warc-record-id"]: k for k, r in full.items()}
    assert ids[warc.parse(full[9])[0]["warc-refers-to"]] == 3
    warc.write_archive(pages, f"{folder}2", least=5)
    assert {r.key: r.record_type for r in warc.read_index(spark, f"{folder}2").collect()}[5] == "response"
    warc.write_archive(pages.limit(0), f"{folder}3")
    assert warc.read_index(spark, f"{folder}3").collect() == []


def test_warc_rows_that_repeat_a_key_with_other_payloads(spark, tmp_path):
    rows = [(5, "u", "x"), (5, "u", "y"), (6, "u", "y"), (None, "u", "z"), (None, "u", "q"), (7, "u", "z")]
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/r")
    got = Counter((r.key, r.n_bytes, r.record_type, r.refers_to_key, r.sound) for r in warc.read_index(spark, f"file://{tmp_path}/r").collect())
    assert got == {(5, 1, "response", None, True): 2, (6, 1, "revisit", 5, True): 1, (7, 1, "response", None, True): 1, (None, 1, "revisit", 7, True): 1, (None, 1, "response", None, True): 1}


def test_warc_tells_changed_payloads(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "first"), (2, "u", "first"), (3, "u", "other")], "page_id long, url string, html string")
    warc.write_archive(pages, f"file://{tmp_path}/s")
    stored = spark.read.parquet(f"file://{tmp_path}/s/payloads")
    other = stored.filter("n_bytes = 5").orderBy("address").collect()
    swapped = spark.createDataFrame([(a.address, a.n_bytes, a.first_key, b.packed) for a, b in zip(other, other[::-1], strict=True)], stored.schema)
    swapped.write.mode("overwrite").parquet(f"file://{tmp_path}/t/payloads")
    spark.read.parquet(f"file://{tmp_path}/s/headers").write.parquet(f"file://{tmp_path}/t/headers")
    assert [r.sound for r in warc.read_index(spark, f"file://{tmp_path}/t").collect()] == [False] * 3


def brute_lines(docs):
    """A row per row: kept text, lines, removed lines, removed runs. Rows come in the order of keys, nulls first."""
    def h(line):
        return int(hashlib.md5(line.encode()).hexdigest()[:7], 16)

    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0, i))
    texts = [(t or "").split("\n") for _, t in docs]
    first, places = {}, defaultdict(list)
    for d in order:
        ls = texts[d]
        r = [(L.MULTIPLIER * h(a) + h(b)) % L.PRIME for a, b in zip(ls, ls[1:], strict=False)]
        chosen = {i if r[i] <= r[i + 1] else i + 1 for i in range(len(r) - 1)} if len(r) > 1 else set(range(len(r)))
        for i in sorted(chosen):
            body = ls[i] + "\n" + ls[i + 1]
            if len(body) >= L.MIN_CHARS:
                places[d].append((i, first.setdefault(body, (d, i))))
    out = []
    for d, ls in enumerate(texts):
        gone = set()
        for i, (fd, fi) in places[d]:
            if (fd, fi) != (d, i):
                gone |= {i + o for o in (-1, 0, 1, 2) if 0 <= i + o < len(ls) and 0 <= fi + o < len(texts[fd]) and ls[i + o] == texts[fd][fi + o]}
        out.append(("\n".join(x for i, x in enumerate(ls) if i not in gone), len(ls), len(gone), sum(i - 1 not in gone for i in gone)))
    return out


def test_line_dedup_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {k: x for (k, _), x in zip(rows, brute_lines(rows), strict=True)}
    got = {r.doc_id: (r.kept_text, r.n_lines, r.n_removed_lines, r.n_removed_chunks) for r in L.dedup_lines(docs).collect()}
    assert got == want
    assert sum(x[3] for x in want.values()) > 20


def test_line_dedup_odd_rows(spark):
    block = "\n".join(f"line {i} of a block that many documents share, with words enough" for i in range(40))
    rows = [(1, None), (2, ""), (3, block), (4, "intro\n" + block + "\nend"), (5, block), (6, "\n\n\n\n"), (7, "\n".join(["same line again and again, long enough to count"] * 3000))]
    rows += [(8, "other\nthings"), (8, block), (None, "null key\n" + block), (None, "null key\n" + block)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).selectExpr("*", "1 as lines", "2 as place", "doc_id as __row")
    got = Counter((r.doc_id, r.kept_text, r.n_lines, r.n_removed_lines, r.n_removed_chunks, r.x) for r in L.dedup_lines(docs.withColumn("x", docs.text), keep=("x",)).collect())
    assert got == Counter((k, *x, t) for (k, t), x in zip(rows, brute_lines(rows), strict=True))
    texts = {k: kept for k, kept, *_ in got}
    assert texts[3] == texts[5] == "" and texts[4] == "intro\nend" and texts[7].count("\n") == 0
    assert L.dedup_lines(docs.limit(0)).collect() == []


def test_shared_passages_go_to_their_ends(spark):
    """Recall on passages that two otherwise different documents share, by the number of lines."""
    rnd = random.Random(12)
    line = lambda: " ".join("".join(rnd.choices("abcdefghij", k=rnd.randint(2, 8))) for _ in range(rnd.randint(12, 25)))
    rows, shared = [], {}
    for n in (2, 3, 4, 6, 10):
        for j in range(60):
            passage = [line() for _ in range(n)]
            for copy in range(2):
                k = len(rows)
                rows.append((k, "\n".join([line() for _ in range(rnd.randint(1, 5))] + passage + [line() for _ in range(rnd.randint(1, 5))])))
                if copy:
                    shared[k] = (n, passage)
    got = {r.doc_id: r for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    whole = Counter(n for k, (n, passage) in shared.items() if got[k].n_removed_lines == n and not set(passage) & set(got[k].kept_text.split("\n")))
    print("passages removed whole, of 60, by lines:", dict(whole))
    assert all(whole[n] == 60 for n in (3, 4, 6, 10)) and whole[2] >= 20
    assert sum(r.n_removed_lines for r in got.values()) == sum(r.n_removed_lines for k, r in got.items() if k in shared)


def test_line_dedup_runs_no_python(spark, monkeypatch):
    """Every plan that it writes, and the last one."""
    plans = []
    keep = L.written
    monkeypatch.setattr(L, "written", lambda df, name: (plans.append(df), keep(df, name))[1])
    plans.append(QUERIES["op6_line_dedup"](spark, SF))
    texts = [p._jdf.queryExecution().executedPlan().toString() for p in plans]
    assert len(texts) == 5 and not any("Python" in t or "Arrow" in t for t in texts)


def brute_mix(docs, mix):
    leaves = defaultdict(int)
    for _, leaf, n in docs:
        leaves[leaf] += n
    budgets = M.leaf_budgets(leaves, mix)
    out = []
    for leaf, budget in budgets.items():
        for e in range(mix.epochs):
            left = budget - e * leaves[leaf]
            if left <= 0 and e:
                continue
            run = 0
            own = sorted((int(hashlib.md5(f"{mix.seed}:{e}:{k}".encode()).hexdigest()[:15], 16), k, n) for k, l, n in docs if l == leaf)
            for _, k, n in own:
                run += n
                if run > left:
                    break
                out.append((k, *leaf, n, e))
    return Counter(out)


def test_mixing_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "source", "text").collect()
    plain = [(r.doc_id, (f"domain{int(r.source[3:]) % 4}", r.lang, r.source), len(r.text.split())) for r in docs]
    for mix in (M.PRODUCTION, M.Mix(weights={("domain1",): 50}, share=50, epochs=2)):
        got = Counter(map(tuple, M.mix_sources(spark.read.parquet(f"{SF}/documents.parquet"), mix).collect()))
        assert got == brute_mix(plain, mix)


def test_water_fill_gives_shortages_to_siblings():
    assert M.water_fill(100, [(1, 10), (1, 100), (2, 100)]) == [10, 30, 60]
    assert M.water_fill(100, [(1, 10), (0, 100), (2, 20)]) == [10, 0, 20]
    assert sum(M.water_fill(101, [(1, 100), (1, 100), (1, 100)])) == 101
    leaves = {("a", "x", "1"): 10, ("a", "x", "2"): 90, ("b", "y", "3"): 900}
    got = M.leaf_budgets(leaves, M.Mix(share=20, epochs=1))
    assert got == {("a", "x", "1"): 10, ("a", "x", "2"): 90, ("b", "y", "3"): 100}


def test_mixing_odd_rows(spark):
    rows = [(1, None, "en", "src1"), (2, "", None, None), (3, "a b c", "en", "src1"), (3, "a b c", "en", "src1"), (None, "x", "de", "s"), (5, "w " * 20000, "en", "src2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as epoch", "2 as budget", "3 as place")
    out = M.mix_sources(docs, M.Mix(share=100, epochs=1)).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    assert M.mix_sources(docs.limit(0)).collect() == []


def test_budgets_equal_water_filling(spark):
    rnd = random.Random(4)
    for trial in range(4):
        leaves = {(rnd.choice([None, "", "a", "b"]), rnd.choice([None, "x", "y", "é"]), rnd.choice([None, *"stuvwz"])): rnd.choice([0, 1, 7, 10**3, 10**6, 10**12]) for _ in range(40)}
        weights = {p[: rnd.randint(1, 3)]: rnd.choice([0, 2, 3, 50]) for p in list(leaves)[:12]}
        mix = M.Mix(weights=weights if trial else {}, share=rnd.choice([7, 50, 80, 100]), epochs=1 + trial % 2)
        counted = spark.createDataFrame([(*leaf, n) for leaf, n in leaves.items()], "domain string, lang string, source string, n_tokens long")
        got, n = M.budgets_frame(counted, mix)
        assert n == len(leaves)
        assert {(r.domain, r.lang, r.source): r.budget for r in got.collect()} == M.leaf_budgets(leaves, mix)


def independent_budgets(leaves, mix):
    """Budgets by handing out one token at a time: always to the child furthest below its share that has room."""
    def usable(path):
        return sum(n * mix.epochs for leaf, n in leaves.items() if leaf[: len(path)] == path and all(mix.weights.get(leaf[:d], 1) for d in range(1, 4)))

    def share(path, tokens):
        if len(path) == 3:
            return {path: tokens}
        kids = sorted({leaf[: len(path) + 1] for leaf in leaves if leaf[: len(path)] == path})
        got = dict.fromkeys(kids, 0)
        for _ in range(tokens):
            kid = min((k for k in kids if got[k] < usable(k) and mix.weights.get(k, 1)), key=lambda k: (got[k] + 1) / mix.weights.get(k, 1))
            got[kid] += 1
        return {leaf: n for k in kids for leaf, n in share(k, got[k]).items()}

    return share((), min(usable(()), sum(leaves.values()) * mix.share // 100))


def test_budgets_with_zero_weights_against_single_tokens(spark):
    rnd = random.Random(8)
    for _ in range(3):
        leaves = {(f"d{rnd.randint(0, 2)}", rnd.choice("xyz"), f"s{rnd.randint(0, 3)}"): rnd.choice([0, 1, 30, 90]) for _ in range(16)}
        weights = {p[: rnd.randint(1, 3)]: rnd.choice([0, 0, 1, 3]) for p in rnd.sample(sorted(leaves), min(9, len(leaves)))}
        mix = M.Mix(weights=weights, share=rnd.choice([40, 80, 100]), epochs=2)
        counted = spark.createDataFrame([(*leaf, n) for leaf, n in leaves.items()], "domain string, lang string, source string, n_tokens long")
        got = {(r.domain, r.lang, r.source): r.budget for r in M.budgets_frame(counted, mix)[0].collect()}
        want = independent_budgets(leaves, mix)
        assert sum(got.values()) == sum(want.values())
        assert all(abs(got[k] - want[k]) <= 3 * len(leaves) for k in leaves)  # whole numbers are rounded otherwise
        assert all(not got[k] for k in leaves if not all(weights.get(k[:d], 1) for d in range(1, 4)))


def test_zero_weight_language_leaves_its_share_to_the_other_domain(spark):
    leaves = {("d0", "en", "a"): 1000, ("d0", "de", "b"): 10, ("d1", "en", "c"): 1000}
    mix = M.Mix(weights={("d0", "en"): 0}, share=80, epochs=1)
    assert M.leaf_budgets(leaves, mix) == {("d0", "en", "a"): 0, ("d0", "de", "b"): 10, ("d1", "en", "c"): 1000}


def test_mixing_keeps_a_row_per_selected_row(spark):
    rows = [(k, f"w{i} a b", "en", "src1") for k in (5, None) for i in range(6)] + [(5, "same", "en", "src1")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = M.mix_sources(docs, M.Mix(share=100, epochs=1), keep=("text",)).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter((r[0], r[1]) for r in rows)


def test_mixing_takes_more_than_100000_leaves(spark):
    docs = spark.range(100_003).selectExpr("id as doc_id", "repeat('w ', cast(id % 5 + 1 as int)) as text", "'en' as lang", "concat('host', id) as source")
    mix = M.Mix(share=60, epochs=1)
    budgets = M.leaf_budgets({(f"domain{i % 4}", "en", f"host{i}"): i % 5 + 1 for i in range(100_003)}, mix)
    got = M.mix_sources(docs, mix).collect()
    assert {r.doc_id for r in got} == {int(leaf[2][4:]) for leaf, b in budgets.items() if b >= int(leaf[2][4:]) % 5 + 1}
    assert 0 < len(got) < 100_003
