"""The pipeline against a brute-force version of every stage."""

from __future__ import annotations

from collections import Counter, defaultdict

import corpus_pipeline as P
from skein.llm import quality as Q
from skein.llm.mixing import PRODUCTION
from tests.conftest import TESTDATA
from tests.llm.test_decontam import brute as brute_leaks
from tests.llm.test_quality_secrets import metrics
from tests.llm.test_warc_lines_mixing import brute_lines, brute_mix

SF = f"{TESTDATA}/sf0.001"


def quality_kept(rows):
    """ids that stay, with quantiles over sorted lists."""
    def binned(v):
        e = max(0, v.bit_length() - Q.SKETCH_BITS)
        return v >> e << e

    def at(values, percent):
        return sorted(values)[-(-percent * len(values) // 100) - 1]

    rated, groups = {}, defaultdict(list)
    for r in rows:
        n, _, symbols, dup, _, failed = metrics(r["text"])
        words = r["text"].split()
        lines = max(1, sum(bool(x.strip(" \t\x0b\x0c\r")) for x in r["text"].split("\n")))
        shout = sum(w.upper() == w and w.lower() != w and len(w) > 1 for w in words)
        ratios = {"symbol_ratio": 10**6 * symbols // max(n, 1), "shout_ratio": 10**6 * shout // max(n, 1), "dup_line_ratio": 10**6 * dup // lines}
        rated[r["doc_id"]] = (failed, ratios, (r["lang"], r["source"]))
        if not failed:
            for level in ((), (r["lang"],), (r["lang"], r["source"])):
                groups[level].append(ratios)
    out = set()
    for k, (failed, m, g) in rated.items():
        bad = failed
        for rule, resolution in Q.RULES.items():
            if failed:
                break
            q = None
            for level in ((), g[:1], g):
                own = [at([binned(x[rule]) for x in groups[level]], p) for p in (Q.LOW, Q.MIDDLE)]
                n = len(groups[level])
                q = own if q is None else [(n * a + Q.PRIOR * b) // (n + Q.PRIOR) for a, b in zip(own, q, strict=True)]
            bad = bad or m[rule] > q[1] + Q.SPREADS * (q[1] - q[0] + resolution)
        if not bad:
            out.add(k)
    return out


def similar_kept(rows):
    """ids of the smallest documents of each group linked by a Jaccard similarity of 0.8 or more."""
    rows = sorted(rows, key=lambda r: r["doc_id"])
    sets = []
    for r in rows:
        w = r["text"].lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {rows[i]["doc_id"] for i in range(len(rows)) if root(i) == i}


def test_stages_equal_brute_force(spark):
    assert [n for n, _ in P.STAGES] == ["quality rules", "line dedup", "simhash near-dedup", "benchmark decontamination", "source mix"]
    source = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r.asDict() for r in source.collect()]
    good = quality_kept(rows)
    rows = [r for r in rows if r["doc_id"] in good]
    texts = brute_lines([(r["doc_id"], r["text"]) for r in rows])
    rows = [r | {"text": x[0]} for r, x in zip(rows, texts, strict=True)]
    alone = similar_kept(rows)
    rows = [r for r in rows if r["doc_id"] in alone]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = brute_leaks([(r["doc_id"], r["text"]) for r in rows], items)
    rows = [r for r in rows if not leaks[r["doc_id"]]]
    mixed = brute_mix([(r["doc_id"], (f"domain{int(r['source'][3:]) % 4}", r["lang"], r["source"]), len(r["text"].split())) for r in rows], PRODUCTION)
    got = P.run(spark, SF)
    assert got.columns[:5] == list(P.COLUMNS)
    found = Counter((r.doc_id, r.domain, r.lang, r.source, r.n_tokens, r.epoch) for r in got.collect())
    assert found == mixed
    by = {r["doc_id"]: r["text"] for r in rows}
    assert all(r.text == by[r.doc_id] and r.n_chars == len(r.text) for r in got.collect())


def test_stages_take_odd_and_empty_tables(spark):
    rows = [(1, None, "en", "src1", None), (None, "", None, None, 0), (3, "word " * 40000, "en", "src1", 5), (4, "a\nb\n" * 200, "de", None, 1), (4, "a\nb\n" * 200, "de", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as kept", "2 as component")
    for name, stage in P.STAGES:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, SF)
            assert out.columns[:5] == list(P.COLUMNS), name
            assert table is docs or out.count() == 0
    assert P.line_dedup(spark, docs, SF).count() == len(rows)


def test_rows_that_repeat_or_lack_an_id_are_judged_each(spark):
    good = lambda i: " ".join(f"w{i}x{j}" for j in range(120))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").select("text").first()[0]
    rows = [(k, good(i), "en", "src1", 1) for i, k in enumerate([5, 5, None, None, 7, 8])]
    docs = lambda more: spark.createDataFrame(rows + more, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    count = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    want = Counter((r[0], r[1]) for r in rows)
    bad = [(5, "too short", "en", "src1", 1), (None, "too short", "en", "src1", 1)]
    assert count(P.quality_rules(spark, docs(bad), SF)) == want
    copies = [(5, good(0), "en", "src1", 1), (None, good(2), "en", "src1", 1), (6, good(1) + " one more", "en", "src1", 1), (9, good(2), "en", "src1", 1)]
    assert count(P.simhash_dedup(spark, docs(copies), SF)) == want
    leaks = [(5, f"{good(50)} {item} {good(51)}", "en", "src1", 1), (None, item, "en", "src1", 1)]
    assert count(P.decontamination(spark, docs(leaks), SF)) == want
    assert count(P.line_dedup(spark, docs(copies[:1]), SF)) == want + Counter({(5, good(0)): 1})
    mixed = P.source_mix(spark, docs([]), SF).collect()
    chosen = Counter((r.doc_id, r.text, r.epoch) for r in mixed)
    assert 0 < len(mixed) and max(chosen.values()) == 1 and not Counter((r.doc_id, r.text) for r in mixed if r.epoch == 0) - want
