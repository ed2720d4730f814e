from __future__ import annotations

import html
import itertools
import random
import re
import zlib

from skein.llm import html as H
from skein.llm import toxicity as T
from skein.llm.queries import QUERIES
from tests.conftest import TESTDATA

SF = f"{TESTDATA}/sf0.01"


def plain_article(page):
    """What the test pages hold between <article> and </article>, by another way than the operator's."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    parts = re.split(r"</?(?:p|h1|br)>", inner)
    texts = [" ".join(html.unescape(re.sub(r"</?[a-z]+>", "", p)).split()) for p in parts]
    return " ".join(t for t in texts if t)


def test_articles_of_the_test_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = QUERIES["op7_html_extraction"](spark, SF).collect()
    assert len(got) == len(pages)
    wrong = [r.page_id for r in got if r.text != plain_article(pages[r.page_id].html)]
    assert not wrong, (wrong[:5], [r.text[:200] for r in got if r.page_id == wrong[0]], plain_article(pages[wrong[0]].html)[:200])
    assert all(r.n_chars == len(r.text) and r.url == pages[r.page_id].url for r in got)


def test_min_cut_is_minimal():
    rnd = random.Random(5)
    for _ in range(60):
        n = rnd.randint(1, 8)
        ratings = [rnd.choice([-2.0, -1.0, -0.5, 0.5, 1.0, 3.0]) for _ in range(n)]
        edges = [(i, j, rnd.random()) for i in range(n) for j in range(i + 1, n) if rnd.random() < 0.5]

        def cost(keep, ratings=ratings, edges=edges):
            return sum(max(r, 0) if not k else max(-r, 0) for r, k in zip(ratings, keep, strict=True)) + sum(c for u, v, c in edges if keep[u] != keep[v])

        best = min(cost(k) for k in itertools.product((False, True), repeat=n))
        assert abs(cost(H.min_cut(ratings, edges)) - best) < 1e-6


def test_boilerplate_goes_and_short_paragraphs_stay():
    page = """<html><head><title>no</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=x>Menu entry</a></nav>
    <div class="cookie-notice">We use cookies on this site. Accept them all, please.</div>
    <main><article><header><h1>Title &amp; more</h1></header><p>First   paragraph, long enough to be a text of its own.<p>Ti.</p>
    <div class="ad">Buy this thing now. It is cheap.</div><script>var x="</p>";</script><ul><li>one</li><li>two</li></ul><form><label>Mail</label></form>
    <p>Last &lt;one&gt; with <b>bo</b>ld&#233;.</p></article><section id="comments"><article class="comment"><p>Great article, I liked all of it a lot.</p></article></section></main>
    <aside><p>Related things that you may like to read as well.</p></aside><footer>&copy; someone</footer></body>"""
    assert H.main_text(page) == "Title & more First paragraph, long enough to be a text of its own. Ti. one two Last <one> with boldé."


def test_pages_without_article_and_odd_ones(spark):
    body = " ".join(f"Sentence number {i} of a longer text." for i in range(12))
    page = f'<body><div class="menu"><a href=a>Home</a> <a href=b>News</a></div><div class="post-content"><p>{body}</p><p>Short.</p></div><div id="footer">Imprint</div>'
    assert H.main_text(page) == f"{body} Short."
    titled = f'<div class="article-header"><h2>Own title</h2></div><div class="site-header"><p>Site name</p></div><iframe src=x><div class="entry-content"><p>{body}&nbsp;&#x2003; End.</p></div>'
    assert H.main_text(titled) == f"Own title {body} End."
    assert H.main_text(None) == H.main_text("") == H.main_text("<nav>x</nav>") == H.main_text("<!-- open") == ""
    assert H.main_text("<article><p>" + "<div>" * 3000 + "deep") == "deep"
    assert len(H.main_text("<article>" + "<p>word and more.</p>" * 5000)) == 5000 * 15 - 1
    rows = [(1, None, None), (2, "u", ""), (2, "u", ""), (None, "v", page)]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as key", "2 as text", "3 as k0")).collect()
    assert sorted((r.page_id or 0, r.url or "", r.n_chars) for r in got) == [(0, "v", len(body) + 7), (1, "", 0), (2, "u", 0), (2, "u", 0)]


def test_article_text_with_telling_names_stays():
    for page, text in (
        ('<article><p class="text alert">A text of some length that is marked.</p></article>', "A text of some length that is marked."),
        ('<article><p>First of the paragraphs, long enough.</p><h2 id="comments-on-law">Comments on law</h2><p>Second of the paragraphs, long enough.</p></article>', "First of the paragraphs, long enough. Comments on law Second of the paragraphs, long enough."),
        ('<article><div class="text-share-price">The price of a share rose.</div></article>', "The price of a share rose."),
        ("<h1>A story</h1><p>x is less than y today</p>", "A story x is less than y today"),
        ("<article><p>Let <math><mi>x</mi><mo>&lt;</mo><mn>3</mn></math> hold, and 1 < 2 too.</p></article>", "Let x<3 hold, and 1 < 2 too."),
        ('<article><p>Long enough to be the text.</p><div class="postComments"><p>Nice one, really, I liked it. Very much so! Indeed I did. Thanks.</p></div></article>', "Long enough to be the text."),
        ("<article>word</article><footer>Some company. All rights reserved. Call us, or write.</footer>", "word"),
    ):
        assert H.main_text(page) == text, page


def test_cut_decides_where_ratings_dont(spark):
    """A line's own rating is below 0; neighbours, parents and the article around it decide."""
    got = H.labels("<article><p>A paragraph of the article that says a thing or two. It goes on for a while, so it is long.</p><p>So.</p><p>Another paragraph of it, also with a thing to say. And it goes on.</p></article><p>So.</p>")
    assert [(r > 0, k) for _, r, k in got] == [(True, True), (False, True), (True, True), (False, False)]
    changed = every = 0
    for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect():
        for _, rating, kept in H.labels(r.html):
            changed, every = changed + ((rating > 0) != kept), every + 1
    print("blocks whose label the cut changes:", changed, "of", every)
    assert changed > 0.01 * every


def test_broken_markup_takes_linear_time():
    import time

    for unit in ("<div>word ", '<p x="', "<p x='>", "<svg>", "<a><b></i>", "<p></div>", "<!-", "<li><a href=x>w", "</p><p>w. ", "<table><tr><td>x"):
        began = time.perf_counter()
        H.main_text(unit * (1_000_000 // len(unit)))
        assert time.perf_counter() - began < 40, unit


def test_toxicity_held_out_and_contract(spark):
    got = {r.doc_id: r for r in QUERIES["op9_toxicity"](spark, f"{TESTDATA}/sf0.1").collect()}
    labels = spark.read.parquet(f"{TESTDATA}/sf0.1/labels.parquet").collect()
    assert len(got) == spark.read.parquet(f"{TESTDATA}/sf0.1/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for k, r in got.items())
    held = [(r.toxic, got[r.doc_id].predicted) for r in labels if got[r.doc_id].held_out]
    hit, false, missed = held.count((1, 1)), held.count((0, 1)), held.count((1, 0))
    assert hit / (hit + missed) > 0.6 and hit / (hit + false) > 0.9
    by_language = {}
    for r in labels:
        if got[r.doc_id].held_out:
            by_language.setdefault(got[r.doc_id].lang, []).append((r.toxic, int(got[r.doc_id].flagged)))
    figures = {lang: (x.count((1, 1)), x.count((1, 0)), x.count((0, 1)), x.count((0, 0))) for lang, x in sorted(by_language.items())}
    print("found, missed, falsely flagged, left alone by language:", figures)
    assert all(false <= 0.05 * (false + alone) for _, _, false, alone in figures.values()), figures
    assert sum(f[0] for f in figures.values()) >= 0.6 * sum(f[0] + f[1] for f in figures.values()), figures


def test_toxicity_odd_rows(spark):
    rows = [(i, ("you are an idiot today " if i % 3 == 0 else "a fine and quiet day ") + f"w{i} " * 5, "en" if i % 2 else None, int(i % 3 == 0)) for i in range(400)] + [(400, None, "en", 0), (401, "", "en", 1), (402, "word " * 150000 + "idiot", "en", 1), (402, "word", "en", None), (None, "x", "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    labels = docs.select("doc_id", "toxic")
    scored, model = T.toxicity(docs.drop("toxic").selectExpr("*", "1 as score", "2 as key", "3 as fold"), labels)
    got = scored.collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.score for r in got if r.doc_id is not None and r.doc_id < 400}
    assert sum((s >= 0.5) == (i % 3 == 0) for i, s in by.items()) > 380
    assert max(r.score for r in got if r.doc_id == 402) >= 0.5
    assert T.toxicity(docs.limit(0), labels.limit(0))[0].collect() == []
    assert {(r.lang, r.flagged) for r in got} >= {("en", True), ("en", False)} and all(r.flagged is not None for r in got)
    assert T.flag_by_language(docs.selectExpr("lang", "0.9D as score"), model).filter("flagged").count() == len(rows)


def test_toxicity_learns_from_every_label(spark, monkeypatch):
    """More labels than the 4,000 and 8,000 rows that were once drawn: all are counted, and several shards agree with one."""
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choices([f"w{j}" for j in range(300)], k=12)) + (" idiot" if i % 4 == 0 else ""), "en", int(i % 4 == 0)) for i in range(16_000)]
    docs = spark.createDataFrame(rows, "key long, text string, lang string, label int")
    counts = T.word_counts(T.labelled(docs.select("key", "text", "lang"), docs.select("key", "label")))
    training = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 > 1]
    word = T.token_ids("idiot")[0]
    assert len(training) > 9_000 and counts[0, 1, word[0]] >= sum(r[3] for r in training) > 2_000
    assert counts.sum() == sum(len(set(T.token_ids(r[1])[:, t].tolist())) for r in training for t in range(2))
    seen = []
    monkeypatch.setattr(T, "EPOCHS", 2)
    for shard in (20_000, 2_000):
        model = T.train(docs.select("key", "text", "lang"), docs.select("key", "label").repartition(3), shard=shard)
        again = T.train(docs.select("key", "text", "lang").repartition(5), docs.select("key", "label"), shard=shard)
        assert (model.tables == again.tables).all() and (model.shift, model.cuts) == (again.shift, again.cuts)
        seen.append([model.score(r[1]) >= 0.5 for r in rows[:500]])
    assert seen[0] == seen[1] == [r[3] == 1 for r in rows[:500]]
