"""The exact way of the quality rules: equal hash bits and very many windows."""

from __future__ import annotations

from skein.llm import quality as Q
from tests.llm.test_quality_secrets import metrics


def test_exact_way_gives_the_same_numbers(spark, monkeypatch):
    monkeypatch.setattr(Q, "PLACE_BITS", 5)  # 32 places: longer texts take the exact way
    rows = [(i, " ".join(f"w{(j * (i + 3)) % 37}" for j in range(n))) for i, n in enumerate((3, 31, 33, 34, 35, 60, 200, 900))]
    got = {r.doc_id: r.n_repeat_words for r in Q.metrics(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: metrics(t)[4] for i, t in rows}
