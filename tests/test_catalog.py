"""Every query of the catalog against its SQL in DuckDB."""

from __future__ import annotations

import os

import pytest

from skein.plans import catalog
from tests.conftest import TESTDATA
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, name):
    sf_dir = f"{TESTDATA}/sf0.01"
    df = catalog.QUERIES[name](spark, sf_dir)
    compare(df, catalog.ORACLE[name], sf_dir)


def test_text_file_is_written_and_read_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "shared_folder", lambda spark: str(tmp_path / "text"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "12")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        df = catalog.src_text_file(spark, f"{TESTDATA}/sf0.01")
        assert len(os.listdir(tmp_path / "text")) == 12
        compare(df, catalog.ORACLE["src_text_file"], f"{TESTDATA}/sf0.01")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_entry_names_every_catalog_query():
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
