"""Registered queries of the corpus operators and, where SQL can say the same, their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import oracles
from skein.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {"op1_suffix_dedup": oracles.OP1, "op5_quality_rules": oracles.OP5, "op6_line_dedup": oracles.OP6, "op10_mixing_sources": oracles.OP10}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.quality import quality

    judged = quality(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "adaptive_failed", "kept")


@query
def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.secrets import KINDS, listed, scan_secrets

    found = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.sort_array(F.concat("base", "linked"))).alias("spans"), F.size("linked").cast("long").alias("n_linked"))


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from uuid import uuid4

    from skein.llm.common import shared_folder
    from skein.llm.warc import read_index, write_archive

    folder = f"{shared_folder(spark)}/warc-{uuid4().hex}"
    write_archive(table(spark, sf_dir, "pages"), folder)
    index = read_index(spark, folder)
    return index.select(F.col("key").alias("page_id"), F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.col("refers_to_key").alias("refers_to"), "sound")


ORACLE["op2_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS s, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST(1 + ((CAST('0x' || s[CAST(1 + 5 * (i // 4) AS INTEGER):CAST(5 + 5 * (i // 4) AS INTEGER)] AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS INTEGER)]), 'string_agg', '') AS payload_digest,
CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to, true AS sound FROM d"""


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.lines import dedup_lines

    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", F.md5("kept_text").alias("kept_md5"))


@query
def op10_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.mixing import PRODUCTION, mix_sources

    return mix_sources(table(spark, sf_dir, "documents"), PRODUCTION)


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.toxicity import toxicity

    scored, _ = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "lang", "flagged")


@query
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.html import extract

    return extract(table(spark, sf_dir, "pages"))


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.substrings import dedup_substrings

    return dedup_substrings(table(spark, sf_dir, "documents"))
