"""A corpus pipeline of five stages over ``documents``; each one reads what the one before it wrote.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but
the last return the columns of documents. ``run`` writes each stage as Parquet into the shared folder
and rereads it. No stage can be said in SQL as a whole, so ``ORACLE_SQL`` is None and the tests hold
``run`` against a brute-force version.

Every row is a document, told apart by a row number: rows that repeat a doc_id, or have none, are judged
each by itself, and no stage gives out more rows than it reads (the last: than rows times epochs). Null texts
count as empty ones; languages and sources may be null. Empty tables give empty tables. Further columns
are left out. Texts cross no shuffle to be filtered: row numbers of what goes meet just the rows
that a filter of fixed size lets through.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.bitmaps import without
from skein.llm.common import cut, shared_folder, table, written
from skein.llm.decontam import contaminated
from skein.llm.lines import dedup_lines
from skein.llm.mixing import PRODUCTION, mix_sources
from skein.llm.quality import quality
from skein.llm.simhash import similar_documents

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__row``, a number of its own for every row that stays the same whenever it is read.

    Rows of files have their file's number and their place in it, so nothing is written. Other tables are written
    with their numbers. The list of files, which the driver of Spark holds anyway, is what is broadcast.
    """
    plain = docs.select(*COLUMNS)
    try:
        placed = plain.select(*COLUMNS, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at")) if docs.inputFiles() else None
    except AnalysisException:  # made from files by more than reading them
        placed = None
    if placed is None:
        return written(plain.withColumn("__row", F.monotonically_increasing_id()), "pipeline-rows")
    files = sorted(r[0] for r in placed.select("__file").distinct().collect())
    known = docs.sparkSession.createDataFrame([(f, i << 40) for i, f in enumerate(files)], "__name string, __base long")
    return placed.join(F.broadcast(known), F.col("__file") == F.col("__name")).select(*COLUMNS, (F.col("__base") + F.col("__at")).alias("__row"))


def drop(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` but for those whose ``__row`` is in ``gone``."""
    return without(rows, "__row", gone).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed or the learned rules reject go."""
    rows = numbered(docs)
    return drop(rows, cut(quality(rows, key="__row").filter("not kept").select("__row")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go; every document stays, with its new text and length."""
    kept = dedup_lines(docs, keep=("lang", "source"))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 or more on five-word shingles, the document with the smallest id stays."""
    rows = numbered(docs)
    return drop(rows, cut(similar_documents(rows, row="__row").filter("not first").select("row")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    rows = numbered(docs)
    return drop(rows, cut(contaminated(rows, table(spark, sf_dir, "benchmark"), key="__row").filter("contaminated").select("__row")))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The production mix: a row per selected document and epoch, with domain, n_tokens and epoch."""
    return mix_sources(docs, PRODUCTION, keep=("text", "n_chars")).select(*COLUMNS, "domain", "n_tokens", "epoch")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", simhash_dedup),
    ("benchmark decontamination", decontamination),
    ("source mix", source_mix),
]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another; the result of the last one, read from where it was written."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
