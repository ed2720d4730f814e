"""What several corpus operators share: cutting lineage, table paths, words."""

from __future__ import annotations

import os
import tempfile
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local one where unset and Spark is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), "skein-checkpoints")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Computes ``df`` once into the shared folder; its lineage starts there. Survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, reread: lineage is cut, and readers take the columns they need."""
    folder = f"{shared_folder(df.sparkSession)}/{name}-{uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def step_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a step's table in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


def step(df: DataFrame, folder: str) -> DataFrame:
    """``df`` written to ``folder`` and reread, like ``written``; the files of its shuffles go at once, not when the driver collects garbage.

    Python gets its rows by 4 MB, not just by their number, so that long texts don't add up.
    """
    spark = df.sparkSession
    settings = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 22)}
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        df.write.parquet(folder)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    return spark.read.schema(df.schema).parquet(folder)


def removed(spark: SparkSession, *folders: str) -> None:
    """Deletes tables of steps that no result is read from."""
    for f in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sampled(row: Column, share: float) -> Column:
    """Whether a value's 64-bit hash lies in the lowest ``share`` of all; holds for shares of any size."""
    return F.lit(True) if share >= 1 else F.xxhash64(row) < F.lit(int(share * (1 << 64)) - (1 << 63))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+``; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), "")


def barrier(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that the optimizer can't inline into later lambdas.

    A lambda that names an outer expression would compute it again for each element; a Generate
    node (over a one-element array) makes it a stored attribute.
    """
    name = "__barrier"
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.explode(F.array(row)).alias(name)).select(*[F.col(c) for c in df.columns if c not in columns], *[F.col(f"{name}.{n}").alias(n) for n in columns])
