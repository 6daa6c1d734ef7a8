"""Helpers shared by the corpus operators: reading, staging, row keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from copyledger.session import scratch_path, ship_package

#: Characters that separate words and are stripped from lines.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Rows of one Arrow batch: bounds a Python worker's memory when texts are long.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, kind: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back.

    Cuts lineage (a lost executor re-reads files), freezes values and gives
    later joins a plain scan, so AQE sees real sizes and can split hot keys.
    """
    spark = df.sparkSession
    path = scratch_path(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def python_ready(spark: SparkSession) -> SparkSession:
    """Ship the package to Python workers and bound their Arrow batches."""
    ship_package(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    return spark


def row_key() -> Column:
    """Identity of a row: equal only for rows with the same id and text."""
    return F.xxhash64(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")))


def keep_rows(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """``docs`` rows whose key is (``left_semi``) or is not (``left_anti``) in
    ``keys(key, id)``; every column of ``docs`` is kept under its own name."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       row_key().alias("key"), F.col("doc_id").alias("id"))
    keys = keys.select(F.col("key").alias("k"), F.col("id").alias("i"))
    out = rows.join(keys, (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("i")), how)
    return out.select("row.*")
