"""Canonical store and alias tables (the set form of moving files into a
content-addressed layout and replacing copies by links).

* canonical: one row per kept file (``canonical_path, file_id, file_hash,
  file_size_bytes, h1, h2``), written where the join leaves them.  ``h1`` and
  ``h2`` are columns, not folders, so the ``00`` bucket of unhashed files is no
  hot folder and no task writes 256 small files.
* alias: every catalogued path -> its canonical path (kept files map to
  themselves, duplicates to their master's copy).
* lookup: (hash, canonical path) -> the store file that holds the content, in
  ranges of hash and path.  A condition on the hash reads a few row groups of
  it and then only the store files they name; content is not moved for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from copyledger import constants as C


def _h(path_col: str, level: int):
    # dst = <store>/files/<h1>/<h2>/<name>: take the two directory names.
    parts = F.split(F.col(path_col), "/")
    return F.element_at(parts, -3 if level == 1 else -2)


def canonical_table(plan: DataFrame, files: DataFrame) -> DataFrame:
    keep = plan.filter(F.col("action").isin(C.ACTION_KEEP, C.ACTION_ALREADY_DONE))
    meta = files.select(F.col("id").alias("file_id"), "file_hash", "file_size_bytes")
    return keep.join(meta, "file_id").select(
        F.col("dst").alias("canonical_path"), "file_id", "file_hash", "file_size_bytes",
        _h("dst", 1).alias("h1"), _h("dst", 2).alias("h2"))


def alias_table(plan: DataFrame) -> DataFrame:
    kept = plan.filter(F.col("action").isin(C.ACTION_KEEP, C.ACTION_ALREADY_DONE)).select(
        F.col("src").alias("path"), F.col("dst").alias("canonical_path"), "file_id",
        F.lit("self").alias("kind"))
    linked = plan.filter(F.col("action") == C.ACTION_LINK).select(
        F.col("src").alias("path"), F.col("dst").alias("canonical_path"), "file_id",
        F.lit("link").alias("kind"))
    return kept.unionByName(linked)


def write_store(canonical_with_content: DataFrame, path: str) -> str:
    """Write the canonical rows (with their content) as the store table, as
    they come from the join: content moves once at most, and never to sort it."""
    canonical_with_content.write.mode("overwrite").parquet(path)
    return path


def write_lookup(spark: SparkSession, store: str, path: str, row_group_bytes: int = 1 << 20) -> str:
    """Write the lookup table of a store: narrow columns only, sorted by hash
    and path over range partitions, so files without a hash (which share one)
    are split by their paths."""
    entries = spark.read.parquet(store).select(
        "file_hash", "canonical_path", "file_id", "file_size_bytes", F.col("_metadata.file_name").alias("store_file"))
    keys = ["file_hash", "canonical_path"]
    (entries.repartitionByRange(*keys).sortWithinPartitions(*keys)
     .write.option("parquet.block.size", row_group_bytes).mode("overwrite").parquet(path))
    return path


def find_copies(spark: SparkSession, store: str, lookup: str, where: Column) -> DataFrame:
    """Store rows, with their content, for which ``where`` (a condition on
    ``file_hash``, ``canonical_path``, ``file_id`` or ``file_size_bytes``)
    holds.  The names of the store files that hold them come to the driver: no
    more than the store has files."""
    hits = spark.read.parquet(lookup).filter(where)
    names = [r[0] for r in hits.select("store_file").distinct().collect()]
    every = spark.read.parquet(store)
    held = spark.read.schema(every.schema).parquet(*[f"{store}/{n}" for n in names]) if names else every.limit(0)
    return held.filter(where)


def rebuild_check(alias: DataFrame, store: DataFrame, originals: DataFrame) -> DataFrame:
    """Resolve every original path through alias -> store and compare the
    full-content fingerprint with the original's.  One row of counts."""
    resolved = (alias.join(store.select("canonical_path", F.col("content_md5").alias("_stored")),
                           "canonical_path", "left")
                .join(originals.select("path", F.col("content_md5").alias("_orig")), "path", "left"))
    return resolved.agg(
        F.count(F.lit(1)).alias("paths"),
        F.count_if(F.col("_stored").isNotNull()).alias("resolved"),
        F.count_if(F.col("_stored") == F.col("_orig")).alias("identical"),
        F.count_if(F.col("_stored") != F.col("_orig")).alias("mismatched"))
