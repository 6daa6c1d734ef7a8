"""Size gate: only files that share a size with another file are fingerprinted.

All forms aggregate before they join, so a size held by a third of all rows
is combined map-side and the join's skewed side is split by AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def size_classes(files: DataFrame, min_members: int = 2) -> DataFrame:
    """Sizes held by at least ``min_members`` rows (NULL sizes never qualify)."""
    return (files.filter(F.col("file_size_bytes").isNotNull())
            .groupBy("file_size_bytes")
            .agg(F.count(F.lit(1)).alias("file_count"))
            .filter(F.col("file_count") >= min_members))


def size_candidates(files: DataFrame) -> DataFrame:
    """Rows whose size occurs at least twice (semi-join on the size classes)."""
    return files.join(size_classes(files).select("file_size_bytes"), "file_size_bytes", "left_semi")


def mark_candidates(files: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Adds ``is_candidate``: the row's size occurs at least twice in ``scope``
    (default: ``files`` itself)."""
    classes = size_classes(files if scope is None else scope) \
        .select("file_size_bytes", F.lit(True).alias("_cand"))
    # Rows without a size never qualify and would all share the NULL key.
    unsized = files.filter(F.col("file_size_bytes").isNull()).withColumn("is_candidate", F.lit(False))
    return (files.filter(F.col("file_size_bytes").isNotNull()).join(classes, "file_size_bytes", "left")
            .withColumn("is_candidate", F.coalesce(F.col("_cand"), F.lit(False)))
            .drop("_cand").unionByName(unsized))


def apply_gate(files: DataFrame, fp_col: str, scope: DataFrame | None = None) -> DataFrame:
    """``file_hash`` = the fingerprint for candidate rows, NULL otherwise."""
    marked = mark_candidates(files, scope)
    return marked.withColumn("file_hash", F.when(F.col("is_candidate"), F.col(fp_col))).drop("is_candidate")


def cross_batch_candidates(new_rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Batch-scope gate of the original tool: catalog rows of equal size and
    case-insensitively equal name to a new row whose size is held by >= 2 new
    rows.  The new side is first reduced to one row per (size, name) with its
    match count, so a hot key never yields all new x old pairs."""
    batch_sizes = size_classes(new_rows).select("file_size_bytes")
    keys = (new_rows.join(batch_sizes, "file_size_bytes", "left_semi")
            .groupBy("file_size_bytes", F.lower("file_name").alias("name_key"))
            .agg(F.count(F.lit(1)).alias("new_matches")))
    old_c = catalog.select(
        F.col("id").alias("old_id"), "file_size_bytes",
        F.lower("file_name").alias("name_key"),
        F.col("original_path").alias("old_path"),
        F.col("file_hash").alias("old_hash"))
    # New and catalog rows are disjoint path sets, so a match is never the row itself.
    return (old_c.join(keys, ["file_size_bytes", "name_key"], "inner")
            .select("old_id", "file_size_bytes", "old_path", "old_hash", "new_matches"))


def backfill_candidates(catalog: DataFrame) -> DataFrame:
    """Rows still without a hash whose size is shared across the catalog."""
    return size_candidates(catalog).filter(F.col("file_hash").isNull())
