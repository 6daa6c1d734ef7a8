"""Questions about a stored catalog: what is pending, what is gone, which
references point nowhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyledger import constants as C


def pending(files: DataFrame) -> DataFrame:
    """Files not processed yet."""
    return files.filter(F.col("deduplication_status") == C.STATUS_PENDING)


def pending_unique(files: DataFrame) -> DataFrame:
    """Pending files that are nobody's duplicate."""
    return pending(files).filter(~F.col("is_duplicate") & F.col("master_file_id").isNull())


def missing(files: DataFrame, present: DataFrame) -> DataFrame:
    """Pending files whose path is not in the listing ``present(path)``."""
    gone = F.col("original_path") == F.col("_p")
    return pending(files).join(present.select(F.col("path").alias("_p")), gone, "left_anti")


def fk_audit(files: DataFrame, groups: DataFrame, paths: DataFrame) -> DataFrame:
    """One row: alias rows, duplicates and groups that point at a file id the
    catalog does not hold (a null reference is none)."""
    def dangling(df: DataFrame, ref: str, tag: str) -> DataFrame:
        ids = files.select(F.col("id").alias("_id"))
        refs = df.filter(F.col(ref).isNotNull()).select(F.col(ref).alias("_ref"))
        return refs.join(ids, F.col("_ref") == F.col("_id"), "left_anti").select(F.lit(tag).alias("t"))

    tagged = (dangling(paths, "file_id", "p").unionByName(dangling(files, "master_file_id", "m"))
              .unionByName(dangling(groups, "master_file_id", "g")))
    return tagged.agg(F.count_if(F.col("t") == "p").alias("paths_without_file"),
                      F.count_if(F.col("t") == "m").alias("duplicates_without_master"),
                      F.count_if(F.col("t") == "g").alias("groups_without_master"))
