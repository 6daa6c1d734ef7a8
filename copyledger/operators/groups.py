"""Duplicate groups, master election and duplicate flags.

Groups are one aggregate per hash: ``count``, ``sum``, ``min(id)`` and
``min_by(size, id)`` are all partial-aggregated before the shuffle, so a hash held by a
third of all rows costs one combined row per map task.  The master is the
lowest id (``min`` / ``min_by``, both hash-aggregated); flags reach the files through an equi-join on the hash (one row
per group on the build side; AQE splits a hot hash on the stream side).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP_COLS = ("group_hash", "file_size_bytes", "master_file_id", "duplicate_count",
              "total_size_bytes", "space_saved_bytes")


def _finish(agg: DataFrame) -> DataFrame:
    return (agg.filter(F.col("members") > 1)
            .select(
                F.col("group_hash"),
                F.col("master_size").alias("file_size_bytes"),
                F.col("master_id").alias("master_file_id"),
                (F.col("members") - 1).alias("duplicate_count"),
                F.col("total").alias("total_size_bytes"),
                (F.col("total") - F.col("master_size")).alias("space_saved_bytes")))


def groups_from_hashed(files: DataFrame, key: str = "hash") -> DataFrame:
    """Groups over rows that carry a hash: >= 2 members, master = min id."""
    hashed = files.filter(F.col("file_hash").isNotNull() & (F.col("file_hash") != ""))
    group_key = F.col("file_hash") if key == "hash" else \
        F.concat_ws(":", F.col("file_size_bytes").cast("string"), F.col("file_hash"))
    agg = (hashed.groupBy(group_key.alias("group_hash"))
           .agg(F.count(F.lit(1)).alias("members"),
                F.sum("file_size_bytes").alias("total"),
                F.min("id").alias("master_id"),
                F.min_by("file_size_bytes", "id").alias("master_size")))
    return _finish(agg)


def groups_from_fingerprints(files: DataFrame, fp_col: str = "content_fp",
                             key: str = "hash") -> DataFrame:
    """Size gate and grouping in one pass over the rows.

    Rows are first combined per (size, fingerprint); the gate keeps the
    (size, fingerprint) cells whose size holds >= 2 rows; cells are then
    regrouped by fingerprint.  Every shuffle carries aggregated cells, never
    file rows, and the input is read once.
    """
    cells = (files.filter(F.col("file_size_bytes").isNotNull())
             .groupBy("file_size_bytes", F.col(fp_col).alias("fp"))
             .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("min_id")))
    # Both branches read the same cell columns, so the cells' shuffle is
    # computed once and reused (the input is scanned once).
    shared = (cells.groupBy("file_size_bytes")
              .agg(F.sum("n").alias("size_n"), F.min("min_id").alias("any_id"))
              .filter((F.col("size_n") > 1) & F.col("any_id").isNotNull())
              .select("file_size_bytes"))
    # An inner join on the distinct shared sizes (a semi join would be pushed
    # below the aggregate and make the input be read twice).
    gated = cells.join(shared, "file_size_bytes", "inner")
    group_key = F.col("fp") if key == "hash" else \
        F.concat_ws(":", F.col("file_size_bytes").cast("string"), F.col("fp"))
    agg = (gated.groupBy(group_key.alias("group_hash"))
           .agg(F.sum("n").alias("members"),
                F.sum(F.col("n") * F.col("file_size_bytes")).alias("total"),
                F.min("min_id").alias("master_id"),
                F.min_by("file_size_bytes", "min_id").alias("master_size")))
    return _finish(agg)


def apply_flags(files: DataFrame, groups: DataFrame) -> DataFrame:
    """Sets ``is_duplicate`` and ``master_file_id`` from the groups (W2);
    rows outside a group are unique (flag false, master NULL).

    Only hashed rows take part in the join: unhashed rows (most files -- every
    unique size) would all share the NULL key and land on one reducer of a
    shuffle join, so they are unioned back with unique flags instead."""
    base = files.drop("is_duplicate", "master_file_id")
    hashed = base.filter(F.col("file_hash").isNotNull())
    unhashed = (base.filter(F.col("file_hash").isNull())
                .withColumn("is_duplicate", F.lit(False))
                .withColumn("master_file_id", F.lit(None).cast("long")))
    masters = groups.select(F.col("group_hash").alias("_gh"), F.col("master_file_id").alias("_master"))
    joined = hashed.join(masters, F.col("file_hash") == F.col("_gh"), "left")
    is_dup = F.col("_master").isNotNull() & (F.col("id") != F.col("_master"))
    flagged = (joined.withColumn("is_duplicate", is_dup)
               .withColumn("master_file_id", F.when(is_dup, F.col("_master")).cast("long"))
               .drop("_gh", "_master"))
    return flagged.unionByName(unhashed)


def groups_for_processing(groups: DataFrame, legacy_group_skip: bool = False) -> DataFrame:
    """Groups with at least one duplicate; parity mode also skips groups
    already stamped as processed."""
    out = groups.filter(F.col("duplicate_count") > 0)
    if legacy_group_skip and "deduplicated_at" in groups.columns:
        out = out.filter(F.col("deduplicated_at").isNull())
    return out


def group_members(groups: DataFrame, files: DataFrame) -> DataFrame:
    """Group -> member files on the hash (the per-group file list, as a join)."""
    g = groups.select(F.col("group_hash"), F.col("master_file_id").alias("group_master_id"))
    return files.join(g, files["file_hash"] == g["group_hash"], "inner")


def verify_full(files: DataFrame, full_hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``verify='full'``: members of sampled-hash groups get their full-content
    hash (``full_hashes``: id, full_hash -- read for those members only) and
    groups are rebuilt on it, splitting sampled collisions.  Returns
    (files with ``file_hash`` replaced for re-hashed members, groups)."""
    sampled = groups_from_hashed(files)
    members = group_members(sampled, files).select("id")
    full = full_hashes.join(members, "id", "left_semi").select("id", F.col("full_hash").alias("_full"))
    refined = (files.join(full, "id", "left")
               .withColumn("file_hash", F.coalesce("_full", "file_hash")).drop("_full"))
    return refined, groups_from_hashed(refined)
