"""Table maintenance as set operations (parquet tables have no MERGE).

Every upsert is a join on the natural key followed by a per-column choice
between the old and the new value; each writes a new snapshot version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyledger import constants as C
from copyledger import schemas
from copyledger.functions.formatting import utc_ts
from copyledger.sources.snapshots import stage

METADATA_COLS = ("file_name", "file_size_bytes", "created_at", "year", "month",
                 "month_day", "project_name")
KEPT_COLS = ("id", "file_hash", "is_duplicate", "master_file_id",
             "deduplication_status", "deduplication_timestamp")


def new_file_rows(rows: DataFrame, run_ts: str) -> DataFrame:
    """Catalog rows for freshly listed files (with ids)."""
    return (rows.withColumn("file_hash", F.lit(None).cast("string"))
            .withColumn("scan_timestamp", utc_ts(run_ts))
            .withColumn("is_duplicate", F.lit(False))
            .withColumn("master_file_id", F.lit(None).cast("long"))
            .withColumn("deduplication_status", F.lit(C.STATUS_PENDING))
            .withColumn("deduplication_timestamp", F.lit(None).cast("timestamp")))


def upsert_files(prior: DataFrame, scanned: DataFrame, run_ts: str) -> DataFrame:
    """Upsert by path: rows of ``scanned`` (carrying ``id`` for new paths)
    overwrite the metadata columns and the scan time of known paths; hash,
    flags, status and id of known paths are kept, unless the size or the time
    changed: then the content did, so the hash, the flags and the status are
    cleared and the row is gated and grouped again.  Unseen known rows stay.

    The batch is written first, so its size is known: a small one is sent to
    the catalog's tasks, which then never move; a large one is joined by
    shuffles.  New paths are what is left of the batch without the catalog's
    paths among it."""
    new = stage(scanned.select("original_path", "id", *METADATA_COLS), "upsert-batch")
    cols = schemas.FILES.fieldNames()
    old = prior.select(*[F.col(c).alias("o_" + c) for c in cols])
    known = prior.select("original_path").join(new.select("original_path"), "original_path", "left_semi")
    fresh = new_file_rows(new.join(known, "original_path", "left_anti"), run_ts)
    n = new.select(*[F.col(c).alias("n_" + c) for c in ("original_path", *METADATA_COLS)])
    j = old.join(n, F.col("o_original_path") == F.col("n_original_path"), "left")
    seen = F.col("n_original_path").isNotNull()
    changed = seen & ~(F.col("o_file_size_bytes").eqNullSafe(F.col("n_file_size_bytes"))
                       & F.col("o_created_at").eqNullSafe(F.col("n_created_at")))
    cleared = {"is_duplicate": F.lit(False), "deduplication_status": F.lit(C.STATUS_PENDING)}
    out = []
    for c in cols:
        if c in METADATA_COLS:
            value = F.when(seen, F.col("n_" + c)).otherwise(F.col("o_" + c))
        elif c == "scan_timestamp":
            value = F.when(seen, utc_ts(run_ts)).otherwise(F.col("o_" + c))
        elif c in KEPT_COLS and c != "id":
            value = F.when(changed, cleared.get(c, F.lit(None))).otherwise(F.col("o_" + c))
        else:
            value = F.col("o_" + c)
        out.append(value.alias(c))
    return j.select(*out).unionByName(fresh.select(*cols))


def set_hashes(files: DataFrame, hashes: DataFrame, run_ts: str) -> DataFrame:
    """New hashes (``id, file_hash``) win; rows that got one have their scan
    time refreshed; empty hashes are ignored."""
    h = hashes.filter(F.col("file_hash").isNotNull() & (F.col("file_hash") != "")) \
        .select(F.col("id").alias("_hid"), F.col("file_hash").alias("_new_hash"))
    j = files.join(h, F.col("id") == F.col("_hid"), "left")
    got = F.col("_new_hash").isNotNull()
    return (j.withColumn("file_hash", F.coalesce("_new_hash", "file_hash"))
            .withColumn("scan_timestamp", F.when(got, utc_ts(run_ts))
                        .otherwise(F.col("scan_timestamp")))
            .drop("_hid", "_new_hash"))


def upsert_groups(prior_groups: DataFrame, fresh: DataFrame, run_ts: str) -> DataFrame:
    """Recomputed groups keep the creation and processed times of the group
    they replace; groups that fell to one member disappear."""
    old = prior_groups.select(F.col("group_hash").alias("_g"),
                              F.col("created_at").alias("_created"),
                              F.col("deduplicated_at").alias("_done"))
    j = fresh.join(old, F.col("group_hash") == F.col("_g"), "left")
    return (j.withColumn("created_at", F.coalesce("_created", utc_ts(run_ts)))
            .withColumn("deduplicated_at", F.col("_done"))
            .select(*schemas.GROUPS.fieldNames()))


def mark_processed(files: DataFrame, done_ids: DataFrame, run_ts: str,
                   status: str = C.STATUS_DONE) -> DataFrame:
    """Status and time for the ids in ``done_ids`` (column ``file_id``)."""
    d = done_ids.select(F.col("file_id").alias("_done_id")).distinct()
    j = files.join(d, F.col("id") == F.col("_done_id"), "left")
    hit = F.col("_done_id").isNotNull()
    return (j.withColumn("deduplication_status", F.when(hit, F.lit(status))
                         .otherwise(F.col("deduplication_status")))
            .withColumn("deduplication_timestamp", F.when(hit, utc_ts(run_ts))
                        .otherwise(F.col("deduplication_timestamp")))
            .drop("_done_id"))


def mark_groups(groups: DataFrame, done_hashes: DataFrame, run_ts: str) -> DataFrame:
    """Stamp ``deduplicated_at`` on the groups in ``done_hashes`` (column
    ``group_hash``) that are not stamped yet."""
    d = done_hashes.select(F.col("group_hash").alias("_dh")).distinct()
    j = groups.join(d, F.col("group_hash") == F.col("_dh"), "left")
    return (j.withColumn("deduplicated_at", F.when(
        F.col("_dh").isNotNull() & F.col("deduplicated_at").isNull(),
        utc_ts(run_ts)).otherwise(F.col("deduplicated_at")))
            .drop("_dh"))


def insert_paths(existing: DataFrame, candidates: DataFrame, run_ts: str | None = None) -> DataFrame:
    """Insert-or-ignore on (file_id, path_type, path).

    The stored rows that a candidate repeats are found first, with the
    candidates as the build side: a small batch never shuffles the table."""
    key = ["file_id", "path_type", "path"]
    wanted = candidates.select(*key).dropDuplicates(key)
    fresh = wanted.join(existing.select(*key).join(wanted, key, "left_semi"), key, "left_anti")
    ts = utc_ts(run_ts) if run_ts else F.lit(None).cast("timestamp")
    return existing.select(*schemas.PATHS.fieldNames()).unionByName(
        fresh.withColumn("created_at", ts).select(*schemas.PATHS.fieldNames()))
