"""Incremental catalog maintenance: one scan batch as one Spark job.

listing rows -> new paths (anti-join) -> ids -> upsert -> size gate ->
fingerprint the candidates only -> set hashes -> regroup -> flags.

The fingerprint step is a function ``hasher(candidates) -> (id, file_hash)``
so the same job serves content tables (fingerprint computed in the scan and
looked up by path) and files on storage (sampled reads of at most 5 KiB per
candidate, after the gate).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyledger import schemas
from copyledger.functions.formatting import utc_ts
from copyledger.operators import gate as G
from copyledger.operators import stats as S
from copyledger.operators import upserts as U
from copyledger.operators.groups import apply_flags, groups_from_hashed
from copyledger.operators.ids import assign_ids, max_id
from copyledger.sources import path_buckets as PB
from copyledger.sources import snapshots as SNAP
from copyledger.sources.snapshots import stage

Hasher = Callable[[DataFrame], DataFrame]
BROADCAST_ROWS = 50_000


def merged_if_large(df: DataFrame) -> DataFrame:
    """A stored frame whose joins shuffle if it has more than ``BROADCAST_ROWS``
    rows: by the size of its compressed columns Spark would send millions of
    rows through the driver."""
    return df.hint("merge") if df.count() > BROADCAST_ROWS else df


def new_paths(scanned: DataFrame, prior_files: DataFrame) -> DataFrame:
    """Listed rows whose path is not in the catalog yet.

    The known paths among them are found with the batch as the build side, so
    a small batch never shuffles the catalog."""
    scanned = merged_if_large(scanned)
    known = prior_files.select("original_path").join(scanned.select("original_path"), "original_path", "left_semi")
    return scanned.join(known, "original_path", "left_anti")


def new_paths_bucketed(scanned: DataFrame, root: str, entry: dict) -> DataFrame:
    """``new_paths`` from the catalog's bucketed paths: a large batch moves, the catalog does not."""
    return scanned.join(PB.known_among(scanned, root, entry), "original_path", "left_anti")


def new_to_catalog(scanned: DataFrame, prior_files: DataFrame, root: str, tables: dict) -> DataFrame:
    """New rows by the bucketed paths if the version (``tables`` of its marker) has them, else by its files."""
    if PB.ENTRY in tables:
        return new_paths_bucketed(scanned, root, tables[PB.ENTRY])
    return new_paths(scanned, prior_files)


def with_ids(new_rows: DataFrame, prior_files: DataFrame) -> DataFrame:
    if "id" in new_rows.columns:
        return stage(new_rows, "fresh")  # several tables are derived from it
    return assign_ids(new_rows, ["original_path"], base_id=max_id(prior_files))


def hash_candidates(files: DataFrame, new_rows: DataFrame, prior_files: DataFrame,
                    scope: str) -> DataFrame:
    """Rows to fingerprint now (``id, original_path, file_size_bytes``)."""
    if scope == "catalog":
        need = G.backfill_candidates(files)
        return need.select("id", "original_path", "file_size_bytes")
    if scope == "batch":
        in_batch = G.size_candidates(new_rows).select("id", "original_path", "file_size_bytes")
        partners = G.cross_batch_candidates(new_rows, prior_files) \
            .filter(F.col("old_hash").isNull()).select(F.col("old_id").alias("id"))
        old = partners.join(prior_files.select("id", "original_path", "file_size_bytes"), "id")
        return in_batch.unionByName(old).dropDuplicates(["id"])
    raise ValueError(f"unknown candidate scope {scope!r}")


def scan_increment(prior_files: DataFrame, prior_groups: DataFrame, scanned: DataFrame,
                   run_ts: str, hasher: Hasher, scope: str = "catalog",
                   mode: str = "skip_known", recompute: str = "affected",
                   skip_hash: bool = False) -> tuple[DataFrame, DataFrame]:
    """(files, groups) after one scan batch.

    ``recompute="affected"`` (catalog scope, skip_known) touches only what the
    batch can change: the gate runs over rows whose size occurs in the batch,
    and groups and flags are rebuilt only for the hashes fingerprinted now.
    That relies on the prior catalog being gate-complete (every row whose size
    is shared carries a hash), which every catalog-scope run leaves behind; a
    catalog scanned otherwise is completed by ``backfill_candidates``.
    ``recompute="full"`` rebuilds the gate and all groups from the whole catalog.
    ``skip_hash`` records the new rows only (no gate, groups unchanged).
    """
    files, groups, _, _ = _scan(prior_files, prior_groups, scanned, new_paths(scanned, prior_files), run_ts,
                                hasher, scope, mode, recompute, skip_hash)
    return files, groups


def _scan(prior_files, prior_groups, scanned, new, run_ts, hasher, scope, mode, recompute, skip_hash):
    fresh = merged_if_large(with_ids(new, prior_files))
    if mode == "skip_known":
        added = U.new_file_rows(fresh, run_ts).select(*schemas.FILES.fieldNames())
        files = prior_files.select(*schemas.FILES.fieldNames()).unionByName(added)
    elif mode == "refresh":
        ids = fresh.select("original_path", F.col("id").alias("_nid"))
        rows = scanned.drop("id").join(ids, "original_path", "left").withColumnRenamed("_nid", "id")
        files = U.upsert_files(prior_files, rows, run_ts)
    else:
        raise ValueError(f"unknown scan mode {mode!r}")
    if skip_hash:
        change = Change(added, None, None, None) if mode == "skip_known" else None
        return files, prior_groups.select(*schemas.GROUPS.fieldNames()), fresh, change
    if recompute == "affected" and scope == "catalog" and mode == "skip_known":
        files, groups, change = _affected_update(prior_files, files, prior_groups, added, run_ts, hasher)
        return files, groups, fresh, change
    need = hash_candidates(files, fresh, prior_files, scope)
    hashes = _fingerprints(hasher, need)
    files = U.set_hashes(files, hashes, run_ts)
    groups_now = groups_from_hashed(files)
    files = apply_flags(files, groups_now).select(*schemas.FILES.fieldNames())
    groups = U.upsert_groups(prior_groups, groups_now, run_ts)
    return files, groups, fresh, None


def _fingerprints(hasher: Hasher, need: DataFrame) -> DataFrame:
    """Fingerprints of this run's candidates, staged in the shared folder:
    reading bytes is the expensive step and every table written by the run
    (files, groups, statistics) depends on it, so it happens exactly once."""
    return stage(hasher(need).select("id", "file_hash"), "fingerprints")


@dataclass
class Change:
    """Rows that a run changed: ``files`` as they are now (new ones included)
    and as they were, groups as they are now and as they were."""
    files: DataFrame
    files_before: DataFrame | None
    groups: DataFrame | None
    groups_before: DataFrame | None

    def years(self) -> list:
        return [r["year"] for r in self.files.select("year").distinct().collect()]

    def cells(self, cells: DataFrame) -> DataFrame:
        """The catalog's statistics cells after the change."""
        none = self.files.limit(0)
        before = S.statistic_cells(none if self.files_before is None else self.files_before, self.groups_before)
        return S.moved_cells(cells, before, S.statistic_cells(self.files, self.groups))


def _affected_update(prior_files: DataFrame, files: DataFrame, prior_groups: DataFrame, added: DataFrame,
                     run_ts: str, hasher: Hasher) -> tuple[DataFrame, DataFrame, Change]:
    # Sizes of this batch: only they can change the gate.
    sizes = added.filter(F.col("file_size_bytes").isNotNull()).select("file_size_bytes").distinct()
    touched = files.join(sizes, "file_size_bytes", "left_semi")
    need = G.backfill_candidates(touched).select("id", "original_path", "file_size_bytes")
    hashes = merged_if_large(_fingerprints(hasher, need)).filter(F.col("file_hash").isNotNull() & (F.col("file_hash") != ""))
    # Hashes fingerprinted now: only their groups can change.  Their members
    # are written once: files, groups and statistics are all derived from them.
    affected = hashes.select(F.col("file_hash").alias("group_hash")).distinct()
    hashed = U.set_hashes(files, hashes, run_ts)
    members = hashed.join(affected, hashed["file_hash"] == affected["group_hash"], "left_semi")
    members = merged_if_large(
        stage(apply_flags(members, groups_from_hashed(members)).select(*schemas.FILES.fieldNames()), "members"))
    changed = members.unionByName(added.join(members.select("id"), "id", "left_anti").select(*members.columns))
    ids = members.select("id")
    kept_files = prior_files.select(*schemas.FILES.fieldNames()).join(ids, "id", "left_anti")
    marks = affected.select(F.col("group_hash").alias("_aff"))
    hit = prior_groups["group_hash"] == marks["_aff"]
    old_groups = prior_groups.join(marks, hit, "left_semi")
    renewed = U.upsert_groups(old_groups, groups_from_hashed(members), run_ts)
    groups = prior_groups.join(marks, hit, "left_anti").select(*schemas.GROUPS.fieldNames()).unionByName(renewed)
    before = prior_files.join(ids, "id", "left_semi")
    return kept_files.unionByName(changed), groups, Change(changed, before, renewed, old_groups)


def path_rows(files: DataFrame, run_ts: str) -> DataFrame:
    """The 'original' alias row of every catalog file."""
    return files.select(F.col("id").alias("file_id"), F.lit("original").alias("path_type"),
                        F.col("original_path").alias("path"),
                        utc_ts(run_ts).alias("created_at"))


def scan_batch(catalog: dict[str, DataFrame], scanned: DataFrame, run_ts: str, hasher: Hasher,
               scope: str = "catalog", mode: str = "skip_known", skip_hash: bool = False,
               recompute: str = "affected") -> dict[str, DataFrame]:
    """One complete scan run over a stored catalog: files and groups, the
    'original' alias row of every new file (insert-or-ignore), and the
    statistics refreshed with the deduplication counters carried over."""
    files, groups, fresh, _ = _scan(catalog["files"], catalog["duplicate_groups"], scanned,
                                    new_paths(scanned, catalog["files"]), run_ts,
                                    hasher, scope, mode, recompute, skip_hash)
    paths = U.insert_paths(catalog["paths"], path_rows(fresh, run_ts), run_ts)
    fresh_stats = S.statistics_table(files, groups, catalog["statistics"], run_ts)
    stats = S.upsert_stats(catalog["statistics"], fresh_stats)
    return {"files": files, "duplicate_groups": groups, "paths": paths, "statistics": stats}


def commit_scan(root: str, scanned: DataFrame, run_ts: str, hasher: Hasher,
                scope: str = "catalog", mode: str = "skip_known", skip_hash: bool = False,
                recompute: str = "affected", source: str | None = None, bucket_paths: bool = False) -> int:
    """One scan run over the catalog stored at ``root``, committed as the next
    version; ``source`` is noted in its commit marker.  ``files`` and
    ``groups`` are written first; the alias rows and
    statistics are then derived from the stored tables, so the scan itself
    (fingerprint reads included) runs once.  ``bucket_paths`` stores the
    catalog's paths in buckets too; later runs keep and use them."""
    spark = scanned.sparkSession
    version = SNAP.next_version(spark, root)
    prior = SNAP.read_catalog(spark, root, version - 1)
    held = SNAP.manifest(spark, root, version - 1)["tables"]
    files, groups, fresh, change = _scan(prior["files"], prior["duplicate_groups"], scanned,
                                         new_to_catalog(scanned, prior["files"], root, held), run_ts, hasher,
                                         scope, mode, recompute, skip_hash)
    new: dict[str, dict] = {}

    def write(table: str, df: DataFrame, **options) -> DataFrame:
        new[table] = SNAP.write_table(df, root, table, version, **options)
        return SNAP.read_entry(spark, root, table, new[table])
    files_s = write("files", files, changed=change.years() if change else None)
    groups_s = write("duplicate_groups", groups)
    new_rows = merged_if_large(files_s.join(fresh.select("original_path"), "original_path", "left_semi"))
    write("paths", U.insert_paths(prior["paths"], path_rows(new_rows, run_ts), run_ts))
    # the statistics move with the rows that changed; neither files nor groups are read for them
    cells = write("cells", change.cells(prior["cells"]) if change and "cells" in held else S.statistic_cells(files_s, groups_s))
    write("statistics", S.upsert_stats(prior["statistics"], S.statistics_from_cells(cells, prior["statistics"], run_ts)))
    if PB.ENTRY in held or bucket_paths:
        new[PB.ENTRY] = PB.add_paths(fresh if PB.ENTRY in held else files_s, root, held.get(PB.ENTRY))
    SNAP.commit(spark, root, version, source, new)
    return version
