"""Deduplication plan: catalog -> one action row per pending file.

The plan is computed, never simulated: it says which file is kept (moved to
the canonical store), which becomes a link to its master's canonical copy,
and which cannot be handled (missing file, directory not listed, link too
deep, group without its master, master without a copy).  Every pending file of
a group or of its own has a row.  Applying a plan is a set of upserts (processed marks, alias rows,
group stamps, counters); a second plan over the applied catalog holds no
``keep`` or ``link`` rows.

Columns: ``file_id, action, src, dst, link_target, reason, phase`` where
phase 0 is the non-duplicate pass (uniques and masters, in id order) and
phase 1 re-consolidates processed masters that lost their store entry.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from copyledger import constants as C
from copyledger.functions import paths as P
from copyledger.operators.collisions import resolve_counters
from copyledger.operators import stats as S
from copyledger.operators import upserts as U
from copyledger.operators.groups import groups_for_processing
from copyledger.sources import path_buckets as PB
from copyledger.sources import snapshots as SNAP
from copyledger.sources.snapshots import stage

REASON_NOT_FOUND = "file not found"
REASON_MASTER_NOT_FOUND = "master file not found"
REASON_DUP_MISSING = "duplicate already missing"
REASON_TOO_DEEP = "relative path too deep"
REASON_ORPHAN = "master not in catalog"
REASON_RECORDED = "already consolidated"
REASON_NO_COPY = "master has no stored copy"
REASON_UNREADABLE = "directory could not be listed"
PLAN_COLS = ("file_id", "action", "src", "dst", "link_target", "reason", "phase")


def recorded_store_paths(paths: DataFrame, store_listing: DataFrame | None = None) -> DataFrame:
    """First recorded consolidated path per file (``file_id, recorded``); with
    ``store_listing`` (``path``) only paths that still exist count."""
    kept = paths.filter(F.col("path_type") == C.PATH_CONSOLIDATED)
    if store_listing is not None:
        kept = kept.join(store_listing.select("path").distinct(), "path", "left_semi")
    return kept.groupBy("file_id").agg(F.min("path").alias("recorded"))


def with_presence(files: DataFrame, present: DataFrame) -> DataFrame:
    """Adds ``exists``: the original path is in the current listing, and
    ``unknown``: it is not, but it or a directory above it could not be read
    (a row of ``present`` with an ``error``), so nothing says it is gone."""
    failed = None
    if "error" in present.columns:
        failed = present.filter(F.col("error").isNotNull()).select(F.col("path").alias("_above")).distinct()
        present = present.filter(F.col("error").isNull())
    p = present.select(F.col("path").alias("_p")).distinct().withColumn("_hit", F.lit(True))
    out = (files.join(p, F.col("original_path") == F.col("_p"), "left")
           .withColumn("exists", F.coalesce("_hit", F.lit(False))).drop("_p", "_hit"))
    if failed is None:
        return out.withColumn("unknown", F.lit(False))
    parts = F.split("original_path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    below = (out.filter(~F.col("exists")).select(F.col("id").alias("_uid"), F.explode(above).alias("_above"))
             .join(failed, "_above", "left_semi").select("_uid").distinct())
    return (out.join(below, F.col("id") == F.col("_uid"), "left")
            .withColumn("unknown", F.col("_uid").isNotNull()).drop("_uid"))


def _row(action, src, dst, link, reason, phase, file_id="id"):
    return [F.col(file_id).alias("file_id"), F.lit(action).alias("action"),
            (src if src is not None else F.lit(None).cast("string")).alias("src"),
            (dst if dst is not None else F.lit(None).cast("string")).alias("dst"),
            (link if link is not None else F.lit(None).cast("string")).alias("link_target"),
            (F.lit(reason) if reason is not None else F.lit(None).cast("string")).alias("reason"),
            (phase if not isinstance(phase, int) else F.lit(phase)).alias("phase")]


def dedup_plan(files: DataFrame, groups: DataFrame, paths: DataFrame, present: DataFrame,
               store_root: str, legacy_group_skip: bool = False,
               store_hashes: DataFrame | None = None,
               store_listing: DataFrame | None = None) -> DataFrame:
    """The plan.  ``store_hashes`` (``id, store_hash``) names kept files that
    have no gate hash (``hash_scope='all'``: every stored file sits under its
    own hash prefix, nothing in the shared ``00/00/no_hash_*`` bucket); without
    it the parity layout is used.  ``present`` may carry the listing's
    ``error`` column; ``store_listing`` says which recorded copies still exist."""
    rec = recorded_store_paths(paths, store_listing)
    f = with_presence(files, present).join(rec, F.col("id") == F.col("file_id"), "left").drop("file_id")
    # The plan reads the annotated catalog from several branches: stage it
    # once (narrow columns only) instead of recomputing the joins per branch.
    f = stage(f.select("id", "original_path", "file_name", "file_hash", "is_duplicate",
                       "master_file_id", "deduplication_status", "exists", "unknown", "recorded"), "plan-input")
    pending_strict = F.col("deduplication_status") == C.STATUS_PENDING
    pending_loose = F.coalesce(F.col("deduplication_status"), F.lit(C.STATUS_PENDING)) == C.STATUS_PENDING
    non_dup = ~F.col("is_duplicate") & F.col("master_file_id").isNull()

    # Phase 0: pending uniques and masters.
    p0 = f.filter(pending_strict & non_dup)
    p0_unread = p0.filter(F.col("unknown")).select(
        *_row(C.ACTION_UNREADABLE, F.col("original_path"), None, None, REASON_UNREADABLE, 0))
    p0_missing = p0.filter(~F.col("exists") & ~F.col("unknown")).select(
        *_row(C.ACTION_MISSING, F.col("original_path"), None, None, REASON_NOT_FOUND, 0))
    p0_done = p0.filter(F.col("exists") & F.col("recorded").isNotNull()).select(
        *_row(C.ACTION_ALREADY_DONE, F.col("original_path"), F.col("recorded"), None, REASON_RECORDED, 0))
    p0_keep = p0.filter(F.col("exists") & F.col("recorded").isNull()) \
        .select("id", "original_path", "file_hash", "file_name", F.lit(0).alias("phase"))

    # Groups with at least one pending duplicate, and their masters.
    g = groups_for_processing(groups, legacy_group_skip).select(
        F.col("group_hash"), F.col("master_file_id").alias("g_master"))
    dups = f.filter(F.col("is_duplicate") & pending_loose).join(
        g, F.col("file_hash") == F.col("group_hash"), "inner")
    masters_needed = dups.select("g_master").distinct()
    m = f.select(F.col("id").alias("g_master"), F.col("original_path").alias("m_path"),
                 F.col("file_hash").alias("m_hash"), F.col("file_name").alias("m_name"),
                 F.col("exists").alias("m_exists"), F.col("unknown").alias("m_unknown"),
                 F.col("recorded").alias("m_recorded"),
                 (pending_strict & non_dup).alias("m_in_p0"))
    mstate = masters_needed.join(m, "g_master", "left")
    # Phase 1: processed masters with no store entry are consolidated again.
    p1 = mstate.filter(F.col("m_path").isNotNull() & F.col("m_recorded").isNull() & ~F.col("m_in_p0"))
    p1_keep = p1.filter(F.col("m_exists")).select(
        F.col("g_master").alias("id"), F.col("m_path").alias("original_path"),
        F.col("m_hash").alias("file_hash"), F.col("m_name").alias("file_name"), F.lit(1).alias("phase"))
    p1_unread = p1.filter(F.col("m_unknown")).select(
        *_row(C.ACTION_UNREADABLE, F.col("m_path"), None, None, REASON_UNREADABLE, 1, "g_master"))
    p1_missing = p1.filter(~F.col("m_exists") & ~F.col("m_unknown")).select(
        *_row(C.ACTION_MISSING, F.col("m_path"), None, None, REASON_MASTER_NOT_FOUND, 1, "g_master"))

    # Canonical names for every kept file (collision counters in (phase, id) order).
    keep = p0_keep.unionByName(p1_keep)
    if store_hashes is not None:
        sh = store_hashes.select(F.col("id").alias("_sid"), "store_hash")
        keep = (keep.join(sh, F.col("id") == F.col("_sid"), "left")
                .withColumn("file_hash", F.coalesce("file_hash", "store_hash"))
                .drop("_sid", "store_hash"))
    cands = P.with_store_location(keep, store_root, "file_hash", "file_name").select(
        "id", "dir", "base", F.col("phase").alias("ord0"), F.col("id").alias("ord1"))
    rec_all = paths.filter(F.col("path_type") == C.PATH_CONSOLIDATED).select(
        P.parent_dir("path").alias("dir"), P.basename("path").alias("name"))
    names = resolve_counters(cands, rec_all)
    keep_rows = keep.join(names.select("id", F.concat_ws("/", "dir", "name").alias("dst")), "id")
    keep_out = keep_rows.select(*_row(C.ACTION_KEEP, F.col("original_path"), F.col("dst"), None, None,
                                      F.col("phase")))

    # Where each needed master lives after the plan: one row per master, staged,
    # so the one join with the duplicates has plain inputs and AQE can split a
    # master that many files share.
    loc = stage(mstate.select("g_master", "m_path", "m_recorded")
                .join(keep_rows.select(F.col("id").alias("g_master"), F.col("dst").alias("m_planned")),
                      "g_master", "left")
                .select("g_master", F.coalesce("m_recorded", "m_planned").alias("m_loc"),
                        F.col("m_path").isNull().alias("_orphan")), "plan-masters")
    d = dups.join(loc, "g_master")
    orphan = d.filter(F.col("_orphan")).select(
        *_row(C.ACTION_ORPHAN_GROUP, F.col("original_path"), None, None, REASON_ORPHAN, 1))
    no_copy = d.filter(~F.col("_orphan") & F.col("m_loc").isNull()).select(
        *_row(C.ACTION_NO_COPY, F.col("original_path"), None, None, REASON_NO_COPY, 1))
    live = d.filter(~F.col("_orphan") & F.col("m_loc").isNotNull())
    unread = live.filter(F.col("unknown")).select(
        *_row(C.ACTION_UNREADABLE, F.col("original_path"), F.col("m_loc"), None, REASON_UNREADABLE, 1))
    gone = live.filter(~F.col("exists") & ~F.col("unknown")).select(
        *_row(C.ACTION_MISSING, F.col("original_path"), F.col("m_loc"), None, REASON_DUP_MISSING, 1))
    linkable = P.with_relpath(live.filter(F.col("exists")).withColumn("_parent", P.parent_dir("original_path")),
                              "m_loc", "_parent", "_target")
    too_deep = linkable.filter(P.dotdot_count("_target") >= C.MAX_LINK_DOTDOTS).select(
        *_row(C.ACTION_TOO_DEEP, F.col("original_path"), F.col("m_loc"), F.col("_target"), REASON_TOO_DEEP, 1))
    links = linkable.filter(P.dotdot_count("_target") < C.MAX_LINK_DOTDOTS).select(
        *_row(C.ACTION_LINK, F.col("original_path"), F.col("m_loc"), F.col("_target"), None, 1))

    out = p0_missing
    for part in (p0_unread, p0_done, keep_out, p1_unread, p1_missing, orphan, no_copy, unread, gone,
                 too_deep, links):
        out = out.unionByName(part)
    return out.select(*PLAN_COLS)


def is_error():
    return F.col("action").isin(*C.ERROR_ACTIONS) & \
        ~((F.col("action") == C.ACTION_MISSING) & (F.col("reason") == REASON_DUP_MISSING))


def plan_coverage(files: DataFrame, plan: DataFrame) -> DataFrame:
    """Pending files, and those of them that the plan has no row for (one row)."""
    pending = files.filter(F.col("deduplication_status") == C.STATUS_PENDING).select(F.col("id").alias("_id"))
    rows = plan.select("file_id").distinct()
    return pending.join(rows, F.col("_id") == F.col("file_id"), "left").agg(
        F.count("_id").alias("pending"), F.count_if(F.col("file_id").isNull()).alias("uncovered"))


def _outcome() -> list:
    return [F.count_if(F.col("action") == C.ACTION_KEEP).alias("files_consolidated"),
            F.count_if(F.col("action") == C.ACTION_LINK).alias("symlinks_created"),
            (F.count_if((F.col("action") == C.ACTION_KEEP) & (F.col("phase") == 0))
             + F.count_if(F.col("action") == C.ACTION_LINK)).alias("files_deduplicated"),
            F.count_if(is_error()).alias("errors")]


def plan_outcome(plan: DataFrame) -> DataFrame:
    """Run counters: consolidated, linked, processed, errors (one row)."""
    return plan.agg(*_outcome())


def stage_counted(plan: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """The plan written and read back, and its ``plan_outcome``, counted by the
    write itself (a task that is repeated counts once)."""
    seen = Observation(f"plan-{uuid.uuid4().hex}")
    staged = stage(plan.observe(seen, *_outcome()), "plan")
    return staged, {name: int(n) for name, n in seen.get.items()}


def plan_errors_top(plan: DataFrame, k: int = C.ERRORS_SHOWN) -> DataFrame:
    """First ``k`` errors (phase, file id order) plus one row counting the
    errors not shown (``file_id`` NULL, ``remaining`` set)."""
    errs = plan.filter(is_error())
    top = errs.orderBy("phase", "file_id").limit(k).select(
        "file_id", "action", "reason", "src", F.lit(None).cast("long").alias("remaining"))
    rest = errs.agg(F.count(F.lit(1)).alias("_n")).select(
        F.lit(None).cast("long").alias("file_id"), F.lit(None).cast("string").alias("action"),
        F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("src"),
        F.greatest(F.col("_n") - k, F.lit(0)).cast("long").alias("remaining"))
    return top.unionByName(rest)


def applied(files: DataFrame, groups: DataFrame, paths: DataFrame, plan: DataFrame,
            run_ts: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, groups, paths) after applying a plan."""
    done_actions = F.col("action").isin(C.ACTION_KEEP, C.ACTION_LINK) | \
        ((F.col("action") == C.ACTION_MISSING) & (F.col("reason") == REASON_DUP_MISSING))
    files2 = U.mark_processed(files, plan.filter(done_actions).select("file_id"), run_ts)
    new_paths = (plan.filter(F.col("action") == C.ACTION_KEEP)
                 .select("file_id", F.lit(C.PATH_CONSOLIDATED).alias("path_type"), F.col("dst").alias("path"))
                 .unionByName(plan.filter(F.col("action") == C.ACTION_LINK)
                              .select("file_id", F.lit(C.PATH_SYMLINK).alias("path_type"),
                                      F.col("src").alias("path"))))
    paths2 = U.insert_paths(paths, new_paths, run_ts)
    # A group is stamped when none of its pending duplicates failed, or when
    # none is pending and its master did not fail.
    hashes = files.select(F.col("id").alias("file_id"), "file_hash")
    per_group = plan.filter(F.col("phase") == 1).join(hashes, "file_id").groupBy("file_hash").agg(
        F.count_if(is_error()).alias("_bad"))
    ok = per_group.filter(F.col("_bad") == 0).select(F.col("file_hash").alias("group_hash"))
    loose = F.coalesce(F.col("deduplication_status"), F.lit(C.STATUS_PENDING)) == C.STATUS_PENDING
    waiting = files.filter(F.col("is_duplicate") & loose).select(F.col("file_hash").alias("group_hash")).distinct()
    failed = plan.filter(is_error()).select(F.col("file_id").alias("master_file_id")).distinct()
    idle = (groups.filter(F.col("duplicate_count") > 0).select("group_hash", "master_file_id")
            .join(waiting, "group_hash", "left_anti").join(failed, "master_file_id", "left_anti"))
    groups2 = U.mark_groups(groups, ok.unionByName(idle.select("group_hash")), run_ts)
    return files2, groups2, paths2


def commit_dedup(spark: SparkSession, root: str, present: DataFrame, store_root: str, run_ts: str,
                 **options) -> int:
    """One deduplication run over the catalog stored at ``root``: the plan is
    written once, applied to files, groups and alias rows, the statistics are
    refreshed with the run's counters, and all are committed as one version.
    ``options`` go to ``dedup_plan``."""
    version = SNAP.next_version(spark, root)
    old = SNAP.read_catalog(spark, root)
    plan, counted = stage_counted(
        dedup_plan(old["files"], old["duplicate_groups"], old["paths"], present, store_root, **options))
    tables = applied(old["files"], old["duplicate_groups"], old["paths"], plan, run_ts)
    new = {name: SNAP.write_table(table, root, name, version)
           for name, table in zip(("files", "duplicate_groups", "paths"), tables)}
    files = SNAP.read_entry(spark, root, "files", new["files"])
    held = SNAP.manifest(spark, root)["tables"]
    if "cells" in held:
        # only rows of the plan changed, and of a group nothing that is counted
        ids = plan.select(F.col("file_id").alias("id")).distinct()
        before, after = (S.statistic_cells(f.join(ids, "id", "left_semi")) for f in (old["files"], files))
        cells = S.moved_cells(old["cells"], before, after)
    else:
        cells = S.statistic_cells(files, SNAP.read_entry(spark, root, "duplicate_groups", new["duplicate_groups"]))
    new["cells"] = SNAP.write_table(cells, root, "cells", version)
    cells = SNAP.read_entry(spark, root, "cells", new["cells"])
    new["statistics"] = SNAP.write_table(
        S.upsert_stats(old["statistics"], S.statistics_from_cells(cells, plan_counters(spark, counted), run_ts)),
        root, "statistics", version)
    new |= {name: entry for name, entry in held.items() if name == PB.ENTRY}    # the run adds no files
    SNAP.commit(spark, root, version, entries=new)
    return version


def plan_counters(spark: SparkSession, counted: dict[str, int]) -> DataFrame:
    """The run's counters as statistics rows (``stat_name, stat_value``)."""
    return spark.createDataFrame([(name, str(counted[name])) for name in C.DEDUP_COUNTER_KEYS],
                                 "stat_name string, stat_value string")
