"""Properties of the catalog jobs on the sf0.001 fixture."""

from pyspark.sql import functions as F

from copyledger import schemas
from copyledger.operators import listing
from copyledger.plans import dedup_plan as DP
from copyledger.plans import incremental as INC
from copyledger.registry import REGISTRY

from conftest import SMALL


def _set(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


def test_two_batches_equal_one_scan(spark):
    one = _set(REGISTRY["duplicate_groups"](spark, SMALL), "group_hash", "master_file_id", "duplicate_count",
               "total_size_bytes", "space_saved_bytes")
    two = _set(REGISTRY["incremental_groups"](spark, SMALL), "group_hash", "master_file_id", "duplicate_count",
               "total_size_bytes", "space_saved_bytes")
    assert one == two and len(one) == 4


def test_report_totals_equal_statistics(spark):
    s = REGISTRY["report_summary"](spark, SMALL).first()
    st = {r.stat_name: r.value_num for r in REGISTRY["statistics_table"](spark, SMALL).collect()}
    assert st["total_files"] == s.total_files == 144
    assert st["duplicate_files"] == s.duplicate_files
    assert st["space_saved_bytes"] == s.space_saved_bytes
    g = REGISTRY["duplicate_groups"](spark, SMALL).collect()
    assert s.space_saved_bytes == sum(r.space_saved_bytes for r in g)
    assert s.duplicate_files == sum(r.duplicate_count for r in g)


def test_plan_idempotent_and_store_lossless(spark):
    again = {(r.action, r.reason): r["count"] for r in REGISTRY["idempotent_rerun"](spark, SMALL).collect()}
    assert ("keep", None) not in again and ("link", None) not in again
    chk = REGISTRY["rebuild_check"](spark, SMALL).first()
    assert chk.paths == chk.resolved == chk.identical == 144 and chk.mismatched == 0
    fk = REGISTRY["fk_audit"](spark, SMALL).first()
    assert tuple(fk) == (0, 0, 0)
    alias = REGISTRY["alias_table"](spark, SMALL)
    assert alias.select("path").distinct().count() == 144
    canon = REGISTRY["dedup_plan"](spark, SMALL).filter(F.col("action") == "keep")
    assert canon.select("dst").distinct().count() == canon.count()       # destinations unique


def test_layout_filters(spark):
    rows = [("/r/2025/october/10_01/projA/a.mp4", False), ("/r/2025/october/10_01/projA/sub/B.MOV", False),
            ("/r/2025/october/10_01/projA/.hid.mp4", False), ("/r/2025/october/10_01/projA/_us.mp4", False),
            ("/r/2025/october/10_01/_projB/c.mp4", False), ("/r/2025/october/10_01/projA/n.txt", False),
            ("/r/2025/october/10_01/stray.mp4", False), ("/r/.hidden/files/00/x/x.mp4", False),
            ("/r/2025/october/10_01/projA/link.mp4", True), ("/r/2025/october/10_01/pr oj=C/é f.mp4", False),
            ("/r/2025/.october/10_01/p/q.mp4", False), ("/other/2025/october/10_01/p/q.mp4", False)]
    df = spark.createDataFrame([(p, 1, None, l, None) for p, l in rows],
                               "path string, size long, mtime timestamp_ntz, is_link boolean, error string")
    got = sorted(r.original_path for r in listing.catalog_rows(df, "/r").collect())
    assert got == sorted(["/r/2025/october/10_01/projA/a.mp4", "/r/2025/october/10_01/projA/sub/B.MOV",
                          "/r/2025/october/10_01/projA/.hid.mp4", "/r/2025/october/10_01/projA/_us.mp4",
                          "/r/2025/october/10_01/_projB/c.mp4", "/r/2025/october/10_01/pr oj=C/é f.mp4"])
    sub = listing.catalog_rows(df, "/r", subfolder="2025/october").count()
    assert sub == 6


def test_affected_update_equals_full_recompute(spark):
    from copyledger.plans import incremental as INC
    from copyledger import registry as R

    sf = "/root/testdata/sf0.01"         # 14 groups span both batches here (none at sf0.001)
    b1f, b1g = R._batch1(spark, sf)
    rows2 = R._batch_rows(spark, sf, 2)
    h = R._fixture_hasher(spark, sf)
    f_aff, g_aff = INC.scan_increment(b1f, b1g, rows2, R.RUN2, h, recompute="affected")
    f_full, g_full = INC.scan_increment(b1f, b1g, rows2, R.RUN2, h, recompute="full")
    cols = ["id", "file_hash", "is_duplicate", "master_file_id", "scan_timestamp"]
    assert _set(f_aff, *cols) == _set(f_full, *cols)
    gcols = ["group_hash", "master_file_id", "duplicate_count", "total_size_bytes", "created_at"]
    assert _set(g_aff, *gcols) == _set(g_full, *gcols)


def test_flagship_plan_scans_documents_once(spark):
    """The flagship reads the documents once: both branches of the gate share
    the aggregated cells' exchange (final AQE plan)."""
    df = REGISTRY["duplicate_groups"](spark, SMALL)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("Scan parquet") == 1
    assert "ReusedExchange" in final
    assert "SortAggregate" not in final          # min + min_by keep hash aggregation


def test_hash_all_plan_has_no_shared_bucket(spark):
    plan = REGISTRY["dedup_plan_hash_all"](spark, SMALL)
    keep = plan.filter(F.col("action") == "keep")
    assert keep.filter(F.col("dst").contains("/no_hash_")).count() == 0
    assert keep.select("dst").distinct().count() == keep.count() > 0
    parity = REGISTRY["dedup_plan"](spark, SMALL)
    assert _set(plan, "file_id", "action") == _set(parity, "file_id", "action")   # same decisions


def _files(spark, rows):
    """(id, path, size, hash, master, status) -> a files table."""
    full = [(i, p, p.rsplit("/", 1)[-1], size, h, None, "2025", "may", "5_1", "p", None, m is not None, m, st, None)
            for i, p, size, h, m, st in rows]
    return spark.createDataFrame(full, schemas.FILES)


def test_refresh_notices_changed_content(spark):
    run = "2025-01-01 00:00:00"
    names = [f"/r/2025/may/5_1/p/{n}.mp4" for n in "abc"]
    prior = _files(spark, [(1, names[0], 10, "h", None, "not_processed"), (2, names[1], 10, "h", 1, "deduplicated"),
                           (3, names[2], 999, None, None, "not_processed")])
    groups = spark.createDataFrame([("h", 10, 1, 1, 20, 10, None, None)], schemas.GROUPS)
    scanned = spark.createDataFrame([(names[0], "a.mp4", 10, None, "2025", "may", "5_1", "p"),
                                     (names[1], "b.mp4", 999, None, "2025", "may", "5_1", "p")],
                                    "original_path string, file_name string, file_size_bytes long, created_at "
                                    "timestamp_ntz, year string, month string, month_day string, project_name string")

    def hasher(need):
        return need.select("id", F.lit("new").alias("file_hash"))
    files, fresh = INC.scan_increment(prior, groups, scanned, run, hasher, mode="refresh")
    got = {r.id: (r.file_size_bytes, r.file_hash, r.is_duplicate, r.master_file_id, r.deduplication_status)
           for r in files.collect()}
    assert got == {1: (10, "h", False, None, "not_processed"), 2: (999, "new", False, None, "not_processed"),
                   3: (999, "new", True, 2, "not_processed")}
    assert [(r.group_hash, r.master_file_id) for r in fresh.collect()] == [("new", 2)]


def test_plan_has_a_row_for_every_pending_file(spark):
    d = "/r/2025/may/5_1/p"
    files = _files(spark, [(1, f"{d}/a.mp4", 10, "h", None, "not_processed"), (2, f"{d}/b.mp4", 10, "h", 1, "not_processed"),
                           (3, f"{d}/c.mp4", 7, "o", 99, "not_processed"), (4, f"{d}/q/d.mp4", 5, None, None, "not_processed"),
                           (5, f"{d}/e.mp4", 6, None, None, "not_processed"), (6, f"{d}/f.mp4", 3, "k", None, "deduplicated"),
                           (7, f"{d}/g.mp4", 3, "k", 6, "not_processed"), (8, "/r" + "/x" * 24 + "/h.mp4", 3, "k", 6, "not_processed")])
    groups = spark.createDataFrame([("h", 10, 1, 1, 20, 10, None, None), ("o", 7, 99, 1, 14, 7, None, None),
                                    ("k", 3, 6, 2, 9, 6, None, None)], schemas.GROUPS)
    paths = spark.createDataFrame([(6, "consolidated", "/s/k/f.mp4", None), (5, "consolidated", "/s/e.mp4", None)],
                                  schemas.PATHS)
    here = [(f"{d}/{n}.mp4", None) for n in "bcefg"] + [("/r" + "/x" * 24 + "/h.mp4", None), (f"{d}/q", "denied")]
    present = spark.createDataFrame(here, "path string, error string")
    plan = DP.dedup_plan(files, groups, paths, present, "/s")
    got = {r.file_id: r.action for r in plan.collect()}
    assert got == {1: "missing", 2: "no_master_copy", 3: "orphan_group", 4: "unreadable", 5: "already_done",
                   7: "link", 8: "too_deep"}
    assert DP.plan_coverage(files, plan).first().uncovered == 0
    # The store copy of 6 is lost: its master file is consolidated again.
    gone = DP.dedup_plan(files, groups, paths, present, "/s", store_listing=present.limit(0))
    assert {r.file_id: r.action for r in gone.collect()}[6] == "keep"
