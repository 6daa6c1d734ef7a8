"""Bucketed catalog paths: equal to the test over files, folders merged by size, no shuffle of the catalog; run counters
counted by the write of the plan."""

import re
import tempfile

from pyspark.sql import functions as F

from copyledger import schemas
from copyledger.plans import dedup_plan as DP
from copyledger.plans import incremental as INC
from copyledger.sources import path_buckets as PB
from copyledger.sources import snapshots as SNAP

RUNS = [f"2025-01-0{i} 00:00:00" for i in range(1, 9)]


def fresh_root():
    return tempfile.mkdtemp(prefix="copyledger-test-", dir="/tmp") + "/it's a catalog"


def scanned(spark, names):
    rows = [(f"/r/{n}", n.rsplit("/", 1)[1], 1000 + len(n), None, *n.split("/")[:4]) for n in names]
    return spark.createDataFrame(rows, "original_path string, file_name string, file_size_bytes long, created_at "
                                       "timestamp_ntz, year string, month string, month_day string, project_name string")


def hasher(need):
    return need.select("id", F.concat(F.lit("h"), F.col("file_size_bytes")).alias("file_hash"))


def paths(spark, lo, hi):
    return spark.range(lo, hi).select(F.concat(F.lit("/r/"), F.col("id")).alias("original_path"))


def test_folders_are_merged_by_size(spark):
    root, entry, lo = fresh_root(), None, 0
    for n in (1000, 10, 3, 0, 3, 1, 600):
        entry = PB.add_paths(paths(spark, lo, lo + n), root, entry, per_bucket=100)
        lo += n
        sizes = [f["rows"] for f in entry["folders"]]
        assert sum(sizes) == lo and all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))
        assert [f["buckets"] for f in entry["folders"]] == [-(-s // 100) for s in sizes]
        batch = paths(spark, lo - 5, lo + 5)
        assert PB.known_among(batch, root, entry).count() == 5
    assert len(entry["folders"]) == 1
    none = PB.add_paths(paths(spark, 0, 0), root)
    assert none == {"folders": []} and PB.known_among(paths(spark, 0, 4), root, none).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(PB.ENTRY)]


def test_the_catalog_side_is_not_shuffled(spark):
    root = fresh_root()
    entry = PB.add_paths(paths(spark, 0, 3000), root, per_bucket=500)
    entry = PB.add_paths(paths(spark, 3000, 3300), root, entry, per_bucket=500)
    batch = SNAP.stage(paths(spark, 2900, 3400))
    name = "spark.sql.autoBroadcastJoinThreshold"
    held = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        known = PB.known_among(batch, root, entry)
        text = known._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in text.splitlines() if "FileScan" in line]
        mine = [line for line in scans if "Bucketed: true" in line]
        assert len(scans) == 4 and len(mine) == 2 and "out of 6" in mine[0] and "out of 1" in mine[1]
        # one shuffle per folder, of the batch, into the folder's own buckets
        assert sorted(re.findall(r"Exchange (\w+)\(\S+, (\d+)\)", text)) in (
            [("hashpartitioning", "1"), ("hashpartitioning", "6")], [("hashpartitioning", "6")])
        over = text.split("Exchange ")[1:]
        assert not any("Bucketed: true" in part.split("Join")[0].split("FileScan")[1] for part in over)
        new = INC.new_paths_bucketed(batch, root, entry)
        assert sorted(r[0] for r in new.collect()) == [f"/r/{i}" for i in range(3300, 3400)]
    finally:
        spark.conf.set(name, held)


def test_runs_keep_and_use_the_bucketed_paths(spark):
    plain, bucketed = fresh_root(), fresh_root()
    years = [f"202{y}/may/5_1/p/{i}.mp4" for y in range(3) for i in range(20)]
    for i, names in enumerate((years[:30], years[10:50], years[40:], [])):
        for root in (plain, bucketed):
            INC.commit_scan(root, scanned(spark, names), RUNS[i], hasher, bucket_paths=root == bucketed and i == 1)
        tables = SNAP.manifest(spark, bucketed)["tables"]
        assert (PB.ENTRY in tables) == (i >= 1) and PB.ENTRY not in SNAP.manifest(spark, plain)["tables"]
    a, b = (SNAP.read_catalog(spark, root) for root in (plain, bucketed))
    for table in ("files", "paths", "duplicate_groups", "statistics"):
        assert sorted(map(str, a[table].collect())) == sorted(map(str, b[table].collect()))
    assert sum(f["rows"] for f in tables[PB.ENTRY]["folders"]) == 60 == a["files"].count()
    plan = INC.new_to_catalog(scanned(spark, years[:3]), b["files"], bucketed, tables)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "/known_paths/" in text and "/files/" not in text and plan.count() == 0
    # a deduplication run adds no files; another writer of files may, so the buckets end with its version
    listing = a["files"].select(F.col("original_path").alias("path"))
    DP.commit_dedup(spark, bucketed, listing, "/store", RUNS[5])
    assert SNAP.manifest(spark, bucketed)["tables"][PB.ENTRY] == tables[PB.ENTRY]
    SNAP.write_catalog({"files": b["files"].limit(10)}, bucketed)
    assert PB.ENTRY not in SNAP.manifest(spark, bucketed)["tables"]
    INC.commit_scan(bucketed, scanned(spark, years[:40]), RUNS[6], hasher, bucket_paths=True)
    assert SNAP.read_table(spark, bucketed, "files").select("original_path").distinct().count() >= 40


def test_a_scan_over_tables_in_memory(spark):
    none = {t: spark.createDataFrame([], s) for t, s in schemas.TABLES.items()}
    out = INC.scan_batch(none, scanned(spark, ["2023/may/5_1/p/a.mp4", "2023/may/5_1/q/a.mp4"]), RUNS[0], hasher)
    assert out["files"].count() == out["paths"].count() == 2 and out["duplicate_groups"].count() == 1


def test_counters_come_from_the_write(spark):
    root = fresh_root()
    INC.commit_scan(root, scanned(spark, [f"2023/may/5_1/p{i}/a.mp4" for i in range(9)]), RUNS[0], hasher)
    c = SNAP.read_catalog(spark, root)
    listing = c["files"].filter("original_path not like '%p3%'").select(F.col("original_path").alias("path"))
    plan, counted = DP.stage_counted(DP.dedup_plan(c["files"], c["duplicate_groups"], c["paths"], listing, "/store"))
    assert counted == DP.plan_outcome(plan).first().asDict() and counted["symlinks_created"] == 7
    empty = {t: spark.createDataFrame([], s) for t, s in schemas.TABLES.items()}
    plan, counted = DP.stage_counted(
        DP.dedup_plan(empty["files"], empty["duplicate_groups"], empty["paths"], listing.limit(0), "/store"))
    assert plan.count() == 0 and set(counted.values()) == {0} and len(counted) == 4
    DP.commit_dedup(spark, root, listing, "/store", RUNS[1])
    stats = {r.stat_name: r.stat_value for r in SNAP.read_table(spark, root, "statistics").collect()}
    assert stats["symlinks_created"] == "7" and stats["files_consolidated"] == "1"
