"""Partition-scoped versions, two writers, the split upsert's plan, statistics by deltas."""

import os
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from copyledger import schemas
from copyledger.operators import stats as S
from copyledger.operators import upserts as U
from copyledger.plans import dedup_plan as DP
from copyledger.plans import incremental as INC
from copyledger.sources import snapshots as SNAP

RUNS = [f"2025-01-0{i} 00:00:00" for i in range(1, 9)]


def scanned(spark, names, size=10):
    rows = [(f"/r/{n}", n.rsplit("/", 1)[1], size, None, *n.split("/")[:4]) for n in names]
    return spark.createDataFrame(rows, "original_path string, file_name string, file_size_bytes long, created_at "
                                       "timestamp_ntz, year string, month string, month_day string, project_name string")


def hasher(need):
    return need.select("id", F.concat(F.lit("h"), F.col("file_size_bytes")).alias("file_hash"))


def fresh_root():
    return tempfile.mkdtemp(prefix="copyledger-test-", dir="/tmp")


def folders(spark, root):
    return SNAP.manifest(spark, root)["tables"]["files"]["parts"]


def stamps(root, parts):
    return {p: sorted((f, os.stat(f"{root}/{folder}/{p}/{f}").st_mtime_ns) for f in os.listdir(f"{root}/{folder}/{p}"))
            for p, folder in parts.items()}


def checked(spark, root):
    """The stored cells and statistics equal a full recompute."""
    c = SNAP.read_catalog(spark, root)
    want = S.statistic_cells(c["files"], c["duplicate_groups"])
    assert sorted(map(str, c["cells"].collect())) == sorted(map(str, want.collect()))
    full = S.summary(c["files"], c["duplicate_groups"]).first()
    assert S.cells_summary(c["cells"]).first() == full
    stored = {r.stat_name: r.stat_value for r in c["statistics"].collect()}
    assert stored["total_files"] == str(full.total_files) and stored["duplicate_files"] == str(full.duplicate_files)
    return c


def test_only_changed_years_are_written(spark):
    root = fresh_root()
    INC.commit_scan(root, scanned(spark, ["2023/may/5_1/p/a.mp4", "2024/may/5_1/p/b.mp4", "2025/may/5_1/p/c.mp4"], 10)
                    .withColumn("file_size_bytes", F.col("year").cast("long")), RUNS[0], hasher)
    before = folders(spark, root)
    old = stamps(root, before)
    # a file of 2025 that equals the one of 2023: both years change, 2024 does not
    INC.commit_scan(root, scanned(spark, ["2025/june/6_1/q/d.mp4"], 2023), RUNS[1], hasher)
    after = folders(spark, root)
    assert after["year=2024"] == before["year=2024"] and len(set(after.values())) == 2
    assert after["year=2023"] != before["year=2023"] and after["year=2025"] != before["year=2025"]
    assert stamps(root, before) == old          # nothing of the version before was touched
    c = checked(spark, root)
    flags = {r.file_name: (r.is_duplicate, r.file_hash) for r in c["files"].collect()}
    assert flags == {"a.mp4": (False, "h2023"), "b.mp4": (False, None), "c.mp4": (False, None), "d.mp4": (True, "h2023")}
    # the version before is still there as it was
    assert SNAP.read_table(spark, root, "files", 1).count() == 3
    # a pruned read opens the year's folder only
    plan = SNAP.read_files_scoped(spark, root, "2024/may")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_null_and_odd_years(spark):
    root = fresh_root()
    rows = scanned(spark, ["2023/may/5_1/p/a.mp4", "20:3/may/5_1/p/b.mp4", "x/may/5_1/p/c.mp4"])
    rows = rows.withColumn("year", F.nullif("year", F.lit("x"))).withColumn("file_size_bytes", F.length("original_path"))
    INC.commit_scan(root, rows, RUNS[0], hasher, skip_hash=True)
    for i, name in enumerate(("20:3/may/5_1/p/dddd.mp4", "x/may/5_1/p/eeeeee.mp4"), 1):
        more = scanned(spark, [name], 99 + i)
        INC.commit_scan(root, more.withColumn("year", F.nullif("year", F.lit("x"))), RUNS[i], hasher)
        checked(spark, root)
    files = SNAP.read_table(spark, root, "files")
    assert sorted(str(r.year) for r in files.collect()) == ["2023", "20:3", "20:3", "None", "None"]
    assert len(set(folders(spark, root).values())) == 3


def test_two_writers_of_a_version(spark):
    root = fresh_root()
    INC.commit_scan(root, scanned(spark, ["2023/may/5_1/p/a.mp4"]), RUNS[0], hasher)
    files = SNAP.read_table(spark, root, "files")
    one = SNAP.write_table(files.withColumn("file_name", F.lit("one")), root, "files", 2)
    two = SNAP.write_table(files.withColumn("file_name", F.lit("two")), root, "files", 2)
    SNAP.commit(spark, root, 2, entries={"files": one})
    with pytest.raises(Exception, match="exists"):
        SNAP.commit(spark, root, 2, entries={"files": two})
    assert SNAP.read_table(spark, root, "files").first().file_name == "one"
    with pytest.raises(FileExistsError):
        SNAP.write_table(files, root, "files", 2)
    assert SNAP.read_catalog(spark, root)["duplicate_groups"].columns == schemas.GROUPS.fieldNames()  # taken over


def test_statistics_follow_insert_refresh_and_deduplication(spark):
    root = fresh_root()
    names = [f"202{i % 3}/may/5_{i % 2}/p{i % 4}/{i}.mp4" for i in range(40)]
    rows = scanned(spark, names).withColumn("file_size_bytes", F.length("original_path") + F.col("year").cast("long") % 2)
    INC.commit_scan(root, rows.limit(25), RUNS[0], hasher)
    checked(spark, root)
    INC.commit_scan(root, rows, RUNS[1], hasher)
    checked(spark, root)
    INC.commit_scan(root, scanned(spark, ["2021/june/6_1/p9/z.mp4", "2029/june/6_1/p9/y.mp4"], 12_345), RUNS[2], hasher)
    checked(spark, root)
    INC.commit_scan(root, rows.withColumn("file_size_bytes", F.lit(77).cast("long")).limit(5), RUNS[3], hasher, mode="refresh")
    checked(spark, root)
    present = SNAP.read_table(spark, root, "files").select("original_path").filter("original_path NOT LIKE '%/7.mp4'")
    DP.commit_dedup(spark, root, present.withColumnRenamed("original_path", "path"), "/store", RUNS[4])
    c = checked(spark, root)
    assert c["files"].filter("deduplication_status = 'deduplicated'").count() > 30
    plan = S.statistics_from_cells(SNAP.read_table(spark, root, "cells"), None, RUNS[6])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "/cells/" in text and "/files/" not in text and "/duplicate_groups/" not in text


def exchanges_over(text, table):
    """Shuffles of a plan that have a scan of ``table`` below them with no broadcast join between."""
    lines = text.splitlines()
    depth = [len(re.match(r"[\s:+\-|]*", line).group()) for line in lines]
    found = 0
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" not in line:
            continue
        level = None
        for k in range(i + 1, len(lines)):
            if depth[k] <= depth[i]:
                break
            if level is not None and depth[k] > level:
                continue
            level = depth[k] if "BroadcastHashJoin" in lines[k] else None
            found += table in lines[k]
    return found


def test_a_small_batch_does_not_move_the_catalog(spark):
    root = fresh_root()
    n = 30_000
    big = spark.range(n).select(
        F.concat(F.lit("/r/2023/may/5_1/p/"), F.md5(F.col("id").cast("string"))).alias("original_path"), "id")
    big = (big.withColumn("file_name", F.lit("n")).withColumn("file_size_bytes", F.col("id"))
           .withColumn("created_at", F.lit(None).cast("timestamp_ntz")).withColumn("year", F.lit("2023"))
           .withColumn("month", F.lit("may")).withColumn("month_day", F.lit("5_1")).withColumn("project_name", F.lit("p")))
    SNAP.write_catalog({"files": U.new_file_rows(big, RUNS[0])}, root)
    prior = SNAP.read_table(spark, root, "files")
    batch = big.filter("id % 7000 = 0").unionByName(
        big.limit(3).withColumn("original_path", F.concat("original_path", F.lit("x"))).withColumn("id", F.col("id") + n))
    batch = batch.withColumn("file_size_bytes", F.col("file_size_bytes") + 1)
    name = "spark.sql.autoBroadcastJoinThreshold"
    held = spark.conf.get(name)
    spark.conf.set(name, str(200 * 1024))
    try:
        out = U.upsert_files(prior, batch, RUNS[1])
        text = out._jdf.queryExecution().executedPlan().toString()
        assert exchanges_over(text, "original_path") == 0 and "FullOuter" not in text
        spark.conf.set(name, "-1")      # a batch of the catalog's size is joined by shuffles
        wide = U.upsert_files(prior, batch, RUNS[1])
        assert exchanges_over(wide._jdf.queryExecution().executedPlan().toString(), "original_path") > 0
        rows = {r.id: r for r in out.collect()}
        assert len(rows) == n + 3 and sum(r.file_size_bytes != r.id for r in rows.values()) == 5 + 3
        assert sorted(map(str, wide.collect())) == sorted(map(str, rows.values()))
    finally:
        spark.conf.set(name, held)
