"""Snapshots (versioning, empty catalog, pruning), the directory source on a
hand-made tree, and streaming ingest."""

import hashlib
import os
import tempfile
import threading
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from copyledger import schemas
from copyledger.operators import listing
from copyledger.registry import REGISTRY
from copyledger.sources import media_files as MF
from copyledger.sources import sampled_read as SR
from copyledger.sources import snapshots as SNAP
from copyledger.streaming import ingest as STR

from conftest import SMALL


def test_empty_catalog_has_schema(spark):
    root = tempfile.mkdtemp(prefix="copyledger-test-", dir="/tmp")
    cat = SNAP.read_catalog(spark, root)
    for name, df in cat.items():
        assert df.count() == 0 and df.schema.fieldNames() == schemas.TABLES[name].fieldNames()
    assert SNAP.next_version(spark, root) == 1


def test_snapshot_scope_is_pruned(spark):
    df = REGISTRY["snapshot_roundtrip"](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "(year#" in plan
    assert "PushedFilters: [IsNotNull(month), EqualTo(month,march)]" in plan
    assert "deduplication_timestamp" not in plan.split("ReadSchema:")[1].split("\n")[0]
    assert df.count() == 3          # DuckDB oracle at sf0.001


def _touch(path, data=b"x"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_media_source_on_tree(spark):
    root = tempfile.mkdtemp(prefix="copyledger-tree-", dir="/tmp") + "/root"
    day = f"{root}/2025/october/10_01"
    _touch(f"{day}/projA/a.mp4", b"same-bytes")
    _touch(f"{day}/projA/sub/B.MOV", b"same-bytes")
    _touch(f"{day}/projA/.hid.mp4", b"other")
    _touch(f"{day}/projA/.h/d.mp4", b"o2")
    _touch(f"{day}/projA/_us.mp4", b"o3")
    _touch(f"{day}/_projB/c.mp4", b"o4")
    _touch(f"{day}/projA/n.txt", b"t")
    _touch(f"{day}/stray.mp4", b"s")
    _touch(f"{root}/.hidden/files/00/x.mp4", b"h")
    _touch(f"{day}/pr oj=C/é f.mp4", b"e")
    _touch(f"{day}/projA/empty.mp4", b"")
    os.symlink(f"{day}/projA/a.mp4", f"{day}/projA/link.mp4")
    rows = listing.catalog_rows(MF.read_tree(spark, root), root)
    got = sorted(r.original_path[len(root) + 1:] for r in rows.collect())
    assert got == sorted(["2025/october/10_01/projA/a.mp4", "2025/october/10_01/projA/sub/B.MOV",
                          "2025/october/10_01/projA/.hid.mp4", "2025/october/10_01/projA/.h/d.mp4",
                          "2025/october/10_01/projA/_us.mp4", "2025/october/10_01/_projB/c.mp4",
                          "2025/october/10_01/pr oj=C/é f.mp4", "2025/october/10_01/projA/empty.mp4"])
    hashes = {r.path[len(root) + 1:]: r.file_hash for r in
              SR.read_fingerprints(rows.withColumn("id", F.lit(1).cast("long"))).collect()}
    assert hashes["2025/october/10_01/projA/a.mp4"] == hashes["2025/october/10_01/projA/sub/B.MOV"]
    assert hashes["2025/october/10_01/projA/empty.mp4"] == "d41d8cd98f00b204e9800998ecf8427e"
    sub = listing.catalog_rows(MF.read_tree(spark, root, subfolder="2025/october"), root, "2025/october")
    assert sub.count() == 8
    # Executor-side discovery lists exactly the same entries as the data source.
    raw = {(r.path, r.size, r.is_link) for r in MF.read_tree(spark, root).collect()}
    dist = {(r.path, r.size, r.is_link) for r in MF.list_tree_distributed(spark, root).collect()}
    assert raw == dist and len(raw) >= 10
    dsub = MF.list_tree_distributed(spark, root, subfolder="2025/october")
    assert listing.catalog_rows(dsub, root, "2025/october").count() == 8


def test_stream_equals_batch(spark):
    stream = {tuple(r) for r in REGISTRY["stream_ingest"](spark, SMALL).collect()}
    batch = {tuple(r) for r in REGISTRY["duplicate_groups"](spark, SMALL).collect()}
    assert stream == batch and len(batch) == 4


def test_missing_root_is_an_error_and_unreadable_directories_are_rows(spark):
    root = tempfile.mkdtemp(prefix="copyledger-tree-", dir="/tmp")
    with pytest.raises(FileNotFoundError):
        MF.plan_units(f"{root}/absent")
    with pytest.raises(FileNotFoundError):
        MF.list_tree_distributed(spark, f"{root}/absent")
    failed = []
    assert MF._visible_dirs(f"{root}/absent", failed) == [] and failed == [f"{root}/absent"]
    rows = list(MF.walk_unit(MF.Unit(failed[0], recursive=False)))
    assert len(rows) == 1 and rows[0][1] is None and "FileNotFoundError" in rows[0][4]
    errors = spark.createDataFrame(
        [("/r/2025", None, None, False, "PermissionError"), ("/r/2025/may/5_1/p/a.mp4", 1, None, False, None),
         ("/q/x", None, None, False, "elsewhere")], schemas.LISTING)
    assert [r.path for r in listing.scan_errors(errors, "/r").collect()] == ["/r/2025"]


def test_second_writer_of_a_version_fails(spark):
    root = tempfile.mkdtemp(prefix="copyledger-test-", dir="/tmp")
    SNAP.commit(spark, root, 1, "one#3")
    with pytest.raises(Exception, match="exists"):
        SNAP.commit(spark, root, 1)
    assert SNAP.committed_source(spark, root, 1) == "one#3"


def test_stream_over_a_catalog_replays_once(spark):
    root = tempfile.mkdtemp(prefix="copyledger-test-", dir="/tmp")
    names = [f"/r/2025/may/5_1/p/{i}.mp4" for i in range(4)]

    def listed(part):
        return spark.createDataFrame([(n, 10, None, False, None) for n in part], schemas.LISTING)

    def hasher(need):
        return need.select("id", F.lit("same").alias("file_hash"))
    for batch, part in ((0, names[:2]), (0, names[2:]), (1, names[2:]), (1, names[2:])):
        STR.ingest_batch(listed(part), batch, root, "/r", hasher, "2025-01-01 00:00:00", stream="a")
    STR.ingest_batch(listed(["/r/2025/may/5_1/p/new.mp4"]), 0, root, "/r", hasher, "2025-01-01 00:00:00", stream="b")
    files = SNAP.read_table(spark, root, "files").orderBy("id").collect()
    assert [r.id for r in files] == [1, 2, 3, 4, 5] and len({r.original_path for r in files}) == 5
    assert SNAP.committed_versions(spark, root) == [1, 2, 3]
    assert SNAP.read_table(spark, root, "duplicate_groups").first().duplicate_count == 4


def test_byte_ranges_are_the_sampled_slices():
    assert SR.byte_ranges(0) == [(0, 0)] and SR.byte_ranges(5119) == [(0, 5119)]
    assert SR.byte_ranges(5120) == [(0, 1024), (2048, 1024), (4096, 1024)]
    assert SR.byte_ranges(5121) == [(0, 1024), (2048, 1024), (4097, 1024)]
    assert SR.byte_ranges(1 << 30, "full") == [(0, 1 << 30)]


def test_reads_overlap_within_the_bound():
    """Readers meet at a barrier inside ``open``: it only opens when that many
    files are open at once, and never more are."""
    readers, meet, lock = 4, threading.Barrier(4, timeout=20), threading.Lock()
    folder = tempfile.mkdtemp(prefix="copyledger-test-", dir="/tmp")
    data = {f"{folder}/{i}": bytes([i]) * (3000 * i) for i in range(12)}
    for path, content in data.items():
        _touch(path, content)
    now, most = [0], [0]

    class Slow:
        def __init__(self, path):
            self.file = open(path, "rb")

        def __enter__(self):
            with lock:
                now[0] += 1
                most[0] = max(most[0], now[0])
            meet.wait()
            return self.file

        def __exit__(self, *_):
            self.file.close()
            with lock:
                now[0] -= 1
    names = [*data]
    batches = [pd.DataFrame({"id": range(8), "path": names[:8]}), pd.DataFrame({"id": range(4), "path": names[8:]})]
    got = pd.concat(list(SR._hash_batches("sampled", readers, Slow)(iter(batches))))
    assert most[0] == readers and list(got["path"]) == names and got["hash_error"].isna().all()
    for path, h in zip(got["path"], got["file_hash"]):
        c = data[path]
        cuts = [c] if len(c) < 5120 else [c[:1024], c[len(c) // 2 - 512:len(c) // 2 + 512], c[-1024:]]
        parts = [hashlib.md5(b).hexdigest() for b in cuts]
        assert h == (parts[0] if len(parts) == 1 else hashlib.md5("".join(parts).encode()).hexdigest())
    gone = list(SR._hash_batches("full")(iter([pd.DataFrame({"id": [1], "path": [f"{folder}/none"]})])))[0]
    assert gone["file_hash"][0] is None and "FileNotFoundError" in gone["hash_error"][0]


def _small_tree():
    root = tempfile.mkdtemp(prefix="copyledger-tree-", dir="/tmp") + "/root"
    for year in ("2023", "2024"):
        for month in ("march", "may", "june"):
            for project in ("a", "b"):
                _touch(f"{root}/{year}/{month}/01_01/{project}/x.mp4", f"{year}{month}{project}".encode())
    _touch(f"{root}/2024/march/01_01/.a/x.mp4")
    return root


def test_pruned_walk_enters_wanted_directories_only(monkeypatch):
    root, entered, scandir = _small_tree(), [], os.scandir

    def counting(path):
        entered.append(path[len(root):])
        return scandir(path)
    monkeypatch.setattr(MF.os, "scandir", counting)
    every = MF.plan_units(root, expand_levels=0)
    assert len(every) == 12 and len(entered) == 1 + 2 + 6 + 6
    entered.clear()
    units = MF.plan_units(root, None, 0, {"year": {"2024", "1999"}, "month": {"march", "june"}})
    assert sorted(u.path[len(root):] for u in units) == [
        f"/2024/{m}/01_01/{p}" for m in ("june", "march") for p in ("a", "b")]
    # Years and months are entered by name; only the months and their days are listed.
    assert sorted(entered) == ["/2024/june", "/2024/june/01_01", "/2024/march", "/2024/march/01_01"]
    assert [u.path[len(root):] for u in MF.plan_units(root, None, 0, {"project_name": {"b"}, "year": {"2023"}})] == [
        f"/2023/{m}/01_01/b" for m in ("june", "march", "may")]
    for odd in (".a", "", "..", ".", "a/..", "a/x.mp4"):
        assert MF.plan_units(root, None, 0, {"project_name": {odd}}) == []
    assert len(MF.plan_units(root, "2024/may", 0, {"year": {"2024"}})) == 2
    assert MF.plan_units(root, "2024/may", 0, {"year": {"2023"}}) == []


def test_filters_reach_the_tree_source(spark):
    root, year, month, project = _small_tree(), F.col("year"), F.col("month"), F.col("project_name")

    def found(df):
        return sorted(r.path[len(root):] for r in df.collect())
    tree = MF.read_tree(spark, root)
    summer = MF.scan_tree(spark, root, (year == "2024") & month.isin("may", "june"))
    want = [f"/2024/{m}/01_01/{p}/x.mp4" for m in ("june", "may") for p in ("a", "b")]
    assert summer.columns == tree.columns and found(summer) == want
    assert summer.rdd.getNumPartitions() < tree.rdd.getNumPartitions()
    assert found(MF.scan_tree(spark, root, (year == "2024") & (year == "2023"))) == []
    assert len(found(MF.scan_tree(spark, root, (year == "2024") | (project == "a")))) == 9
    # Plans over one scan, and scans of one tree, do not share what was pushed.
    part, odd = summer.filter(F.col("path").endswith("/a/x.mp4")), F.col("size") < 0
    both = MF.scan_tree(spark, root, year == "2023").union(part).union(summer.filter(odd)).union(summer)
    assert len(found(both)) == 6 + 2 + 0 + 4 and found(summer) == want
    plain = MF.read_tree(spark, root, layout=True)
    assert len(found(plain.filter(year == "2024"))) == 6 and len(found(plain)) == 12
    assert len(found(plain.filter(year == "2024").union(plain.filter(year == "2023")).union(plain))) == 24


def test_stream_reads_arrivals_from_the_tree(spark):
    """Restarts, late files, a moved-in directory of old files, a touched file."""
    base = tempfile.mkdtemp(prefix="copyledger-test-", dir="/tmp")
    root, day = f"{base}/root", f"{base}/root/2025/may/05_01"

    def ingest():
        STR.run_ingest_tree(spark, root, f"{base}/catalog", f"{base}/ckpt", SR.storage_hasher(),
                            "2025-01-01 00:00:00", overlap_seconds=0)
        files = SNAP.read_table(spark, f"{base}/catalog", "files")
        return sorted(r.original_path[len(day) + 1:] for r in files.select("original_path").collect())
    _touch(f"{day}/p/a.mp4", b"same")
    _touch(f"{day}/p/deep/er/b.mp4", b"same")
    _touch(f"{base}/aside/old.mp4", b"same")
    assert ingest() == ["p/a.mp4", "p/deep/er/b.mp4"]
    assert ingest() == ["p/a.mp4", "p/deep/er/b.mp4"]
    assert SNAP.committed_versions(spark, f"{base}/catalog") == [1]        # an empty batch writes no version
    os.rename(f"{base}/aside", f"{day}/p/deep/moved")
    _touch(f"{day}/p/deep/er/c.mp4", b"other")
    os.utime(f"{day}/p/a.mp4", (1, 1))
    want = ["p/a.mp4", "p/deep/er/b.mp4", "p/deep/er/c.mp4", "p/deep/moved/old.mp4"]
    assert ingest() == want and ingest() == want
    assert SNAP.committed_versions(spark, f"{base}/catalog") == [1, 2]
    group = SNAP.read_table(spark, f"{base}/catalog", "duplicate_groups").collect()
    assert [r.duplicate_count for r in group] == [2]      # three copies: the master and two more


def test_stream_walk_leaves_out_what_did_not_change():
    root = _small_tree()
    reader = MF.MediaFilesStream({"root": root, "overlap_seconds": "0"})
    until = reader.latestOffset()
    time.sleep(0.1)            # change times come from a coarser clock, hence the usual overlap
    fresh = f"{root}/2024/may/01_01/a/new.mp4"
    _touch(fresh)
    parts = reader.partitions(until, reader.latestOffset())
    rows = [r for p in parts for r in reader.read(p)]
    assert sorted(r[0] for r in rows) == [fresh, f"{root}/2024/may/01_01/a/x.mp4"]
    assert reader.partitions(until, until) == []
    _touch(f"{root}/2023/may/02_01/c/x.mp4")          # a new day: the month's directory changed
    later = [r[0] for p in reader.partitions(until, reader.latestOffset()) for r in reader.read(p)]
    assert f"{root}/2023/may/02_01/c/x.mp4" in later and f"{root}/2023/june/01_01/a/x.mp4" not in later
