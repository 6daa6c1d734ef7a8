"""What must not grow with the number of directories, listing files or rows of a batch."""

import os
import tempfile

from copyledger import registry as R
from copyledger.operators.listing import catalog_rows
from copyledger.plans import incremental as INC
from copyledger.session import scratch_path
from copyledger.sources import fixture as FX
from copyledger.sources import media_files as MF
from copyledger.sources import snapshots as SNAP
from copyledger.streaming import ingest as STR

from conftest import SMALL


def test_tasks_of_a_listing_do_not_follow_its_directories(spark):
    root = tempfile.mkdtemp(prefix="copyledger-tree-", dir="/tmp") + "/root"
    for i in range(60):
        os.makedirs(f"{root}/2025/may/05_{i % 28 + 1:02}/project{i}/sub")
        with open(f"{root}/2025/may/05_{i % 28 + 1:02}/project{i}/sub/a.mp4", "wb") as f:
            f.write(b"x" * i)
    tree = MF.read_tree(spark, root)
    assert len(MF.plan_units(root)) == 120
    assert tree.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(r["size"] for r in tree.collect()) == list(range(60))
    assert MF.read_tree(spark, root, num_partitions=100).rdd.getNumPartitions() == 100


def test_queries_over_a_tree_walk_it_once(spark):
    rows, _ = R._tree_rows(spark, SMALL)
    assert "media_files" not in rows._jdf.queryExecution().toString() and rows.inputFiles()


def test_versions_follow_the_bytes_that_arrived_not_the_files(spark):
    base = scratch_path(spark, "stream")
    rows = FX.fixture_listing(spark, SMALL).select(*STR.LISTING_STREAM.fieldNames())
    rows.filter("id < 100").repartition(6).write.parquet(f"{base}/in")
    STR.run_ingest(spark, f"{base}/in", f"{base}/catalog", f"{base}/checkpoint", FX.FIXTURE_ROOT,
                   R._fixture_hasher(spark, SMALL), R.RUN1)
    assert SNAP.committed_versions(spark, f"{base}/catalog") == [1]
    want = {r["original_path"] for r in catalog_rows(rows.filter("id < 100"), FX.FIXTURE_ROOT).collect()}
    assert {r["original_path"] for r in SNAP.read_table(spark, f"{base}/catalog", "files").collect()} == want


def test_joins_of_a_large_batch_send_no_rows_through_the_driver(spark, monkeypatch):
    files1, _ = R._batch1(spark, SMALL)
    rows = R._all_rows(spark, SMALL)
    want = {r["id"] for r in INC.new_paths(rows, files1).collect()}
    monkeypatch.setattr(INC, "BROADCAST_ROWS", 10)
    got = INC.new_paths(rows, files1)
    assert {r["id"] for r in got.collect()} == want and want
    assert "Broadcast" not in got._jdf.queryExecution().toString()
    few = INC.new_paths(rows.limit(5), files1)
    assert "Broadcast" in few._jdf.queryExecution().toString()
