"""Lookups by hash read a few row groups of the lookup table and the store files they name."""

import glob
import hashlib
import tempfile

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from copyledger.plans import store as ST


def test_lookup_by_hash_prunes(spark):
    base = tempfile.mkdtemp(prefix="copyledger-test-", dir="/tmp")
    n, keys = 4000, {}
    rows = []
    for i in range(n):      # a third has no hash: all of these share one folder of the layout
        h = None if i % 3 == 0 else hashlib.md5(str(i).encode()).hexdigest()
        keys[i] = h
        rows.append((f"/s/files/{h[:2] if h else '00'}/{h[2:4] if h else '00'}/{h or 'no_hash'}_{i}.mp4",
                     i, h, 10, f"content {i}".encode()))
    table = spark.createDataFrame(rows, "canonical_path string, file_id long, file_hash string, "
                                        "file_size_bytes long, content binary")
    store = ST.write_store(table.repartition(12), f"{base}/store")
    lookup = ST.write_lookup(spark, store, f"{base}/lookup", row_group_bytes=4096)
    ranges, blank = [], 0
    for name in glob.glob(f"{lookup}/*.parquet"):
        meta = pq.ParquetFile(name).metadata
        for g in range(meta.num_row_groups):
            stats = meta.row_group(g).column(0).statistics
            blank += stats.null_count == meta.row_group(g).num_rows
            if stats.has_min_max:
                ranges.append((stats.min, stats.max))
    assert len(ranges) > 1 and blank > 1          # hashes in ranges; the files without one are split too
    wanted = F.col("file_hash") == keys[1]
    assert sum(lo <= keys[1] <= hi for lo, hi in ranges) == 1
    plan = spark.read.parquet(lookup).filter(wanted)._jdf.queryExecution().executedPlan().toString()
    assert f"EqualTo(file_hash,{keys[1]})" in plan
    got = ST.find_copies(spark, store, lookup, wanted)
    assert [(r.file_id, bytes(r.content)) for r in got.collect()] == [(1, b"content 1")]
    assert len(got.inputFiles()) == 1 and len(spark.read.parquet(store).inputFiles()) == 12
    assert ST.find_copies(spark, store, lookup, F.col("file_hash") == "none").count() == 0
    blanks = ST.find_copies(spark, store, lookup, F.col("file_hash").isNull())
    assert {r.file_id for r in blanks.collect()} == {i for i in range(n) if keys[i] is None}


def test_lookup_of_an_empty_store(spark):
    base = tempfile.mkdtemp(prefix="copyledger-test-", dir="/tmp")
    empty = spark.createDataFrame([], "canonical_path string, file_id long, file_hash string, "
                                      "file_size_bytes long, content binary")
    store = ST.write_store(empty, f"{base}/store")
    lookup = ST.write_lookup(spark, store, f"{base}/lookup")
    found = ST.find_copies(spark, store, lookup, F.col("file_hash") < "8")
    assert found.count() == 0 and found.columns == empty.columns
