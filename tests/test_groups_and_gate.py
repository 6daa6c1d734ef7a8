"""Groups, master election, flags and the size gate on hand-made rows."""

from pyspark.sql import functions as F

from copyledger.operators import gate, groups


def _files(spark, rows):
    return spark.createDataFrame(rows, "id long, file_size_bytes long, content_fp string, file_name string")


def test_groups_master_and_space(spark):
    rows = [(5, 10, "h1", "a.mp4"), (2, 10, "h1", "b.mp4"), (9, 10, "h1", "c.mp4"),
            (3, 20, "h2", "d.mp4"), (4, 30, "h3", "e.mp4"), (7, 30, "h4", "f.mp4"),
            (8, None, "h5", "g.mp4")]
    f = _files(spark, rows)
    g = {r.group_hash: r for r in groups.groups_from_fingerprints(f, "content_fp").collect()}
    assert set(g) == {"h1"}                      # h2: unique size; h3/h4: same size, different hash
    assert g["h1"].master_file_id == 2 and g["h1"].duplicate_count == 2
    assert g["h1"].total_size_bytes == 30 and g["h1"].space_saved_bytes == 20
    hashed = gate.apply_gate(f, "content_fp")
    g2 = {r.group_hash: r for r in groups.groups_from_hashed(hashed).collect()}
    assert g2.keys() == g.keys() and g2["h1"] == g["h1"]
    flags = {r.id: (r.is_duplicate, r.master_file_id)
             for r in groups.apply_flags(hashed, groups.groups_from_hashed(hashed)).collect()}
    assert flags[2] == (False, None) and flags[5] == (True, 2) and flags[9] == (True, 2)
    assert flags[4] == (False, None) and flags[8] == (False, None)


def test_size_blind_group_and_size_key(spark):
    # Two sizes whose sampled hash collides (constant content), both sizes shared.
    rows = [(1, 6000, "same", "a"), (2, 6000, "same", "b"), (3, 7000, "same", "c"), (4, 7000, "x", "d")]
    f = _files(spark, rows)
    by_hash = groups.groups_from_fingerprints(f, "content_fp").collect()
    assert len(by_hash) == 1 and by_hash[0].duplicate_count == 2 and by_hash[0].file_size_bytes == 6000
    by_size = groups.groups_from_fingerprints(f, "content_fp", key="size_hash").collect()
    assert [(r.group_hash, r.duplicate_count) for r in by_size] == [("6000:same", 1)]


def test_hot_size_partial_aggregation(spark):
    # One size holds most rows: the group aggregate must still be exact.
    n = 20000
    rows = spark.range(n).select(F.col("id"), F.lit(0).cast("long").alias("file_size_bytes"),
                                 F.when(F.col("id") % 3 == 0, F.lit("e")).otherwise(
                                     F.concat(F.lit("u"), F.col("id").cast("string"))).alias("content_fp"),
                                 F.lit("n").alias("file_name"))
    g = groups.groups_from_fingerprints(rows, "content_fp").collect()
    assert len(g) == 1 and g[0].duplicate_count == (n + 2) // 3 - 1 and g[0].master_file_id == 0


def test_cross_batch_candidates(spark):
    new = spark.createDataFrame([(10, 100, "Clip.MP4"), (11, 100, "x.mp4"), (12, 5, "solo.mp4")],
                                "id long, file_size_bytes long, file_name string")
    old = spark.createDataFrame([(1, 100, "clip.mp4", "/o/1", None), (2, 100, "other.mp4", "/o/2", "h"),
                                 (3, 5, "solo.mp4", "/o/3", None)],
                                "id long, file_size_bytes long, file_name string, original_path string, "
                                "file_hash string")
    got = sorted((r.old_id, r.new_matches) for r in gate.cross_batch_candidates(new, old).collect())
    assert got == [(1, 1)]      # size 5 has one new row only; names compare case-insensitively


def test_verify_full_splits_sampled_collision(spark):
    # ids 1, 2: equal sampled hash, different content; 3: a true copy of 1.
    files = spark.createDataFrame(
        [(1, 20000, "s"), (2, 20000, "s"), (3, 20000, "s"), (4, 10, None)],
        "id long, file_size_bytes long, file_hash string")
    full = spark.createDataFrame([(1, "fa"), (2, "fb"), (3, "fa"), (4, "fx")], "id long, full_hash string")
    refined, g = groups.verify_full(files, full)
    assert [(r.group_hash, r.master_file_id, r.duplicate_count) for r in g.collect()] == [("fa", 1, 1)]
    hashes = {r.id: r.file_hash for r in refined.collect()}
    assert hashes == {1: "fa", 2: "fb", 3: "fa", 4: None}     # non-members keep their value


def test_legacy_group_skip(spark):
    g = spark.createDataFrame([("a", 1, 1, None), ("b", 2, 1, "2025-01-01 00:00:00"), ("c", 3, 0, None)],
                              "group_hash string, master_file_id long, duplicate_count long, "
                              "deduplicated_at string").withColumn("deduplicated_at",
                                                                   F.col("deduplicated_at").cast("timestamp"))
    assert sorted(r.group_hash for r in groups.groups_for_processing(g).collect()) == ["a", "b"]
    assert [r.group_hash for r in groups.groups_for_processing(g, legacy_group_skip=True).collect()] == ["a"]
