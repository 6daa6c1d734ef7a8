"""Listing in rounds: the same rows as the source, large subtrees spread over tasks, one directory listed by the driver."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from copyledger.sources import media_files as MF


def touch(path):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as fh:
        fh.write(b"x")


@pytest.fixture(scope="module")
def tree():
    root = tempfile.mkdtemp(prefix="copyledger-test-", dir="/tmp") + "/root"
    deep = f"{root}/2024/may/5_1/big"
    for i in range(60):                                   # one chain of 60 levels
        deep += f"/d{i}"
        touch(f"{deep}/f{i}.mp4")
    for i in range(300):                                  # one folder with 300 folders and as many files
        touch(f"{root}/2024/may/5_1/big/wide/s{i}/a.mp4")
        touch(f"{root}/2024/may/5_1/big/wide/w{i}.mp4")
    touch(f"{root}/2023/june/6_2/small/a.mp4")
    touch(f"{root}/2023/june/6_2/small/.kept/b.mp4")      # hidden below the project: kept
    touch(f"{root}/2023/.june/6_2/small/no.mp4")          # hidden level: left out
    touch(f"{root}/.2022/june/6_2/small/no.mp4")
    touch(f"{root}/2023/june/stray.mp4")                  # above the projects: left out
    os.symlink(f"{root}/2023", f"{root}/2021")            # a level may be a link
    os.symlink(f"{root}/2023/june", f"{root}/2024/may/5_1/big/link")   # below it, a link is a row
    return root


def listed(df):
    return sorted(tuple(r) for r in df.collect())


def test_rounds_equal_the_source(spark, tree):
    want = listed(MF.read_tree(spark, tree).select("path", "size", "mtime", "is_link"))
    assert len(want) == 60 + 600 + 1 + 4 and len(set(want)) == len(want)
    for entries in (1, 7, 100, MF.UNIT_ENTRIES):
        got = MF.list_tree_frontier(spark, tree, unit_entries=entries) if entries > 1 else \
            MF.list_tree_frontier(spark, f"{tree}/", "2023/june", unit_entries=1)
        if entries > 1:
            assert listed(got.select("path", "size", "mtime", "is_link")) == want
        else:
            month = [r for r in want if r[0].startswith(f"{tree}/2023/june/")]
            assert listed(got.select("path", "size", "mtime", "is_link")) == month and len(month) == 2
    assert MF.list_tree_frontier(spark, tree, "2019/may").count() == 0
    with pytest.raises(FileNotFoundError):
        MF.list_tree_frontier(spark, f"{tree}/none")
    with pytest.raises(ValueError):
        MF.list_tree_frontier(spark, tree, unit_entries=0)


def test_a_large_project_is_spread_and_the_driver_lists_the_root_only(spark, tree, monkeypatch):
    seen, scandir = [], os.scandir
    monkeypatch.setattr(os, "scandir", lambda path: seen.append(path) or scandir(path))
    rows = MF.list_tree_frontier(spark, tree, unit_entries=50, num_partitions=8)
    assert seen == [tree]
    by_task = {}
    for r in rows.filter(F.col("path").contains("/big/wide/s")).select(F.input_file_name().alias("f")).collect():
        by_task[r.f] = by_task.get(r.f, 0) + 1
    assert len(by_task) == 8 and max(by_task.values()) <= 75    # 300 folders handed on, dealt to 8 tasks


def test_a_unit_stops_after_its_entries(tree):
    big = f"{tree}/2024/may/5_1/big"
    rows = list(MF.walk_up_to(big, 4, 10))
    files, units = [r for r in rows if r[5] is None], [r for r in rows if r[5] is not None]
    assert len(files) == 302 and {r[5] for r in units} == {6}   # big, wide and d0 are listed; what lies below is handed on
    assert len(units) == 301 and all(os.path.isdir(r[0]) for r in units)
    again = [r for u in units for r in MF.walk_up_to(u[0], u[5], 1 << 30)]
    assert sorted(r[0] for r in files + again) == sorted(r[0] for r in MF.walk_unit(MF.Unit(big, True)))


def test_directories_that_cannot_be_listed_are_rows(spark, tree, monkeypatch):
    def scandir(path, real=os.scandir):
        if path.endswith(("/2023", "/small")):
            raise PermissionError(path)
        return real(path)
    monkeypatch.setattr(os, "scandir", scandir)
    got = [r for y in ("2023", "2024") for r in MF.walk_up_to(f"{tree}/{y}", 1, 1 << 30)]
    assert [r[0] for r in got if r[4]] == [f"{tree}/2023"] and len(got) == 1 + 661
    below = list(MF.walk_up_to(f"{tree}/2023/june", 2, 1 << 30))
    assert [(r[0], r[4].split(":")[0]) for r in below] == [(f"{tree}/2023/june/6_2/small", "PermissionError")]
