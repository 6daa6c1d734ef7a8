"""``media_files``: a Python data source listing a ``root/year/month/
month_day/project/**`` tree (metadata only, never file bytes).

The driver lists only the four fixed directory levels (and, with
``expand_levels``, the first levels below each project) to build work units;
units are packed into input partitions (``read_tree``: as many as a shuffle
has, however many directories there are), so a project holding a third of all
files is split across tasks by its subdirectories.  Executors walk their
units recursively without following directory links and yield one row per
regular file or link: ``path, size, mtime, is_link, error``.

Hidden names are dropped at levels 1-4 only (deeper hidden files are kept),
links are reported (``is_link``) so the scan can skip them, and an
unreadable entry yields ``size`` NULL with the error text.  ``subfolder``
(``year/month``) restricts the walk to one month.

With ``layout=true`` rows carry the four level names as columns.  ``scan_tree``
filters on them and pushes equality and IN into the walk: a level whose names
are known is entered directly, without listing its siblings.  Spark still
evaluates the filters, so a directory that cannot be read above the filtered
level gives no row.  What was pushed into a Python source is kept per loaded
table, not per plan, so two filters over one loaded table would share the walk
of one of them: ``scan_tree`` therefore loads a table per filter and hands on
no level columns, and a plain ``layout=true`` read pushes nothing.

As a stream (``readStream``) the offset is the time up to which the tree was
listed, kept in the stream's checkpoint.  A batch holds what changed since the
last offset: files by their change time, and all that lies below a directory
that changed, since a directory moved into the tree brings old files with it.
``overlap_seconds`` (default 120) covers clocks that differ between driver and
storage.  An entry may therefore come again, but none is left out; the catalog
takes each path once.
"""

from __future__ import annotations

import collections
import datetime as _dt
import itertools
import os
import time
from dataclasses import dataclass

from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, In,
                                    InputPartition)

from copyledger.session import pickle_by_value

pickle_by_value(__name__)

SCHEMA = "path string, size long, mtime timestamp_ntz, is_link boolean, error string"
LEVELS = ("year", "month", "month_day", "project_name")
LAYOUT_SCHEMA = SCHEMA + "".join(f", {name} string" for name in LEVELS)


@dataclass
class Unit:
    path: str
    recursive: bool
    since: int | None = None       # only what changed after this time (ns); None: everything


class UnitsPartition(InputPartition):
    def __init__(self, index: int, units: list[Unit]):
        super().__init__(index)
        self.units = units


def _visible_dirs(path: str, failed: list[str]) -> list[str]:
    """Visible directories in ``path``; unreadable ones are added to ``failed``
    (walking them gives their error row)."""
    try:
        with os.scandir(path) as it:
            return sorted(e.path for e in it
                          if not e.name.startswith(".") and e.is_dir(follow_symlinks=True))
    except OSError:
        failed.append(path)
        return []


def _start(root: str, subfolder: str | None) -> tuple[list[str], int]:
    """Directories to start from, and their level; a missing root is an error."""
    root = root.rstrip("/") or "/"
    if not os.path.isdir(root):
        raise FileNotFoundError(f"no such directory: {root}")
    if not subfolder:
        return [root], 0
    parts = [p for p in subfolder.strip("/").split("/") if p]
    if len(parts) != 2:
        raise ValueError("subfolder must be exactly 'year/month'")
    base = os.path.join(root, *parts)
    if not os.path.isdir(base) or any(p.startswith(".") for p in parts):
        return [], 2
    return [base], 2


def _named_dirs(path: str, names: set[str]) -> list[str]:
    """The visible directories of these names in ``path``, without listing it."""
    found = (os.path.join(path, n) for n in sorted(names) if n and "/" not in n and not n.startswith("."))
    return [d for d in found if os.path.isdir(d)]


def plan_units(root: str, subfolder: str | None = None, expand_levels: int = 1,
               wanted: dict[str, set[str]] | None = None) -> list[Unit]:
    """Driver side: the four fixed levels, then ``expand_levels`` below.
    ``wanted`` holds the only names to enter per level."""
    wanted = wanted or {}
    level, depth = _start(root, subfolder)
    failed: list[str] = []
    if depth and any(name not in wanted.get(column, {name})
                     for d in level for column, name in zip(LEVELS, d.split("/")[-depth:])):
        level = []
    for column in LEVELS[depth:]:
        level = [d for parent in level for d in (
            _named_dirs(parent, wanted[column]) if column in wanted else _visible_dirs(parent, failed))]
    units: list[Unit] = [Unit(d, recursive=False) for d in failed]
    for project in level:
        frontier = [project]
        for _ in range(expand_levels):
            nxt = []
            for d in frontier:
                units.append(Unit(d, recursive=False))   # files directly in d
                try:
                    with os.scandir(d) as it:
                        nxt.extend(sorted(e.path for e in it if e.is_dir(follow_symlinks=False)))
                except OSError:
                    pass
            frontier = nxt
        units.extend(Unit(d, recursive=True) for d in frontier)
    return units


def _entry_row(entry: os.DirEntry):
    try:
        is_link = entry.is_symlink()
        st = entry.stat(follow_symlinks=False)
        # Creation time: birth time where the platform reports it, else mtime;
        # in UTC, so tasks on differently set machines agree.
        when = getattr(st, "st_birthtime", st.st_mtime)
        mtime = _dt.datetime.fromtimestamp(when, _dt.timezone.utc).replace(tzinfo=None)
        return (entry.path, int(st.st_size), mtime, is_link, None)
    except OSError as e:
        return (entry.path, None, None, False, f"{type(e).__name__}: {e}")


def _unless_changed(path: str, since: int | None) -> int | None:
    """``since`` for what lies below ``path``: None where the directory itself
    changed after it, or cannot be looked at."""
    try:
        return None if since is None or os.stat(path).st_ctime_ns > since else since
    except OSError:
        return None


def walk_unit(unit: Unit, below: list[str] | None = None):
    """The unit's rows; directories that it does not enter go to ``below``."""
    stack = [(unit.path, unit.since)]
    while stack:
        d, since = stack.pop()
        since = _unless_changed(d, since)
        try:
            with os.scandir(d) as it:
                entries = sorted(it, key=lambda e: e.name)
        except OSError as e:
            yield (d, None, None, False, f"{type(e).__name__}: {e}")
            continue
        for e in entries:
            try:
                if not e.is_symlink() and e.is_dir(follow_symlinks=False):
                    if unit.recursive:
                        stack.append((e.path, since))
                    elif below is not None:
                        below.append(e.path)
                elif e.is_symlink() or e.is_file(follow_symlinks=False):
                    if since is None or e.stat(follow_symlinks=False).st_ctime_ns > since:
                        yield _entry_row(e)
            except OSError as err:
                yield (e.path, None, None, False, f"{type(err).__name__}: {err}")


class _TreeReader:
    """Options, packing of units into partitions, and the walk of one of them."""

    def __init__(self, options: dict):
        self.root = options["root"].rstrip("/") or "/"
        self.subfolder = options.get("subfolder")
        self.expand_levels = int(options.get("expand_levels", "1"))
        self.num_partitions = int(options.get("num_partitions", "0"))
        self.layout = _has_layout(options)

    def _packed(self, units: list[Unit]) -> list[UnitsPartition]:
        n = max(1, min(self.num_partitions or len(units), len(units)))
        buckets: list[list[Unit]] = [[] for _ in range(n)]
        for i, u in enumerate(units):
            buckets[i % n].append(u)
        return [UnitsPartition(i, b) for i, b in enumerate(buckets)]

    def _levels(self, path: str) -> tuple:
        parts = [p for p in path[len(self.root):].split("/") if p][:len(LEVELS)]
        return (*parts, *[None] * (len(LEVELS) - len(parts)))

    def read(self, partition: UnitsPartition):
        for unit in partition.units:
            for row in walk_unit(unit):
                yield (*row, *self._levels(row[0])) if self.layout else row


class MediaFilesReader(_TreeReader, DataSourceReader):
    wanted: dict[str, set[str]] = {}

    def partitions(self):
        return self._packed(plan_units(self.root, self.subfolder, self.expand_levels, self.wanted))


class PrunedMediaFilesReader(MediaFilesReader):
    def pushFilters(self, filters):
        """Every filter is also left to Spark."""
        self.wanted = {}
        for f in filters:
            if isinstance(f, (EqualTo, EqualNullSafe, In)) and f.attribute[0] in LEVELS:
                names = set(f.value) if isinstance(f, In) else {f.value}
                names.discard(None)
                self.wanted[f.attribute[0]] = names & self.wanted.get(f.attribute[0], names)
            yield f


class MediaFilesStream(_TreeReader, DataSourceStreamReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.overlap = int(float(options.get("overlap_seconds", "120")) * 1e9)

    def initialOffset(self) -> dict:
        return {"until": 0}

    def latestOffset(self) -> dict:
        return {"until": time.time_ns()}

    def partitions(self, start: dict, end: dict):
        if start == end:
            return []
        units = plan_units(self.root, self.subfolder, self.expand_levels)
        if start["until"] > 0:
            seen = {self.root: _unless_changed(self.root, start["until"] - self.overlap)}
            for u in units:
                u.since = self._since(u.path, seen)
        return self._packed(units)

    def _since(self, path: str, seen: dict[str, int | None]) -> int | None:
        """The bound of a directory after those above it, each looked at once."""
        if path not in seen:
            seen[path] = _unless_changed(path, self._since(os.path.dirname(path), seen))
        return seen[path]


def _has_layout(options: dict) -> bool:
    return str(options.get("layout", "false")).lower() == "true"


class MediaFilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_files"

    def schema(self) -> str:
        return LAYOUT_SCHEMA if _has_layout(self.options) else SCHEMA

    def reader(self, schema):
        pruned = self.options.get("pushdown") == "one-filter"
        return PrunedMediaFilesReader(self.options) if pruned else MediaFilesReader(self.options)

    def streamReader(self, schema):
        return MediaFilesStream(self.options)


def register(spark) -> None:
    spark.dataSource.register(MediaFilesSource)


def _with_options(reader, root: str, subfolder: str | None, options: dict):
    reader = reader.format("media_files").option("root", root)
    if subfolder:
        reader = reader.option("subfolder", subfolder)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()


def read_tree(spark, root: str, subfolder: str | None = None, **options):
    """The tree as a table, walked anew by every reader of it; as many tasks
    as a shuffle, or ``num_partitions``."""
    register(spark)
    options.setdefault("num_partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return _with_options(spark.read, root, subfolder, options)


def scan_tree(spark, root: str, where, subfolder: str | None = None, **options):
    """The tree's rows for which ``where``, a condition on the level columns,
    holds; only directories that its equalities and INs allow are walked."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    tree = read_tree(spark, root, subfolder, layout=True, pushdown="one-filter", **options)
    return tree.filter(where).drop(*LEVELS)


def stream_tree(spark, root: str, subfolder: str | None = None, **options):
    """The tree as a stream; a batch has as many tasks as a shuffle (most of
    its directories did not change), or ``num_partitions``."""
    register(spark)
    options.setdefault("num_partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return _with_options(spark.readStream, root, subfolder, options)


# ---------------------------------------------------------------------------
# Distributed listing: the driver lists only year/month/day; executors expand
# each day into project work units, the units are spread by a repartition
# (a day holding a third of all projects becomes many tasks), then walked.
# ---------------------------------------------------------------------------

UNIT_SCHEMA = "unit string, recursive boolean"
WALK_ROWS = 10_000     # rows a task holds before it hands them on


def _day_dirs(root: str, subfolder: str | None) -> tuple[list[str], list[str]]:
    """Day directories, and the directories above them that cannot be read."""
    level, depth = _start(root, subfolder)
    failed: list[str] = []
    for _ in range(3 - depth):
        level = [d for parent in level for d in _visible_dirs(parent, failed)]
    return level, failed


def _expand_days(expand_levels: int):
    import pandas as pd

    def fn(batches):
        for pdf in batches:
            units, rec = [], []
            for day in pdf["day"]:
                failed: list[str] = []
                projects = _visible_dirs(day, failed)
                units += failed
                rec += [False] * len(failed)
                for project in projects:
                    frontier = [project]
                    for _ in range(expand_levels):
                        nxt = []
                        for d in frontier:
                            units.append(d)
                            rec.append(False)
                            try:
                                with os.scandir(d) as it:
                                    nxt.extend(sorted(e.path for e in it if e.is_dir(follow_symlinks=False)))
                            except OSError:
                                pass
                        frontier = nxt
                    units.extend(frontier)
                    rec.extend([True] * len(frontier))
            yield pd.DataFrame({"unit": units, "recursive": pd.Series(rec, dtype=bool)})
    return fn


def _frames(found, extra: tuple[str, ...] = ()):
    """Rows as data frames of at most ``WALK_ROWS`` rows."""
    import pandas as pd

    while rows := list(itertools.islice(found, WALK_ROWS)):
        out = pd.DataFrame(rows, columns=["path", "size", "mtime", "is_link", "error", *extra])
        for name in ("size", *extra):
            out[name] = out[name].astype("Int64")
        out["mtime"] = pd.to_datetime(out["mtime"])
        out["is_link"] = out["is_link"].astype(bool)
        yield out


def _walk_units(batches):
    yield from _frames(r for pdf in batches for u, rec in zip(pdf["unit"], pdf["recursive"])
                       for r in walk_unit(Unit(u, bool(rec))))


def list_tree_distributed(spark, root: str, subfolder: str | None = None, expand_levels: int = 1,
                          num_partitions: int | None = None):
    """Same rows as the ``media_files`` source, with project discovery and the
    walk both running on executors."""
    days, failed = _day_dirs(root, subfolder)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    day_df = spark.createDataFrame([(d,) for d in days], "day string")
    units = day_df.repartition(max(1, min(len(days), n))).mapInPandas(_expand_days(expand_levels), UNIT_SCHEMA)
    units = units.union(spark.createDataFrame([(d, False) for d in failed], UNIT_SCHEMA))
    return units.repartition(n).mapInPandas(_walk_units, SCHEMA)


# ---------------------------------------------------------------------------
# Listing by rounds: the driver lists the root only.  A round walks every unit
# of the frontier up to a number of entries, level by level, and hands on the
# directories it did not reach; they are dealt out anew as the next frontier.
# A large subtree is so split wherever it is large, however deep, while a small
# one ends in the round that meets it.  One directory is one listing call.
# ---------------------------------------------------------------------------

FRONTIER_SCHEMA = SCHEMA + ", unit_level long"
UNIT_ENTRIES = 20_000     # entries of a unit after which its other directories are handed on


def walk_up_to(path: str, level: int, entries: int):
    """Rows below ``path`` (at ``level`` under the root), breadth first, until
    ``entries`` were listed; directories left over come as rows with their level."""
    queue, listed = collections.deque([(path, level)]), 0
    while queue:
        d, depth = queue.popleft()
        if listed >= entries:
            yield (d, None, None, False, None, depth)
            continue
        below: list[str] = []
        if depth < len(LEVELS):
            failed: list[str] = []
            below = _visible_dirs(d, failed)
            rows = (r for f in failed for r in walk_unit(Unit(f, recursive=False)))
        else:
            rows = walk_unit(Unit(d, recursive=False), below)
        for row in rows:
            listed += 1
            yield (*row, None)
        listed += len(below)
        queue.extend((b, depth + 1) for b in below)


def _walk_frontier(entries: int):
    def fn(batches):
        yield from _frames((r for pdf in batches for d, level in zip(pdf["path"], pdf["unit_level"])
                            for r in walk_up_to(d, int(level), entries)), ("unit_level",))
    return fn


def list_tree_frontier(spark, root: str, subfolder: str | None = None, unit_entries: int = UNIT_ENTRIES,
                       num_partitions: int | None = None):
    """Same rows as the ``media_files`` source, listed in rounds.  Each round
    is written to the shared folder, so a lost executor repeats its own units
    only; there are no more rounds than the tree has levels, and the driver
    holds the root's directories and a count per round."""
    from pyspark.sql import functions as F

    from copyledger.session import scratch_path

    if unit_entries < 1:
        raise ValueError("unit_entries must be at least 1")
    tasks = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    level, depth = _start(root, subfolder)
    failed: list[str] = []
    if not depth:
        level, depth = _visible_dirs(level[0], failed), 1
    start = [(d, depth) for d in level] + [(d, 0) for d in failed]
    frontier = spark.createDataFrame(start, "path string, unit_level long")
    written, units = [], len(start)
    while units:
        written.append(scratch_path(spark, "frontier"))
        (frontier.repartition(min(units, tasks)).mapInPandas(_walk_frontier(unit_entries), FRONTIER_SCHEMA)
         .write.parquet(written[-1]))
        frontier = (spark.read.schema(FRONTIER_SCHEMA).parquet(written[-1])
                    .filter(F.col("unit_level").isNotNull()).select("path", "unit_level"))
        units = frontier.count()
    if not written:
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema(FRONTIER_SCHEMA).parquet(*written)
    return rows.filter(F.col("unit_level").isNull()).drop("unit_level")
