"""Catalog storage as versioned parquet snapshots, plus staging helpers.

A catalog lives under ``<root>/<table>/v=<N>-<id>/``.  A run never overwrites
what it read: it writes its tables into folders of its own, with a fresh id, and
then one commit marker ``<root>/_commits/v=N+1`` that names, for every table,
the folder it is read from, so readers see all tables of a version or none of
them, and two writers of one version never touch each other's files (the second
marker fails).  ``files`` is partitioned by ``year``, and its entry names the
folder of each partition: a run that changed some years writes those and takes
the others over from the version before.  A marker holds the whole list, so a
reader opens the newest one only, however many versions there are.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from copyledger import schemas
from copyledger.session import scratch_path
from copyledger.sources.path_buckets import ENTRY as PATHS_ENTRY

COMMITS = "_commits"
PARTITION_COLS = {"files": ("year",)}


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, jpath


def _exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _fs(spark, path)
    return fs.exists(jpath)


def committed_versions(spark: SparkSession, root: str) -> list[int]:
    """Versions whose commit marker exists (written after all their tables)."""
    fs, jpath = _fs(spark, f"{root}/{COMMITS}")
    if not fs.exists(jpath):
        return []
    return sorted(int(st.getPath().getName()[2:]) for st in fs.listStatus(jpath)
                  if st.getPath().getName().startswith("v="))


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """What the newest commit marker (at or below ``version``) holds: ``source``,
    ``tables`` (entries of ``write_table``) and ``streams`` (newest micro-batch of each)."""
    seen = [v for v in committed_versions(spark, root) if version is None or v <= version]
    return _marker(spark, root, seen[-1]) if seen else {"source": "", "tables": {}, "streams": {}}


def _marker(spark: SparkSession, root: str, version: int) -> dict:
    fs, jpath = _fs(spark, f"{root}/{COMMITS}/v={version}")
    stream = fs.open(jpath)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def read_entry(spark: SparkSession, root: str, table: str, entry: dict | None) -> DataFrame:
    """A table from its folders; empty and typed if there are none.  At most
    one scan per folder that a partition is read from."""
    schema = schemas.TABLES[table]
    if entry and "folder" in entry:
        return spark.read.schema(schema).parquet(f"{root}/{entry['folder']}").select(*schema.fieldNames())
    by_folder: dict[str, list[str]] = {}
    for part, folder in sorted((entry or {}).get("parts", {}).items()):
        by_folder.setdefault(folder, []).append(f"{root}/{folder}/{part}")
    out = None
    for folder, paths in by_folder.items():
        df = spark.read.schema(schema).option("basePath", f"{root}/{folder}").parquet(*paths)
        out = df.select(*schema.fieldNames()) if out is None else out.unionByName(df.select(*schema.fieldNames()))
    return spark.createDataFrame([], schema) if out is None else out


def read_table(spark: SparkSession, root: str, table: str, version: int | None = None) -> DataFrame:
    """The table as of the latest committed version (or as of ``version``)."""
    return read_entry(spark, root, table, manifest(spark, root, version)["tables"].get(table))


def _part_names(spark: SparkSession, column: str, values: Iterable) -> set[str]:
    """Folder names of partition values, as Spark writes them."""
    jvm = spark.sparkContext._jvm
    name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    return {name(column, v) for v in values}


def write_table(df: DataFrame, root: str, table: str, version: int, changed: Iterable | None = None) -> dict:
    """Write one table of an uncommitted version into a folder of its own and
    return its entry for ``commit``.  ``changed``: of a partitioned table, the
    partition values that are written (all rows of them are in ``df``); the
    others are taken over from the newest committed version."""
    from pyspark.sql import functions as F

    spark = df.sparkSession
    if version in committed_versions(spark, root):
        raise FileExistsError(f"version {version} of {root} is already committed")
    folder = f"{table}/v={version}-{uuid.uuid4().hex[:12]}"
    df = df.select(*schemas.TABLES[table].fieldNames())
    if table not in PARTITION_COLS:
        df.write.parquet(f"{root}/{folder}")
        return {"folder": folder}
    (column,) = PARTITION_COLS[table]
    parts: dict[str, str] = {}
    if changed is not None:
        changed = list(changed)
        new = _part_names(spark, column, changed)
        old = manifest(spark, root)["tables"].get(table, {}).get("parts", {})
        parts = {p: f for p, f in old.items() if p not in new}
        hit = F.col(column).isin([v for v in changed if v is not None])
        df = df.where(hit | F.col(column).isNull() if None in changed else hit)
    df.write.partitionBy(column).parquet(f"{root}/{folder}")
    fs, jpath = _fs(spark, f"{root}/{folder}")
    written = [st.getPath().getName() for st in fs.listStatus(jpath) if st.isDirectory()]
    return {"parts": parts | {name: folder for name in written if name.startswith(f"{column}=")}}


def commit(spark: SparkSession, root: str, version: int, source: str | None = None,
           entries: dict[str, dict] | None = None) -> None:
    """Publish a version: readers see all its tables at once, or none.  The
    marker holds ``source`` (``stream#batch`` for a micro-batch) and all tables'
    entries, those not in ``entries`` as before (bucketed paths only as long as
    ``files`` is); a second writer of the same version fails."""
    old = manifest(spark, root, version - 1)
    tables = dict(old["tables"])
    if "files" in (entries or {}):
        tables.pop(PATHS_ENTRY, None)
    stream, _, batch = (source or "").rpartition("#")
    streams = old["streams"] | ({stream: int(batch)} if stream else {})
    text = json.dumps({"source": source or "", "tables": tables | (entries or {}), "streams": streams})
    fs, jpath = _fs(spark, f"{root}/{COMMITS}/v={version}")
    out = fs.create(jpath, False)
    out.write(text.encode())
    out.close()


def committed_source(spark: SparkSession, root: str, version: int) -> str:
    """The source that the version's commit marker holds."""
    return _marker(spark, root, version)["source"]


def next_version(spark: SparkSession, root: str) -> int:
    seen = committed_versions(spark, root)
    return (seen[-1] + 1) if seen else 1


def write_catalog(tables: dict[str, DataFrame], root: str, version: int | None = None) -> int:
    """Write every table of a catalog version, then commit it."""
    spark = next(iter(tables.values())).sparkSession
    version = version or next_version(spark, root)
    entries = {name: write_table(df, root, name, version) for name, df in tables.items()}
    commit(spark, root, version, entries=entries)
    return version


def read_catalog(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    tables = manifest(spark, root, version)["tables"]
    return {t: read_entry(spark, root, t, tables.get(t)) for t in schemas.TABLES}


def stage_path(df: DataFrame, kind: str = "stage") -> str:
    """Write ``df`` to a fresh folder in the shared checkpoint folder."""
    path = scratch_path(df.sparkSession, kind)
    df.write.mode("overwrite").parquet(path)
    return path


def stage(df: DataFrame, kind: str = "stage") -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: cuts
    lineage (a lost executor re-reads the staged files, not the sources) and
    later readers get column pruning and pushed filters."""
    return df.sparkSession.read.parquet(stage_path(df, kind))


def read_files_scoped(spark: SparkSession, root: str, subfolder: str | None = None,
                      columns: tuple[str, ...] | None = None) -> DataFrame:
    """The latest ``files`` table, optionally scoped to ``year/month``: the
    year prunes partitions, the month becomes a pushed parquet filter."""
    from pyspark.sql import functions as F

    files = read_table(spark, root, "files")
    if subfolder:
        parts = [p for p in subfolder.strip("/").split("/") if p]
        if len(parts) != 2:
            raise ValueError("subfolder must be exactly 'year/month'")
        files = files.filter((F.col("year") == parts[0]) & (F.col("month") == parts[1]))
    return files.select(*columns) if columns else files
