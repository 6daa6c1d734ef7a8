"""The catalog's paths in buckets, so that a large batch finds the known ones
among its paths without the catalog's paths being shuffled.

A catalog's entry ``known_paths`` lists folders of bucketed parquet (one column,
``original_path``, hashed into buckets of about ``PATHS_PER_BUCKET`` paths).  A
run adds the paths that are new as one folder; folders before it that hold less
than twice as many are merged into it, so there are about log2(n) folders and a
path is rewritten as often at most.  Folders are never changed once written: a
run that fails before its commit leaves no trace in what readers see.

Spark reads a bucketed table by its definition, not by its files: a folder is
defined as a table just long enough to resolve it.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

KEY = "original_path"
ENTRY = "known_paths"
PATHS_PER_BUCKET = 1_000_000


def _table_name() -> str:
    return f"{ENTRY}_{uuid.uuid4().hex}"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _write(paths: DataFrame, root: str, rows: int, per_bucket: int) -> dict:
    buckets = max(1, -(-rows // per_bucket))
    folder, name = f"{ENTRY}/{uuid.uuid4().hex}", _table_name()
    (paths.repartition(buckets, KEY).write.format("parquet").bucketBy(buckets, KEY)
     .option("path", f"{root}/{folder}").saveAsTable(name))
    paths.sparkSession.sql(f"DROP TABLE {name}")     # the files stay: their place was given
    return {"folder": folder, "buckets": buckets, "rows": rows}


def _read(spark: SparkSession, root: str, folder: dict) -> DataFrame:
    name = _table_name()
    spark.sql(f"CREATE TABLE {name} ({KEY} STRING) USING parquet CLUSTERED BY ({KEY}) "
              f"INTO {folder['buckets']} BUCKETS LOCATION {_quoted(root + '/' + folder['folder'])}")
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def folders(entry: dict | None) -> list[dict]:
    return (entry or {}).get("folders", [])


def add_paths(paths: DataFrame, root: str, entry: dict | None = None, per_bucket: int = PATHS_PER_BUCKET) -> dict:
    """The entry with these paths added (a stored or staged frame: it is counted, then written)."""
    paths = paths.select(KEY)
    kept, rows = list(folders(entry)), paths.count()
    if not rows:
        return {"folders": kept}
    while kept and kept[-1]["rows"] < 2 * rows:
        last = kept.pop()
        paths, rows = paths.unionByName(_read(paths.sparkSession, root, last)), rows + last["rows"]
    return {"folders": [*kept, _write(paths, root, rows, per_bucket)]}


def known_among(batch: DataFrame, root: str, entry: dict | None) -> DataFrame:
    """The paths of ``batch`` that the entry holds.  The batch meets each folder
    in the folder's own buckets; where it is small, it is broadcast instead."""
    spark, keys = batch.sparkSession, batch.select(KEY)
    found = [_read(spark, root, f).join(keys.repartition(f["buckets"], KEY), KEY, "left_semi") for f in folders(entry)]
    return reduce(DataFrame.unionByName, found) if found else keys.limit(0)
