"""Catalog statistics, breakdowns and top-k lists.

The single-row summaries combine the files and the groups with one
aggregate over a tagged union (no join): each input row says which measure
it feeds.  Breakdowns are plain ``groupBy`` aggregates (partial + final);
top-k uses ``orderBy(...).limit(k)`` which plans as ``TakeOrderedAndProject``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from copyledger import constants as C
from copyledger.functions.formatting import iso_utc, ratio_pct, stat_to_int, utc_ts

_MEASURES = ("file_count", "total_size", "duplicate_count")


def _dup_int():
    return F.when(F.col("is_duplicate"), F.lit(1)).otherwise(F.lit(0))


def _tagged(files: DataFrame, groups: DataFrame) -> DataFrame:
    f = files.select(
        F.lit("f").alias("_src"), "project_name", "file_size_bytes",
        F.col("is_duplicate"), F.col("scan_timestamp"),
        F.lit(None).cast("long").alias("space_saved_bytes"),
        F.lit(None).cast("long").alias("duplicate_count"))
    g = groups.select(
        F.lit("g").alias("_src"), F.lit(None).cast("string").alias("project_name"),
        F.lit(None).cast("long").alias("file_size_bytes"),
        F.lit(None).cast("boolean").alias("is_duplicate"),
        F.lit(None).cast("timestamp").alias("scan_timestamp"),
        "space_saved_bytes", "duplicate_count")
    return f.unionByName(g)


def summary(files: DataFrame, groups: DataFrame) -> DataFrame:
    """Report header figures in one pass (one row)."""
    is_f = F.col("_src") == "f"
    is_g = F.col("_src") == "g"
    agg = _tagged(files, groups).agg(
        F.count_distinct(F.when(is_f, F.col("project_name"))).alias("total_projects"),
        F.count_if(is_f).alias("total_files"),
        F.count_if(is_f & F.col("is_duplicate")).alias("duplicate_files"),
        F.coalesce(F.sum(F.when(is_f, F.col("file_size_bytes"))), F.lit(0)).cast("long").alias("total_size_bytes"),
        F.coalesce(F.avg(F.when(is_f, F.col("file_size_bytes"))), F.lit(0.0)).alias("average_file_size"),
        F.coalesce(F.sum(F.when(is_g, F.col("space_saved_bytes"))), F.lit(0)).cast("long").alias("space_saved_bytes"),
        F.count_if(is_g & (F.col("duplicate_count") > 0)).alias("duplicate_groups"),
        F.max(F.when(is_f, F.col("scan_timestamp"))).alias("last_scan_timestamp"),
    )
    return _with_ratios(agg)


def _with_ratios(agg: DataFrame) -> DataFrame:
    return agg.select(
        "total_projects", "total_files",
        (F.col("total_files") - F.col("duplicate_files")).alias("unique_files"),
        "duplicate_files",
        ratio_pct("duplicate_files", "total_files").alias("duplicate_percentage"),
        "total_size_bytes", "space_saved_bytes",
        ratio_pct("space_saved_bytes", "total_size_bytes").alias("space_saved_percentage"),
        "duplicate_groups", "average_file_size", "last_scan_timestamp")


def statistics_table(files: DataFrame, groups: DataFrame, prior_stats: DataFrame | None,
                     updated_at: str) -> DataFrame:
    """The 11-key long statistics table.  The three deduplication counters
    are carried over from the prior table (0 when absent or not an integer)."""
    return _statistics_rows(summary(files, groups), prior_stats, updated_at)


def _statistics_rows(s: DataFrame, prior_stats: DataFrame | None, updated_at: str) -> DataFrame:
    spark = s.sparkSession
    ts = utc_ts(updated_at)
    fresh = s.withColumn("last_scan_iso", iso_utc("last_scan_timestamp")).select(F.expr(
        "stack(8, "
        "'total_files', cast(total_files as string), 'integer', "
        "'total_size_bytes', cast(total_size_bytes as string), 'integer', "
        "'unique_files', cast(unique_files as string), 'integer', "
        "'duplicate_files', cast(duplicate_files as string), 'integer', "
        "'duplicate_groups', cast(duplicate_groups as string), 'integer', "
        "'space_saved_bytes', cast(space_saved_bytes as string), 'integer', "
        "'space_saved_percentage', cast(space_saved_percentage as string), 'float', "
        "'last_scan_timestamp', coalesce(last_scan_iso, ''), 'datetime'"
        ") as (stat_name, stat_value, stat_type)"))
    keys = spark.createDataFrame([(k,) for k in C.DEDUP_COUNTER_KEYS], "stat_name string")
    if prior_stats is None:
        carried = keys.select("stat_name", F.lit("0").alias("stat_value"))
    else:
        prior = prior_stats.select("stat_name", "stat_value")
        carried = keys.join(prior, "stat_name", "left").select(
            "stat_name", stat_to_int("stat_value").cast("string").alias("stat_value"))
    carried = carried.withColumn("stat_type", F.lit("integer"))
    return fresh.unionByName(carried).withColumn("updated_at", ts)


# ---------------------------------------------------------------------------
# Statistics kept by deltas: a table of cells, one row per (year, month,
# project, status) of files and one row for the groups.  A run adds the cells of
# the rows it changed as they are now and takes away those of the same rows
# as they were; the statistics are then an aggregate over the cells.
# ---------------------------------------------------------------------------

CELL_KEYS = ("kind", "year", "month", "project_name", "deduplication_status")
CELL_SUMS = ("n_files", "n_sized", "bytes", "duplicates", "n_groups", "space_saved")


def _long(column) -> F.Column:
    return F.coalesce(column, F.lit(0)).cast("long")


def statistic_cells(files: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Cells of the given rows."""
    zero = F.lit(0).cast("long")
    cells = (files.groupBy(*CELL_KEYS[1:])
             .agg(_long(F.count(F.lit(1))).alias("n_files"), _long(F.count("file_size_bytes")).alias("n_sized"),
                  _long(F.sum("file_size_bytes")).alias("bytes"), _long(F.sum(_dup_int())).alias("duplicates"),
                  zero.alias("n_groups"), zero.alias("space_saved"), F.max("scan_timestamp").alias("last_scan"))
             .withColumn("kind", F.lit("files")))
    if groups is not None:
        cells = cells.unionByName(groups.agg(
            _long(F.count_if(F.col("duplicate_count") > 0)).alias("n_groups"),
            _long(F.sum("space_saved_bytes")).alias("space_saved")).withColumn("kind", F.lit("groups")),
            allowMissingColumns=True)
    return cells.select(*CELL_KEYS, *[_long(F.col(c)).alias(c) for c in CELL_SUMS], "last_scan")


def moved_cells(cells: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """``cells`` after a run that turned the rows of ``before`` into those of
    ``after`` (cells of either).  Scan times only rise, so the latest is kept."""
    gone = before.select(*CELL_KEYS, *[(-F.col(c)).alias(c) for c in CELL_SUMS],
                         F.lit(None).cast("timestamp").alias("last_scan"))
    summed = (cells.unionByName(gone).unionByName(after).groupBy(*CELL_KEYS)
              .agg(*[F.sum(c).alias(c) for c in CELL_SUMS], F.max("last_scan").alias("last_scan")))
    return summed.filter((F.col("kind") == "groups") | (F.col("n_files") != 0))


def cells_summary(cells: DataFrame) -> DataFrame:
    """``summary`` from cells: projects are distinct over cells, not over files."""
    is_f = F.col("kind") == "files"
    total = {c: _long(F.sum(c)) for c in CELL_SUMS}
    return _with_ratios(cells.agg(
        F.count_distinct(F.when(is_f, F.col("project_name"))).alias("total_projects"),
        total["n_files"].alias("total_files"), total["duplicates"].alias("duplicate_files"),
        total["bytes"].alias("total_size_bytes"),
        F.coalesce(F.sum("bytes") / F.nullif(F.sum("n_sized"), F.lit(0)), F.lit(0.0)).alias("average_file_size"),
        total["space_saved"].alias("space_saved_bytes"), total["n_groups"].alias("duplicate_groups"),
        F.max(F.when(is_f, F.col("last_scan"))).alias("last_scan_timestamp")))


def statistics_from_cells(cells: DataFrame, prior_stats: DataFrame | None, updated_at: str) -> DataFrame:
    """``statistics_table`` without reading files or groups."""
    return _statistics_rows(cells_summary(cells), prior_stats, updated_at)


def upsert_stats(prior: DataFrame, new: DataFrame) -> DataFrame:
    """New keys overwrite, other prior keys are kept."""
    return new.unionByName(prior.join(new.select("stat_name"), "stat_name", "left_anti"))


def report_cells(files: DataFrame) -> DataFrame:
    """Files combined per (year, month, project, status): one scan serves every
    breakdown below, which take these cells in place of file rows."""
    return files.groupBy("year", "month", "project_name", "deduplication_status").agg(
        F.count(F.lit(1)).alias("cell_rows"), F.sum("file_size_bytes").alias("file_size_bytes"),
        F.sum(_dup_int()).alias("cell_duplicates"))


def _count(df: DataFrame):
    return (F.sum("cell_rows") if "cell_rows" in df.columns else F.count(F.lit(1))).cast("long")


def _measures(df: DataFrame, *keys: str) -> DataFrame:
    dups = F.sum(F.col("cell_duplicates") if "cell_duplicates" in df.columns else _dup_int())
    return df.groupBy(*keys).agg(
        _count(df).alias("file_count"),
        F.coalesce(F.sum("file_size_bytes"), F.lit(0)).cast("long").alias("total_size"),
        dups.cast("long").alias("duplicate_count"))


def breakdown_by_year(files: DataFrame) -> DataFrame:
    return _measures(files.filter(F.col("year").isNotNull()), "year")


def breakdown_by_month(files: DataFrame) -> DataFrame:
    return _measures(files.filter(F.col("year").isNotNull() & F.col("month").isNotNull()),
                     "year", "month")


def project_measures(files: DataFrame) -> DataFrame:
    return _measures(files.filter(F.col("project_name").isNotNull()), "project_name")


def top_projects(files: DataFrame, by: str = "file_count", k: int = C.TOP_K_DEFAULT) -> DataFrame:
    """Top-k projects by ``file_count`` or ``total_size``; ties by name."""
    return project_measures(files).orderBy(F.col(by).desc(), F.col("project_name").asc()).limit(k)


def status_breakdown(files: DataFrame) -> DataFrame:
    return files.groupBy("deduplication_status").agg(_count(files).alias("count"))


SECTIONS = {"year": ("year",), "month": ("year", "month"), "project": ("project_name",),
            "status": ("deduplication_status",)}


def report_sections(files: DataFrame) -> DataFrame:
    """All breakdowns in one aggregate over one scan: ``section``, the key
    columns (NULL where the section has no such key) and the measures."""
    keys = ["year", "month", "project_name", "deduplication_status"]
    sets = files.groupingSets([[F.col(k) for k in own] for own in SECTIONS.values()], *keys).agg(
        F.grouping_id(*keys).alias("_id"),
        _count(files).alias("file_count"),
        F.coalesce(F.sum("file_size_bytes"), F.lit(0)).cast("long").alias("total_size"),
        F.coalesce(F.sum(_dup_int()), F.lit(0)).cast("long").alias("duplicate_count"))
    section, kept = F.lit(None).cast("string"), F.lit(False)
    for name, own in SECTIONS.items():
        bits = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in own)
        here, known = F.col("_id") == bits, F.lit(True)
        for k in own if name != "status" else ():
            known = known & F.col(k).isNotNull()
        section, kept = F.when(here, F.lit(name)).otherwise(section), kept | (here & known)
    return sets.filter(kept).select(section.alias("section"), *keys, "file_count", "total_size", "duplicate_count")


def ordered_breakdowns(files: DataFrame) -> DataFrame:
    """The year, month and status breakdowns with ``place``, the row's position
    in its section's order.  The windows see one row per year, month or status."""
    cells = report_cells(files)

    def placed(section: str, df: DataFrame, label, count: str, *order) -> DataFrame:
        place = F.row_number().over(Window.orderBy(*order)).cast("long")
        return df.select(F.lit(section).alias("section"), place.alias("place"), label.alias("label"),
                         F.col(count).alias("file_count"))

    year, month = F.col("year").desc(), F.col("month").desc()
    return (placed("year", breakdown_by_year(cells), F.col("year"), "file_count", year)
            .unionByName(placed("month", breakdown_by_month(cells), F.concat_ws("/", "year", "month"),
                                "file_count", year, month))
            .unionByName(placed("status", status_breakdown(cells), F.col("deduplication_status"), "count",
                                F.col("count").desc(), F.col("deduplication_status"))))


def capacity_need(files: DataFrame, capacity_bytes: int | None = None) -> DataFrame:
    """Bytes of pending files (duplicates included) against a capacity."""
    pending = files.filter(F.col("deduplication_status") == C.STATUS_PENDING)
    agg = pending.agg(F.count(F.lit(1)).alias("pending_files"),
                      F.coalesce(F.sum("file_size_bytes"), F.lit(0)).cast("long").alias("pending_bytes"))
    if capacity_bytes is None:
        return agg
    return agg.withColumn("capacity_bytes", F.lit(capacity_bytes).cast("long")) \
        .withColumn("sufficient", F.col("capacity_bytes") >= F.col("pending_bytes"))
