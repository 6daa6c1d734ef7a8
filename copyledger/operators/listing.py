"""Listing -> catalog rows: layout parse (year/month/day/project), the scan
filters (hidden levels, links, video extensions, depth) and subfolder scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyledger.functions import paths as P

LEVELS = ("year", "month", "month_day", "project_name")


def validate_subfolder(subfolder: str | None) -> tuple[str, str] | None:
    """``year/month`` -> (year, month); anything else is refused."""
    if subfolder is None:
        return None
    parts = [p for p in subfolder.strip("/").split("/") if p]
    if len(parts) != 2 or any(p in (".", "..") for p in parts):
        raise ValueError(f"subfolder must be exactly 'year/month', got {subfolder!r}")
    return parts[0], parts[1]


def parse_layout(listing: DataFrame, root: str) -> DataFrame:
    """Adds ``rel_depth, year, month, month_day, project_name, file_name``."""
    rel = P.relative_to("path", root)
    parts = P.layout_parts(rel)
    out = listing.withColumn("_parts", parts).withColumn("rel_depth", F.size("_parts"))
    for i, name in enumerate(LEVELS):
        out = out.withColumn(name, P.layout_level("_parts", i))
    return out.withColumn("file_name", P.basename("path")).drop("_parts")


def keep_filter(root_is_inside: bool = True):
    """Scan filters: below a project dir, no hidden level 1-4, no links, video ext."""
    visible = F.lit(True)
    for name in LEVELS:
        visible = visible & ~F.col(name).startswith(".")
    return ((F.col("rel_depth") >= 5) & visible & ~F.col("is_link")
            & P.is_video_name("file_name"))


def catalog_rows(listing: DataFrame, root: str, subfolder: str | None = None,
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """Catalog-shaped rows (``original_path, file_name, file_size_bytes,
    created_at, year, month, month_day, project_name``) plus ``keep`` columns."""
    parsed = parse_layout(listing.filter(F.col("path").startswith(root.rstrip("/") + "/")), root)
    out = parsed.filter(keep_filter())
    scope = validate_subfolder(subfolder)
    if scope is not None:
        out = out.filter((F.col("year") == scope[0]) & (F.col("month") == scope[1]))
    return out.select(
        F.col("path").alias("original_path"),
        "file_name",
        F.col("size").alias("file_size_bytes"),
        F.col("mtime").alias("created_at"),
        *LEVELS,
        *keep,
    )


def scan_errors(listing: DataFrame, root: str, subfolder: str | None = None) -> DataFrame:
    """Entries below ``root`` that could not be read (``path, error``): files
    and whole directories, whatever their extension."""
    out = listing.filter(F.col("error").isNotNull()
                         & (F.concat("path", F.lit("/")).startswith(root.rstrip("/") + "/")))
    scope = validate_subfolder(subfolder)
    if scope is not None:
        out = out.filter(F.concat("path", F.lit("/")).startswith("/".join((root.rstrip("/"), *scope)) + "/"))
    return out.select("path", "error")


def files_per_project(rows: DataFrame) -> DataFrame:
    """Files found per project directory of a scan."""
    return rows.groupBy("year", "month", "month_day", "project_name").agg(
        F.count(F.lit(1)).alias("file_count"))
