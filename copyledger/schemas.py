"""StructTypes of the catalog tables, and the listing."""

from __future__ import annotations

from pyspark.sql import types as T

FILES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("original_path", T.StringType(), False),
    T.StructField("file_name", T.StringType(), False),
    T.StructField("file_size_bytes", T.LongType(), True),
    T.StructField("file_hash", T.StringType(), True),
    T.StructField("created_at", T.TimestampNTZType(), True),
    T.StructField("year", T.StringType(), True),
    T.StructField("month", T.StringType(), True),
    T.StructField("month_day", T.StringType(), True),
    T.StructField("project_name", T.StringType(), True),
    T.StructField("scan_timestamp", T.TimestampType(), True),
    T.StructField("is_duplicate", T.BooleanType(), False),
    T.StructField("master_file_id", T.LongType(), True),
    T.StructField("deduplication_status", T.StringType(), True),
    T.StructField("deduplication_timestamp", T.TimestampType(), True),
])

PATHS = T.StructType([
    T.StructField("file_id", T.LongType(), False),
    T.StructField("path_type", T.StringType(), False),
    T.StructField("path", T.StringType(), False),
    T.StructField("created_at", T.TimestampType(), True),
])

GROUPS = T.StructType([
    T.StructField("group_hash", T.StringType(), False),
    T.StructField("file_size_bytes", T.LongType(), True),
    T.StructField("master_file_id", T.LongType(), True),
    T.StructField("duplicate_count", T.LongType(), True),
    T.StructField("total_size_bytes", T.LongType(), True),
    T.StructField("space_saved_bytes", T.LongType(), True),
    T.StructField("created_at", T.TimestampType(), True),
    T.StructField("deduplicated_at", T.TimestampType(), True),
])

STATISTICS = T.StructType([
    T.StructField("stat_name", T.StringType(), False),
    T.StructField("stat_value", T.StringType(), True),
    T.StructField("stat_type", T.StringType(), True),
    T.StructField("updated_at", T.TimestampType(), True),
])

CELLS = T.StructType([
    T.StructField("kind", T.StringType(), False),
    T.StructField("year", T.StringType(), True),
    T.StructField("month", T.StringType(), True),
    T.StructField("project_name", T.StringType(), True),
    T.StructField("deduplication_status", T.StringType(), True),
    T.StructField("n_files", T.LongType(), False),
    T.StructField("n_sized", T.LongType(), False),
    T.StructField("bytes", T.LongType(), False),
    T.StructField("duplicates", T.LongType(), False),
    T.StructField("n_groups", T.LongType(), False),
    T.StructField("space_saved", T.LongType(), False),
    T.StructField("last_scan", T.TimestampType(), True),
])

LISTING = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("size", T.LongType(), True),
    T.StructField("mtime", T.TimestampNTZType(), True),
    T.StructField("is_link", T.BooleanType(), False),
    T.StructField("error", T.StringType(), True),
])

TABLES = {
    "files": FILES,
    "paths": PATHS,
    "duplicate_groups": GROUPS,
    "statistics": STATISTICS,
    "cells": CELLS,
}
