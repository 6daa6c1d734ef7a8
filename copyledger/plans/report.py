"""Markdown report: every figure computed by Spark, rendered to
``(section, ord, line)`` rows.

The report is an aggregate of bounded size (a few lines per year, month,
status and top-k project), so ordering its lines is cheap; writing it
sorts by (section, ord) and emits one text file.  Sections whose breakdown
is empty are omitted, and the three deduplication counter lines appear only
when ``files_deduplicated`` is positive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copyledger import constants as C
from copyledger.functions.formatting import fixed2, format_bytes, format_percentage, stat_to_int, thousands
from copyledger.operators import stats as S
from copyledger.sources.snapshots import stage

# ---------------------------------------------------------------------------
# FIXED VALUES: report text (titles, labels and table headers)
# ---------------------------------------------------------------------------
TITLE = "# Video Catalog Report\n"
RULE = "---\n"
SUMMARY_TITLE = "## Executive Summary\n"
DETAIL_TITLE = "## Detailed Statistics\n"
OVERVIEW_TITLE = "### File Overview\n"
DEDUP_TITLE = "### Deduplication Statistics\n"
METRIC_HEADER = ("| Metric | Value |", "|--------|-------|")
YEAR_TITLE = "## Breakdown by Year\n"
YEAR_HEADER = ("| Year | Files | Total Size | Duplicates |", "|------|-------|------------|------------|")
MONTH_TITLE = "## Breakdown by Month\n"
MONTH_HEADER = ("| Year | Month | Files | Total Size | Duplicates |",
                "|------|-------|-------|------------|------------|")
TOP_COUNT_TITLE = "## Top 10 Projects by File Count\n"
TOP_SIZE_TITLE = "## Top 10 Projects by Total Size\n"
PROJECT_HEADER = ("| Project Name | Files | Total Size | Duplicates |",
                  "|--------------|-------|------------|------------|")
STATUS_TITLE = "## Files by Deduplication Status\n"
STATUS_HEADER = ("| Status | Count |", "|--------|-------|")
GENERATED = "*Generated: {}*\n"
BULLET = "- **{}**: "
SUMMARY_LABELS = ("Total Projects Scanned", "Total Videos Cataloged", "Unique Videos", "Duplicate Videos",
                  "Total Storage", "Space Saved (Deduplication)", "Duplicate Groups", "Average File Size",
                  "Files Consolidated", "Symlinks Created", "Files Deduplicated")
OVERVIEW_LABELS = ("Total Videos", "Unique Videos", "Duplicate Videos", "Total Storage Size", "Average File Size")
DEDUP_LABELS = ("Duplicate Groups", "Space Saved", "Space Saved Percentage", "Files Consolidated",
                "Symlinks Created", "Files Deduplicated")


def _lines(df: DataFrame, section: int, items: list[tuple[Column, Column | None]]) -> DataFrame:
    """One output row per (line, condition) of a one-row frame."""
    arr = F.array(*[F.struct(F.lit(i).alias("ord"), text.alias("line"),
                             (cond if cond is not None else F.lit(True)).alias("keep"))
                    for i, (text, cond) in enumerate(items)])
    return (df.select(F.explode(arr).alias("x")).filter("x.keep")
            .select(F.lit(section).alias("section"), F.col("x.ord").alias("ord"), F.col("x.line").alias("line")))


def _table(rows: DataFrame, section: int, title: str, header: tuple[str, str],
           order: list[Column], cells: list[Column]) -> DataFrame:
    """Title and header (only when ``rows`` is not empty), one line per row in
    ``order``, then a blank line."""
    n = rows.agg(F.count(F.lit(1)).alias("n")).filter("n > 0")
    head = _lines(n, section, [(F.lit(title), None), (F.lit(header[0]), None), (F.lit(header[1]), None)])
    w = Window.orderBy(*order)   # a bounded breakdown (years, months, statuses, top-k)
    body = rows.select(
        F.lit(section).alias("section"), (F.row_number().over(w) + 2).alias("ord"),
        F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    tail = n.select(F.lit(section).alias("section"), F.lit(1 << 30).alias("ord"), F.lit("").alias("line"))
    return head.unionByName(body).unionByName(tail)


def report_lines(files: DataFrame, groups: DataFrame, stats_table: DataFrame | None,
                 generated_at: str) -> DataFrame:
    """The report's lines (``section, ord, line``).  ``files`` is scanned twice:
    for the one-row summary and for the cells that all breakdowns share."""
    s = S.summary(files, groups)
    if stats_table is not None:
        counters = stats_table.filter(F.col("stat_name").isin(*C.DEDUP_COUNTER_KEYS)).groupBy().pivot(
            "stat_name", list(C.DEDUP_COUNTER_KEYS)).agg(F.first("stat_value"))
        counters = counters.select(*[stat_to_int(F.col(k)).alias(k) for k in C.DEDUP_COUNTER_KEYS])
    else:
        counters = files.sparkSession.createDataFrame(
            [(0, 0, 0)], ", ".join(f"{k} long" for k in C.DEDUP_COUNTER_KEYS))
    # Both are one-row aggregates: stack them into one row without a join.
    one = s.select("*", *[F.lit(None).cast("long").alias(k) for k in C.DEDUP_COUNTER_KEYS]).unionByName(
        counters.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in s.schema.fields],
                        *C.DEDUP_COUNTER_KEYS)).agg(*[F.max(c).alias(c) for c in s.columns + list(C.DEDUP_COUNTER_KEYS)])
    one = stage(one, "report-summary")
    files = stage(S.report_cells(files), "report-cells")

    tv, uq, dp = F.col("total_files"), F.col("unique_files"), F.col("duplicate_files")
    has_dedup = F.col("files_deduplicated") > 0
    pct_saved = F.concat(fixed2("space_saved_percentage"), F.lit("%"))
    fc, sc, fd = (thousands(F.col(k)) for k in ("files_consolidated", "symlinks_created", "files_deduplicated"))

    def with_share(value: Column, share: Column) -> Column:
        return F.concat(value, F.lit(" ("), share, F.lit(")"))

    def metrics(labels: tuple[str, ...], values: list[Column], last: str = " |") -> list[Column]:
        ends = [" |"] * (len(labels) - 1) + [last]
        return [F.concat(F.lit(f"| {label} | "), value, F.lit(end))
                for label, value, end in zip(labels, values, ends, strict=True)]

    def always(*lines) -> list[tuple[Column, Column | None]]:
        return [(F.lit(x) if isinstance(x, str) else x, None) for x in lines]

    unique, duplicates = (with_share(thousands(c), format_percentage(c, tv)) for c in (uq, dp))
    stored, saved, mean = (format_bytes(c) for c in ("total_size_bytes", "space_saved_bytes", "average_file_size"))
    n_groups, run = thousands("duplicate_groups"), [fc, sc, fd]
    bullets = [F.concat(F.lit(BULLET.format(label)), value) for label, value in zip(SUMMARY_LABELS, [
        thousands("total_projects"), thousands(tv), unique, duplicates, stored, with_share(saved, pct_saved),
        n_groups, mean, *run], strict=True)]
    savings = metrics(DEDUP_LABELS, [n_groups, saved, pct_saved, *run])

    def of_run(lines: list[Column]) -> list[tuple[Column, Column | None]]:
        """The counters of a run, last in their section, stand only after one."""
        return [*always(*lines[:-len(run)]), *[(x, has_dedup) for x in lines[-len(run):]]]

    head = _lines(one, 0, always(TITLE, GENERATED.format(generated_at), RULE))
    summary = _lines(one, 1, [*always(SUMMARY_TITLE), *of_run(bullets), *always("")])
    detail = _lines(one, 2, [
        *always(DETAIL_TITLE, OVERVIEW_TITLE, *METRIC_HEADER,
                *metrics(OVERVIEW_LABELS, [thousands(tv), unique, duplicates, stored, mean], last=" |\n"),
                DEDUP_TITLE, *METRIC_HEADER),
        *of_run(savings), *always("")])

    def measure_cells(*keys):
        return [F.col(k) for k in keys] + [thousands("file_count"), format_bytes("total_size"),
                                           thousands("duplicate_count")]

    years = _table(S.breakdown_by_year(files), 3, YEAR_TITLE, YEAR_HEADER,
                   [F.col("year").desc()], measure_cells("year"))
    months = _table(S.breakdown_by_month(files), 4, MONTH_TITLE, MONTH_HEADER,
                    [F.col("year").desc(), F.col("month").desc()], measure_cells("year", "month"))
    top_n = _table(S.top_projects(files, "file_count"), 5, TOP_COUNT_TITLE, PROJECT_HEADER,
                   [F.col("file_count").desc(), F.col("project_name")], measure_cells("project_name"))
    top_s = _table(S.top_projects(files, "total_size"), 6, TOP_SIZE_TITLE, PROJECT_HEADER,
                   [F.col("total_size").desc(), F.col("project_name")], measure_cells("project_name"))
    status = S.status_breakdown(files).withColumn("deduplication_status",
                                                  F.coalesce("deduplication_status", F.lit("None")))
    stat_t = _table(status, 7, STATUS_TITLE, STATUS_HEADER,
                    [F.col("count").desc(), F.col("deduplication_status")],
                    [F.col("deduplication_status"), thousands("count")])
    out = head
    for part in (summary, detail, years, months, top_n, top_s, stat_t):
        out = out.unionByName(part)
    return out


def write_report(lines: DataFrame, path: str) -> str:
    """One markdown file: lines in (section, ord) order."""
    # A bounded number of lines; one sorted partition is one file in this order.
    (lines.repartition(1).sortWithinPartitions("section", "ord").select("line").write.mode("overwrite").text(path))
    return path
