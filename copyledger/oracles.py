"""DuckDB SQL for each registered query (same column names and values).

Tables ``documents``, ``pages`` ... are views over the same parquet files.
The fixture CTEs restate FIXTURES.md section 2 in SQL.
"""

from __future__ import annotations

from copyledger import constants as C
from copyledger.sources import fixture as FX


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def sampled_fp_sql(b: str) -> str:
    n = f"octet_length({b})"
    return (f"CASE WHEN {n} < {C.HASH_MIN_SIZE_FOR_MULTI_CHUNK} THEN md5({b}) ELSE md5("
            f"md5({b}[1:{C.HASH_CHUNK_SIZE}]) || "
            f"md5({b}[({n} // 2 - {C.HASH_CHUNK_SIZE // 2 - 1}):({n} // 2 + {C.HASH_CHUNK_SIZE // 2})]) || "
            f"md5({b}[({n} - {C.HASH_CHUNK_SIZE - 1}):{n}])) END")


FIXTURE_CTES = f"""
fx AS (
  SELECT doc_id AS id, lang, source, encode(text) AS content,
    CAST({FX.FIRST_YEAR} + doc_id % 3 AS VARCHAR) AS year,
    ({_list(FX.MONTH_NAMES)})[(doc_id // 3) % 12 + 1] AS month,
    lpad(CAST((doc_id // 3) % 12 + 1 AS VARCHAR), 2, '0') || '_' ||
      lpad(CAST(1 + (doc_id // 36) % 28 AS VARCHAR), 2, '0') AS month_day,
    CASE WHEN doc_id % {FX.HIDDEN_PROJECT_EVERY} = 0 THEN '.' || source ELSE source END AS project_name,
    'clip_' || CAST(doc_id % {FX.NAMES_PER_PROJECT} AS VARCHAR) || '.' ||
      ({_list(FX.FIXTURE_EXTS)})[doc_id % 8 + 1] AS file_name,
    doc_id % {FX.LINK_EVERY} = 0 AS is_link,
    CASE WHEN doc_id % 10 < {FX.BATCH1_BELOW} THEN 1 ELSE 2 END AS scan_batch
  FROM documents),
fl AS (
  SELECT *, '{FX.FIXTURE_ROOT}/' || year || '/' || month || '/' || month_day || '/' ||
      project_name || '/' || lang || '/' ||
      CASE WHEN id >= {FX.PATHS_REPEAT} THEN 'b' || CAST(id // {FX.PATHS_REPEAT} AS VARCHAR) || '/' ELSE '' END ||
      file_name AS original_path,
    CAST(octet_length(content) AS BIGINT) AS file_size_bytes,
    md5(content) AS content_fp_full,
    {sampled_fp_sql('content')} AS content_fp
  FROM fx),
files_v AS (
  SELECT * FROM fl
  WHERE NOT is_link
    AND NOT (year LIKE '.%' OR month LIKE '.%' OR month_day LIKE '.%' OR project_name LIKE '.%')
    AND lower(regexp_extract(file_name, '^.+(\\.[^.]+)$', 1)) IN {_in(C.VIDEO_EXTENSIONS)})"""


def catalog_ctes(fp_col: str = "content_fp") -> str:
    """files_v -> gate -> groups -> flags -> state (as ``cat`` and ``grp``)."""
    return FIXTURE_CTES + f""",
shared AS (SELECT file_size_bytes FROM files_v GROUP BY file_size_bytes HAVING count(*) > 1),
hashed AS (
  SELECT f.*, CASE WHEN s.file_size_bytes IS NOT NULL THEN f.{fp_col} END AS file_hash
  FROM files_v f LEFT JOIN shared s ON f.file_size_bytes = s.file_size_bytes),
grp AS (
  SELECT file_hash AS group_hash,
    CAST(arg_min(file_size_bytes, id) AS BIGINT) AS file_size_bytes,
    min(id) AS master_file_id,
    CAST(count(*) - 1 AS BIGINT) AS duplicate_count,
    CAST(sum(file_size_bytes) AS BIGINT) AS total_size_bytes,
    CAST(sum(file_size_bytes) - arg_min(file_size_bytes, id) AS BIGINT) AS space_saved_bytes
  FROM hashed WHERE file_hash IS NOT NULL GROUP BY file_hash HAVING count(*) > 1),
cat AS (
  SELECT h.* EXCLUDE (content),
    (g.master_file_id IS NOT NULL AND h.id <> g.master_file_id) AS is_duplicate,
    CASE WHEN g.master_file_id IS NOT NULL AND h.id <> g.master_file_id
         THEN g.master_file_id END AS master_file_id,
    CASE WHEN h.id % {FX.DONE_EVERY} = 0 THEN '{C.STATUS_DONE}' ELSE '{C.STATUS_PENDING}' END
      AS deduplication_status,
    CASE WHEN h.scan_batch = 1 THEN TIMESTAMP '{FX.BATCH_RUN_TS[0]}'
         ELSE TIMESTAMP '{FX.BATCH_RUN_TS[1]}' END AS scan_timestamp
  FROM hashed h LEFT JOIN grp g ON h.file_hash = g.group_hash)"""


def _with(ctes: str, body: str) -> str:
    return "WITH " + ctes.strip() + "\n" + body


GROUP_SELECT = ("SELECT group_hash, file_size_bytes, master_file_id, duplicate_count, "
                "total_size_bytes, space_saved_bytes FROM grp")

LISTING_COLS = "id, original_path, file_name, file_size_bytes, year, month, month_day, project_name"

MEASURES = ("count(*) AS file_count, CAST(COALESCE(sum(file_size_bytes), 0) AS BIGINT) AS total_size, "
            "CAST(sum(CASE WHEN is_duplicate THEN 1 ELSE 0 END) AS BIGINT) AS duplicate_count")


def _fmt2(x: str) -> str:
    return f"format('{{:.2f}}', CAST({x} AS DOUBLE))"


def format_bytes_sql(x: str) -> str:
    v = f"CAST({x} AS DOUBLE)"
    parts = [f"WHEN {v} = 0 THEN '0 B'"]
    scale = 1.0
    for unit in C.BYTE_UNITS:
        parts.append(f"WHEN {v} / {scale!r} < 1024.0 THEN {_fmt2(f'{v} / {scale!r}')} || ' {unit}'")
        scale *= 1024.0
    return "CASE " + " ".join(parts) + f" ELSE {_fmt2(f'{v} / {scale!r}')} || ' {C.BYTE_UNIT_LAST}' END"


def pct_sql(value: str, total: str) -> str:
    return (f"CASE WHEN {total} = 0 THEN 0.0 ELSE CAST({value} AS DOUBLE) / "
            f"CAST({total} AS DOUBLE) * 100.0 END")


def format_pct_sql(value: str, total: str) -> str:
    return f"CASE WHEN {total} = 0 THEN '0.00%' ELSE {_fmt2(pct_sql(value, total))} || '%' END"


def thousands_sql(x: str) -> str:
    return f"format('{{:,}}', CAST({x} AS BIGINT))"


ORACLES: dict[str, str] = {}

ORACLES["duplicate_groups"] = _with(catalog_ctes("content_fp"), GROUP_SELECT)
ORACLES["duplicate_groups_full"] = _with(catalog_ctes("content_fp_full"), GROUP_SELECT)
ORACLES["duplicate_groups_size_key"] = _with(catalog_ctes("content_fp").replace(
    "SELECT file_hash AS group_hash,",
    "SELECT CAST(file_size_bytes AS VARCHAR) || ':' || file_hash AS group_hash,").replace(
    "GROUP BY file_hash HAVING", "GROUP BY file_size_bytes, file_hash HAVING"), GROUP_SELECT)
ORACLES["catalog_listing"] = _with(FIXTURE_CTES, f"SELECT {LISTING_COLS} FROM files_v")
_sub_year, _sub_month = "2024", "march"
ORACLES["subfolder_scan"] = _with(
    FIXTURE_CTES, f"SELECT {LISTING_COLS} FROM files_v WHERE year = '{_sub_year}' AND month = '{_sub_month}'")
ORACLES["project_file_counts"] = _with(
    FIXTURE_CTES, "SELECT year, month, month_day, project_name, count(*) AS file_count "
                  "FROM files_v GROUP BY year, month, month_day, project_name")
ORACLES["size_candidates"] = _with(
    FIXTURE_CTES, "SELECT file_size_bytes, count(*) AS file_count FROM files_v "
                  "GROUP BY file_size_bytes HAVING count(*) >= 2")
ORACLES["size_candidate_files"] = _with(
    FIXTURE_CTES, "SELECT id, file_size_bytes, file_name FROM files_v WHERE file_size_bytes IN "
                  "(SELECT file_size_bytes FROM files_v GROUP BY file_size_bytes HAVING count(*) > 1)")
ORACLES["fingerprint_sampled"] = (
    "SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, "
    f"{sampled_fp_sql('encode(text)')} AS fingerprint FROM documents")
ORACLES["fingerprint_full"] = (
    "SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, "
    "md5(encode(text)) AS fingerprint FROM documents")
ORACLES["fingerprint_pages"] = (
    "SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS n_bytes, "
    f"{sampled_fp_sql('encode(html)')} AS fingerprint FROM pages")
ORACLES["duplicate_flags"] = _with(
    catalog_ctes(), "SELECT id, file_hash, is_duplicate, master_file_id FROM cat")
ORACLES["duplicate_groups_documents"] = """
WITH d AS (SELECT doc_id AS id, CAST(octet_length(encode(text)) AS BIGINT) AS file_size_bytes,
                  md5(encode(text)) AS file_hash FROM documents),
grp AS (
  SELECT file_hash AS group_hash, CAST(arg_min(file_size_bytes, id) AS BIGINT) AS file_size_bytes,
    min(id) AS master_file_id, CAST(count(*) - 1 AS BIGINT) AS duplicate_count,
    CAST(sum(file_size_bytes) AS BIGINT) AS total_size_bytes,
    CAST(sum(file_size_bytes) - arg_min(file_size_bytes, id) AS BIGINT) AS space_saved_bytes
  FROM d GROUP BY file_hash HAVING count(*) > 1)
""" + GROUP_SELECT
ORACLES["duplicate_groups_pages"] = f"""
WITH d AS (SELECT page_id AS id, CAST(octet_length(encode(html)) AS BIGINT) AS file_size_bytes,
                  {sampled_fp_sql('encode(html)')} AS fp
           FROM (SELECT page_id, html FROM pages
                 UNION ALL SELECT page_id + 10000000, html FROM pages WHERE page_id % 9 = 0)),
h AS (SELECT id, file_size_bytes, fp AS file_hash FROM d WHERE file_size_bytes IN
      (SELECT file_size_bytes FROM d GROUP BY file_size_bytes HAVING count(*) > 1)),
grp AS (
  SELECT file_hash AS group_hash, CAST(arg_min(file_size_bytes, id) AS BIGINT) AS file_size_bytes,
    min(id) AS master_file_id, CAST(count(*) - 1 AS BIGINT) AS duplicate_count,
    CAST(sum(file_size_bytes) AS BIGINT) AS total_size_bytes,
    CAST(sum(file_size_bytes) - arg_min(file_size_bytes, id) AS BIGINT) AS space_saved_bytes
  FROM h GROUP BY file_hash HAVING count(*) > 1)
""" + GROUP_SELECT

_SUMMARY = f""",
fs AS (
  SELECT count(DISTINCT project_name) AS total_projects, count(*) AS total_files,
    count(*) FILTER (WHERE is_duplicate) AS duplicate_files,
    CAST(COALESCE(sum(file_size_bytes), 0) AS BIGINT) AS total_size_bytes,
    COALESCE(avg(file_size_bytes), 0.0) AS average_file_size,
    max(scan_timestamp) AS last_scan_timestamp
  FROM cat),
gs AS (
  SELECT CAST(COALESCE(sum(space_saved_bytes), 0) AS BIGINT) AS space_saved_bytes,
    count(*) FILTER (WHERE duplicate_count > 0) AS duplicate_groups FROM grp),
summ AS (
  SELECT total_projects, total_files, total_files - duplicate_files AS unique_files, duplicate_files,
    {pct_sql('duplicate_files', 'total_files')} AS duplicate_percentage,
    total_size_bytes, space_saved_bytes,
    {pct_sql('space_saved_bytes', 'total_size_bytes')} AS space_saved_percentage,
    duplicate_groups, average_file_size, last_scan_timestamp
  FROM fs, gs)"""

ORACLES["report_summary"] = _with(
    catalog_ctes() + _SUMMARY,
    "SELECT * REPLACE (strftime(last_scan_timestamp, '%Y-%m-%d %H:%M:%S') AS last_scan_timestamp) FROM summ")

ORACLES["statistics_table"] = _with(catalog_ctes() + _SUMMARY, """
SELECT stat_name, stat_type, value_num, value_text FROM (
  SELECT 'total_files' AS stat_name, 'integer' AS stat_type, CAST(total_files AS DOUBLE) AS value_num, NULL AS value_text FROM summ
  UNION ALL SELECT 'total_size_bytes', 'integer', CAST(total_size_bytes AS DOUBLE), NULL FROM summ
  UNION ALL SELECT 'unique_files', 'integer', CAST(unique_files AS DOUBLE), NULL FROM summ
  UNION ALL SELECT 'duplicate_files', 'integer', CAST(duplicate_files AS DOUBLE), NULL FROM summ
  UNION ALL SELECT 'duplicate_groups', 'integer', CAST(duplicate_groups AS DOUBLE), NULL FROM summ
  UNION ALL SELECT 'space_saved_bytes', 'integer', CAST(space_saved_bytes AS DOUBLE), NULL FROM summ
  UNION ALL SELECT 'space_saved_percentage', 'float', space_saved_percentage, NULL FROM summ
  UNION ALL SELECT 'last_scan_timestamp', 'datetime', NULL,
    strftime(last_scan_timestamp, '%Y-%m-%dT%H:%M:%S') || '+00:00' FROM summ
  UNION ALL SELECT 'files_deduplicated', 'integer', 0.0, NULL
  UNION ALL SELECT 'symlinks_created', 'integer', 0.0, NULL
  UNION ALL SELECT 'files_consolidated', 'integer', 0.0, NULL)""")

ORACLES["breakdown_year"] = _with(
    catalog_ctes(), f"SELECT year, {MEASURES} FROM cat WHERE year IS NOT NULL GROUP BY year")
ORACLES["breakdown_month"] = _with(
    catalog_ctes(), f"SELECT year, month, {MEASURES} FROM cat "
                    "WHERE year IS NOT NULL AND month IS NOT NULL GROUP BY year, month")
ORACLES["status_breakdown"] = _with(
    catalog_ctes(), "SELECT deduplication_status, count(*) AS count FROM cat GROUP BY deduplication_status")
_SECTION = "SELECT '{}' AS section, {} AS year, {} AS month, {} AS project_name, {} AS deduplication_status, "
ORACLES["report_sections"] = _with(catalog_ctes(), " UNION ALL ".join([
    _SECTION.format("year", "year", "NULL", "NULL", "NULL") + f"{MEASURES} FROM cat WHERE year IS NOT NULL GROUP BY year",
    _SECTION.format("month", "year", "month", "NULL", "NULL")
    + f"{MEASURES} FROM cat WHERE year IS NOT NULL AND month IS NOT NULL GROUP BY year, month",
    _SECTION.format("project", "NULL", "NULL", "project_name", "NULL")
    + f"{MEASURES} FROM cat WHERE project_name IS NOT NULL GROUP BY project_name",
    _SECTION.format("status", "NULL", "NULL", "NULL", "deduplication_status")
    + f"{MEASURES} FROM cat GROUP BY deduplication_status"]))
ORACLES["breakdowns_ordered"] = _with(catalog_ctes(), """
SELECT 'year' AS section, row_number() OVER (ORDER BY year DESC) AS place, year AS label, count(*) AS file_count
FROM cat GROUP BY year
UNION ALL SELECT 'month', row_number() OVER (ORDER BY year DESC, month DESC), year || '/' || month, count(*)
FROM cat GROUP BY year, month
UNION ALL SELECT 'status', row_number() OVER (ORDER BY count(*) DESC, deduplication_status), deduplication_status, count(*)
FROM cat GROUP BY deduplication_status""")
ORACLES["pending_ordered"] = _with(catalog_ctes(), f"""
SELECT row_number() OVER (ORDER BY id) AS place, id AS file_id, original_path FROM cat
WHERE deduplication_status = '{C.STATUS_PENDING}'""")
for _key, _by in (("top_projects_count", "file_count"), ("top_projects_size", "total_size")):
    ORACLES[_key] = _with(
        catalog_ctes(), f"SELECT project_name, {MEASURES} FROM cat WHERE project_name IS NOT NULL "
                        f"GROUP BY project_name ORDER BY {_by} DESC, project_name ASC LIMIT {C.TOP_K_DEFAULT}")
ORACLES["capacity_need"] = _with(catalog_ctes(), f"""
SELECT count(*) AS pending_files, CAST(COALESCE(sum(file_size_bytes), 0) AS BIGINT) AS pending_bytes,
  CAST(10000000 AS BIGINT) AS capacity_bytes,
  10000000 >= COALESCE(sum(file_size_bytes), 0) AS sufficient
FROM cat WHERE deduplication_status = '{C.STATUS_PENDING}'""")
ORACLES["format_metrics"] = _with(catalog_ctes(), f"""
SELECT year, month,
  {thousands_sql('file_count')} AS files_text,
  {format_bytes_sql('total_size')} AS size_text,
  {format_bytes_sql('total_size * 1048576')} AS size_text_scaled,
  {format_pct_sql('duplicate_count', 'file_count')} AS dup_pct_text,
  {thousands_sql('total_size * 1000')} AS bytes_text
FROM (SELECT year, month, {MEASURES} FROM cat
      WHERE year IS NOT NULL AND month IS NOT NULL GROUP BY year, month)""")


# ---------------------------------------------------------------------------
# Incremental catalog (batch 1 scanned first, then batch 2)
# ---------------------------------------------------------------------------

RUN1, RUN2 = FX.BATCH_RUN_TS

BATCH_CTES = catalog_ctes() + """,
b1 AS (SELECT * EXCLUDE (content) FROM files_v WHERE scan_batch = 1),
b2 AS (SELECT * EXCLUDE (content) FROM files_v WHERE scan_batch = 2),
b1s AS (SELECT file_size_bytes AS s FROM b1 GROUP BY file_size_bytes HAVING count(*) > 1),
b1h AS (SELECT b1.*, CASE WHEN b1s.s IS NOT NULL THEN b1.content_fp END AS file_hash
        FROM b1 LEFT JOIN b1s ON b1.file_size_bytes = b1s.s),
b1g AS (SELECT file_hash AS gh, min(id) AS m FROM b1h WHERE file_hash IS NOT NULL
        GROUP BY file_hash HAVING count(*) > 1),
b1f AS (SELECT b1h.*, (b1g.m IS NOT NULL AND b1h.id <> b1g.m) AS is_dup
        FROM b1h LEFT JOIN b1g ON b1h.file_hash = b1g.gh),
b2s AS (SELECT file_size_bytes AS s FROM b2 GROUP BY file_size_bytes HAVING count(*) > 1),
b2c AS (SELECT * FROM b2 WHERE file_size_bytes IN (SELECT s FROM b2s))"""


def _groups_and_flags(src: str, id_col: str = "id") -> str:
    """CTEs ``g2`` (groups) and ``f2`` (flagged rows) over ``src(id, file_size_bytes, file_hash)``."""
    return f""",
g2 AS (
  SELECT file_hash AS group_hash, CAST(arg_min(file_size_bytes, {id_col}) AS BIGINT) AS file_size_bytes,
    min({id_col}) AS master_file_id, CAST(count(*) - 1 AS BIGINT) AS duplicate_count,
    CAST(sum(file_size_bytes) AS BIGINT) AS total_size_bytes,
    CAST(sum(file_size_bytes) - arg_min(file_size_bytes, {id_col}) AS BIGINT) AS space_saved_bytes
  FROM {src} WHERE file_hash IS NOT NULL GROUP BY file_hash HAVING count(*) > 1),
f2 AS (
  SELECT s.*, (g2.master_file_id IS NOT NULL AND s.{id_col} <> g2.master_file_id) AS is_duplicate,
    CASE WHEN g2.master_file_id IS NOT NULL AND s.{id_col} <> g2.master_file_id
         THEN g2.master_file_id END AS master_file_id
  FROM {src} s LEFT JOIN g2 ON s.file_hash = g2.group_hash)"""


ORACLES["incremental_new_files"] = _with(BATCH_CTES, "SELECT id, original_path FROM b2")
ORACLES["cross_batch_candidates"] = _with(BATCH_CTES + """,
n2 AS (SELECT file_size_bytes, file_name FROM b2
       UNION ALL SELECT file_size_bytes, upper(file_name) FROM b1, range(2) WHERE id % 5 = 0),
n2c AS (SELECT * FROM n2 WHERE file_size_bytes IN
        (SELECT file_size_bytes FROM n2 GROUP BY file_size_bytes HAVING count(*) > 1))""", """
SELECT o.id AS old_id, o.file_size_bytes, o.original_path AS old_path, o.file_hash AS old_hash,
       count(*) AS new_matches
FROM n2c n JOIN b1h o ON n.file_size_bytes = o.file_size_bytes AND lower(n.file_name) = lower(o.file_name)
GROUP BY o.id, o.file_size_bytes, o.original_path, o.file_hash""")
ORACLES["statistics_delta"] = _with(catalog_ctes(), f"""
SELECT 'files' AS kind, year, month, project_name, '{C.STATUS_PENDING}' AS deduplication_status,
  count(*) AS n_files, count(file_size_bytes) AS n_sized, CAST(sum(file_size_bytes) AS BIGINT) AS bytes,
  count(*) FILTER (WHERE is_duplicate) AS duplicates, CAST(0 AS BIGINT) AS n_groups, CAST(0 AS BIGINT) AS space_saved
FROM cat GROUP BY year, month, project_name
UNION ALL
SELECT 'groups', NULL, NULL, NULL, NULL, 0, 0, CAST(0 AS BIGINT), 0, count(*) FILTER (WHERE duplicate_count > 0),
  CAST(COALESCE(sum(space_saved_bytes), 0) AS BIGINT) FROM grp""")
ORACLES["partition_versions"] = _with(FIXTURE_CTES, """
SELECT year, CAST(CASE WHEN year = '2024' THEN 2 ELSE 1 END AS BIGINT) AS version, count(*) AS files
FROM files_v WHERE scan_batch = 1 OR year = '2024' GROUP BY year""")
ORACLES["assign_ids"] = _with(BATCH_CTES, """
SELECT original_path, (SELECT max(id) FROM b1) + row_number() OVER (ORDER BY original_path) AS id FROM b2""")
ORACLES["catalog_upsert"] = _with(BATCH_CTES + """,
ids AS (
  SELECT original_path, file_size_bytes, content_fp, scan_batch,
    CASE WHEN scan_batch = 1 THEN id ELSE (SELECT max(id) FROM b1) +
      row_number() OVER (PARTITION BY scan_batch ORDER BY original_path) END AS nid
  FROM files_v),
src AS (
  SELECT nid AS id, original_path, file_size_bytes,
    CASE WHEN file_size_bytes IN (SELECT file_size_bytes FROM shared) THEN content_fp END AS file_hash
  FROM ids)""" + _groups_and_flags("src"), f"""
SELECT id, original_path, file_size_bytes, file_hash, is_duplicate, master_file_id,
  '{RUN2}' AS scan_timestamp FROM f2""")
ORACLES["refresh_changed"] = _with(BATCH_CTES + """,
now_ AS (SELECT id, id % 13 = 0 AS changed, file_hash, content_fp,
           CASE WHEN id % 13 = 0 THEN 7 + id % 2 ELSE file_size_bytes END AS file_size_bytes FROM b1h),
src AS (SELECT id, CAST(file_size_bytes AS BIGINT) AS file_size_bytes,
          CASE WHEN NOT changed AND file_hash IS NOT NULL THEN file_hash
               WHEN file_size_bytes IN (SELECT file_size_bytes FROM now_ GROUP BY ALL HAVING count(*) > 1)
               THEN CASE WHEN changed THEN md5(CAST(id % 2 AS VARCHAR)) ELSE content_fp END END AS file_hash
        FROM now_)""" + _groups_and_flags("src"), GROUP_SELECT.replace("FROM grp", "FROM g2"))
ORACLES["group_upsert"] = _with(BATCH_CTES, f"""
SELECT grp.group_hash, grp.file_size_bytes, grp.master_file_id, grp.duplicate_count,
  grp.total_size_bytes, grp.space_saved_bytes,
  CASE WHEN grp.group_hash IN (SELECT gh FROM b1g) THEN '{RUN1}' ELSE '{RUN2}' END AS created_at
FROM grp""")
ORACLES["incremental_groups"] = ORACLES["duplicate_groups"]
ORACLES["incremental_batch_scope"] = _with(BATCH_CTES + """,
fin AS (
  SELECT o.id, o.file_size_bytes,
    CASE WHEN o.file_hash IS NOT NULL THEN o.file_hash
         WHEN EXISTS (SELECT 1 FROM b2c n WHERE n.file_size_bytes = o.file_size_bytes
                      AND lower(n.file_name) = lower(o.file_name)) THEN o.content_fp END AS file_hash
  FROM b1h o
  UNION ALL
  SELECT id, file_size_bytes,
    CASE WHEN file_size_bytes IN (SELECT s FROM b2s) THEN content_fp END AS file_hash
  FROM b2)""" + _groups_and_flags("fin"), "SELECT id, file_hash, is_duplicate, master_file_id FROM f2")
ORACLES["backfill_candidates"] = _with(BATCH_CTES, """
SELECT id, file_size_bytes FROM (
  SELECT id, file_size_bytes, file_hash FROM b1h
  UNION ALL SELECT id, file_size_bytes, NULL FROM b2)
WHERE file_hash IS NULL AND file_size_bytes IN (SELECT file_size_bytes FROM shared)""")
ORACLES["stat_upsert"] = _with(BATCH_CTES + _SUMMARY + f""",
cnt AS (SELECT count(*) AS d, count(*) FILTER (WHERE is_dup) AS s FROM b1f WHERE id % {FX.DONE_EVERY} = 0)""", """
SELECT stat_name, stat_type, value_num, value_text FROM (
  SELECT 'total_files' AS stat_name, 'integer' AS stat_type, CAST(total_files AS DOUBLE) AS value_num, NULL AS value_text FROM summ
  UNION ALL SELECT 'total_size_bytes', 'integer', CAST(total_size_bytes AS DOUBLE), NULL FROM summ
  UNION ALL SELECT 'unique_files', 'integer', CAST(unique_files AS DOUBLE), NULL FROM summ
  UNION ALL SELECT 'duplicate_files', 'integer', CAST(duplicate_files AS DOUBLE), NULL FROM summ
  UNION ALL SELECT 'duplicate_groups', 'integer', CAST(duplicate_groups AS DOUBLE), NULL FROM summ
  UNION ALL SELECT 'space_saved_bytes', 'integer', CAST(space_saved_bytes AS DOUBLE), NULL FROM summ
  UNION ALL SELECT 'space_saved_percentage', 'float', space_saved_percentage, NULL FROM summ
  UNION ALL SELECT 'last_scan_timestamp', 'datetime', NULL,
    strftime(last_scan_timestamp, '%Y-%m-%dT%H:%M:%S') || '+00:00' FROM summ
  UNION ALL SELECT 'files_deduplicated', 'integer', CAST(d AS DOUBLE), NULL FROM cnt
  UNION ALL SELECT 'symlinks_created', 'integer', CAST(s AS DOUBLE), NULL FROM cnt
  UNION ALL SELECT 'files_consolidated', 'integer', CAST(d - s AS DOUBLE), NULL FROM cnt)""")
ORACLES["path_insert_ignore"] = _with(BATCH_CTES, f"""
SELECT id AS file_id, 'original' AS path_type, original_path AS path, '{RUN1}' AS created_at FROM b1
UNION ALL
SELECT id, 'original', original_path, '{RUN2}' FROM b2""")


# ---------------------------------------------------------------------------
# Deduplication plan, store names, canonical store
# ---------------------------------------------------------------------------

EXT_RE = r"(?s)^\.*[^.].*?(\.[^.]*)$"
GEN_RE = r"^(.*)_([1-9][0-9]*)$"
PLAN_TS = "2025-03-15 00:00:00"
DONE_TS = "2025-03-01 00:00:00"
_SAN_FROM = C.SANITIZE_CHARS.replace("'", "''")
_SAN_TO = "_" * len(C.SANITIZE_CHARS)


def sanitize_ctes(src: str, name_col: str, out: str, prefix: str) -> str:
    """CTEs ``{prefix}1..3`` adding ``{out}`` = sanitized ``{name_col}`` to ``src``."""
    M = C.SANITIZED_NAME_MAX
    return f"""
{prefix}1 AS (SELECT *, translate({name_col}, '{_SAN_FROM}', '{_SAN_TO}') AS {prefix}_clean FROM {src}),
{prefix}2 AS (SELECT *, regexp_extract({prefix}_clean, '{EXT_RE}', 1) AS {prefix}_ext FROM {prefix}1),
{prefix}3 AS (SELECT *, CASE WHEN length({prefix}_clean) > {M} THEN
    left(left({prefix}_clean, length({prefix}_clean) - length({prefix}_ext)),
         CASE WHEN {M} - length({prefix}_ext) >= 0 THEN {M} - length({prefix}_ext)
              ELSE greatest(length({prefix}_clean) - length({prefix}_ext) + {M} - length({prefix}_ext), 0) END)
      || {prefix}_ext
    ELSE {prefix}_clean END AS {out} FROM {prefix}2)"""


def store_dir_sql(h: str) -> str:
    return (f"'{FX.FIXTURE_STORE}/{C.STORE_SUBDIR}/' || CASE WHEN {h} IS NULL OR {h} = '' THEN "
            f"'{C.NO_HASH_PREFIX1}/{C.NO_HASH_PREFIX2}' ELSE substr({h}, 1, 2) || '/' || substr({h}, 3, 2) END")


def store_base_sql(h: str, sname: str) -> str:
    return f"CASE WHEN {h} IS NULL OR {h} = '' THEN '{C.NO_HASH_PART}' ELSE {h} END || '_' || {sname}"


def counter_name_sql(base: str, counter: str) -> str:
    ext = f"regexp_extract({base}, '{EXT_RE}', 1)"
    return (f"CASE WHEN {counter} = 0 THEN {base} ELSE left({base}, length({base}) - length({ext})) "
            f"|| '_' || CAST({counter} AS VARCHAR) || {ext} END")


def counters_ctes(cands: str, taken: str, order: str) -> str:
    """``kc``: ``cands(id, dir, base, ...)`` with ``counter`` given the taken
    names ``taken(dir, name)`` (bulk first-fit, families without edges)."""
    return f""",
kr AS (SELECT *, row_number() OVER (PARTITION BY dir, base ORDER BY {order}) - 1 AS i FROM {cands}),
tk1 AS (SELECT DISTINCT dir, name, regexp_extract(name, '{EXT_RE}', 1) AS ext FROM {taken}),
tk2 AS (SELECT dir, name, ext, left(name, length(name) - length(ext)) AS stem FROM tk1),
tk AS (SELECT DISTINCT dir, base, t FROM (
  SELECT dir, name AS base, CAST(0 AS BIGINT) AS t FROM tk2
  UNION ALL
  SELECT dir, regexp_extract(stem, '{GEN_RE}', 1) || ext,
         CAST(regexp_extract(stem, '{GEN_RE}', 2) AS BIGINT)
  FROM tk2 WHERE regexp_extract(stem, '{GEN_RE}', 1) <> '')),
tkg AS (SELECT dir, base, t - (row_number() OVER (PARTITION BY dir, base ORDER BY t) - 1) AS g FROM tk),
kc AS (SELECT kr.*, kr.i + (SELECT count(*) FROM tkg WHERE tkg.dir = kr.dir AND tkg.base = kr.base
                            AND tkg.g <= kr.i) AS counter FROM kr)"""


def relpath_ctes(src: str, target: str, start: str, out: str) -> str:
    """``rp4``: ``src`` plus ``{out}`` = relpath(target, start)."""
    return f""",
rp1 AS (SELECT *, list_filter(string_split({start}, '/'), lambda x: x <> '') AS ra,
               list_filter(string_split({target}, '/'), lambda x: x <> '') AS rb FROM {src}),
rp2 AS (SELECT *, least(len(ra), len(rb)) AS rn FROM rp1),
rp3 AS (SELECT *, CASE WHEN rn = 0 THEN 0 ELSE coalesce(
          list_position(list_transform(range(1, rn + 1), lambda i: ra[i] = rb[i]), false) - 1, rn) END AS rk
        FROM rp2),
rp4 AS (SELECT * EXCLUDE (ra, rb, rn, rk, rj), CASE WHEN rj = '' THEN '.' ELSE rj END AS {out} FROM (
  SELECT *, array_to_string(list_concat(list_transform(range(len(ra) - rk), lambda x: '..'), rb[rk + 1:]), '/') AS rj
  FROM rp3))"""


def dotdots_sql(x: str) -> str:
    return f"CAST((length({x}) - length(replace({x}, '..', ''))) // 2 AS INTEGER)"


def plan_ctes(fresh: bool, name_hash: str = "file_hash", hard: bool = False) -> str:
    """The plan of the fixture state; ``hard``: of ``registry._hard_state``."""
    ex = "TRUE" if fresh else f"(c.id % {FX.MISSING_EVERY} <> 0)"
    unread, path, known, living = "FALSE", "c.original_path", "TRUE", "TRUE"
    if hard:
        unread = "(c.year = '2024' AND c.month = 'may')"
        ex = f"({ex} AND NOT {unread})"
        path = (f"CASE WHEN c.id % 3 = 0 THEN left(c.original_path, length(c.original_path) - length(c.file_name) - 1) "
                f"|| '{'/d' * C.MAX_LINK_DOTDOTS}/' || c.file_name ELSE c.original_path END")
        known = "NOT (c.id % 4 = 3 AND c.id IN (SELECT master_file_id FROM grp))"
        living = "file_id % 10 <> 0"
    status = f"'{C.STATUS_PENDING}'" if fresh else "c.deduplication_status"
    rec_filter = "FALSE" if fresh else f"id % {5 if hard else FX.CONSOLIDATED_EVERY} = 0 AND NOT is_duplicate"
    P_ = C.STATUS_PENDING
    return catalog_ctes() + f""",
s0 AS (SELECT c.* EXCLUDE (deduplication_status, original_path), {path} AS original_path,
         {status} AS deduplication_status, {ex} AS ex, {unread} AS unk FROM cat c WHERE {known}),""" + \
        sanitize_ctes("s0", "file_name", "sname", "sz") + f""",
ps AS (SELECT *, {store_dir_sql('file_hash')} AS sdir, {store_base_sql('file_hash', 'sname')} AS sbase,
             {store_dir_sql(name_hash)} AS ksdir, {store_base_sql(name_hash, 'sname')} AS ksbase FROM sz3),
rec AS (SELECT id AS file_id, sdir || '/' || sbase AS recorded FROM ps WHERE {rec_filter}),
f AS (SELECT ps.*, rec.recorded FROM ps LEFT JOIN rec ON ps.id = rec.file_id AND {living}),
p0 AS (SELECT * FROM f WHERE deduplication_status = '{P_}' AND NOT is_duplicate AND master_file_id IS NULL),
dups AS (SELECT f.*, g.master_file_id AS g_master FROM f JOIN grp g ON f.file_hash = g.group_hash
         WHERE f.is_duplicate AND coalesce(f.deduplication_status, '{P_}') = '{P_}' AND g.duplicate_count > 0),
mst AS (SELECT d.g_master, m.original_path AS m_path, m.ex AS m_ex, m.unk AS m_unk, m.recorded AS m_rec,
          m.ksdir AS m_sdir, m.ksbase AS m_sbase,
          (m.deduplication_status = '{P_}' AND NOT m.is_duplicate AND m.master_file_id IS NULL) AS m_in_p0
        FROM (SELECT DISTINCT g_master FROM dups) d LEFT JOIN f m ON m.id = d.g_master),
p1 AS (SELECT * FROM mst WHERE m_path IS NOT NULL AND m_rec IS NULL AND NOT m_in_p0),
keep AS (SELECT id, original_path, ksdir AS dir, ksbase AS base, 0 AS phase FROM p0 WHERE ex AND recorded IS NULL
         UNION ALL SELECT g_master, m_path, m_sdir, m_sbase, 1 FROM p1 WHERE m_ex),
taken AS (SELECT sdir AS dir, sbase AS name FROM ps WHERE {rec_filter})""" + \
        counters_ctes("keep", "taken", "phase, id") + f""",
kd AS (SELECT id, original_path, phase, dir || '/' || {counter_name_sql('base', 'counter')} AS dst FROM kc),
loc AS (SELECT mst.g_master, coalesce(mst.m_rec, kd.dst) AS m_loc, mst.m_path IS NULL AS orphan
        FROM mst LEFT JOIN kd ON kd.id = mst.g_master),
dd AS (SELECT dups.*, loc.m_loc, loc.orphan FROM dups JOIN loc ON dups.g_master = loc.g_master),
lk0 AS (SELECT *, regexp_extract(original_path, '(?s)^(.*)/[^/]*$', 1) AS parent FROM dd
        WHERE NOT orphan AND m_loc IS NOT NULL AND ex)""" + relpath_ctes("lk0", "m_loc", "parent", "link_target") + f""",
plan AS (
  SELECT id AS file_id, 'missing' AS action, original_path AS src, CAST(NULL AS VARCHAR) AS dst,
         CAST(NULL AS VARCHAR) AS link_target, 'file not found' AS reason, 0 AS phase FROM p0 WHERE NOT ex AND NOT unk
  UNION ALL SELECT id, 'unreadable', original_path, NULL, NULL, 'directory could not be listed', 0 FROM p0 WHERE unk
  UNION ALL SELECT g_master, 'unreadable', m_path, NULL, NULL, 'directory could not be listed', 1 FROM p1 WHERE m_unk
  UNION ALL SELECT id, 'unreadable', original_path, m_loc, NULL, 'directory could not be listed', 1
    FROM dd WHERE NOT orphan AND m_loc IS NOT NULL AND unk
  UNION ALL SELECT id, 'already_done', original_path, recorded, NULL, 'already consolidated', 0
    FROM p0 WHERE ex AND recorded IS NOT NULL
  UNION ALL SELECT id, 'keep', original_path, dst, NULL, NULL, phase FROM kd
  UNION ALL SELECT g_master, 'missing', m_path, NULL, NULL, 'master file not found', 1 FROM p1 WHERE NOT m_ex AND NOT m_unk
  UNION ALL SELECT id, 'orphan_group', original_path, NULL, NULL, 'master not in catalog', 1 FROM dd WHERE orphan
  UNION ALL SELECT id, 'no_master_copy', original_path, NULL, NULL, 'master has no stored copy', 1
    FROM dd WHERE NOT orphan AND m_loc IS NULL
  UNION ALL SELECT id, 'missing', original_path, m_loc, NULL, 'duplicate already missing', 1
    FROM dd WHERE NOT orphan AND m_loc IS NOT NULL AND NOT ex AND NOT unk
  UNION ALL SELECT id, CASE WHEN {dotdots_sql('link_target')} >= {C.MAX_LINK_DOTDOTS} THEN 'too_deep' ELSE 'link' END,
    original_path, m_loc, link_target,
    CASE WHEN {dotdots_sql('link_target')} >= {C.MAX_LINK_DOTDOTS} THEN 'relative path too deep' END, 1 FROM rp4),
perr AS (SELECT *, action IN ('missing', 'too_deep', 'orphan_group', 'no_master_copy', 'unreadable')
                   AND NOT (action = 'missing' AND reason = 'duplicate already missing') AS is_error FROM plan)"""


PLAN_STATE = plan_ctes(False)
PLAN_FRESH = plan_ctes(True)

ORACLES["pending_files"] = _with(catalog_ctes(), f"""
SELECT id, original_path, file_name, file_size_bytes, file_hash, is_duplicate, master_file_id,
  deduplication_status FROM cat WHERE deduplication_status = '{C.STATUS_PENDING}'""")
ORACLES["pending_unique"] = _with(catalog_ctes(), f"""
SELECT id, original_path, file_name, file_size_bytes, file_hash, deduplication_status FROM cat
WHERE deduplication_status = '{C.STATUS_PENDING}' AND NOT is_duplicate AND master_file_id IS NULL""")
ORACLES["missing_files"] = _with(catalog_ctes(), f"""
SELECT id, original_path, is_duplicate FROM cat
WHERE deduplication_status = '{C.STATUS_PENDING}' AND id % {FX.MISSING_EVERY} = 0""")
ORACLES["sanitize_names"] = "WITH pg AS (SELECT page_id, url, url || '_' || url || '_' || url AS long_name FROM pages)," + \
    sanitize_ctes("pg", "url", "sanitized", "sa") + "," + sanitize_ctes("sa3", "long_name", "sanitized_long", "sb") + f"""
SELECT page_id, sanitized,
  left(sanitized, length(sanitized) - length(regexp_extract(sanitized, '{EXT_RE}', 1))) AS stem,
  regexp_extract(sanitized, '{EXT_RE}', 1) AS ext, sanitized_long,
  CAST(length(sanitized_long) AS INTEGER) AS long_length FROM sb3"""
ORACLES["consolidated_paths"] = _with(PLAN_FRESH, "SELECT id, sdir AS dir, sbase AS base FROM ps")
ORACLES["collision_names"] = _with(plan_ctes(False).replace(
    "taken AS (SELECT sdir", "allc AS (SELECT id, sdir AS dir, sbase AS base FROM f),\ntaken AS (SELECT sdir").replace(
    "row_number() OVER (PARTITION BY dir, base ORDER BY phase, id) - 1 AS i FROM keep",
    "row_number() OVER (PARTITION BY dir, base ORDER BY id) - 1 AS i FROM allc"),
    f"SELECT id, counter, {counter_name_sql('base', 'counter')} AS name FROM kc")
_FIRST_FREE = counter_name_sql("c.base", "k")
ORACLES["collision_first_fit"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id AS id, '{FX.FIXTURE_STORE}/n' || CAST(doc_id % 37 AS VARCHAR) AS dir,
    CASE WHEN doc_id % 37 % 2 = 1 AND doc_id % 4 = 2 THEN 'clip_1.mp4'
         WHEN doc_id % 37 % 2 = 1 AND doc_id % 4 = 3 THEN 'clip_' || CAST(doc_id // 37 % 6 AS VARCHAR) || '.mp4'
         ELSE 'clip.mp4' END AS base FROM documents),
c AS (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY id) AS n FROM d),
walk AS (
  SELECT dir, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS counter,
    CAST(NULL AS VARCHAR) AS name,
    CASE WHEN bool_or(id % 111 < 37) THEN ['clip_2.mp4', 'clip_5.mp4', 'clip_2025010112304599999999999.mp4']
         ELSE CAST([] AS VARCHAR[]) END AS used
  FROM d GROUP BY dir
  UNION ALL
  SELECT dir, n, id, counter, name, list_append(used, name) FROM (
    SELECT *, {counter_name_sql('base', 'counter')} AS name FROM (
      SELECT w.dir, c.n, c.id, c.base, w.used, CAST(list_filter(range(0, len(w.used) + 1),
        lambda k: NOT list_contains(w.used, {_FIRST_FREE}))[1] AS BIGINT) AS counter
      FROM walk w JOIN c ON c.dir = w.dir AND c.n = w.n + 1)))
SELECT id, counter, name FROM walk WHERE n > 0"""
ORACLES["link_targets"] = _with(PLAN_FRESH + """,
lt0 AS (SELECT d.id, d.master_file_id, m.sdir || '/' || m.sbase AS master_dst,
          regexp_extract(d.original_path, '(?s)^(.*)/[^/]*$', 1) AS parent
        FROM ps d JOIN ps m ON d.master_file_id = m.id WHERE d.is_duplicate)""" +
    relpath_ctes("lt0", "master_dst", "parent", "link_target").replace("rp", "rq"),
    f"SELECT id, master_file_id, link_target, {dotdots_sql('link_target')} AS dotdots FROM rq4")
ORACLES["dedup_plan"] = _with(PLAN_STATE, "SELECT file_id, action, src, dst, link_target, reason, phase FROM plan")
ORACLES["plan_coverage"] = _with(PLAN_STATE, f"""
SELECT count(*) AS pending, count(*) FILTER (WHERE id NOT IN (SELECT file_id FROM plan)) AS uncovered
FROM cat WHERE deduplication_status = '{C.STATUS_PENDING}'""")
ORACLES["plan_outcome"] = _with(PLAN_STATE, """
SELECT count(*) FILTER (WHERE action = 'keep') AS files_consolidated,
  count(*) FILTER (WHERE action = 'link') AS symlinks_created,
  count(*) FILTER (WHERE action = 'keep' AND phase = 0) + count(*) FILTER (WHERE action = 'link') AS files_deduplicated,
  count(*) FILTER (WHERE is_error) AS errors FROM perr""")
ORACLES["plan_errors_top"] = _with(PLAN_STATE, f"""
SELECT * FROM (SELECT file_id, action, reason, src, CAST(NULL AS BIGINT) AS remaining FROM perr WHERE is_error
               ORDER BY phase, file_id LIMIT {C.ERRORS_SHOWN})
UNION ALL
SELECT NULL, NULL, NULL, NULL, CAST(greatest(count(*) - {C.ERRORS_SHOWN}, 0) AS BIGINT) FROM perr WHERE is_error""")
_DONE_IDS = ("(SELECT file_id FROM plan WHERE action IN ('keep', 'link') OR "
             "(action = 'missing' AND reason = 'duplicate already missing'))")
ORACLES["mark_processed"] = _with(PLAN_STATE, f"""
SELECT id,
  CASE WHEN id IN {_DONE_IDS} THEN '{C.STATUS_DONE}' ELSE deduplication_status END AS deduplication_status,
  CASE WHEN id IN {_DONE_IDS} THEN '{PLAN_TS}'
       WHEN id % {FX.DONE_EVERY} = 0 THEN '{DONE_TS}' END AS deduplication_timestamp
FROM cat""")
_STAMPED = f""",
pg AS (SELECT c.file_hash FROM perr p JOIN cat c ON p.file_id = c.id
       WHERE p.phase = 1 GROUP BY c.file_hash HAVING count(*) FILTER (WHERE p.is_error) = 0
       UNION SELECT group_hash FROM grp WHERE duplicate_count > 0
         AND group_hash NOT IN (SELECT file_hash FROM cat WHERE is_duplicate
                                AND coalesce(deduplication_status, '{C.STATUS_PENDING}') = '{C.STATUS_PENDING}')
         AND master_file_id NOT IN (SELECT file_id FROM perr WHERE is_error))"""
ORACLES["dedup_run"] = _with(PLAN_STATE, f"""
SELECT CASE WHEN id IN {_DONE_IDS} THEN '{C.STATUS_DONE}' ELSE deduplication_status END AS name,
  CAST(count(*) AS VARCHAR) AS value FROM cat GROUP BY 1
UNION ALL SELECT 'files_consolidated', CAST(count(*) FILTER (WHERE action = 'keep') AS VARCHAR) FROM perr
UNION ALL SELECT 'symlinks_created', CAST(count(*) FILTER (WHERE action = 'link') AS VARCHAR) FROM perr
UNION ALL SELECT 'files_deduplicated', CAST(count(*) FILTER (WHERE action = 'keep' AND phase = 0)
  + count(*) FILTER (WHERE action = 'link') AS VARCHAR) FROM perr""")
ORACLES["group_processed"] = _with(PLAN_STATE + _STAMPED, f"""
SELECT group_hash, CASE WHEN group_hash IN (SELECT file_hash FROM pg) THEN '{PLAN_TS}' END
  AS deduplicated_at FROM grp""")
ORACLES["legacy_group_skip"] = _with(PLAN_STATE + _STAMPED, """
SELECT group_hash, duplicate_count FROM grp
WHERE duplicate_count > 0 AND group_hash NOT IN (SELECT file_hash FROM pg)""")
ORACLES["idempotent_rerun"] = _with(PLAN_STATE, "SELECT action, reason, count(*) AS count FROM perr "
                                                "WHERE is_error GROUP BY action, reason")
ORACLES["fk_audit"] = _with(PLAN_STATE + """,
paths2 AS (SELECT id AS file_id FROM cat UNION ALL SELECT file_id FROM rec
           UNION ALL SELECT file_id FROM plan WHERE action IN ('keep', 'link'))""", """
SELECT (SELECT count(*) FROM paths2 WHERE file_id NOT IN (SELECT id FROM cat)) AS paths_without_file,
  (SELECT count(*) FROM cat WHERE master_file_id IS NOT NULL AND master_file_id NOT IN (SELECT id FROM cat))
    AS duplicates_without_master,
  (SELECT count(*) FROM grp WHERE master_file_id NOT IN (SELECT id FROM cat)) AS groups_without_master""")
ORACLES["fk_audit_dirty"] = _with(PLAN_STATE + """,
left_ AS (SELECT id, master_file_id FROM cat WHERE id % 4 <> 3),
paths2 AS (SELECT id AS file_id FROM cat UNION ALL SELECT file_id FROM rec)""", """
SELECT (SELECT count(*) FROM paths2 WHERE file_id NOT IN (SELECT id FROM left_)) AS paths_without_file,
  (SELECT count(*) FROM left_ WHERE master_file_id IS NOT NULL AND master_file_id NOT IN (SELECT id FROM left_))
    AS duplicates_without_master,
  (SELECT count(*) FROM grp WHERE master_file_id NOT IN (SELECT id FROM left_)) AS groups_without_master""")
ORACLES["dedup_plan_hard"] = _with(plan_ctes(False, hard=True),
                                   "SELECT file_id, action, src, dst, link_target, reason, phase FROM plan")
ORACLES["canonical_store"] = _with(PLAN_FRESH, """
SELECT p.dst AS canonical_path, p.file_id, string_split(p.dst, '/')[-3] AS h1,
  string_split(p.dst, '/')[-2] AS h2, c.file_size_bytes, c.content_fp_full AS content_md5
FROM plan p JOIN cat c ON p.file_id = c.id WHERE p.action IN ('keep', 'already_done')""")
ORACLES["store_lookup"] = _with(PLAN_FRESH, """
SELECT c.file_hash, p.dst AS canonical_path, p.file_id, c.file_size_bytes, c.content_fp_full AS content_md5
FROM plan p JOIN cat c ON p.file_id = c.id WHERE p.action IN ('keep', 'already_done') AND c.file_hash < '8'""")
ORACLES["alias_table"] = _with(PLAN_FRESH, """
SELECT src AS path, dst AS canonical_path, file_id, 'self' AS kind FROM plan WHERE action IN ('keep', 'already_done')
UNION ALL SELECT src, dst, file_id, 'link' FROM plan WHERE action = 'link'""")
ORACLES["rebuild_check"] = _with(PLAN_FRESH + """,
al AS (SELECT src AS path, dst AS canonical_path FROM plan WHERE action IN ('keep', 'already_done', 'link')),
stq AS (SELECT p.dst AS canonical_path, c.content_fp_full AS stored FROM plan p JOIN cat c ON p.file_id = c.id
        WHERE p.action IN ('keep', 'already_done')),
res AS (SELECT al.path, stq.stored, c.content_fp_full AS orig FROM al LEFT JOIN stq USING (canonical_path)
        LEFT JOIN cat c ON c.original_path = al.path)""", """
SELECT count(*) AS paths, count(*) FILTER (WHERE stored IS NOT NULL) AS resolved,
  count(*) FILTER (WHERE stored = orig) AS identical, count(*) FILTER (WHERE stored <> orig) AS mismatched FROM res""")


# ---------------------------------------------------------------------------
# Directory trees written from the documents
# ---------------------------------------------------------------------------

_REL = f"substr(original_path, {len(FX.FIXTURE_ROOT) + 2})"
ORACLES["media_listing"] = _with(FIXTURE_CTES, f"""
SELECT {_REL} AS rel_path, file_name, file_size_bytes, year, month, month_day, project_name FROM files_v""")
ORACLES["media_subfolder"] = _with(FIXTURE_CTES, f"""
SELECT {_REL} AS rel_path, file_name, file_size_bytes, year, month, month_day, project_name FROM files_v
WHERE year = '2024' AND month = 'march'""")
ORACLES["media_pruned_scan"] = _with(FIXTURE_CTES, f"""
SELECT {_REL} AS rel_path, file_name, file_size_bytes, year, month, month_day, project_name FROM files_v
WHERE year = '2024' AND month IN ('march', 'june')""")
ORACLES["media_scan_tree"] = _with(FIXTURE_CTES + """,
tv AS (SELECT row_number() OVER (ORDER BY original_path) AS id, file_size_bytes, content_fp FROM files_v),
th AS (SELECT id, file_size_bytes, CASE WHEN file_size_bytes IN
         (SELECT file_size_bytes FROM tv GROUP BY file_size_bytes HAVING count(*) > 1) THEN content_fp END AS file_hash
       FROM tv)""" + _groups_and_flags("th"), "SELECT * FROM g2")
ORACLES["media_sampled_hashes"] = _with(FIXTURE_CTES, f"""
SELECT {_REL} AS rel_path, file_size_bytes, content_fp AS file_hash, CAST(NULL AS VARCHAR) AS hash_error FROM files_v""")


# ---------------------------------------------------------------------------
# Markdown report after the plan is applied
# ---------------------------------------------------------------------------

def _t(x: str) -> str:
    return thousands_sql(x)


def _fb(x: str) -> str:
    return format_bytes_sql(x)


_NL = " || chr(10)"


def _report_table(section: int, src: str, title: str, header: tuple[str, str], order: str, cells: list[str]) -> str:
    body = " || ' | ' || ".join(cells)
    return f"""
  UNION ALL SELECT {section}, 0, '{title.rstrip(chr(10))}'{_NL} FROM (SELECT count(*) AS n FROM {src}) WHERE n > 0
  UNION ALL SELECT {section}, 1, '{header[0]}' FROM (SELECT count(*) AS n FROM {src}) WHERE n > 0
  UNION ALL SELECT {section}, 2, '{header[1]}' FROM (SELECT count(*) AS n FROM {src}) WHERE n > 0
  UNION ALL SELECT {section}, CAST(row_number() OVER (ORDER BY {order}) + 2 AS INTEGER), '| ' || {body} || ' |' FROM {src}
  UNION ALL SELECT {section}, {1 << 30}, '' FROM (SELECT count(*) AS n FROM {src}) WHERE n > 0"""


def _report_sql() -> str:
    from copyledger.plans import report as RP

    cells = lambda *k: list(k) + [_t("file_count"), _fb("total_size"), _t("duplicate_count")]
    pct = "format('{:.2f}', space_saved_percentage) || '%'"
    ctes = PLAN_STATE + _SUMMARY + f""",
cnt AS (SELECT count(*) FILTER (WHERE action = 'keep') AS files_consolidated,
          count(*) FILTER (WHERE action = 'link') AS symlinks_created,
          count(*) FILTER (WHERE action = 'keep' AND phase = 0) + count(*) FILTER (WHERE action = 'link')
            AS files_deduplicated FROM plan),
one AS (SELECT * FROM summ, cnt),
fil2 AS (SELECT c.*, CASE WHEN id IN {_DONE_IDS} THEN '{C.STATUS_DONE}' ELSE deduplication_status END AS st2
         FROM cat c),
yb AS (SELECT year, {MEASURES} FROM fil2 WHERE year IS NOT NULL GROUP BY year),
mb AS (SELECT year, month, {MEASURES} FROM fil2 WHERE year IS NOT NULL AND month IS NOT NULL GROUP BY year, month),
pb AS (SELECT project_name, {MEASURES} FROM fil2 WHERE project_name IS NOT NULL GROUP BY project_name),
tc AS (SELECT * FROM pb ORDER BY file_count DESC, project_name LIMIT 10),
ts AS (SELECT * FROM pb ORDER BY total_size DESC, project_name LIMIT 10),
sb AS (SELECT coalesce(st2, 'None') AS deduplication_status, count(*) AS count FROM fil2 GROUP BY st2)"""
    dd = "FROM one WHERE files_deduplicated > 0"
    lines = f"""
SELECT section, ord, line FROM (
  SELECT 0 AS section, 0 AS ord, '{RP.TITLE.rstrip(chr(10))}'{_NL} AS line
  UNION ALL SELECT 0, 1, '*Generated: {PLAN_TS}*'{_NL}
  UNION ALL SELECT 0, 2, '{RP.RULE.rstrip(chr(10))}'{_NL}
  UNION ALL SELECT 1, 0, '{RP.SUMMARY_TITLE.rstrip(chr(10))}'{_NL}
  UNION ALL SELECT 1, 1, '- **Total Projects Scanned**: ' || {_t('total_projects')} FROM one
  UNION ALL SELECT 1, 2, '- **Total Videos Cataloged**: ' || {_t('total_files')} FROM one
  UNION ALL SELECT 1, 3, '- **Unique Videos**: ' || {_t('unique_files')} || ' (' || {format_pct_sql('unique_files', 'total_files')} || ')' FROM one
  UNION ALL SELECT 1, 4, '- **Duplicate Videos**: ' || {_t('duplicate_files')} || ' (' || {format_pct_sql('duplicate_files', 'total_files')} || ')' FROM one
  UNION ALL SELECT 1, 5, '- **Total Storage**: ' || {_fb('total_size_bytes')} FROM one
  UNION ALL SELECT 1, 6, '- **Space Saved (Deduplication)**: ' || {_fb('space_saved_bytes')} || ' (' || {pct} || ')' FROM one
  UNION ALL SELECT 1, 7, '- **Duplicate Groups**: ' || {_t('duplicate_groups')} FROM one
  UNION ALL SELECT 1, 8, '- **Average File Size**: ' || {_fb('average_file_size')} FROM one
  UNION ALL SELECT 1, 9, '- **Files Consolidated**: ' || {_t('files_consolidated')} {dd}
  UNION ALL SELECT 1, 10, '- **Symlinks Created**: ' || {_t('symlinks_created')} {dd}
  UNION ALL SELECT 1, 11, '- **Files Deduplicated**: ' || {_t('files_deduplicated')} {dd}
  UNION ALL SELECT 1, 12, ''
  UNION ALL SELECT 2, 0, '{RP.DETAIL_TITLE.rstrip(chr(10))}'{_NL}
  UNION ALL SELECT 2, 1, '{RP.OVERVIEW_TITLE.rstrip(chr(10))}'{_NL}
  UNION ALL SELECT 2, 2, '{RP.METRIC_HEADER[0]}'
  UNION ALL SELECT 2, 3, '{RP.METRIC_HEADER[1]}'
  UNION ALL SELECT 2, 4, '| Total Videos | ' || {_t('total_files')} || ' |' FROM one
  UNION ALL SELECT 2, 5, '| Unique Videos | ' || {_t('unique_files')} || ' (' || {format_pct_sql('unique_files', 'total_files')} || ') |' FROM one
  UNION ALL SELECT 2, 6, '| Duplicate Videos | ' || {_t('duplicate_files')} || ' (' || {format_pct_sql('duplicate_files', 'total_files')} || ') |' FROM one
  UNION ALL SELECT 2, 7, '| Total Storage Size | ' || {_fb('total_size_bytes')} || ' |' FROM one
  UNION ALL SELECT 2, 8, '| Average File Size | ' || {_fb('average_file_size')} || ' |'{_NL} FROM one
  UNION ALL SELECT 2, 9, '{RP.DEDUP_TITLE.rstrip(chr(10))}'{_NL}
  UNION ALL SELECT 2, 10, '{RP.METRIC_HEADER[0]}'
  UNION ALL SELECT 2, 11, '{RP.METRIC_HEADER[1]}'
  UNION ALL SELECT 2, 12, '| Duplicate Groups | ' || {_t('duplicate_groups')} || ' |' FROM one
  UNION ALL SELECT 2, 13, '| Space Saved | ' || {_fb('space_saved_bytes')} || ' |' FROM one
  UNION ALL SELECT 2, 14, '| Space Saved Percentage | ' || {pct} || ' |' FROM one
  UNION ALL SELECT 2, 15, '| Files Consolidated | ' || {_t('files_consolidated')} || ' |' {dd}
  UNION ALL SELECT 2, 16, '| Symlinks Created | ' || {_t('symlinks_created')} || ' |' {dd}
  UNION ALL SELECT 2, 17, '| Files Deduplicated | ' || {_t('files_deduplicated')} || ' |' {dd}
  UNION ALL SELECT 2, 18, ''""" + \
        _report_table(3, "yb", RP.YEAR_TITLE, RP.YEAR_HEADER, "year DESC", cells("year")) + \
        _report_table(4, "mb", RP.MONTH_TITLE, RP.MONTH_HEADER, "year DESC, month DESC", cells("year", "month")) + \
        _report_table(5, "tc", RP.TOP_COUNT_TITLE, RP.PROJECT_HEADER, "file_count DESC, project_name",
                      cells("project_name")) + \
        _report_table(6, "ts", RP.TOP_SIZE_TITLE, RP.PROJECT_HEADER, "total_size DESC, project_name",
                      cells("project_name")) + \
        _report_table(7, "sb", RP.STATUS_TITLE, RP.STATUS_HEADER, "count DESC, deduplication_status",
                      ["deduplication_status", _t("count")]) + ")"
    return _with(ctes, lines)


ORACLES["markdown_report"] = _report_sql()
ORACLES["report_file"] = ("SELECT string_agg(line || chr(10), '' ORDER BY section, ord) AS report FROM ("
                          + _report_sql() + ")")

ORACLES["stream_ingest"] = ORACLES["duplicate_groups"]
ORACLES["stream_ingest_listing"] = _with(catalog_ctes(), """
SELECT group_hash, duplicate_count, total_size_bytes FROM grp""")
ORACLES["stream_tree"] = _with(catalog_ctes(), f"SELECT {_REL} AS rel_path, file_size_bytes, file_hash FROM cat")
ORACLES["listing_times"] = _with(FIXTURE_CTES, """
SELECT id, original_path,
  strftime(TIMESTAMP '2023-01-01 00:00:00' + to_seconds(id * 3600), '%Y-%m-%d %H:%M:%S') AS created_at FROM files_v""")
ORACLES["scan_errors"] = _with(FIXTURE_CTES, """
SELECT original_path AS path, 'PermissionError: not readable' AS error FROM fl WHERE id % 41 = 0""")
ORACLES["group_members"] = _with(catalog_ctes(), """
SELECT g.group_hash, h.id, h.id = g.master_file_id AS is_master FROM hashed h JOIN grp g ON h.file_hash = g.group_hash""")
ORACLES["verify_full_groups"] = _with(catalog_ctes() + """,
mem AS (SELECT h.id FROM hashed h JOIN grp g ON h.file_hash = g.group_hash),
ref AS (SELECT id, file_size_bytes, CASE WHEN id IN (SELECT id FROM mem) THEN content_fp_full ELSE file_hash END
          AS file_hash FROM hashed)""" + _groups_and_flags("ref"), "SELECT * FROM g2")
ORACLES["snapshot_roundtrip"] = _with(catalog_ctes(), """
SELECT id, original_path, file_hash, is_duplicate, master_file_id, deduplication_status FROM cat
WHERE year = '2024' AND month = 'march'""")

ORACLES["incremental_paths"] = ORACLES["path_insert_ignore"]
ORACLES["incremental_statistics"] = ORACLES["statistics_table"]
ORACLES["media_listing_distributed"] = ORACLES["media_listing"]
ORACLES["new_paths_bucketed"] = ORACLES["incremental_new_files"]
ORACLES["media_listing_frontier"] = ORACLES["media_listing"]

ORACLES["dedup_plan_hash_all"] = _with(plan_ctes(False, "coalesce(file_hash, content_fp)"),
                                       "SELECT file_id, action, src, dst, link_target, reason, phase FROM plan")
