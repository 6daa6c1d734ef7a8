"""A file listing derived from the ``documents`` table.

One document is one file: its text (as UTF-8 bytes) is the file content and
its id, language and source place it in a ``root/year/month/month_day/
project/lang/name`` tree.  The listing has the same shape as the one the
directory source yields, plus the document id, the scan batch and
fingerprints computed in the scan stage, so content bytes never cross a
shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from copyledger.functions import fingerprint as fp
from copyledger.functions.formatting import utc_ts

# ---------------------------------------------------------------------------
# FIXED VALUES of the fixture layout (see FIXTURES.md section 2)
# ---------------------------------------------------------------------------
FIXTURE_ROOT = "/vol/root"
FIXTURE_STORE = "/vol/store"
MONTH_NAMES = ("january", "february", "march", "april", "may", "june", "july",
               "august", "september", "october", "november", "december")
FIXTURE_EXTS = ("mp4", "MOV", "mkv", "txt", "mpg", "M4V", "jpg", "ts")
FIRST_YEAR = 2023
HIDDEN_PROJECT_EVERY = 97
LINK_EVERY = 53
NAMES_PER_PROJECT = 25
PATHS_REPEAT = 25_200      # ids this far apart share the levels above: a level of their own follows
# Derived state variants used by the plan fixtures.
DONE_EVERY = 11            # deduplication_status = 'deduplicated'
CONSOLIDATED_EVERY = 22    # a consolidated path is already recorded
MISSING_EVERY = 31         # the file no longer exists
BATCH1_BELOW = 7           # k % 10 < 7 -> scan batch 1, else batch 2
# Run timestamps of the two scan batches (UTC).
BATCH_RUN_TS = ("2025-01-01 00:00:00", "2025-02-01 00:00:00")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _lpad2(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def fixture_path(root: str = FIXTURE_ROOT) -> Column:
    """``root/year/month/month_day/project/lang/name`` of a document."""
    k = F.col("doc_id")
    month_idx = (F.floor(k / 3) % 12 + 1).cast("int")
    year = (F.lit(FIRST_YEAR) + k % 3).cast("string")
    month = F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), month_idx)
    month_day = F.concat(_lpad2(month_idx), F.lit("_"), _lpad2(1 + F.floor(k / 36) % 28))
    project = F.when(k % HIDDEN_PROJECT_EVERY == 0, F.concat(F.lit("."), F.col("source"))) \
        .otherwise(F.col("source"))
    ext = F.element_at(F.array(*[F.lit(e) for e in FIXTURE_EXTS]), (k % 8 + 1).cast("int"))
    name = F.concat(F.lit("clip_"), (k % NAMES_PER_PROJECT).cast("string"), F.lit("."), ext)
    block = F.when(k >= PATHS_REPEAT, F.concat(F.lit("b"), F.floor(k / PATHS_REPEAT).cast("string")))
    return F.concat_ws("/", F.lit(root), year, month, month_day, project, F.col("lang"), block, name)


def fixture_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing rows ``path, size, mtime, is_link, error`` plus ``id, lang,
    scan_batch, content_fp, content_fp_full``."""
    docs = documents(spark, sf_dir)
    k = F.col("doc_id")
    content = fp.as_bytes("text")
    cols = [
        fixture_path().alias("path"),
        fp.byte_length(content).alias("size"),
        F.expr("timestampadd(SECOND, doc_id * 3600, timestamp_ntz'2023-01-01 00:00:00')").alias("mtime"),
        (k % LINK_EVERY == 0).alias("is_link"),
        F.lit(None).cast("string").alias("error"),
        k.alias("id"),
        F.col("lang"),
        F.when(k % 10 < BATCH1_BELOW, F.lit(1)).otherwise(F.lit(2)).alias("scan_batch"),
        fp.sampled_fingerprint(content).alias("content_fp"),
        fp.full_fingerprint(content).alias("content_fp_full"),
    ]
    return docs.select(*cols)


def batch_run_ts(batch_col: Column) -> Column:
    return F.when(batch_col == 1, utc_ts(BATCH_RUN_TS[0])) \
        .otherwise(utc_ts(BATCH_RUN_TS[1]))
