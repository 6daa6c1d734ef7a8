"""Streaming catalog ingest: listing files arrive in a folder; each
micro-batch is one incremental scan committed as the next catalog version.

``readStream`` over the listing folder (parquet, fixed schema), or straight
over a directory tree (``run_ingest_tree``), feeds ``foreachBatch``.  The commit marker of a version names the stream (its
checkpoint) and the micro-batch, so a replayed batch finds itself committed
and does nothing, while a stream that starts on a catalog with other versions,
or with a new checkpoint, goes on after them; a batch that failed before its
marker is simply rewritten -- exactly-once catalog updates.  Rows may carry an
``id``; rows without one get the next ids in path order.  The state is the
catalog itself, so no watermark is needed: every path is seen once and groups
are recomputed per batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from copyledger import schemas
from copyledger.operators.ids import assign_ids, max_id
from copyledger.operators.listing import catalog_rows
from copyledger.plans import incremental as INC
from copyledger.sources import media_files as MF
from copyledger.sources import snapshots as SNAP

BATCH_BYTES = 1 << 30      # of listing files in a micro-batch
LISTING_STREAM = T.StructType(schemas.LISTING.fields + [T.StructField("id", T.LongType(), True)])


def batch_run_ts(base_ts: str, batch_id: int) -> str:
    """Run time of a micro-batch: ``base_ts`` plus one day per batch."""
    import datetime as dt

    base = dt.datetime.fromisoformat(base_ts)
    return (base + dt.timedelta(days=batch_id)).strftime("%Y-%m-%d %H:%M:%S")


def last_batch(spark: SparkSession, catalog_root: str, stream: str) -> int:
    """The newest micro-batch of ``stream`` in the catalog, or -1."""
    return SNAP.manifest(spark, catalog_root)["streams"].get(stream, -1)


def numbered(rows: DataFrame, prior: DataFrame, catalog_root: str) -> DataFrame:
    """Rows with a caller's id keep it; the others get ids above all of these
    and the catalog's, new paths first counted in path order."""
    given = rows.filter(F.col("id").isNotNull())
    tables = SNAP.manifest(rows.sparkSession, catalog_root)["tables"]
    blank = INC.new_to_catalog(rows.filter(F.col("id").isNull()).drop("id"), prior, catalog_root, tables)
    if blank.isEmpty():
        return given
    base = max(max_id(prior), max_id(given))
    return given.unionByName(assign_ids(blank, ["original_path"], base_id=base).select(*rows.columns))


def ingest_batch(batch: DataFrame, batch_id: int, catalog_root: str, root: str, hasher,
                 base_ts: str, scope: str = "catalog", stream: str = "stream") -> None:
    spark = batch.sparkSession
    if batch_id <= last_batch(spark, catalog_root, stream):
        return
    if "id" not in batch.columns:
        batch = batch.withColumn("id", F.lit(None).cast("long"))
    rows = SNAP.stage(catalog_rows(batch, root, keep=("id",)), "micro-batch")
    rows = numbered(rows, SNAP.read_table(spark, catalog_root, "files"), catalog_root)
    if rows.isEmpty():      # nothing new: no version
        return
    INC.commit_scan(catalog_root, rows, batch_run_ts(base_ts, batch_id), hasher, scope=scope,
                    source=f"{stream}#{batch_id}")


def run_ingest(spark: SparkSession, listing_dir: str, catalog_root: str, checkpoint: str, root: str,
               hasher, base_ts: str, scope: str = "catalog", files_per_batch: int | None = None) -> None:
    """Process every listing file now in ``listing_dir`` (availableNow).  A
    micro-batch takes files of ``BATCH_BYTES`` in all, or ``files_per_batch``
    files: each commits a version of the catalog, so their number should follow
    the bytes that arrived, not the files they came in."""
    limit = ("maxBytesPerTrigger", BATCH_BYTES) if files_per_batch is None else ("maxFilesPerTrigger", files_per_batch)
    stream = spark.readStream.schema(LISTING_STREAM).option(*limit).parquet(listing_dir)
    _ingest(stream, catalog_root, checkpoint, root, hasher, base_ts, scope)


def run_ingest_tree(spark: SparkSession, root: str, catalog_root: str, checkpoint: str, hasher, base_ts: str,
                    scope: str = "catalog", **options) -> None:
    """Process what the tree at ``root`` holds now and the catalog does not
    (availableNow).  The stream lists what changed since its last offset; paths
    that come again are known to the catalog and add nothing."""
    _ingest(MF.stream_tree(spark, root, **options), catalog_root, checkpoint, root, hasher, base_ts, scope)


def _ingest(stream: DataFrame, catalog_root: str, checkpoint: str, root: str, hasher, base_ts: str,
            scope: str) -> None:
    query = (stream.writeStream
             .foreachBatch(lambda df, bid: ingest_batch(df, bid, catalog_root, root, hasher, base_ts, scope,
                                                       stream=checkpoint))
             .option("checkpointLocation", checkpoint)
             .trigger(availableNow=True)
             .start())
    query.awaitTermination()
