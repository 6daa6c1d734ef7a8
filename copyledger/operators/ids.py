"""Dense, ordered ids for new catalog rows without a one-partition window.

Rows are range-partitioned and sorted on the order key, tagged with
``monotonically_increasing_id`` (partition index in the high bits, position
in the low bits) and staged to the shared folder so the tags are fixed.
Per-partition counts (one row per partition, so a bounded broadcast) give
each partition its offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from copyledger.sources.snapshots import stage

_LOW_BITS = 33


def assign_ids(rows: DataFrame, order_cols: list[str], base_id: int = 0,
               id_col: str = "id") -> DataFrame:
    """``id_col`` = base_id + 1, 2, ... in ``order_cols`` order (ties broken by
    the key itself, so the key should be unique)."""
    tagged = (rows.repartitionByRange(*order_cols)
              .sortWithinPartitions(*order_cols)
              .withColumn("_mid", F.monotonically_increasing_id()))
    tagged = stage(tagged, "ids")
    tagged = (tagged.withColumn("_part", F.shiftright("_mid", _LOW_BITS))
              .withColumn("_local", F.col("_mid").bitwiseAND((1 << _LOW_BITS) - 1)))
    counts = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    # ``offsets`` has one row per range partition: bounded by their number.
    out = tagged.join(F.broadcast(offsets), "_part")
    return (out.withColumn(id_col, (F.lit(base_id) + F.col("_offset") + F.col("_local") + 1).cast("long"))
            .drop("_mid", "_part", "_local", "_offset"))


def max_id(files: DataFrame, id_col: str = "id") -> int:
    """Largest id in use (0 for an empty catalog); a one-row aggregate."""
    value = files.agg(F.max(id_col)).first()[0]
    return int(value) if value is not None else 0
