"""Position of a row within its key, in a given order, without a window
over raw rows.

A window ``row_number() over (partition by key order by ...)`` puts each key
in one task; a key holding a third of all rows would make that task a third
of the job.  Here rows are range-partitioned on (key, order), so a hot key
spans many partitions; each row is tagged with its partition-local position
(``monotonically_increasing_id``, frozen by staging) and the per (key,
partition) counts -- at most keys x partitions small rows -- give the
offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from copyledger.sources.snapshots import stage

_LOW_BITS = 33


def rank_within(df: DataFrame, key_cols: list[str], order_cols: list[str],
                out_col: str = "rank0") -> DataFrame:
    """0-based position of each row within ``key_cols`` in ``order_cols`` order.

    The same path at every size; AQE sizes the ranges."""
    tagged = (df.repartitionByRange(*key_cols, *order_cols)
              .sortWithinPartitions(*key_cols, *order_cols)
              .withColumn("_mid", F.monotonically_increasing_id()))
    tagged = stage(tagged, "rank").withColumn("_part", F.shiftright("_mid", _LOW_BITS))
    cells = tagged.groupBy(*key_cols, "_part").agg(
        F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*key_cols).orderBy("_part") \
        .rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    out = tagged.join(cells.drop("_n"), [*key_cols, "_part"])
    return (out.withColumn(out_col, (F.col("_offset") + F.col("_mid") - F.col("_first")).cast("long"))
            .drop("_mid", "_part", "_first", "_offset"))
