"""Connected components by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyledger.llm.common import stage


def components(edges: DataFrame, kind: str = "components") -> DataFrame:
    """``edges(a, b)`` (long) -> ``v, label``: the smallest vertex reachable.

    Every round takes the smallest label among the neighbours, then follows
    the label's own label.  A round ends in staged tables, so lineage stays
    short and AQE can split a label that many vertices share.  It ends when a
    round changes nothing; only a counter reaches the driver.
    """
    both = stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                 .where("a != b").distinct(), f"{kind}-edges")
    labels = stage(both.groupBy(F.col("a").alias("v"))
                   .agg(F.least(F.first("a"), F.min("b")).alias("label")), f"{kind}-start")
    while True:
        near = (both.join(labels.select(F.col("v").alias("b"), "label"), "b")
                .groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near")))
        hooked = stage(labels.join(near, "v").select(
            "v", F.col("label").alias("old"), F.least("label", "near").alias("label")), f"{kind}-hook")
        jump = hooked.select(F.col("v").alias("label"), F.col("label").alias("next"))
        labels = stage(hooked.join(jump, "label")
                       .select("v", "old", F.col("next").alias("label")), f"{kind}-jump")
        changed = labels.where("label != old").count()
        labels = labels.select("v", "label")
        if not changed:
            return labels
