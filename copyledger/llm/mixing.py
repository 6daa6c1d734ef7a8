"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a word budget; a document's exponential key ``-ln(u) / w``
(``u`` from a digest of the row, ``w`` its quality weight) orders it within
its source.  Complete epochs of the source come first; the rest of the budget
takes the documents whose prefix sum of sizes stays nearest to it.

Prefix sums never put a source into one task: keys are folded to a 20-bit
bucket in key order, split into two levels of 1024.  Level sums per
(source, bucket) decide whole buckets; only the bucket that the budget cuts
goes on to the next level, and the last window runs over one of 2**20 cells.

Defined results: a null text has size 0 and takes 0; a null source is a
source of its own, after all others; repeated rows are separate documents
(equal rows share a key and are interchangeable); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copyledger.llm.common import row_key, stage
from copyledger.operators.ranking import rank_within

WORD = r"[^\x20\x09-\x0D]+"
LEVEL = 1024


def quality_weight(text: Column, size: Column) -> Column:
    """Weight in (0, 1]: highest for texts of about six characters a word."""
    per_word = F.length(text) / F.greatest(size, F.lit(1))
    return 1 / (1 + F.abs(per_word - 6) / 6)


def uniform(seed: int, doc_id: Column, text: Column) -> Column:
    """A reproducible number in (0, 1) for each row."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string"), text))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def source_targets(sources: DataFrame, share: float = 1.5, cap: float = 2.0,
                   weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """``sources(skey, source, source_size)`` plus ``target``.

    Weights repeat over the sources in code point order, null last.  The
    budget ``share * all sizes`` is dealt by weight; what exceeds
    ``cap * source_size`` is dealt again to the others until none exceeds it:
    the level that fills the sources is the largest one seen when they are
    capped one after the other in order of ``cap * size / weight``.
    One row per source: these windows see names and sums, never documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.row_number().over(by_name) - 1) % len(weights) + 1)
    ranked = sources.withColumn("w", w).withColumn("most", F.col("source_size") * cap)
    by_fill = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * share
    level = (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    leveled = ranked.withColumn("level", level)
    top = F.max("level").over(Window.partitionBy())
    return (leveled.withColumn("target", F.least(F.col("most"), top * F.col("w")))
            .select("skey", "source_size", "target"))


def mix_sources(docs: DataFrame, share: float = 1.5, cap: float = 2.0,
                weights: tuple[int, ...] = (5, 2, 1), seed: int = 7,
                weight: Column | None = None) -> DataFrame:
    """One row per document: doc_id, key (``row_key``), source, size, source_size,
    target, copies (how often the mix takes it) and taken (words it contributes)."""
    text = F.col("text")
    sized = docs.select("doc_id", "source", "text", row_key().alias("key"), F.coalesce(
        F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long")).alias("size"),
        *([weight.alias("w")] if weight is not None else []))
    if weight is None:
        sized = sized.withColumn("w", quality_weight(F.coalesce(text, F.lit("")), F.col("size")))
    key = -F.log(uniform(seed, F.col("doc_id"), text)) / F.col("w")
    bucket = F.least(F.floor((1 - F.exp(-F.col("k"))) * (LEVEL * LEVEL)), F.lit(LEVEL * LEVEL - 1))
    rows = (sized.withColumn("k", key).withColumn("b", bucket.cast("int"))
            .select("doc_id", "key", "source", "size", "k",
                    F.when(F.col("source").isNull(), F.lit("n"))
                    .otherwise(F.concat(F.lit("s"), F.col("source"))).alias("skey"),
                    F.floor(F.col("b") / LEVEL).cast("int").alias("b1"),
                    (F.col("b") % LEVEL).alias("b2")))
    rows = stage(rows, "mix-rows")

    cells = rows.groupBy("skey", "b1").agg(F.sum("size").alias("cell"), F.first("source").alias("source"))
    sources = cells.groupBy("skey").agg(F.first("source").alias("source"),
                                        F.sum("cell").alias("source_size"))
    budget = (source_targets(sources, share, cap, weights)
              .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(
                  F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
              .withColumn("part", F.col("target") - F.col("epochs") * F.col("source_size")))
    so_far = Window.partitionBy("skey").orderBy("b1").rowsBetween(Window.unboundedPreceding, -1)
    cells = (cells.withColumn("start", F.coalesce(F.sum("cell").over(so_far), F.lit(0)))
             .drop("source").join(budget, "skey"))
    state = (F.when(F.col("start") + F.col("cell") <= F.col("part"), F.lit(1))
             .when(F.col("start") > F.col("part"), F.lit(0)).otherwise(F.lit(2)))
    placed = stage(rows.join(cells.withColumn("state", state), ["skey", "b1"]), "mix-placed")

    cut = placed.where("state = 2")
    fine = cut.groupBy("skey", "b1", "b2").agg(F.sum("size").alias("cell2"))
    so_far = Window.partitionBy("skey", "b1").orderBy("b2").rowsBetween(Window.unboundedPreceding, -1)
    fine = fine.withColumn("start2", F.coalesce(F.sum("cell2").over(so_far), F.lit(0))).drop("cell2")
    so_far = (Window.partitionBy("skey", "b1", "b2").orderBy("k", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.col("start") + F.col("start2") + F.coalesce(F.sum("size").over(so_far), F.lit(0))
    cut = (cut.join(fine, ["skey", "b1", "b2"])
           .withColumn("extra", (ahead + F.col("size") / 2 <= F.col("part")).cast("long")))
    whole = placed.where("state < 2").withColumn("extra", F.col("state").cast("long"))
    cols = ["doc_id", "key", "source", "size", "source_size", "target", "epochs", "extra"]
    copies = F.when(F.col("size") > 0, F.least(F.col("epochs") + F.col("extra"), F.lit(int(cap))))
    return (whole.select(*cols).unionByName(cut.select(*cols))
            .withColumn("copies", F.coalesce(copies, F.lit(0)).cast("long"))
            .select("doc_id", "key", "source", "size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).alias("taken")))


def mixed_documents(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The mix itself: each document of ``plan`` (made from ``docs``) as often as it is taken.

    Rows equal in id, text and source share a key, so their copies differ, by
    one, only where the budget ends among them: ``more`` of them get one more.
    """
    groups = (plan.groupBy(F.col("doc_id").alias("i"), F.col("key").alias("k"), F.col("source").alias("s"))
              .agg(F.min("copies").alias("least"), F.max("copies").alias("most"),
                   F.sum("copies").alias("total"), F.count("*").alias("n"))
              .where("most > 0")
              .select("i", "k", "s", "least", (F.col("total") - F.col("least") * F.col("n")).alias("more")))
    groups = stage(groups, "mix-groups")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col("doc_id").alias("id"), row_key().alias("key"), F.col("source").alias("src"))
    same = (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("i")) & F.col("src").eqNullSafe(F.col("s"))
    even = rows.join(groups.where("more = 0"), same).select("row", F.col("least").alias("copies"))
    odd = rows.join(groups.where("more > 0"), same).select(
        "row", "least", "more", F.to_json(F.struct("i", "k", "s")).alias("group"),
        F.monotonically_increasing_id().alias("at"))
    odd = rank_within(odd, ["group"], ["at"], "place").select(
        "row", (F.col("least") + (F.col("place") < F.col("more")).cast("long")).alias("copies"))
    return (even.unionByName(odd).where("copies > 0")
            .select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
            .select("row.*"))
