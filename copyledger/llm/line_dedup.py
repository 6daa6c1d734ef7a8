"""Line dedup: explode normalised lines, hash, count distinct documents per
hash, drop the lines over the threshold, reassemble by position.

Only (row, position, 16-byte hash) rows of lines long enough are shuffled by
hash; the count is a two-phase distinct aggregate, so a line that a third of
all documents hold is combined before it meets.  The frequent hashes are a
staged table with one row per line, joined back with AQE free to split the
hot side.  Texts move at most once, to meet the positions to drop.

Defined results: a null or empty text is one empty line; a null ``doc_id`` is
one document that ranks below all others; rows that repeat a ``doc_id`` are
one document for counting and keep a row each; an empty table gives no rows;
extra columns pass through under their own names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copyledger.llm.common import BLANKS, LOWER, UPPER, stage

NO_ID = -(1 << 63)


def line_key(line: Column) -> Column:
    """The line stripped of blanks at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def frequent_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """``lines(id, hash)`` -> hash, keeper (largest id) of lines in ``min_docs`` ids."""
    return (lines.groupBy("hash").agg(F.count_distinct("id").alias("n"), F.max("id").alias("keeper"))
            .where(F.col("n") >= min_docs).select("hash", "keeper"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``row`` (the input row as a struct), ``kept`` (text without dropped
    lines), ``n_lines`` and ``n_dropped``, one row per input row."""
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    body = F.coalesce(F.col("text"), F.lit(""))
    lines = (docs.select(id_.alias("id"), F.xxhash64(body).alias("th"),
                         F.posexplode(F.split(body, "\n", -1)).alias("pos", "line"))
             .where(F.length("line") >= min_chars)
             .select("id", "th", "pos", line_key(F.col("line")).alias("key"))
             .where(F.length("key") >= min_chars)
             .select("id", "th", "pos", F.unhex(F.md5("key")).alias("hash")))
    lines = stage(lines, "lines")
    frequent = stage(frequent_lines(lines, min_docs), "lines-frequent")
    drops = (lines.join(frequent, "hash").where(F.col("id") != F.col("keeper"))
             .groupBy("id", "th").agg(F.collect_set("pos").alias("drop")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       body.alias("body"), id_.alias("id"), F.xxhash64(body).alias("th"))
    joined = rows.join(drops.hint("shuffle_hash"), ["id", "th"], "left")
    parts = joined.select("row", "body", "drop", F.split("body", "\n", -1).alias("parts"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("drop"))
    kept = F.array_join(F.transform(stay, lambda p: F.get(F.col("parts"), p)), "\n")
    return parts.select("row", F.when(F.col("drop").isNull(), F.col("body")).otherwise(kept).alias("kept"),
                        F.size("parts").cast("long").alias("n_lines"),
                        F.coalesce(F.array_size("drop"), F.lit(0)).cast("long").alias("n_dropped"))


def without_frequent_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with the kept text (and its length in ``n_chars``, if there)."""
    out = dedup_lines(docs, min_chars, min_docs)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
