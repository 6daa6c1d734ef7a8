"""Registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copyledger.llm import (
    chunk_dedup,
    decontam,
    hard_negatives,
    importance,
    license_scan,
    line_dedup,
    mixing,
    quality,
    secret_scan,
    simhash,
    token_counts,
    topk,
    toxicity,
)
from copyledger.llm.common import stage, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = stage(topk.quantised(table(spark, sf_dir, "embeddings")), "vectors")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), 10)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "model")

    def of_kind(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select("doc_id", *[of_kind(k).alias(f"n_{k}") for k in secret_scan.KINDS],
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
                        F.size("unjudged").cast("long").alias("n_unjudged"))


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op7_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunk_dedup.repeated_spans(table(spark, sf_dir, "documents"))

    def total(ranges):
        return F.aggregate(ranges, F.lit(0).cast("long"), lambda a, s: a + s["words"])

    def joined(ranges):
        return F.array_join(F.transform(ranges, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")

    return found.select("doc_id", "n_chunks", "n_repeated", F.size("spans").cast("long").alias("n_spans"),
                        total("spans").alias("repeated_words"), total("cuts").alias("removed_words"),
                        joined("spans").alias("spans"), joined("cuts").alias("cuts"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("key")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where("label IS NOT NULL")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = stage(topk.quantised(rows.withColumn("label", label), 256, "label"), "vectors")
    found = hard_negatives.hard_negatives(vectors, vectors.where("vec_id % 100 = 0"), 5, 5, (80, 100))
    return found.drop("positive_rank")


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 0.3)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 5, 20, 42, 10_000)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_mixing, op2_simhash, op3_topk, op4_secrets, op5_tokens, op6_licenses, op7_chunk_dedup, op8_line_dedup,
    op9_toxicity, op10_decontam, op11_hard_negatives, op12_quality, op13_importance)}

SQL: dict[str, str] = {}

SQL["op8_line_dedup"] = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, pos, parts[pos] AS line FROM docs, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS pos)),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
many AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
         GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT keyed.*, many.k IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN many USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

SQL["op1_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
keyed AS (
  SELECT doc_id, source, size,
         -ln((('0x' || substr(md5(concat_ws(':', '7', doc_id::VARCHAR, text)), 1, 13))::BIGINT + 0.5::DOUBLE)
             / 4503599627370496::DOUBLE)
         / (1 / (1 + abs(length(coalesce(text, '')) / greatest(size, 1)::DOUBLE - 6) / 6)) AS k
  FROM sized),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM keyed GROUP BY source),
filled AS (
  SELECT *, source_size * 2.0::DOUBLE AS most,
         (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size * 2.0::DOUBLE) OVER (
            ORDER BY source_size * 2.0::DOUBLE / w, source ASC NULLS LAST
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY source_size * 2.0::DOUBLE / w, source ASC NULLS LAST
            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources),
budget AS (
  SELECT source, source_size, least(most, max(level) OVER () * w) AS target FROM filled),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM budget),
ahead AS (
  SELECT d.*, source_size, target, epochs, target - epochs * source_size AS part,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id, d.size
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       (size * least(2, epochs + CASE WHEN before + size / 2.0::DOUBLE <= part THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ahead
"""

SQL["op3_topk"] = r"""
WITH vectors AS (
  SELECT vec_id::BIGINT AS vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

SQL["op11_hard_negatives"] = r"""
WITH vectors AS (
  SELECT vec_id::BIGINT AS vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
  FROM vectors a JOIN vectors c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (
  SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank
  FROM positives JOIN scored USING (anchor_id)
  WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""

# CRC-32 is affine: a message's checksum is the exclusive or of one table entry
# for each byte and its distance from the end, and one for its length.
SQL["op13_importance"] = r"""
WITH RECURSIVE texts AS (
  SELECT 'd' AS kind, row_number() OVER () AS row, doc_id, text FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
split AS (
  SELECT kind, row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (
  SELECT kind, row, unnest(flatten([list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))
                                    for n in [1, 2, 3] if n <= len(w)])) AS f FROM split),
counted AS (SELECT kind, row, f, count(*) AS n FROM runs GROUP BY ALL),
features AS (SELECT f, hex(encode(f)) AS x, strlen(f) AS size FROM (SELECT DISTINCT f FROM counted)),
steps AS (
  SELECT 0 AS step, range::BIGINT AS b, range::BIGINT AS c FROM range(256)
  UNION ALL
  SELECT step + 1, b, CASE WHEN step < 8 THEN CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END END
  FROM steps WHERE step < 8),
crc AS (SELECT b, c AS t FROM steps WHERE step = 8),
shifted AS (
  SELECT 0::BIGINT AS d, b, t AS c FROM crc
  UNION ALL
  SELECT d + 1, s.b, xor(s.c >> 8, crc.t) FROM shifted s JOIN crc ON crc.b = s.c & 255
  WHERE d < (SELECT max(size) FROM features)),
starts AS (
  SELECT 0::BIGINT AS size, 4294967295::BIGINT AS c
  UNION ALL
  SELECT size + 1, xor(s.c >> 8, crc.t) FROM starts s JOIN crc ON crc.b = s.c & 255
  WHERE size < (SELECT max(size) FROM features)),
bytes AS (
  SELECT f, size, size - pos AS d, ('0x' || substr(x, 2 * pos - 1, 2))::BIGINT AS b
  FROM features, LATERAL (SELECT unnest(range(1, size + 1)) AS pos)),
bucket AS (
  SELECT f, xor(xor(bit_xor(shifted.c), any_value(starts.c)), 4294967295) % 10000 AS bucket
  FROM bytes JOIN shifted USING (d, b) JOIN starts ON starts.size = bytes.size GROUP BY f),
placed AS (SELECT kind, row, bucket, n FROM counted JOIN bucket USING (f)),
shares AS (
  SELECT bucket, coalesce(sum(n) FILTER (kind = 'd'), 0) AS s, coalesce(sum(n) FILTER (kind = 'b'), 0) AS t
  FROM placed GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0) AS ss, coalesce(sum(t), 0) AS tt FROM shares),
gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (ss + 10000)::DOUBLE)
                                 / ((s + 1)::DOUBLE * (tt + 10000)::DOUBLE)))::BIGINT AS gain FROM shares, totals),
weights AS (
  SELECT row, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight
  FROM placed JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY row),
scored AS (
  SELECT doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT
             + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM split LEFT JOIN weights USING (row) WHERE kind = 'd'),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, 5 * count(*) OVER () // 100 AS n
  FROM scored WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= n THEN place END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""
