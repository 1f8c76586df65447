"""The registered queries of the ten operators: (spark, sf_dir) -> DataFrame, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, chat, exact_dedup, imatch, mixing, secret_scan, sharding, simhash, token_counts, toxicity
from quarry.llm.common import table

PROBE_TEXT = "\\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(PROBE_TEXT).alias("text"))
    out = chat.format_chats(rows.unionByName(probe))
    loss = chat.loss_text(F.col("recovered"))
    turns = F.array_join(F.transform("recovered", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("recovered").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = toxicity.fold(F.col("doc_id")) == 1
    scored = toxicity.score(docs, toxicity.train(docs, labels.filter(~held)))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("h")).alias("text_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), "piece_bpe_32k.model", 4096)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), "byte_bpe_multi_50k.tiktoken")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_digests(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_toxicity, op3_exact_dedup, op4_token_counts, op5_simhash, op6_imatch, op7_byte_bpe, op8_secret_scan, op9_sharding, op10_mixing, pipeline)}

ORACLES = {
    "op1_chat_format": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (
  SELECT *, CASE role WHEN 'user' THEN 4 WHEN 'assistant' THEN 9 WHEN 'system' THEN 6 WHEN 'tool' THEN 4 ELSE 1 + 2 * strlen(role) END AS label,
    contains(text, '### ') OR contains(text, '</turn>') OR regexp_matches(text, '(?s)\\.') AS clash,
    length(text) AS n,
    length(text) - length(replace(text, '\', '')) + length(text) - length(replace(text, '#', '')) + (length(text) - length(replace(text, '</', ''))) // 2 AS more
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(n) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + label + 2 + n + CASE WHEN clash THEN more ELSE 0 END + 8)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id""",
    "op3_exact_dedup": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  row_number() OVER (PARTITION BY text ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(text) AS text_sha256
FROM d WINDOW w AS (PARTITION BY text)""",
    "op10_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
weighed AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS w FROM per),
filled AS (SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - 2::DOUBLE * coalesce(sum(source_size) OVER before, 0)::DOUBLE) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::DOUBLE AS unit,
  row_number() OVER (ORDER BY source_size / w, source IS NULL, source) AS place
  FROM weighed WINDOW before AS (ORDER BY source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min(unit, place) FILTER (unit * w <= 2 * source_size) AS level FROM filled),
plan AS (SELECT source, source_size, CASE WHEN level IS NULL OR level * w > 2 * source_size THEN 2::DOUBLE * source_size ELSE level * w END AS target,
  ('0x' || substr(sha256(CASE WHEN source IS NULL THEN '42:' ELSE '42:s' || source END), 1, 5))::BIGINT / 1048576::DOUBLE AS shift FROM filled, level),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, md5(coalesce(doc_id::VARCHAR, '')), doc_id) AS nth FROM d),
taken AS (SELECT r.*, source_size, target, least(floor(nth * rate + shift) - floor((nth - 1) * rate + shift), 2)::BIGINT AS copies
  FROM ranked r JOIN (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM plan) p ON r.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies FROM taken""",
}
