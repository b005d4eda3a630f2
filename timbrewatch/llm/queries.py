"""One query per operator over its whole table, and the SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from timbrewatch.llm import (
    bpe, chat, decontaminate, fingerprints, licenses, lines, pii, quality, secrets, simhash, structure, warc, whitening)
from timbrewatch.llm.common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op3_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "log_weight", "key", "selected")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate.mark_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", F.size("items").cast("long").alias("n_items"), F.array_join(F.col("items").cast("array<string>"), ",").alias("items"),
                         F.round("coverage", 6).alias("coverage"), (F.size("items") > 0).alias("contaminated"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), bpe.vocabulary_path(spark))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, errors=4)
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    awkward = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", awkward), (-7, 1, "assistant", awkward)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(*more.columns).unionByName(more)
    chats = chat.format_chats(chat.events_of(rows)).select(
        "conv_id", F.length("formatted").cast("long").alias("formatted_chars"),
        chat.read_turns(F.col("formatted")).alias("turns"), F.array_join(chat.read_loss(F.col("formatted"), F.col("loss")), "").alias("learnt"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
                        F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.repair_report(structure.damage(table(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_winnowing, op3_quality_resampling, op4_secret_scan, op5_line_dedup, op6_decontaminate,
    op7_pii, op8_bpe_codec, op9_simhash, op10_warc, op11_chat_format, op12_whitening, op13_structure_repair)}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

def _escaped(column: str) -> str:
    return rf"regexp_replace(regexp_replace({column}, '<({chat.AFTER_ANGLE})', '<\\\1', 'g'), '\[({chat.AFTER_SQUARE})', '[\\\1', 'g')"


ORACLES = {
    "op5_line_dedup": rf"""
WITH cut AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{UPPER}', '{LOWER}') AS key
  FROM cut),
shared AS (
  SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2)
SELECT k.doc_id, count(*) AS n_lines,
       CAST(sum(CASE WHEN s.owner IS NOT NULL AND s.owner <> k.doc_id THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos)
                       FILTER (WHERE s.owner IS NULL OR s.owner = k.doc_id), '')) AS kept_sha256
FROM keyed k LEFT JOIN shared s ON k.key = s.key
GROUP BY k.doc_id""",
    "op10_warc": """
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
spelt AS (
  SELECT *, array_to_string(list_transform(range(32), i -> substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((strpos('0123456789abcdef', substr(sha, CAST((5 * i) // 4 + 1 AS BIGINT), 1)) - 1) * 16
      + strpos('0123456789abcdef', substr(sha || '0', CAST((5 * i) // 4 + 2 AS BIGINT), 1)) - 1)
      // (CASE (5 * i) % 4 WHEN 0 THEN 8 WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 1 END) % 32 + 1 AS BIGINT), 1)), '') AS payload_digest,
    max(page_id) OVER (PARTITION BY sha) AS best
  FROM hashed)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> best THEN best END AS refers_to
FROM spelt""",
    "op11_chat_format": rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
    CASE WHEN role = 'assistant' THEN text ELSE '' END AS learnt,
    {_escaped('text')} AS body, {_escaped('role')} AS name
  FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(sum(length(learnt)) AS BIGINT) AS loss_chars, sha256(string_agg(learnt, '' ORDER BY place)) AS loss_sha256,
  CAST(sum(length(body) + CASE role WHEN 'user' THEN 22 WHEN 'system' THEN 24 WHEN 'assistant' THEN 7
    ELSE 24 + length(name) END) AS BIGINT) AS formatted_chars
FROM numbered GROUP BY conv_id""",
}
