"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, held_out


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = toxicity.score(docs, toxicity.fit(docs, labels))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), *out.columns[1:])


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import exact_dedup

    return exact_dedup.assign(documents(spark, sf_dir))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    return secrets.scan(documents(spark, sf_dir))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import near_dedup

    return near_dedup.assign(documents(spark, sf_dir))


OP4_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""

def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontamination

    return decontamination.overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import line_dedup

    out = line_dedup.dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    return sharding.shard(documents(spark, sf_dir), law="rows")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    return warc.digest_rows(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP7_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS low FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN low < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN low < page_id THEN low END AS refers_to, CAST(NULL AS VARCHAR) AS error
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""

def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language_id

    out = language_id.identify(documents(spark, sf_dir))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), *out.columns[1:])


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pieces

    return pieces.digest(documents(spark, sf_dir))


OP10_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
s AS (SELECT key, min(doc_id) AS low FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, s.low IS NOT NULL AND k.doc_id <> s.low AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP5_SQL = """
WITH dw AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
bw AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM benchmark),
dp AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM dw),
bp AS (SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) AS q, len(w) AS n_words FROM bw),
al AS (SELECT doc_id, item_id, p - q AS start, n_words, count(*) AS n_equal FROM dp JOIN bp USING (word) GROUP BY ALL)
SELECT doc_id, item_id, CAST(start AS INTEGER) AS start, CAST(n_words AS INTEGER) AS n_words, CAST(n_equal AS INTEGER) AS n_equal
FROM al WHERE n_equal >= 0.75 * n_words AND n_equal >= least(8, n_words)
"""

QUERIES = {"op1_toxicity": op1_toxicity, "op2_secrets": op2_secrets, "op3_near_dedup": op3_near_dedup, "op4_exact_dedup": op4_exact_dedup, "op5_decontamination": op5_decontamination, "op6_sharding": op6_sharding, "op7_warc": op7_warc, "op8_language_id": op8_language_id, "op9_pieces": op9_pieces, "op10_line_dedup": op10_line_dedup}
ORACLES: dict[str, str] = {"op4_exact_dedup": OP4_SQL, "op5_decontamination": OP5_SQL, "op7_warc": OP7_SQL, "op10_line_dedup": OP10_SQL}
