"""Ingest: overlapping character chunks with byte and character offsets, episodes, evidence checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import lexical_terms, stable_hash

MAX_CHARS, OVERLAP, VERSION = 1200, 200, "char-window-v1"


def chunk_bounds(length: Column, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> Column:
    """Array of (start, end) in characters; the last chunk ends at the text's end, an empty text has none."""
    step = max_chars - min(overlap, max_chars - 1)
    last = F.greatest(F.ceil((length - max_chars) / step), F.lit(0)).cast("int")
    bounds = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * step).alias("start"), F.least(i * step + max_chars, length).alias("end")))
    return F.when(length > 0, bounds)


def chunk(docs: DataFrame, id_col: str, text: str = "text", max_chars: int = MAX_CHARS, overlap: int = OVERLAP, with_ids: bool = False) -> DataFrame:
    """One row per chunk: source_id, span_index, char and byte offsets, text, lexical_text."""
    d = docs.select(F.col(id_col).alias("source_id"), F.col(text).alias("_text"))
    d = d.select("source_id", "_text", F.posexplode(chunk_bounds(F.length("_text"), max_chars, overlap)).alias("span_index", "b"))
    piece = F.substring(F.col("_text"), F.col("b.start") + 1, F.col("b.end") - F.col("b.start"))
    byte_start = F.octet_length(F.substring(F.col("_text"), F.lit(1), F.col("b.start")))
    out = d.select("source_id", "span_index", F.col("b.start").alias("char_start"), F.col("b.end").alias("char_end"), byte_start.alias("byte_start"), (byte_start + F.octet_length(piece)).alias("byte_end"), piece.alias("text"))
    out = out.withColumn("lexical_text", F.lower("text")).withColumn("text_hash", F.sha2("text", 256))
    if with_ids:
        out = out.withColumn("id", F.concat(F.lit("span_"), stable_hash("source_id", "byte_start", "byte_end", F.lit(VERSION), "text_hash")))
    return out


def episodes(rows: DataFrame) -> DataFrame:
    """Episodes with their content hash and lexical terms; valid_from falls back to the event time."""
    return rows.withColumn("valid_from_ms", F.coalesce("valid_from_ms", "event_time_ms")).withColumn("content_hash", F.sha2(F.coalesce("raw_text", F.lit("")), 256)).withColumn("lexical_terms", F.array_distinct(lexical_terms("raw_text")))


def missing_evidence(claims: DataFrame, evidence: DataFrame, refs: str, id_col: str = "id") -> DataFrame:
    """References of claims to evidence that does not exist: (claim id, evidence id)."""
    cited = claims.select("id", F.explode(refs).alias("evidence_id"))
    return cited.join(evidence.select(F.col(id_col).alias("evidence_id")), "evidence_id", "left_anti").select("id", "evidence_id")


def evidence_role(cited: DataFrame, key: str) -> DataFrame:
    """state_bearing if any actor is not the assistant."""
    return cited.groupBy(key).agg(F.when(F.bool_or(F.col("actor_kind") != "assistant"), "state_bearing").otherwise("context").alias("role"))
