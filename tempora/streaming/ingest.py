"""Streaming ingest: episodes arrive as a stream, are chunked and appended batch by batch; current values kept as they come.

Each micro-batch is one commit of the store; episodes that are stored are left alone with their spans and jobs, in any
tenant, so a batch that is replayed after a failure changes nothing. Late history never replaces newer state: newest-wins is by time, not by
arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import SCOPE, lexical_terms
from ..operators import ingest
from ..sources.storage import OP, Store


def episode_writes(store: Store, batch: DataFrame) -> dict[str, DataFrame]:
    """The rows of episodes that are not stored yet, of their spans and of one pending job each, marked as writes."""
    rows = batch.dropDuplicates(["id"]).join(store._live("episodes", store.manifest()).select("id"), "id", "left_anti")
    rows = ingest.episodes(rows).withColumn("status", F.lit("active"))
    spans = source_spans(rows, "raw_text", "episode", F.col("event_time_ms"))
    jobs = rows.select(F.concat(F.lit("xjob_"), "id").alias("id"), F.col("id").alias("episode_id"), "sequence_no", "event_time_ms", F.lit("pending").alias("status"), F.lit(0).alias("attempt_count"), F.col("event_time_ms").alias("created_at_ms"), *_inherited(rows))
    return {t: df.withColumn(OP, F.lit("put")) for t, df in (("episodes", rows), ("spans", spans), ("extraction_jobs", jobs))}


def _inherited(rows: DataFrame) -> list[str]:
    """The scope that records inherit from their source: every id of it, the visibility and the policy."""
    return [c for c in (*SCOPE, "visibility", "policy_tags_json") if c in rows.columns]


def source_spans(rows: DataFrame, text: str, source_type: str, created_at_ms: Column) -> DataFrame:
    """The spans of sources (id, text, scope, validity), which inherit scope and validity."""
    spans = ingest.chunk(rows, "id", text).withColumn("id", F.concat_ws("_", F.lit("span"), "source_id", "span_index"))
    spans = spans.withColumn("lexical_terms", F.array_distinct(lexical_terms("text"))).withColumn("chunker_version", F.lit(ingest.VERSION))
    valid = [c for c in ("valid_from_ms", "valid_to_ms") if c in rows.columns]
    keep = rows.select(F.col("id").alias("source_id"), created_at_ms.alias("created_at_ms"), *valid, *_inherited(rows))
    return spans.join(keep, "source_id").withColumn("status", F.lit("active")).withColumn("source_type", F.lit(source_type))


def append_episodes(store: Store, batch: DataFrame) -> None:
    """Episodes, their spans and one pending job each, in one commit. Episodes already stored are left alone."""
    store.commit(episode_writes(store, batch))


def append_episodes_with_embeddings(store: Store, batch: DataFrame, vectors: DataFrame) -> None:
    """Bulk ingest: vectors has (source_id, span_index, embedding), one for each span of the batch and no other."""
    writes = episode_writes(store, batch)
    spans = writes["spans"]
    keys = ["source_id", "span_index"]
    given = vectors.select("source_id", F.col("span_index").cast("int").alias("span_index"), "embedding")
    odd = spans.select(*keys).withColumn("s", F.lit(1)).join(given.select(*keys).withColumn("v", F.lit(1)), keys, "full").where("s is null or v is null")
    if not odd.isEmpty():
        raise ValueError("every span needs one embedding")
    store.commit(writes | {"spans": spans.join(given, keys)})


def append_vector_spans(store: Store, spans: DataFrame) -> None:
    """Spans with vectors only: without words they are invisible to keyword search."""
    store.commit({"spans": spans.withColumn("lexical_terms", F.array().cast("array<string>")).withColumn("status", F.lit("active")).withColumn(OP, F.lit("put"))})


def append_artifacts(store: Store, artifacts: DataFrame, text: str = "text") -> None:
    """Artifacts and the spans of their text; no job, as artifacts have no actor."""
    known = store._live("artifacts", store.manifest()).select("id")
    rows = artifacts.dropDuplicates(["id"]).join(known, "id", "left_anti").withColumn("status", F.lit("active"))
    spans = source_spans(rows, text, "artifact", F.col("ingested_at_ms"))
    store.commit({"artifacts": rows.drop(text).withColumn(OP, F.lit("put")), "spans": spans.withColumn(OP, F.lit("put"))})


def stream_episodes(store: Store, source: DataFrame, checkpoint: str, **trigger):
    """A running query that appends every micro-batch of a streaming source. checkpoint is a folder that all share."""
    return source.writeStream.foreachBatch(lambda batch, _: append_episodes(store, batch)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(events: DataFrame, delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Events per window and type; what comes later than the watermark is dropped by Spark."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
