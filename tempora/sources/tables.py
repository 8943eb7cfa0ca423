"""The engine's tables as views over the driver's Parquet tables. Every mapping is narrow: no shuffle, columns pruned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DAY_MS = 86_400_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def millis(ts: Column | str) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_millis(c.cast("timestamp"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as claims: one slot per user and event type."""
    t = millis("ts")
    return read(spark, sf_dir, "events").select(
        F.concat(F.lit("claim_ev_"), "event_id").alias("id"), F.lit("events").alias("space_id"), F.col("user_id").cast("string").alias("user_id"), F.concat(F.lit("user "), "user_id").alias("subject"), F.col("event_type").alias("predicate"),
        F.round(F.col("value") * 100).cast("long").cast("string").alias("object_value"), F.concat_ws(" ", F.lit("user"), "user_id", "event_type").alias("claim_text"), F.lit("fact").alias("claim_kind"), F.lit("affirmative").alias("polarity"), F.lit("active").alias("status"),
        t.alias("observed_at_ms"), t.alias("valid_from_ms"), F.lit(None).cast("long").alias("valid_to_ms"), F.col("event_id").alias("source_sequence_no"), F.lit("user").alias("asserted_by"), F.concat_ws("|", F.concat(F.lit("user "), "user_id"), "event_type").alias("slot_id"), F.lit(None).cast("string").alias("slot_facet"), F.array(F.concat(F.lit("ep_ev_"), "event_id")).alias("source_episode_ids"), F.lit(1.0).alias("confidence"),
    )


def set_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its order as set-valued claims: order contains part."""
    li, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    t = millis("o_orderdate")
    return j.select(
        F.concat(F.lit("claim_li_"), "l_orderkey", F.lit("_"), "l_linenumber").alias("id"), "l_orderkey", F.concat(F.lit("order "), "l_orderkey").alias("subject"), F.lit("contains part").alias("predicate"), F.col("l_partkey").cast("string").alias("object_value"),
        F.lit("relationship").alias("claim_kind"), F.lit("active").alias("status"), t.alias("observed_at_ms"), t.alias("valid_from_ms"), F.lit(None).cast("long").alias("valid_to_ms"), F.col("l_linenumber").cast("long").alias("source_sequence_no"),
    )


def retractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """error events as corrections that retract the user's signup."""
    e = read(spark, sf_dir, "events").where("event_type = 'error'")
    return e.select(
        F.concat(F.lit("corr_ev_"), "event_id").alias("id"), F.lit("active").alias("status"), F.lit("retract").alias("operation"), F.lit("claim").alias("target_type"), F.lit("canonical_slot").alias("target_match"), F.array().cast("array<string>").alias("target_ids"),
        F.concat(F.lit("user "), "user_id").alias("target_subject_key"), F.lit("signup").alias("target_predicate_key"), F.lit(None).cast("string").alias("target_selector"), millis("ts").alias("effective_at_ms"), F.col("event_id").alias("source_sequence_no"),
    )


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "user_message").when(F.col("role") == "assistant", "assistant_message").otherwise("system_event")
    t = F.col("conv_id") * 100_000 + F.col("turn") * 1000
    return c.select(F.concat(F.lit("ep_"), "conv_id", F.lit("_"), "turn").alias("id"), F.col("conv_id").cast("string").alias("thread_id"), F.col("turn").alias("sequence_no"), F.col("role").alias("actor_kind"), kind.alias("source_kind"), t.alias("event_time_ms"), F.lit(None).cast("long").alias("valid_from_ms"), F.col("text").alias("raw_text"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as spans: one a turn."""
    c = read(spark, sf_dir, "conversations")
    return c.select(F.concat(F.lit("span_"), "conv_id", F.lit("_"), "turn").alias("id"), F.col("conv_id").cast("string").alias("source_id"), F.col("turn").cast("int").alias("span_index"), "text", F.lit("active").alias("status"), (F.col("conv_id") * 100_000 + F.col("turn") * 1000).alias("valid_from_ms"), F.lit(None).cast("long").alias("valid_to_ms"))


def vector_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.concat(F.lit("vec_"), F.lpad(F.col("vec_id").cast("string"), 8, "0")).alias("id"), F.concat(F.lit("label_"), "label").alias("source_id"), F.col("vec_id").alias("seq"), "embedding")


def state_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as bitemporal states of their customer: superseded when the customer's next order is recorded."""
    from pyspark.sql import Window

    t = millis("o_orderdate")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("object_value"), t.alias("valid_from_ms"), (t + F.col("o_orderkey") % 5 * DAY_MS).alias("recorded_at_ms"))
    w = Window.partitionBy("o_custkey").orderBy("recorded_at_ms", "o_orderkey")
    return o.select("o_orderkey", "o_custkey", "object_value", "valid_from_ms", F.col("valid_from_ms").alias("observed_at_ms"), F.lit(None).cast("long").alias("valid_to_ms"), "recorded_at_ms", F.lead("recorded_at_ms").over(w).alias("superseded_at_ms"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer-order and order-part edges; confidence from the discount."""
    o = read(spark, sf_dir, "orders").select(F.concat(F.lit("co_"), "o_orderkey").alias("id"), F.concat(F.lit("cust_"), "o_custkey").alias("src"), F.concat(F.lit("order_"), "o_orderkey").alias("dst"), F.lit(1.0).alias("confidence"))
    li = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("op_"), F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).alias("id"), F.concat(F.lit("order_"), "l_orderkey").alias("src"), F.concat(F.lit("part_"), "l_partkey").alias("dst"), F.round(1 - F.col("l_discount"), 2).alias("confidence"))
    return o.union(li)
