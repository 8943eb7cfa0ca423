"""State projection: claims to state records, scope rebuilds, interval reconciliation on both time axes, slot rankings,
answer support and validation, purges of forgotten values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import canonical_part, mask_values, rrf_share, state_kind
from .claims import SET_KINDS, apply_corrections, resolve_current, set_members
from .predicates import effective_start, valid_at

#: Fields that decide whether two versions of a state say the same; ids and times of writing do not.
MEANING = ["slot_id", "slot_facet", "state_kind", "subject", "predicate", "object_value", "valid_from_ms"]


def state_records(claims: DataFrame, projected_at_ms: int) -> DataFrame:
    """Scalar claims as state records: kind by status, polarity and asserter; keyed by slot and kind."""
    kind = state_kind(F.col("status"), F.col("polarity"), F.col("asserted_by"), F.col("claim_kind"))
    out = claims.where(~F.col("claim_kind").isin(*SET_KINDS)).withColumn("state_kind", kind).withColumn("claim_ids", F.array("id"))
    for refs, name in (("source_span_ids", "source_spans"), ("source_episode_ids", "source_episodes")):
        if refs in out.columns:
            out = out.withColumn(name, F.col(refs))
    key = F.when(F.col("state_kind") == "tombstone", F.concat_ws("|", F.lit("tombstone"), "id")).otherwise(F.concat_ws("|", "slot_id", "state_kind", "slot_facet"))
    return out.withColumn("state_key", key).withColumn("valid_from_ms", effective_start()).withColumn("projected_at_ms", F.lit(projected_at_ms)).withColumn("recorded_at_ms", F.lit(projected_at_ms)).withColumn("superseded_at_ms", F.lit(None).cast("long"))


def set_state_records(claims: DataFrame, keys: list[str], projected_at_ms: int) -> DataFrame:
    """Set-valued claims as one record a slot; members that a later removal names are gone."""
    members = claims.where(F.col("claim_kind").isin(*SET_KINDS))
    v = canonical_part("object_value")
    gone = members.where((F.col("status") != "active") | (F.col("polarity") == "negative")).groupBy(*keys, v.alias("_v")).agg(F.max(effective_start()).alias("_at"))
    live = members.where((F.col("status") == "active") & (F.col("polarity") != "negative")).withColumn("_v", v).join(gone, [*keys, "_v"], "left")
    live = live.where(F.col("_at").isNull() | (effective_start() > F.col("_at"))).drop("_v", "_at")
    return set_members(live, keys).withColumn("state_kind", F.lit("set")).withColumn("recorded_at_ms", F.lit(projected_at_ms))


def rebuild(claims: DataFrame, corrections: DataFrame | None, at: int | None, projected_at_ms: int) -> DataFrame:
    """A scope's states from scratch: corrections, newest-wins, state records."""
    versions = claims.where(valid_at(at, effective_start()))
    if corrections is not None:
        versions = apply_corrections(versions, corrections, at)
    return state_records(resolve_current(versions), projected_at_ms)


def same_meaning(left: str, right: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in MEANING])


def reconcile(stored: DataFrame, incoming: DataFrame, write_ms: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new, superseded, historical): what a projection writes.

    A stored live version that says the same as an incoming one is left alone, and so is the incoming one. Other incoming
    versions are new. Other stored live versions of the incoming slots are superseded, and where a new version of their
    slot and facet begins inside their interval a historical revision ends there. All keyed by (slot_id, slot_facet), so
    one partitioning serves the three outputs.
    """
    live = stored.where(F.col("superseded_at_ms").isNull())
    s, i = live.alias("s"), incoming.alias("i")
    new = i.join(s, same_meaning("i", "s"), "left_anti").withColumn("recorded_at_ms", F.lit(write_ms)).withColumn("superseded_at_ms", F.lit(None).cast("long"))
    touched = incoming.select("slot_id").distinct()
    stale = s.join(i, same_meaning("s", "i"), "left_anti").join(touched, "slot_id", "left_semi")
    starts = new.select(F.col("slot_id").alias("_slot"), F.col("slot_facet").alias("_facet"), F.col("valid_from_ms").alias("_from"))
    on = (stale["slot_id"] == starts["_slot"]) & stale["slot_facet"].eqNullSafe(starts["_facet"]) & (starts["_from"] >= F.coalesce(stale["valid_from_ms"], F.lit(-(2**63)))) & (stale["valid_to_ms"].isNull() | (starts["_from"] < stale["valid_to_ms"]))
    boundary = stale.join(starts, on, "left").groupBy("id").agg(F.min("_from").alias("_boundary"))
    stale = stale.join(boundary, "id")
    superseded = stale.drop("_boundary").withColumn("superseded_at_ms", F.lit(write_ms))
    historical = stale.where(F.col("_boundary") > F.col("valid_from_ms")).withColumn("valid_to_ms", F.col("_boundary")).withColumn("recorded_at_ms", F.lit(write_ms)).withColumn("superseded_at_ms", F.lit(None).cast("long")).withColumn("id", F.concat_ws("@", "id", F.lit(write_ms))).drop("_boundary")
    return new, superseded, historical


def rank_slots(ranked: DataFrame, k: int) -> DataFrame:
    """Distinct slots of ranked hits (slot_id, rank from 0), by their best rank, with a new rank."""
    best = ranked.groupBy("slot_id").agg(F.min("rank").alias("best")).orderBy("best", "slot_id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy("best", "slot_id")) - 1)


def fuse_slots(vector: DataFrame, lexical: DataFrame, k: int) -> DataFrame:
    """Slots by the sum of their shares in both rankings."""
    both = vector.select("slot_id", rrf_share(F.col("rank")).alias("share")).union(lexical.select("slot_id", rrf_share(F.col("rank")).alias("share")))
    return both.groupBy("slot_id").agg(F.sum("share").alias("score")).orderBy(F.desc("score"), "slot_id").limit(k)


def resolve_slots(claims: DataFrame, aliases: DataFrame) -> DataFrame:
    """Claims with the canonical slot of their (subject, predicate); null when an alias names two slots."""
    reg = aliases.groupBy("alias_subject_key", "alias_predicate_key").agg(F.min("canonical_slot_id").alias("alias_slot"), F.max("canonical_slot_id").alias("_hi")).withColumn("alias_slot", F.when(F.col("alias_slot") == F.col("_hi"), F.col("alias_slot"))).withColumn("ambiguous", F.col("alias_slot").isNull()).drop("_hi")
    out = claims.withColumn("alias_subject_key", canonical_part("subject")).withColumn("alias_predicate_key", canonical_part("predicate")).join(reg, ["alias_subject_key", "alias_predicate_key"], "left")
    return out.withColumn("resolved_slot", F.when(F.coalesce("ambiguous", F.lit(False)), F.lit(None)).otherwise(F.coalesce("alias_slot", "slot_id")))


def validate_answer(answer: DataFrame, support: DataFrame, spans: DataFrame) -> DataFrame:
    """Each claimed sentence with its first failing reason, null when it may stand.

    answer: id, slot_id, span_id, quote, text; support: slot_id, support; spans: span_id, span_text (those of the packet).
    """
    j = answer.join(support, "slot_id", "left").join(spans, "span_id", "left")
    reason = (
        F.when(F.col("support").isNull(), "unknown_slot")
        .when(F.col("support") != "supported", "not_supported")
        .when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty_text")
        .when(F.col("span_id").isNull(), "no_evidence")
        .when(F.col("span_text").isNull(), "span_unavailable")
        .when(~F.col("span_text").contains(F.coalesce("quote", F.lit(""))) | F.col("quote").isNull(), "quote_mismatch")
    )
    return j.select("id", reason.alias("reason"))


def purge(spans: DataFrame, values: list[str], affected: DataFrame) -> DataFrame:
    """Spans of affected sources with the forgotten values masked; the rest as they are."""
    hit = affected.select(F.col("source_id").alias("_s")).distinct().withColumn("_hit", F.lit(True))
    out = spans.join(hit, spans["source_id"] == F.col("_s"), "left")
    return out.withColumn("text", F.when(F.col("_hit"), mask_values("text", values)).otherwise(F.col("text"))).drop("_s", "_hit")
