"""Bitemporal maintenance: what a projection writes when claims, corrections and rules of a batch arrive in any order.

All slots of a batch are handled at once. Ids of versions hash the write's key and never the clock, so a replay writes
the same rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import canonical_part, fnv1a64, stable_hash
from .claims import apply_corrections, resolve_current, same_instant, set_members
from .predicates import effective_start, settled, valid_at
from .projection import same_meaning, state_records
from .scans import claim_versions, merge_slots

NONE = "cast(array() as array<string>)"


def _start() -> Column:
    return F.coalesce("valid_from_ms", "observed_at_ms")


# ids -------------------------------------------------------------------------------------------------------------------


def scalar_state_id(kind: str = "state_kind") -> Column:
    """a tombstone is keyed by its claim, any other state by slot, kind and, if it has one, facet."""
    other = F.when(F.col("slot_facet").isNull(), stable_hash("slot_id", kind)).otherwise(stable_hash("slot_id", kind, "slot_facet"))
    return F.concat(F.lit("state_"), F.when(F.col(kind) == "tombstone", stable_hash("id", kind)).otherwise(other))


def trace_id() -> Column:
    """of rule, trigger claim and derived claim."""
    return F.concat(F.lit("trace_"), stable_hash("rule_id", "trigger_claim_id", "derived_claim_id"))


def versioned_id(key: str, write_key: str, *parts: Column | str) -> Column:
    """of the record's key, the write's key and what tells versions of one write apart."""
    return F.concat(F.col(key), F.lit("@"), stable_hash(F.lit(write_key), *parts))


def write_key(seed: str, written: DataFrame, prior: DataFrame) -> str:
    """The hash of the seed, the sorted ids written and the sorted ids of the versions they meet.

    Only two sums of hashes and a count come to the driver, whatever the number of ids; they do not depend on order.
    """

    def digest(df: DataFrame) -> str:
        ids = df.select(F.col("id").cast("string").alias("id")).distinct()
        r = ids.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.sum(F.xxhash64(F.lit(1), "id").cast("decimal(38,0)")).alias("s")).first()
        return f"{r['n']}/{r['x']}/{r['s']}"

    return fnv1a64([seed, digest(written), digest(prior)])


# boundaries --------------------------------------------------------------------------------------------------------------


def boundaries(claims: DataFrame, corrections: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """The valid times at which a batch changes something, in order: (boundary)."""
    parts = [claims.select(F.explode(F.array(effective_start(), F.col("valid_to_ms"))).alias("boundary"))]
    if corrections is not None:
        parts.append(corrections.where("status = 'active'").select(F.col("effective_at_ms").alias("boundary")))
    if rules is not None:
        parts.append(rules.select(F.explode(F.array("valid_from_ms", "valid_to_ms")).alias("boundary")))
    return reduce(lambda a, b: a.union(b), parts).where("boundary is not null").distinct().orderBy("boundary")


def changed_at(claims: DataFrame, times: DataFrame) -> DataFrame:
    """The claims that begin at each boundary, and those that end there, restated as expired from it on."""
    begin = claims.join(times, effective_start() == F.col("boundary"))
    end = claims.join(times, F.col("valid_to_ms") == F.col("boundary")).withColumn("status", F.lit("expired")).withColumn("valid_from_ms", F.col("boundary")).withColumn("valid_to_ms", F.lit(None).cast("long"))
    return begin.unionByName(end)


def current_at(claims: DataFrame, times: DataFrame, keys: list[str]) -> DataFrame:
    """The current claim of each key at each boundary. A version is carried to the boundaries of its own slot inside
    its interval, so nothing is compared with all times."""
    at = times.select(*keys, "boundary").distinct()
    j = claims.join(at, keys).where(valid_at(F.col("boundary"), effective_start()))
    w = Window.partitionBy(*keys, "boundary").orderBy(effective_start().desc(), F.col("source_sequence_no").desc_nulls_last(), F.col("observed_at_ms").desc(), F.col("id").desc())
    return j.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


# state intervals -------------------------------------------------------------------------------------------------------


def close_before_stored(new: DataFrame, stored: DataFrame) -> DataFrame:
    """New versions end at the next later start among the stored versions of their slot and facet."""
    later = stored.select(F.col("slot_id").alias("_slot"), F.col("slot_facet").alias("_facet"), _start().alias("_from"))
    on = (new["slot_id"] == F.col("_slot")) & new["slot_facet"].eqNullSafe(F.col("_facet")) & (F.col("_from") > F.coalesce(new["valid_from_ms"], new["observed_at_ms"]))
    nxt = new.join(later, on).groupBy("id").agg(F.min("_from").alias("_next"))
    return new.join(nxt, "id", "left").withColumn("valid_to_ms", F.least("valid_to_ms", "_next")).drop("_next")


def stale_boundary(stale: DataFrame, new: DataFrame, incoming: int | None) -> DataFrame:
    """(id, boundary): the earliest start of a new version of the slot and facet inside [from, to) of a stale one, else
    the incoming boundary if that is inside; rows without either are left out."""
    begin, end = F.coalesce("valid_from_ms", "observed_at_ms"), F.coalesce("valid_to_ms", F.lit(2**63 - 1))
    s = stale.select("id", "slot_id", "slot_facet", begin.alias("_a"), end.alias("_b"))
    starts = new.select(F.col("slot_id").alias("_slot"), F.col("slot_facet").alias("_facet"), _start().alias("_from"))
    on = (F.col("slot_id") == F.col("_slot")) & F.col("slot_facet").eqNullSafe(F.col("_facet")) & (F.col("_from") >= F.col("_a")) & (F.col("_from") < F.col("_b"))
    inner = s.join(starts, on, "left").groupBy("id", "_a", "_b").agg(F.min("_from").alias("_first"))
    given = F.lit(incoming).cast("long")
    out = inner.select("id", F.coalesce("_first", F.when((given >= F.col("_a")) & (given < F.col("_b")), given)).alias("boundary"))
    return out.where("boundary is not null")


def reconcile(stored: DataFrame, incoming: DataFrame, write_ms: int, key: str, boundary: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new, superseded, historical).

    Stored versions that say the same as an incoming one stay untouched, and the incoming one is dropped. New versions end
    at the next stored start. Another stored version with a boundary inside it is superseded and, where it began before the
    boundary, written again up to it; one without a boundary stays.
    """
    live = stored.where("superseded_at_ms is null")
    s, i = live.alias("s"), incoming.alias("i")
    fresh = i.join(s, same_meaning("i", "s"), "left_anti")
    fresh = fresh.withColumn("id", versioned_id("id", key, _start(), F.coalesce("object_value", F.lit(""))))
    fresh = close_before_stored(fresh, live).withColumn("recorded_at_ms", F.lit(write_ms)).withColumn("superseded_at_ms", F.lit(None).cast("long"))
    rest = s.join(i, same_meaning("s", "i"), "left_anti").join(incoming.select("slot_id").distinct(), "slot_id", "left_semi")
    cut = rest.join(stale_boundary(rest, fresh, boundary), "id")
    superseded = cut.drop("boundary").withColumn("status", F.lit("superseded")).withColumn("superseded_at_ms", F.lit(write_ms))
    again = cut.where(_start() < F.col("boundary")).withColumn("valid_to_ms", F.col("boundary")).withColumn("recorded_at_ms", F.lit(write_ms)).withColumn("superseded_at_ms", F.lit(None).cast("long"))
    historical = again.withColumn("id", versioned_id("id", key, F.lit("until"), "boundary")).drop("boundary")
    return fresh, superseded, historical


def reconcile_traces(stored: DataFrame, incoming: DataFrame, active_claims: DataFrame, write_ms: int, key: str, boundary: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As reconcile(), by target slot; traces are the same if rule, trigger and derived claim are. A stale trace whose
    derived claim is still active and that is not emitted again stays."""
    live = stored.where("superseded_at_ms is null")
    same = ["trace_key", "valid_from_ms"]
    new = incoming.join(live.select(*same), same, "left_anti")
    new = new.withColumn("id", versioned_id("trace_key", key, F.col("valid_from_ms"))).withColumn("recorded_at_ms", F.lit(write_ms)).withColumn("superseded_at_ms", F.lit(None).cast("long"))
    stale = live.join(incoming.select(*same), same, "left_anti").join(incoming.select("target_slot_id").distinct(), "target_slot_id", "left_semi")
    kept = active_claims.select(F.col("id").alias("derived_claim_id")).join(incoming.select("derived_claim_id"), "derived_claim_id", "left_anti")
    stale = stale.join(kept.distinct(), "derived_claim_id", "left_anti").withColumn("slot_id", F.col("target_slot_id")).withColumn("slot_facet", F.lit(None).cast("string"))
    begun = new.withColumn("slot_id", F.col("target_slot_id")).withColumn("slot_facet", F.lit(None).cast("string"))
    cut = stale.join(stale_boundary(stale, begun, boundary), "id").drop("slot_id", "slot_facet")
    superseded = cut.drop("boundary").withColumn("status", F.lit("superseded")).withColumn("superseded_at_ms", F.lit(write_ms))
    again = cut.where(_start() < F.col("boundary")).withColumn("valid_to_ms", F.col("boundary")).withColumn("recorded_at_ms", F.lit(write_ms))
    return new, superseded, again.withColumn("id", versioned_id("trace_key", key, F.lit("until"), "boundary")).drop("boundary")


def future_set_snapshots(claims: DataFrame, stored: DataFrame, boundary: int, write_ms: int, key: str) -> DataFrame:
    """The sets of the slots as they stand at each later start of a stored set, with the late members that arrived now.

    claims: the set-valued claims of the affected slots, old and new; stored: their live set states. A snapshot that says
    what the stored one says is left out; it holds until the stored one ends.
    """
    sets = stored.where("superseded_at_ms is null and state_kind = 'set'").withColumn("boundary", _start()).where(F.col("boundary") > boundary)
    times = sets.select("slot_id", "boundary").distinct()
    live = claims.join(times, "slot_id").where((F.col("status") == "active") & (F.col("polarity") != "negative") & valid_at(F.col("boundary"), effective_start()))
    made = set_members(live, ["slot_id", "boundary"]).select("slot_id", "boundary", "members", "observed_at_ms")
    old = sets.select("slot_id", "boundary", F.col("members").alias("_old"), F.col("valid_to_ms").alias("_end"), F.col("id").alias("_id"))
    j = made.join(old, ["slot_id", "boundary"]).where(F.array_sort(F.transform("members", canonical_part)) != F.array_sort(F.transform("_old", canonical_part)))
    new_id = F.concat(F.col("_id"), F.lit("@"), stable_hash(F.lit(key), F.array_join("members", "\u0000"), "boundary"))
    return j.select(new_id.alias("id"), "slot_id", F.lit("set").alias("state_kind"), "members", "observed_at_ms", F.col("boundary").alias("valid_from_ms"), F.col("_end").alias("valid_to_ms"), F.lit(write_ms).cast("long").alias("recorded_at_ms"), F.lit(None).cast("long").alias("superseded_at_ms"))


# the projector ---------------------------------------------------------------------------------------------------------


def with_rule_ids(states: DataFrame, traces: DataFrame) -> DataFrame:
    """States with the rules of the traces that derived any of their claims, beside those they have."""
    by_claim = traces.where("derived_claim_id is not null").select(F.col("derived_claim_id").alias("_claim"), "rule_id")
    found = states.select("id", F.explode(F.coalesce("claim_ids", F.expr(NONE))).alias("_claim")).join(by_claim, "_claim").groupBy("id").agg(F.collect_set("rule_id").alias("_rules"))
    out = states.join(found, "id", "left")
    return out.withColumn("rule_ids", F.array_sort(F.array_union(F.coalesce("rule_ids", F.expr(NONE)), F.coalesce("_rules", F.expr(NONE))))).drop("_rules")


def slot_identities(claims: DataFrame, rules: DataFrame | None, stored: DataFrame | None, write_ms: int, key: str) -> DataFrame:
    """The identity of each slot of the claims, merged with what is stored, under an id of this write."""
    none = F.expr(NONE)
    own = claims.where("slot_id is not null").groupBy(*[c for c in ("space_id",) if c in claims.columns], F.col("slot_id").alias("slot_key")).agg(
        F.min(canonical_part("subject")).alias("subject_key"), F.min(canonical_part("predicate")).alias("predicate_key"), F.min("subject").alias("subject"), F.min("predicate").alias("predicate"),
        F.min("subject_entity_id" if "subject_entity_id" in claims.columns else F.lit(None).cast("string")).alias("subject_entity_id"),
        F.array_sort(F.collect_set("id")).alias("source_claim_ids"), F.min("observed_at_ms").alias("observed_at_ms"),
    )
    own = own.withColumn("source_rule_ids", none).withColumn("recorded_at_ms", F.lit(write_ms).cast("long"))
    if rules is not None:
        ends = rules.select(F.col("id").alias("_rule"), F.explode(F.array("trigger_slot_id", "target_slot_id")).alias("slot_key")).groupBy("slot_key").agg(F.array_sort(F.collect_set("_rule")).alias("_r"))
        own = own.join(ends, "slot_key", "left").withColumn("source_rule_ids", F.coalesce("_r", none)).drop("_r")
    own = own.withColumn("id", F.lit("new"))
    if stored is not None:
        kept = stored.where("superseded_at_ms is null").join(own.select("slot_key"), "slot_key", "left_semi")
        own = own.unionByName(kept.select(*[c for c in own.columns if c in kept.columns]), allowMissingColumns=True)
    merged = merge_slots(own)
    return merged.withColumn("id", versioned_id("slot_key", key, F.array_join("source_claim_ids", ","))).withColumn("superseded_at_ms", F.lit(None).cast("long"))


def project(slots: DataFrame, claims: DataFrame, corrections: DataFrame | None, stored: DataFrame, at: int | None, write_ms: int, seed: str) -> dict[str, DataFrame]:
    """B1: what the projection of some slots writes: new, superseded and historical states.

    Versions of any status, corrections, newest-wins, state records with the versions that a later one replaced at the
    same instant; then the stored live states of these slots are reconciled. If nothing changes, nothing is written.
    """
    versions = claim_versions(claims, slots, at)
    if corrections is not None:
        versions = apply_corrections(versions, corrections, at).drop("correction_ids")
    versions = settled(versions)
    now = state_records(resolve_current(versions), write_ms)
    replaced = same_instant(versions, ["slot_id"])
    earlier = state_records(replaced.withColumn("projection_key", F.lit("")), write_ms)
    incoming = settled(now.unionByName(earlier).withColumn("id", scalar_state_id()))
    mine = settled(stored.join(slots.select(F.col(slots.columns[0]).alias("slot_id")).distinct(), "slot_id", "left_semi"))
    key = write_key(seed, incoming, mine.where("superseded_at_ms is null"))
    new, superseded, historical = reconcile(mine, incoming, write_ms, key, at)
    return {"new": settled(new), "superseded": settled(superseded), "historical": settled(historical)}


def retire(frontier: DataFrame, stored: DataFrame, write_ms: int, column: str = "slot_id") -> DataFrame:
    """Live states (or traces, by target_slot_id) of slots outside the frontier, superseded."""
    keys = frontier.select(F.col(frontier.columns[0]).alias(column)).distinct()
    return stored.where("superseded_at_ms is null").join(keys, column, "left_anti").withColumn("status", F.lit("superseded")).withColumn("superseded_at_ms", F.lit(write_ms).cast("long"))
