"""Canonical identity: alias registries that fail closed, canonical slots of claims, rules and corrections, admission of
proposed slots and aliases, targets of corrections, and the builders of records with generated ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import canonical_part, slot_id, stable_hash
from .claims import SET_KINDS, selector_join
from .predicates import valid_at

NONE = "cast(array() as array<string>)"


# registries ------------------------------------------------------------------------------------------------------------


def entity_registry(aliases: DataFrame) -> DataFrame:
    """L1: alias_key, entity_id of the keys that one entity owns."""
    live = aliases.where("status = 'active' and superseded_at_ms is null")
    one = live.groupBy("alias_key").agg(F.min("entity_id").alias("entity_id"), F.max("entity_id").alias("_hi"))
    return one.where("entity_id = _hi").drop("_hi")


def slot_registry(aliases: DataFrame, at: int | None = None) -> DataFrame:
    """L1: owner (entity or subject key), predicate key, alias_slot; null where two slots claim the surface."""
    live = aliases.where((F.col("status") == "active") & F.col("superseded_at_ms").isNull() & valid_at(at))
    both = live.select(F.explode(F.array("alias_subject_entity_id", "alias_subject_key")).alias("owner"), F.col("alias_predicate_key").alias("_pk"), "canonical_slot_id").where("owner is not null")
    g = both.groupBy("owner", "_pk").agg(F.min("canonical_slot_id").alias("_lo"), F.max("canonical_slot_id").alias("_hi"))
    return g.select("owner", "_pk", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias("alias_slot"), (F.col("_lo") != F.col("_hi")).alias("ambiguous"))


def surface_owners(aliases: DataFrame) -> DataFrame:
    """canonical_slot_id, surfaces: those that no other slot has."""
    one = aliases.groupBy("alias_subject_key", "alias_predicate_key").agg(F.min("canonical_slot_id").alias("canonical_slot_id"), F.max("canonical_slot_id").alias("_hi")).where("canonical_slot_id = _hi")
    return one.groupBy("canonical_slot_id").agg(F.array_sort(F.collect_set(F.concat_ws(" / ", "alias_subject_key", "alias_predicate_key"))).alias("surfaces"))


def _resolve(df: DataFrame, subject: str, predicate: str, entity: str, entities: DataFrame, slots: DataFrame) -> DataFrame:
    """df with _sk, _pk, _entity, _new (an entity found by name), _alias (slot by alias) and _ambiguous."""
    out = df.withColumn("_sk", canonical_part(F.coalesce(subject, F.lit("")))).withColumn("_pk", canonical_part(F.coalesce(predicate, F.lit(""))))
    names = entities.select(F.col("alias_key").alias("_sk"), F.col("entity_id").alias("_found"))
    out = out.join(names, "_sk", "left")
    out = out.withColumn("_new", F.col(entity).isNull() & F.col("_found").isNotNull()).withColumn("_entity", F.coalesce(entity, "_found"))
    by = lambda key, n: slots.select(F.col("owner").alias(key), "_pk", F.col("alias_slot").alias(f"_a{n}"), F.col("ambiguous").alias(f"_m{n}"))
    out = out.join(by("_entity", 1), ["_entity", "_pk"], "left").join(by("_sk", 2), ["_sk", "_pk"], "left")
    conflict = F.col("_a1").isNotNull() & F.col("_a2").isNotNull() & (F.col("_a1") != F.col("_a2"))
    bad = F.coalesce("_m1", F.lit(False)) | F.coalesce("_m2", F.lit(False)) | conflict
    out = out.withColumn("_ambiguous", bad).withColumn("_alias", F.when(~bad, F.coalesce("_a1", "_a2")))
    return out.drop("_found", "_a1", "_m1", "_a2", "_m2")


def canonicalize_claims(claims: DataFrame, entities: DataFrame, slots: DataFrame) -> DataFrame:
    """L2: slot by alias, else the claim's own slot if its entity was only now found, else the preset slot, else its own.
    A preset slot that is not the claim's own stays, with the own slot as its facet. Claims without subject or predicate
    stay as they are."""
    out = _resolve(claims, "subject", "predicate", "subject_entity_id", entities, slots)
    own = slot_id(F.col("_entity"), F.col("_sk"), F.col("_pk"))
    out = out.withColumn("_own", own)
    slot = F.when(F.col("_alias").isNotNull(), F.col("_alias")).when(F.col("_new"), F.col("_own")).otherwise(F.coalesce("slot_id", "_own"))
    named = F.col("subject").isNotNull() & F.col("predicate").isNotNull()
    out = out.withColumn("_slot", slot)
    facet = F.when(F.col("_alias").isNull() & (F.col("_slot") != F.col("_own")), F.col("_own"))
    out = out.withColumn("slot_facet", F.when(named, facet).otherwise(F.col("slot_facet"))).withColumn("slot_id", F.when(named, F.col("_slot")).otherwise(F.col("slot_id")))
    out = out.withColumn("subject_entity_id", F.when(named, F.col("_entity")).otherwise(F.col("subject_entity_id")))
    return out.select(*claims.columns)


def canonicalize_rules(rules: DataFrame, entities: DataFrame, slots: DataFrame) -> DataFrame:
    """L3: each end of a rule with its entity, its slot by alias, and its binding: ambiguous, bound or pending."""
    out = rules
    for end in ("trigger", "target"):
        cols = out.columns
        r = _resolve(out, f"{end}_subject", f"{end}_predicate", f"{end}_subject_entity_id", entities, slots)
        slot = F.coalesce("_alias", f"{end}_slot_id")
        status = F.when(F.col("_ambiguous"), "ambiguous").when(slot.isNotNull(), "bound").otherwise("pending")
        r = r.withColumn(f"{end}_binding_status", status).withColumn(f"{end}_slot_id", F.when(~F.col("_ambiguous"), slot)).withColumn(f"{end}_subject_entity_id", F.col("_entity"))
        out = r.withColumn(f"{end}_subject_key", F.col("_sk")).withColumn(f"{end}_predicate_key", F.col("_pk")).select(*cols)
    return out


def canonicalize_corrections(corrections: DataFrame, entities: DataFrame, slots: DataFrame) -> DataFrame:
    """L3: corrections with the entity of their target's subject and the slot that an alias gives it."""
    out = _resolve(corrections, "target_subject_key", "target_predicate_key", "target_subject_entity_id", entities, slots)
    out = out.withColumn("target_subject_entity_id", F.col("_entity")).withColumn("target_slot_id", F.coalesce("_alias", "target_slot_id"))
    return out.select(*corrections.columns)


def admit_slots(claims: DataFrame, slots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """L4: (claims, aliases): a proposed slot stays only if it has the claim's subject, by entity where both have one,
    else by key; where its predicate differs, the claim's surface becomes an alias of it, sourced by the claim."""
    s = slots.select(F.col("slot_key").alias("slot_id"), F.col("subject_entity_id").alias("_e"), F.col("subject_key").alias("_s"), F.col("predicate_key").alias("_p"), F.lit(True).alias("_known"))
    j = claims.join(s, "slot_id", "left").withColumn("_sk", canonical_part(F.coalesce("subject", F.lit("")))).withColumn("_pk", canonical_part(F.coalesce("predicate", F.lit(""))))
    same = F.when(F.col("_e").isNotNull() & F.col("subject_entity_id").isNotNull(), F.col("_e") == F.col("subject_entity_id")).otherwise(F.col("_s") == F.col("_sk"))
    ok = F.coalesce(F.col("_known") & same, F.lit(False))
    aliases = j.where(ok & (F.col("_pk") != F.col("_p"))).select(F.col("_sk").alias("alias_subject_key"), F.col("_pk").alias("alias_predicate_key"), F.col("subject_entity_id").alias("alias_subject_entity_id"), F.col("slot_id").alias("canonical_slot_id"), F.array("id").alias("source_claims"))
    return j.withColumn("slot_id", F.when(ok, F.col("slot_id"))).select(*claims.columns), aliases


def check_slot_aliases(aliases: DataFrame, claims: DataFrame, slots: DataFrame) -> DataFrame:
    """(id, reason) of aliases that may not be written: a source claim that does not exist, or no such target slot."""
    cited = aliases.select("id", F.explode("source_claims").alias("_c")).join(claims.select(F.col("id").alias("_c")), "_c", "left_anti").select("id").distinct()
    none = aliases.where(F.size("source_claims") == 0).select("id")
    lost = aliases.join(slots.select(F.col("slot_key").alias("canonical_slot_id")).distinct(), "canonical_slot_id", "left_anti").select("id")
    parts = [cited.withColumn("reason", F.lit("unknown_claim")), none.withColumn("reason", F.lit("no_source")), lost.withColumn("reason", F.lit("unknown_slot"))]
    return reduce(lambda a, b: a.union(b), parts).groupBy("id").agg(F.min("reason").alias("reason"))


# entities --------------------------------------------------------------------------------------------------------------


def resolve_entity_ids(inputs: DataFrame, registry: DataFrame) -> DataFrame:
    """Inputs (id, canonical_name, aliases, ...) with entity_id: the one entity that all their known names belong to."""
    names = inputs.select("id", F.explode(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.expr(NONE)))).alias("_n")).select("id", canonical_part("_n").alias("alias_key"))
    g = names.join(registry, "alias_key").groupBy("id").agg(F.min("entity_id").alias("_lo"), F.max("entity_id").alias("_hi"))
    return inputs.join(g.select("id", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias("entity_id")), "id", "left")


def merge_entities(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Entities by id: the stored canonical name stays, a new one becomes an alias; names and sources are united.
    Aliases need source claims: an entity without any keeps only its canonical name."""
    both = stored.select("id", "canonical_name", "aliases", "source_claims", "entity_type", F.lit(0).alias("_late")).union(incoming.select("id", "canonical_name", "aliases", "source_claims", "entity_type", F.lit(1)))
    none = F.expr(NONE)
    g = both.groupBy("id").agg(
        F.min_by("canonical_name", "_late").alias("canonical_name"), F.min_by("entity_type", "_late").alias("entity_type"),
        F.array_distinct(F.flatten(F.collect_list(F.array_append(F.coalesce("aliases", none), F.col("canonical_name"))))).alias("_names"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("source_claims", none))))).alias("source_claims"),
    )
    names = F.array_sort(F.array_remove("_names", F.col("canonical_name")))
    return g.select("id", "canonical_name", "entity_type", F.when(F.size("source_claims") > 0, names).otherwise(none).alias("aliases"), "source_claims")


def foreign_ids(rows: DataFrame, stored: DataFrame, scope: list[str]) -> DataFrame:
    """Ids that are stored under another scope: they may not be written."""
    s = stored.select("id", *[F.col(c).alias(f"_{c}") for c in scope])
    differ = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in scope])
    return rows.join(s, "id").where(differ).select("id").distinct()


def alias_rows(entities: DataFrame, stored: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """(new, superseded) alias rows so that the names of the entities are theirs: a name that another entity of the
    same call or store holds stays with both, and is ambiguous to readers."""
    e = entities.where(F.size("source_claims") > 0)
    names = e.select(F.col("id").alias("entity_id"), "entity_type", "source_claims", F.explode(F.array_distinct(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.expr(NONE))))).alias("_n"))
    want = names.select("entity_id", "entity_type", "source_claims", canonical_part("_n").alias("alias_key")).where("alias_key <> ''").dropDuplicates(["entity_id", "alias_key"])
    live = stored.where("superseded_at_ms is null")
    same = ["entity_id", "alias_key"]
    new = want.join(live.select(*same), same, "left_anti").withColumn("id", F.concat(F.lit("alias_"), stable_hash("entity_id", "alias_key"))).withColumn("recorded_at_ms", F.lit(now_ms).cast("long")).withColumn("superseded_at_ms", F.lit(None).cast("long")).withColumn("status", F.lit("active"))
    gone = live.join(e.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").join(want.select(*same), same, "left_anti").withColumn("superseded_at_ms", F.lit(now_ms).cast("long"))
    return new, gone


def move_to_entities(claims: DataFrame, registry: DataFrame) -> DataFrame:
    """Claims without an entity, in the slot of their subject's name, moved to the slot of the entity that the name now
    has; the facet is cleared. Only the moved claims are returned."""
    out = claims.where("subject_entity_id is null and subject is not null and predicate is not null")
    out = out.withColumn("_sk", canonical_part("subject")).withColumn("_pk", canonical_part("predicate"))
    out = out.join(registry.select(F.col("alias_key").alias("_sk"), "entity_id"), "_sk")
    out = out.where(F.col("slot_id") == slot_id(F.lit(None).cast("string"), F.col("_sk"), F.col("_pk")))
    moved = out.withColumn("slot_id", slot_id(F.col("entity_id"), F.col("_sk"), F.col("_pk"))).withColumn("subject_entity_id", F.col("entity_id")).withColumn("slot_facet", F.lit(None).cast("string"))
    return moved.select(*claims.columns)


# corrections -------------------------------------------------------------------------------------------------------------


def replacement_claims(corrections: DataFrame, targets: DataFrame) -> DataFrame:
    """M3: the claim that each replace correction puts in the place of each target (targets: claim columns and
    correction_id); corrections without a new value make none."""
    c = corrections.where("operation = 'replace' and new_value is not null").select(F.col("id").alias("correction_id"), "new_value", "effective_at_ms", F.col("source_sequence_no").alias("_seq"), F.coalesce("source_span_ids", F.expr(NONE)).alias("_spans"), F.coalesce("source_episode_ids", F.expr(NONE)).alias("_episodes"))
    j = targets.join(c, "correction_id")
    text = F.to_json(F.struct("predicate", "subject", F.col("new_value").alias("value")))
    return j.select(
        F.concat(F.lit("claim_replace_"), stable_hash("correction_id", "id", "new_value")).alias("id"), F.lit("active").alias("status"), text.alias("claim_text"), "subject", "predicate", F.col("new_value").alias("object_value"), "slot_id", "slot_facet",
        "claim_kind", F.lit("affirmative").alias("polarity"), F.lit("correction_replace").alias("asserted_by"), F.col("_seq").alias("source_sequence_no"), F.col("_spans").alias("source_span_ids"), F.col("_episodes").alias("source_episode_ids"),
        F.col("effective_at_ms").alias("observed_at_ms"), F.col("effective_at_ms").alias("valid_from_ms"), "valid_to_ms", F.array("correction_id").alias("correction_ids"), F.col("id").alias("replaced_id"),
    )


def resolve_targets(corrections: DataFrame, claims: DataFrame, slots: DataFrame) -> DataFrame:
    """M5: id, target_slot_id, problem of destructive claim corrections: they must mean exactly one slot. The slots are
    those of the claims named by id or selector, and of the structured target; problem: no_target or ambiguous_target."""
    c = corrections.where((F.col("target_type") == "claim") & F.col("operation").isin("retract", "replace", "tombstone", "forget", "mark_stale"))
    k = claims.select(F.col("id").alias("_claim"), "slot_id", "claim_text", canonical_part(F.coalesce("subject", F.lit(""))).alias("_sk"), canonical_part(F.coalesce("predicate", F.lit(""))).alias("_pk"), "object_value").where("slot_id is not null")
    named = c.select("id", F.explode("target_ids").alias("_claim")).join(k, "_claim").select("id", F.col("slot_id").alias("s"))
    with_selector = c.where(F.size(F.coalesce("target_ids", F.expr(NONE))) == 0).select("id", "target_selector")
    chosen = selector_join(k, with_selector, "target_selector", "claim_text", "_sk", "_pk", "object_value").select("id", F.col("slot_id").alias("s"))
    keyed = slots.select(F.col("slot_key").alias("s"), F.col("subject_key").alias("target_subject_key"), F.col("predicate_key").alias("target_predicate_key"))
    structured = c.select("id", "target_subject_key", "target_predicate_key").join(keyed, ["target_subject_key", "target_predicate_key"]).select("id", "s")
    given = c.where("target_slot_id is not null").select("id", F.col("target_slot_id").alias("s"))
    g = named.union(chosen).union(structured).union(given).groupBy("id").agg(F.min("s").alias("_lo"), F.max("s").alias("_hi"))
    j = c.select("id").join(g, "id", "left")
    return j.select("id", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias("target_slot_id"), F.when(F.col("_lo").isNull(), "no_target").when(F.col("_lo") != F.col("_hi"), "ambiguous_target").alias("problem"))


def already_projected(corrections: DataFrame, states: DataFrame) -> DataFrame:
    """M6: ids of corrections for which the slot has a state of the expected kind at the effective time."""
    kind = F.when(F.col("operation").isin("retract", "tombstone", "forget"), "tombstone").when(F.col("operation").isin("replace", "mark_stale"), "unsupported").otherwise("current")
    c = corrections.select(F.col("id").alias("correction_id"), F.col("target_slot_id").alias("slot_id"), kind.alias("state_kind"), "effective_at_ms")
    s = states.where("superseded_at_ms is null").select("slot_id", "state_kind", F.coalesce("valid_from_ms", "observed_at_ms").alias("_from"), "valid_to_ms")
    hit = (F.col("_from") <= F.col("effective_at_ms")) & (F.col("valid_to_ms").isNull() | (F.col("effective_at_ms") < F.col("valid_to_ms")))
    return c.join(s, ["slot_id", "state_kind"]).where(hit).select(F.col("correction_id").alias("id")).distinct()


# builders ----------------------------------------------------------------------------------------------------------------


def generated(kind: str, *parts: Column | str, scope: list[str] | None = None) -> Column:
    """kind_ and the hash of the space, the parts and, if any narrower id is set, the hash of those."""
    narrower = [F.when(F.col(c).isNotNull(), F.concat(F.lit("="), F.col(c))).otherwise("") for c in scope or []]
    plain = stable_hash("space_id", *parts)
    if not narrower:
        return F.concat(F.lit(f"{kind}_"), plain)
    some = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in scope or []])
    return F.concat(F.lit(f"{kind}_"), F.when(some, stable_hash("space_id", *parts, stable_hash(*narrower))).otherwise(plain))


def manual_claims(rows: DataFrame) -> DataFrame:
    """Claims with their canonical keys, slot, evidence and id."""
    none = F.expr(NONE)
    sk, pk = canonical_part(F.coalesce("subject", F.lit(""))), canonical_part(F.coalesce("predicate", F.lit("")))
    out = rows.withColumn("subject_key", sk).withColumn("evidence_ids", F.array_sort(F.array_distinct(F.concat(F.coalesce("source_span_ids", none), F.coalesce("source_episode_ids", none)))))
    out = out.withColumn("slot_id", F.coalesce("slot_id", slot_id(F.col("subject_entity_id"), sk, pk))).withColumn("id", F.coalesce("id", generated("claim", sk, pk, F.coalesce("object_value", F.lit("")), "observed_at_ms")))
    return out.withColumn("status", F.coalesce("status", F.lit("active"))).withColumn("polarity", F.coalesce("polarity", F.lit("affirmative")))


def sequence_numbers(claims: DataFrame, episodes: DataFrame) -> DataFrame:
    """Claims with the greatest sequence number among the episodes that they cite."""
    cited = claims.select("id", F.explode("source_episode_ids").alias("_e")).join(episodes.select(F.col("id").alias("_e"), "sequence_no"), "_e").groupBy("id").agg(F.max("sequence_no").alias("_seq"))
    return claims.join(cited, "id", "left").withColumn("source_sequence_no", F.coalesce("_seq", "source_sequence_no")).drop("_seq")


def is_set(kind: str = "claim_kind") -> Column:
    return F.col(kind).isin(*SET_KINDS)


def first_by_id(df: DataFrame, *order: Column | str) -> DataFrame:
    """Each id once, the first by the order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where("_n = 1").drop("_n")
