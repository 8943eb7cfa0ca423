"""Domain scans: filters, semi joins, order and limit over tables that are already narrowed to a scope.

A scan that takes ids takes them as a DataFrame, so a set of any size is one semi join. Limits come after the filter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import SCOPE, canonical_part, state_priority
from .claims import EXCLUDES, apply_corrections, newest, resolve_current
from .predicates import effective_start, history_visible, rule_bound, rule_in_force, span_active, state_visible, trace_visible, valid_at

RECENT_STATES = 8


def _first(df: DataFrame, limit: int | None, *order: Column | str) -> DataFrame:
    out = df.orderBy(*order)
    return out if limit is None else out.limit(limit)


def _in(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows whose column is one of the ids (a DataFrame with one column); null is none of them."""
    keys = ids.select(F.col(ids.columns[0]).alias("_key")).where("_key is not null").distinct()
    return df.join(keys, df[column] == F.col("_key"), "left_semi")


def scope_of(df: DataFrame) -> list[str]:
    return [c for c in SCOPE if c in df.columns]


def spans(table: DataFrame, limit: int | None = None, at: int | None = None, order: list[str] | None = None) -> DataFrame:
    """Active spans valid at a time, in storage order."""
    return _first(table.where(span_active(at)), limit, *(order or ["_seq", "_row"]))


def claims(table: DataFrame, limit: int | None = None, at: int | None = None, order: list[str] | None = None) -> DataFrame:
    """Active claims whose effective interval holds the time."""
    return _first(table.where((F.col("status") == "active") & valid_at(at, effective_start())), limit, *(order or ["_seq", "_row"]))


def current(versions: DataFrame, corrections: DataFrame | None, limit: int | None = None, at: int | None = None) -> DataFrame:
    """The newest of each projection key after corrections, in the order of (key, id)."""
    out = versions if corrections is None else apply_corrections(versions, corrections, at).drop("correction_ids")
    return _first(resolve_current(out), limit, "projection_key", "id")


def current_claims(table: DataFrame, corrections: DataFrame | None, limit: int | None = None, at: int | None = None) -> DataFrame:
    """Corrections first, then what is still active, then newest-wins."""
    live = table.where((F.col("status") == "active") & valid_at(at, effective_start()))
    if corrections is not None:
        live = apply_corrections(live, corrections, at).where("status = 'active'").drop("correction_ids")
    return _first(resolve_current(live), limit, "projection_key", "id")


def claim_versions(table: DataFrame, slots: DataFrame, at: int | None = None) -> DataFrame:
    """Versions of any status of the slots, by id."""
    return _in(table, "slot_id", slots).where(valid_at(at, effective_start())).dropDuplicates(["id"])


def current_of_slots(table: DataFrame, slots: DataFrame, corrections: DataFrame | None, limit: int | None = None, at: int | None = None) -> DataFrame:
    """C4: as current_claims, from versions of any status: a slot whose newest version is gone says so."""
    return current(claim_versions(table, slots, at), corrections, limit, at)


def current_of_subjects(table: DataFrame, subjects: DataFrame, corrections: DataFrame | None, limit: int | None = None, at: int | None = None) -> DataFrame:
    """Subjects (subject_entity_id, subject_key): by entity where the subject has one, else by key."""
    keyed = table.withColumn("_sk", canonical_part(F.coalesce("subject", F.lit(""))))
    by_entity = _in(keyed, "subject_entity_id", subjects.where("subject_entity_id is not null").select("subject_entity_id"))
    by_key = _in(keyed, "_sk", subjects.where("subject_entity_id is null").select("subject_key"))
    versions = by_entity.union(by_key).drop("_sk").dropDuplicates(["id"])
    return current(versions.where((F.col("status") == "active") & valid_at(at, effective_start())), corrections, limit, at)


def by_ids(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows by id."""
    return _in(table, "id", ids).orderBy("id")


def corrections(table: DataFrame, limit: int | None = None) -> DataFrame:
    """Corrections of any status in storage order."""
    return _first(table, limit, "_seq", "_row")


def active(table: DataFrame, limit: int | None = None, at: int | None = None, order: list[str] | None = None) -> DataFrame:
    """Active artifacts or profiles valid at a time."""
    return _first(table.where((F.col("status") == "active") & valid_at(at)), limit, *(order or ["_seq", "_row"]))


def entities(table: DataFrame, limit: int | None = None) -> DataFrame:
    """C11: active entities by id."""
    return _first(table.where("status = 'active'"), limit, "id")


def slot_aliases(table: DataFrame, limit: int | None = None, at: int | None = None) -> DataFrame:
    """Active slot aliases that nothing has superseded, valid at a time, by id."""
    return _first(table.where((F.col("status") == "active") & F.col("superseded_at_ms").isNull() & valid_at(at)), limit, "id")


def aliases_for_keys(table: DataFrame, names: DataFrame) -> DataFrame:
    """Active, unsuperseded entity aliases of the names, compared in canonical form."""
    keys = names.select(canonical_part(F.col(names.columns[0])).alias("name"))
    return _in(table.where((F.col("status") == "active") & F.col("superseded_at_ms").isNull()), "alias_key", keys)


def rules(table: DataFrame, limit: int | None = None, at: int | None = None) -> DataFrame:
    """C14: active rules in force."""
    return _first(table.where((F.col("status") == "active") & rule_in_force(at)), limit, "id")


def rules_for_slot(table: DataFrame, subject: str, predicate: str, limit: int | None = None, at: int | None = None) -> DataFrame:
    """Bound rules in force whose trigger has the canonical subject and predicate."""
    hit = (F.col("trigger_subject_key") == canonical_part(F.lit(subject))) & (F.col("trigger_predicate_key") == canonical_part(F.lit(predicate)))
    return _first(table.where((F.col("status") == "active") & hit & rule_bound(at)), limit, "id")


def rules_for_claims(table: DataFrame, triggers: DataFrame, names: DataFrame | None = None, at: int | None = None) -> DataFrame:
    """(rule, claim) pairs of one exact scope: by trigger slot, or by predicate and any name key of the claim's entity.

    names: (entity_id, name_key), the canonical names of entities. Two equi joins, and the pairs once each.
    """
    bound = table.where((F.col("status") == "active") & rule_bound(at)).alias("r")
    c = triggers.withColumn("_sk", canonical_part(F.coalesce("subject", F.lit("")))).withColumn("_pk", canonical_part(F.coalesce("predicate", F.lit("")))).alias("c")
    same = reduce(lambda a, b: a & b, [F.col(f"r.{s}").eqNullSafe(F.col(f"c.{s}")) for s in scope_of(table) if s in triggers.columns], F.lit(True))
    pair = [F.col("r.id").alias("rule_id"), F.col("c.id").alias("claim_id")]
    by_slot = bound.join(c, (F.col("r.trigger_slot_id") == F.col("c.slot_id")) & same).select(*pair)
    keys = c.select("c.*", F.col("c._sk").alias("_name"))
    if names is not None and "subject_entity_id" in triggers.columns:
        named = c.join(names.select("entity_id", "name_key").alias("n"), F.col("c.subject_entity_id") == F.col("n.entity_id"))
        keys = keys.union(named.select("c.*", F.col("n.name_key").alias("_name")))
    keys = keys.distinct().alias("c")
    by_key = bound.join(keys, (F.col("r.trigger_predicate_key") == F.col("c._pk")) & (F.col("r.trigger_subject_key") == F.col("c._name")) & same).select(*pair)
    return by_slot.union(by_key).distinct()


def by_priority(states: DataFrame, limit: int | None = None) -> DataFrame:
    """C17: states by (priority of kind, observation, id)."""
    return _first(states, limit, state_priority(F.col("state_kind")), "observed_at_ms", "id")


def states(table: DataFrame, limit: int | None = None, valid: int | None = None, tt: int | None = None) -> DataFrame:
    """C17: visible states in priority order."""
    return by_priority(table.where(state_visible(valid, tt)), limit)


def states_of(table: DataFrame, column: str, ids: DataFrame, limit: int | None = None, valid: int | None = None, tt: int | None = None) -> DataFrame:
    """Visible states whose slot or subject entity is one of the ids, each id once."""
    return by_priority(_in(table.where(state_visible(valid, tt)), column, ids).dropDuplicates(["id"]), limit)


def state_history(table: DataFrame, slots: DataFrame, valid: int | None = None, tt: int | None = None) -> DataFrame:
    """C20: versions begun by then, by (observation, id)."""
    return _in(table.where(history_visible(valid, tt)), "slot_id", slots).orderBy("observed_at_ms", "id")


def version_counts(table: DataFrame, slots: DataFrame, valid: int | None = None) -> DataFrame:
    """C20: the number of versions of each slot."""
    return _in(table.where(history_visible(valid)), "slot_id", slots).groupBy("slot_id").agg(F.count(F.lit(1)).alias("n_versions"))


def unsuperseded(table: DataFrame, slots: DataFrame, column: str = "slot_id") -> DataFrame:
    """States or traces (column target_slot_id) that nothing has superseded, of every valid interval."""
    return _in(table.where("superseded_at_ms is null"), column, slots)


def traces(table: DataFrame, limit: int | None = None, valid: int | None = None, tt: int | None = None) -> DataFrame:
    """Visible dependency traces by (hop, observation, id)."""
    return _first(table.where(trace_visible(valid, tt)), limit, "hop", "observed_at_ms", "id")


def merge_slots(versions: DataFrame) -> DataFrame:
    """The versions of a slot key in a scope as one: sources united, the earliest times, the first labels.

    Labels are those of the smallest (recorded, id) that has one; min_by combines before the shuffle.
    """
    keys = [*scope_of(versions), "slot_key"]
    order = F.struct("recorded_at_ms", "id")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>")))))).alias(c)
    kept = [c for c in ("subject_key", "predicate_key", "subject_entity_id", "subject", "predicate") if c in versions.columns]
    lists = [c for c in ("source_claim_ids", "source_rule_ids", "source_entity_ids") if c in versions.columns]
    return versions.groupBy(*keys).agg(*[first(c) for c in kept], *[union(c) for c in lists], F.min("observed_at_ms").alias("observed_at_ms"), F.min("recorded_at_ms").alias("recorded_at_ms"))


def slots(table: DataFrame, limit: int | None = None, valid: int | None = None, tt: int | None = None) -> DataFrame:
    """Visible slots, versions merged within a scope."""
    return _first(merge_slots(table.where(trace_visible(valid, tt))), limit, "slot_key", *scope_of(table))


def latest_comparable(table: DataFrame) -> DataFrame:
    """The latest (start, id) direct, active, affirmative claim of each slot and scope."""
    direct = table.where((F.col("status") == "active") & (F.col("polarity") == "affirmative") & (F.col("asserted_by") != "extractor_derived"))
    return newest(direct, ["slot_id", *scope_of(table)], [effective_start().desc(), F.desc("id")])


def repairable_triggers(rule_table: DataFrame, slot_table: DataFrame, claim_table: DataFrame, at: int | None = None) -> DataFrame:
    """Trigger slots of on_change rules with the latest claim to compare with: slot_id, claim_id, object_value, n_rules."""
    on_change = rule_table.where((F.col("status") == "active") & (F.col("activation") == "on_change") & rule_in_force(at))
    wanted = on_change.groupBy(F.col("trigger_slot_id").alias("slot_id"), *scope_of(rule_table)).agg(F.count(F.lit(1)).alias("n_rules"))
    known = slot_table.select(F.col("slot_key").alias("slot_id"), *scope_of(slot_table)).distinct()
    last = latest_comparable(claim_table.where(valid_at(at, effective_start())))
    keys = ["slot_id", *[c for c in scope_of(rule_table) if c in slot_table.columns and c in claim_table.columns]]
    join = lambda a, b: a.join(b.select(*keys, *[c for c in b.columns if c not in a.columns]), reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys]), "inner").drop(*[b[k] for k in keys])
    return join(join(wanted, known), last.select(*keys, F.col("id").alias("claim_id"), "object_value"))


def rule_neighbours(rule_table: DataFrame) -> DataFrame:
    """The slots at the other end of the rules of each slot: (slot_id, triggers, targets), sorted."""
    ends = rule_table.where("trigger_slot_id is not null and target_slot_id is not null")
    a = ends.select(F.col("target_slot_id").alias("slot_id"), F.col("trigger_slot_id").alias("trigger"), F.lit(None).cast("string").alias("target"))
    b = ends.select(F.col("trigger_slot_id").alias("slot_id"), F.lit(None).cast("string").alias("trigger"), F.col("target_slot_id").alias("target"))
    return a.union(b).groupBy("slot_id").agg(F.array_sort(F.collect_set("trigger")).alias("triggers"), F.array_sort(F.collect_set("target")).alias("targets"))


def recent(state_table: DataFrame, n: int = RECENT_STATES) -> DataFrame:
    """The n latest states of each slot, newest first, then kind and text; one that says the same of the same
    interval as the state before it is left out."""
    w = Window.partitionBy("slot_id").orderBy(F.desc("observed_at_ms"), "state_kind", "state_text", "id")
    same = reduce(lambda a, b: a & b, [F.lag(c).over(w).eqNullSafe(F.col(c)) for c in ("state_kind", "state_text", "valid_from_ms", "valid_to_ms")])
    seen = state_table.where("slot_id is not null").withColumn("_first", F.row_number().over(w) == 1).withColumn("_same", same)
    once = seen.where("_first or not _same").drop("_first", "_same")
    return once.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= n)


def binding_contexts(slot_table: DataFrame, entity_table: DataFrame, alias_table: DataFrame, state_table: DataFrame, rule_table: DataFrame, limit: int | None = None) -> DataFrame:
    """Each slot with its entity's name, its surfaces that no other slot has, its recent states and its rules'
    neighbours. Every list is aggregated on its own key before it is joined."""
    surfaces = alias_table.groupBy("alias_subject_key", "alias_predicate_key").agg(F.min("canonical_slot_id").alias("slot_id"), F.max("canonical_slot_id").alias("_hi")).where("slot_id = _hi")
    surface = F.concat_ws("|", "alias_subject_key", "alias_predicate_key")
    surfaces = surfaces.groupBy("slot_id").agg(F.array_sort(F.collect_set(surface)).alias("surfaces"))
    last = recent(state_table).groupBy("slot_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("recency", "state_text"))), lambda s: s["state_text"]).alias("recent_states"))
    names = entity_table.where("status = 'active'").select(F.col("id").alias("subject_entity_id"), "canonical_name")
    base = slot_table.withColumnRenamed("slot_key", "slot_id")
    out = base.join(names, "subject_entity_id", "left").join(surfaces, "slot_id", "left").join(last, "slot_id", "left").join(rule_neighbours(rule_table), "slot_id", "left")
    return _first(out, limit, "slot_id")


def slots_of_evidence(table: DataFrame, evidence: DataFrame) -> DataFrame:
    """Slots of active claims that cite any of the ids, be they of spans or of sources: (slot_id)."""
    none = F.array().cast("array<string>")
    refs = [F.coalesce(c, none) for c in ("source_span_ids", "source_episode_ids") if c in table.columns]
    cited = table.where("status = 'active' and slot_id is not null").select("slot_id", F.explode(F.concat(*refs)).alias("cited"))
    return _in(cited, "cited", evidence).select("slot_id").distinct()


def current_kinds(table: DataFrame, slot_ids: DataFrame | None = None, valid: int | None = None, tt: int | None = None) -> DataFrame:
    """The kind of the highest priority of each slot and scope."""
    seen = table.where(state_visible(valid, tt))
    if slot_ids is not None:
        seen = _in(seen, "slot_id", slot_ids)
    return seen.groupBy("slot_id", *scope_of(table)).agg(F.min_by("state_kind", state_priority(F.col("state_kind"))).alias("state_kind"))


def context_corrections(table: DataFrame, span_hits: DataFrame, claim_rows: DataFrame, at: int | None = None) -> DataFrame:
    """M7: corrections that name any of the spans or claims, each once, in the order in which they act."""
    ids = span_hits.select(F.col("id").alias("target")).union(claim_rows.select(F.col("id").alias("target")))
    act = table.where((F.col("status") == "active") & F.col("operation").isin(*EXCLUDES, "restore") & (F.lit(True) if at is None else F.col("effective_at_ms") <= at))
    hit = _in(act.select("id", F.explode("target_ids").alias("target")), "target", ids).select("id").distinct()
    return act.join(hit, "id", "left_semi").orderBy("effective_at_ms", "id")


