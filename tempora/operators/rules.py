"""Dependency rules: activation, derivation over hops, stale targets, missing triggers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import after, canonical_part, slot_id, stable_hash, template_value
from .predicates import effective_start

MAX_HOPS = 8


def activation(claims: DataFrame, rules: DataFrame) -> DataFrame:
    """Every (rule, trigger) with whether it fires. continuous_projection fires for a trigger of the rule's window,
    on_change only after the rule began, with a prior claim of the slot whose value differs."""
    w = Window.partitionBy("slot_id").orderBy(effective_start(), "source_sequence_no", "id")
    c = claims.withColumn("prior_value", F.lag("object_value").over(w)).withColumn("prior_id", F.lag("id").over(w)).withColumn("start", effective_start()).alias("c")
    j = c.join(rules.alias("r"), F.col("c.slot_id") == F.col("r.trigger_slot_id"))
    inside = (F.col("c.start") >= F.coalesce("r.valid_from_ms", F.lit(-(2**63)))) & (F.col("r.valid_to_ms").isNull() | (F.col("c.start") < F.col("r.valid_to_ms")))
    status = (
        F.when(~inside, "outside_validity_window")
        .when((F.col("activation") == "on_change") & F.col("prior_id").isNull(), "no_prior_value")
        .when((F.col("activation") == "on_change") & F.col("prior_value").eqNullSafe(F.col("c.object_value")), "no_value_change")
        .when(F.col("action") == "mark_unsupported", "applied_unsupported")
        .when(F.col("c.object_value").isNull() & F.col("r.value").isNull(), "missing_trigger_value")
        .otherwise("applied_derived")
    )
    return j.select(F.col("r.id").alias("rule_id"), F.col("c.id").alias("trigger_id"), F.col("c.slot_id").alias("trigger_slot_id"), "target_slot_id", "prior_id", F.col("c.subject").alias("subject"), F.col("c.predicate").alias("predicate"), F.col("c.object_value").alias("trigger_value"), F.col("r.value").alias("rule_value"), "value_template", "start", F.col("c.source_sequence_no").alias("seq"), status.alias("status"))


def derive(fired: DataFrame) -> DataFrame:
    """The derived claim of each application: value, else the filled template, else the trigger's value."""
    value = template_value(F.col("rule_value"), F.col("value_template"), F.col("trigger_value"), F.col("subject"), F.col("predicate"))
    return fired.where("status = 'applied_derived'").withColumn("derived_value", value)


def propagate(claims: DataFrame, rules: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """Derived claims over at most max_hops hops, never back to a slot on their own path. One hop is one equi join."""
    frontier = claims.select("slot_id", F.col("object_value").alias("value"), "subject", F.array("slot_id").alias("path"), F.lit(0).alias("hop"), F.col("id").alias("root_id"))
    out = None
    for hop in range(1, max_hops + 1):
        r = rules.where("action = 'derive_value'")
        nxt = frontier.join(r, frontier["slot_id"] == r["trigger_slot_id"]).where(~F.array_contains("path", F.col("target_slot_id")))
        value = template_value(r["value"], F.col("value_template"), frontier["value"], frontier["subject"], F.lit(""))
        nxt = nxt.select(F.col("target_slot_id").alias("slot_id"), value.alias("value"), "subject", F.array_append("path", F.col("target_slot_id")).alias("path"), F.lit(hop).alias("hop"), "root_id")
        if claims.sparkSession.sparkContext.getCheckpointDir():
            nxt = nxt.checkpoint()
        if nxt.isEmpty():
            break
        out = nxt if out is None else out.union(nxt)
        frontier = nxt
    return out if out is not None else frontier.limit(0)


def stale_targets(triggers: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets asserted before their trigger changed. Both have slot pairs in `pair`, start and seq."""
    t, g = triggers.alias("t"), targets.alias("g")
    return t.join(g, F.col("t.pair") == F.col("g.pair")).where(after(F.col("t.start"), F.col("t.seq"), F.col("g.start"), F.col("g.seq")))


# writing and binding ---------------------------------------------------------------------------------------------------


def checked_rules(rules: DataFrame) -> DataFrame:
    """Rules with canonical keys and an id; problem is set where one may not be written: it needs spans and
    episodes as evidence, and a continuous rule cannot only mark its target unsupported."""
    none = F.array().cast("array<string>")
    key = lambda c: canonical_part(F.coalesce(c, F.lit("")))
    out = rules
    for end in ("trigger", "target"):
        out = out.withColumn(f"{end}_subject_key", key(f"{end}_subject")).withColumn(f"{end}_predicate_key", key(f"{end}_predicate"))
    new_id = F.concat(F.lit("rule_"), stable_hash("trigger_subject_key", "trigger_predicate_key", "target_subject_key", "target_predicate_key", "action", "activation", F.coalesce("valid_from_ms", F.lit(0))))
    out = out.withColumn("id", F.coalesce("id", new_id)).withColumn("activation", F.coalesce("activation", F.lit("on_change")))
    bad = F.when((F.size(F.coalesce("source_span_ids", none)) == 0) | (F.size(F.coalesce("source_episode_ids", none)) == 0), "needs_evidence")
    return out.withColumn("problem", bad.when((F.col("activation") == "continuous_projection") & (F.col("action") == "mark_unsupported"), "continuous_mark"))


def bind(rules: DataFrame, claims: DataFrame) -> DataFrame:
    """Rules with the slot of each end: those of the claims that have its subject (by entity where both have one) and
    predicate, and the preset one. None: its own slot; one: bound; more: ambiguous. A target for any slot of its subject
    becomes exact if its own surface has a claim; else its subject must be one identity."""
    c = claims.select("slot_id", "subject_entity_id", canonical_part(F.coalesce("subject", F.lit(""))).alias("_sk"), canonical_part(F.coalesce("predicate", F.lit(""))).alias("_pk"))
    by_key = c.groupBy("_sk", "_pk", "subject_entity_id").agg(F.collect_set("slot_id").alias("_slots"))
    out = rules
    for end in ("trigger", "target"):
        entity, sk, pk, slot = (F.col(f"{end}_{x}") for x in ("subject_entity_id", "subject_key", "predicate_key", "slot_id"))
        r = out.select("id", entity.alias("_re"), sk.alias("_sk"), pk.alias("_pk"))
        same_key = r.join(by_key, ["_sk", "_pk"]).where("_re is null or subject_entity_id is null").select("id", "_slots")
        same_entity = r.drop("_sk").withColumnRenamed("_re", "subject_entity_id").join(by_key.drop("_sk"), ["subject_entity_id", "_pk"]).select("id", "_slots")
        found = same_key.union(same_entity).groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("_slots"))).alias("_found"), F.lit(True).alias("_evidence"))
        out = out.join(found, "id", "left")
        preset = F.filter(F.array(slot), lambda x: x.isNotNull())
        slots = F.array_distinct(F.concat(preset, F.coalesce("_found", F.array().cast("array<string>"))))
        own = F.when((sk != "") & (pk != ""), slot_id(entity, sk, pk))
        status = F.when(F.size(slots) > 1, "ambiguous").when((F.size(slots) == 1) | own.isNotNull(), "bound").otherwise("pending")
        bound_slot = F.when(F.size(slots) == 1, slots[0]).when(F.size(slots) == 0, own)
        keep = F.coalesce(F.col(f"{end}_binding_status") == "ambiguous", F.lit(False))
        if end == "target":
            names = c.groupBy("_sk").agg(F.count_distinct(F.coalesce("subject_entity_id", "_sk")).alias("_ids"))
            out = out.join(names.withColumnRenamed("_sk", "target_subject_key"), "target_subject_key", "left")
            out = out.withColumn("target_match", F.when((F.col("target_match") == "any_active_slot_for_subject") & F.col("_evidence"), "exact_slot").otherwise(F.col("target_match")))
            wide = F.col("target_match") == "any_active_slot_for_subject"
            one = F.when(entity.isNotNull() | (F.coalesce("_ids", F.lit(0)) == 1) | ((F.coalesce("_ids", F.lit(0)) == 0) & (sk != "")), "bound").when(F.col("_ids") > 1, "ambiguous").otherwise("pending")
            status, bound_slot = F.when(wide, one).otherwise(status), F.when(wide, slot).otherwise(bound_slot)
        out = out.withColumns({"_status": F.when(keep, "ambiguous").otherwise(status), "_bound": F.when(keep, slot).otherwise(bound_slot)})
        out = out.withColumn(f"{end}_binding_status", F.col("_status")).withColumn(f"{end}_slot_id", F.col("_bound")).drop("_found", "_evidence", "_ids", "_status", "_bound")
    return out.select(*rules.columns)


# read-time completion --------------------------------------------------------------------------------------------------

APPLIED = ("applied_derived", "applied_unsupported")


def fire(fired: DataFrame, targets: DataFrame) -> DataFrame:
    """The outcome of each activated (rule, trigger) against the current claim of its target: rule_id,
    trigger_slot_id, target_slot_id, trigger_id, status, value.

    A trigger with a value derives. One without leaves the target unsupported, unless the target was asserted again, by
    itself, after the value was lost. A mark applies only over a target that is older than the trigger.
    """
    t = targets.select(F.col("slot_id").alias("target_slot_id"), F.col("object_value").alias("_tv"), F.coalesce("valid_from_ms", "observed_at_ms").alias("_ts"), F.col("source_sequence_no").alias("_tq"), ((F.col("status") == "active") & (F.col("polarity") == "affirmative")).alias("_live"), (~F.col("claim_kind").isin("relationship", "event") & (F.col("asserted_by") != "extractor_derived")).alias("_direct"))
    j = fired.join(t, "target_slot_id", "left")
    later = F.coalesce(F.col("_live") & F.col("_direct") & F.col("_tv").isNotNull() & after(F.col("_ts"), F.col("_tq"), F.col("start"), F.col("seq")), F.lit(False))
    stale = F.coalesce(F.col("_live") & after(F.col("start"), F.col("seq"), F.col("_ts"), F.col("_tq")), F.lit(False))
    value = template_value(F.col("rule_value"), F.col("value_template"), F.col("trigger_value"), F.col("subject"), F.col("predicate"))
    status = (
        F.when(~F.col("status").isin(*APPLIED, "missing_trigger_value"), F.col("status"))
        .when((F.col("status") == "applied_unsupported") & ~stale, "not_applicable")
        .when(F.col("status") == "applied_unsupported", "applied_unsupported")
        .when(F.col("trigger_value").isNotNull() & value.isNotNull(), "applied_derived")
        .when(later, "missing_trigger_value")
        .otherwise("applied_unsupported")
    )
    return j.select("rule_id", "trigger_slot_id", "target_slot_id", "trigger_id", status.alias("status"), F.when(status == "applied_derived", value).alias("value"), "start", "seq")


def without_redundant_marks(outcomes: DataFrame, rules: DataFrame) -> DataFrame:
    """A mark of a target that another rule derives from the same trigger's same transition is left out."""
    keys = ["trigger_slot_id", "target_slot_id", "trigger_id"]
    derived = outcomes.where("status = 'applied_derived' and value is not null").select(*keys).distinct().withColumn("_derived", F.lit(True))
    action = rules.select(F.col("id").alias("rule_id"), "action")
    j = outcomes.join(action, "rule_id", "left").join(derived, keys, "left")
    return j.where("not (status = 'applied_unsupported' and action = 'mark_unsupported' and coalesce(_derived, false))").drop("_derived", "action")


def missing_triggers(rules: DataFrame, claims: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The unsupported claim of each target whose rules' triggers have no claim: id, slot_id, subject, predicate,
    rule_ids, valid_from_ms. It holds from the latest start of these rules; a target that a rule resolved, or that was
    asserted by itself after that start, gets none."""
    known = claims.select(F.col("slot_id").alias("trigger_slot_id")).distinct()
    lost = rules.where("target_slot_id is not null").join(known, "trigger_slot_id", "left_anti")
    lost = lost.join(outcomes.where(F.col("status").isin(*APPLIED)).select("target_slot_id").distinct(), "target_slot_id", "left_anti")
    order = F.struct(F.coalesce("valid_from_ms", F.lit(-(2**63))).alias("f"), "id")
    g = lost.groupBy("target_slot_id").agg(
        F.array_sort(F.collect_set("id")).alias("rule_ids"), F.max(F.when(F.col("valid_from_ms").isNotNull(), F.struct(F.col("valid_from_ms").alias("f"), F.col("source_sequence_no").alias("q")))).alias("_b"),
        F.max_by("target_subject", order).alias("_rs"), F.max_by("target_predicate", order).alias("_rp"), F.min("valid_to_ms").alias("valid_to_ms"),
    )
    w = Window.partitionBy("slot_id").orderBy(effective_start().desc(), F.col("source_sequence_no").desc_nulls_last(), F.desc("id"))
    now = claims.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(F.col("slot_id").alias("target_slot_id"), "subject", "predicate", effective_start().alias("_ts"), F.col("source_sequence_no").alias("_tq"), ((F.col("status") == "active") & (F.col("polarity") == "affirmative") & F.col("object_value").isNotNull() & (F.col("asserted_by") != "extractor_derived") & ~F.col("claim_kind").isin("relationship", "event")).alias("_own"))
    j = g.join(now, "target_slot_id", "left").withColumn("_at", F.coalesce("_b.f", "_ts")).withColumn("_q", F.when(F.col("_b").isNotNull(), F.col("_b.q")).otherwise(F.col("_tq")))
    again = F.coalesce(F.col("_own") & after(F.col("_ts"), F.col("_tq"), F.col("_at"), F.col("_q")), F.lit(False))
    j = j.where(F.col("_at").isNotNull() & ~again).withColumn("subject", F.coalesce("subject", "_rs")).withColumn("predicate", F.coalesce("predicate", "_rp")).where("subject is not null and predicate is not null")
    new_id = F.concat(F.lit("derived_"), stable_hash(F.lit("missing_dependency_trigger"), "target_slot_id", F.array_join("rule_ids", "\u001f"), "_at", F.coalesce("_q", F.lit(-(2**63)))))
    return j.select(new_id.alias("id"), F.col("target_slot_id").alias("slot_id"), "subject", "predicate", "rule_ids", F.col("_at").alias("valid_from_ms"), "valid_to_ms", F.lit("uncertain").alias("polarity"), F.lit("dependency_resolution").alias("asserted_by"))


def complete(rules: DataFrame, claims: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """The outcome of every (rule, target) over the current claims of a closed read, hop after hop: what a hop derives
    triggers the next; marks that a derivation makes redundant go; then targets whose trigger was never seen become
    unsupported, and what was derived from these is dropped."""
    frontier, out = claims, None
    for hop in range(1, max_hops + 1):
        if frontier.sparkSession.sparkContext.getCheckpointDir():
            frontier = frontier.checkpoint()
        if frontier.isEmpty():
            break
        got = without_redundant_marks(fire(activation(frontier, rules), claims), rules).withColumn("hop", F.lit(hop))
        if out is not None:
            got = got.join(out.select("rule_id", "target_slot_id", "trigger_id"), ["rule_id", "target_slot_id", "trigger_id"], "left_anti")
        got = got.checkpoint() if frontier.sparkSession.sparkContext.getCheckpointDir() else got
        out = got if out is None else out.unionByName(got)
        new = got.where("status = 'applied_derived' and value is not null")
        template = {c: F.lit(None).cast(frontier.schema[c].dataType) for c in frontier.columns}
        template |= {"id": F.concat(F.lit("derived_"), stable_hash("rule_id", "trigger_id", "value")), "slot_id": F.col("target_slot_id"), "object_value": F.col("value"), "status": F.lit("active"), "polarity": F.lit("affirmative"), "asserted_by": F.lit("extractor_derived"), "claim_kind": F.lit("fact"), "valid_from_ms": F.col("start"), "observed_at_ms": F.col("start"), "source_sequence_no": F.col("seq")}
        frontier = new.select(*[template[c].cast(claims.schema[c].dataType).alias(c) for c in claims.columns])
    if out is None:
        out = fire(activation(claims, rules), claims).withColumn("hop", F.lit(0)).limit(0)
    lost = missing_triggers(rules, claims, out)
    marks = lost.select(F.explode("rule_ids").alias("rule_id"), F.col("slot_id").alias("target_slot_id"), F.col("id").alias("_claim")).join(rules.select(F.col("id").alias("rule_id"), "trigger_slot_id"), "rule_id")
    out = out.join(marks.select(F.col("target_slot_id").alias("trigger_slot_id")).distinct(), "trigger_slot_id", "left_anti")
    return out.select("rule_id", "trigger_slot_id", "target_slot_id", "status", "value", "hop").union(marks.select("rule_id", "trigger_slot_id", "target_slot_id", F.lit("applied_unsupported"), F.lit(None).cast("string"), F.lit(0)))


def persisted_outcomes(states: DataFrame, rules: DataFrame) -> DataFrame:
    """The outcomes that derived and unsupported states stand for."""
    status = F.when(F.col("state_kind") == "derived", "applied_derived").when(F.col("state_kind") == "unsupported", "applied_unsupported")
    each = states.withColumn("status", status).where("status is not null").select(F.explode("rule_ids").alias("rule_id"), F.col("slot_id").alias("target_slot_id"), "status", F.get("claim_ids", F.lit(0)).alias("resolved_claim_id"))
    return each.join(rules.select(F.col("id").alias("rule_id"), "trigger_slot_id"), "rule_id", "left").select("rule_id", "trigger_slot_id", "target_slot_id", "status", "resolved_claim_id")


def merge_outcomes(read: DataFrame, persisted: DataFrame, suppressed: DataFrame | None = None) -> DataFrame:
    """One outcome a (rule, target): the read's, unless it was not applied and a persisted one is there; persisted
    outcomes of claims that the read suppressed are left out."""
    if suppressed is not None:
        persisted = persisted.join(suppressed.select(F.col("id").alias("resolved_claim_id")), "resolved_claim_id", "left_anti")
    a = read.select("rule_id", "target_slot_id", F.col("trigger_slot_id").alias("_t"), F.col("status").alias("_s"))
    b = persisted.groupBy("rule_id", "target_slot_id").agg(F.min("trigger_slot_id").alias("_pt"), F.min("status").alias("_ps"))
    j = a.join(b, ["rule_id", "target_slot_id"], "full")
    use = F.col("_s").isNull() | (~F.col("_s").isin(*APPLIED) & F.col("_ps").isNotNull())
    return j.select("rule_id", "target_slot_id", F.when(use, F.col("_pt")).otherwise(F.col("_t")).alias("trigger_slot_id"), F.when(use, F.col("_ps")).otherwise(F.col("_s")).alias("status")).orderBy("rule_id", "target_slot_id")


def new_rule_triggers(rule: DataFrame, claims: DataFrame) -> DataFrame:
    """A new rule acts on the claims of its trigger slot that hold at its start: activated (rule, trigger) pairs."""
    starts = rule.select(F.col("trigger_slot_id").alias("slot_id"), F.coalesce("valid_from_ms", F.lit(-(2**63))).alias("_at")).distinct()
    held = claims.join(starts, "slot_id").where((effective_start() <= F.col("_at")) & (F.col("valid_to_ms").isNull() | (F.col("_at") < F.col("valid_to_ms")))).drop("_at").dropDuplicates(["id"])
    return activation(held.select(*claims.columns), rule.withColumn("valid_from_ms", F.lit(None).cast("long")))
