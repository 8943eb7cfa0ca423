"""The answer-ready read: which states a query is about, what supports each slot, and the checks of an answer against it.

Sets of ids are one-column DataFrames. The support of a slot is one row: slot_id, view, state, source_claim_ids,
source_span_ids, subject, predicate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import canonical_part, phrase_present, state_kind, state_priority, support_priority
from .claims import newest
from .graph import closure
from .scans import current_kinds

VIEWS = ("current", "timeline", "set")
ROLES = ("answer_target", "supporting")
#: Fixed: what each signal adds to the score of a state.
SIGNALS = {"preferred": 8, "evidence": 6, "anchored": 4, "set_entity": 2}
NONE = "cast(array() as array<string>)"


def read_plan(selections: list[dict], targets: list[str] | None = None) -> tuple[dict[str, str], set[str]]:
    """Q2: (view of each selected slot, the answer targets). A slot with two views is an error, and so are selections
    without a target, unless the targets are given."""
    views: dict[str, str] = {}
    for s in selections:
        view, role = s.get("view", "current"), s.get("role", "answer_target")
        if view not in VIEWS or role not in ROLES:
            raise ValueError(f"unknown view or role in {s}")
        if views.setdefault(s["slot_id"], view) != view:
            raise ValueError(f"slot {s['slot_id']} is selected with two views")
    chosen = set(targets) if targets is not None else {s["slot_id"] for s in selections if s.get("role", "answer_target") == "answer_target"}
    if selections and not chosen:
        raise ValueError("selections need an answer target")
    return views, chosen


def _query(text: str) -> Column:
    return canonical_part(F.lit(text))


def _named(text: str, *surfaces: str) -> Column:
    """Whether the query holds any of the columns' texts as a phrase."""
    return reduce(lambda a, b: a | b, [F.coalesce(phrase_present(_query(text), canonical_part(F.coalesce(c, F.lit("")))), F.lit(False)) for c in surfaces])


def _flag(df: DataFrame, column: str, ids: DataFrame, name: str) -> DataFrame:
    """df with a column that tells whether its key is one of the ids."""
    keys = ids.select(F.col(ids.columns[0]).alias("_key")).where("_key is not null").distinct().withColumn(name, F.lit(True))
    return df.join(keys, df[column] == F.col("_key"), "left").withColumn(name, F.coalesce(name, F.lit(False))).drop("_key")


def mentioned_entities(entities: DataFrame, text: str) -> DataFrame:
    """Q3: ids of entities of which the query holds a name: (id)."""
    name = F.explode(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.expr(NONE)))).alias("name")
    return entities.select("id", name).where(_named(text, "name")).select("id").distinct()


def query_slots(slots: DataFrame, entities: DataFrame, text: str) -> DataFrame:
    """Q3: slots of which the query names the predicate, and the subject or its entity: (slot_key)."""
    out = _flag(slots, "subject_entity_id", mentioned_entities(entities, text), "_mentioned")
    return out.where(_named(text, "predicate", "predicate_key") & (_named(text, "subject", "subject_key") | F.col("_mentioned"))).select("slot_key").distinct()


def expand_targets(targets: DataFrame, read_set: DataFrame, rules: DataFrame, states: DataFrame, slots: DataFrame, asked: DataFrame, valid: int | None = None, tt: int | None = None) -> DataFrame:
    """Q4: the targets, the derived consequences of them in the read set, and slots that the query names whose state is
    derived, deleted or unsupported and that are in the read set or share a subject with a target: (slot_id)."""
    t, r = targets.select(F.col(targets.columns[0]).alias("slot_id")), read_set.select(F.col(read_set.columns[0]).alias("slot_id"))
    exact = rules.where("trigger_binding_status = 'bound' and target_binding_status = 'bound' and target_match = 'exact_slot' and action = 'derive_value'")
    reached = exact.join(t.withColumnRenamed("slot_id", "trigger_slot_id"), "trigger_slot_id", "left_semi").select(F.col("target_slot_id").alias("slot_id")).join(r, "slot_id", "left_semi")
    kinds = current_kinds(states, None, valid, tt).select("slot_id", "state_kind")
    derived = kinds.where("state_kind = 'derived'").join(reached, "slot_id", "left_semi").select("slot_id")
    life = kinds.where("state_kind in ('derived', 'tombstone', 'unsupported')").join(asked.select(F.col(asked.columns[0]).alias("slot_id")), "slot_id", "left_semi").select("slot_id")
    subject = F.coalesce("subject_entity_id", "subject_key").alias("_subject")
    keyed = slots.select(F.col("slot_key").alias("slot_id"), subject)
    near = keyed.join(keyed.join(t, "slot_id", "left_semi").select("_subject").distinct(), "_subject", "left_semi").select("slot_id")
    return t.union(derived).union(life.join(r.union(near).distinct(), "slot_id", "left_semi")).distinct()


def candidate_states(states: DataFrame, slot_ids: DataFrame, entity_ids: DataFrame, explicit: bool) -> DataFrame:
    """Q5: states of the candidate slots; an unselected read takes those of mentioned entities and of the states' own
    subjects too, and every state when nothing matched."""
    of_slots = states.join(slot_ids.select(F.col(slot_ids.columns[0]).alias("slot_id")).distinct(), "slot_id", "left_semi")
    if explicit:
        return of_slots
    entities = entity_ids.select(F.col(entity_ids.columns[0]).alias("subject_entity_id")).union(of_slots.select("subject_entity_id")).where("subject_entity_id is not null").distinct()
    found = of_slots.unionByName(states.join(entities, "subject_entity_id", "left_semi").select(*of_slots.columns)).dropDuplicates(["id"])
    return states if found.isEmpty() else found


def assess(states: DataFrame, text: str, *, preferred: DataFrame, evidence_slots: DataFrame, evidence_spans: DataFrame, entities: DataFrame) -> DataFrame:
    """Q6: the states with the signals of SIGNALS and their score."""
    subject = F.coalesce("subject_entity_id", canonical_part("subject"))
    spans = evidence_spans.select(F.col(evidence_spans.columns[0]).alias("_span")).distinct()
    cited = states.select("id", F.explode(F.coalesce("source_spans", F.expr(NONE))).alias("_span")).join(spans, "_span", "left_semi").select("id").distinct()
    out = _flag(states.withColumn("_subject", subject), "id", cited, "_cites")
    out = _flag(out, "slot_id", preferred, "preferred")
    out = _flag(out, "slot_id", evidence_slots, "_on_slot")
    out = _flag(out, "subject_entity_id", mentioned_entities(entities, text), "_entity")
    out = _flag(out, "_subject", out.where("_cites").select("_subject"), "_linked")
    out = out.withColumn("_named", _named(text, "subject")).withColumn("evidence", F.col("_cites") | F.col("_on_slot"))
    out = out.withColumn("anchored", _named(text, "predicate") & (F.col("_entity") | F.col("_named") | F.col("_linked")))
    out = out.withColumn("set_entity", (F.col("state_kind") == "set") & (F.col("_entity") | F.col("_named")))
    score = reduce(lambda a, b: a + b, [F.when(F.col(s), n).otherwise(0) for s, n in SIGNALS.items()])
    return out.withColumn("score", score).drop("_subject", "_cites", "_on_slot", "_entity", "_linked", "_named")


def selection_order() -> list[Column]:
    return [F.desc("score"), state_priority(F.col("state_kind")), F.desc("observed_at_ms"), F.col("id")]


def select_states(assessed: DataFrame, limit: int) -> DataFrame:
    """T5, Q6: the best states; one without a signal is never chosen."""
    return assessed.where("score > 0").orderBy(*selection_order()).limit(limit)


def visible_in_views(states: DataFrame, views: dict[str, str]) -> DataFrame:
    """Q6: states of a slot; the set view of a slot hides its current and derived ones."""
    sets = [s for s, v in views.items() if v == "set"]
    hidden = F.col("slot_id").isin(sets) & ~F.col("state_kind").isin("set", "tombstone", "unsupported", "rule") if sets else F.lit(False)
    return states.where(F.col("slot_id").isNotNull() & ~hidden)


def selection_trace(states: DataFrame, assessed: DataFrame, selected: DataFrame) -> DataFrame:
    """Q13: what became of each state in scope: candidate_filtered, selected, no_selection_signal or claim_limit."""
    a = assessed.select("id", "score", *SIGNALS, F.lit(True).alias("_eligible"))
    j = states.select("id", "state_kind", "slot_id").join(a, "id", "left").join(selected.select("id", F.lit(True).alias("_selected")), "id", "left")
    disposition = F.when(F.col("_eligible").isNull(), "candidate_filtered").when(F.col("_selected"), "selected").when(F.col("score") == 0, "no_selection_signal").otherwise("claim_limit")
    return j.select("id", "state_kind", "slot_id", F.coalesce("score", F.lit(0)).alias("score"), disposition.alias("disposition"))


def dependency_slots(states: DataFrame, rules: DataFrame, max_hops: int = 8) -> DataFrame:
    """Q7: the slots of the states and those that they depend on over rules, with the hop."""
    roots = states.where("slot_id is not null").select(F.col("slot_id").alias("node")).distinct()
    edges = rules.where("status = 'active' and trigger_slot_id is not null and target_slot_id is not null").select(F.col("trigger_slot_id").alias("src"), F.col("target_slot_id").alias("dst"))
    return closure(edges, roots, max_hops)


def _list(df: DataFrame, name: str) -> Column:
    return F.coalesce(name, F.expr(NONE)) if name in df.columns else F.expr(NONE)


def claim_support(claims: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """The support of each slot from its claims and set states.

    The first that holds: a tombstone of the whole slot: deleted; an unsupported claim of the whole slot: unsupported; a
    set state: supported; any tombstone: deleted; any other claim that is not active and affirmative: unsupported; any
    claim: supported. A claim speaks for the whole slot unless it is of a relationship or an event.
    """
    kind = state_kind(F.col("status"), F.col("polarity"), F.col("asserted_by"), F.col("claim_kind"))
    whole = ~F.col("claim_kind").isin("relationship", "event")
    rows = claims.select("slot_id", F.col("id").alias("claim"), _list(claims, "source_span_ids").alias("spans"), "subject", "predicate", kind.alias("k"), whole.alias("w"), F.col("status").isin("retracted", "tombstoned", "redacted").alias("gone"), ((F.col("status") != "active") | (F.col("polarity") != "affirmative")).alias("weak"), F.lit(False).alias("s"))
    if sets is not None:
        rows = rows.union(sets.select("slot_id", F.lit(None).cast("string"), _list(sets, "source_spans"), "subject", "predicate", F.lit("set"), F.lit(False), F.lit(False), F.lit(False), F.lit(True)))
    any_ = lambda c: F.max(F.coalesce(c, F.lit(False)))
    state = (
        F.when(any_((F.col("k") == "tombstone") & F.col("w")), "deleted")
        .when(any_((F.col("k") == "unsupported") & F.col("w")), "unsupported")
        .when(any_(F.col("s")), "supported")
        .when(any_(F.col("gone")), "deleted")
        .when(any_(F.col("weak")), "unsupported")
        .otherwise("supported")
    )
    spans = F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans"))))
    return rows.groupBy("slot_id").agg(state.alias("state"), F.array_sort(F.collect_set("claim")).alias("source_claim_ids"), spans.alias("source_span_ids"), F.min("subject").alias("subject"), F.min("predicate").alias("predicate"))


def state_support(states: DataFrame) -> DataFrame:
    """The support of each slot from its state records, by the same order of reasons."""
    whole = ~F.col("claim_kind").isin("relationship", "event")
    any_ = lambda c: F.max(F.coalesce(c, F.lit(False)))
    k = F.col("state_kind")
    state = (
        F.when(any_(whole & (k == "tombstone")), "deleted")
        .when(any_(whole & (k == "unsupported")), "unsupported")
        .when(any_((k == "set") & (F.size("members") > 0)), "supported")
        .when(any_(k == "tombstone"), "deleted")
        .when(any_(k == "unsupported"), "unsupported")
        .when(any_(k.isin("current", "derived", "set")), "supported")
        .otherwise("no_evidence")
    )
    return states.groupBy("slot_id").agg(state.alias("state"))


def target_support(support: DataFrame, targets: DataFrame, slots: DataFrame) -> DataFrame:
    """Q10: the support of the targets; one without any claim has no evidence. Labels that claims lack are the slot's."""
    t = targets.select(F.col(targets.columns[0]).alias("slot_id")).distinct()
    labels = slots.select(F.col("slot_key").alias("slot_id"), F.col("subject").alias("_s"), F.col("predicate").alias("_p"))
    j = t.join(support, "slot_id", "left").join(labels, "slot_id", "left")
    return j.select("slot_id", F.coalesce("state", F.lit("no_evidence")).alias("state"), F.coalesce("source_claim_ids", F.expr(NONE)).alias("source_claim_ids"), F.coalesce("source_span_ids", F.expr(NONE)).alias("source_span_ids"), F.coalesce("subject", "_s").alias("subject"), F.coalesce("predicate", "_p").alias("predicate"))


SUPPORTED_KINDS = ("current", "derived", "set")


def with_views(support: DataFrame, views: dict[str, str], versions: DataFrame) -> DataFrame:
    """Q10: the view of each slot; a timeline or set view is supported when any version in the slot's history
    (slot_id, state_kind, object_value, members, claim_ids, source_spans) is a supported one with a value."""
    view = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in views.items() for x in kv]), F.col("slot_id")), F.lit("current")) if views else F.lit("current")
    good = versions.where(F.col("state_kind").isin(*SUPPORTED_KINDS) & (F.col("object_value").isNotNull() | (F.size(F.coalesce("members", F.expr(NONE))) > 0)))
    seen = good.groupBy("slot_id").agg(F.flatten(F.collect_list(F.coalesce("claim_ids", F.expr(NONE)))).alias("_c"), F.flatten(F.collect_list(F.coalesce("source_spans", F.expr(NONE)))).alias("_s"))
    j = support.withColumn("view", view).join(seen, "slot_id", "left").withColumn("_wide", F.col("view").isin("timeline", "set") & F.col("_c").isNotNull())
    both = lambda a, b: F.when(F.col("_wide"), F.array_sort(F.array_distinct(F.concat(a, b)))).otherwise(F.col(a))
    return j.select("slot_id", "view", F.when(F.col("_wide"), "supported").otherwise(F.col("state")).alias("state"), both("source_claim_ids", "_c").alias("source_claim_ids"), both("source_span_ids", "_s").alias("source_span_ids"), "subject", "predicate")


def aggregate_state(support: DataFrame) -> str:
    """Deleted before unsupported before supported before no_evidence."""
    row = support.agg(F.min_by("state", support_priority(F.col("state"))).alias("s")).first()
    return row["s"] or "no_evidence"


def proof_spans(support: DataFrame) -> DataFrame:
    """Q11: the spans that prove the targets, each once: the first of each slot is required and comes first."""
    rows = support.select("slot_id", F.posexplode("source_span_ids").alias("pos", "span_id"))
    once = rows.groupBy("span_id").agg(F.min(F.struct(F.when(F.col("pos") == 0, 0).otherwise(1).alias("rest"), "slot_id", "pos")).alias("o"))
    return once.select("span_id", (F.col("o.rest") == 0).alias("required")).orderBy(F.desc("required"), "span_id")


def hydrate_evidence(proof: DataFrame, retrieved: DataFrame, spans: DataFrame) -> DataFrame:
    """Q11: proof spans first (score 1.0 when they were not retrieved), then the other retrieved hits: id, score, required."""
    p = proof.select(F.col("span_id").alias("id"), "required").join(spans.select("id"), "id", "left_semi")
    out = p.join(retrieved.select("id", "score"), "id", "full")
    return out.select("id", F.coalesce("score", F.lit(1.0)).alias("score"), F.coalesce("required", F.lit(False)).alias("required"), F.col("required").isNull().alias("extra")).orderBy(F.desc("required"), "extra", F.desc("score"), "id")


def distinct_history_values(versions: DataFrame) -> DataFrame:
    """slot_id, values: the values and members of supported versions, the oldest first, each once in canonical form."""
    good = versions.where(F.col("state_kind").isin(*SUPPORTED_KINDS))
    each = good.select("slot_id", "valid_from_ms", "observed_at_ms", "id", F.posexplode(F.filter(F.concat(F.array("object_value"), F.coalesce("members", F.expr(NONE))), lambda v: v.isNotNull())).alias("pos", "value"))
    order = F.struct(F.coalesce("valid_from_ms", F.lit(-(2**63))).alias("f"), "observed_at_ms", "id", "pos")
    first = each.groupBy("slot_id", canonical_part("value").alias("_v")).agg(F.min(F.struct(order.alias("o"), "value")).alias("m"))
    return first.groupBy("slot_id").agg(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["value"]).alias("values"))


def facets(claims: DataFrame) -> DataFrame:
    """Q12: one row a slot and facet: the newest claim's labels, the facet's support, its value if that is supported."""
    facet = F.coalesce("slot_facet", "slot_id")
    sup = claim_support(claims.withColumn("slot_id", F.struct(F.col("slot_id").alias("s"), facet.alias("f")))).select("slot_id.s", "slot_id.f", "state", "source_claim_ids", "source_span_ids")
    last = newest(claims.withColumn("_f", facet), ["slot_id", "_f"]).select(F.col("slot_id").alias("s"), F.col("_f").alias("f"), "subject", "predicate", "object_value", "valid_from_ms", "valid_to_ms")
    j = sup.join(last, ["s", "f"])
    return j.select(F.col("s").alias("slot_id"), F.col("f").alias("facet"), "subject", "predicate", F.col("state").alias("support_state"), F.when(F.col("state") == "supported", F.col("object_value")).alias("value"), "source_claim_ids", "source_span_ids", "valid_from_ms", "valid_to_ms")


def resolved_slots(support: DataFrame, claims: DataFrame, sets: DataFrame, versions: DataFrame) -> DataFrame:
    """Q12: the answer-ready view of each slot of with_views().

    current_value: the newest claim's value where the slot is supported and its supported facets agree; members: those of
    the newest set state, or for a set view without one the values that the slot has held.
    """
    f = facets(claims)
    agree = f.where("support_state = 'supported'").groupBy("slot_id").agg(F.count_distinct(canonical_part("value")).alias("_values"))
    count = f.groupBy("slot_id").agg(F.count(F.lit(1)).alias("n_facets"))
    top = newest(claims, ["slot_id"]).select("slot_id", F.col("object_value").alias("_value"), F.col("valid_from_ms").alias("_cf"), F.col("valid_to_ms").alias("_ct"), state_kind(F.col("status"), F.col("polarity"), F.col("asserted_by"), F.col("claim_kind")).alias("_kind"), F.lit(True).alias("_has_claim"))
    w = Window.partitionBy("slot_id").orderBy(F.desc("valid_from_ms"), F.desc("observed_at_ms"), F.desc("id"))
    last = sets.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("slot_id", "members", F.col("valid_from_ms").alias("_sf"), F.col("valid_to_ms").alias("_st"), F.lit(True).alias("_has_set"))
    j = support.join(top, "slot_id", "left").join(last, "slot_id", "left").join(agree, "slot_id", "left").join(count, "slot_id", "left").join(distinct_history_values(versions), "slot_id", "left")
    ok = F.col("state") == "supported"
    kind = F.when(F.col("state") == "deleted", "tombstone").when(F.col("state") == "unsupported", "unsupported").when(ok & F.col("_has_set"), "set").when(ok, F.col("_kind"))
    explicit = F.coalesce("members", F.expr(NONE))
    members = F.when(~ok, F.expr(NONE)).when((F.size(explicit) == 0) & (F.col("view") == "set"), F.coalesce("values", F.expr(NONE))).otherwise(explicit)
    value = F.when(ok & (F.coalesce("_values", F.lit(0)) <= 1), F.col("_value"))
    return j.select("slot_id", "view", F.col("state").alias("support_state"), kind.alias("state_kind"), "subject", "predicate", value.alias("current_value"), members.alias("members"), F.coalesce("n_facets", F.lit(0)).alias("n_facets"), "source_claim_ids", "source_span_ids", F.when(F.col("_has_claim"), F.col("_cf")).otherwise(F.col("_sf")).alias("valid_from_ms"), F.when(F.col("_has_claim"), F.col("_ct")).otherwise(F.col("_st")).alias("valid_to_ms"))


def restrict(support: DataFrame, slot_ids: DataFrame, span_ids: DataFrame) -> DataFrame:
    """V3: the support that a packet still holds: its slots, their spans among its spans; a supported slot without any
    of them has no evidence."""
    s = support.join(slot_ids.select(F.col(slot_ids.columns[0]).alias("slot_id")).distinct(), "slot_id", "left_semi")
    inside = s.select("slot_id", F.explode("source_span_ids").alias("_span")).join(span_ids.select(F.col(span_ids.columns[0]).alias("_span")).distinct(), "_span", "left_semi")
    kept = inside.groupBy("slot_id").agg(F.array_sort(F.collect_set("_span")).alias("_kept"))
    j = s.join(kept, "slot_id", "left").withColumn("source_span_ids", F.coalesce("_kept", F.expr(NONE))).drop("_kept")
    return j.withColumn("state", F.when((F.col("state") == "supported") & (F.size("source_span_ids") == 0), "no_evidence").otherwise(F.col("state")))


def check_answer(answer: DataFrame, support: DataFrame, spans: DataFrame) -> DataFrame:
    """V2: each claim of an answer with its slot, and why it is rejected (null: it is emitted).

    answer: claim (its number), slot_id or null, text, evidence array<struct<span_id, quote>>; spans: span_id, text of the
    packet. The first reason in this order: unknown_slot or ambiguous_slot, the slot's state, missing_text,
    missing_evidence, evidence_outside_support, then by citation evidence_unavailable or quote_mismatch.
    """
    n = support.count()
    if n == 1:  # a claim without a slot answers from the only one
        answer = answer.crossJoin(F.broadcast(support.select(F.col("slot_id").alias("_only")))).withColumn("slot_id", F.coalesce("slot_id", "_only")).drop("_only")
    s = support.select("slot_id", "state", F.col("source_span_ids").alias("_allowed"))
    j = answer.join(s, "slot_id", "left")
    cites = j.select("claim", "_allowed", F.posexplode("evidence").alias("pos", "e")).select("claim", "pos", "e.span_id", "e.quote", (~F.array_contains("_allowed", F.col("e.span_id"))).alias("outside"))
    found = cites.join(spans.select("span_id", F.col("text").alias("_source")), "span_id", "left")
    bad = F.when(F.col("_source").isNull(), "evidence_unavailable").when((F.trim(F.coalesce("quote", F.lit(""))) == "") | ~F.col("_source").contains(F.col("quote")), "quote_mismatch")
    per = found.groupBy("claim").agg(F.max("outside").alias("_outside"), F.min(F.when(bad.isNotNull(), F.struct("pos", bad.alias("why")))).alias("_bad"))
    states = {"unsupported": "unsupported_slot", "deleted": "deleted_slot", "no_evidence": "no_evidence"}
    j = j.join(per, "claim", "left")
    reason = F.when(F.col("slot_id").isNull(), "ambiguous_slot").when(F.col("state").isNull(), "unknown_slot")
    for state, why in states.items():
        reason = reason.when(F.col("state") == state, why)
    reason = reason.when(F.trim(F.coalesce("text", F.lit(""))) == "", "missing_text").when(F.size("evidence") <= 0, "missing_evidence").when(F.col("_outside"), "evidence_outside_support").otherwise(F.col("_bad.why"))
    return j.select("claim", "slot_id", reason.alias("reason"))


def refusal(support: DataFrame, requested: bool = False) -> str | None:
    """V2: why an answer must be refused: deleted_state, unsupported_state or no_evidence, by the worst slot."""
    names = {"deleted": "deleted_state", "unsupported": "unsupported_state", "no_evidence": "no_evidence"}
    held = {r["state"] for r in support.select("state").distinct().collect()} | {aggregate_state(support)}  # four states at most
    return next((why for state, why in names.items() if state in held), "requested" if requested else None)


def finalize(answer: DataFrame, support: DataFrame, spans: DataFrame, refuse: bool = False) -> dict:
    """V2: the disposition, the claims that stand, and every claim's check. An answer is as long as its reader bears."""
    rows = check_answer(answer, support, spans).orderBy("claim").collect()
    if refuse:
        return {"disposition": "refuse", "claims": [], "refusal_reason": refusal(support, True), "checks": [(r["claim"], "refusal_contains_claims") for r in rows]}
    good = [r["claim"] for r in rows if r["reason"] is None]
    why = None if good else refusal(support) or "no_supported_claims"
    return {"disposition": "answer" if good else "refuse", "claims": good, "refusal_reason": why, "checks": [(r["claim"], r["reason"]) for r in rows]}


def validate(answer: DataFrame, support: DataFrame, spans: DataFrame) -> None:
    """V1: the first violation, by claim, fails the whole answer."""
    bad = check_answer(answer, support, spans).where("reason is not null").orderBy("claim").limit(1).collect()
    if bad:
        raise ValueError(f"claim {bad[0]['claim']}: {bad[0]['reason']}")
