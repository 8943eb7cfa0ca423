import pytest
from pyspark.sql import functions as F

from tempora.api import Memory
from tempora.operators import answers as A
from tempora.operators import context as X
from tempora.operators import erasure as D
from tempora.operators import rules as U
from tempora.operators import sources as SR
from tempora.operators import timeline as TL


def test_read_plan():
    assert A.read_plan([{"slot_id": "a"}, {"slot_id": "b", "view": "set", "role": "supporting"}]) == ({"a": "current", "b": "set"}, {"a"})
    for bad in ([{"slot_id": "a"}, {"slot_id": "a", "view": "set"}], [{"slot_id": "a", "role": "supporting"}], [{"slot_id": "a", "view": "x"}]):
        with pytest.raises(ValueError):
            A.read_plan(bad)
    assert A.read_plan([{"slot_id": "a", "role": "supporting"}], ["b"])[1] == {"b"}


def test_reserve():
    items = [("state_resolved", 30), ("state_current", 40), ("raw", 10), ("raw", 20)]
    assert X.raw_reserve(items, 100, 2, 0) == 30  # all evidence fits in its half
    assert X.raw_reserve(items, 100, 2, 1) == 30 and X.raw_reserve(items, 20, 2, 0) == 10
    assert X.raw_reserve(items[:2], 100, 2, 0) == 0


def test_state_items_leave_room_and_cards_yield(spark):
    word = lambda n: " ".join(["w"] * n)
    rows = [("r", "a", "state_current", 0, word(50), False, "k"), ("r", "card", "state_entity_card", 1, word(2), False, "k"), ("r", "b", "state_current", 2, word(30), False, "l"), ("r", "e", "raw", 3, word(40), True, None)]
    items = spark.createDataFrame(rows, "request string, id string, kind string, place long, rendered string, raw boolean, subject_key string")
    got = X.pack_state(items, 100).orderBy("place").collect()
    assert [r.id for r in got] == ["a", "e"] and all(r.truncated for r in got)


def test_finalising(spark):
    support = spark.createDataFrame([("s", "supported", ["p1"]), ("d", "deleted", ["p2"])], "slot_id string, state string, source_span_ids array<string>")
    spans = spark.createDataFrame([("p1", "The office is in Rome."), ("p2", "x")], "span_id string, text string")
    cols = "claim int, slot_id string, text string, evidence array<struct<span_id:string,quote:string>>"
    answer = spark.createDataFrame([(0, "s", "Rome", [("p1", "in Rome")]), (1, "d", "x", [("p2", "x")]), (2, None, "x", [])], cols)
    out = A.finalize(answer, support, spans)
    assert out == {"disposition": "answer", "claims": [0], "refusal_reason": None, "checks": [(0, None), (1, "deleted_slot"), (2, "ambiguous_slot")]}
    with pytest.raises(ValueError):
        A.validate(answer, support, spans)
    A.validate(answer.where("claim = 0"), support, spans)
    bad = A.finalize(answer.where("claim = 1"), support, spans)
    assert bad["disposition"] == "refuse" and bad["refusal_reason"] == "deleted_state"
    assert A.finalize(answer, support, spans, refuse=True)["checks"][0] == (0, "refusal_contains_claims")
    only = support.where("slot_id = 's'")  # a claim without a slot answers from the only one
    assert [r.reason for r in A.check_answer(answer.where("claim = 2"), only, spans).collect()] == ["missing_evidence"]


def test_renderers(spark):
    rows = spark.createDataFrame([("c", "active", "affirmative", "user", "fact", "Bo", "city", "Rome"), ("d", "tombstoned", "affirmative", "user", "fact", "Bo", None, "Rome"), ("e", "active", "uncertain", "user", "fact", "Bo", "city", "Rome")], "id string, status string, polarity string, asserted_by string, claim_kind string, subject string, predicate string, object_value string")
    got = {r.id: r.t for r in rows.select("id", X.render_claim().alias("t")).collect()}
    assert got["c"] == "### CurrentState c\nslot: Bo / city\nvalue: Rome\n"
    assert got["d"] == "### TombstoneState d\nslot: Bo / \nsupport_state: deleted\ncurrent_value: null\nhistorical_evidence_is_current: false\n"
    assert got["e"].startswith("### UnsupportedState e\nslot: Bo / city\nsupport_state: unsupported\n")
    cor = spark.createDataFrame([("k", "forget", None, "city", "secret", "secret")], "id string, operation string, target_subject_key string, target_predicate_key string, target_selector string, new_value string")
    text = cor.select(X.render_correction().alias("t")).first().t
    assert text.startswith("### TombstoneState k\ntarget_slot: unknown / city\n") and "secret" not in text
    hist = spark.createDataFrame([("s", 0, "current", 'a"b', None, "Bo", "city", 5, 5, None)], "slot_id string, n int, state_kind string, object_value string, members array<string>, subject string, predicate string, observed_at_ms long, valid_from_ms long, valid_to_ms long")
    assert X.render_history(hist).first().rendered == '### SlotHistory s\nslot: Bo / city\nauthoritative_current_value: false\nversions_oldest_to_newest:\n- state_kind: current; value: "a\\"b"; members: []; observed_at_ms: 5; valid_from_ms: 5; valid_to_ms: \n'


RULE = "id string, space_id string, status string, trigger_subject string, trigger_predicate string, trigger_slot_id string, target_subject string, target_predicate string, target_slot_id string, activation string, action string, value string, value_template string, source_sequence_no long, valid_from_ms long, valid_to_ms long"
CLAIM = "id string, slot_id string, subject string, predicate string, object_value string, status string, polarity string, asserted_by string, claim_kind string, observed_at_ms long, valid_from_ms long, valid_to_ms long, source_sequence_no long"


def rule(i, a, b, activation="continuous_projection", action="derive_value", value=None, template=None, start=0):
    return (i, "s", "active", a, "is", a, b, "is", b, activation, action, value, template, 1, start, None)


def claim(i, slot, value, at, seq=1, status="active", by="user"):
    return (i, slot, slot, "is", value, status, "affirmative", by, "fact", at, at, None, seq)


def test_chains_complete_at_read_time(spark):
    rules = spark.createDataFrame([rule("r1", "a", "b", template="<{value}>"), rule("r2", "b", "c"), rule("r3", "a", "b", "on_change", "mark_unsupported"), rule("r4", "never", "d", start=50)], RULE)
    claims = spark.createDataFrame([claim("c0", "a", "x", 5), claim("c1", "a", "y", 10), claim("c2", "b", "old", 1), claim("c4", "d", "known", 20)], CLAIM)
    now = claims.where("id <> 'c0'")
    out = {(r.rule_id, r.target_slot_id): (r.status, r.value, r.hop) for r in U.complete(rules, now).collect()}
    assert out["r1", "b"] == ("applied_derived", "<y>", 1) and out["r2", "c"][0] == "applied_derived"
    assert ("c", "<y>") in {(t, v) for (_, t), (_, v, _) in out.items()} or out["r2", "c"][1] in ("<y>", "old")
    assert out["r4", "d"] == ("applied_unsupported", None, 0)
    later = now.union(spark.createDataFrame([claim("c5", "d", "again", 60)], CLAIM)).where("id <> 'c4'")
    assert not [r for r in U.complete(rules, later).collect() if r.rule_id == "r4"]  # asserted by itself after the rule began
    marked = U.without_redundant_marks(U.fire(U.activation(claims, rules), now), rules).where("status = 'applied_unsupported'")
    assert marked.where("rule_id = 'r3'").count() == 0  # r1 derives the same target from the same change


def test_new_rule_and_checks(spark):
    rules = spark.createDataFrame([rule("r", "a", "b", start=7)], RULE)
    claims = spark.createDataFrame([claim("c0", "a", "x", 5), claim("c1", "a", "y", 10)], CLAIM)
    assert [(r.trigger_id, r.status) for r in U.new_rule_triggers(rules, claims).collect()] == [("c0", "applied_derived")]
    rows = rules.withColumn("source_span_ids", F.array(F.lit("s"))).withColumn("source_episode_ids", F.array(F.lit("e")))
    assert U.checked_rules(rows).first().problem is None
    assert U.checked_rules(rows.withColumn("action", F.lit("mark_unsupported"))).first().problem == "continuous_mark"
    assert U.checked_rules(rows.withColumn("source_span_ids", F.expr("cast(array() as array<string>)"))).first().problem == "needs_evidence"


def test_write_keys_do_not_depend_on_order(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "id string"), spark.createDataFrame([("y",), ("x",)], "id string")
    assert TL.write_key("s", a, b) == TL.write_key("s", b, a) != TL.write_key("t", a, b)
    assert TL.write_key("s", a, a.limit(1)) != TL.write_key("s", a, b)


def test_traces_are_reconciled(spark):
    cols = "id string, trace_key string, status string, target_slot_id string, derived_claim_id string, observed_at_ms long, valid_from_ms long, valid_to_ms long, recorded_at_ms long, superseded_at_ms long"
    stored = spark.createDataFrame([("t1", "k1", "active", "s", "d1", 1, 1, None, 1, None), ("t2", "k2", "active", "s", "d2", 1, 1, None, 1, None), ("t3", "k3", "active", "s", "d3", 1, 1, None, 1, None)], cols)
    incoming = spark.createDataFrame([("n1", "k1", "active", "s", "d1", 1, 1, None, 2, None), ("n4", "k4", "active", "s", "d4", 9, 9, None, 2, None)], cols)
    new, gone, past = TL.reconcile_traces(stored, incoming, spark.createDataFrame([("d3",)], "id string"), 5, "w")
    assert [r.trace_key for r in new.collect()] == ["k4"]
    assert [r.id for r in gone.collect()] == ["t2"]  # k3 derives a claim that is still active
    assert [(r.trace_key, r.valid_from_ms, r.valid_to_ms) for r in past.collect()] == [("k2", 1, 9)]


def test_derivations_are_followed_to_their_end(spark):
    n = 12
    traces = spark.createDataFrame([(f"c{i}", f"c{i + 1}", "r") for i in range(n)] + [("z", "q", "bad")], "trigger_claim_id string, derived_claim_id string, rule_id string")
    ids = lambda *x: spark.createDataFrame([(v,) for v in x], "id string")
    got = {r.id for r in D.derived_closure(traces, ids("c0"), ids("bad")).collect()}
    assert got == {f"c{i}" for i in range(n + 1)} | {"q"}


def test_supplemental_round_leaves_out_chosen_sources(spark):
    hits = spark.createDataFrame([("a1", "a", 1, 0.9, 0), ("b0", "b", 0, 0.5, 1)], "id string, source_id string, span_index int, score double, rank int")
    registry = spark.createDataFrame([(s, [f"{s}{i}" for i in range(4)]) for s in "abc"], "source_id string, span_ids array<string>")
    spans = registry.select(F.explode("span_ids").alias("id")).where("id <> 'a2'")  # one that a correction hides
    more = spark.createDataFrame([("a", 0), ("c", 1)], "source_id string, rank int")
    out = SR.source_diverse_search(hits, [], registry, spans, max_sources=2, spans_per_source=3, supplemental=[more], supplemental_sources=5, supplemental_spans=2).collect()
    by = {}
    for r in sorted(out, key=lambda r: r.rank_in_source):
        by.setdefault(r.plan_rank, []).append(r.id)
    assert by == {0: ["a1", "a0"], 1: ["b0", "b1", "b2"], 2: ["c0", "c1"]}


def test_a_batch_is_applied_whole_or_not_at_all(spark, tmp_path):
    m = Memory.create(spark, str(tmp_path), "batch")
    scope = {"space": "team"}
    m.ingest_episode({"scope": scope, "id": "e1", "text": "The office is in Rome.", "event_time_ms": 10, "sequence_no": 3})
    span = m.read("spans", scope).first().id
    one = {"id": "c1", "subject": "Office", "predicate": "city", "object_value": "Rome", "observed_at_ms": 10, "span_ids": [span], "episode_ids": ["e1"]}
    (job,) = m.lease_jobs(20, "w")
    out = m.apply_batch(scope, [one], job_id=job, worker="w", now_ms=30)
    assert out["claims"] == 1 and out["state_records"] == 1 and m.backlog(scope)["n_jobs"] == 0
    stored = m.read("claims", scope).first()
    assert stored.source_sequence_no == 3 and stored.slot_id.startswith("slot_")
    with pytest.raises(ValueError):
        m.apply_batch(scope, [{**one, "id": "c2", "span_ids": ["none"]}], now_ms=40)
    assert m.read("claims", scope).count() == 1
    m.apply_batch(scope, [{**one, "id": "c3", "object_value": "Oslo", "observed_at_ms": 50}], now_ms=60)
    live = m.read("state_records", scope).where("superseded_at_ms is null").collect()
    assert {(r.object_value, r.valid_to_ms) for r in live} == {("Rome", 50), ("Oslo", None)}
    with pytest.raises(ValueError):
        m.apply_batch(scope, corrections=[{"operation": "retract", "target_ids": ["nobody"], "effective_at_ms": 70}], now_ms=70)
    read = m.answer_state(scope, "Which city is the office in?", valid_at=100)
    row = read["slots"].first()
    assert row.support_state == "supported" and row.current_value == "Oslo"
    erased = m.erase_episodes(scope, ["e1"])
    assert erased["claims"] == 2 and erased["spans"] == 1 and m.read("claims", scope).count() == 0 and m.read("state_records", scope).count() == 0


def test_forgotten_values_leave_the_store(spark, tmp_path):
    m = Memory.create(spark, str(tmp_path), "forget")
    scope = {"space": "team"}
    m.ingest_episode({"scope": scope, "id": "e1", "text": "The code is swordfish, keep it.", "event_time_ms": 10})
    span = m.read("spans", scope).first().id
    m.apply_batch(scope, [{"id": "c1", "subject": "door", "predicate": "code", "object_value": "swordfish", "observed_at_ms": 10, "span_ids": [span], "episode_ids": ["e1"]}], now_ms=20)
    m.add_correction({"scope": scope, "id": "k", "operation": "forget", "target_ids": ["c1"], "effective_at_ms": 30, "target_selector": "swordfish"})
    out = m.purge_forgotten(scope, 100)
    assert out["claims"] == 1 and out["markers"] == 1 and out["redacted_spans"] == 1
    for table, column in (("spans", "text"), ("episodes", "raw_text"), ("claims", "object_value"), ("corrections", "target_selector"), ("state_records", "object_value")):
        assert not [r for r in m.read(table, scope).select(column).collect() if r[0] and "swordfish" in r[0]], table
    assert m.read("claims", scope).first().status == "tombstoned"
    assert m.purge_forgotten(scope, 100)["claims"] == 0


def test_entities_rules_and_aliases(spark, tmp_path):
    m = Memory.create(spark, str(tmp_path), "ents")
    scope = {"space": "team"}
    m.add_claims([{"scope": scope, "id": f"c{i}", "subject": s, "predicate": "city", "object_value": v, "observed_at_ms": i} for i, (s, v) in enumerate([("office", "Rome"), ("depot", "Oslo")])])
    e = m.add_entity({"scope": scope, "name": "Acme", "aliases": ["ACME Corp"], "claim_ids": ["c0"]})
    assert m.add_entity({"scope": scope, "name": "acme corp", "aliases": ["Acme Inc"], "claim_ids": ["c1"]}) == e
    row = m.read("entities", scope).first()
    assert row.canonical_name == "Acme" and set(row.aliases) == {"ACME Corp", "Acme Inc", "acme corp"} and row.source_claims == ["c0", "c1"]
    r = m.add_rule({"scope": scope, "trigger": {"subject": "Office", "predicate": "city"}, "target": {"subject": "depot", "predicate": "City"}, "action": "derive_value", "span_ids": ["s"], "episode_ids": ["e"]})
    rule_row = m.read("rules", scope).where(F.col("id") == r).first()
    assert rule_row.trigger_binding_status == "bound" and rule_row.trigger_slot_id == m.get_claim(scope, "c0")["slot_id"]
    with pytest.raises(ValueError):
        m.add_rule({"scope": scope, "trigger": {"subject": "a", "predicate": "b"}, "target": {"subject": "c", "predicate": "d"}, "action": "derive_value"})
    slot = m.get_claim(scope, "c0")["slot_id"]
    assert m.add_slot_alias({"scope": scope, "subject": "HQ", "predicate": "town", "slot_id": slot, "claim_ids": ["c0"]})
    for bad in ({"claim_ids": ["nope"], "slot_id": slot}, {"claim_ids": ["c0"], "slot_id": "nowhere"}):
        with pytest.raises(ValueError):
            m.add_slot_alias({"scope": scope, "subject": "HQ", "predicate": "place", **bad})
    m.add_profile({"scope": scope, "subject_id": e, "key": "k", "text": "t", "claim_ids": ["c0"]})
    m.add_edge({"scope": scope, "src": e, "dst": "x", "relation": "near"})
    assert m.read("profiles", scope).count() == m.read("edges", scope).count() == 1
