from tempora.api import Memory


def test_a_memory_from_end_to_end(spark, tmp_path):
    m = Memory.create(spark, str(tmp_path), "mem")
    team = {"space": "team"}
    m.ingest_episode({"scope": team, "text": "Payments go through Stripe.", "event_time_ms": 10})
    m.ingest_episode({"scope": team, "text": "The office is in Toronto.", "event_time_ms": 20})
    hits = m.search(team, "payments").collect()
    assert len(hits) == 1 and hits[0].score > 0
    assert m.search({"space": "other"}, "payments").count() == 0
    m.add_claims([{"scope": team, "id": f"c{i}", "subject": "office", "predicate": "city", "object_value": v, "observed_at_ms": t} for i, (v, t) in enumerate([("Toronto", 100), ("Vancouver", 200)])])
    assert [r.object_value for r in m.list_claims(team).collect()] == ["Vancouver"]
    assert [r.object_value for r in m.list_claims(team, 150).collect()] == ["Toronto"]
    m.add_correction({"scope": team, "operation": "retract", "target_ids": ["c1"], "effective_at_ms": 300})
    assert [r.object_value for r in m.list_claims(team).collect()] == ["Toronto"]
    assert m.backlog(team)["n_jobs"] == 2
    leased = m.lease_jobs(1000, "w", 50, limit=5)
    assert len(leased) == 1
    m.complete_job(leased[0], "w")
    assert m.backlog(team)["n_jobs"] == 1
    assert m.pack_context(team, "office toronto", 50).count() == 1
    assert m.erase_scope(team)["claims"] == 2 and m.list_claims(team).count() == 0
