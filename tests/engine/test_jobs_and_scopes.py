import json
import threading

import pytest
from pyspark.sql import functions as F

from tempora.api import Memory
from tempora.functions import scalars as S
from tempora.sources import storage as ST
from tempora.streaming import ingest as I


@pytest.fixture
def memory(spark, tmp_path):
    return Memory.create(spark, str(tmp_path), "mem")


def test_spans_and_jobs_inherit_the_whole_scope(memory):
    narrow = {"space": "team", "project": "p1", "agent": "a"}
    memory.ingest_episode({"scope": narrow, "text": "Payments go through Stripe.", "event_time_ms": 10})
    assert memory.search(narrow, "payments").count() == 1 and memory.search({"space": "team"}, "payments").count() == 1
    assert memory.search({"space": "team", "project": "p2"}, "payments").count() == 0
    assert memory.backlog(narrow)["n_jobs"] == 1 and memory.backlog({"space": "team"})["n_jobs"] == 1 and memory.backlog({"space": "x"})["n_jobs"] == 0


def test_insert_after_delete_and_compaction(spark, tmp_path):
    schema = "id string, v string"
    s = ST.Store.create(spark, str(tmp_path), "st", {"t": spark.createDataFrame([], schema).schema})
    rows = lambda *x: spark.createDataFrame(list(x), schema)
    s.insert("t", rows(("a", "1"), ("b", "1")))
    assert s.delete("t", "id = 'a'") == 1
    assert {r.id: r.inserted for r in s.insert("t", rows(("a", "2"), ("b", "2"))).collect()} == {"a": True, "b": False}
    s.compact("t")
    plan = s.table("t")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan  # a compacted table is read as it is
    s.upsert("t", rows(("b", "3")))
    s.delete("t", "id = 'a'")
    s.insert("t", rows(("c", "4")))
    assert {r.id: r.v for r in s.table("t").collect()} == {"b": "3", "c": "4"}
    with s.read_cache() as cached:
        s.upsert("t", rows(("b", "5")))
        assert {r.id: r.v for r in cached.table("t").collect()} == {"b": "3", "c": "4"}
        assert cached.table("t") is cached.table("t")
    with pytest.raises(RuntimeError), s.mutation({"space_id": "s"}) as writes:
        writes["t"] = rows(("z", "1")).withColumn(ST.OP, F.lit("put"))
        raise RuntimeError
    assert s.scan("t", "id = 'z'").count() == 0


def test_job_transitions(memory):
    scope = {"space": "team"}
    for t in (1, 2):
        memory.ingest_episode({"scope": scope, "text": "x", "event_time_ms": t})
    (job,) = memory.lease_jobs(10, "w")
    with pytest.raises(ValueError):
        memory.complete_job(job, "other")
    memory.fail_job(job, "w", "bad")
    assert memory.lease_jobs(20, "w") == [] and memory.backlog(scope) | {"oldest_ms": 0} == {"n_jobs": 2, "n_failed": 1, "oldest_ms": 0}
    memory.retry_job(job)
    assert memory.lease_jobs(30, "w") == [job]
    memory.fail_job(job, "w", "bad")
    memory.skip_job(job)
    assert memory.backlog(scope)["n_jobs"] == 1
    (second,) = memory.lease_jobs(40, "w", lease_ms=10)
    assert second != job
    assert memory.lease_jobs(100, "v", lease_ms=10) == [second]  # an expired lease is taken over, and counts
    assert memory.lease_jobs(200, "v", lease_ms=10) == [second]
    assert memory.lease_jobs(300, "v") == [] and memory.backlog(scope)["n_failed"] == 1  # no attempt left
    with pytest.raises(KeyError):
        memory.complete_job("none", "w")
    with pytest.raises(ValueError):
        memory.retry_job(job)


def test_tenants_have_their_own_jobs(spark, tmp_path):
    m = Memory.create(spark, str(tmp_path), "iso", tenant_isolation=True)
    a = {"space": "s", "tenant": "a"}
    for _ in range(2):  # a replay changes nothing
        m.ingest_episode({"scope": a, "id": "e1", "text": "hello", "event_time_ms": 1})
    assert m.store.table("episodes", "a").count() == 1 and m.store.table("episodes", "b").count() == 0
    (job,) = m.lease_jobs(5, "w", tenant="a")
    m.complete_job(job, "w", a)
    m.ingest_episode({"scope": a, "id": "e1", "text": "hello", "event_time_ms": 1})
    assert m.backlog(a)["n_jobs"] == 0
    with pytest.raises(ST.PermissionDenied):
        m.lease_jobs(5, "w")


def test_scope_locks():
    broader, exact = ST.scope_lock_keys({"space_id": "s", "user_id": "u", "thread_id": "t"})
    assert len(broader) == 3 and exact not in broader
    locks, seen = ST.ScopeLocks(), []

    def write(name, scope, erase=False):
        with locks.held(scope, erase):
            seen.append(name)

    narrow = {"space_id": "s", "user_id": "u"}
    with locks.held({"space_id": "s"}, erase=True):
        t = threading.Thread(target=write, args=("narrow", narrow))
        t.start()
        t.join(0.2)
        assert seen == []
        other = threading.Thread(target=write, args=("other", {"space_id": "o"}))
        other.start()
        other.join(5)
        assert seen == ["other"]
    t.join(5)
    assert seen == ["other", "narrow"]
    with locks.held(narrow):
        t = threading.Thread(target=write, args=("sibling", {"space_id": "s", "user_id": "v"}))
        t.start()
        t.join(5)
        assert seen[-1] == "sibling"


def test_migration_fills_what_older_stores_lack(spark, tmp_path):
    tables = ST.schemas() | {"span_terms": spark.createDataFrame([], "id string, span_id string, term string").schema}
    s = ST.Store.create(spark, str(tmp_path), "old", tables)
    put = lambda table, df: s.commit({table: df.withColumn(ST.OP, F.lit("put"))})
    put("spans", spark.createDataFrame([("s1", "a b"), ("s2", "c")], "id string, text string"))
    put("span_terms", spark.createDataFrame([("1", "s1", "b"), ("2", "s1", "a")], "id string, span_id string, term string"))
    put("claims", spark.createDataFrame([("c1", ["z", "a"], ["a"])], "id string, source_span_ids array<string>, source_episode_ids array<string>"))
    put("state_records", spark.createDataFrame([("t1", "Big Apple")], "id string, state_text string"))
    s._publish(s._number() + 1, s.manifest() | {"version": 0})
    opened = ST.Store.open(spark, str(tmp_path), "old")
    assert opened.manifest()["version"] == 1
    assert {r.id: r.lexical_terms for r in opened.table("spans").collect()} == {"s1": ["a", "b"], "s2": None}
    assert opened.table("claims").first().evidence_ids == ["a", "z"] and opened.table("state_records").first().lexical_terms == ["apple", "big"]
    s._publish(s._number() + 1, s.manifest() | {"version": 9})
    with pytest.raises(NotImplementedError):
        ST.Store.open(spark, str(tmp_path), "old")
    with pytest.raises(ValueError):
        ST.StoreConfig("Bad Name")


def test_bulk_vectors_and_artifacts(spark, tmp_path):
    s = ST.Store.create(spark, str(tmp_path), "bulk", ST.schemas())
    ep = spark.createDataFrame([("e1", "sp", 1, 5, None, "word " * 400)], "id string, space_id string, sequence_no long, event_time_ms long, valid_from_ms long, raw_text string")
    vectors = lambda n: spark.createDataFrame([("e1", i, [float(i), 1.0]) for i in range(n)], "source_id string, span_index int, embedding array<float>")
    with pytest.raises(ValueError):
        I.append_episodes_with_embeddings(s, ep, vectors(1))
    assert s.table("episodes").count() == 0
    I.append_episodes_with_embeddings(s, ep, vectors(2))
    assert sorted(r.embedding[0] for r in s.table("spans").collect()) == [0.0, 1.0]
    I.append_vector_spans(s, spark.createDataFrame([("v1", "sp", "x", "hidden words", [1.0, 1.0])], "id string, space_id string, source_id string, text string, embedding array<float>"))
    m = Memory(s)
    assert m.search({"space": "sp"}, "hidden").count() == 0 and m.search({"space": "sp"}, "", 2, "vector", [1.0, 1.0]).count() == 2
    assert [r.id for r in m.search({"space": "sp"}, "word", 5, "hybrid", [1.0, 1.0]).collect()]
    art = m.ingest_artifact({"scope": {"space": "sp", "user": "u"}, "title": "T", "uri": "file:a", "text": "zebra crossing"})
    assert m.search({"space": "sp", "user": "u"}, "zebra").count() == 1 and m.read("artifacts", {"space": "sp"}).first().id == art["id"]
    assert m.backlog({"space": "sp"})["n_jobs"] == 1


def test_times():
    from datetime import datetime, timezone

    assert S.to_millis(None) is None and S.to_millis(5) == 5 and S.to_millis("1970-01-01T00:00:01Z") == 1000
    assert S.to_millis(datetime(1970, 1, 1, 0, 0, 2)) == S.to_millis(datetime(1970, 1, 1, 0, 0, 2, tzinfo=timezone.utc)) == 2000


def test_text_facade(memory):
    payload = json.dumps({"items": [{"scope": {"space": "s"}, "id": "c1", "subject": "office", "predicate": "city", "object_value": "Rome", "observed_at_ms": 5}]})
    assert json.loads(memory.call("add_claims", payload)) == ["c1"]
    rows = json.loads(memory.call("list_claims", json.dumps({"scope": {"space": "s"}})))
    assert rows[0]["object_value"] == "Rome" and memory.get_claim({"space": "s"}, "c1")["subject"] == "office" and memory.get_claim({"space": "s"}, "c2") is None
    with pytest.raises(ValueError):
        memory.call("_rows", "{}")
