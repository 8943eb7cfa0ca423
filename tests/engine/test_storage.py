import pytest
from pyspark.sql import functions as F

from tempora.sources import storage as S
from tempora.streaming import ingest as I

SCHEMA = "tenant_id string, id string, v string, n long"


def rows(spark, *items):
    return spark.createDataFrame(list(items), "tenant_id string, id string, v string, n long")


@pytest.fixture
def store(spark, tmp_path):
    return S.Store.create(spark, str(tmp_path), "st", {"t": rows(spark, ("", "", "", 0)).schema})


def values(df):
    return {r.id: r.v for r in df.collect()}


def test_insert_upsert_delete(spark, store):
    out = store.insert("t", rows(spark, ("x", "a", "1", 2), ("x", "a", "0", 1), ("x", "b", "1", 1)), "n")
    assert {r.id: r.inserted for r in out.collect()} == {"a": True, "b": True} and values(store.table("t")) == {"a": "0", "b": "1"}
    out = store.insert("t", rows(spark, ("x", "a", "9", 1), ("x", "c", "1", 1)))
    assert {r.id: r.inserted for r in out.collect()} == {"a": False, "c": True}
    snap = store.snapshot()
    store.upsert("t", rows(spark, ("x", "a", "7", 1), ("x", "a", "8", 2)), "n")
    assert store.delete("t", "id = 'b'") == 1
    assert values(store.table("t")) == {"a": "8", "c": "1"} and values(snap.table("t")) == {"a": "0", "b": "1", "c": "1"}
    assert [r.id for r in store.scan("t", "v != '0'", 1).collect()] == ["c"]
    assert values(store.fetch("t", spark.createDataFrame([("a",), ("z",)], "id string"))) == {"a": "8"}
    store.compact("t")
    assert values(store.table("t")) == {"a": "8", "c": "1"}
    with pytest.raises(ValueError):
        store.delete("t", " ")


def test_open_create_drop(spark, tmp_path):
    with pytest.raises(S.NotFound):
        S.Store.open(spark, str(tmp_path), "none")
    s = S.Store.create(spark, str(tmp_path), "one", S.schemas())
    with pytest.raises(S.AlreadyExists):
        S.Store.create(spark, str(tmp_path), "one", {})
    assert S.Store.open(spark, str(tmp_path), "one").table("claims").count() == 0
    s.drop()
    with pytest.raises(S.NotFound):
        S.Store.open(spark, str(tmp_path), "one")


def test_tenants_are_apart(spark, tmp_path):
    s = S.Store.create(spark, str(tmp_path), "iso", {"t": rows(spark, ("", "", "", 0)).schema}, tenant_isolation=True)
    s.commit({"t": rows(spark, ("x", "a", "1", 1), ("y", "b", "1", 1)).withColumn(S.OP, F.lit("put"))})
    with pytest.raises(S.PermissionDenied):
        s.table("t")
    assert set(values(s.table("t", "x"))) == {"a"}


def test_streamed_episodes(spark, tmp_path):
    s = S.Store.create(spark, str(tmp_path / "st"), "ep", S.schemas())
    src = spark.createDataFrame([("e1", "sp", 1, "user", 10, None, "x" * 1500), ("e2", "sp", 2, "user", 20, None, "hi")], "id string, space_id string, sequence_no long, actor_kind string, event_time_ms long, valid_from_ms long, raw_text string")
    src.write.parquet(str(tmp_path / "in"))
    q = I.stream_episodes(s, spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert s.table("episodes").count() == 2 and s.table("spans").count() == 3 and s.table("extraction_jobs").count() == 2
    I.append_episodes(s, src)
    assert s.table("episodes").count() == 2
