"""Registered queries on tables that the small test data does not have."""

from pyspark.sql import functions as F

from tempora.functions import scalars as S
from tempora.operators import claims as C
from tempora.plans import registry


def test_proof_targets_keeps_keys_of_seven_digits_apart(spark, tmp_path):
    rows = [(k, size) for size in (1, 2, 5) for k in range(1_000_000 + 100 * size, 1_000_000 + 100 * size + 25)]
    spark.createDataFrame(rows, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    out = {tuple(r) for r in registry.QUERIES["proof_targets"](spark, str(tmp_path)).collect()}
    assert out == {("0", False, 1, 25, 25), ("1", False, 1, 25, 0)}


def test_selectors_meet_only_texts_with_a_word_of_theirs(spark, tmp_path):
    selectors = ["Than  THE heron", "one", " two words ", "a b", "", None, "   ", "x\ny heron\nz q", "ße straße Ñandú", "aa bb  cc", " the the the "]
    texts = [None, "", "than  the heron", "athan  the herons", "than the heron", "phone two wordsmith", "cara ba b", "1x\ny heron\nz q1", "große straße ñandúes", "daa bb  ccd", "aa  bb cc", "the the the", "than  the heron"]
    s = spark.createDataFrame([(i, t) for i, t in enumerate(selectors)], "item_id long, text string")
    t = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, body string")
    want = sorted(tuple(r) for r in t.join(s, S.selector_match(F.col("text"), F.col("body"))).select("item_id", "doc_id").collect())
    assert sorted(tuple(r) for r in C.selector_join(t, s, "text", "body").select("item_id", "doc_id").collect()) == want and len(want) > 10
    two = t.withColumn("other", F.when(F.col("doc_id") % 2 == 0, F.reverse("body")).otherwise(F.lit("Than  the HERON")))
    want = sorted(tuple(r) for r in two.join(s, S.selector_match(F.col("text"), F.col("body"), F.col("other"))).select("item_id", "doc_id").collect())
    assert sorted(tuple(r) for r in C.selector_join(two, s, "text", "body", "other").select("item_id", "doc_id").collect()) == want

    s.where("text is not null").write.parquet(f"{tmp_path}/benchmark.parquet")
    t.withColumnRenamed("body", "text").write.parquet(f"{tmp_path}/documents.parquet")
    out = registry.QUERIES["selector_theta_join"](spark, str(tmp_path))
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.item_id: r.n_docs for r in out.collect()}[0] == 3  # twice as it is, once within longer words


def test_same_instant_deals_rows_by_their_number(spark, monkeypatch):
    rows = [(k, 1, 1, None, seq, "ab"[(k * seq) % 3 == 0]) for k in range(300) for seq in range(4)]
    df = spark.createDataFrame(rows, "slot_id long, observed_at_ms long, valid_from_ms long, valid_to_ms long, source_sequence_no long, object_value string")
    value = {(r[0], r[4]): r[5] for r in rows}
    want = sorted((k, seq) for k, seq in value if value[k, seq] != value[k, 3])
    few = C.same_instant(df, ["slot_id"])
    monkeypatch.setattr(C, "ROWS_A_TASK", 100)
    many = C.same_instant(df, ["slot_id"])
    assert str(many._jdf.queryExecution().executedPlan()).count("Exchange") == 1  # the window takes the rows as dealt
    assert many.rdd.getNumPartitions() == 12
    for out in (few, many):
        assert sorted((r.slot_id, r.source_sequence_no) for r in out.collect()) == want and want
