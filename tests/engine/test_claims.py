import random

from pyspark.sql import functions as F

from tempora.operators import claims as C
from tempora.operators import graph as G
from tempora.operators import maintenance as M
from tempora.operators import retrieval as R

CLAIM = "id string, subject string, predicate string, object_value string, claim_text string, claim_kind string, polarity string, status string, observed_at_ms long, valid_from_ms long, valid_to_ms long, source_sequence_no long, asserted_by string, slot_id string, slot_facet string"
CORRECTION = "id string, status string, operation string, target_type string, target_match string, target_ids array<string>, target_subject_key string, target_predicate_key string, target_selector string, effective_at_ms long, source_sequence_no long"


def claim(i, value, at, seq=None, slot="s", kind="fact", end=None):
    return (i, "User", "city", value, f"text {value}", kind, "affirmative", "active", at, at, end, seq, "user", slot, None)


def test_newest_wins_equals_the_pairwise_rule(spark):
    rng = random.Random(2)
    rows = [claim(f"c{i:03d}", str(rng.randint(0, 3)), rng.randint(0, 3), rng.randint(0, 3), slot=f"s{rng.randint(0, 5)}") for i in range(80)]
    df = spark.createDataFrame(rows, CLAIM)
    a = {r.id for r in C.resolve_current(df).collect()}
    b = {r.id for r in C.resolve_fold(df).collect()}
    assert a == b and len(a) == len({r[13] for r in rows})


def test_set_kinds_keep_a_row_per_value(spark):
    df = spark.createDataFrame([claim("a", "X", 1, 1, kind="event"), claim("b", "x ", 2, 2, kind="event"), claim("c", "Y", 3, 3, kind="event")], CLAIM)
    assert {r.id for r in C.resolve_current(df).collect()} == {"b", "c"}
    row = C.set_members(df, ["slot_id"]).first()
    assert row.members == ["X", "Y"] and row.observed_at_ms == 3


def test_corrections_last_effect_wins(spark):
    df = spark.createDataFrame([claim("a", "v", 1), claim("b", "w", 5)], CLAIM)
    base = lambda i, op, at, ids=(), match="claim_versions", sel=None: (i, "active", op, "claim", match, list(ids), "user", "city", sel, at, None)
    cor = spark.createDataFrame([base("r1", "retract", 2, ["a"]), base("r2", "restore", 3, ["a"]), base("r3", "tombstone", 4, match="canonical_slot"), base("r4", "assert", 9, ["b"]), base("r5", "forget", 6, sel=" W ")], CORRECTION)
    out = {r.id: r.status for r in C.apply_corrections(df, cor).collect()}
    assert out == {"a": "tombstoned", "b": "redacted"}
    early = {r.id: r.status for r in C.apply_corrections(df, cor, at=3).collect()}
    assert early == {"a": "active", "b": "active"}


def test_history_drops_repeats(spark):
    df = spark.createDataFrame([claim("a", "1", 1, 1), claim("b", "1", 2, 2), claim("c", "2", 3, 3), claim("d", "1", 4, 4)], CLAIM)
    out = C.history(df, ["slot_id"], [F.col("valid_from_ms")], F.col("object_value")).orderBy("id").collect()
    assert [r.id for r in out] == ["a", "c", "d"]


def test_expand_gives_each_edge_once(spark):
    edges = spark.createDataFrame([("e1", "a", "b", 1.0), ("e2", "b", "c", 0.5), ("e3", "c", "a", None), ("e4", "c", "d", -1.0)], "id string, src string, dst string, confidence double")
    out = {r.id: (r.depth, r.score) for r in G.expand(edges, spark.createDataFrame([("a",)], "entity string"), 3).collect()}
    assert out == {"e1": (1, 1.0), "e3": (1, 1.0), "e2": (2, 0.25), "e4": (2, 0.0)}


def test_closure(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(5)] + [("n5", "n0")], "src string, dst string")
    out = {r.node: r.hop for r in G.closure(edges, spark.createDataFrame([("n5",)], "node string"), 3).collect()}
    assert out == {"n5": 0, "n4": 1, "n3": 2, "n2": 3}


def test_greedy_packing_skips_and_clips(spark):
    df = spark.createDataFrame([("q", 1, "a b c"), ("q", 2, "a b c d e f"), ("q", 3, "x y"), ("z", 1, "one two three four five six")], "k string, n int, text string")
    out = {(r.k, r.n): r.tokens for r in M.pack_greedy(df, 5, "k", "n").collect()}
    assert out[("q", 1)] == 3 and out[("q", 3)] == 2 and ("q", 2) not in out and out[("z", 1)] <= 5


def test_metrics(spark):
    hits = spark.createDataFrame([("q", "miss", 0), ("q", "g1", 1), ("q", "g2", 2)], "query string, id string, rank int")
    rel = spark.createDataFrame([("q", "g1"), ("q", "g2")], "query string, id string")
    r = M.metrics(hits, rel, 3).first()
    assert (r.recall, r.reciprocal_rank) == (1.0, 0.5)


def test_neighbors_once_each(spark):
    spans = spark.createDataFrame([("s", i, f"i{i}") for i in range(6)], "source_id string, span_index int, id string")
    hits = spark.createDataFrame([("s", 1, 0, 1.0), ("s", 2, 1, 0.8)], "source_id string, span_index int, rank int, score double")
    out = sorted((r.span_index, r.rank) for r in R.neighbors(hits, spans, 1, 1).collect())
    assert out == [(0, 0), (1, 0), (2, 0), (3, 1)]


def test_leases_respect_the_order_of_a_scope(spark):
    jobs = spark.createDataFrame([("a", "t", 1, "failed", 0, None), ("b", "t", 2, "pending", 0, None), ("c", "u", 1, "leased", 0, 5), ("d", "u", 2, "pending", 0, None), ("e", None, 1, "pending", 0, None)], "id string, thread_id string, sequence_no int, status string, attempt_count int, lease_expires_at_ms long")
    assert {r.id for r in M.leasable(jobs, 10, 3).collect()} == {"c", "e"}
    assert {r.id for r in M.leasable(jobs, 10, 1).collect()} == {"e"}


def test_strip_ids_drops_what_is_left_empty(spark):
    rows = spark.createDataFrame([("r1", ["a", "b"], []), ("r2", ["a"], []), ("r3", ["a"], ["c"])], "id string, x array<string>, y array<string>")
    out = {r.id: (r.x, r.y) for r in M.strip_ids(rows, spark.createDataFrame([("a",)], "id string"), ["x", "y"]).collect()}
    assert out == {"r1": (["b"], []), "r3": ([], ["c"])}
