"""Queries of the answer-ready read, context packing, answer checks, timelines, erasure and source-diverse search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import answers as A
from ..operators import context as X
from ..operators import erasure as D
from ..operators import lexical_index as LI
from ..operators import sources as SR
from ..operators import timeline as TL
from ..sources import tables as T
from .registry import query, shared
from .scan_queries import NONE, _part_claims, _rules, _slots, _states

DAY = T.DAY_MS


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return T.read(spark, d, "customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("ent_"), "c_custkey").alias("id"), F.concat(F.lit("Customer "), "c_custkey").alias("canonical_name"), F.array(F.concat(F.lit("Client "), "c_custkey")).alias("aliases"))


QUESTION = "What about the 1-urgent of customer 7, client 9 and customer 12?"
ASSESSED = """WITH s AS (SELECT o_orderkey AS k, o_custkey AS c, lower(o_orderpriority) AS p, o_orderdate AS t, o_orderkey % 5 AS kind FROM orders),
f AS (SELECT *, c IN (7, 20) AS pref, (k % 40 = 3 AND c = 30) OR c = 31 AS ev, c IN (9, 12) AND c % 3 = 0 AS ent, c IN (7, 12) AS subj, c = 30 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = 30 AND o_orderkey % 40 = 3) AS linked FROM s),
g AS (SELECT *, 8 * CAST(pref AS INTEGER) + 6 * CAST(ev AS INTEGER) + 4 * CAST(p = '1-urgent' AND (ent OR subj OR linked) AS INTEGER) + 2 * CAST(kind = 4 AND (ent OR subj) AS INTEGER) AS score FROM f)"""


def _assessed(spark: SparkSession, d: str) -> DataFrame:
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "id string")
    s = _states(spark, d)
    # only the state of customer 30 cites the evidence
    s = s.withColumn("source_spans", F.when(F.col("slot_id") == "slot_30", F.col("source_spans")).otherwise(F.expr(NONE)))
    return A.assess(s, QUESTION, preferred=ids("slot_7", "slot_20"), evidence_slots=ids("slot_31"), evidence_spans=ids("sp_3"), entities=_entities(spark, d))


@query(ASSESSED + " SELECT 'st_' || k AS id, score FROM g WHERE score > 0 ORDER BY score DESC, kind, t DESC, id LIMIT 40")
def read_selection(spark: SparkSession, d: str) -> DataFrame:
    """The states that a question is about, by their signals."""
    return A.select_states(_assessed(spark, d), 40).select("id", "score")


@query(
    ASSESSED
    + """, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, kind, t DESC, 'st_' || k) AS n FROM g WHERE c % 10 <> 8)
SELECT 'st_' || g.k AS id, CASE WHEN g.c % 10 = 8 THEN 'candidate_filtered' WHEN g.score > 0 AND r.n <= 25 THEN 'selected' WHEN g.score = 0 THEN 'no_selection_signal' ELSE 'claim_limit' END AS disposition FROM g LEFT JOIN r ON r.k = g.k"""
)
def selection_trace(spark: SparkSession, d: str) -> DataFrame:
    eligible = _assessed(spark, d).where("cast(regexp_replace(slot_id, 'slot_', '') as long) % 10 <> 8")
    return A.selection_trace(_states(spark, d), eligible, A.select_states(eligible, 25)).select("id", "disposition")


@query("SELECT 'slot_' || c_custkey AS slot_key FROM customer WHERE c_custkey IN (7, 12) AND c_custkey IN (SELECT o_custkey FROM orders) UNION SELECT 'slot_9' WHERE 9 IN (SELECT o_custkey FROM orders)")
def named_slots(spark: SparkSession, d: str) -> DataFrame:
    """Slots of which a question names the predicate, and the subject or a name of its entity."""
    slots = _slots(spark, d).select("slot_key", "subject_key", "predicate_key", F.lit(None).cast("string").alias("subject"), "predicate").distinct()
    k = F.regexp_replace("slot_key", "slot_", "").cast("long")
    slots = slots.withColumn("subject_entity_id", F.when(k % 3 == 0, F.concat(F.lit("ent_"), k)))
    return A.query_slots(slots, _entities(spark, d), "The order of customer 7, client 9 and CUSTOMER 12?")


@query(
    """WITH k AS (SELECT o_custkey, o_orderkey % 5 AS kind FROM orders), s AS (SELECT o_custkey, CASE WHEN bool_or(kind = 0) THEN 'deleted' WHEN bool_or(kind = 1) THEN 'unsupported' ELSE 'supported' END AS s FROM k GROUP BY 1)
SELECT 'slot_' || o_custkey AS slot_id, s AS state FROM s"""
)
def state_support(spark: SparkSession, d: str) -> DataFrame:
    return A.state_support(_states(spark, d)).select("slot_id", "state")


CLAIM_SUPPORT = "SELECT p_size, CASE WHEN bool_or(p_partkey % 97 = 0) THEN 'deleted' WHEN bool_or(p_partkey % 11 = 0) THEN 'unsupported' ELSE 'supported' END AS state, count(*) AS n FROM part WHERE p_partkey % 17 < 3 GROUP BY 1"


def _claims_with_gone(spark: SparkSession, d: str) -> DataFrame:
    c = _part_claims(spark, d).where("source_sequence_no % 17 < 3")
    return c.withColumn("status", F.when(F.col("source_sequence_no") % 97 == 0, "tombstoned").otherwise(F.col("status")))


@query(f"WITH s AS ({CLAIM_SUPPORT}) SELECT 'slot_' || n.n AS slot_id, coalesce(s.state, 'no_evidence') AS state, CAST(coalesce(s.n, 0) AS INTEGER) AS n_claims FROM (SELECT DISTINCT p_size AS n FROM part UNION SELECT 99) n LEFT JOIN s ON s.p_size = n.n")
def target_support(spark: SparkSession, d: str) -> DataFrame:
    targets = _part_claims(spark, d).select("slot_id").union(spark.createDataFrame([("slot_99",)], "slot_id string")).distinct()
    slots = targets.select(F.col("slot_id").alias("slot_key"), F.lit("s").alias("subject"), F.lit("p").alias("predicate"))
    out = A.target_support(A.claim_support(_claims_with_gone(spark, d)), targets, slots)
    return out.select("slot_id", "state", F.size("source_claim_ids").alias("n_claims"))


@query(
    f"""WITH s AS ({CLAIM_SUPPORT}), c AS (SELECT * FROM part WHERE p_partkey % 17 < 3),
f AS (SELECT p_size, p_size || '/' || p_partkey % 3 AS facet, arg_max(p_brand, p_partkey) AS v, bool_or(p_partkey % 97 = 0 OR p_partkey % 11 = 0) AS bad FROM c GROUP BY p_size, p_partkey % 3),
a AS (SELECT p_size, count(*) AS n, count(DISTINCT v) FILTER (WHERE NOT bad) AS vals FROM f GROUP BY 1), t AS (SELECT p_size, arg_max(p_brand, p_partkey) AS v FROM c GROUP BY 1)
SELECT 'slot_' || s.p_size AS slot_id, s.state AS support_state, CASE WHEN s.state = 'supported' AND vals <= 1 THEN t.v END AS current_value, CAST(a.n AS INTEGER) AS n_facets FROM s JOIN a ON a.p_size = s.p_size JOIN t ON t.p_size = s.p_size"""
)
def resolved_slots(spark: SparkSession, d: str) -> DataFrame:
    """The answer of each slot: no value where its supported facets disagree."""
    c = _claims_with_gone(spark, d).withColumn("slot_facet", F.concat_ws("/", F.regexp_replace("slot_id", "slot_", ""), (F.col("source_sequence_no") % 3).cast("string")))
    empty = _states(spark, d).limit(0)
    support = A.with_views(A.claim_support(c), {}, empty)
    return A.resolved_slots(support, c, empty, empty).select("slot_id", "support_state", "current_value", F.col("n_facets").cast("int").alias("n_facets"))


@query(
    """WITH v AS (SELECT o_custkey, o_orderdate AS t, 'st_' || o_orderkey AS id, 0 AS pos, o_orderstatus AS val FROM orders WHERE o_orderkey % 5 IN (2, 3, 4)
UNION ALL SELECT o_custkey, o_orderdate, 'st_' || o_orderkey, 1, 'm ' || o_orderkey % 3 FROM orders WHERE o_orderkey % 5 = 4 UNION ALL SELECT o_custkey, o_orderdate, 'st_' || o_orderkey, 2, 'Same' FROM orders WHERE o_orderkey % 5 = 4),
f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, lower(val) ORDER BY t, id, pos) AS n FROM v)
SELECT 'slot_' || o_custkey AS slot_id, string_agg(val, ',' ORDER BY t, id, pos) AS vals FROM f WHERE n = 1 GROUP BY 1"""
)
def history_values(spark: SparkSession, d: str) -> DataFrame:
    return A.distinct_history_values(_states(spark, d)).select("slot_id", F.array_join("values", ",").alias("vals"))


@query(
    """SELECT conv_id * 1000 + turn AS claim, CASE WHEN turn % 7 = 6 THEN 'ambiguous_slot' WHEN conv_id % 9 = 0 THEN 'unknown_slot' WHEN conv_id % 9 = 1 THEN 'deleted_slot' WHEN conv_id % 9 = 2 THEN 'unsupported_slot' WHEN conv_id % 9 = 3 THEN 'no_evidence'
WHEN turn % 7 = 5 THEN 'missing_text' WHEN turn % 7 = 4 THEN 'missing_evidence' WHEN turn % 7 = 3 THEN 'evidence_outside_support' WHEN turn % 7 = 2 THEN 'evidence_unavailable' WHEN NOT contains(text, CASE WHEN turn % 7 = 1 THEN 'no such quote' ELSE substring(text, 3, 20) END) THEN 'quote_mismatch' END AS reason FROM conversations"""
)
def answer_checks(spark: SparkSession, d: str) -> DataFrame:
    """Each claim of an answer with the first reason to reject it."""
    c = T.read(spark, d, "conversations")
    t, slot = F.col("turn") % 7, F.col("conv_id").cast("string")
    span = F.concat(F.lit("sp_"), slot, F.lit("_"), F.col("turn").cast("string"))
    quote = F.when(t == 1, "no such quote").otherwise(F.substring("text", 3, 20))
    cite = F.array(F.struct(span.alias("span_id"), quote.alias("quote")))
    nothing = F.filter(cite, lambda x: F.lit(False))
    answer = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("claim"), F.when(t != 6, slot).alias("slot_id"), F.when(t == 5, " ").otherwise("said").alias("text"), F.when(t == 4, nothing).otherwise(cite).alias("evidence"))
    m = F.col("conv_id") % 9
    state = F.when(m == 1, "deleted").when(m == 2, "unsupported").when(m == 3, "no_evidence").otherwise("supported")
    support = c.where("conv_id % 9 <> 0").groupBy(slot.alias("slot_id"), state.alias("state")).agg(F.collect_list(F.when(t != 3, span)).alias("source_span_ids"))
    return A.check_answer(answer, support, c.where(t != 2).select(span.alias("span_id"), "text")).select("claim", "reason")


@query(
    f"""WITH s AS ({CLAIM_SUPPORT}), k AS (SELECT p_size, count(DISTINCT p_partkey % 100) FILTER (WHERE p_partkey % 100 < 10) AS n FROM part WHERE p_partkey % 17 < 3 GROUP BY 1)
SELECT 'slot_' || s.p_size AS slot_id, CASE WHEN state = 'supported' AND k.n = 0 THEN 'no_evidence' ELSE state END AS state, CAST(k.n AS INTEGER) AS n_spans FROM s JOIN k ON k.p_size = s.p_size WHERE s.p_size % 2 = 0"""
)
def restricted_support(spark: SparkSession, d: str) -> DataFrame:
    """The support that a packet of some slots and spans still holds."""
    slots = _part_claims(spark, d).where("cast(regexp_replace(slot_id, 'slot_', '') as int) % 2 = 0").select("slot_id")
    spans = spark.range(10).select(F.concat(F.lit("sp_"), "id").alias("id"))
    return A.restrict(A.claim_support(_claims_with_gone(spark, d)), slots, spans).select("slot_id", "state", F.size("source_span_ids").alias("n_spans"))


# context -----------------------------------------------------------------------------------------------------------------


@query(
    """SELECT 'cl_' || p_partkey AS id, '### ' || CASE WHEN p_partkey % 13 = 0 THEN 'DerivedState' ELSE 'CurrentState' END || ' cl_' || p_partkey || chr(10) || 'slot: Size ' || p_size || ' / brand' || chr(10) || 'value: ' || p_brand || chr(10) ||
'valid_from_ms: ' || p_partkey || chr(10) || 'valid_to_ms: ' || chr(10) || 'source_span_ids: sp_' || p_partkey % 100 || chr(10) || 'source_episode_ids: ep_' || p_partkey % 50 || chr(10) AS rendered FROM part"""
)
def rendered_claims(spark: SparkSession, d: str) -> DataFrame:
    return _part_claims(spark, d).select("id", X.render_claim(True).alias("rendered"))


@query(
    """SELECT 'st_' || o_orderkey AS id, '### Memory st_' || o_orderkey || chr(10) || 'source_type: Episode' || chr(10) || 'source_id: slot_' || o_custkey || chr(10) || 'source_actor: user' || chr(10) || 'span_index: 3' || chr(10) || 'score: 0.2500' || chr(10) ||
'valid_from: ' || strftime(o_orderdate, '%Y-%m-%d %H:%MZ') || ' (' || (epoch_us(o_orderdate) // 1000) || ')' || chr(10) || 'valid_to: ' || chr(10) || chr(10) || o_orderpriority || chr(10) AS rendered FROM orders"""
)
def rendered_spans(spark: SparkSession, d: str) -> DataFrame:
    s = _states(spark, d).select("id", F.lit("episode").alias("source_type"), F.col("slot_id").alias("source_id"), F.lit("user").alias("source_actor"), F.lit(3).alias("span_index"), F.lit(0.25).alias("score"), "valid_from_ms", "valid_to_ms", F.col("state_text").alias("text"))
    return s.select("id", X.render_span(True).alias("rendered"))


KIND_OF = "CASE o_orderkey % 5 WHEN 0 THEN 'state_tombstone' WHEN 1 THEN 'state_unsupported' WHEN 2 THEN 'state_derived' WHEN 3 THEN 'state_current' ELSE 'state_set' END"


def _items(spark: SparkSession, d: str) -> DataFrame:
    s = _states(spark, d)
    return s.select(F.col("slot_id").alias("request"), "id", F.concat(F.lit("state_"), "state_kind").alias("kind"), F.col("source_sequence_no").alias("order"), F.array(F.col("object_value")).alias("slot_ids"), F.concat_ws(" ", "state_text", "id").alias("rendered"))


@query("SELECT 'slot_' || o_custkey AS request, 'st_' || o_orderkey AS id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 5, CAST(o_orderstatus <> 'F' AS INTEGER), o_orderkey) - 1 AS INTEGER) AS place FROM orders")
def item_order(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d)
    targets = items.select("request", F.lit("F").alias("slot_id")).distinct()
    return X.order_items(items, targets).select("request", "id", "place")


@query(
    """WITH RECURSIVE t AS (SELECT conv_id, turn, greatest(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')), CAST(ceil(length(text) / 4.0) AS BIGINT), 1) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
p AS (SELECT conv_id, turn, n, r, CASE WHEN n <= 200 THEN n ELSE 0 END AS used, n <= 200 AS kept FROM t WHERE r = 1
UNION ALL SELECT t.conv_id, t.turn, t.n, t.r, p.used + CASE WHEN p.used + t.n <= 200 THEN t.n ELSE 0 END, p.used + t.n <= 200 FROM p JOIN t ON t.conv_id = p.conv_id AND t.r = p.r + 1)
SELECT CAST(conv_id AS VARCHAR) AS request, CAST(turn AS VARCHAR) AS id, CAST(n AS BIGINT) AS tokens FROM p WHERE kept"""
)
def state_packing(spark: SparkSession, d: str) -> DataFrame:
    """Evidence packed in order; what does not fit is skipped."""
    c = T.read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("request"), F.col("turn").cast("string").alias("id"), F.lit("raw").alias("kind"), F.col("turn").alias("place"), F.col("text").alias("rendered"), F.lit(True).alias("raw"), F.lit(None).cast("string").alias("subject_key"))
    return X.pack_state(c, 200).select("request", "id", "tokens")


@query(
    """WITH c AS (SELECT *, p_size % 2 = 0 AS refuses FROM part WHERE p_size <= 12), f AS (SELECT p_size // 4 AS g, min(refuses) AS closed FROM c GROUP BY 1),
s AS (SELECT p_size // 4 AS g, p_size, min(lpad(CAST(p_partkey AS VARCHAR), 6, '0')) AS first FROM c WHERE NOT refuses GROUP BY 1, 2)
SELECT CAST(f.g AS VARCHAR) AS request, closed AS fail_closed, CAST((SELECT count(*) FROM s WHERE s.g = f.g) AS INTEGER) AS required, CAST((SELECT count(*) FROM c WHERE NOT refuses AND p_size // 4 = f.g) AS INTEGER) AS n_proof, CAST((SELECT count(*) FROM c WHERE refuses AND p_size // 4 = f.g) AS INTEGER) AS n_withheld FROM f"""
)
def proof_targets(spark: SparkSession, d: str) -> DataFrame:
    """Span ids are padded to the width of any key: a shorter lpad cuts longer keys, and different spans become one."""
    p = T.read(spark, d, "part").where("p_size <= 12")
    n = F.col("p_size")
    r = p.groupBy((n / 4).cast("int").cast("string").alias("request"), F.concat(F.lit("slot_"), n).alias("slot_id"), F.when(n % 2 == 0, "unsupported").otherwise("supported").alias("support_state")).agg(F.array_sort(F.collect_set(F.lpad(F.col("p_partkey").cast("string"), 20, "0"))).alias("source_span_ids")).withColumn("view", F.lit("current"))
    return X.proof_targets(r).select("request", "fail_closed", F.col("required").cast("int").alias("required"), F.size("proof_span_ids").alias("n_proof"), F.size("withheld").alias("n_withheld"))


@query("SELECT CASE WHEN p_size < 20 THEN 'ent_' || p_size ELSE 'size ' || p_size END AS subject_key, CASE WHEN p_size < 20 THEN 'entity_state:big size ' || p_size ELSE 'entity_state:size ' || p_size END AS id, count(*) AS n_claims FROM part GROUP BY p_size")
def entity_cards(spark: SparkSession, d: str) -> DataFrame:
    c = _part_claims(spark, d).withColumn("order", F.col("source_sequence_no"))
    n = T.read(spark, d, "part").select(F.col("p_size").alias("n")).distinct().where("n < 20")
    entities = n.select(F.concat(F.lit("ent_"), "n").alias("id"), F.concat(F.lit("Big size "), "n").alias("canonical_name"), F.array(F.concat(F.lit("Size "), "n")).alias("aliases"), F.array(F.lit("c")).alias("source_claims"))
    return X.entity_cards(c, X.entity_names(entities)).select("subject_key", "id", "n_claims")


# timelines ---------------------------------------------------------------------------------------------------------------

EV = "SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS ms, CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS object_value FROM events"


@query(f"SELECT DISTINCT ms AS boundary FROM ({EV}) WHERE user_id % 5 = 0 UNION SELECT ms + 1000 FROM ({EV}) WHERE user_id % 5 = 0 AND event_type = 'click'")
def batch_boundaries(spark: SparkSession, d: str) -> DataFrame:
    c = T.claims(spark, d).where("cast(user_id as long) % 5 = 0")
    return TL.boundaries(c.withColumn("valid_to_ms", F.when(F.col("predicate") == "click", F.col("valid_from_ms") + 1000)))


@query(
    f"""WITH e AS ({EV}), b AS (SELECT DISTINCT user_id, event_type, ms AS boundary FROM e WHERE event_id % 3 = 0)
SELECT 'claim_ev_' || e.event_id AS id, boundary FROM b JOIN e ON e.user_id = b.user_id AND e.event_type = b.event_type AND e.ms <= boundary QUALIFY row_number() OVER (PARTITION BY b.user_id, b.event_type, boundary ORDER BY e.ms DESC, e.event_id DESC) = 1"""
)
def boundary_states(spark: SparkSession, d: str) -> DataFrame:
    """The current claim of each slot at every boundary that the slot has."""
    c = T.claims(spark, d)
    times = c.where("source_sequence_no % 3 = 0").select("slot_id", F.col("valid_from_ms").alias("boundary"))
    return TL.current_at(c, times, ["slot_id"]).select("id", "boundary")


RECON = f"WITH e AS ({EV}), a AS (SELECT * FROM e WHERE event_id % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ms DESC, event_id DESC) = 1), b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ms DESC, event_id DESC) = 1), x AS (SELECT a.user_id, a.event_type, a.ms AS am, b.ms AS bm, a.object_value AS av, b.object_value AS bv FROM a JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type)"


@query(
    RECON
    + """ SELECT 'new' AS part, user_id, event_type, ms AS valid_from_ms, CAST(NULL AS BIGINT) AS valid_to_ms FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.user_id = b.user_id AND a.event_type = b.event_type AND a.object_value = b.object_value AND a.ms = b.ms)
UNION ALL SELECT 'superseded', user_id, event_type, am, NULL FROM x WHERE (am <> bm OR av <> bv) UNION ALL SELECT 'historical', user_id, event_type, am, bm FROM x WHERE bm > am"""
)
def interval_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """What a second projection writes after a first one that had four events in five, row by row."""
    from ..operators import claims as C
    from ..operators import projection as PJ

    c = T.claims(spark, d)
    stored = PJ.state_records(C.resolve_current(c.where("source_sequence_no % 5 <> 0")), 1)
    new, superseded, historical = TL.reconcile(stored, PJ.state_records(C.resolve_current(c), 2), 2, "w")
    cols = [F.col("user_id").cast("long").alias("user_id"), F.col("predicate").alias("event_type"), "valid_from_ms", "valid_to_ms"]
    parts = [df.select(F.lit(name).alias("part"), *cols) for name, df in (("new", new), ("superseded", superseded), ("historical", historical))]
    return parts[0].union(parts[1]).union(parts[2])


@query(RECON + " SELECT 'new' AS part, count(*) AS n FROM x WHERE am <> bm OR av <> bv UNION ALL SELECT 'superseded', count(*) FROM x WHERE am <> bm OR av <> bv UNION ALL SELECT 'historical', count(*) FROM x WHERE bm > am")
def state_projection(spark: SparkSession, d: str) -> DataFrame:
    """A batch's slots projected against what is stored."""
    from ..operators import claims as C
    from ..operators import projection as PJ

    c = T.claims(spark, d)
    first = C.resolve_current(c.where("source_sequence_no % 5 <> 0"))
    stored = PJ.state_records(first, 1).withColumn("id", TL.scalar_state_id())
    slots = first.select("slot_id").distinct()
    out = TL.project(slots, c, None, stored, None, 2, "seed")
    parts = [df.select(F.lit(name).alias("part")) for name, df in out.items()]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH m AS (SELECT l_orderkey, l_linenumber, min(CAST(l_partkey AS VARCHAR)) AS v FROM lineitem GROUP BY 1, 2), b AS (SELECT DISTINCT l_orderkey, l_linenumber AS boundary FROM m WHERE l_linenumber IN (3, 5)),
late AS (SELECT DISTINCT l_orderkey FROM m WHERE l_linenumber = 2)
SELECT b.l_orderkey AS slot_id, CAST(b.boundary AS BIGINT) AS valid_from_ms, CAST(count(DISTINCT m.v) AS INTEGER) AS n_members FROM b JOIN m ON m.l_orderkey = b.l_orderkey AND m.l_linenumber <= b.boundary
WHERE EXISTS (SELECT 1 FROM m o WHERE o.l_orderkey = b.l_orderkey AND o.l_linenumber = 2 AND NOT EXISTS (SELECT 1 FROM m q WHERE q.l_orderkey = b.l_orderkey AND q.l_linenumber <= b.boundary AND q.l_linenumber <> 2 AND q.v = o.v)) GROUP BY 1, 2"""
)
def set_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Line 2 of each order arrives late: the later sets that lack it are written again."""
    from ..operators import claims as C

    li = T.read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.col("l_partkey").cast("string")).alias("v"))
    n = F.col("l_linenumber").cast("long")
    claims = li.select(F.concat_ws("_", "l_orderkey", "l_linenumber").alias("id"), F.col("l_orderkey").alias("slot_id"), F.col("v").alias("object_value"), F.lit("relationship").alias("claim_kind"), F.lit("active").alias("status"), F.lit("affirmative").alias("polarity"), n.alias("observed_at_ms"), n.alias("valid_from_ms"), F.lit(None).cast("long").alias("valid_to_ms"), n.alias("source_sequence_no"))
    times = li.where("l_linenumber in (3, 5)").select(F.col("l_orderkey").alias("slot_id"), n.alias("boundary"))
    early = claims.where("valid_from_ms <> 2").join(times, "slot_id").where("valid_from_ms <= boundary")
    stored = C.set_members(early, ["slot_id", "boundary"]).select(F.concat_ws("@", "slot_id", "boundary").alias("id"), "slot_id", F.lit("set").alias("state_kind"), "members", "observed_at_ms", F.col("boundary").alias("valid_from_ms"), F.lit(None).cast("long").alias("valid_to_ms"), F.lit(None).cast("long").alias("superseded_at_ms"))
    out = TL.future_set_snapshots(claims, stored, 2, 9, "w")
    return out.select("slot_id", "valid_from_ms", F.size("members").alias("n_members"))


@query("SELECT 'st_' || o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'r_' || o_orderkey % 7 || CASE WHEN 'x_' || o_orderkey % 3 > 'r_' THEN ',x_' || o_orderkey % 3 END ELSE 'r_' || o_orderkey % 7 END AS rules FROM orders")
def rule_ids_on_states(spark: SparkSession, d: str) -> DataFrame:
    s = _states(spark, d)
    k = F.col("source_sequence_no")
    traces = s.where(k % 2 == 0).select(F.get("claim_ids", F.lit(0)).alias("derived_claim_id"), F.concat(F.lit("x_"), k % 3).alias("rule_id"))
    return TL.with_rule_ids(s, traces).select("id", F.array_join("rule_ids", ",").alias("rules"))


@query("SELECT 'st_' || o_orderkey AS id FROM orders WHERE o_custkey % 4 <> 0")
def retired_states(spark: SparkSession, d: str) -> DataFrame:
    frontier = T.read(spark, d, "customer").where("c_custkey % 4 = 0").select(F.concat(F.lit("slot_"), "c_custkey").alias("slot_id"))
    return TL.retire(frontier, _states(spark, d), 5).select("id")


# erasure -----------------------------------------------------------------------------------------------------------------


def _erasure_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Parts as claims that cite spans and episodes, rules between sizes, traces that derive a part's claim from the one a
    thousand before it, states and entities over them."""
    c = _part_claims(spark, d)
    k = F.col("source_sequence_no")
    none = F.lit(None).cast("string")
    cols = "id string, claim_id string, src_entity_id string, dst_entity_id string, source_spans array<string>, entity_id string, source_claims array<string>, evidence_claims array<string>, source_span_ids array<string>, source_episode_ids array<string>"
    empty = spark.createDataFrame([], cols)
    traces = c.where(k > 1000).select(F.concat(F.lit("tr_"), k).alias("id"), none.alias("rule_id"), F.concat(F.lit("cl_"), k - 1000).alias("trigger_claim_id"), none.alias("prior_trigger_claim_id"), F.col("id").alias("derived_claim_id"), F.expr(NONE).alias("source_spans"), F.expr(NONE).alias("source_episodes"))
    states = c.select(F.concat(F.lit("st_"), k).alias("id"), F.array("id").alias("claim_ids"), F.expr(NONE).alias("correction_ids"), F.expr(NONE).alias("rule_ids"), F.expr(NONE).alias("source_spans"), F.expr(NONE).alias("source_episodes"))
    entities = c.groupBy("slot_id").agg(F.array_sort(F.collect_list("id")).alias("source_claims")).select(F.concat(F.lit("ent_"), "slot_id").alias("id"), "source_claims")
    return {
        "claims": c, "spans": spark.range(100).select(F.concat(F.lit("sp_"), "id").alias("id"), F.lit("episode").alias("source_type"), F.concat(F.lit("ep_"), F.col("id") % 50).alias("source_id")),
        "episodes": spark.range(50).select(F.concat(F.lit("ep_"), "id").alias("id")), "extraction_jobs": spark.range(50).select(F.concat(F.lit("xjob_"), "id").alias("id"), F.concat(F.lit("ep_"), "id").alias("episode_id")),
        "rules": _rules(spark, d), "corrections": empty, "dependency_traces": traces, "state_records": states, "profiles": empty, "entities": entities, "slot_aliases": empty, "entity_aliases": empty, "edges": empty,
        "slots": c.select(F.col("slot_id").alias("id"), F.array(F.lit("kept")).alias("source_claim_ids"), F.expr(NONE).alias("source_rule_ids"), F.expr(NONE).alias("source_entity_ids")).dropDuplicates(["id"]),
    }


@query(
    """WITH RECURSIVE c AS (SELECT p_partkey AS k, p_size FROM part), g(k) AS (SELECT k FROM c WHERE k % 100 IN (3, 53) OR k % 50 = 3 UNION SELECT c.k FROM g JOIN c ON c.k = g.k + 1000),
n AS (SELECT DISTINCT p_size AS n FROM part)
SELECT 'claims' AS tbl, count(*) AS n FROM g UNION ALL SELECT 'state_records', count(*) FROM g UNION ALL SELECT 'spans', 2 UNION ALL SELECT 'episodes', 1 UNION ALL SELECT 'extraction_jobs', 1
UNION ALL SELECT 'dependency_traces', count(*) FROM c WHERE k > 1000 AND (k IN (SELECT k FROM g) OR k - 1000 IN (SELECT k FROM g)) UNION ALL SELECT 'rules', count(*) FROM n WHERE n IN (3, 53)
UNION ALL SELECT 'entities', count(*) FROM (SELECT p_size FROM c GROUP BY 1 HAVING bool_and(k IN (SELECT k FROM g)))"""
)
def erase_closure(spark: SparkSession, d: str) -> DataFrame:
    """Everything that depends on one episode, over every table, with derivations followed to their end."""
    tables = _erasure_tables(spark, d)
    erased, _ = D.episodes(tables, spark.createDataFrame([("ep_3",)], "id string"))
    shown = ["claims", "state_records", "spans", "episodes", "extraction_jobs", "dependency_traces", "rules", "entities"]
    parts = [erased[t].select(F.lit(t).alias("tbl"), "id").union(spark.createDataFrame([(t, None)], "tbl string, id string")) for t in shown]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy("tbl").agg(F.count("id").alias("n"))


@query(
    """SELECT conv_id || '_' || turn AS id, regexp_replace(text, '(?i)(^|[^\\p{L}\\p{N}])(the|and|que)([^\\p{L}\\p{N}]|$)', 'x', 'g') = text AS same FROM conversations WHERE conv_id % 4 = 0"""
)
def redacted_spans(spark: SparkSession, d: str) -> DataFrame:
    """Texts with forgotten values hidden; only those that hold one as a whole word change."""
    c = T.read(spark, d, "conversations").where("conv_id % 4 = 0").withColumn("_values", F.array(F.lit("The "), F.lit("and"), F.lit("QUE")))
    out = D.redact(c.withColumn("was", F.col("text")), "text")
    return out.select(F.concat_ws("_", "conv_id", "turn").alias("id"), (F.col("text") == F.col("was")).alias("same"))


# source-diverse search ---------------------------------------------------------------------------------------------------


def _registry(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as sources: their turns' ids in order."""
    c = T.spans(spark, d)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("span_index", "id"))), lambda x: x["id"])
    return c.groupBy("source_id").agg(ids.alias("span_ids"))


HITS = "SELECT conv_id, turn, row_number() OVER (ORDER BY (conv_id * 7 + turn * 3) % 101, conv_id, turn) - 1 AS r FROM conversations QUALIFY r < 40"


def _hits(spark: SparkSession, d: str) -> DataFrame:
    c = T.read(spark, d, "conversations").withColumn("o", (F.col("conv_id") * 7 + F.col("turn") * 3) % 101).orderBy("o", "conv_id", "turn").limit(40)
    c = c.withColumn("rank", F.row_number().over(Window.orderBy("o", "conv_id", "turn")) - 1)
    return c.select(F.concat(F.lit("span_"), "conv_id", F.lit("_"), "turn").alias("id"), F.col("conv_id").cast("string").alias("source_id"), F.col("turn").cast("int").alias("span_index"), (1 / (F.col("rank") + 1)).alias("score"), "rank")


FUSED = f"WITH h AS ({HITS}), s AS (SELECT conv_id, row_number() OVER (ORDER BY min(r)) - 1 AS rank, 1.0 AS w FROM h GROUP BY 1), l AS (SELECT conv_id, row_number() OVER (ORDER BY count(*) DESC, CAST(conv_id AS VARCHAR)) - 1 AS rank, 0.5 AS w FROM conversations GROUP BY 1 QUALIFY rank < 20), f AS (SELECT conv_id, sum(w / (61 + rank)) AS score FROM (SELECT * FROM s UNION ALL SELECT * FROM l) GROUP BY 1), p AS (SELECT *, row_number() OVER (ORDER BY score DESC, CAST(conv_id AS VARCHAR)) - 1 AS plan FROM f QUALIFY plan < 12)"


def _lexical(spark: SparkSession, d: str) -> DataFrame:
    n = T.read(spark, d, "conversations").groupBy(F.col("conv_id").cast("string").alias("source_id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source_id").limit(20)
    return n.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "source_id")) - 1)


@query(FUSED + " SELECT CAST(conv_id AS VARCHAR) AS source_id, CAST(plan AS INTEGER) AS plan_rank, round(score, 9) AS score FROM p")
def primary_sources(spark: SparkSession, d: str) -> DataFrame:
    _, order = SR.by_source(_hits(spark, d))
    return SR.fuse_sources([(order, 1.0), (_lexical(spark, d), 0.5)], 12).select("source_id", "plan_rank", F.round("score", 9).alias("score"))


CANDIDATES = """, hh AS (SELECT h.*, row_number() OVER (PARTITION BY conv_id ORDER BY r) AS hr FROM h WHERE conv_id IN (SELECT conv_id FROM p) QUALIFY hr <= 3), k AS (SELECT p.conv_id, count(hh.r) AS n FROM p LEFT JOIN hh ON hh.conv_id = p.conv_id GROUP BY 1),
m AS (SELECT conv_id, count(*) AS size FROM conversations GROUP BY 1),
c AS (SELECT conv_id, 0 AS a, r AS b, 0 AS e, turn + 1 AS turn FROM hh UNION ALL SELECT conv_id, 0, r, 1, greatest(turn - 1, 0) FROM hh UNION ALL SELECT p.conv_id, 1, i, 0, i FROM p JOIN m ON m.conv_id = p.conv_id, range(3) t(i) WHERE i < size),
o AS (SELECT c.conv_id, c.turn, min((c.a, c.b, c.e)) AS o FROM c JOIN conversations v ON v.conv_id = c.conv_id AND v.turn = c.turn WHERE NOT EXISTS (SELECT 1 FROM hh WHERE hh.conv_id = c.conv_id AND hh.turn = c.turn) GROUP BY 1, 2),
fl AS (SELECT o.conv_id, o.turn, row_number() OVER (PARTITION BY o.conv_id ORDER BY o.o) AS place FROM o JOIN k ON k.conv_id = o.conv_id QUALIFY place <= greatest(3 - k.n, 0))"""


@query(FUSED + CANDIDATES + " SELECT CAST(conv_id AS VARCHAR) AS source_id, string_agg('span_' || conv_id || '_' || turn, ',' ORDER BY place) AS fills FROM fl GROUP BY conv_id")
def fill_ids(spark: SparkSession, d: str) -> DataFrame:
    """The neighbours and leading spans that fill each source's plan."""
    lists, order = SR.by_source(_hits(spark, d))
    chosen = SR.fuse_sources([(order, 1.0), (_lexical(spark, d), 0.5)], 12)
    made = SR.plans(chosen, lists, _registry(spark, d), 3, 1)
    return made.where("size(fill_ids) > 0").select("source_id", F.array_join("fill_ids", ",").alias("fills"))


@query(
    FUSED
    + CANDIDATES
    + """, al AS (SELECT conv_id, turn, hr AS pos FROM hh UNION ALL SELECT fl.conv_id, fl.turn, k.n + fl.place FROM fl JOIN k ON k.conv_id = fl.conv_id)
SELECT 'span_' || al.conv_id || '_' || al.turn AS id, CAST(al.pos AS INTEGER) AS rank_in_source, CAST(p.plan AS INTEGER) AS plan_rank FROM al JOIN p ON p.conv_id = al.conv_id"""
)
def source_diverse_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Dense hits and lexical sources fused by source, filled up and taken in turn."""
    spans = T.spans(spark, d).select("id", "text")
    out = SR.source_diverse_search(_hits(spark, d), [(_lexical(spark, d), 0.5)], _registry(spark, d), spans, max_sources=12, spans_per_source=3)
    return out.select("id", "rank_in_source", "plan_rank")


@query(
    f"""WITH h AS ({HITS}), p AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 5 = 2), hh AS (SELECT h.*, row_number() OVER (PARTITION BY conv_id ORDER BY r) AS hr FROM h WHERE conv_id % 5 = 2 QUALIFY hr <= 3)"""
    + CANDIDATES[CANDIDATES.index(", k AS") :]
    + """ SELECT 'span_' || conv_id || '_' || turn AS id, CAST(pos AS INTEGER) AS rank_in_source FROM (SELECT conv_id, turn, hr AS pos FROM hh UNION ALL SELECT fl.conv_id, fl.turn, k.n + fl.place FROM fl JOIN k ON k.conv_id = fl.conv_id)"""
)
def hydrate_sources(spark: SparkSession, d: str) -> DataFrame:
    """Selected sources with their prior hits, neighbours and leading spans."""
    chosen = T.read(spark, d, "conversations").where("conv_id % 5 = 2").select(F.col("conv_id").alias("plan_rank"), F.col("conv_id").cast("string").alias("source_id"), F.lit(3).alias("max_spans")).distinct()
    return SR.hydrate_selected(chosen, _hits(spark, d), _registry(spark, d), T.spans(spark, d).select("id", "text")).select("id", "rank_in_source")


WORDS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


@query(
    f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents WHERE doc_id % 2 = 0), s AS (SELECT count(*) AS n, greatest(1.0, avg(len(w))) AS avg FROM d),
t AS (SELECT doc_id, len(w) AS dl, unnest(['heron', 'of', 'the']) AS term, unnest([len(list_filter(w, lambda x: x = 'heron')), len(list_filter(w, lambda x: x = 'of')), len(list_filter(w, lambda x: x = 'the'))]) AS tf FROM d),
f AS (SELECT term, count(*) AS df FROM t WHERE tf > 0 GROUP BY 1)
SELECT CAST(doc_id AS VARCHAR) AS source_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))), 6) AS score FROM t JOIN f USING (term), s WHERE tf > 0 AND df <= greatest(1, 0.2 * n) GROUP BY 1"""
)
def source_index_search(spark: SparkSession, d: str) -> DataFrame:
    """BM25 over a stored index of whole sources; words in more than a fifth of them are skipped."""
    docs = T.read(spark, d, "documents").where("doc_id % 2 = 0")
    rows = docs.select(F.col("doc_id").alias("ordinal"), F.col("doc_id").cast("string").alias("source_id"), F.lit("").alias("title"), F.col("source").alias("directory"), F.col("text").alias("body"), F.expr(NONE).alias("span_ids"))
    index = LI.build(rows, shared(spark, "index"))
    return index.search("of the heron", 1_000_000, 0.2).select("source_id", F.round("score", 6).alias("score"))


@query(
    f"""WITH cw AS (SELECT conv_id, turn, {WORDS} AS w FROM conversations WHERE conv_id % 6 = 1), n AS (SELECT * FROM cw WHERE len(w) > 0), s AS (SELECT count(*) AS n, avg(len(w)) AS avg FROM n),
t AS (SELECT conv_id, turn, len(w) AS dl, unnest(['que', 'the', 'und']) AS term, unnest([len(list_filter(w, lambda x: x = 'que')), len(list_filter(w, lambda x: x = 'the')), len(list_filter(w, lambda x: x = 'und'))]) AS tf FROM n), f AS (SELECT term, count(*) AS df FROM t WHERE tf > 0 GROUP BY 1),
b AS (SELECT conv_id, turn, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))) AS score FROM t JOIN f USING (term), s WHERE tf > 0 GROUP BY 1, 2),
hits AS ({HITS}), q AS (SELECT conv_id, turn, row_number() OVER (ORDER BY score DESC, 'span_' || conv_id || '_' || turn) - 1 AS r FROM b UNION ALL SELECT conv_id, turn, row_number() OVER (ORDER BY r) - 1 FROM hits WHERE conv_id % 6 = 1),
fu AS (SELECT conv_id, turn, sum(1.0 / (61 + r)) AS score FROM q GROUP BY 1, 2), h AS (SELECT conv_id, turn, row_number() OVER (ORDER BY score DESC, 'span_' || conv_id || '_' || turn) AS r FROM fu),
p AS (SELECT DISTINCT conv_id FROM cw), hh AS (SELECT h.*, row_number() OVER (PARTITION BY conv_id ORDER BY r) AS hr FROM h QUALIFY hr <= 3)"""
    + CANDIDATES[CANDIDATES.index(", k AS") :]
    + """ SELECT 'span_' || conv_id || '_' || turn AS id, CAST(pos AS INTEGER) AS rank_in_source FROM (SELECT conv_id, turn, hr AS pos FROM hh UNION ALL SELECT fl.conv_id, fl.turn, k.n + fl.place FROM fl JOIN k ON k.conv_id = fl.conv_id)"""
)
def passage_search(spark: SparkSession, d: str) -> DataFrame:
    """Passages inside selected sources: their words and dense hits fused, then filled up."""
    spans = T.spans(spark, d).select("id", "source_id", "span_index", "text")
    chosen = T.read(spark, d, "conversations").where("conv_id % 6 = 1").select(F.col("conv_id").alias("plan_rank"), F.col("conv_id").cast("string").alias("source_id"), F.lit(3).alias("max_spans")).distinct()
    return SR.search_selected(chosen, "que the und", _hits(spark, d), _registry(spark, d), spans).select("id", "rank_in_source")
