"""The engine's queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import claims as C
from ..operators import filters as FD
from ..operators import graph as G
from ..operators import ingest as I
from ..operators import maintenance as M
from ..operators import predicates as P
from ..operators import projection as PJ
from ..operators import retrieval as R
from ..operators import rules as U
from ..operators import scans as SC
from ..sources import tables as T
from ..sources.storage import OP, Store
from .registry import query, shared

EV = "SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS ms, CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS object_value FROM events"
AT = 1_704_500_000_000
WORD = r"[^\p{L}\p{N}]+"
QUERY_TEXT = "than the heron thing"
TERMS = ["than", "the", "heron", "thing"]


# newest-wins and the two time axes -----------------------------------------------------------------------------------


@query(f"SELECT 'claim_ev_' || event_id AS id, CAST(user_id AS VARCHAR) AS user_id, event_type AS predicate, object_value, ms AS valid_from_ms FROM ({EV}) QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ms DESC, event_id DESC) = 1")
def current_claims(spark: SparkSession, d: str) -> DataFrame:
    return C.current_claims(T.claims(spark, d)).select("id", "user_id", "predicate", "object_value", "valid_from_ms")


@query(f"WITH e AS ({EV}), m AS (SELECT CAST(quantile_disc(ms, 0.5) AS BIGINT) AS cut_ms FROM e) SELECT 'claim_ev_' || event_id AS id, event_type AS predicate, object_value FROM e, m WHERE ms <= cut_ms QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ms DESC, event_id DESC) = 1")
def claims_as_of(spark: SparkSession, d: str) -> DataFrame:
    c = T.claims(spark, d)
    at = c.agg(F.expr("percentile_disc(0.5) within group (order by valid_from_ms)").cast("long").alias("at"))
    live = c.crossJoin(F.broadcast(at)).where(P.valid_at(F.col("at"), P.effective_start()))
    return C.resolve_current(live).select("id", "predicate", "object_value")


@query(f"SELECT 'claim_ev_' || event_id AS id, ms AS valid_from_ms, lead(ms) OVER (PARTITION BY user_id, event_type ORDER BY ms, event_id) AS valid_to_ms FROM ({EV})")
def claim_intervals(spark: SparkSession, d: str) -> DataFrame:
    c = T.claims(spark, d)
    return C.close_before_next(c, ["slot_id"], [F.col("valid_from_ms"), F.col("source_sequence_no")]).select("id", "valid_from_ms", "valid_to_ms")


STATES = "SELECT o_orderkey, o_custkey, o_orderstatus, epoch_us(o_orderdate) // 1000 AS vf, epoch_us(o_orderdate) // 1000 + (o_orderkey % 5) * 86400000 AS rec FROM orders"


@query(f"WITH s AS ({STATES}), b AS (SELECT *, lead(rec) OVER (PARTITION BY o_custkey ORDER BY rec, o_orderkey) AS sup FROM s), m AS (SELECT quantile_disc(rec, 0.5) AS tt FROM b) SELECT o_orderkey, o_custkey, vf AS valid_from_ms, rec AS recorded_at_ms FROM b, m WHERE rec <= tt AND (sup IS NULL OR tt < sup) AND vf <= tt")
def bitemporal_state(spark: SparkSession, d: str) -> DataFrame:
    s = T.state_records(spark, d)
    m = s.agg(F.expr("percentile_disc(0.5) within group (order by recorded_at_ms)").cast("long").alias("tt"))
    j = s.crossJoin(F.broadcast(m))
    return j.where(P.recorded_at(F.col("tt")) & P.valid_at(F.col("tt"), P.effective_start())).select("o_orderkey", "o_custkey", "valid_from_ms", "recorded_at_ms")


@query(f"WITH s AS ({STATES}), b AS (SELECT *, lead(rec) OVER (PARTITION BY o_custkey ORDER BY rec, o_orderkey) AS sup FROM s) SELECT o_orderkey, o_custkey FROM b WHERE sup IS NULL")
def state_visible_now(spark: SparkSession, d: str) -> DataFrame:
    return T.state_records(spark, d).where(P.state_visible()).select("o_orderkey", "o_custkey")


@query(f"WITH s AS ({STATES}), b AS (SELECT *, lead(rec) OVER (PARTITION BY o_custkey ORDER BY rec, o_orderkey) AS sup FROM s) SELECT o_custkey, count(*) AS n_versions FROM b WHERE rec <= 800000000000 AND (sup IS NULL OR 800000000000 < sup) AND vf <= 800000000000 GROUP BY 1")
def state_history_visible(spark: SparkSession, d: str) -> DataFrame:
    return T.state_records(spark, d).where(P.history_visible(800_000_000_000, 800_000_000_000)).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_versions"))


@query("WITH x AS (SELECT l_orderkey, CAST(l_partkey AS VARCHAR) AS v, min(l_linenumber) AS s FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, string_agg(v, ',' ORDER BY s, v) AS members, epoch_us(o_orderdate) // 1000 AS valid_from_ms FROM x JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey, o_orderdate")
def set_states(spark: SparkSession, d: str) -> DataFrame:
    return C.set_members(T.set_claims(spark, d), ["l_orderkey"]).select("l_orderkey", F.array_join("members", ",").alias("members"), "valid_from_ms")


@query(f"SELECT event_type, user_id, object_value FROM (SELECT *, user_id % 7 AS facet FROM ({EV})) QUALIFY row_number() OVER (PARTITION BY event_type, facet, user_id ORDER BY ms DESC, event_id DESC) = 1")
def facet_current(spark: SparkSession, d: str) -> DataFrame:
    c = T.claims(spark, d).withColumn("slot_facet", F.concat_ws("|", "slot_id", (F.col("user_id").cast("long") % 7).cast("string")))
    return C.newest(c.withColumn("k", C.facet_key()), ["k"]).select(F.col("predicate").alias("event_type"), F.col("user_id").cast("long").alias("user_id"), "object_value")


@query(f"WITH e AS ({EV}), r AS (SELECT user_id, max(ms) AS eff FROM e WHERE event_type = 'error' GROUP BY 1) SELECT 'claim_ev_' || event_id AS id, CASE WHEN event_type = 'signup' AND eff IS NOT NULL AND ms <= eff THEN 'retracted' ELSE 'active' END AS status FROM e LEFT JOIN r ON e.user_id = r.user_id")
def corrections_apply(spark: SparkSession, d: str) -> DataFrame:
    return C.apply_corrections(T.claims(spark, d), T.retractions(spark, d)).select("id", "status")


@query(f"WITH e AS ({EV}), r AS (SELECT user_id, max(ms) AS eff FROM e WHERE event_type = 'error' GROUP BY 1), k AS (SELECT e.* FROM e LEFT JOIN r ON e.user_id = r.user_id WHERE NOT (event_type = 'signup' AND eff IS NOT NULL AND ms <= eff)) SELECT 'claim_ev_' || event_id AS id, event_type AS predicate, object_value FROM k QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ms DESC, event_id DESC) = 1")
def corrected_current(spark: SparkSession, d: str) -> DataFrame:
    return C.current_claims(T.claims(spark, d), T.retractions(spark, d)).select("id", "predicate", "object_value")


@query(f"SELECT user_id, event_type, ms AS valid_from_ms, object_value FROM (SELECT *, lag(object_value) OVER w AS p, row_number() OVER w AS n FROM ({EV}) WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ms, event_id)) WHERE n = 1 OR object_value IS DISTINCT FROM p")
def slot_history(spark: SparkSession, d: str) -> DataFrame:
    h = C.history(T.claims(spark, d), ["slot_id"], [F.col("valid_from_ms"), F.col("source_sequence_no")], F.col("object_value"))
    return h.select(F.col("user_id").cast("long").alias("user_id"), F.col("predicate").alias("event_type"), "valid_from_ms", "object_value")


@query(f"SELECT user_id, event_type, count(*) AS version_count, count(DISTINCT trim(object_value, '-')) AS distinct_values, min(ms) AS first_observed_ms, max(ms) AS last_observed_ms FROM ({EV}) GROUP BY 1, 2 HAVING count(*) >= 2")
def slot_history_trace(spark: SparkSession, d: str) -> DataFrame:
    t = C.history_trace(T.claims(spark, d), ["user_id", "predicate"])
    return t.select(F.col("user_id").cast("long").alias("user_id"), F.col("predicate").alias("event_type"), "version_count", "distinct_values", "first_observed_ms", "last_observed_ms")


@query(f"SELECT 'claim_ev_' || event_id AS id, object_value, lag(object_value) OVER (PARTITION BY user_id, event_type ORDER BY ms, event_id) AS prior_value FROM ({EV})")
def as_of_prior_value(spark: SparkSession, d: str) -> DataFrame:
    return C.prior_value(T.claims(spark, d), ["slot_id"]).select("id", "object_value", "prior_value")


@query("WITH o AS (SELECT o_orderkey, epoch_us(o_orderdate) // 1000 AS f, epoch_us(o_orderdate) // 1000 + 60 * CAST(86400000 AS BIGINT) AS t FROM orders), l AS (SELECT l_orderkey, l_linenumber, epoch_us(l_shipdate) // 1000 AS f, epoch_us(l_shipdate) // 1000 + 30 * CAST(86400000 AS BIGINT) AS t FROM lineitem) SELECT l_orderkey, l_linenumber, greatest(o.f, l.f) AS from_ms, least(o.t, l.t) AS to_ms FROM o JOIN l ON o_orderkey = l_orderkey WHERE greatest(o.f, l.f) < least(o.t, l.t)")
def interval_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    day = T.DAY_MS
    o, s = T.millis("o_orderdate"), T.millis("l_shipdate")
    a = T.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), o.alias("valid_from_ms"), (o + 60 * day).alias("valid_to_ms"))
    b = T.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", s.alias("valid_from_ms"), (s + 30 * day).alias("valid_to_ms"))
    return C.interval_overlap(a, b, ["k"]).select(F.col("a.k").alias("l_orderkey"), "l_linenumber", "from_ms", "to_ms")


@query(f"SELECT event_type, min(CASE WHEN event_type = 'error' THEN 'tombstone' WHEN object_value LIKE '-%' THEN 'unsupported' ELSE 'current' END) AS low, max(CASE WHEN event_type = 'error' THEN 'tombstone' WHEN object_value LIKE '-%' THEN 'unsupported' ELSE 'current' END) AS high, count(*) AS n FROM ({EV}) GROUP BY 1")
def claim_kinds(spark: SparkSession, d: str) -> DataFrame:
    """The kind of state that claims stand for: errors are retracted, negative values deny."""
    c = T.claims(spark, d).withColumn("polarity", F.when(F.col("object_value").startswith("-"), "negative").otherwise("affirmative")).withColumn("status", F.when(F.col("predicate") == "error", "retracted").otherwise("active"))
    k = c.withColumn("k", S.state_kind(F.col("status"), F.col("polarity"), F.col("asserted_by"), F.col("claim_kind")))
    return k.groupBy(F.col("predicate").alias("event_type")).agg(F.min("k").alias("low"), F.max("k").alias("high"), F.count(F.lit(1)).alias("n"))


@query("WITH s AS (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'deleted' WHEN 'P' THEN 'unsupported' ELSE 'supported' END AS s FROM orders) SELECT o_custkey, CASE min(CASE s WHEN 'deleted' THEN 0 WHEN 'unsupported' THEN 1 ELSE 2 END) WHEN 0 THEN 'deleted' WHEN 1 THEN 'unsupported' ELSE 'supported' END AS support, count(*) AS n_states FROM s GROUP BY 1")
def support_contract(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "F", "tombstone").when(F.col("o_orderstatus") == "P", "unsupported").otherwise("current")
    return C.support(T.read(spark, d, "orders").select("o_custkey", kind.alias("state_kind")), ["o_custkey"])


@query("SELECT CASE min(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END) WHEN 0 THEN 'deleted' WHEN 1 THEN 'unsupported' ELSE 'supported' END AS support, count(DISTINCT o_custkey) AS n_slots FROM orders")
def support_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return C.aggregate_support(support_contract(spark, d))


@query("WITH x AS (SELECT l_orderkey, l_linenumber, l_returnflag, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS n, first_value(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_returnflag DESC) AS w FROM lineitem) SELECT l_orderkey, l_linenumber, l_returnflag FROM x WHERE l_linenumber < n AND l_returnflag <> w")
def same_instant_predecessors(spark: SparkSession, d: str) -> DataFrame:
    c = T.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_returnflag").alias("object_value"), F.lit(1).cast("long").alias("valid_from_ms"), F.lit(1).cast("long").alias("observed_at_ms"), F.lit(None).cast("long").alias("valid_to_ms"), F.col("l_linenumber").cast("long").alias("source_sequence_no"))
    return C.same_instant(c, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_returnflag")


# corrections of spans ------------------------------------------------------------------------------------------------


@query(
    """WITH t AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1), s AS (SELECT DISTINCT doc_id FROM documents, benchmark WHERE item_id % 10 = 0 AND contains(lower(documents.text), lower(trim(left(benchmark.text, 40)))))
SELECT 'doc_' || doc_id AS id FROM documents WHERE (doc_id IN (SELECT doc_id FROM t) AND doc_id % 3 = 0) OR (doc_id NOT IN (SELECT doc_id FROM t) AND doc_id NOT IN (SELECT doc_id FROM s))"""
)
def span_corrections(spark: SparkSession, d: str) -> DataFrame:
    """Spans that no correction excludes: named ones are deleted at 0, selected ones forgotten at 5, some restored at 10."""
    hits = T.read(spark, d, "documents").select(F.concat(F.lit("doc_"), "doc_id").alias("id"), "text")
    toxic = T.read(spark, d, "labels").where("toxic = 1").select("doc_id").distinct()
    none, ids = F.lit(None).cast("string"), F.array(F.concat(F.lit("doc_"), "doc_id"))
    row = lambda df, key, op, at, targets, selector: df.select(F.concat(F.lit(f"{op}_"), key).alias("id"), F.lit("active").alias("status"), F.lit("span").alias("target_type"), F.lit(op).alias("operation"), F.lit(at).cast("long").alias("effective_at_ms"), targets.alias("target_ids"), selector.alias("target_selector"))
    named = row(toxic, "doc_id", "tombstone", 0, ids, none)
    back = row(toxic.where("doc_id % 3 = 0"), "doc_id", "restore", 10, ids, none)
    chosen = row(T.read(spark, d, "benchmark").where("item_id % 10 = 0"), "item_id", "forget", 5, F.array().cast("array<string>"), F.substring("text", 1, 40))
    return R.span_exclusions(hits, named.union(back).union(chosen)).select("id")


@query("SELECT item_id, count(*) AS n_docs FROM benchmark, documents WHERE contains(lower(documents.text), lower(trim(left(benchmark.text, 40)))) GROUP BY 1")
def selector_theta_join(spark: SparkSession, d: str) -> DataFrame:
    """Selectors against all texts."""
    b = T.read(spark, d, "benchmark").select("item_id", F.substring("text", 1, 40).alias("selector"))
    docs = T.read(spark, d, "documents").select(F.col("text").alias("body"))
    return C.selector_join(docs, b, "selector", "body").groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))


# rules ---------------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, r_name AS derived_value, 1 AS hop FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def derive_one_hop(spark: SparkSession, d: str) -> DataFrame:
    """Rule (nation) -> (region): one rule per nation, derived along one hop."""
    c, n, r = (T.read(spark, d, t) for t in ("customer", "nation", "region"))
    claims = c.select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("nation_"), "c_nationkey").alias("slot_id"), F.col("c_custkey").cast("string").alias("subject"), F.col("c_nationkey").cast("string").alias("object_value"))
    rules = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.concat(F.lit("nation_"), "n_nationkey").alias("trigger_slot_id"), F.concat(F.lit("region_"), "r_regionkey").alias("target_slot_id"), F.lit("derive_value").alias("action"), F.col("r_name").alias("value"), F.lit("{value}").alias("value_template"))
    return U.propagate(claims, rules, 1).select(F.col("root_id").cast("long").alias("c_custkey"), F.col("value").alias("derived_value"), "hop")


@query("SELECT c_custkey, hop, v AS derived_value FROM (SELECT c_custkey, 1 AS hop, n_name AS v FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT c_custkey, 2, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)")
def derive_two_hop(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = (T.read(spark, d, t) for t in ("customer", "nation", "region"))
    claims = c.select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("key_"), "c_nationkey").alias("slot_id"), F.col("c_custkey").cast("string").alias("subject"), F.col("c_nationkey").cast("string").alias("object_value"))
    first = n.select(F.concat(F.lit("key_"), "n_nationkey").alias("trigger_slot_id"), F.concat(F.lit("nation_"), "n_nationkey").alias("target_slot_id"), F.lit("derive_value").alias("action"), F.col("n_name").alias("value"), F.lit("{value}").alias("value_template"))
    second = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.concat(F.lit("nation_"), "n_nationkey").alias("trigger_slot_id"), F.concat(F.lit("region_"), "r_regionkey").alias("target_slot_id"), F.lit("derive_value").alias("action"), F.col("r_name").alias("value"), F.lit("{value}").alias("value_template"))
    return U.propagate(claims, first.union(second), 8).select(F.col("root_id").cast("long").alias("c_custkey"), "hop", F.col("value").alias("derived_value"))


@query(f"WITH e AS ({EV}), x AS (SELECT *, lag(object_value) OVER (PARTITION BY user_id, event_type ORDER BY ms, event_id) AS p, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ms, event_id) AS pid FROM e) SELECT 'claim_ev_' || event_id AS trigger_id, CASE WHEN pid IS NULL THEN 'no_prior_value' WHEN p = object_value THEN 'no_value_change' ELSE 'applied_unsupported' END AS status FROM x WHERE event_type = 'signup'")
def rule_activation(spark: SparkSession, d: str) -> DataFrame:
    c = T.claims(spark, d).where("predicate = 'signup'")
    rules = c.select(F.col("slot_id").alias("trigger_slot_id")).distinct().select(F.concat(F.lit("rule_"), "trigger_slot_id").alias("id"), "trigger_slot_id", F.lit("t").alias("target_slot_id"), F.lit("on_change").alias("activation"), F.lit("mark_unsupported").alias("action"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("value_template"), F.lit(None).cast("long").alias("valid_from_ms"), F.lit(None).cast("long").alias("valid_to_ms"))
    return U.activation(c, rules).select("trigger_id", "status")


@query(f"WITH e AS ({EV}), t AS (SELECT user_id, max(ms) AS ms FROM e WHERE event_type = 'signup' GROUP BY 1), g AS (SELECT * FROM e WHERE event_type = 'purchase') SELECT 'claim_ev_' || event_id AS id FROM g JOIN t USING (user_id) WHERE t.ms > g.ms")
def stale_targets(spark: SparkSession, d: str) -> DataFrame:
    c = T.claims(spark, d)
    t = c.where("predicate = 'signup'").groupBy(F.col("user_id").alias("pair")).agg(F.max("valid_from_ms").alias("start")).withColumn("seq", F.lit(None).cast("long"))
    g = c.where("predicate = 'purchase'").select(F.col("user_id").alias("pair"), F.col("valid_from_ms").alias("start"), F.lit(None).cast("long").alias("seq"), "id")
    return U.stale_targets(t, g).select("g.id")


@query("WITH RECURSIVE e AS (SELECT DISTINCT 'cust_' || c_custkey AS src, 'nation_' || c_nationkey AS dst FROM customer UNION SELECT 'nation_' || n_nationkey, 'region_' || n_regionkey FROM nation), w AS (SELECT 'region_1' AS node, 0 AS hop UNION SELECT e.src, w.hop + 1 FROM w JOIN e ON e.dst = w.node WHERE w.hop < 8) SELECT node, CAST(min(hop) AS INTEGER) AS hop FROM w GROUP BY 1")
def dependency_closure(spark: SparkSession, d: str) -> DataFrame:
    c, n = T.read(spark, d, "customer"), T.read(spark, d, "nation")
    e = c.select(F.concat(F.lit("cust_"), "c_custkey").alias("src"), F.concat(F.lit("nation_"), "c_nationkey").alias("dst")).union(n.select(F.concat(F.lit("nation_"), "n_nationkey"), F.concat(F.lit("region_"), "n_regionkey")))
    return G.closure(e, spark.createDataFrame([("region_1",)], "node string"))


@query("WITH RECURSIVE e AS (SELECT 'co_' || o_orderkey AS id, 'cust_' || o_custkey AS src, 'order_' || o_orderkey AS dst, CAST(1 AS DOUBLE) AS c FROM orders UNION ALL SELECT 'op_' || concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey), 'order_' || l_orderkey, 'part_' || l_partkey, round(1 - l_discount, 2) FROM lineitem), u AS (SELECT src AS a, dst AS b FROM e UNION ALL SELECT dst, src FROM e), n AS (SELECT 'cust_1' AS node, 0 AS hop UNION SELECT u.b, n.hop + 1 FROM n JOIN u ON u.a = n.node WHERE n.hop < 2), f AS (SELECT node, min(hop) AS hop FROM n GROUP BY 1) SELECT e.id, CAST(min(f.hop + 1) AS INTEGER) AS depth, round(min(e.c / 1.0) / min(f.hop + 1), 6) AS score FROM e JOIN f ON f.node = e.src OR f.node = e.dst WHERE f.hop < 2 GROUP BY e.id")
def graph_expand_ranked(spark: SparkSession, d: str) -> DataFrame:
    out = G.expand(T.edges(spark, d), spark.createDataFrame([("cust_1",)], "entity string"), 2)
    return out.select("id", "depth", F.round("score", 6).alias("score"))


@query("WITH c AS (SELECT c_custkey, c_nationkey FROM customer), n AS (SELECT c_nationkey, count(*) AS k, min(c_custkey) AS one FROM c GROUP BY 1) SELECT s_suppkey, CASE WHEN k = 1 THEN one END AS entity_id FROM supplier LEFT JOIN n ON c_nationkey = s_nationkey")
def entity_alias_resolution(spark: SparkSession, d: str) -> DataFrame:
    a = T.read(spark, d, "customer").select(F.concat(F.lit("Nation "), "c_nationkey").alias("alias"), F.col("c_custkey").alias("entity_id"))
    s = T.read(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("NATION  "), "s_nationkey").alias("subject"))
    return G.resolve_entities(s, a).select("s_suppkey", "entity_id")


# ingest and text -----------------------------------------------------------------------------------------------------


@query("WITH b AS (SELECT doc_id, text, length(text) AS n, greatest(CAST(ceil((length(text) - 1200) / 1000.0) AS BIGINT), 0) AS last FROM documents WHERE length(text) > 0), c AS (SELECT doc_id, text, n, unnest(generate_series(0, last)) AS i FROM b) SELECT doc_id, CAST(i AS INTEGER) AS span_index, i * 1000 AS char_start, least(i * 1000 + 1200, n) AS char_end, sha256(substring(text, i * 1000 + 1, 1200)) AS text_hash FROM c")
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return I.chunk(T.read(spark, d, "documents"), "doc_id").select(F.col("source_id").alias("doc_id"), "span_index", "char_start", "char_end", "text_hash")


@query(f"SELECT doc_id, count(*) AS n_terms, count(DISTINCT t) AS n_distinct FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '{WORD}')) AS t FROM documents) WHERE t <> '' GROUP BY 1")
def lexical_terms(spark: SparkSession, d: str) -> DataFrame:
    t = T.read(spark, d, "documents").select("doc_id", S.lexical_terms("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct")).where("n_terms > 0")


@query(f"SELECT t AS term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '{WORD}')) AS t FROM documents) WHERE t <> '' GROUP BY 1")
def term_stats(spark: SparkSession, d: str) -> DataFrame:
    return R.term_stats(T.read(spark, d, "documents"), "doc_id", "text")


@query("SELECT CAST(conv_id AS VARCHAR) AS thread_id, count(*) AS n, CASE WHEN bool_or(role <> 'assistant') THEN 'state_bearing' ELSE 'context' END AS role FROM conversations GROUP BY 1")
def evidence_role(spark: SparkSession, d: str) -> DataFrame:
    e = T.episodes(spark, d)
    n = e.groupBy("thread_id").agg(F.count(F.lit(1)).alias("n"))
    return I.evidence_role(e, "thread_id").join(n, "thread_id").select("thread_id", "n", "role")


@query("SELECT 'claim_' || e.event_id AS id, 'ep_' || (e.event_id % 400) || '_' || (e.event_id % 9) AS evidence_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = e.event_id % 400 AND c.turn = e.event_id % 9)")
def evidence_validation(spark: SparkSession, d: str) -> DataFrame:
    c = T.read(spark, d, "events").select(F.concat(F.lit("claim_"), "event_id").alias("id"), F.array(F.concat(F.lit("ep_"), F.col("event_id") % 400, F.lit("_"), F.col("event_id") % 9)).alias("refs"))
    return I.missing_evidence(c, T.episodes(spark, d), "refs")


@query("SELECT doc_id, greatest(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')), CAST(ceil(length(text) / 4.0) AS BIGINT), 1) AS tokens FROM documents")
def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    return T.read(spark, d, "documents").select("doc_id", S.estimate_tokens("text").cast("long").alias("tokens"))


@query("SELECT doc_id, len(regexp_extract_all(text, '(?i)\\b(idiot|moron|clown)\\b')) AS n_masked FROM documents")
def mask_values(spark: SparkSession, d: str) -> DataFrame:
    masked = S.mask_values("text", ["idiot", " Moron ", "clown", "of"])
    gap = F.size(F.split(masked, r"\[forgotten\]", -1)) - F.size(F.split(F.col("text"), r"\[forgotten\]", -1))
    return T.read(spark, d, "documents").select("doc_id", gap.cast("long").alias("n_masked"))


# retrieval -----------------------------------------------------------------------------------------------------------


def _bm25_sql(docs: str, key: str, corpus: str, k: int, ratio: float | None = None) -> str:
    terms = ", ".join(f"'{t}'" for t in TERMS)
    n = "(SELECT count(*) FROM base)"
    avg = "(SELECT greatest(avg(dl), 1.0) FROM base)" if corpus == "sources" else "(SELECT avg(dl) FROM base)"
    where = {"all": "WHERE dl > 0", "matched": "WHERE id IN (SELECT id FROM tf)", "sources": ""}[corpus]
    skip = f"AND df <= greatest(1, {ratio} * {n})" if ratio else ""
    return f"""
WITH d AS ({docs}), x AS (SELECT id, len(list_filter(string_split_regex(lower(coalesce(text, '')), '{WORD}'), lambda t: t <> '')) AS dl, list_filter(string_split_regex(lower(coalesce(text, '')), '{WORD}'), lambda t: t <> '') AS ts FROM d),
tf AS (SELECT id, t, count(*) AS tf FROM (SELECT id, unnest(ts) AS t FROM x) WHERE t IN ({terms}) GROUP BY 1, 2),
base AS (SELECT id, dl FROM x {where}),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT tf.id, sum(ln(({n} - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / {avg}))) AS score FROM tf JOIN df USING (t) JOIN x USING (id) WHERE true {skip} GROUP BY 1)
SELECT id AS {key}, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT {k}"""


@query(_bm25_sql("SELECT doc_id AS id, text FROM documents", "doc_id", "all", 50))
def keyword_bm25_all(spark: SparkSession, d: str) -> DataFrame:
    out = R.bm25(T.read(spark, d, "documents"), QUERY_TEXT, 50, id_col="doc_id")
    return out.select("doc_id", F.round("score", 6).alias("score"))


@query(_bm25_sql("SELECT doc_id AS id, text FROM documents", "doc_id", "matched", 50))
def keyword_bm25_matched(spark: SparkSession, d: str) -> DataFrame:
    out = R.bm25(T.read(spark, d, "documents"), QUERY_TEXT, 50, id_col="doc_id", corpus="matched")
    return out.select("doc_id", F.round("score", 6).alias("score"))


@query(_bm25_sql("SELECT conv_id AS id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1", "conv_id", "sources", 20, 0.9))
def keyword_bm25_source(spark: SparkSession, d: str) -> DataFrame:
    c = T.read(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), "\n").alias("text"))
    out = R.bm25(c, QUERY_TEXT, 20, id_col="conv_id", corpus="sources", max_df_ratio=0.9)
    return out.select("conv_id", F.round("score", 6).alias("score"))


VEC = "SELECT vec_id, label, list_cosine_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS dist FROM embeddings"


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return list(T.read(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0])


@query(f"SELECT 'vec_' || lpad(CAST(vec_id AS VARCHAR), 8, '0') AS id, round(dist, 6) AS score FROM ({VEC}) ORDER BY dist, vec_id LIMIT 20")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.vector_top_k(T.vector_spans(spark, d), _query_vector(spark, d), 20).select("id", F.round("score", 6).alias("score"))


@query(f"WITH v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY dist, vec_id) - 1 AS r FROM ({VEC}) ORDER BY dist, vec_id LIMIT 40), k AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS r FROM ({_bm25_sql('SELECT doc_id AS id, text FROM documents', 'doc_id', 'all', 40)})) SELECT id, round(sum(1.0 / (61 + r)), 6) AS score FROM (SELECT * FROM v UNION ALL SELECT * FROM k) GROUP BY 1 ORDER BY sum(1.0 / (61 + r)) DESC, id LIMIT 30")
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    v = R.ranked(R.vector_top_k(T.vector_spans(spark, d), _query_vector(spark, d), 40), F.col("score"), F.col("seq")).select(F.col("seq").alias("id"), "rank")
    k = R.bm25(T.read(spark, d, "documents"), QUERY_TEXT, 40, id_col="doc_id").withColumn("score", F.round("score", 6))
    k = R.ranked(k, F.desc("score"), F.col("doc_id")).select(F.col("doc_id").alias("id"), "rank")
    return R.rrf([(v, 1.0), (k, 1.0)], 30).select("id", F.round("score", 6).alias("score"))


@query(f"WITH v AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY dist, vec_id) AS n FROM ({VEC})), s AS (SELECT label, row_number() OVER (ORDER BY dist, vec_id) AS sr FROM v WHERE n = 1) SELECT vec_id, CAST(n AS INTEGER) AS rank_in_source, CAST(sr AS INTEGER) AS source_rank FROM v JOIN s USING (label) WHERE n <= 3 AND sr <= 5")
def source_diverse(spark: SparkSession, d: str) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in _query_vector(spark, d)])
    hits = T.vector_spans(spark, d).withColumn("score", S.cosine_distance(F.col("embedding"), q)).drop("embedding")
    return R.source_diverse(hits, 5, 3, order=[F.col("score"), F.col("seq")]).select(F.col("seq").alias("vec_id"), "rank_in_source", "source_rank")


@query("WITH h AS (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS rank FROM conversations WHERE turn = 1), b AS (SELECT c.conv_id, c.turn, h.rank, 1.0 / (1 + abs(c.turn - h.turn)) AS score FROM h JOIN conversations c ON c.conv_id = h.conv_id AND c.turn BETWEEN h.turn - 1 AND h.turn + 1) SELECT conv_id, turn, round(score, 6) AS score FROM b QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY rank) = 1")
def neighbor_completion(spark: SparkSession, d: str) -> DataFrame:
    s = T.spans(spark, d)
    hits = s.where("span_index = 1").select("source_id", "span_index", F.col("source_id").cast("long").alias("rank"), F.lit(1.0).alias("score"))
    out = R.neighbors(hits, s.select("source_id", "span_index", "id"), 1, 1)
    return out.select(F.col("source_id").cast("long").alias("conv_id"), F.col("span_index").cast("long").alias("turn"), F.round("score", 6).alias("score"))


@query(f"WITH t AS (SELECT DISTINCT doc_id, t FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '{WORD}')) AS t FROM documents) WHERE t IN ('idiot', 'moron', 'akia', 'the', 'password')), r AS (SELECT t FROM t GROUP BY 1 HAVING count(*) <= 50) SELECT DISTINCT doc_id FROM t WHERE t IN (SELECT t FROM r)")
def rare_term_states(spark: SparkSession, d: str) -> DataFrame:
    s = T.read(spark, d, "documents").select(F.col("doc_id").alias("id"), S.lexical_terms("text").alias("lexical_terms"))
    return R.rare_terms(s, ["idiot", "moron", "akia", "the", "password"]).select(F.col("id").alias("doc_id"))


@query("WITH m AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY 1) SELECT label, round(sum(abs(x / n)), 4) AS l1, round(sum(x / n * i), 4) AS weighted FROM m JOIN n USING (label) WHERE n > 0 GROUP BY 1")
def mean_embedding(spark: SparkSession, d: str) -> DataFrame:
    m = R.mean_embedding(T.read(spark, d, "embeddings"), "label")
    return m.select("label", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.abs(x)), 4).alias("l1"), F.round(F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 4).alias("weighted"))


METRICS_SQL = """
WITH h AS (SELECT source AS query, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1 AS rank FROM documents),
t AS (SELECT * FROM h WHERE rank < 10),
rel AS (SELECT source AS query, doc_id AS id FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
bad AS (SELECT source AS query, doc_id AS id FROM documents JOIN labels USING (doc_id) WHERE toxic = 1),
j AS (SELECT t.*, rel.id IS NOT NULL AS r, bad.id IS NOT NULL AS b FROM t LEFT JOIN rel ON t.query = rel.query AND t.id = rel.id LEFT JOIN bad ON t.query = bad.query AND t.id = bad.id),
p AS (SELECT query, count(*) AS n, count(*) FILTER (WHERE r) AS found, min(rank) FILTER (WHERE r) AS first, coalesce(sum(1 / log2(rank + 2.0)) FILTER (WHERE r), 0) AS dcg, count(*) FILTER (WHERE b) AS bad FROM j GROUP BY 1),
w AS (SELECT query, count(*) AS n_rel FROM rel GROUP BY 1)
SELECT query, round(coalesce(found, 0) / n_rel, 6) AS recall, round(coalesce(1.0 / (first + 1), 0), 6) AS reciprocal_rank,
       round(coalesce(dcg, 0) / list_sum(list_transform(generate_series(0, least(n_rel, 10) - 1), lambda i: 1 / log2(i + 2.0))), 6) AS ndcg, round(coalesce(bad / n, 0), 6) AS stale_rate
FROM w LEFT JOIN p USING (query)
"""


@query(METRICS_SQL)
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    docs, lab = T.read(spark, d, "documents").select("doc_id", "source", "n_chars"), T.read(spark, d, "labels")
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")) - 1
    hits = docs.select(F.col("source").alias("query"), F.col("doc_id").alias("id"), rank.alias("rank"))
    j = docs.join(lab, "doc_id").select(F.col("source").alias("query"), F.col("doc_id").alias("id"), "quality", "toxic")
    out = M.metrics(hits, j.where("quality = 1"), 10, j.where("toxic = 1"))
    return out.select("query", *[F.round(c, 6).alias(c) for c in ("recall", "reciprocal_rank", "ndcg", "stale_rate")])


# the filter dialect --------------------------------------------------------------------------------------------------

FILTERS = {
    "compare": ("orders", "o_orderkey", "o_totalprice >= 100000 AND o_orderstatus != 'F'", "o_totalprice >= 100000 AND o_orderstatus <> 'F'"),
    "and_or": ("orders", "o_orderkey", "(o_orderstatus = 'O' OR o_orderstatus = 'P') AND o_custkey < 50", "(o_orderstatus = 'O' OR o_orderstatus = 'P') AND o_custkey < 50"),
    "null": ("orders", "o_orderkey", "o_orderpriority IS NOT NULL", "o_orderpriority IS NOT NULL"),
    "in": ("lineitem", "l_orderkey", "l_returnflag IN ('A', 'N') AND l_suppkey NOT IN (1, 2, 3)", "l_returnflag IN ('A', 'N') AND l_suppkey NOT IN (1, 2, 3)"),
    "like_prefix": ("part", "p_partkey", "p_name LIKE 'p%'", "p_name LIKE 'p%'"),
    "like_suffix": ("part", "p_partkey", "p_name LIKE '%1'", "p_name LIKE '%1'"),
    "like_pattern": ("part", "p_partkey", "p_type LIKE '%S_E%'", "p_type LIKE '%S_E%'"),
}


def _filter(name: str, table: str, key: str, text: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return FD.where(T.read(spark, d, table), text).select(key)

    run.__name__ = f"filter_{name}"
    return run


for _name, (_table, _key, _text, _sql) in FILTERS.items():
    query(f"SELECT {_key} FROM {_table} WHERE {_sql}")(_filter(_name, _table, _key, _text))

TERM_SETS = f"SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '{WORD}'), lambda t: t <> '')) AS ts FROM documents"


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return T.read(spark, d, "documents").select("doc_id", F.array_distinct(S.lexical_terms("text")).alias("terms"))


@query(f"SELECT doc_id FROM ({TERM_SETS}) WHERE list_has_any(ts, ['idiot', 'moron'])")
def filter_contain_any(spark: SparkSession, d: str) -> DataFrame:
    return FD.where(_terms(spark, d), "terms CONTAIN_ANY ('idiot', 'moron')").select("doc_id")


@query(f"SELECT doc_id FROM ({TERM_SETS}) WHERE list_has_all(ts, ['the', 'heron'])")
def filter_contain_all(spark: SparkSession, d: str) -> DataFrame:
    return FD.where(_terms(spark, d), "terms CONTAIN_ALL ('the', 'heron')").select("doc_id")


@query(f"SELECT doc_id FROM ({TERM_SETS}) WHERE NOT list_has_any(ts, ['the'])")
def filter_not_contain(spark: SparkSession, d: str) -> DataFrame:
    return FD.where(_terms(spark, d), "terms NOT CONTAIN_ANY ('the')").select("doc_id")


@query(f"SELECT doc_id FROM ({TERM_SETS}) WHERE len(ts) >= 300")
def filter_array_length(spark: SparkSession, d: str) -> DataFrame:
    return FD.where(_terms(spark, d), "array_length(terms) >= 300").select("doc_id")


# storage semantics ---------------------------------------------------------------------------------------------------


def _store(spark: SparkSession, d: str) -> tuple[Store, DataFrame]:
    """A fresh store of one table, and the orders as its rows: the customer is the key, the order number the order."""
    o = T.read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("id"), "o_orderkey", "o_orderstatus", "o_totalprice")
    return Store.create(spark, shared(spark, "store"), "orders", {"orders": o.schema}), o


@query("SELECT o_custkey AS o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1 UNION ALL SELECT o_custkey, min(o_orderkey) FROM orders GROUP BY 1 HAVING count(*) FILTER (WHERE o_orderkey % 2 = 0) = 0")
def insert_only(spark: SparkSession, d: str) -> DataFrame:
    """First write of a key wins, in a call and between calls."""
    store, o = _store(spark, d)
    store.insert("orders", o.where("o_orderkey % 2 = 0"), "o_orderkey")
    store.insert("orders", o, "o_orderkey")
    return store.table("orders").select(F.col("id").cast("long").alias("o_custkey"), "o_orderkey")


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, max_by(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """Last write of a key wins, in a call and between calls, over a compacted table."""
    store, o = _store(spark, d)
    middle = o.agg(F.percentile_approx("o_orderkey", 0.5)).first()[0]
    store.upsert("orders", o.where(F.col("o_orderkey") <= middle), "o_orderkey")
    store.compact("orders")
    store.upsert("orders", o.where(F.col("o_orderkey") > middle), "o_orderkey")
    return store.table("orders").select(F.col("id").cast("long").alias("o_custkey"), "o_orderkey", "o_orderstatus")


LATEST = "SELECT o_custkey, max(o_orderkey) AS k, max_by(o_orderstatus, o_orderkey) AS s, max_by(o_totalprice, o_orderkey) AS p FROM orders GROUP BY 1"


@query(f"SELECT k AS o_orderkey FROM ({LATEST}) WHERE NOT (s = 'F' AND p < 200000)")
def delete_by_filter(spark: SparkSession, d: str) -> DataFrame:
    store, o = _store(spark, d)
    store.upsert("orders", o, "o_orderkey")
    store.delete("orders", "o_orderstatus = 'F' AND o_totalprice < 200000")
    return store.table("orders").select("o_orderkey")


@query(f"SELECT k AS o_orderkey FROM ({LATEST}) WHERE s = 'O' ORDER BY CAST(o_custkey AS VARCHAR) LIMIT 100")
def prefix_scan(spark: SparkSession, d: str) -> DataFrame:
    """A filtered scan in storage order, cut after the filter."""
    store, o = _store(spark, d)
    latest = C.newest(o, ["id"], [F.desc("o_orderkey")]).orderBy("id").coalesce(1)
    store.commit({"orders": latest.withColumn(OP, F.lit("put"))})
    return store.scan("orders", "o_orderstatus = 'O'", 100).select("o_orderkey")


# jobs, erasure, packing, validation ----------------------------------------------------------------------------------


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    return T.episodes(spark, d).select(F.concat(F.lit("xjob_"), "id").alias("id"), "thread_id", "sequence_no", F.when(F.col("sequence_no") == 2, "failed").when((F.col("sequence_no") == 0) & (F.col("thread_id").cast("long") % 3 == 0), "leased").otherwise("pending").alias("status"), F.lit(0).alias("attempt_count"), (F.col("event_time_ms") % 7000).alias("lease_expires_at_ms"), F.col("event_time_ms").alias("created_at_ms"))


JOBS = "SELECT 'xjob_ep_' || conv_id || '_' || turn AS id, conv_id, turn, CASE WHEN turn = 2 THEN 'failed' WHEN turn = 0 AND conv_id % 3 = 0 THEN 'leased' ELSE 'pending' END AS status, (conv_id * 100000 + turn * 1000) % 7000 AS exp, conv_id * 100000 + turn * 1000 AS created FROM conversations"


@query(f"WITH j AS ({JOBS}), f AS (SELECT conv_id, min(turn) AS t FROM j GROUP BY 1) SELECT id FROM j JOIN f ON j.conv_id = f.conv_id AND j.turn = f.t WHERE status = 'pending' OR (status = 'leased' AND exp <= 3000)")
def job_lease_order(spark: SparkSession, d: str) -> DataFrame:
    return M.leasable(_jobs(spark, d), 3000, 5).select("id")


@query(f"SELECT count(*) AS n_jobs, count(*) FILTER (WHERE status = 'failed') AS n_failed, min(created) AS oldest_ms FROM ({JOBS}) WHERE turn <> 1")
def job_backlog(spark: SparkSession, d: str) -> DataFrame:
    """Open jobs only: the second turn's is skipped."""
    return M.backlog(_jobs(spark, d).withColumn("status", F.when(F.col("sequence_no") == 1, "skipped").otherwise(F.col("status"))))


@query("SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS refs FROM lineitem WHERE l_partkey % 4 <> 0 GROUP BY 1")
def strip_ids(spark: SparkSession, d: str) -> DataFrame:
    li = T.read(spark, d, "lineitem")
    rows = li.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda s: s["l_partkey"].cast("string")).alias("refs")).withColumn("id", F.col("l_orderkey"))
    erased = T.read(spark, d, "part").where("p_partkey % 4 = 0").select(F.col("p_partkey").cast("string").alias("id"))
    return M.strip_ids(rows, erased, ["refs"]).select("l_orderkey", F.array_join("refs", ",").alias("refs"))


@query("WITH t AS (SELECT conv_id, turn, greatest(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')), CAST(ceil(length(text) / 4.0) AS BIGINT), 1) AS n FROM conversations), r AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM t) SELECT conv_id, turn, CAST(run AS BIGINT) AS running FROM r WHERE run <= 200")
def pack_prefix(spark: SparkSession, d: str) -> DataFrame:
    return M.pack_prefix(T.read(spark, d, "conversations"), 200, ["conv_id"], [F.col("turn")]).select("conv_id", "turn", "running")


@query(
    """WITH RECURSIVE t AS (SELECT conv_id, turn, greatest(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')), CAST(ceil(length(text) / 4.0) AS BIGINT), 1) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
p AS (SELECT conv_id, turn, n, r, CASE WHEN n <= 200 THEN n ELSE 0 END AS used, n <= 200 AS kept FROM t WHERE r = 1
UNION ALL SELECT t.conv_id, t.turn, t.n, t.r, p.used + CASE WHEN p.used + t.n <= 200 THEN t.n ELSE 0 END, p.used + t.n <= 200 FROM p JOIN t ON t.conv_id = p.conv_id AND t.r = p.r + 1)
SELECT conv_id, turn FROM p WHERE kept UNION ALL SELECT conv_id, min(turn) FROM p GROUP BY conv_id HAVING NOT bool_or(kept)"""
)
def pack_greedy(spark: SparkSession, d: str) -> DataFrame:
    return M.pack_greedy(T.read(spark, d, "conversations").select("conv_id", "turn", "text"), 200, "conv_id", "turn").select("conv_id", "turn")


@query("WITH q AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN substring(text, 5, 30) ELSE 'no such quote' END AS quote FROM conversations) SELECT conv_id || '_' || turn AS id, contains(c.text, quote) AS found FROM q JOIN conversations c USING (conv_id, turn)")
def quote_validation(spark: SparkSession, d: str) -> DataFrame:
    c = T.read(spark, d, "conversations").withColumn("text_id", F.concat_ws("_", "conv_id", "turn"))
    q = c.select(F.col("text_id").alias("id"), "text_id", F.when(F.col("turn") % 2 == 0, F.substring("text", 5, 30)).otherwise("no such quote").alias("quote"))
    return M.quotes_found(q, c.select("text_id", "text"))


# projection, rankings, validation ------------------------------------------------------------------------------------


@query(f"WITH e AS ({EV}), r AS (SELECT user_id, max(ms) AS eff FROM e WHERE event_type = 'error' GROUP BY 1), k AS (SELECT e.*, event_type = 'signup' AND eff IS NOT NULL AND ms <= eff AS gone FROM e LEFT JOIN r ON e.user_id = r.user_id), n AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ms DESC, event_id DESC) = 1) SELECT user_id, event_type, CASE WHEN gone THEN 'tombstone' ELSE 'current' END AS state_kind, object_value FROM n")
def scope_rebuild(spark: SparkSession, d: str) -> DataFrame:
    out = PJ.rebuild(T.claims(spark, d), T.retractions(spark, d), None, 1)
    return out.select(F.col("user_id").cast("long").alias("user_id"), F.col("predicate").alias("event_type"), "state_kind", "object_value")


@query(f"WITH v AS (SELECT label, min(r) AS best FROM (SELECT label, row_number() OVER (ORDER BY dist, vec_id) - 1 AS r FROM ({VEC}) ORDER BY dist, vec_id LIMIT 160) GROUP BY 1), vr AS (SELECT label, row_number() OVER (ORDER BY best, label) - 1 AS rank FROM v), l AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), lr AS (SELECT label, row_number() OVER (ORDER BY n DESC, label) - 1 AS rank FROM l) SELECT label, round(sum(1.0 / (61 + rank)), 6) AS score FROM (SELECT * FROM vr UNION ALL SELECT * FROM lr) GROUP BY 1")
def slot_rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    hits = R.ranked(R.vector_top_k(T.vector_spans(spark, d), _query_vector(spark, d), R.fetch_k(20)), F.col("score"), F.col("seq"))
    vector = PJ.rank_slots(hits.select(F.regexp_replace("source_id", "label_", "").cast("int").alias("slot_id"), "rank"), 1000)
    n = T.read(spark, d, "embeddings").groupBy(F.col("label").alias("slot_id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "slot_id").limit(1000)
    lexical = R.ranked(n, F.desc("n"), F.col("slot_id"))
    return PJ.fuse_slots(vector, lexical, 1000).select(F.col("slot_id").alias("label"), F.round("score", 6).alias("score"))


@query(f"WITH e AS ({EV}), a AS (SELECT DISTINCT event_type AS p, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'signup' THEN 'slot_a' ELSE NULL END AS s FROM e WHERE event_type IN ('signup', 'error')) SELECT 'claim_ev_' || event_id AS id, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'signup' THEN 'slot_a' ELSE 'user ' || user_id || '|' || event_type END AS resolved_slot FROM e")
def slot_alias_resolution(spark: SparkSession, d: str) -> DataFrame:
    """signup has one alias slot, error has two and so none."""
    c = T.claims(spark, d)
    pairs = c.where("predicate in ('signup', 'error')").select(F.col("subject").alias("alias_subject_key"), F.col("predicate").alias("alias_predicate_key")).distinct()
    two = pairs.where("alias_predicate_key = 'error'").withColumn("canonical_slot_id", F.lit("slot_b"))
    aliases = pairs.withColumn("canonical_slot_id", F.lit("slot_a")).union(two)
    return PJ.resolve_slots(c, aliases).select("id", "resolved_slot")


@query(f"SELECT event_id AS id, user_id FROM ({EV}) WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ms DESC, 'claim_ev_' || event_id DESC) = 1")
def latest_direct_claims(spark: SparkSession, d: str) -> DataFrame:
    out = SC.latest_comparable(T.claims(spark, d).where("predicate = 'purchase'"))
    return out.select(F.col("source_sequence_no").alias("id"), F.col("user_id").cast("long").alias("user_id"))


@query("SELECT conv_id || '_' || turn AS id, CASE WHEN conv_id % 7 = 0 THEN 'unknown_slot' WHEN conv_id % 5 = 0 THEN 'not_supported' WHEN turn % 3 = 2 THEN 'no_evidence' WHEN NOT contains(text, CASE WHEN turn % 2 = 0 THEN substring(text, 3, 20) ELSE 'no such quote' END) THEN 'quote_mismatch' END AS reason FROM conversations")
def answer_validation(spark: SparkSession, d: str) -> DataFrame:
    c = T.read(spark, d, "conversations")
    key = F.concat_ws("_", "conv_id", "turn")
    answer = c.select(key.alias("id"), F.col("conv_id").alias("slot_id"), F.when(F.col("turn") % 3 != 2, key).alias("span_id"), F.when(F.col("turn") % 2 == 0, F.substring("text", 3, 20)).otherwise("no such quote").alias("quote"), F.lit("a sentence").alias("text"))
    support = c.select(F.col("conv_id").alias("slot_id")).distinct().where("slot_id % 7 <> 0").withColumn("support", F.when(F.col("slot_id") % 5 == 0, "deleted").otherwise("supported"))
    return PJ.validate_answer(answer, support, c.select(key.alias("span_id"), F.col("text").alias("span_text")))


WORD_AT = r"(?i)(^|[^\p{L}\p{N}])(the|and)([^\p{L}\p{N}]|$)"


@query(f"SELECT conv_id || '_' || turn AS id, CASE WHEN conv_id % 2 = 0 THEN regexp_replace(regexp_replace(text, '{WORD_AT}', '\\1[forgotten]\\3', 'g'), '{WORD_AT}', '\\1[forgotten]\\3', 'g') ELSE text END AS text FROM conversations")
def purge_forgotten(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts with the forgotten values hidden, in the affected sources only."""
    s = T.spans(spark, d)
    out = PJ.purge(s, ["the", "And"], s.where("cast(source_id as long) % 2 = 0").select("source_id"))
    return out.select(F.regexp_replace("id", "span_", "").alias("id"), "text")
