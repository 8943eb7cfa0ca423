"""Queries of the domain scans, slots, rules and canonical identity, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import canonical_part
from ..operators import canonical as K
from ..operators import rules as U
from ..operators import scans as SC
from ..sources import tables as T
from .registry import query

EV = "SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS ms, CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS object_value FROM events"
NONE = "cast(array() as array<string>)"


def _ids(df: DataFrame, name: str = "id") -> DataFrame:
    return df.select(F.col(df.columns[0]).alias(name)).distinct()


@query(
    f"""WITH e AS ({EV}), r AS (SELECT user_id, max(ms) AS eff FROM e WHERE event_type = 'error' GROUP BY 1)
SELECT 'claim_ev_' || event_id AS id, CASE WHEN event_type = 'signup' AND eff IS NOT NULL AND ms <= eff THEN 'retracted' ELSE 'active' END AS status
FROM e LEFT JOIN r ON e.user_id = r.user_id WHERE e.user_id % 3 = 0 AND event_type IN ('signup', 'click')
QUALIFY row_number() OVER (PARTITION BY e.user_id, event_type ORDER BY ms DESC, event_id DESC) = 1"""
)
def claims_of_slots(spark: SparkSession, d: str) -> DataFrame:
    """The newest version of some slots, of any status after corrections."""
    c = T.claims(spark, d)
    slots = c.where("cast(user_id as long) % 3 = 0 and predicate in ('signup', 'click')").select("slot_id").distinct()
    return SC.current_of_slots(c, slots, T.retractions(spark, d)).select("id", "status")


@query(
    f"""SELECT 'claim_ev_' || event_id AS id, event_type AS predicate FROM ({EV}) WHERE user_id % 4 = 0 OR user_id % 10 = 1
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ms DESC, event_id DESC) = 1"""
)
def claims_of_subjects(spark: SparkSession, d: str) -> DataFrame:
    """Subjects by entity where they have one, else by key."""
    c = T.claims(spark, d)
    u = F.col("user_id").cast("long")
    c = c.withColumn("subject_entity_id", F.when(u % 2 == 0, F.concat(F.lit("ent_"), "user_id")))
    some = c.where("cast(user_id as long) % 4 = 0 or cast(user_id as long) % 10 = 1").select("subject_entity_id", canonical_part("subject").alias("subject_key")).distinct()
    return SC.current_of_subjects(c, some, None).select("id", "predicate")


@query("SELECT 'al_' || c_custkey AS id, 'ent_' || c_custkey AS entity_id FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 = 0")
def aliases_for_keys(spark: SparkSession, d: str) -> DataFrame:
    c = T.read(spark, d, "customer")
    k = F.col("c_custkey")
    table = c.select(F.concat(F.lit("al_"), k).alias("id"), F.lit("active").alias("status"), canonical_part("c_name").alias("alias_key"), F.concat(F.lit("ent_"), k).alias("entity_id"), F.when(k % 5 == 0, F.lit(1)).cast("long").alias("superseded_at_ms"))
    return SC.aliases_for_keys(table, c.where("c_custkey % 7 = 0").select(F.upper("c_name").alias("name"))).select("id", "entity_id")


def _rules(spark: SparkSession, d: str) -> DataFrame:
    """A rule a part size: from the slot of one brand's parts to another's; odd sizes act on change."""
    s = T.read(spark, d, "part").select("p_size").distinct().select(F.col("p_size").alias("n"))
    n, none = F.col("n"), F.lit(None).cast("string")
    return s.select(
        F.concat(F.lit("rule_"), n).alias("id"), F.lit("sp").alias("space_id"), F.lit("active").alias("status"), F.concat(F.lit("size "), n).alias("trigger_subject"), F.lit("brand").alias("trigger_predicate"), F.concat(F.lit("size "), n).alias("trigger_subject_key"), F.lit("brand").alias("trigger_predicate_key"),
        none.alias("trigger_subject_entity_id"), F.concat(F.lit("slot_"), n).alias("trigger_slot_id"), F.when(n % 6 == 0, "pending").otherwise("bound").alias("trigger_binding_status"), F.concat(F.lit("size "), n + 1).alias("target_subject"), F.lit("brand").alias("target_predicate"),
        F.concat(F.lit("size "), n + 1).alias("target_subject_key"), F.lit("brand").alias("target_predicate_key"), none.alias("target_subject_entity_id"), F.concat(F.lit("slot_"), n + 1).alias("target_slot_id"), F.lit("bound").alias("target_binding_status"), F.lit("exact_slot").alias("target_match"),
        F.when(n % 2 == 1, "on_change").otherwise("continuous_projection").alias("activation"), F.when(n % 5 == 0, "mark_unsupported").otherwise("derive_value").alias("action"), none.alias("value_template"), none.alias("value"),
        F.array(F.concat(F.lit("sp_"), n)).alias("source_span_ids"), F.array(F.concat(F.lit("ep_"), n)).alias("source_episode_ids"), n.cast("long").alias("source_sequence_no"), (n * 10).cast("long").alias("valid_from_ms"), F.lit(None).cast("long").alias("valid_to_ms"),
    )


def _part_claims(spark: SparkSession, d: str) -> DataFrame:
    """Parts as claims on the brand of their size."""
    p, none = T.read(spark, d, "part"), F.lit(None).cast("string")
    k, n = F.col("p_partkey"), F.col("p_size")
    return p.select(
        F.concat(F.lit("cl_"), k).alias("id"), F.lit("sp").alias("space_id"), F.lit("active").alias("status"), F.concat(F.lit("Size "), n).alias("subject"), F.lit("brand").alias("predicate"), F.col("p_brand").alias("object_value"), none.alias("subject_entity_id"), F.concat(F.lit("slot_"), n).alias("slot_id"), none.alias("slot_facet"),
        F.lit("fact").alias("claim_kind"), F.when(k % 11 == 0, "negative").otherwise("affirmative").alias("polarity"), F.when(k % 13 == 0, "extractor_derived").otherwise("user").alias("asserted_by"), k.alias("observed_at_ms"), k.alias("valid_from_ms"), F.lit(None).cast("long").alias("valid_to_ms"), k.alias("source_sequence_no"),
        F.col("p_name").alias("claim_text"), F.array(F.concat(F.lit("sp_"), k % 100)).alias("source_span_ids"), F.array(F.concat(F.lit("ep_"), k % 50)).alias("source_episode_ids"),
    )


@query("SELECT 'rule_' || p_size AS rule_id, 'cl_' || p_partkey AS claim_id FROM part WHERE p_size % 6 <> 0")
def rules_for_claims(spark: SparkSession, d: str) -> DataFrame:
    return SC.rules_for_claims(_rules(spark, d), _part_claims(spark, d))


@query(
    """SELECT 'slot_' || p_size AS slot_id, 'cl_' || arg_max(p_partkey, p_partkey) AS claim_id, arg_max(p_brand, p_partkey) AS object_value
FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 AND p_size % 2 = 1 GROUP BY p_size"""
)
def repairable_triggers(spark: SparkSession, d: str) -> DataFrame:
    slots = _part_claims(spark, d).select(F.col("slot_id").alias("slot_key"), "space_id").distinct()
    return SC.repairable_triggers(_rules(spark, d), slots, _part_claims(spark, d)).select("slot_id", "claim_id", "object_value")


@query("SELECT DISTINCT 'slot_' || p_size AS slot_id FROM part WHERE p_partkey % 100 = 7 OR p_partkey % 50 = 3")
def evidence_slots(spark: SparkSession, d: str) -> DataFrame:
    return SC.slots_of_evidence(_part_claims(spark, d), spark.createDataFrame([("sp_7",), ("ep_3",)], "id string"))


STATE_KINDS = "CASE o_orderkey % 5 WHEN 0 THEN 'tombstone' WHEN 1 THEN 'unsupported' WHEN 2 THEN 'derived' WHEN 3 THEN 'current' ELSE 'set' END"


def _states(spark: SparkSession, d: str) -> DataFrame:
    """Orders as live states of their customer, of five kinds."""
    o = T.read(spark, d, "orders")
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("tombstone", "unsupported", "derived", "current", "set")]), (k % 5 + 1).cast("int"))
    t = T.millis("o_orderdate")
    return o.select(
        F.concat(F.lit("st_"), k).alias("id"), F.concat(F.lit("slot_"), "o_custkey").alias("slot_id"), F.lit("sp").alias("space_id"), kind.alias("state_kind"), F.lit("fact").alias("claim_kind"), F.concat(F.lit("Customer "), "o_custkey").alias("subject"), F.lower("o_orderpriority").alias("predicate"), F.col("o_orderstatus").alias("object_value"),
        F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("ent_"), "o_custkey")).alias("subject_entity_id"), F.col("o_orderpriority").alias("state_text"), t.alias("observed_at_ms"), t.alias("valid_from_ms"), F.lit(None).cast("long").alias("valid_to_ms"), t.alias("recorded_at_ms"), F.lit(None).cast("long").alias("superseded_at_ms"),
        F.array(F.concat(F.lit("cl_"), k)).alias("claim_ids"), F.array(F.concat(F.lit("sp_"), k % 40)).alias("source_spans"), F.array(F.concat(F.lit("r_"), k % 7)).alias("rule_ids"), F.when(k % 5 == 4, F.array(F.concat(F.lit("m "), k % 3), F.lit("Same"))).otherwise(F.expr(NONE)).alias("members"), k.alias("source_sequence_no"), F.lit("active").alias("status"), F.lit(None).cast("string").alias("slot_facet"),
    )


@query(
    f"""SELECT 'st_' || o_orderkey AS id FROM (SELECT o_orderkey, o_orderdate, CASE {STATE_KINDS} WHEN 'tombstone' THEN 0 WHEN 'unsupported' THEN 1 WHEN 'derived' THEN 2 WHEN 'current' THEN 3 ELSE 4 END AS p FROM orders)
ORDER BY p, o_orderdate, 'st_' || o_orderkey LIMIT 500"""
)
def states_by_priority(spark: SparkSession, d: str) -> DataFrame:
    return SC.states(_states(spark, d), 500).select("id")


@query("SELECT 'st_' || o_orderkey AS id FROM orders WHERE o_custkey % 3 = 0 AND o_custkey % 4 = 1")
def states_of_entities(spark: SparkSession, d: str) -> DataFrame:
    some = T.read(spark, d, "customer").where("c_custkey % 4 = 1").select(F.concat(F.lit("ent_"), "c_custkey").alias("id"))
    return SC.states_of(_states(spark, d), "subject_entity_id", some).select("id")


@query(f"SELECT 'slot_' || o_custkey AS slot_id, arg_min(k, p) AS state_kind FROM (SELECT o_custkey, {STATE_KINDS} AS k, o_orderkey % 5 AS p FROM orders) GROUP BY 1")
def state_kinds(spark: SparkSession, d: str) -> DataFrame:
    return SC.current_kinds(_states(spark, d)).select("slot_id", "state_kind")


@query(
    """WITH s AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderpriority, o_orderkey % 5 AS k5 FROM orders),
k AS (SELECT *, CASE k5 WHEN 0 THEN 'tombstone' WHEN 1 THEN 'unsupported' WHEN 2 THEN 'derived' WHEN 3 THEN 'current' ELSE 'set' END AS kind FROM s),
l AS (SELECT *, lag(kind) OVER w AS pk, lag(o_orderpriority) OVER w AS pp, lag(o_orderdate) OVER w AS pd FROM k WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, kind, o_orderpriority, 'st_' || o_orderkey))
SELECT 'st_' || o_orderkey AS id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, kind, o_orderpriority, 'st_' || o_orderkey) AS INTEGER) AS recency
FROM l WHERE pk IS NULL OR NOT (pk = kind AND pp = o_orderpriority AND pd = o_orderdate) QUALIFY recency <= 8"""
)
def recent_slot_states(spark: SparkSession, d: str) -> DataFrame:
    return SC.recent(_states(spark, d)).select("id", "recency")


def _slots(spark: SparkSession, d: str) -> DataFrame:
    """Orders as versions of their customer's slot identity."""
    k = F.col("o_orderkey")
    t = T.millis("o_orderdate")
    return T.read(spark, d, "orders").select(
        F.concat(F.lit("v_"), k).alias("id"), F.concat(F.lit("slot_"), "o_custkey").alias("slot_key"), F.lit("sp").alias("space_id"), F.concat(F.lit("customer "), "o_custkey").alias("subject_key"), F.lit("order").alias("predicate_key"), F.when(k % 3 != 0, F.concat(F.lit("Customer "), "o_custkey", F.lit(" as of "), k)).alias("subject"),
        F.lit("Order").alias("predicate"), F.lit(None).cast("string").alias("subject_entity_id"), F.array(F.concat(F.lit("cl_"), k % 10)).alias("source_claim_ids"), F.array(F.concat(F.lit("r_"), k % 3)).alias("source_rule_ids"), F.expr(NONE).alias("source_entity_ids"),
        t.alias("observed_at_ms"), t.alias("valid_from_ms"), F.lit(None).cast("long").alias("valid_to_ms"), k.alias("recorded_at_ms"), F.lit(None).cast("long").alias("superseded_at_ms"),
    )


@query(
    """SELECT 'slot_' || o_custkey AS slot_key, arg_min(CASE WHEN o_orderkey % 3 <> 0 THEN 'Customer ' || o_custkey || ' as of ' || o_orderkey END, o_orderkey) FILTER (WHERE o_orderkey % 3 <> 0) AS subject,
string_agg(DISTINCT 'cl_' || o_orderkey % 10, ',' ORDER BY 'cl_' || o_orderkey % 10) AS claims, min(epoch_us(o_orderdate) // 1000) AS observed_at_ms, min(o_orderkey) AS recorded_at_ms FROM orders GROUP BY 1"""
)
def slot_identity_merge(spark: SparkSession, d: str) -> DataFrame:
    return SC.merge_slots(_slots(spark, d)).select("slot_key", "subject", F.array_join("source_claim_ids", ",").alias("claims"), "observed_at_ms", "recorded_at_ms")


@query(
    """WITH n AS (SELECT DISTINCT p_size AS n FROM part), s AS (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IN (SELECT n FROM n)),
t AS (SELECT o_custkey, count(*) AS c FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS r FROM (SELECT DISTINCT o_custkey, o_orderdate, o_orderkey % 5, o_orderpriority FROM orders)) WHERE r <= 8 GROUP BY 1)
SELECT 'slot_' || s.o_custkey AS slot_id, CASE WHEN s.o_custkey % 3 = 0 THEN c_name END AS canonical_name, CASE WHEN s.o_custkey % 2 = 0 THEN 'customer ' || s.o_custkey || '|order' END AS surfaces, CAST(t.c AS INTEGER) AS n_recent,
CASE WHEN EXISTS (SELECT 1 FROM n WHERE n = s.o_custkey - 1) THEN 'slot_' || (s.o_custkey - 1) END AS triggers, 'slot_' || (s.o_custkey + 1) AS targets
FROM s JOIN customer ON c_custkey = o_custkey JOIN t ON t.o_custkey = s.o_custkey"""
)
def binding_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Slots with their entity, unambiguous surfaces, recent states and rule neighbours."""
    rules = _rules(spark, d)
    slots = _slots(spark, d).select("slot_key", "space_id").distinct().join(rules.select(F.col("trigger_slot_id").alias("slot_key")), "slot_key", "left_semi")
    k = F.regexp_replace("slot_key", "slot_", "").cast("long")
    slots = slots.withColumn("subject_entity_id", F.when(k % 3 == 0, F.concat(F.lit("ent_"), k)))
    c = T.read(spark, d, "customer")
    entities = c.select(F.concat(F.lit("ent_"), "c_custkey").alias("id"), F.lit("active").alias("status"), F.col("c_name").alias("canonical_name"))
    key = F.concat(F.lit("customer "), "c_custkey").alias("alias_subject_key")
    aliases = c.select(key, F.lit("order").alias("alias_predicate_key"), F.concat(F.lit("slot_"), "c_custkey").alias("canonical_slot_id"))
    aliases = aliases.union(c.where("c_custkey % 2 = 1").select(key, F.lit("order"), F.lit("slot_x")))
    out = SC.binding_contexts(slots, entities, aliases, _states(spark, d), rules)
    blank = lambda c: F.nullif(F.array_join(c, ","), F.lit(""))
    return out.select("slot_id", "canonical_name", blank("surfaces").alias("surfaces"), F.size("recent_states").alias("n_recent"), blank("triggers").alias("triggers"), blank("targets").alias("targets"))


# canonical identity ------------------------------------------------------------------------------------------------------


def _registries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Sizes below 20 are entities; the brand of sizes below 10 has an alias slot, that of size 5 has two."""
    n = T.read(spark, d, "part").select(F.col("p_size").alias("n")).distinct()
    key = F.concat(F.lit("size "), "n")
    entities = n.where("n < 20").select(key.alias("alias_key"), F.concat(F.lit("ent_"), "n").alias("entity_id"), F.lit("active").alias("status"), F.lit(None).cast("long").alias("superseded_at_ms"))
    none = F.lit(None).cast("long")
    row = lambda df, slot: df.select(key.alias("alias_subject_key"), F.lit("brand").alias("alias_predicate_key"), F.lit(None).cast("string").alias("alias_subject_entity_id"), slot.alias("canonical_slot_id"), F.lit("active").alias("status"), none.alias("superseded_at_ms"), none.alias("valid_from_ms"), none.alias("valid_to_ms"))
    slots = row(n.where("n < 10"), F.concat(F.lit("alias_"), "n")).union(row(n.where("n = 5"), F.lit("alias_other")))
    return K.entity_registry(entities), K.slot_registry(slots)


@query(
    """SELECT 'cl_' || p_partkey AS id, CASE WHEN p_size < 20 THEN 'ent_' || p_size END AS entity,
CASE WHEN p_size < 10 AND p_size <> 5 THEN 'alias' WHEN p_size < 20 THEN 'own' ELSE 'preset' END AS slot, p_size >= 20 AS has_facet FROM part"""
)
def claim_canonicalisation(spark: SparkSession, d: str) -> DataFrame:
    out = K.canonicalize_claims(_part_claims(spark, d), *_registries(spark, d))
    n = F.lower(F.replace("subject", F.lit("Size "), F.lit("")))
    kind = F.when(F.col("slot_id").startswith("alias_"), "alias").when(F.col("slot_id") == F.concat(F.lit("slot_"), n), "preset").otherwise("own")
    return out.select("id", F.col("subject_entity_id").alias("entity"), kind.alias("slot"), F.col("slot_facet").isNotNull().alias("has_facet"))


@query("SELECT 'rule_' || n AS id, CASE WHEN n = 5 THEN 'ambiguous' ELSE 'bound' END AS trigger, CASE WHEN n = 4 THEN 'ambiguous' ELSE 'bound' END AS target, CASE WHEN n = 5 THEN NULL WHEN n < 10 THEN 'alias_' || n ELSE 'slot_' || n END AS slot FROM (SELECT DISTINCT p_size AS n FROM part)")
def rule_canonicalisation(spark: SparkSession, d: str) -> DataFrame:
    out = K.canonicalize_rules(_rules(spark, d), *_registries(spark, d))
    return out.select("id", F.col("trigger_binding_status").alias("trigger"), F.col("target_binding_status").alias("target"), F.col("trigger_slot_id").alias("slot"))


@query("SELECT 'cl_' || p_partkey AS id, CASE WHEN p_size % 3 <> 0 THEN 'slot_' || p_size END AS slot_id, p_size % 3 = 1 AS alias FROM part")
def slot_admission(spark: SparkSession, d: str) -> DataFrame:
    """Proposed slots of another subject are refused; one of another predicate makes an alias."""
    n = T.read(spark, d, "part").select(F.col("p_size").alias("n")).distinct()
    subject = F.when(F.col("n") % 3 == 0, "someone else").otherwise(F.concat(F.lit("size "), "n"))
    slots = n.select(F.concat(F.lit("slot_"), "n").alias("slot_key"), F.lit(None).cast("string").alias("subject_entity_id"), subject.alias("subject_key"), F.when(F.col("n") % 3 == 1, "label").otherwise("brand").alias("predicate_key"))
    claims, aliases = K.admit_slots(_part_claims(spark, d), slots)
    made = aliases.select(F.explode("source_claims").alias("id"), F.lit(True).alias("a"))
    return claims.join(made, "id", "left").select("id", "slot_id", F.coalesce("a", F.lit(False)).alias("alias"))


@query("SELECT 'cl_' || p_partkey AS replaced_id, 'New ' || p_size AS object_value, p_partkey + 5 AS valid_from_ms FROM part WHERE p_size % 4 = 0")
def replacement_claims(spark: SparkSession, d: str) -> DataFrame:
    c = _part_claims(spark, d)
    n = F.regexp_replace("slot_id", "slot_", "")
    cor = c.select(F.concat(F.lit("co_"), "id").alias("id"), F.when(n.cast("int") % 4 == 0, "replace").otherwise("retract").alias("operation"), F.concat(F.lit("New "), n).alias("new_value"), (F.col("valid_from_ms") + 5).alias("effective_at_ms"), "source_sequence_no", "source_span_ids", "source_episode_ids")
    return K.replacement_claims(cor, c.withColumn("correction_id", F.concat(F.lit("co_"), "id"))).select("replaced_id", "object_value", "valid_from_ms")


@query(
    """SELECT 'co_' || n AS id, CASE WHEN n % 3 = 0 THEN NULL WHEN n % 3 = 1 THEN 'slot_' || n END AS target_slot_id,
CASE WHEN n % 3 = 0 THEN 'no_target' WHEN n % 3 = 2 THEN 'ambiguous_target' END AS problem FROM (SELECT DISTINCT p_size AS n FROM part WHERE p_size BETWEEN 2 AND 40)"""
)
def correction_targets(spark: SparkSession, d: str) -> DataFrame:
    c = _part_claims(spark, d)
    first = c.groupBy("slot_id").agg(F.min("id").alias("one"), F.regexp_replace(F.min("slot_id"), "slot_", "").cast("int").alias("n")).where("n between 2 and 40")
    other = c.where("slot_id = 'slot_1'").agg(F.min("id").alias("other"))
    ids = F.when(F.col("n") % 3 == 0, F.array(F.lit("nobody"))).when(F.col("n") % 3 == 1, F.array("one")).otherwise(F.array("one", "other"))
    cor = first.crossJoin(F.broadcast(other)).select(F.concat(F.lit("co_"), "n").alias("id"), F.lit("claim").alias("target_type"), F.lit("retract").alias("operation"), ids.alias("target_ids"), *[F.lit(None).cast("string").alias(x) for x in ("target_selector", "target_subject_key", "target_predicate_key", "target_slot_id")])
    slots = c.select(F.col("slot_id").alias("slot_key"), F.lit("none").alias("subject_key"), F.lit("none").alias("predicate_key")).limit(1)
    return K.resolve_targets(cor, c, slots)


@query(
    """SELECT 'ent_' || c_nationkey AS id, arg_min(c_name, c_custkey) AS canonical_name, CAST(count(DISTINCT c_name) - 1 AS INTEGER) AS n_aliases, CAST(count(*) AS INTEGER) AS n_sources FROM customer GROUP BY c_nationkey"""
)
def entity_merge(spark: SparkSession, d: str) -> DataFrame:
    """The customers of a nation as entries of one entity: the first is stored, the others come in."""
    c = T.read(spark, d, "customer")
    first = F.min("c_custkey").over(Window.partitionBy("c_nationkey"))
    rows = c.withColumn("_f", first).select(F.concat(F.lit("ent_"), "c_nationkey").alias("id"), F.col("c_name").alias("canonical_name"), F.expr(NONE).alias("aliases"), F.array(F.concat(F.lit("cl_"), "c_custkey")).alias("source_claims"), F.lit("org").alias("entity_type"), (F.col("_f") == F.col("c_custkey")).alias("_stored"))
    out = K.merge_entities(rows.where("_stored"), rows.where("not _stored"))
    return out.select("id", "canonical_name", F.size("aliases").alias("n_aliases"), F.size("source_claims").alias("n_sources"))


# rules -------------------------------------------------------------------------------------------------------------------


@query(
    """WITH n AS (SELECT DISTINCT p_size AS n FROM part WHERE p_size % 6 <> 5)
SELECT 'rule_' || n AS id, CASE WHEN n % 4 = 0 THEN 'ambiguous' ELSE 'bound' END AS trigger, CASE WHEN n % 4 <> 0 THEN 'slot_' || n END AS slot FROM n"""
)
def rule_binding(spark: SparkSession, d: str) -> DataFrame:
    """Ends bound to the slots of the claims that have their surface; the surface of some sizes has two."""
    c = _part_claims(spark, d)
    n = F.regexp_replace("slot_id", "slot_", "").cast("int")
    two = c.where(n % 4 == 0).withColumn("slot_id", F.concat("slot_id", F.lit("_other")))
    rules = _rules(spark, d).where("source_sequence_no % 6 <> 5").withColumn("trigger_binding_status", F.lit("pending")).withColumn("trigger_slot_id", F.lit(None).cast("string"))
    return U.bind(rules, c.union(two)).select("id", F.col("trigger_binding_status").alias("trigger"), F.col("trigger_slot_id").alias("slot"))


@query(
    """WITH n AS (SELECT DISTINCT p_size AS n FROM part), c AS (SELECT * FROM part WHERE p_size % 5 <> 2),
l AS (SELECT p_size, max(p_partkey) AS k, arg_max(p_partkey % 11 <> 0 AND p_partkey % 13 <> 0, p_partkey) AS own FROM c GROUP BY 1)
SELECT 'slot_' || (n.n + 1) AS slot_id, 'rule_' || n.n AS rules, CAST(n.n * 10 AS BIGINT) AS valid_from_ms
FROM n LEFT JOIN l ON l.p_size = n.n + 1 WHERE n.n % 5 = 2 AND NOT (coalesce(l.own, false) AND l.k > n.n * 10)"""
)
def missing_triggers(spark: SparkSession, d: str) -> DataFrame:
    """Rules whose trigger no claim speaks of leave their target unsupported, unless it was asserted by itself later."""
    c = _part_claims(spark, d).where("cast(regexp_replace(slot_id, 'slot_', '') as int) % 5 <> 2")
    none = spark.createDataFrame([], "target_slot_id string, status string")
    return U.missing_triggers(_rules(spark, d), c, none).select("slot_id", F.array_join("rule_ids", ",").alias("rules"), "valid_from_ms")


@query(
    """SELECT 'rule_' || n AS rule_id, 'slot_' || (n + 1) AS target_slot_id, CASE WHEN n % 3 = 0 THEN 'applied_derived' WHEN n % 3 = 1 THEN 'applied_unsupported' ELSE 'no_prior_value' END AS status
FROM (SELECT DISTINCT p_size AS n FROM part)"""
)
def outcome_merge(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of the read, and persisted ones where the read applied nothing."""
    r = _rules(spark, d).withColumn("n", F.col("source_sequence_no"))
    base = r.select(F.col("id").alias("rule_id"), "trigger_slot_id", "target_slot_id", "n")
    read = base.select("rule_id", "trigger_slot_id", "target_slot_id", F.when(F.col("n") % 3 == 0, "applied_derived").otherwise("no_prior_value").alias("status"))
    kind = F.when(F.col("n") % 3 == 1, "unsupported").when(F.col("n") % 3 == 0, "unsupported").otherwise("current")
    states = base.select(kind.alias("state_kind"), F.array("rule_id").alias("rule_ids"), F.col("target_slot_id").alias("slot_id"), F.array(F.concat(F.lit("c_"), "n")).alias("claim_ids"))
    return U.merge_outcomes(read, U.persisted_outcomes(states, r)).select("rule_id", "target_slot_id", "status")
