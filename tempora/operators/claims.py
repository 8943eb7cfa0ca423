"""Claims: corrections, newest-wins resolution, facets, sets, histories, intervals and support."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import SCOPE, SUPPORT_PRIORITY, canonical_part, support_priority
from .predicates import correction_active, effective_start, valid_at

SET_KINDS = ("relationship", "event", "preference")
EXCLUDES = ("retract", "replace", "tombstone", "forget", "mark_stale")
IGNORED = ("assert", "merge", "split")
#: Fixed: rows that a task sorts where a window meets a whole table; 216 million rows are 173 tasks.
ROWS_A_TASK = 1_250_000


def _scope(df: DataFrame) -> list[str]:
    return [c for c in SCOPE if c in df.columns]


def facet_key() -> Column:
    return F.coalesce("slot_facet", "slot_id", F.concat_ws("|", canonical_part("subject"), canonical_part("predicate")))


def projection_key() -> Column:
    """Set-valued kinds keep one row per value, others one per facet; claims without a slot are their own text."""
    named = (F.coalesce("subject", F.lit("")) != "") | (F.coalesce("predicate", F.lit("")) != "")
    value = canonical_part(F.coalesce("object_value", F.lit("")))
    return F.when(F.col("claim_kind").isin(*SET_KINDS), F.concat_ws("|", "claim_kind", facet_key(), value)).when(named, facet_key()).otherwise(F.col("claim_text"))


def newest_order() -> list[Column]:
    """Start, then sequence, then observation, then not ended, then id. It equals the pairwise rule wherever sequence
    numbers are all given or all missing; resolve_fold() follows the pairwise rule in mixtures."""
    return [effective_start().desc_nulls_last(), F.col("source_sequence_no").desc_nulls_last(), F.col("observed_at_ms").desc_nulls_last(), F.col("valid_to_ms").isNull().desc(), F.col("id").desc()]


def newest(df: DataFrame, keys: list[Column | str], order: list[Column] | None = None) -> DataFrame:
    """The newest row of each key. row_number with a filter of 1 becomes a group limit before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*(order or newest_order()))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def resolve_current(claims: DataFrame) -> DataFrame:
    return newest(claims.withColumn("projection_key", projection_key()), ["projection_key", *_scope(claims)])


def resolve_fold(claims: DataFrame) -> DataFrame:
    """The pairwise newest-wins rule folded in id order, for keys that mix given and missing sequence numbers."""
    import pandas as pd

    schema = claims.schema

    def newer(a, b) -> bool:
        sa, sb = (x["valid_from_ms"] if pd.notna(x["valid_from_ms"]) else x["observed_at_ms"] for x in (a, b))
        if sa != sb:
            return sa > sb
        if pd.notna(a["source_sequence_no"]) and pd.notna(b["source_sequence_no"]) and a["source_sequence_no"] != b["source_sequence_no"]:
            return a["source_sequence_no"] > b["source_sequence_no"]
        if a["observed_at_ms"] != b["observed_at_ms"]:
            return a["observed_at_ms"] > b["observed_at_ms"]
        if pd.isna(a["valid_to_ms"]) != pd.isna(b["valid_to_ms"]):
            return bool(pd.isna(a["valid_to_ms"]))
        return a["id"] > b["id"]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("id").reset_index(drop=True)
        best = 0
        for i in range(1, len(rows)):
            if newer(rows.iloc[i], rows.iloc[best]):
                best = i
        return rows.iloc[[best]].drop(columns="projection_key")

    return claims.withColumn("projection_key", projection_key()).groupBy("projection_key", *_scope(claims)).applyInPandas(fold, schema)


def selector_join(rows: DataFrame, selectors: DataFrame, selector: str, *texts: str) -> DataFrame:
    """Pairs of a row and a selector that one of its texts holds: the join on selector_match. The selectors are a query
    set and are broadcast; the two sides share no column name.

    A text that holds a selector has every word between two spaces of it as a word of its own. So a selector waits at one
    such word, its longest, and a row, lower-cased once, meets only the selectors that wait at a word it has. Selectors
    without such a word wait at the empty one, which every row has."""
    s = selectors.withColumn("_s", F.lower(F.trim(selector))).where("_s <> ''")
    inner = F.expr("filter(slice(split(_s, ' '), 2, greatest(size(split(_s, ' ')) - 2, 0)), w -> w <> '')")
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    s = s.withColumn("_w", F.coalesce(longest, F.lit("")))
    low = [f"_t{i}" for i in range(len(texts))]
    r = rows.withColumns({t: F.lower(F.coalesce(text, F.lit(""))) for t, text in zip(low, texts)})
    words = r.withColumn("_w", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), *[F.split(t, " ") for t in low]))))
    holds = reduce(lambda a, b: a | b, [F.col(t).contains(F.col("_s")) for t in low])
    return words.join(F.broadcast(s), "_w").where(holds).select(*rows.columns, *selectors.columns)


def apply_corrections(claims: DataFrame, corrections: DataFrame, at: int | None = None) -> DataFrame:
    """Claims with the last effect of the corrections that target them: active, or the status that the effect gives.

    Targets are named ids, a canonical slot, or a selector; each is its own equi or theta join, so that the first two
    never become a product. Effects are ordered by (effective time, sequence, id); restore clears.
    """
    cor = corrections.where(correction_active(at) & (F.col("target_type") == "claim") & ~F.col("operation").isin(*IGNORED))
    cor = cor.select("id", "operation", "effective_at_ms", F.col("source_sequence_no").alias("cseq"), "target_match", "target_ids", "target_subject_key", "target_predicate_key", "target_selector").alias("c")
    key = claims.select("id", canonical_part("subject").alias("sk"), canonical_part("predicate").alias("pk"), "claim_text", "object_value", effective_start().alias("start")).alias("k")
    cols = [F.col("k.id").alias("claim_id"), F.col("c.id").alias("correction_id"), "operation", "effective_at_ms", "cseq"]
    by_id = cor.withColumn("target", F.explode("target_ids")).alias("c").join(key, F.col("c.target") == F.col("k.id")).select(*cols)
    slot = cor.where(F.col("target_match") == "canonical_slot").alias("c").join(key, (F.col("c.target_subject_key") == F.col("k.sk")) & (F.col("c.target_predicate_key") == F.col("k.pk")) & (F.col("k.start") <= F.col("c.effective_at_ms"))).select(*cols)
    selectors = cor.select(F.col("id").alias("correction_id"), "operation", "effective_at_ms", "cseq", "target_selector")
    select = selector_join(key.select(F.col("id").alias("claim_id"), "sk", "pk", "claim_text", "object_value"), selectors, "target_selector", "claim_text", "sk", "pk", "object_value").select("claim_id", "correction_id", "operation", "effective_at_ms", "cseq")
    effect = by_id.union(slot).union(select).groupBy("claim_id").agg(F.max_by("operation", F.struct("effective_at_ms", F.coalesce("cseq", F.lit(-1)), "correction_id")).alias("operation"), F.array_sort(F.collect_set("correction_id")).alias("correction_ids"))
    status = F.element_at(F.create_map(*[F.lit(x) for x in ("retract", "retracted", "replace", "superseded", "tombstone", "tombstoned", "forget", "redacted", "mark_stale", "expired", "restore", "active")]), F.col("operation"))
    out = claims.join(effect, claims["id"] == effect["claim_id"], "left")
    return out.withColumn("status", F.coalesce(status, F.col("status"))).drop("claim_id", "operation")


def current_claims(claims: DataFrame, corrections: DataFrame | None = None, at: int | None = None) -> DataFrame:
    live = claims.where((F.col("status") == "active") & valid_at(at, effective_start()))
    if corrections is not None:
        live = apply_corrections(live, corrections, at).where("status = 'active'").drop("correction_ids")
    return resolve_current(live)


def set_members(claims: DataFrame, keys: list[str]) -> DataFrame:
    """One row per slot: the distinct values in the order and spelling first seen, and the interval of the set."""
    seen = claims.withColumn("_v", canonical_part("object_value"))
    first = seen.groupBy(*keys, "_v").agg(F.min(F.struct(effective_start().alias("t"), F.coalesce("source_sequence_no", F.lit(-1)).alias("s"), "id", "object_value")).alias("m"), F.max("observed_at_ms").alias("o"), F.max(effective_start()).alias("f"), F.min("valid_to_ms").alias("e"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["object_value"]).alias("members"), F.max("o").alias("observed_at_ms"), F.max("f").alias("valid_from_ms"), F.min("e").alias("valid_to_ms"))


def close_before_next(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """valid_to becomes the smaller of itself and the next later start of the key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("valid_to_ms", F.least("valid_to_ms", F.lead("valid_from_ms").over(w)))


def history(df: DataFrame, keys: list[str], order: list[Column], value: Column) -> DataFrame:
    """Versions in order without those that repeat the version before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_p", F.lag(value).over(w)).withColumn("_n", F.row_number().over(w)).where((F.col("_n") == 1) | ~value.eqNullSafe(F.col("_p"))).drop("_p", "_n")


def history_trace(claims: DataFrame, keys: list[str]) -> DataFrame:
    """Slots of two versions or more."""
    out = claims.groupBy(*keys).agg(F.count(F.lit(1)).alias("version_count"), F.count_distinct(canonical_part("object_value")).alias("distinct_values"), F.min("observed_at_ms").alias("first_observed_ms"), F.max("observed_at_ms").alias("last_observed_ms"))
    return out.where("version_count >= 2")


def prior_value(claims: DataFrame, keys: list[str]) -> DataFrame:
    """Every claim with the value of the latest strictly earlier (start, sequence) claim of its slot: an as-of join of a
    table with itself. Claims of equal start and sequence have the same prior."""
    place = F.struct(effective_start().alias("t"), F.coalesce("source_sequence_no", F.lit(-(2**63))).alias("s"))
    ranked = claims.withColumn("_p", F.dense_rank().over(Window.partitionBy(*keys).orderBy(place)))
    w = Window.partitionBy(*keys).orderBy("_p").rangeBetween(Window.unboundedPreceding, -1)
    last = F.max(F.struct("_p", "id", "object_value")).over(w)
    return ranked.withColumn("_l", last).withColumn("prior_value", F.col("_l.object_value")).withColumn("prior_id", F.col("_l.id")).drop("_p", "_l")


def same_instant(claims: DataFrame, keys: list[str]) -> DataFrame:
    """Versions that an equal start with a later sequence and another value replaces at once: empty intervals.

    The claims are counted first: what one task sorts is a number of rows that does not grow with the table. Adaptive
    execution would join partitions by their compressed size, or leave as many as there are cores."""
    n = -(-claims.count() // ROWS_A_TASK)
    dealt = claims.repartition(max(n, claims.sparkSession.sparkContext.defaultParallelism), *keys) if n > 1 else claims
    w = Window.partitionBy(*keys, effective_start()).orderBy(F.col("source_sequence_no").desc(), F.col("_v").desc())
    out = dealt.withColumn("_v", canonical_part("object_value")).withColumn("_w", F.first("_v").over(w)).withColumn("_s", F.first("source_sequence_no").over(w))
    out = out.where((F.col("source_sequence_no") < F.col("_s")) & (F.col("_v") != F.col("_w"))).drop("_v", "_w", "_s")
    return out.withColumn("valid_from_ms", effective_start()).withColumn("valid_to_ms", F.col("valid_from_ms"))


def support(states: DataFrame, keys: list[str]) -> DataFrame:
    """The support of each slot, the strongest of its states first."""
    kind = F.when(F.col("state_kind") == "tombstone", "deleted").when(F.col("state_kind") == "unsupported", "unsupported").otherwise("supported")
    return states.withColumn("_s", kind).groupBy(*keys).agg(F.min_by("_s", support_priority(F.col("_s"))).alias("support"), F.count(F.lit(1)).alias("n_states"))


def aggregate_support(slots: DataFrame) -> DataFrame:
    best = F.min(support_priority(F.col("support")))
    return slots.agg(reduce(lambda acc, kv: acc.when(best == kv[1], kv[0]), SUPPORT_PRIORITY.items(), F.when(best.isNull(), "no_evidence")).alias("support"), F.count(F.lit(1)).alias("n_slots"))


def interval_overlap(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of one key whose intervals meet, with the intersection."""
    a, b = left.alias("a"), right.alias("b")
    on = reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])
    start = F.greatest("a.valid_from_ms", "b.valid_from_ms")
    end = F.least("a.valid_to_ms", "b.valid_to_ms")
    return a.join(b, on).withColumn("from_ms", start).withColumn("to_ms", end).where(F.col("to_ms").isNull() | (F.col("from_ms") < F.col("to_ms")))
