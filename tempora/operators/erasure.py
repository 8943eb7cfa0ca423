"""Erasure: what depends on erased records, over every table, and the purge of forgotten values.

Tables are DataFrames already narrowed to the scope and the scopes inside it. Ids travel as one-column DataFrames and
every step is a semi join; the closure over derivations loops over hops, with its frontier checkpointed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import HIDDEN_TEXT
from .claims import SET_KINDS
from .predicates import settled

#: Lists of evidence ids, by table.
EVIDENCE = {
    "claims": ["source_span_ids", "source_episode_ids"],
    "rules": ["source_span_ids", "source_episode_ids"],
    "corrections": ["source_span_ids", "source_episode_ids"],
    "dependency_traces": ["source_spans", "source_episodes"],
    "state_records": ["source_spans", "source_episodes"],
    "profiles": ["source_spans"],
    "edges": ["source_spans"],
}


def _ids(df: DataFrame, column: str = "id") -> DataFrame:
    return df.select(F.col(column).alias("id")).where("id is not null").distinct()


def _union(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.union(b), parts).distinct()


def _citing(table: DataFrame, columns: list[str], ids: DataFrame) -> DataFrame:
    """Ids of rows whose columns (texts or lists) hold any of the ids."""
    none = F.array().cast("array<string>")
    lists = [F.coalesce(F.col(c), none) if table.schema[c].dataType.simpleString().startswith("array") else F.array(F.col(c)) for c in columns]
    refs = table.select("id", F.explode(F.concat(*lists)).alias("_ref"))
    return _ids(refs.join(ids.select(F.col("id").alias("_ref")), "_ref", "left_semi"))


def derived_closure(traces: DataFrame, claims: DataFrame, rules: DataFrame) -> DataFrame:
    """The claim ids, and those that rules derived from any of them or by any of the rules, hop after hop."""
    step = traces.where("derived_claim_id is not null").select(F.col("trigger_claim_id").alias("id"), F.col("derived_claim_id").alias("derived"))
    by_rule = traces.join(rules.select(F.col("id").alias("rule_id")), "rule_id", "left_semi").select(F.col("derived_claim_id").alias("id")).where("id is not null")
    seen = _union(claims.select("id"), by_rule)
    frontier = seen
    while True:
        found = step.join(frontier, "id", "left_semi").select(F.col("derived").alias("id")).distinct().join(seen, "id", "left_anti")
        if traces.sparkSession.sparkContext.getCheckpointDir():
            found = found.checkpoint()
        if found.isEmpty():
            return seen
        seen, frontier = seen.union(found), found


def dependents(tables: dict[str, DataFrame], erased: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(ids to delete by table, rows to write again by table) when `erased` (ids by table) goes.

    Claims, rules and corrections that cite erased evidence go; then claims derived from them; traces, states, profiles
    and edges that cite any of these; entities, aliases and slots lose the ids and go when none is left.
    """
    empty = tables["claims"].select("id").limit(0)
    out = {t: erased.get(t, empty) for t in tables}
    rewrites: dict[str, DataFrame] = {}
    evidence = _union(out["spans"], out["episodes"])

    def add(table: str, found: DataFrame) -> None:
        out[table] = _union(out[table], found)

    for t in ("claims", "rules", "corrections"):
        add(t, _citing(tables[t], EVIDENCE[t], evidence))
    traces = tables["dependency_traces"]
    out["rules"] = settled(out["rules"])
    out["claims"] = settled(derived_closure(traces, out["claims"], out["rules"]))
    add("dependency_traces", _citing(traces, ["trigger_claim_id", "prior_trigger_claim_id", "derived_claim_id"], out["claims"]))
    add("dependency_traces", _citing(traces, ["rule_id"], out["rules"]))
    add("dependency_traces", _citing(traces, EVIDENCE["dependency_traces"], evidence))
    for column, of in (("claim_ids", "claims"), ("correction_ids", "corrections"), ("rule_ids", "rules")):
        add("state_records", _citing(tables["state_records"], [column], out[of]))
    add("state_records", _citing(tables["state_records"], EVIDENCE["state_records"], evidence))
    add("profiles", _citing(tables["profiles"], ["evidence_claims"], out["claims"]))
    add("profiles", _citing(tables["profiles"], EVIDENCE["profiles"], evidence))

    def strip(table: str, lists: dict[str, str]) -> None:
        rows = tables[table].join(out[table], "id", "left_anti")
        hit = reduce(lambda a, b: a.union(b), [_citing(rows, [c], out[of]) for c, of in lists.items()]).distinct()
        rows = rows.join(hit, "id", "left_semi")
        left = rows
        for c, of in lists.items():
            left = _without(left, c, out[of])
        kept = left.where(reduce(lambda a, b: a | b, [F.size(c) > 0 for c in lists]))
        rewrites[table] = kept
        add(table, hit.join(kept.select("id"), "id", "left_anti"))

    strip("entities", {"source_claims": "claims"})
    out["entities"] = settled(out["entities"])
    strip("slot_aliases", {"source_claims": "claims"})
    add("entity_aliases", _citing(tables["entity_aliases"], ["entity_id"], out["entities"]))
    strip("entity_aliases", {"source_claims": "claims"})
    add("edges", _citing(tables["edges"], ["claim_id"], out["claims"]))
    add("edges", _citing(tables["edges"], ["src_entity_id", "dst_entity_id"], out["entities"]))
    add("edges", _citing(tables["edges"], EVIDENCE["edges"], evidence))
    strip("slots", {"source_claim_ids": "claims", "source_rule_ids": "rules", "source_entity_ids": "entities"})
    return out, rewrites


def _without(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows with the ids taken out of a list, the order of the others kept."""
    none = F.array().cast("array<string>")
    base = rows.withColumn(column, F.coalesce(column, none))
    kept = base.select("id", F.posexplode(column).alias("_p", "_r")).join(ids.select(F.col("id").alias("_r")), "_r", "left_anti")
    kept = kept.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_r"))), lambda s: s["_r"]).alias("_k"))
    return base.join(kept, "id", "left").withColumn(column, F.coalesce("_k", none)).drop("_k").select(*rows.columns)


def episodes(tables: dict[str, DataFrame], ids: DataFrame) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """D2 from episodes: their spans and jobs go with them, and all that depends on these."""
    known = _ids(tables["episodes"].join(ids.select("id"), "id", "left_semi"))
    spans = tables["spans"].where("source_type = 'episode'").join(known.select(F.col("id").alias("source_id")), "source_id", "left_semi").select("id")
    jobs = tables["extraction_jobs"].join(known.select(F.col("id").alias("episode_id")), "episode_id", "left_semi").select("id")
    return dependents(tables, {"episodes": known, "spans": spans, "extraction_jobs": jobs})


def report(erased: dict[str, DataFrame]) -> dict[str, int]:
    """Rows per table."""
    return {t: df.count() for t, df in erased.items()}


def forget_targets(claims: DataFrame, corrections: DataFrame, before_ms: int) -> DataFrame:
    """The claims that active forget corrections in effect before a time name by id: claim rows and correction_id."""
    cor = corrections.where((F.col("status") == "active") & (F.col("operation") == "forget") & (F.col("target_type") == "claim") & (F.col("effective_at_ms") < before_ms))
    named = cor.select(F.col("id").alias("correction_id"), F.col("effective_at_ms").alias("forgotten_at_ms"), F.explode("target_ids").alias("_target"))
    return claims.join(named, claims["id"] == F.col("_target")).drop("_target")


def purge(tables: dict[str, DataFrame], before_ms: int) -> dict[str, DataFrame]:
    """D3: what a purge of forgotten claims writes.

    deleted: claim ids with all that depends on them by derivation; markers: one claim without a value for each
    single-valued slot that lost its value; spans and episodes: their texts with the values hidden, vectors cleared;
    corrections: those that named a value, without selector, new value, reason and metadata. A second purge finds no
    targets and writes nothing.
    """
    targets = settled(forget_targets(tables["claims"], tables["corrections"], before_ms))
    erased, rewrites = dependents(tables, {"claims": _ids(targets)})
    single = targets.where(~F.col("claim_kind").isin(*SET_KINDS) & F.col("slot_id").isNotNull())
    marker = single.groupBy("slot_id").agg(F.min_by(F.struct(*[F.col(c) for c in tables["claims"].columns]), "id").alias("c"), F.max("forgotten_at_ms").alias("at"), F.min("correction_id").alias("correction_id"))
    marker = marker.select(F.concat(F.lit("claim_forgotten_"), "correction_id", F.lit("_"), F.sha2("slot_id", 256).substr(1, 16)).alias("id"), "c.slot_id", "c.subject", "c.predicate", F.lit(None).cast("string").alias("object_value"), F.lit("tombstoned").alias("status"), F.col("at").alias("valid_from_ms"), F.col("at").alias("observed_at_ms"))
    values = targets.select(F.explode("source_span_ids").alias("id"), "object_value").where("length(trim(object_value)) >= 3")
    by_span = values.groupBy("id").agg(F.array_sort(F.collect_set("object_value")).alias("_values"))
    spans = redact(tables["spans"].join(by_span, "id"), "text")
    by_episode = targets.select(F.explode("source_episode_ids").alias("id"), "object_value").where("length(trim(object_value)) >= 3").groupBy("id").agg(F.array_sort(F.collect_set("object_value")).alias("_values"))
    eps = redact(tables["episodes"].join(by_episode, "id"), "raw_text")
    if "embedding" in spans.columns:
        spans = spans.withColumn("embedding", F.lit(None).cast(tables["spans"].schema["embedding"].dataType))
    done = targets.select("correction_id").distinct()
    cor = tables["corrections"].join(done, tables["corrections"]["id"] == F.col("correction_id"), "left_semi")
    for c in ("target_selector", "new_value", "reason", "metadata_json"):
        if c in cor.columns:
            cor = cor.withColumn(c, F.lit(None).cast("string"))
    return {"deleted": erased["claims"], "erased": erased, "rewrites": rewrites, "markers": marker, "spans": spans, "episodes": eps, "corrections": cor}


def redact(rows: DataFrame, text: str) -> DataFrame:
    """Rows with the values of their own list `_values` hidden, whole words, the longest value first."""
    longest = F.array_sort(F.transform("_values", lambda v: F.lower(F.trim(v))), lambda a, b: F.length(b) - F.length(a))
    word = r"[\p{IsAlphabetic}\p{N}]"
    quoted = F.transform(longest, lambda v: F.regexp_replace(v, r"([\\.\[\]{}()*+?^$|])", r"\\$1"))
    pattern = F.concat(F.lit(rf"(?<!{word})(?iu:"), F.array_join(quoted, "|"), F.lit(rf")(?!{word})"))
    return rows.withColumn(text, F.regexp_replace(F.col(text), pattern, F.lit(HIDDEN_TEXT))).drop("_values")


