"""Context packing: items rendered as text, ordered by what they tell about the answer, and packed into a token budget.

Renderers are Columns, so any number of records is rendered where it lies. A packet belongs to one request and holds no
more than its budget; packing goes through the items of each request in order, in one group a request.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import canonical_part, clip_to_budget, estimate_tokens, estimate_tokens_py, utc_minute

#: Fixed: the order of item kinds in a packet.
PRIORITY = {
    "state_resolved": 0,
    "state_tombstone": 1,
    "state_unsupported": 2,
    "state_derived": 3,
    "state_current": 4,
    "state_set": 5,
    "state_history": 6,
    "state_entity_card": 7,
    "state_rule": 8,
}
OTHER_PRIORITY = 9
#: Fixed: the heading of each kind of claim, and of each kind of correction.
TITLES = {"state_tombstone": "TombstoneState", "state_unsupported": "UnsupportedState", "state_derived": "DerivedState", "state_set": "SetState", "state_rule": "StateRule", "state_current": "CurrentState"}
CORRECTION_TITLES = {"state_tombstone": "TombstoneState", "state_unsupported": "UnsupportedState", "state_restore": "RestoredState", "state_change": "StateChange"}
#: Fixed: what a correction says; it never shows its selector or new value.
CORRECTION_TEXT = {
    "retract": "Memory of the target slot is retracted and must not be treated as current. Other slots are not affected.",
    "tombstone": "Memory of the target slot is deleted and must not be treated as current. Other slots are not affected.",
    "forget": "Memory of the target slot is deleted and must not be treated as current. Other slots are not affected.",
    "replace": "Memory of the target slot is stale or unsupported unless a later active value is present.",
    "mark_stale": "Memory of the target slot is stale or unsupported unless a later active value is present.",
    "restore": "Memory of the target slot is restored.",
    "assert": "Memory of the target slot changed.",
    "merge": "Memory of the target slot changed.",
    "split": "Memory of the target slot changed.",
}


def _map(values: dict[str, str | int], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def _ids(name: str) -> Column:
    return F.array_join(F.coalesce(F.col(name), F.array().cast("array<string>")), ", ")


def slot_label(subject: str | Column = "subject", predicate: str | Column = "predicate") -> Column:
    s, p = (F.col(x) if isinstance(x, str) else x for x in (subject, predicate))
    return _text(s, " / ", p)


def claim_kind() -> Column:
    """The kind of item that a claim is."""
    return (
        F.when(F.col("status").isin("retracted", "tombstoned", "redacted"), "state_tombstone")
        .when((F.col("status") != "active") | (F.col("polarity") == "uncertain"), "state_unsupported")
        .when(F.col("asserted_by") == "extractor_derived", "state_derived")
        .when(F.col("claim_kind").isin("relationship", "event"), "state_set")
        .when(F.col("claim_kind") == "constraint", "state_rule")
        .otherwise("state_current")
    )


def correction_kind() -> Column:
    op = F.col("operation")
    return F.when(op.isin("retract", "tombstone", "forget"), "state_tombstone").when(op.isin("replace", "mark_stale"), "state_unsupported").when(op == "restore", "state_restore").otherwise("state_change")


def render_span(provenance: bool = False) -> Column:
    """Span id, source_type, source_id, source_actor, span_index, score, validity, text."""
    if not provenance:
        return _text("### Memory ", F.col("id"), "\n", F.col("text"), "\n")
    actor = F.when(F.col("source_actor").isNotNull(), _text("source_actor: ", F.col("source_actor"), "\n"))
    head = _text("### Memory ", F.col("id"), "\nsource_type: ", F.initcap("source_type"), "\nsource_id: ", F.col("source_id"), "\n", actor, "span_index: ", F.col("span_index"))
    return _text(head, "\nscore: ", F.format_string("%.4f", F.col("score").cast("double")), "\nvalid_from: ", utc_minute("valid_from_ms"), "\nvalid_to: ", utc_minute("valid_to_ms"), "\n\n", F.col("text"), "\n")


def render_claim(provenance: bool = False) -> Column:
    kind = claim_kind()
    head = _text("### ", _map(TITLES, kind), " ", F.col("id"), "\nslot: ", slot_label(), "\n")
    gone = F.when(F.col("status").isin("retracted", "tombstoned", "redacted"), "deleted").otherwise("unsupported")
    times = _text("valid_from_ms: ", F.col("valid_from_ms"), "\nvalid_to_ms: ", F.col("valid_to_ms"), "\n")
    refs = _text("source_span_ids: ", _ids("source_span_ids"), "\nsource_episode_ids: ", _ids("source_episode_ids"), "\n")
    more = _text(times, refs) if provenance else F.lit("")
    not_current = _text(head, "support_state: ", gone, "\ncurrent_value: null\nhistorical_evidence_is_current: false\n", more)
    return F.when(kind.isin("state_unsupported") | (F.col("status") != "active"), not_current).otherwise(_text(head, "value: ", F.col("object_value"), "\n", more))


def render_set(provenance: bool = False) -> Column:
    """A set state: id, subject, predicate, members, validity and sources."""
    head = _text("### SetState ", F.col("id"), "\nslot: ", slot_label(), "\nmembers: ", _ids("members"), "\n")
    if not provenance:
        return head
    return _text(head, "valid_from_ms: ", F.col("valid_from_ms"), "\nvalid_to_ms: ", F.col("valid_to_ms"), "\nclaim_ids: ", _ids("claim_ids"), "\nsource_span_ids: ", _ids("source_spans"), "\nsource_episode_ids: ", _ids("source_episodes"), "\n")


def set_claims(claims: DataFrame, provenance: bool = False) -> DataFrame:
    """Active relationship and event claims of one subject, predicate and kind as one item: id, rendered, claim_ids."""
    direct = claims.where("status = 'active' and polarity = 'affirmative' and asserted_by <> 'extractor_derived' and claim_kind in ('relationship', 'event')")
    keys = [canonical_part(F.coalesce("subject", F.lit(""))).alias("s"), canonical_part(F.coalesce("predicate", F.lit(""))).alias("p"), "claim_kind"]
    none = F.array().cast("array<string>")
    row = F.struct("order", F.col("id").alias("claim"), "subject", "predicate", "object_value", F.coalesce("source_span_ids", none).alias("spans"), F.coalesce("source_episode_ids", none).alias("episodes"))
    g = direct.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("c"))
    joined = lambda f: F.array_join(F.filter(F.transform("c", f), lambda x: x.isNotNull()), ", ")
    flat = lambda f: F.array_join(F.flatten(F.transform("c", f)), ", ")
    sid = _text("set_state:", F.initcap("claim_kind"), ":", F.col("s"), ":", F.col("p"))
    out = _text("### SetState ", sid, "\nslot: ", slot_label(F.col("c")[0]["subject"], F.col("c")[0]["predicate"]), "\nmembers: ", joined(lambda x: x["object_value"]), "\n")
    if provenance:
        out = _text(out, "claim_ids: ", joined(lambda x: x["claim"]), "\nsource_span_ids: ", flat(lambda x: x["spans"]), "\nsource_episode_ids: ", flat(lambda x: x["episodes"]), "\n")
    return g.select(sid.alias("id"), out.alias("rendered"), F.transform("c", lambda x: x["claim"]).alias("claim_ids"), F.col("c")[0]["order"].alias("order"))


def render_rule(provenance: bool = False) -> Column:
    """A rule with its outcome's resolution_status and resolved_claim_id; null unless it was applied."""
    head = _text(
        "### DependencyProof ", F.col("id"), "\ntrigger_slot: ", slot_label("trigger_subject", "trigger_predicate"), "\ntarget_slot: ", slot_label("target_subject", "target_predicate"), "\nactivation: ", F.col("activation"),
        "\naction: ", F.col("action"), "\nresolution_status: ", F.col("resolution_status"), "\nresolved_claim_id: ", F.col("resolved_claim_id"), "\nauthoritative_current_value: false\n",
    )
    out = _text(head, "source_span_ids: ", _ids("source_span_ids"), "\n") if provenance else head
    return F.when(F.col("resolution_status").isin("applied_derived", "applied_unsupported"), out)


def render_correction(provenance: bool = False) -> Column:
    title = _map(CORRECTION_TITLES, correction_kind())
    s, p = F.col("target_subject_key"), F.col("target_predicate_key")
    target = F.when(s.isNull() & p.isNull(), "unknown").otherwise(_text(F.coalesce(s, F.lit("unknown")), " / ", F.coalesce(p, F.lit("unknown"))))
    said = _map(CORRECTION_TEXT, F.col("operation"))
    if not provenance:
        return _text("### ", title, " ", F.col("id"), "\ntarget_slot: ", target, "\n", said, "\n")
    some = lambda c: F.when(F.col(c).isNull(), "None").otherwise(_text("Some(", F.col(c), ")"))
    name = F.regexp_replace(F.initcap(F.replace(F.col("operation"), F.lit("_"), F.lit(" "))), " ", "")
    ids = _text("[", F.array_join(F.transform(F.coalesce("target_ids", F.array().cast("array<string>")), lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", "), "]")
    return _text(
        "### ", title, " ", F.col("id"), "\noperation: ", name, "\ntarget_slot: ", target, "\ntarget_type: ", F.col("target_type"), "\ntarget_match: ", F.col("target_match"), "\ntarget_ids: ", ids, "\neffective_at_ms: ", F.col("effective_at_ms"),
        "\napplies_valid_from_ms: ", some("applies_from_ms"), "\napplies_valid_to_ms: ", some("applies_to_ms"), "\n\n", said, "\n",
    )


def render_profile() -> Column:
    return _text("### Profile ", F.col("id"), "\n", F.col("profile_key"), ": ", F.col("profile_text"), "\n")


def render_artifact() -> Column:
    return _text("### Artifact ", F.col("id"), "\n", F.col("title"), "\n")


def _json(c: Column) -> Column:
    """A JSON text, or null."""
    inner = F.to_json(F.array(c))
    return F.when(c.isNull(), "null").otherwise(F.substring(inner, F.lit(2), F.length(inner) - 2))


def render_history(versions: DataFrame, provenance: bool = False) -> DataFrame:
    """slot_id, rendered: the versions of each slot in order (column `n`), as one item."""
    line = _text("- state_kind: ", F.col("state_kind"), "; value: ", _json(F.col("object_value")), "; members: ", F.to_json(F.coalesce("members", F.array().cast("array<string>"))), "; observed_at_ms: ", F.col("observed_at_ms"), "; valid_from_ms: ", F.col("valid_from_ms"), "; valid_to_ms: ", F.col("valid_to_ms"))
    if provenance:
        line = _text(line, "; claim_ids: ", _ids("claim_ids"), "; correction_ids: ", _ids("correction_ids"), "; rule_ids: ", _ids("rule_ids"), "; source_span_ids: ", _ids("source_spans"), "; source_episode_ids: ", _ids("source_episodes"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", _text(line, "\n").alias("t")))), lambda x: x["t"]), "")
    g = versions.groupBy("slot_id").agg(lines.alias("_lines"), F.min_by("subject", "n").alias("subject"), F.min_by("predicate", "n").alias("predicate"))
    return g.select("slot_id", _text("### SlotHistory ", F.col("slot_id"), "\nslot: ", slot_label(), "\nauthoritative_current_value: false\nversions_oldest_to_newest:\n", F.col("_lines")).alias("rendered"))


def render_resolved(provenance: bool = False) -> Column:
    """A row of answers.resolved_slots(), with n_facets and, if there are more than one, the text `facet_lines`; and the
    lists dependency_rule_ids and dependency_trigger_slot_ids."""
    ok = F.col("support_state") == "supported"
    sure = ok & (F.col("view") == "current") & ((F.col("n_facets") <= 1) | F.col("current_value").isNotNull())
    out = _text(
        "### ResolvedAnswerState ", F.col("slot_id"), "\nslot: ", slot_label(), "\nread_view: ", F.col("view"), "\nsupport_state: ", F.col("support_state"), "\nanswer_disposition: ", F.when(ok, "answer").otherwise("refuse"),
        "\nstate_kind: ", F.coalesce("state_kind", F.lit("none")), "\nauthoritative_state: true\nauthoritative_current_value: ", sure, "\ncurrent_value: ", F.coalesce("current_value", F.lit("null")),
        "\nmembers: ", F.to_json("members"), "\nvalid_from_ms: ", utc_minute("valid_from_ms"), "\nvalid_to_ms: ", utc_minute("valid_to_ms"), "\n",
        F.when(F.col("n_facets") > 1, _text("co_current_facets: ", F.col("n_facets"), "\n", F.col("facet_lines"))), F.when(F.size("dependency_rule_ids") > 0, "dependency_resolution: applied\n"),
    )
    if not provenance:
        return out
    return _text(out, "source_claim_ids: ", _ids("source_claim_ids"), "\nsource_span_ids: ", _ids("source_span_ids"), "\ndependency_rule_ids: ", _ids("dependency_rule_ids"), "\ndependency_trigger_slot_ids: ", _ids("dependency_trigger_slot_ids"), "\n")


def facet_lines(facets: DataFrame) -> DataFrame:
    """slot_id, facet_lines: a line for each facet, the latest first."""
    line = _text("- facet: ", slot_label(), " | support_state: ", F.col("support_state"), " | value: ", F.coalesce("value", F.lit("null")), " | valid_from_ms: ", utc_minute("valid_from_ms"), " | valid_to_ms: ", utc_minute("valid_to_ms"), "\n")
    key = F.struct((-F.coalesce("valid_from_ms", F.lit(-(2**62)))).alias("f"), "predicate", F.array_join("source_claim_ids", ",").alias("c"), line.alias("t"))
    return facets.groupBy("slot_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["t"]), "").alias("facet_lines"))


def answer_values(resolved: DataFrame) -> DataFrame:
    """request, rendered: all values of the supported targets in one item, if there are at least two and no timeline."""
    each = resolved.select("request", "slot_id", "subject", "predicate", "view", "support_state", F.posexplode(F.filter(F.concat(F.array("current_value"), "members"), lambda v: v.isNotNull())).alias("pos", "value"))
    line = _text("- ", slot_label(), ": ", F.col("value"), "\n")
    lines = F.transform(F.array_sort(F.collect_list(F.when(F.col("support_state") == "supported", F.struct("slot_id", "pos", line.alias("t"))))), lambda x: x["t"])
    timeline = resolved.groupBy("request").agg(F.max(F.col("view") == "timeline").alias("_t"))
    g = each.groupBy("request").agg(lines.alias("_lines")).join(timeline, "request").where("not _t and size(_lines) > 1")
    return g.select("request", _text("### AnswerValues\n", F.array_join("_lines", "")).alias("rendered"))


def entity_names(entities: DataFrame) -> DataFrame:
    """name_key, group_key, display: the names that exactly one entity with source claims has."""
    known = entities.where(F.size("source_claims") > 0)
    each = known.select("id", "canonical_name", F.explode(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name")).select(canonical_part("name").alias("name_key"), "id", "canonical_name")
    one = each.where("name_key <> ''").groupBy("name_key").agg(F.min("id").alias("group_key"), F.max("id").alias("_hi"), F.min("canonical_name").alias("display"))
    return one.where("group_key = _hi").drop("_hi")


def entity_cards(claims: DataFrame, names: DataFrame) -> DataFrame:
    """A card for each subject, its claims' slots in order: subject_key, id, display, slot_ids, n_claims, order."""
    c = claims.where("claim_kind <> 'constraint' and subject is not null").withColumn("name_key", canonical_part("subject")).where("name_key <> ''")
    j = c.join(names, "name_key", "left").withColumn("subject_key", F.coalesce("group_key", "name_key")).withColumn("_display", F.coalesce("display", "subject"))
    g = j.groupBy("subject_key").agg(F.min_by("_display", "order").alias("display"), F.array_sort(F.collect_set("slot_id")).alias("slot_ids"), F.count(F.lit(1)).alias("n_claims"), F.min("order").alias("order"))
    return g.withColumn("id", _text("entity_state:", canonical_part("display")))


# order, reserve, packing -----------------------------------------------------------------------------------------------


def order_items(items: DataFrame, targets: DataFrame) -> DataFrame:
    """State items (request, id, kind, order, slot_ids, rendered) with their place: by the kind's priority, then those
    of answer targets, then the order in which they were found."""
    t = targets.select("request", F.col("slot_id").alias("_slot")).distinct()
    hit = items.select("request", "id", F.explode(F.coalesce("slot_ids", F.array().cast("array<string>"))).alias("_slot")).join(t, ["request", "_slot"], "left_semi").select("request", "id").distinct().withColumn("_hit", F.lit(True))
    out = items.join(hit, ["request", "id"], "left")
    rank = F.coalesce(_map(PRIORITY, F.col("kind")), F.lit(OTHER_PRIORITY))
    w = Window.partitionBy("request").orderBy(rank, F.coalesce("_hit", F.lit(False)).desc(), "order", "id")
    return out.withColumn("place", F.row_number().over(w) - 1).withColumn("target", F.coalesce("_hit", F.lit(False))).drop("_hit")


def chronological(hits: DataFrame) -> list[Column]:
    """The order of evidence in time."""
    return [F.col("valid_from_ms").asc_nulls_first(), F.col("source_id"), F.col("span_index"), F.col("id")]


def proof_targets(resolved: DataFrame) -> DataFrame:
    """For each request: fail_closed (every target is a current read that must refuse: only targets are packed), the
    proof spans of the others, how many of them are required, and the spans that are withheld."""
    refuses = (F.col("view") == "current") & (F.col("support_state") != "supported")
    none = F.array().cast("array<string>")
    first = F.when(~refuses & (F.size("source_span_ids") > 0), F.struct("slot_id", F.col("source_span_ids")[0].alias("s")))
    rest = F.when(~refuses, F.struct("slot_id", F.col("source_span_ids").alias("s")))
    g = resolved.groupBy("request").agg(
        F.min(refuses).alias("fail_closed"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(first)), lambda x: x["s"])).alias("_first"),
        F.flatten(F.transform(F.array_sort(F.collect_list(rest)), lambda x: x["s"])).alias("_rest"),
        F.array_distinct(F.flatten(F.collect_list(F.when(refuses, F.col("source_span_ids")).otherwise(none)))).alias("withheld"),
    )
    return g.select("request", "fail_closed", F.array_distinct(F.concat("_first", "_rest")).alias("proof_span_ids"), F.size("_first").alias("required"), "withheld")


def raw_reserve(items: list[tuple[str, int]], budget: int, raw_start: int, required: int) -> int:
    """Tokens that state items leave to raw evidence. items: (kind, tokens) in order, evidence from raw_start on; the
    first `required` of it are proof."""
    raw = [n for _, n in items[raw_start:]]
    if required:
        reserve = min(sum(raw[:required]), max(budget - sum(n for _, n in items[:raw_start]), 0))
    else:
        reserve = min(raw[0], budget // 2) if raw else 0
    resolved = sum(n for kind, n in items[:raw_start] if kind == "state_resolved")
    share = min(budget // 2, sum(raw), max(budget - resolved, 0))
    return max(reserve, share)


PACKED = "request string, id string, kind string, tokens long, place long, truncated boolean, rendered string"


def pack_state(items: DataFrame, budget: int, required: str | None = None) -> DataFrame:
    """Items (request, id, kind, place, rendered, raw, subject_key, and a column with the number of required proof
    items) packed in order: what does not fit is skipped. State items leave the reserve to evidence; an entity's card is
    left out when a state of that entity is in."""
    cols = items.withColumn("_required", F.col(required).cast("int") if required else F.lit(0)).select("request", "id", "kind", "place", "rendered", "raw", "subject_key", "_required")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("place", kind="stable").to_dict("records")
        rows = [r for r in rows if not r["raw"]] + [r for r in rows if r["raw"]]
        start = sum(not r["raw"] for r in rows)
        sizes = [(r["kind"], estimate_tokens_py(r["rendered"])) for r in rows]
        reserve = raw_reserve(sizes, budget, start, int(rows[0]["_required"] or 0))
        seen, subjects, used, truncated, out = set(), set(), 0, False, []
        for i, (r, (kind, n)) in enumerate(zip(rows, sizes)):
            if r["id"] in seen or (kind == "state_entity_card" and r["subject_key"] in subjects):
                continue
            seen.add(r["id"])
            if used + n > (max(budget - reserve, 0) if i < start else budget):
                truncated = True
                continue
            if kind in ("state_tombstone", "state_unsupported", "state_derived", "state_current", "state_set") and r["subject_key"]:
                subjects.add(r["subject_key"])
            used += n
            out.append((str(r["request"]), r["id"], kind, n, len(out), r["rendered"]))
        return pd.DataFrame([(*o[:5], truncated, o[5]) for o in out], columns=[c.split()[0] for c in PACKED.split(", ")])

    return cols.groupBy("request").applyInPandas(run, PACKED)


def pack_plain(items: DataFrame, budget: int) -> DataFrame:
    """The longest prefix of each request's distinct items that fits; if not even the first does, that one clipped."""
    w = Window.partitionBy("request").orderBy("place")
    once = items.withColumn("_n", F.row_number().over(Window.partitionBy("request", "id").orderBy("place"))).where("_n = 1").drop("_n")
    sized = once.withColumn("tokens", estimate_tokens("rendered")).withColumn("running", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_first", F.row_number().over(w) == 1)
    clip = F.pandas_udf(lambda t: t.map(lambda x: clip_to_budget(x, budget)), T.StringType())
    kept = sized.where((F.col("running") <= budget) | (F.col("_first") & F.lit(budget > 0)))
    over = F.col("running") > budget
    text = F.when(over, clip("rendered")).otherwise(F.col("rendered"))
    return kept.withColumn("rendered", text).withColumn("tokens", estimate_tokens("rendered")).drop("_first", "running")
