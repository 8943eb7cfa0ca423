"""The facade: one object over a store, with plain dictionaries in and DataFrames or dictionaries out."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.scalars import SCOPE, fnv1a64, generated_id
from .operators import answers as A
from .operators import canonical as K
from .operators import claims as C
from .operators import context as X
from .operators import erasure as D
from .operators import maintenance as M
from .operators import retrieval as R
from .operators import rules as U
from .operators import scans as SC
from .operators import timeline as TL
from .operators.ingest import missing_evidence
from .operators.predicates import scope_exact, scope_read, settled, span_active, state_visible
from .sources.storage import OP, ROW, SEQ, AlreadyExists, Store, schemas
from .streaming.ingest import append_artifacts, append_episodes

#: Rows that a reply in JSON carries.
ROWS = 10_000


class Memory:
    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark

    @classmethod
    def create(cls, spark: SparkSession, root: str, name: str, tenant_isolation: bool = False) -> Memory:
        return cls(Store.create(spark, root, name, schemas(), tenant_isolation))

    @classmethod
    def open(cls, spark: SparkSession, root: str, name: str) -> Memory:
        return cls(Store.open(spark, root, name))

    # helpers

    @staticmethod
    def scope(scope: Mapping[str, str | None]) -> dict[str, str | None]:
        given = {k if k.endswith("_id") else f"{k}_id": v for k, v in scope.items()}
        if unknown := set(given) - set(SCOPE):
            raise ValueError(f"unknown scope ids {sorted(unknown)}")
        return {k: given.get(k) for k in SCOPE} | {"space_id": given.get("space_id") or "default"}

    def _rows(self, table: str, rows: Sequence[Mapping]) -> DataFrame:
        schema = schemas()[table]
        names = sorted({k for r in rows for k in r})
        part = T.StructType([schema[n] for n in names])
        return self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], part)

    def read(self, table: str, scope: Mapping[str, str | None]) -> DataFrame:
        s = self.scope(scope)
        return self.store.table(table, s["tenant_id"]).where(scope_read(s))

    # writes

    def ingest_episode(self, item: Mapping) -> dict:
        """One message: its spans and a pending job come with it."""
        s, text = self.scope(item["scope"]), item.get("text", "")
        at = int(item.get("event_time_ms", 0))
        seq = int(item.get("sequence_no", at))
        eid = item.get("id") or generated_id("ep", s["space_id"], [str(seq), str(at), hashlib.sha256(text.encode()).hexdigest()], [s[k] for k in SCOPE[1:]])
        row = {**s, "id": eid, "sequence_no": seq, "event_time_ms": at, "valid_from_ms": item.get("valid_from_ms"), "raw_text": text, "actor_kind": item.get("actor_kind", "user"), "source_kind": item.get("source_kind", "user_message")}
        append_episodes(self.store, self._rows("episodes", [row]))
        return {"id": eid}

    def add_claims(self, items: Sequence[Mapping]) -> list[str]:
        rows = []
        for it in items:
            s = self.scope(it["scope"])
            subject, predicate = it.get("subject"), it.get("predicate")
            cid = it.get("id") or generated_id("claim", s["space_id"], [str(subject), str(predicate), str(it.get("object_value")), str(it.get("observed_at_ms", 0))], [s[k] for k in SCOPE[1:]])
            rows.append({**s, "id": cid, "status": "active", "claim_text": it.get("text") or f"{subject} {predicate} is {it.get('object_value')}", "subject": subject, "predicate": predicate, "object_value": it.get("object_value"), "claim_kind": it.get("kind", "fact"), "polarity": it.get("polarity", "affirmative"), "observed_at_ms": it.get("observed_at_ms", 0), "valid_from_ms": it.get("valid_from_ms", it.get("observed_at_ms", 0)), "valid_to_ms": it.get("valid_to_ms"), "source_sequence_no": it.get("sequence_no"), "asserted_by": it.get("asserted_by", "user"), "slot_id": "slot_" + fnv1a64([" ".join(str(subject).lower().split()), " ".join(str(predicate).lower().split())]), "source_episode_ids": list(it.get("episode_ids", []))})
        self.store.insert("claims", self._rows("claims", rows))
        return [r["id"] for r in rows]

    def add_correction(self, item: Mapping) -> str:
        s = self.scope(item["scope"])
        cid = item.get("id") or generated_id("corr", s["space_id"], [item["operation"], ",".join(item.get("target_ids", [])), str(item.get("effective_at_ms", 0))])
        row = {**s, "id": cid, "status": "active", "operation": item["operation"], "target_type": item.get("target_type", "claim"), "target_match": item.get("target_match", "claim_versions"), "target_ids": list(item.get("target_ids", [])), "target_selector": item.get("target_selector"), "target_subject_key": item.get("target_subject_key"), "target_predicate_key": item.get("target_predicate_key"), "effective_at_ms": item.get("effective_at_ms", 0), "source_sequence_no": item.get("sequence_no")}
        self.store.insert("corrections", self._rows("corrections", [row]))
        return cid

    def get_claim(self, scope: Mapping, claim_id: str) -> dict | None:
        row = self.read("claims", scope).where(F.col("id") == claim_id).first()
        return None if row is None else row.asDict(recursive=True)

    def tombstone(self, item: Mapping) -> str:
        return self.add_correction({**item, "operation": "tombstone"})

    def restore(self, item: Mapping) -> str:
        return self.add_correction({**item, "operation": "restore"})

    def ingest_artifact(self, item: Mapping) -> dict:
        """A file or page: its spans come with it, without a job."""
        s, text = self.scope(item["scope"]), item.get("text", "")
        content = hashlib.sha256(text.encode()).hexdigest()
        aid = item.get("id") or "artifact_" + hashlib.sha256("/".join([s["space_id"], item.get("uri") or "", content]).encode()).hexdigest()[:16]
        row = {**s, "id": aid, "artifact_kind": item.get("kind", "document"), "title": item.get("title", ""), "uri": item.get("uri"), "content_hash": content, "ingested_at_ms": int(item.get("ingested_at_ms", 0)), "valid_from_ms": item.get("valid_from_ms"), "valid_to_ms": item.get("valid_to_ms")}
        append_artifacts(self.store, self._rows("artifacts", [row]).withColumn("text", F.lit(text)))
        return {"id": aid}

    def _add(self, table: str, kind: str, item: Mapping, parts: Sequence[str], **fields) -> str:
        s = self.scope(item["scope"])
        rid = item.get("id") or generated_id(kind, s["space_id"], list(parts), [s[k] for k in SCOPE[1:]])
        self.store.insert(table, self._rows(table, [{**s, "id": rid, "status": "active", **fields}]))
        return rid

    def add_profile(self, item: Mapping) -> str:
        return self._add("profiles", "profile", item, [item["subject_id"], item["key"], str(item.get("generated_at_ms", 0))], subject_id=item["subject_id"], profile_key=item["key"], profile_text=item["text"], evidence_claims=list(item.get("claim_ids", [])), source_spans=list(item.get("span_ids", [])), generated_at_ms=item.get("generated_at_ms", 0))

    def add_edge(self, item: Mapping) -> str:
        return self._add("edges", "edge", item, [item["src"], item["dst"], item["relation"]], src_entity_id=item["src"], dst_entity_id=item["dst"], relation_type=item["relation"], claim_id=item.get("claim_id"), source_spans=list(item.get("span_ids", [])), confidence=item.get("confidence"))

    def add_entity(self, item: Mapping, now_ms: int = 0) -> str:
        """An entity; with names that all belong to one known entity it is that one, and its names and sources are united."""
        s = self.scope(item["scope"])
        stored, aliases = self.read("entities", s), self.read("entity_aliases", s)
        row = {**s, "id": item.get("id") or "", "status": "active", "canonical_name": item["name"], "aliases": list(item.get("aliases", [])), "source_claims": list(item.get("claim_ids", [])), "entity_type": item.get("type", "other")}
        new = K.resolve_entity_ids(self._rows("entities", [row]), K.entity_registry(aliases))
        known = new.first()["entity_id"]
        row["id"] = known or item.get("id") or generated_id("entity", s["space_id"], [row["entity_type"], item["name"]], [s[k] for k in SCOPE[1:]])
        new = self._rows("entities", [row])
        if not K.foreign_ids(new, self.store._live("entities", self.store.manifest()), SCOPE).isEmpty():
            raise AlreadyExists(row["id"])
        merged = K.merge_entities(stored.where(F.col("id") == row["id"]), new)
        for c in SCOPE:
            merged = merged.withColumn(c, F.lit(s[c]))
        merged = merged.withColumn("status", F.lit("active"))
        names, gone = K.alias_rows(merged, aliases, now_ms)
        for c in SCOPE:
            names = names.withColumn(c, F.lit(s[c]))
        with self.store.mutation(s) as writes:
            writes["entities"] = merged.withColumn(OP, F.lit("put"))
            writes["entity_aliases"] = names.unionByName(gone, allowMissingColumns=True).withColumn(OP, F.lit("put"))
        return row["id"]

    def add_slot_alias(self, item: Mapping, now_ms: int = 0) -> str:
        s = self.scope(item["scope"])
        sk, pk = (" ".join(str(item[k]).lower().split()) for k in ("subject", "predicate"))
        row = {**s, "id": item.get("id") or generated_id("slot_alias", s["space_id"], [sk, pk, item["slot_id"]]), "status": "active", "alias_subject_key": sk, "alias_predicate_key": pk, "alias_subject_entity_id": item.get("entity_id"), "canonical_slot_id": item["slot_id"], "source_claims": list(item["claim_ids"]), "recorded_at_ms": now_ms}
        rows = self._rows("slot_aliases", [row])
        claims = self.store.table("claims", s["tenant_id"]).where(scope_exact(s))
        bad = K.check_slot_aliases(rows, claims, claims.select(F.col("slot_id").alias("slot_key")).distinct()).first()
        if bad is not None:
            raise ValueError(f"{bad['id']}: {bad['reason']}")
        self.store.insert("slot_aliases", rows)
        return row["id"]

    def add_rule(self, item: Mapping) -> str:
        """A dependency rule, bound to the slots of the claims that have its ends' surfaces."""
        s = self.scope(item["scope"])
        fields = {f"{end}_{k}": item[end].get(k) for end in ("trigger", "target") for k in ("subject", "predicate", "subject_entity_id", "slot_id")}
        row = {**s, "id": item.get("id"), "status": "active", **fields, "target_match": item.get("target_match", "exact_slot"), "activation": item.get("activation", "on_change"), "action": item["action"], "value": item.get("value"), "value_template": item.get("value_template"), "source_span_ids": list(item.get("span_ids", [])), "source_episode_ids": list(item.get("episode_ids", [])), "source_sequence_no": item.get("sequence_no"), "valid_from_ms": item.get("valid_from_ms"), "valid_to_ms": item.get("valid_to_ms")}
        schema = schemas()["rules"]
        made = U.checked_rules(self.spark.createDataFrame([tuple(row.get(f.name) for f in schema.fields)], schema))
        bad = made.first()["problem"]
        if bad:
            raise ValueError(bad)
        bound = U.bind(made.drop("problem").withColumn("trigger_binding_status", F.lit("pending")).withColumn("target_binding_status", F.lit("pending")), self.read("claims", s))
        self.store.insert("rules", bound)
        return made.first()["id"]

    def apply_batch(self, scope: Mapping, claims: Sequence[Mapping] = (), corrections: Sequence[Mapping] = (), job_id: str | None = None, worker: str | None = None, now_ms: int = 0) -> dict:
        """Claims and corrections of one scope, the states of their slots, and the end of a job: one commit or nothing.

        Evidence must exist in the scope; destructive corrections must mean one slot each.
        """
        s = self.scope(scope)
        tenant = s["tenant_id"]
        with self.store.mutation(s) as writes:
            stored = self.store.table("claims", tenant).where(scope_exact(s)).drop(SEQ, ROW)
            rows = [{**s, "status": "active", "polarity": c.get("polarity", "affirmative"), "claim_kind": c.get("kind", "fact"), "asserted_by": c.get("asserted_by", "user"), "subject": c.get("subject"), "predicate": c.get("predicate"), "object_value": c.get("object_value"), "claim_text": c.get("text", ""), "observed_at_ms": c.get("observed_at_ms", 0), "valid_from_ms": c.get("valid_from_ms"), "valid_to_ms": c.get("valid_to_ms"), "source_span_ids": list(c.get("span_ids", [])), "source_episode_ids": list(c.get("episode_ids", [])), "id": c.get("id"), "slot_id": c.get("slot_id"), "subject_entity_id": c.get("subject_entity_id"), "slot_facet": None, "source_sequence_no": c.get("sequence_no")} for c in claims]
            new = stored.limit(0)
            if rows:
                new = K.manual_claims(self._rows("claims", rows)).select(*[c for c in stored.columns if c in {f.name for f in schemas()["claims"]} and (c in rows[0] or c in ("subject_key", "evidence_ids"))])
                new = settled(stored.limit(0).unionByName(new, allowMissingColumns=True))
                for refs, table in (("source_span_ids", "spans"), ("source_episode_ids", "episodes")):
                    lost = missing_evidence(new, self.read(table, s), refs).first()
                    if lost is not None:
                        raise ValueError(f"claim {lost['id']} cites {lost['evidence_id']}, which does not exist")
                new = K.sequence_numbers(new, self.read("episodes", s)).select(*stored.columns)
                new = settled(K.canonicalize_claims(new, K.entity_registry(self.read("entity_aliases", s)), K.slot_registry(self.read("slot_aliases", s))))
                writes["claims"] = new.join(stored.select("id"), "id", "left_anti").withColumn(OP, F.lit("put"))
            every = stored.unionByName(new)
            cor = self.store.table("corrections", tenant).where(scope_exact(s)).drop(SEQ, ROW)
            touched = new.select("slot_id")
            if corrections:
                made = [{**s, "id": c.get("id") or generated_id("corr", s["space_id"], [c["operation"], ",".join(c.get("target_ids", [])), str(c.get("effective_at_ms", 0))]), "status": "active", "operation": c["operation"], "target_type": "claim", "target_match": c.get("target_match", "claim_versions"), "target_ids": list(c.get("target_ids", [])), "target_selector": c.get("target_selector"), "target_subject_key": c.get("target_subject_key"), "target_predicate_key": c.get("target_predicate_key"), "target_slot_id": c.get("target_slot_id"), "new_value": c.get("new_value"), "effective_at_ms": c.get("effective_at_ms", 0), "source_sequence_no": c.get("sequence_no")} for c in corrections]
                rows_ = self._rows("corrections", made)
                slots = every.select(F.col("slot_id").alias("slot_key"), F.lower("subject").alias("subject_key"), F.lower("predicate").alias("predicate_key")).distinct()
                targets = K.resolve_targets(rows_, every, slots)
                bad = targets.where("problem is not null").first()
                if bad is not None:
                    raise ValueError(f"{bad['id']}: {bad['problem']}")
                cor = cor.unionByName(rows_, allowMissingColumns=True)
                touched = touched.union(targets.select("target_slot_id")).distinct()
                writes["corrections"] = rows_.withColumn(OP, F.lit("put"))
                named = every.join(rows_.where("operation = 'replace'").select(F.col("id").alias("correction_id"), F.explode("target_ids").alias("_t")), F.col("id") == F.col("_t")).drop("_t")
                fresh = stored.limit(0).unionByName(K.replacement_claims(rows_, named).drop("replaced_id"), allowMissingColumns=True)
                for c in SCOPE:
                    fresh = fresh.withColumn(c, F.lit(s[c]))
                every = every.unionByName(fresh)
                writes["claims"] = (writes["claims"].unionByName(fresh.withColumn(OP, F.lit("put"))) if "claims" in writes else fresh.withColumn(OP, F.lit("put")))
            states = self.store.table("state_records", tenant).where(scope_exact(s)).drop(SEQ, ROW)
            out = TL.project(touched.where("slot_id is not null").distinct(), every, cor, states, None, now_ms, f"batch/{now_ms}")
            made_states = states.limit(0)
            for part in out.values():
                made_states = made_states.unionByName(part.select(*[c for c in part.columns if c in states.columns]), allowMissingColumns=True)
            writes["state_records"] = made_states.withColumn(OP, F.lit("put"))
            if job_id is not None:
                job = self._job(scope, job_id, worker)
                writes["extraction_jobs"] = job.withColumn(OP, F.lit("delete"))
            for t, df in writes.items():
                writes[t] = settled(df)
            counts = {t: df.count() for t, df in writes.items()}
        return counts

    def erase_scope(self, scope: Mapping[str, str | None]) -> dict[str, int]:
        """Delete a scope and every narrower one from all tables; the rows per table."""
        s, out = self.scope(scope), {}
        with self.store.mutation(s, erase=True) as writes:
            for table in schemas():
                gone = self.store.table(table, s["tenant_id"]).where(scope_read(s))
                out[table] = gone.count()
                if out[table]:
                    writes[table] = gone.withColumn(OP, F.lit("delete"))
        return out

    def _erase(self, scope: Mapping, plan: Mapping[str, DataFrame], rewrites: Mapping[str, DataFrame], tables: Mapping[str, DataFrame]) -> dict[str, int]:
        plan, rewrites = {t: settled(ids) for t, ids in plan.items()}, {t: settled(df) for t, df in rewrites.items()}
        out = {t: ids.count() for t, ids in plan.items()}
        with self.store.mutation(self.scope(scope), erase=True) as writes:
            for t in tables:
                parts = []
                if out.get(t):
                    parts.append(tables[t].join(plan[t], "id", "left_semi").withColumn(OP, F.lit("delete")))
                if t in rewrites and not rewrites[t].isEmpty():
                    parts.append(rewrites[t].withColumn(OP, F.lit("put")))
                if parts:
                    writes[t] = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1].select(*parts[0].columns))
        return out

    def _tables(self, scope: Mapping) -> dict[str, DataFrame]:
        return {t: self.read(t, scope).drop(SEQ, ROW) for t in schemas()}

    def erase_episodes(self, scope: Mapping, episode_ids: Sequence[str]) -> dict[str, int]:
        """Episodes and all that depends on them; the rows per table."""
        tables = self._tables(scope)
        plan, rewrites = D.episodes(tables, self.spark.createDataFrame([(i,) for i in episode_ids], "id string"))
        return self._erase(scope, plan, rewrites, tables)

    def purge_forgotten(self, scope: Mapping, before_ms: int) -> dict[str, int]:
        """D3: the values of claims forgotten before a time leave the store; texts that hold them are redacted."""
        tables = self._tables(scope)
        made = D.purge(tables, before_ms)
        markers = self.spark.createDataFrame([], tables["claims"].schema).unionByName(made["markers"], allowMissingColumns=True)
        for c, v in self.scope(scope).items():
            markers = markers.withColumn(c, F.lit(v))
        rewrites = {**made["rewrites"], "claims": markers, "spans": made["spans"].select(*tables["spans"].columns), "episodes": made["episodes"].select(*tables["episodes"].columns), "corrections": made["corrections"].select(*tables["corrections"].columns)}
        n = {"markers": markers.count(), "redacted_spans": rewrites["spans"].count(), "redacted_episodes": rewrites["episodes"].count()}
        return self._erase(scope, made["erased"], rewrites, tables) | n

    # reads

    def list_claims(self, scope: Mapping, at_ms: int | None = None) -> DataFrame:
        return C.current_claims(self.read("claims", scope), self.read("corrections", scope), at_ms)

    def search(self, scope: Mapping, query: str, k: int = 10, mode: str = "keyword", embedding: list[float] | None = None, at_ms: int | None = None) -> DataFrame:
        """Spans by BM25, by vector, or by both fused; excluded spans left out. id and score, the best first.

        A vector search keeps its nearest fetch_k(k) spans before corrections, so many excluded ones near the query can
        leave fewer than k. Spans without words are not found by keyword.
        """
        live, cor = self.read("spans", scope).where(span_active(at_ms)), self.read("corrections", scope)
        place = [SEQ, ROW]

        def words() -> DataFrame:
            with_words = live.where("lexical_terms is null or size(lexical_terms) > 0")
            near = R.bm25(with_words, query, R.fetch_k(k), corpus="matched").join(live.select("id", "text"), "id")
            return R.span_exclusions(near, cor, at_ms).orderBy(F.desc("score"), "id").limit(k).select("id", "score")

        def vectors() -> DataFrame:
            near = R.vector_top_k(live, list(embedding or []), R.fetch_k(k), tie=place)
            return R.span_exclusions(near, cor, at_ms).orderBy("score", *place).limit(k).select("id", "score", *place)

        if mode == "keyword":
            return words()
        if mode == "vector":
            return vectors().select("id", "score")
        return R.rrf([(R.ranked(vectors(), F.col("score"), F.col(SEQ), F.col(ROW)), 1.0), (R.ranked(words(), F.desc("score"), F.col("id")), 1.0)], k)

    def compare_search_modes(self, scope: Mapping, query: str, k: int = 10, embedding: list[float] | None = None) -> dict[str, list[str]]:
        """The ids that each mode finds, at most k each."""
        modes = ["keyword"] + (["vector", "hybrid"] if embedding else [])
        return {m: [r["id"] for r in self.search(scope, query, k, m, embedding).collect()] for m in modes}

    def pack_context(self, scope: Mapping, query: str, token_budget: int, k: int = 50, before: int = 0, after: int = 0) -> DataFrame:
        """The hits of a search, and their neighbours if wanted, rendered and packed into the budget."""
        spans = self.read("spans", scope).where(span_active())
        hits = R.ranked(self.search(scope, query, k), F.desc("score"), F.col("id")).join(spans.select("id", "source_id", "span_index", "text"), "id")
        if before or after:
            near = R.neighbors(hits.select("source_id", "span_index", "rank", "score"), spans.select("source_id", "span_index", "id", "text"), before, after)
            hits = near.select("id", "source_id", "span_index", "text", "score", "rank")
        items = hits.select(F.lit("1").alias("request"), "id", X.render_span().alias("rendered"), F.struct("rank", "span_index", "id").alias("place"), "score")
        return X.pack_plain(items, token_budget)

    def answer_state(self, scope: Mapping, query: str, selections: Sequence[Mapping] = (), evidence_span_ids: Sequence[str] = (), limit: int = 256, valid_at: int | None = None, transaction_at: int | None = None) -> dict[str, DataFrame]:
        """The answer-ready read: selected states, the support of the answer targets, and each target's resolved slot."""
        views, targets = A.read_plan(list(selections))
        ids = lambda xs: self.spark.createDataFrame([(x,) for x in xs], "id string")
        claims, entities = self.read("claims", scope), self.read("entities", scope)
        slots = SC.merge_slots(TL.slot_identities(claims, None, None, 0, "read"))
        visible = self.read("state_records", scope).where(state_visible(valid_at, transaction_at)).drop(SEQ, ROW)
        named = A.query_slots(slots, entities, query).withColumnRenamed("slot_key", "slot_id")
        cited = SC.slots_of_evidence(claims, ids(evidence_span_ids))
        chosen = ids(views).withColumnRenamed("id", "slot_id") if views else named.union(cited).distinct()
        if views:
            chosen = A.dependency_slots(chosen, self.read("rules", scope)).select(F.col("node").alias("slot_id"))
        states = A.candidate_states(visible, chosen, A.mentioned_entities(entities, query), bool(views))
        scored = A.assess(settled(states), query, preferred=chosen if views else named, evidence_slots=cited, evidence_spans=ids(evidence_span_ids), entities=entities)
        scored = settled(scored)
        selected = settled(A.select_states(scored, limit))
        if views:
            selected = A.visible_in_views(selected, views)
        goal = ids(targets).withColumnRenamed("id", "slot_id") if targets else selected.select("slot_id").distinct()
        goal = settled(goal)
        now = settled(SC.current_of_slots(claims.drop(SEQ, ROW), goal, self.read("corrections", scope).drop(SEQ, ROW), None, valid_at))
        sets = selected.where("state_kind = 'set'")
        versions = SC.state_history(self.read("state_records", scope), goal, valid_at, transaction_at)
        support = settled(A.with_views(A.target_support(A.claim_support(now, sets), goal, slots), views, versions))
        return {"states": selected, "support": support, "slots": A.resolved_slots(support, now, sets, versions), "trace": A.selection_trace(visible, scored, selected)}

    def validate_answer(self, answer: DataFrame, support: DataFrame, spans: DataFrame) -> None:
        A.validate(answer, support, spans)

    def finalize_answer(self, answer: DataFrame, support: DataFrame, spans: DataFrame, refuse: bool = False) -> dict:
        return A.finalize(answer, support, spans, refuse)

    # jobs

    def lease_jobs(self, now_ms: int, worker: str, lease_ms: int = 60_000, max_attempts: int = 3, limit: int = 10, tenant: str | None = None) -> list[str]:
        """The ids of jobs that a worker may work on until its lease ends; expired leases without attempts left fail."""
        jobs = self.store.table("extraction_jobs", tenant).drop(SEQ, ROW)
        spent = jobs.where((F.col("status") == "leased") & (F.col("lease_expires_at_ms") <= now_ms) & (F.col("attempt_count") + 1 >= max_attempts))
        if not spent.isEmpty():
            self.store.upsert("extraction_jobs", spent.withColumn("status", F.lit("failed")).withColumn("last_error", F.lit("the lease expired")))
            jobs = self.store.table("extraction_jobs", tenant).drop(SEQ, ROW)
        free = M.leasable(jobs, now_ms, max_attempts).orderBy("sequence_no", "id").limit(limit)
        again = F.when(F.col("lease_owner").isNotNull(), F.col("attempt_count") + 1).otherwise(F.col("attempt_count"))
        taken = free.withColumn("attempt_count", again).withColumn("status", F.lit("leased")).withColumn("lease_owner", F.lit(worker)).withColumn("lease_expires_at_ms", F.lit(now_ms + lease_ms))
        ids = [r["id"] for r in taken.select("id").collect()]  # at most `limit`
        if ids:
            self.store.upsert("extraction_jobs", taken)
        return ids

    def _job(self, scope: Mapping | None, job_id: str, worker: str | None = None, status: str = "leased") -> DataFrame:
        tenant = self.scope(scope)["tenant_id"] if scope else None
        job = self.store.table("extraction_jobs", tenant).where(F.col("id") == job_id).drop(SEQ, ROW)
        row = job.first()
        if row is None:
            raise KeyError(job_id)
        if row["status"] != status or (worker is not None and row["lease_owner"] != worker):
            raise ValueError(f"the job is {row['status']}, of {row['lease_owner']}")
        return job

    def complete_job(self, job_id: str, worker: str, scope: Mapping | None = None) -> None:
        """A completed job leaves the queue."""
        self.store.remove("extraction_jobs", self._job(scope, job_id, worker))

    def fail_job(self, job_id: str, worker: str, error: str, now_ms: int = 0, scope: Mapping | None = None) -> None:
        """A failed job holds back the later ones of its scope until it is retried or skipped."""
        job = self._job(scope, job_id, worker)
        free = job.withColumn("status", F.lit("failed")).withColumn("attempt_count", F.col("attempt_count") + 1).withColumn("last_error", F.lit(error))
        self.store.upsert("extraction_jobs", free.withColumn("lease_owner", F.lit(None).cast("string")).withColumn("updated_at_ms", F.lit(now_ms)))

    def retry_job(self, job_id: str, scope: Mapping | None = None) -> None:
        job = self._job(scope, job_id, status="failed")
        self.store.upsert("extraction_jobs", job.withColumn("status", F.lit("pending")).withColumn("attempt_count", F.lit(0)).withColumn("lease_owner", F.lit(None).cast("string")))

    def skip_job(self, job_id: str, scope: Mapping | None = None) -> None:
        self.store.upsert("extraction_jobs", self._job(scope, job_id, status="failed").withColumn("status", F.lit("skipped")))

    def backlog(self, scope: Mapping) -> dict:
        """Open jobs of the scope and the narrower ones."""
        return self.read("extraction_jobs", scope).transform(M.backlog).first().asDict()

    # text in, text out

    def call(self, method: str, payload: str) -> str:
        """A method by name with its arguments as a JSON object; rows come back as a JSON list, of at most ROWS rows."""
        if method.startswith("_") or method in ("call", "create", "open") or not hasattr(self, method):
            raise ValueError(f"no method {method}")
        out = getattr(self, method)(**json.loads(payload))
        if isinstance(out, DataFrame):
            out = [r.asDict(recursive=True) for r in out.limit(ROWS).collect()]
        elif isinstance(out, dict):
            out = {k: [r.asDict(recursive=True) for r in v.limit(ROWS).collect()] if isinstance(v, DataFrame) else v for k, v in out.items()}
        return json.dumps(out, default=str)
