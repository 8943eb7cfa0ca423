"""Versioned Parquet tables: append segments, a manifest swap as the commit, views that resolve the latest write.

A table is a folder of immutable segments and a numbered manifest of those that are live. A commit writes its segments
first and its manifest last, so readers see all of it or nothing, a lost task is retried by Spark's own commit protocol,
and a failed commit leaves only unreferenced files. A snapshot pins a manifest. One writer per store.

Names, schemas and pk rules: insert keeps what is there (the first of equal pks in a call wins), upsert replaces whole
rows (the last one wins) and gives a new place in storage order, delete needs a filter.
"""

from __future__ import annotations

import json
import re
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import SCOPE, lexical_terms
from ..operators import filters

NAME = re.compile(r"[a-z0-9_]{1,63}")
#: Storage order: the commit's number, then the row's number in the commit.
SEQ, ROW, OP = "_seq", "_row", "_op"
SCHEMA_VERSION = 1


@dataclass(frozen=True)
class StoreConfig:
    """What a store is opened with. Connections and certificates are the cluster's concern, not the store's."""

    name: str
    tenant_isolation: bool = False
    embedding_dim: int | None = None

    def __post_init__(self) -> None:
        if not NAME.fullmatch(self.name):
            raise ValueError(f"bad store name {self.name!r}")
        if self.embedding_dim is not None and not 0 < self.embedding_dim <= 20_000:
            raise ValueError("an embedding has 1 to 20000 dimensions")


class NotFound(KeyError):
    pass


class AlreadyExists(ValueError):
    pass


class PermissionDenied(PermissionError):
    pass


class Files:
    """The few file operations of the manifest, through Hadoop's file system, so any store that Spark writes will do."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf, self.root = spark._jvm, spark._jsc.hadoopConfiguration(), root.rstrip("/")

    def path(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def fs(self):
        return self.path().getFileSystem(self.conf)

    def exists(self, name: str = "") -> bool:
        return self.fs().exists(self.path(name))

    def names(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs().listStatus(self.path(name))) if self.exists(name) else []

    def read(self, name: str) -> str:
        stream = self.fs().open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Write beside, then rename: the name appears whole or not at all, and never replaces another's."""
        part = f"{name}.{uuid.uuid4().hex}.tmp"
        stream = self.fs().create(self.path(part), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self.exists(name) or not self.fs().rename(self.path(part), self.path(name)):
            self.fs().delete(self.path(part), False)
            raise RuntimeError(f"{name} was committed by another writer")

    def drop(self) -> None:
        self.fs().delete(self.path(), True)


class Store:
    """Named tables under one folder. schema maps a table to its StructType (with the primary key `id`)."""

    def __init__(self, spark: SparkSession, root: str, name: str, tenant_isolation: bool = False):
        self.config = StoreConfig(name, tenant_isolation)
        self.spark, self.files, self.tenant_isolation = spark, Files(spark, f"{root.rstrip('/')}/{name}"), tenant_isolation
        self.at: int | None = None
        self.locks = ScopeLocks()
        self._cache: dict[tuple[str, str | None], DataFrame] | None = None

    @classmethod
    def create(cls, spark: SparkSession, root: str, name: str, tables: dict[str, T.StructType], tenant_isolation: bool = False) -> Store:
        out = cls(spark, root, name, tenant_isolation)
        if out.files.exists("manifest"):
            raise AlreadyExists(name)
        out._publish(0, {"version": SCHEMA_VERSION, "tenant_isolation": tenant_isolation, "schemas": {t: json.loads(s.json()) for t, s in tables.items()}, "segments": {t: [] for t in tables}})
        return out

    @classmethod
    def open(cls, spark: SparkSession, root: str, name: str) -> Store:
        """The store, brought to this version by the migrations that it lacks; a newer one is refused."""
        out = cls(spark, root, name)
        manifest = out.manifest()
        if manifest["version"] > SCHEMA_VERSION:
            raise NotImplementedError(f"schema version {manifest['version']}")
        out.tenant_isolation = manifest["tenant_isolation"]
        for version in range(manifest["version"], SCHEMA_VERSION):
            MIGRATIONS[version](out)
        return out

    def drop(self) -> None:
        if self.files.exists():
            self.files.drop()

    def _publish(self, number: int, manifest: dict) -> None:
        self.files.publish(f"manifest/{number:012d}.json", json.dumps(manifest))

    def _number(self) -> int:
        names = [n for n in self.files.names("manifest") if n.endswith(".json")]
        if not names:
            raise NotFound(self.files.root)
        return int(names[-1].split(".")[0])

    def manifest(self) -> dict:
        return json.loads(self.files.read(f"manifest/{self.at if self.at is not None else self._number():012d}.json"))

    def snapshot(self) -> Store:
        """A reader that stays at the latest commit."""
        out = Store.__new__(Store)
        out.__dict__ |= self.__dict__ | {"at": self._number()}
        return out

    def _segments(self, table: str, manifest: dict, names: list[str]) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schemas"][table])
        full = T.StructType([*schema.fields, T.StructField(SEQ, T.LongType()), T.StructField(ROW, T.LongType()), T.StructField(OP, T.StringType())])
        paths = [f"{self.files.root}/{table}/{n}" for n in names]
        return self.spark.read.schema(full).parquet(*paths) if paths else self.spark.createDataFrame([], full)

    def _live(self, table: str, manifest: dict) -> DataFrame:
        """The latest write of each id that is no delete. The first segment, once compacted, holds each id once: it is
        read as it is, without what the later segments write again; only those are ranked by id."""
        names = manifest["segments"][table]
        unique = names[:1] if names and names[0] in manifest.get("unique", []) else []
        base, newer = (self._segments(table, manifest, part) for part in (unique, names[len(unique) :]))
        w = Window.partitionBy("id").orderBy(F.desc(SEQ), F.desc(ROW))
        if len(names) == len(unique):
            return base.drop(OP)
        last = newer.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
        live = last.where(F.col(OP) != "delete")
        if unique:
            live = base.join(last.select("id"), "id", "left_anti").select(live.columns).union(live)
        return live.drop(OP)

    def table(self, name: str, tenant: str | None = None) -> DataFrame:
        """The live rows with their place in storage order. With tenant isolation a tenant is needed, and filters the scan."""
        if self._cache is not None and (name, tenant) in self._cache:
            return self._cache[name, tenant]
        manifest = self.manifest()
        if name not in manifest["schemas"]:
            raise NotFound(name)
        if self.tenant_isolation and tenant is None:
            raise PermissionDenied("a tenant is needed")
        out = self._live(name, manifest)
        if self.tenant_isolation:
            out = out.where(F.col("tenant_id") == tenant)
        if self._cache is not None:
            self._cache[name, tenant] = out.persist()
            return self._cache[name, tenant]
        return out

    @contextmanager
    def read_cache(self) -> Iterator[Store]:
        """A reader at the latest commit that reads each table once; its cached tables go when it ends."""
        out = self.snapshot()
        out._cache = {}
        try:
            yield out
        finally:
            for df in out._cache.values():
                df.unpersist()
            out._cache = None

    def scan(self, name: str, where: str = "", limit: int | None = None, tenant: str | None = None) -> DataFrame:
        """Matches of a filter in storage order; a limit comes after the filter."""
        out = filters.where(self.table(name, tenant), where).orderBy(SEQ, ROW)
        return out if limit is None else out.limit(limit)

    def fetch(self, name: str, ids: DataFrame, tenant: str | None = None) -> DataFrame:
        return self.table(name, tenant).join(ids.select("id").distinct(), "id", "left_semi")

    def commit(self, writes: dict[str, DataFrame]) -> None:
        """Append each table's rows (with the column _op) as one segment, all of them visible at once."""
        number, manifest = self._number(), self.manifest()
        for table, rows in writes.items():
            schema = T.StructType.fromJson(manifest["schemas"][table])
            cols = [(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields]
            segment = uuid.uuid4().hex
            # the row's number is unique and increasing inside a commit, without a shuffle
            numbered = rows.select(*cols, F.lit(number + 1).cast("long").alias(SEQ), F.monotonically_increasing_id().alias(ROW), F.col(OP))
            numbered.write.parquet(f"{self.files.root}/{table}/{segment}")
            manifest["segments"][table].append(segment)
        self._publish(number + 1, manifest)

    @contextmanager
    def mutation(self, scope: dict[str, str | None], erase: bool = False) -> Iterator[dict[str, DataFrame]]:
        """A transaction: what the block puts into the dictionary (table to rows with _op) is committed at its end, at
        once; nothing is if it fails. Writers of one scope, and an erasure of any broader one, wait for each other."""
        writes: dict[str, DataFrame] = {}
        with self.locks.held(scope, erase):
            yield writes
            if writes:
                self.commit(writes)

    def insert(self, name: str, rows: DataFrame, order: str | None = None, tenant: str | None = None) -> DataFrame:
        """Rows whose id is not live are added; gives (id, inserted). Of equal ids in a call the first by `order` wins."""
        w = Window.partitionBy("id").orderBy(F.col(order) if order else F.monotonically_increasing_id())
        before = self.snapshot()
        live = before._live(name, before.manifest()).select("id")
        new = rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn").join(live, "id", "left_anti").withColumn(OP, F.lit("put"))
        self.commit({name: new})
        return rows.select("id").distinct().join(live.withColumn("_k", F.lit(True)), "id", "left").select("id", F.col("_k").isNull().alias("inserted"))

    def upsert(self, name: str, rows: DataFrame, order: str | None = None) -> None:
        w = Window.partitionBy("id").orderBy((F.col(order) if order else F.monotonically_increasing_id()).desc())
        self.commit({name: rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn").withColumn(OP, F.lit("put"))})

    def delete(self, name: str, where: str, tenant: str | None = None) -> int:
        if not where.strip():
            raise ValueError("a delete needs a filter")
        return self.remove(name, filters.where(self.table(name, tenant), where))

    def remove(self, name: str, gone: DataFrame) -> int:
        """Delete rows of table()."""
        n = gone.count()
        if n:
            self.commit({name: gone.withColumn(OP, F.lit("delete"))})
        return n

    def compact(self, name: str) -> None:
        """Rewrite a table's live rows as one segment that holds each id once; earlier snapshots keep their files."""
        number, manifest = self._number(), self.manifest()
        segment = uuid.uuid4().hex
        self._live(name, manifest).withColumn(OP, F.lit("put")).write.parquet(f"{self.files.root}/{name}/{segment}")
        manifest["segments"][name] = [segment]
        manifest["unique"] = [*manifest.get("unique", []), segment]
        self._publish(number + 1, manifest)


def scope_lock_keys(scope: dict[str, str | None], erase: bool = False) -> tuple[list[tuple], tuple]:
    """(keys of all broader scopes, the key of the exact one). A broader scope lacks some of the ids that are set beside
    the space; an erasure's keys are marked, so that it meets the writers of every scope that it covers."""
    given = [(k, scope[k]) for k in SCOPE[1:] if scope.get(k) is not None]
    space = ("space_id", scope.get("space_id"))
    broader = [(erase, space, *part) for n in range(len(given)) for part in combinations(given, n)]
    return broader, (erase, space, *given)


class ScopeLocks:
    """One writer a scope, in this driver: an erasure of a scope excludes the writers of all that are narrower."""

    def __init__(self) -> None:
        self._free = threading.Condition()
        self._holders: list[tuple[int, list[tuple], tuple, bool]] = []

    def _may(self, broader: list[tuple], exact: tuple, erase: bool) -> bool:
        for thread, their_broader, their_exact, their_erase in self._holders:
            if thread == threading.get_ident():
                continue
            if exact == their_exact or (erase and exact in their_broader) or (their_erase and their_exact in broader):
                return False
        return True

    @contextmanager
    def held(self, scope: dict[str, str | None], erase: bool = False) -> Iterator[None]:
        broader, exact = scope_lock_keys(scope)
        holder = (threading.get_ident(), broader, exact, erase)
        with self._free:
            self._free.wait_for(lambda: self._may(broader, exact, erase))
            self._holders.append(holder)
        try:
            yield
        finally:
            with self._free:
                self._holders.remove(holder)
                self._free.notify_all()


def evidence_ids() -> Column:
    """The sorted distinct span and episode ids of a claim."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.concat(F.coalesce("source_span_ids", none), F.coalesce("source_episode_ids", none))))


def _migrate_0(store: Store) -> None:
    """Version 1 keeps words and evidence on the rows: spans get their words only if they had postings (table span_terms)."""
    manifest = store.manifest()
    fill = {}
    if "span_terms" in manifest["schemas"]:
        terms = store._live("span_terms", manifest).groupBy(F.col("span_id").alias("id")).agg(F.array_sort(F.collect_set("term")).alias("_t"))
        fill["spans"] = lambda df: df.join(terms, "id").withColumn("lexical_terms", F.col("_t")).drop("_t")
    fill["state_records"] = lambda df: df.where("lexical_terms is null").withColumn("lexical_terms", F.array_sort(F.array_distinct(lexical_terms("state_text"))))
    fill["claims"] = lambda df: df.where("evidence_ids is null").withColumn("evidence_ids", evidence_ids())
    writes = {t: f(store._live(t, manifest)).withColumn(OP, F.lit("put")) for t, f in fill.items() if t in manifest["schemas"]}
    store.commit(writes)
    manifest = store.manifest() | {"version": 1}
    store._publish(store._number() + 1, manifest)


MIGRATIONS = {0: _migrate_0}


def _table(ddl: str) -> T.StructType:
    """The scope columns, then the table's own."""
    scope = [T.StructField(c, T.StringType()) for c in [*SCOPE, "visibility", "policy_tags_json"]]
    return T.StructType([*scope, *T.StructType.fromDDL(ddl).fields])


def schemas() -> dict[str, T.StructType]:
    """Fixed: the engine's tables, their columns and types."""
    return {
        "episodes": _table(
            "id string, status string, source_kind string, actor_kind string, sequence_no long, created_at_ms long, ingested_at_ms long, event_time_ms long,"
            " valid_from_ms long, valid_to_ms long, raw_text string, blob_ref string, mime_type string, content_hash string, parent_ids_json string, metadata_json string"
        ),
        "artifacts": _table(
            "id string, status string, artifact_kind string, title string, uri string, blob_ref string, mime_type string, content_hash string, source_created_ms long,"
            " source_modified_ms long, created_at_ms long, ingested_at_ms long, valid_from_ms long, valid_to_ms long, extracted_text_ref string, metadata_json string"
        ),
        "spans": _table(
            "id string, status string, source_type string, source_id string, byte_start long, byte_end long, char_start long, char_end long, token_start long, token_end long,"
            " span_index long, text string, text_hash string, chunker_version string, lexical_terms array<string>, embedding_model string, embedding_version string,"
            " lexical_text string, created_at_ms long, valid_from_ms long, valid_to_ms long, provenance_json string, embedding array<float>"
        ),
        "corrections": _table(
            "id string, status string, operation string, target_type string, target_match string, target_ids array<string>, target_selector string, target_subject_key string,"
            " target_predicate_key string, target_subject_entity_id string, target_slot_id string, new_value string, reason string, actor_kind string, authority string,"
            " created_at_ms long, effective_at_ms long, applies_from_ms long, applies_to_ms long, cascade_policy string, source_span_ids array<string>,"
            " source_episode_ids array<string>, source_sequence_no long, metadata_json string"
        ),
        "claims": _table(
            "id string, status string, claim_text string, subject string, subject_key string, predicate string, object_value string, subject_entity_id string, slot_id string,"
            " slot_facet string, claim_kind string, polarity string, source_span_ids array<string>, source_episode_ids array<string>, evidence_ids array<string>,"
            " source_sequence_no long, asserted_by string, extractor_version string, confidence float, observed_at_ms long, valid_from_ms long, valid_to_ms long,"
            " correction_ids array<string>, embedding array<float>"
        ),
        "profiles": _table(
            "id string, status string, subject_id string, profile_key string, profile_text string, value_json string, evidence_claims array<string>, source_spans array<string>,"
            " generated_at_ms long, generator_version string, valid_from_ms long, valid_to_ms long, correction_watermark long"
        ),
        "entities": _table(
            "id string, status string, entity_type string, canonical_name string, aliases array<string>, source_claims array<string>, merge_parents array<string>,"
            " split_from_id string, confidence float, embedding array<float>"
        ),
        "entity_aliases": _table(
            "id string, status string, alias_key string, entity_id string, entity_type string, source_claims array<string>, recorded_at_ms long, superseded_at_ms long"
        ),
        "slot_aliases": _table(
            "id string, status string, alias_subject_key string, alias_predicate_key string, alias_subject_entity_id string, canonical_slot_id string,"
            " source_claims array<string>, valid_from_ms long, valid_to_ms long, recorded_at_ms long, superseded_at_ms long"
        ),
        "edges": _table(
            "id string, status string, src_entity_id string, dst_entity_id string, relation_type string, claim_id string, source_spans array<string>, valid_from_ms long,"
            " valid_to_ms long, confidence float"
        ),
        "rules": _table(
            "id string, status string, trigger_subject string, trigger_predicate string, trigger_subject_key string, trigger_predicate_key string,"
            " trigger_subject_entity_id string, trigger_slot_id string, trigger_binding_status string, target_subject string, target_predicate string,"
            " target_subject_key string, target_predicate_key string, target_subject_entity_id string, target_slot_id string, target_binding_status string,"
            " target_match string, activation string, action string, value_template string, value string, source_span_ids array<string>, source_episode_ids array<string>,"
            " source_sequence_no long, valid_from_ms long, valid_to_ms long, confidence float"
        ),
        "state_records": _table(
            "id string, state_key string, status string, state_kind string, claim_kind string, subject string, predicate string, object_value string,"
            " subject_entity_id string, slot_id string, slot_facet string, state_text string, lexical_terms array<string>, members array<string>, claim_ids array<string>,"
            " correction_ids array<string>, rule_ids array<string>, source_spans array<string>, source_episodes array<string>, source_sequence_no long, observed_at_ms long,"
            " valid_from_ms long, valid_to_ms long, projected_at_ms long, recorded_at_ms long, superseded_at_ms long"
        ),
        "dependency_traces": _table(
            "id string, trace_key string, status string, rule_id string, trigger_claim_id string, prior_trigger_claim_id string, derived_claim_id string,"
            " target_subject_key string, target_predicate_key string, target_subject_entity_id string, target_slot_id string, target_subject string, target_predicate string,"
            " state_kind string, hop long, parent_trace_ids array<string>, source_spans array<string>, source_episodes array<string>, observed_at_ms long,"
            " valid_from_ms long, valid_to_ms long, projected_at_ms long, recorded_at_ms long, superseded_at_ms long"
        ),
        "slots": _table(
            "id string, slot_key string, status string, subject_key string, predicate_key string, subject_entity_id string, subject string, predicate string,"
            " source_claim_ids array<string>, source_rule_ids array<string>, source_entity_ids array<string>, observed_at_ms long, valid_from_ms long, valid_to_ms long,"
            " projected_at_ms long, recorded_at_ms long, superseded_at_ms long"
        ),
        "extraction_jobs": _table(
            "id string, episode_id string, sequence_no long, event_time_ms long, status string, attempt_count long, lease_owner string, lease_expires_at_ms long,"
            " last_error string, created_at_ms long, updated_at_ms long"
        ),
    }
