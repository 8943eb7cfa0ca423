"""Exact dedup against immutable snapshots that are screened by static binary fuse filters.

Texts are equal when identical after lower-casing A-Z. A batch is first grouped by itself: copies within it are counted
in one aggregation. The digests of its groups are then screened, bucket by bucket, with the fuse filter of the snapshot;
only what the filter passes joins the exact buckets, and the texts of the two representatives are compared byte for
byte. The merged groups are the next snapshot. Within a batch, equality is that of SHA-256, MD5 and length together.

Defined results: a null text counts as empty; a null doc_id is the smallest id; every one of repeated rows counts in
group_size and gets its group's row (keep_one leaves one of them); an empty table gives an empty result; extra columns
are ignored by the decisions and kept by keep_one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fuse
from .common import ascii_lower, cut, join_hot, tag

KEY = ["sha", "md", "n_bytes"]
#: Digests in a bucket, on average: the most that one filter or one screening task holds.
BUCKET_ROWS = 50_000
NULL_ID = -(2**63)


def _normal(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), ascii_lower(F.coalesce(F.col("text"), F.lit(""))).alias("t"))


def digests(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, sha (hex), md, n_bytes, all of the normalised whole text."""
    raw = F.encode("t", "UTF-8")
    return _normal(docs).select("doc_id", F.sha2(raw, 256).alias("sha"), F.unhex(F.md5(raw)).alias("md"), F.octet_length("t").alias("n_bytes"))


def _bucket(buckets: int):
    return F.pmod(F.conv(F.substring("sha", 1, 8), 16, 10).cast("long"), F.lit(buckets))


def _words(sha: pd.Series) -> np.ndarray:
    return np.array([int(s[8:24], 16) for s in sha], dtype=np.uint64)


def build_filters(groups: DataFrame, buckets: int) -> DataFrame:
    """One fuse filter per bucket of the snapshot's digests: rows (bucket, fuse)."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bucket": [key[0]], "fuse": [fuse.build(_words(pdf["sha"]))]})

    return groups.select(_bucket(buckets).alias("bucket"), "sha").groupBy("bucket").applyInPandas(one, "bucket long, fuse binary")


def screen(groups: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The groups with a column maybe: whether the snapshot's filter lets their digest pass."""

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        data = right["fuse"].iloc[0] if len(right) else b""
        return left.assign(maybe=fuse.probe(data, _words(left["sha"])))

    with_bucket = groups.withColumn("bucket", _bucket(buckets))
    schema = T.StructType([*with_bucket.schema.fields, T.StructField("maybe", T.BooleanType())])
    return with_bucket.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(one, schema).drop("bucket")


def group_batch(rows: DataFrame) -> DataFrame:
    """The copies within one batch: a row per text with the id that stays and their number."""
    return rows.groupBy(*KEY).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def merge(docs: DataFrame, snapshot: DataFrame, batch: DataFrame) -> DataFrame:
    """The snapshot after the batch's groups: screened, byte-checked, joined; neither is changed."""
    # a bucket's filter and the batch's part of it are held by one task: the larger side decides
    batch = cut(batch, "batch")
    buckets = max(1, -(-max(snapshot.count(), batch.count()) // BUCKET_ROWS))
    filters = cut(build_filters(snapshot, buckets), "fuse")
    screened = cut(screen(batch, filters, buckets), "screened")
    old = snapshot.select(*KEY, F.col("keep_id").alias("old_id"), F.col("group_size").alias("old_size"))
    pairs = screened.where("maybe").join(old, KEY).select(*KEY, "keep_id", "old_id", "old_size", "group_size")
    pairs = cut(pairs, "positives")
    # byte check: the two representatives' texts travel, one pair for each text that both sides hold
    ids = pairs.select(F.explode(F.array("keep_id", "old_id")).alias("doc_id"), "sha").distinct()
    texts = _normal(docs).join(ids, "doc_id").where(F.sha2(F.encode("t", "UTF-8"), 256) == F.col("sha")).groupBy("sha").agg(F.min("t").alias("low"), F.max("t").alias("high"))
    same = texts.where("low = high").select("sha")
    equal = pairs.join(same, "sha", "left_semi")
    merged = equal.select(*KEY, F.greatest("keep_id", "old_id").alias("keep_id"), (F.col("old_size") + F.col("group_size")).alias("group_size"))
    merged = cut(merged, "merged")
    fresh = screened.drop("maybe").join(merged, KEY, "left_anti")
    stay = snapshot.join(merged, KEY, "left_anti")
    cols = [*KEY, "keep_id", "group_size"]
    return cut(merged.select(cols).union(fresh.select(cols)).union(stay.select(cols)), "snapshot")


def group(docs: DataFrame, batches: int = 2) -> tuple[DataFrame, DataFrame]:
    """The digests of docs and their groups. The documents arrive in `batches` ranges of doc_id, all of them."""
    rows = cut(digests(docs), "digests")
    edges = [] if batches < 2 else (rows.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 10_000).alias("q")).first()["q"] or [])
    number = sum((F.when(F.col("doc_id") > e, 1).otherwise(0) for e in sorted(set(edges))), F.lit(0))
    rows = rows.withColumn("batch", number)
    snapshot = cut(group_batch(rows.where("batch = 0")), "snapshot")
    for k in range(1, len(set(edges)) + 1):
        snapshot = merge(docs, snapshot, group_batch(rows.where(F.col("batch") == k)))
    return rows.drop("batch"), snapshot


def assign(docs: DataFrame, batches: int = 2) -> DataFrame:
    """A row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    rows, groups = group(docs, batches)
    out = join_hot(rows, groups, KEY, "group_size", rows.count()).select(
        F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"), F.nullif("keep_id", F.lit(NULL_ID)).alias("keep_id"), "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )
    return out


def keep_one(docs: DataFrame, batches: int = 2) -> DataFrame:
    """The documents that stay, with all their columns."""
    rows, groups = group(docs, batches)
    k, s, n = tag("id"), tag("sha"), tag("n")
    keep = groups.select(F.col("keep_id").alias(k), F.col("sha").alias(s))
    raw = F.encode(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), "UTF-8")
    out = docs.withColumn(k, F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))).join(keep, k)
    repeated = not rows.groupBy("doc_id").count().where("count > 1").isEmpty()
    if not repeated:
        return out.select(*docs.columns)
    from pyspark.sql import Window

    out = out.where(F.sha2(raw, 256) == F.col(s)).withColumn(n, F.row_number().over(Window.partitionBy(k, s).orderBy(F.lit(0))))
    return out.where(F.col(n) == 1).select(*docs.columns)
