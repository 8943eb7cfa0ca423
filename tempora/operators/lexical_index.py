"""A stored lexical index over whole sources: postings bucketed by term, so a query reads its terms' buckets only.

Built once, published by its manifest, then read-only. Words of title and body count; a term's frequency in a source is
capped at TF_CAP. BM25 over all sources: terms in more than max(1, ratio * N) of them are skipped, the average length is
one at least, ties go to the source that was added first.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import lexical_terms
from ..sources.storage import Files
from .retrieval import _bm25

#: Fixed.
TF_CAP = 65_535
FORMAT = "tempora-source-index-1"
BUCKETS = 64


def _bucket(term):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


@dataclass
class SourceIndex:
    spark: SparkSession
    root: str
    n_sources: int
    total_len: int

    @property
    def sources(self) -> DataFrame:
        """ordinal, source_id, title, directory, doc_len, span_ids (in order)."""
        return self.spark.read.parquet(f"{self.root}/sources")

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/postings")

    def spans_of(self, ids: DataFrame) -> DataFrame:
        """source_id, span_ids of the sources that are indexed."""
        return self.sources.join(ids.select("source_id").distinct(), "source_id", "left_semi").select("source_id", "span_ids")

    def directory_of(self, ids: DataFrame) -> DataFrame:
        return self.sources.join(ids.select("source_id").distinct(), "source_id", "left_semi").select("source_id", "directory")

    def in_directory(self, directory: str) -> DataFrame:
        """Sources of a directory in the order in which they were added."""
        return self.sources.where(F.col("directory") == directory).orderBy("ordinal").select("source_id")

    def search(self, text: str, k: int, max_df_ratio: float = 1.0) -> DataFrame:
        """source_id, score, ordinal: the k best sources."""
        terms = sorted({t for t in re.split(r"[\W_]+", text.lower()) if t})
        empty = self.sources.limit(0).select("source_id", F.lit(0.0).alias("score"), "ordinal")
        if k == 0 or not terms or not self.n_sources:
            return empty
        buckets = [r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket("term")).distinct().collect()]
        hit = self.postings.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
        most = max(1.0, min(max(max_df_ratio, 0.0), 1.0) * self.n_sources)
        df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") <= most)
        avg = max(1.0, self.total_len / self.n_sources)
        share = _bm25(F.col("tf"), F.col("df"), F.col("doc_len"), F.lit(float(self.n_sources)), F.lit(avg))
        # at most a row a query term
        scored = hit.join(F.broadcast(df), "term").groupBy("source_id", "ordinal").agg(F.sum(share).alias("score"))
        return scored.orderBy(F.desc("score"), "ordinal").limit(k).select("source_id", "score", "ordinal")


def build(docs: DataFrame, root: str) -> SourceIndex:
    """Index docs (ordinal, source_id, title, directory, body, span_ids). The manifest is written last: an index is there
    whole or not at all. Without a source this is an error."""
    spark, files = docs.sparkSession, Files(docs.sparkSession, root)
    words = lexical_terms(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))))
    staged = f"{root}/staged-{uuid.uuid4().hex}"
    t = docs.select("ordinal", "source_id", "title", "directory", "span_ids", words.alias("t"))
    sources = t.select("ordinal", "source_id", "title", "directory", F.size("t").cast("long").alias("doc_len"), "span_ids")
    sources.write.parquet(f"{staged}/sources")
    stats = spark.read.parquet(f"{staged}/sources").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_len").alias("len")).first()
    if not stats["n"]:
        files_staged = Files(spark, staged)
        files_staged.drop()
        raise ValueError("an index needs a source")
    # counted inside a source's task; only the counts are shuffled, to their bucket
    rows = t.select("ordinal", "source_id", F.size("t").alias("doc_len"), F.explode("t").alias("term")).groupBy("ordinal", "source_id", "doc_len", "term").agg(F.least(F.count(F.lit(1)), F.lit(TF_CAP)).alias("tf"))
    rows.withColumn("bucket", _bucket("term")).repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{staged}/postings")
    files.publish("index.json", json.dumps({"format": FORMAT, "data": staged.rsplit("/", 1)[1], "n": stats["n"], "len": stats["len"]}))
    return open_index(spark, root)


def open_index(spark: SparkSession, root: str) -> SourceIndex:
    files = Files(spark, root)
    if not files.exists("index.json"):
        raise FileNotFoundError(root)
    m = json.loads(files.read("index.json"))
    if m["format"] != FORMAT:
        raise ValueError(f"index format {m['format']}, not {FORMAT}")
    return SourceIndex(spark, f"{root}/{m['data']}", m["n"], m["len"] or 0)
