"""Retrieval: exact vector top-k, BM25 over three corpora, rank fusion, source diversity, neighbours, span corrections."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import WORD_CHARS, cosine_distance, lexical_terms, neighbor_score, rrf_share
from .claims import EXCLUDES, IGNORED, selector_join
from .predicates import correction_active, span_active

K1, B = 1.2, 0.75
#: Fixed: candidates that a vector search keeps before corrections.
OVERFETCH, MAX_FETCH = 8, 1024
COMMON_TERM_ROWS = 50


def fetch_k(k: int) -> int:
    return min(OVERFETCH * k, MAX_FETCH)


def vector_top_k(spans: DataFrame, query: list[float], k: int, *, id_col: str = "id", vector: str = "embedding", tie: str | list[str] = "seq") -> DataFrame:
    """Exact cosine top-k: score is the distance, ties by storage order. TakeOrderedAndProject keeps k rows a task."""
    vec = F.array(*[F.lit(float(x)) for x in query])
    return spans.where(F.col(vector).isNotNull() & (F.size(vector) == len(query))).withColumn("score", cosine_distance(F.col(vector), vec)).orderBy("score", *([tie] if isinstance(tie, str) else tie)).limit(k)


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """A top-k result with its 0-based rank. The one-partition window holds k rows only, so df must be a limit."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)


def postings(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, term, tf, dl): counted inside the row, so nothing is shuffled."""
    d = docs.select(id_col, lexical_terms(text).alias("_t")).withColumn("dl", F.size("_t"))
    out = d.select(id_col, "dl", F.explode(F.transform(F.array_distinct("_t"), lambda w: F.struct(w.alias("term"), F.size(F.filter("_t", lambda x: x == w)).alias("tf")))).alias("p"))
    return out.select(id_col, "dl", "p.term", "p.tf")


def term_stats(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Document frequency and total count of each term, in one aggregation: a text gives its words and, after them, its
    different words once more."""
    t = docs.select(lexical_terms(text).alias("_t"))
    t = t.select(F.size("_t").alias("_n"), F.posexplode(F.concat("_t", F.array_distinct("_t"))).alias("_p", "term"))
    return t.groupBy("term").agg(F.count_if(F.col("_p") >= F.col("_n")).alias("df"), F.count_if(F.col("_p") < F.col("_n")).alias("cf"))


def query_postings(docs: DataFrame, terms: list[str], id_col: str, text: str, keep: list[str] | None = None) -> DataFrame:
    """(id, dl, tf_0..tf_n) of every document: only the query's terms are counted, in one narrow pass.

    The counts come out of a generator, so a filter on them is not pushed below and does not count the words again.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    edge = "[" + WORD_CHARS + "]"
    dl = F.regexp_count(low, F.lit(f"{edge}+"))
    # most texts lack a rare word: a plain search comes before the pattern
    count = lambda w: F.when(low.contains(w), F.regexp_count(low, F.lit(f"(?<!{edge}){re.escape(w)}(?!{edge})"))).otherwise(0)
    one = F.struct(dl.alias("dl"), *[count(w).alias(f"tf_{i}") for i, w in enumerate(terms)])
    return docs.select(id_col, *(keep or []), F.inline(F.array(one)))


def _bm25(tf: Column, df: Column, dl: Column, n: Column, avg: Column) -> Column:
    idf = F.log((n - df + 0.5) / (df + 0.5) + 1)
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avg))


def bm25(docs: DataFrame, query: str, k: int | None, *, id_col: str = "id", text: str = "text", corpus: str = "all", max_df_ratio: float | None = None) -> DataFrame:
    """BM25 with the corpus statistics of all documents, of matching ones, or of all with frequent terms skipped.

    corpus `all`: documents with a term; `matched`: documents that hold a query term; `sources`: all, where terms in more
    than max(1, max_df_ratio * N) documents are skipped and the average length is one at least.
    """
    terms = list(dict.fromkeys(t for t in re.split(r"[\W_]+", query.lower()) if t))
    counts = query_postings(docs, terms, id_col, text)
    tfs = [F.col(f"tf_{i}") for i in range(len(terms))]
    hit = reduce(lambda a, b: a + b, tfs) > 0
    base = counts if corpus == "sources" else counts.where(hit if corpus == "matched" else F.col("dl") > 0)
    # one row of statistics: a broadcast of a handful of numbers
    stats = base.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avg"), *[F.sum(F.when(t > 0, 1).otherwise(0)).alias(f"df_{i}") for i, t in enumerate(tfs)])
    joined = counts.where(hit).crossJoin(F.broadcast(stats))
    avg = F.greatest(F.col("avg"), F.lit(1.0)) if corpus == "sources" else F.col("avg")
    parts = []
    for i, t in enumerate(tfs):
        df = F.col(f"df_{i}")
        use = t > 0 if max_df_ratio is None else (t > 0) & (df <= F.greatest(F.lit(1.0), F.col("n") * max_df_ratio))
        parts.append(F.when(use, _bm25(t, df, F.col("dl"), F.col("n"), avg)).otherwise(0.0))
    out = joined.select(id_col, reduce(lambda a, b: a + b, parts).alias("score")).where("score > 0")
    return out if k is None else out.orderBy(F.desc("score"), id_col).limit(k)


def rrf(lists: list[tuple[DataFrame, float]], k: int, id_col: str = "id") -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (id, rank from 0) with weights."""
    parts = [df.select(id_col, rrf_share(F.col("rank"), w).alias("share")) for df, w in lists]
    return reduce(lambda a, b: a.union(b), parts).groupBy(id_col).agg(F.sum("share").alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def source_diverse(hits: DataFrame, max_sources: int, per_source: int, *, source: str = "source_id", order: list[Column]) -> DataFrame:
    """Hits grouped by source, sources in the order of their best hit, taken round-robin by rank within the source."""
    w = Window.partitionBy(source).orderBy(*order)
    inside = hits.withColumn("rank_in_source", F.row_number().over(w)).where(F.col("rank_in_source") <= per_source)
    best = inside.where("rank_in_source = 1").orderBy(*order).limit(max_sources)
    best = best.withColumn("source_rank", F.row_number().over(Window.orderBy(*order))).select(source, "source_rank")
    return inside.join(F.broadcast(best), source).orderBy("rank_in_source", "source_rank")


def neighbors(hits: DataFrame, spans: DataFrame, before: int, after: int) -> DataFrame:
    """Spans of a hit's source within [index - before, index + after]; each once, for its first hit. hits has source_id,
    span_index, rank and score. The band is expanded to exact indexes, so the join is an equi join."""
    band = hits.select("source_id", F.col("span_index").alias("hit_index"), "rank", "score", F.explode(F.sequence(F.col("span_index") - before, F.col("span_index") + after)).alias("span_index"))
    out = band.join(spans, ["source_id", "span_index"])
    w = Window.partitionBy("source_id", "span_index").orderBy("rank")
    out = out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return out.withColumn("score", neighbor_score(F.col("score"), F.col("span_index") - F.col("hit_index")))


def span_exclusions(hits: DataFrame, corrections: DataFrame, at: int | None = None, text: str = "text") -> DataFrame:
    """Hits that no correction excludes: the last effect by (effective time, id) decides; restore clears it."""
    cor = corrections.where(correction_active(at) & (F.col("target_type") == "span") & ~F.col("operation").isin(*IGNORED)).select("id", "operation", "effective_at_ms", "target_ids", "target_selector").alias("c")
    h = hits.select("id", text).alias("h")
    named = cor.withColumn("target", F.explode("target_ids")).alias("c").join(h, F.col("c.target") == F.col("h.id")).select(F.col("h.id").alias("span"), "c.operation", "c.effective_at_ms", F.col("c.id").alias("cid"))
    selectors = cor.select("operation", "effective_at_ms", F.col("id").alias("cid"), "target_selector")
    chosen = selector_join(hits.select(F.col("id").alias("span"), text), selectors, "target_selector", text).select("span", "operation", "effective_at_ms", "cid")
    last = named.union(chosen).groupBy("span").agg(F.max_by("operation", F.struct("effective_at_ms", "cid")).alias("operation"))
    return hits.join(last.where(F.col("operation").isin(*EXCLUDES)), hits["id"] == F.col("span"), "left_anti")


def rare_terms(states: DataFrame, terms: list[str], limit: int = COMMON_TERM_ROWS) -> DataFrame:
    """States that share a query term which at most `limit` stored rows have. states has id and lexical_terms."""
    t = states.select("id", F.explode(F.array_distinct("lexical_terms")).alias("term")).where(F.col("term").isin(*terms))
    rare = t.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= limit).select("term")
    return t.join(rare, "term", "left_semi").select("id").distinct()


def live(spans: DataFrame, at: int | None = None) -> DataFrame:
    return spans.where(span_active(at))


def mean_embedding(pairs: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """The L2-normalised mean of the vectors of each key; a zero mean is dropped. Averages combine before the shuffle."""
    out = pairs.select(key, F.posexplode(vector).alias("pos", "x")).groupBy(key, "pos").agg(F.avg("x").alias("x")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"))
    out = out.withColumn("v", F.transform("v", lambda s: s["x"]))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return out.withColumn("_n", norm).where("_n > 0").select(key, F.transform("v", lambda x: x / F.col("_n")).alias(vector))
