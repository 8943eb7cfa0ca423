"""Source-diverse retrieval: rankings of spans and of whole sources fused by source, each source filled up with the
neighbours of its hits and its leading spans, then taken in turn.

A plan is one row a source: plan_rank, source_id, score, hits (array of (id, score), at most a cap), fill_ids (array).
The rows are as many as the sources asked for; lists are array columns, so a plan is made without a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import mask_values, rrf_share
from .retrieval import bm25, ranked, rrf

HIT = "array<struct<id:string,score:double,span_index:int>>"


def by_source(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ranked hits (id, source_id, span_index, score, rank) as (source_id, hits in rank order, each id once) and
    (source_id, rank): sources in the order of their first hit."""
    once = hits.groupBy("source_id", "id").agg(F.min(F.struct("rank", "score", "span_index")).alias("h"))
    hit = F.struct("h.rank", F.struct("id", F.col("h.score").cast("double").alias("score"), F.col("h.span_index").cast("int").alias("span_index")).alias("hit"))
    lists = once.groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(hit)), lambda x: x["hit"]).alias("hits"), F.min("h.rank").alias("_best"))
    order = lists.select("source_id", (F.row_number().over(Window.orderBy("_best")) - 1).alias("rank"))  # as many rows as hits
    return lists.drop("_best"), order


def fuse_sources(rankings: list[tuple[DataFrame, float]], k: int, exclude: DataFrame | None = None) -> DataFrame:
    """source_id, score, plan_rank: the k best by reciprocal ranks (source_id, rank) with weights; ties by id."""
    parts = [df.select("source_id", rrf_share(F.col("rank"), w).alias("share")) for df, w in rankings]
    fused = reduce(lambda a, b: a.union(b), parts).groupBy("source_id").agg(F.sum("share").alias("score"))
    if exclude is not None:
        fused = fused.join(exclude.select("source_id"), "source_id", "left_anti")
    best = fused.orderBy(F.desc("score"), "source_id").limit(k)
    return best.withColumn("plan_rank", F.row_number().over(Window.orderBy(F.desc("score"), "source_id")) - 1)


def fill_ids(hits: Column, span_ids: Column, cap: Column, radius: int | None) -> Column:
    """Ids that bring a source's hits up to the cap: for each hit +1, -1, +2, ... (not below 0) to the radius, then
    the leading spans; what is there already is left out. Without a radius, leading spans only."""
    leading = F.when(F.least(F.size(span_ids), cap) > 0, F.sequence(F.lit(0), F.least(F.size(span_ids), cap) - 1)).otherwise(F.array().cast("array<int>"))
    if radius is None:
        leading = F.when(F.size(span_ids) > 0, F.sequence(F.lit(0), F.size(span_ids) - 1)).otherwise(F.array().cast("array<int>"))
    places = leading
    if radius:
        steps = lambda h: F.flatten(F.transform(F.sequence(F.lit(1), F.lit(radius)), lambda d: F.array(F.greatest(h["span_index"], F.lit(0)) + d, F.greatest(h["span_index"] - d, F.lit(0)))))
        places = F.concat(F.flatten(F.transform(hits, steps)), leading)
    ids = F.filter(F.transform(places, lambda i: F.get(span_ids, i)), lambda x: x.isNotNull())
    fresh = F.array_except(F.array_distinct(ids), F.transform(hits, lambda h: h["id"]))
    return F.slice(fresh, F.lit(1), F.greatest(cap - F.size(hits), F.lit(0)))


def plans(chosen: DataFrame, lists: DataFrame, registry: DataFrame, cap: int, radius: int | None) -> DataFrame:
    """Plans of chosen sources (source_id, score, plan_rank), their hits cut to the cap and filled from the registry
    (source_id, span_ids)."""
    j = chosen.join(lists, "source_id", "left").join(registry, "source_id", "left")
    hits = F.slice(F.coalesce("hits", F.array().cast(HIT)), 1, cap)
    ids = F.coalesce("span_ids", F.array().cast("array<string>"))
    return j.withColumn("hits", hits).withColumn("fill_ids", fill_ids(F.col("hits"), ids, F.lit(cap), radius)).select("plan_rank", "source_id", "score", "hits", "fill_ids")


def hydrate(made: DataFrame, spans: DataFrame, max_rank: int, once: bool = True) -> DataFrame:
    """Each plan's hits and those of its fills that are among `spans` (id, ...), scored with the plan's score,
    taken in turn: rank_in_source, then plan. With `once` a fill is placed in the first plan that asks for it."""
    hit = F.transform("hits", lambda h: F.struct(h["id"].alias("id"), h["score"].alias("score"), F.lit(False).alias("fill")))
    fill = F.transform("fill_ids", lambda x: F.struct(x.alias("id"), F.col("score").cast("double").alias("score"), F.lit(True).alias("fill")))
    rows = made.select("plan_rank", F.posexplode(F.concat(hit, fill)).alias("pos", "x")).select("plan_rank", "pos", "x.id", "x.score", "x.fill")
    if once:
        first = F.row_number().over(Window.partitionBy("id", "fill").orderBy("plan_rank", "pos"))
        rows = rows.withColumn("_n", first).where("not fill or _n = 1").drop("_n")
    found = rows.join(spans.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").where("not fill or _id is not null").drop("_id")
    place = F.row_number().over(Window.partitionBy("plan_rank").orderBy("pos"))
    return found.withColumn("rank_in_source", place).where(F.col("rank_in_source") <= max_rank).drop("pos", "fill").orderBy("rank_in_source", "plan_rank")


def masked(hits: DataFrame, values: list[str], text: str = "text") -> DataFrame:
    """Hits with the forgotten values hidden."""
    return hits.withColumn(text, mask_values(text, values))


def source_diverse_search(
    dense: DataFrame,
    lexical: list[tuple[DataFrame, float]],
    registry: DataFrame,
    spans: DataFrame,
    *,
    max_sources: int,
    spans_per_source: int,
    radius: int = 1,
    supplemental: list[DataFrame] | None = None,
    supplemental_dense: list[DataFrame] | None = None,
    supplemental_sources: int = 0,
    supplemental_spans: int = 0,
) -> DataFrame:
    """Dense span hits and lexical source rankings (each with its weight) fused by source; then, if there are
    supplemental rankings, a round that leaves out the sources already chosen and takes leading spans only (R7c)."""
    if not max_sources or not spans_per_source:
        return hydrate(plans(fuse_sources([(by_source(dense)[1], 1.0)], 0), by_source(dense)[0], registry, 1, radius), spans, 0)
    lists, order = by_source(dense)
    chosen = fuse_sources([(order, 1.0), *lexical], max_sources)
    made, cap = plans(chosen, lists, registry, spans_per_source, radius), spans_per_source
    if supplemental and supplemental_sources and supplemental_spans:
        rankings = [(df, 1.0) for df in supplemental]
        more = None
        for hits in supplemental_dense or []:
            rankings.append((by_source(hits)[1], 1.0))
            more = hits if more is None else more.withColumn("rank", F.col("rank")).union(hits.withColumn("rank", F.col("rank") + F.lit(1 << 20)))
        extra = fuse_sources(rankings, supplemental_sources, exclude=chosen).withColumn("plan_rank", F.col("plan_rank") + max_sources)
        their = by_source(more)[0] if more is not None else lists.limit(0)
        made, cap = made.union(plans(extra, their, registry, supplemental_spans, None)), max(cap, supplemental_spans)
    return hydrate(made, spans, cap)


def hydrate_selected(selections: DataFrame, prior: DataFrame, registry: DataFrame, spans: DataFrame) -> DataFrame:
    """Selections (plan_rank, source_id, max_spans): their prior hits, the neighbours of these at one step, leading spans."""
    lists, _ = by_source(prior)
    j = selections.join(lists, "source_id", "left").join(registry, "source_id", "left")
    cap = F.col("max_spans").cast("int")
    hits = F.slice(F.coalesce("hits", F.array().cast(HIT)), F.lit(1), F.greatest(cap, F.lit(0)))
    ids = F.coalesce("span_ids", F.array().cast("array<string>"))
    j = j.withColumn("hits", hits)
    j = j.withColumn("score", F.coalesce(F.get("hits", F.lit(0))["score"], F.lit(0.0))).withColumn("fill_ids", F.when(F.col("span_ids").isNull(), F.array().cast("array<string>")).otherwise(fill_ids(F.col("hits"), ids, cap, 1)))
    return hydrate(j.select("plan_rank", "source_id", "score", "hits", "fill_ids"), spans, 2**31 - 1, once=False)


def search_selected(selections: DataFrame, query: str, dense: DataFrame, registry: DataFrame, spans: DataFrame) -> DataFrame:
    """BM25 over the spans of the selected sources fused with the dense hits among them, then hydrated.

    spans: id, source_id, span_index, text of what may be shown; dense: id, rank.
    """
    inside = spans.join(selections.where("max_spans > 0").select("source_id").distinct(), "source_id", "left_semi")
    words = bm25(inside, query, None)
    words = words.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1)  # spans of the selected sources
    kept = dense.select("id", "rank").join(inside.select("id"), "id", "left_semi")
    kept = kept.select("id", (F.row_number().over(Window.orderBy("rank")) - 1).alias("rank"))
    fused = rrf([(kept, 1.0), (words.select("id", "rank"), 1.0)], 2**31 - 1)
    prior = ranked(fused, F.desc("score"), F.col("id")).join(inside.select("id", "source_id", "span_index"), "id")
    return hydrate_selected(selections, prior, registry, spans)
