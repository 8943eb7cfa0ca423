"""Erasure cascades, stripping of ids, job leases, context packing and retrieval metrics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import SCOPE, clip_to_budget, estimate_tokens, estimate_tokens_py


def citing(df: DataFrame, erased: DataFrame, refs: str) -> DataFrame:
    """Rows that cite an erased id; erased has the column id."""
    e = erased.select(F.col("id").alias("_e")).distinct()
    hit = df.select("id", F.explode(refs).alias("_r")).join(e, F.col("_r") == F.col("_e"), "left_semi").select("id").distinct()
    return df.join(hit, "id", "left_semi")


def strip_ids(df: DataFrame, erased: DataFrame, lists: list[str]) -> DataFrame:
    """Lists without the erased ids; rows whose lists are all empty then go."""
    e = erased.select(F.col("id").alias("_e")).distinct()
    out = df
    for name in lists:
        kept = df.select("id", F.posexplode(name).alias("_p", "_r")).join(e, F.col("_r") == F.col("_e"), "left_anti").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_r"))), lambda s: s["_r"]).alias("_k"))
        out = out.drop(name).join(kept, "id", "left").withColumn(name, F.coalesce("_k", F.array().cast("array<string>"))).drop("_k")
    keep = F.lit(False)
    for name in lists:
        keep = keep | (F.size(name) > 0)
    return out.where(keep)


def leasable(jobs: DataFrame, now_ms: int, max_attempts: int) -> DataFrame:
    """Jobs a worker may take: pending, or leased and expired with attempts left, and no earlier open job of their exact
    scope. The earliest open job of each scope is a minimum, so nothing is compared with anything else."""
    expired = (F.col("status") == "leased") & (F.col("lease_expires_at_ms") <= now_ms)
    j = jobs.withColumn("status", F.when(expired & (F.col("attempt_count") + 1 >= max_attempts), "failed").otherwise(F.col("status")))
    opened = F.col("status").isin("pending", "leased", "failed")
    scope = [c for c in SCOPE if c in jobs.columns]
    first = F.min(F.when(opened, F.struct("sequence_no", "id"))).over(Window.partitionBy(*scope))
    free = (F.col("status") == "pending") | (expired & (F.col("attempt_count") + 1 < max_attempts))
    return j.withColumn("_first", first).where(free & (F.struct("sequence_no", "id") == F.col("_first"))).drop("_first")


def backlog(jobs: DataFrame) -> DataFrame:
    """The open jobs: pending, leased and failed ones."""
    return jobs.where(F.col("status").isin("pending", "leased", "failed")).agg(F.count(F.lit(1)).alias("n_jobs"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.min("created_at_ms").alias("oldest_ms"))


def pack_prefix(items: DataFrame, budget: int, keys: list[str], order: list, text: str = "text") -> DataFrame:
    """The longest prefix of each key's items, in order, whose token estimates fit the budget."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("tokens", estimate_tokens(text)).withColumn("running", F.sum("tokens").over(w)).where(F.col("running") <= budget)


def pack_greedy(items: DataFrame, budget: int, key: str, order: str, text: str = "text") -> DataFrame:
    """Items in order, those that do not fit skipped; if none fits, the first one clipped. One request is one group."""
    out_schema = T.StructType([*items.schema.fields, T.StructField("tokens", T.LongType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, left = [], budget
        pdf = pdf.sort_values(order)
        for r in pdf.to_dict("records"):
            n = estimate_tokens_py(r[text])
            if n <= left:
                rows.append(r | {"tokens": n})
                left -= n
        if not rows and len(pdf):
            r = pdf.iloc[0].to_dict()
            clipped = clip_to_budget(r[text], budget)
            rows.append(r | {text: clipped, "tokens": estimate_tokens_py(clipped)})
        return pd.DataFrame(rows, columns=[f.name for f in out_schema.fields])

    return items.groupBy(key).applyInPandas(run, out_schema)


def metrics(hits: DataFrame, relevant: DataFrame, k: int, stale: DataFrame | None = None) -> DataFrame:
    """recall, reciprocal rank and nDCG of the top k of each query, and the share of inadmissible hits.

    hits: query, id, rank from 0; relevant and stale: query, id.
    """
    top = hits.where(F.col("rank") < k).dropDuplicates(["query", "id"])
    rel = relevant.select("query", "id").distinct().withColumn("rel", F.lit(1))
    j = top.join(rel, ["query", "id"], "left")
    if stale is not None:
        j = j.join(stale.select("query", "id").distinct().withColumn("bad", F.lit(1)), ["query", "id"], "left")
    else:
        j = j.withColumn("bad", F.lit(None).cast("int"))
    gain = F.when(F.col("rel") == 1, 1 / F.log2(F.col("rank") + 2.0)).otherwise(0.0)
    per = j.groupBy("query").agg(F.count(F.lit(1)).alias("inspected"), F.sum(F.coalesce("rel", F.lit(0))).alias("found"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"), F.sum(gain).alias("dcg"), F.sum(F.coalesce("bad", F.lit(0))).alias("bad"))
    want = rel.groupBy("query").agg(F.count(F.lit(1)).alias("n_rel"))
    out = want.join(per, "query", "left")
    ideal = F.aggregate(F.sequence(F.lit(0), F.least(F.col("n_rel"), F.lit(k)).cast("int") - 1), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 2.0))
    return out.select("query", (F.coalesce("found", F.lit(0)) / F.col("n_rel")).alias("recall"), F.coalesce(1 / (F.col("first") + 1), F.lit(0.0)).alias("reciprocal_rank"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"), F.coalesce(F.col("bad") / F.col("inspected"), F.lit(0.0)).alias("stale_rate"))


def quotes_found(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """Whether each quote is a substring of the text that it cites. quotes: id, text_id, quote; texts: text_id, text."""
    return quotes.join(texts, "text_id", "left").select("id", F.coalesce(F.col("text").contains(F.col("quote")), F.lit(False)).alias("found"))
