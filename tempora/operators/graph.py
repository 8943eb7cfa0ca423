"""Graph: undirected expansion of edges, entity and slot aliases that fail closed when ambiguous."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import canonical_part


def one_hop(edges: DataFrame, seeds: DataFrame, id_col: str = "entity") -> DataFrame:
    """Edges that touch a seed at either end."""
    s = seeds.select(F.col(id_col).alias("_s")).distinct()
    a = edges.join(s, edges["src"] == F.col("_s"), "left_semi")
    b = edges.join(s, edges["dst"] == F.col("_s"), "left_semi")
    return a.union(b).dropDuplicates(["id"])


def expand(edges: DataFrame, seeds: DataFrame, max_depth: int, limit: int | None = None, id_col: str = "entity") -> DataFrame:
    """Each edge once, at the depth where a breadth-first walk first meets it; score = max(confidence, 0) / depth.

    Every hop is two semi joins and two anti joins; the frontier and what was seen are checkpointed, so neither the plan
    nor the driver grows with the depth.
    """
    frontier = seeds.select(F.col(id_col).alias("entity")).distinct()
    seen, found = frontier, None
    for depth in range(1, max_depth + 1):
        left = edges
        if found is not None:
            left = edges.join(found.select("id"), "id", "left_anti")
        hop = one_hop(left, frontier).withColumn("depth", F.lit(depth))
        if edges.sparkSession.sparkContext.getCheckpointDir():
            hop = hop.checkpoint()
        ends = hop.select(F.explode(F.array("src", "dst")).alias("entity")).distinct().join(seen, "entity", "left_anti")
        found = hop if found is None else found.union(hop)
        frontier = ends
        seen = seen.union(ends)
    out = found.withColumn("score", F.greatest(F.coalesce(F.col("confidence"), F.lit(1.0)), F.lit(0.0)) / F.col("depth"))
    return out if limit is None else out.orderBy(F.desc("score"), "depth", "id").limit(limit)


def unambiguous(aliases: DataFrame, key: str, target: str) -> DataFrame:
    """Alias keys with exactly one target."""
    return aliases.groupBy(key).agg(F.min(target).alias(target), F.max(target).alias("_hi")).where(F.col(target) == F.col("_hi")).drop("_hi")


def resolve_entities(claims: DataFrame, aliases: DataFrame, subject: str = "subject") -> DataFrame:
    """Claims with the entity of their subject, null when no alias or more than one entity has that name."""
    registry = unambiguous(aliases.select(canonical_part("alias").alias("alias_key"), "entity_id"), "alias_key", "entity_id")
    return claims.withColumn("alias_key", canonical_part(subject)).join(registry, "alias_key", "left")


def closure(edges: DataFrame, roots: DataFrame, max_hops: int = 8) -> DataFrame:
    """Nodes reached backwards from roots along (src, dst) edges, with the smallest hop."""
    out = roots.select(F.col("node")).distinct().withColumn("hop", F.lit(0))
    frontier = out
    for hop in range(1, max_hops + 1):
        nxt = edges.join(frontier.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).distinct().join(out.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop))
        if edges.sparkSession.sparkContext.getCheckpointDir():
            nxt = nxt.checkpoint()
        if nxt.isEmpty():
            break
        out, frontier = out.union(nxt), nxt
    return out
