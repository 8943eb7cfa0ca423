"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns VNODES points of a ring; a key belongs to the shard of the next point clockwise. With bounded loads a
shard takes no more than its capacity: what arrives beyond it continues clockwise to the next shard that has room, so
balance is guaranteed and only overflow moves.

The ring is divided into ARCS equal arcs, the resolution at which points lie. One aggregation counts the keys of each
arc (at most ARCS rows reach the driver, whatever the input). Walking the arcs clockwise with the capacities gives, for
each arc, ranges of ranks and the shard they go to; keys are ranked within their arc by (key hash, key), and a key's
slot is the start of its range in the shard plus its rank in the range. So no task ever holds a shard, and equal texts
need not meet: a key's place follows from its id.

Laws: `rows` gives each shard an exact quota, counts at most one apart. `bytes` keeps each shard's bytes
within (1 + slack) times the mean; an arc for which no shard has that much room goes to the emptiest one, so a shard can
pass the bound by less than one arc. `key` has no bound: id and shard count alone decide, and one more
shard takes keys only into itself.

Defined results: a null doc_id hashes as the text's checksum, so that rows without ids are spread (under law `key`, where
the id alone decides, as the empty text); repeated rows each take a place, ranked in any order among
themselves; a null text has size 8 and crc32 0; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

SHARDS = 24
VNODES = 128
ARCS = 1 << 16


@dataclass
class Ring:
    """The points of the ring, in order, and the shard of each."""

    points: list[int]
    owners: list[int]

    @classmethod
    def of(cls, shards: int, vnodes: int = VNODES) -> Ring:
        at = sorted((xxh64_intdigest(f"shard {s} point {v}") % ARCS, s) for s in range(shards) for v in range(vnodes))
        return cls([p for p, _ in at], [s for _, s in at])

    def walk(self, arc: int):
        """The shards clockwise from an arc, each once, the owner first."""
        start, seen = bisect.bisect_left(self.points, arc), set()
        for k in range(len(self.points)):
            s = self.owners[(start + k) % len(self.points)]
            if s not in seen:
                seen.add(s)
                yield s


def arc_of(doc_id: Column, without: Column | None = None) -> Column:
    """The arc of an id; `without` stands for a null one."""
    return F.pmod(F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("") if without is None else without), F.lit(17)), F.lit(ARCS)).cast("int")


def ranges(counts: dict[int, int], ring: Ring, capacity: dict[int, int] | None) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot) of every arc, clockwise; capacity None is no bound."""
    left = dict(capacity) if capacity else None
    filled: dict[int, int] = {}
    out = []
    for arc in sorted(counts):
        n, rank = counts[arc], 0
        for s in ring.walk(arc):
            take = n - rank if left is None else min(n - rank, left.get(s, 0))
            if take:
                out.append((arc, rank, rank + take, s, filled.get(s, 0)))
                filled[s] = filled.get(s, 0) + take
                rank += take
                if left is not None:
                    left[s] -= take
            if rank == n:
                break
        if rank != n:
            raise ValueError("the capacities do not hold all keys")
    return out


def quotas(rows: int, shards: int) -> dict[int, int]:
    return {s: rows // shards + (s < rows % shards) for s in range(shards)}


def _by_bytes(stats: dict[int, tuple[int, int]], ring: Ring, shards: int, slack: float) -> list[tuple[int, int, int, int, int]]:
    """Whole arcs, each to the first shard clockwise that its bytes leave within the bound (the emptiest if none has room)."""
    bound = (1 + slack) * sum(b for _, b in stats.values()) / shards
    used, filled, out = dict.fromkeys(range(shards), 0), dict.fromkeys(range(shards), 0), []
    for arc in sorted(stats):
        n, b = stats[arc]
        s = next((s for s in ring.walk(arc) if used[s] + b <= bound), min(used, key=lambda s: (used[s], s)))
        out.append((arc, 0, n, s, filled[s]))
        used[s] += b
        filled[s] += n
    return out


def shard(docs: DataFrame, shards: int = SHARDS, law: str = "rows", vnodes: int = VNODES, slack: float = 0.05) -> DataFrame:
    """A row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard (law `key`: with one more shard)."""
    spark, ring = docs.sparkSession, Ring.of(shards, vnodes)
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), arc_of(F.col("doc_id"), None if law == "key" else F.concat(F.lit("null/"), F.crc32(raw).cast("string"))).alias("arc"))
    # the counting pass reads ids only, unless bytes are balanced
    stats = {r["arc"]: (r["n"], r["b"]) for r in rows.groupBy("arc").agg(F.count(F.lit(1)).alias("n"), F.sum("size" if law == "bytes" else F.lit(0)).alias("b")).collect()}
    counts = {a: n for a, (n, _) in stats.items()}
    if law == "rows":
        plan = ranges(counts, ring, quotas(sum(counts.values()), shards))
    elif law == "bytes":
        plan = _by_bytes(stats, ring, shards, slack)
    elif law == "key":
        plan = ranges(counts, ring, None)
    else:
        raise ValueError(f"unknown law {law}")
    # every range ends an arc or fills a shard: at most ARCS + shards rows, whatever the input
    if len(plan) > ARCS + shards:
        raise RuntimeError(f"{len(plan)} ranges")
    grown = Ring.of(shards + 1, vnodes)
    table = pd.DataFrame(plan, columns=["arc", "first", "end", "shard", "base"])
    table["grown_shard"] = [next(grown.walk(a)) if law == "key" else None for a in table["arc"]]
    schema = "arc int, first long, end long, shard int, base long, grown_shard int"
    places = spark.createDataFrame(list(table.astype(object).where(table.notna(), None).itertuples(index=False, name=None)), schema)
    rank = F.row_number().over(Window.partitionBy("arc").orderBy(F.xxhash64("doc_id"), "doc_id", "text_crc32", "size")) - 1
    ranked = rows.withColumn("rank", rank.cast("long"))
    out = ranked.join(F.broadcast(places), "arc").where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    return out.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("base") + F.col("rank") - F.col("first")).alias("slot"), "grown_shard")
