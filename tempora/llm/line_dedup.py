"""Line dedup over levelled sorted runs of line hashes, in DataFrame operations only.

A line's key is the line without white space [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased; keys of at least MIN_CHARS
code points count. Documents arrive in batches of ascending doc_id. The hashes of each batch are merge-anti-joined with
the sorted runs of the hashes seen so far, run by run: what a run holds belongs to an earlier document and goes; of what
is new, the smallest doc_id of the batch keeps its lines. The batch's new hashes are added as a run of level 0; when a
level holds FAN_IN runs they are merged to one run of the next level, so a batch meets O(FAN_IN * log n) runs. A run is a
table bucketed and sorted by hash, so neither a join nor a merge shuffles or sorts it again.

A hash is two 64-bit hashes of the key (128 bits).

Defined results: a null or empty text is one empty line; a null doc_id counts as the smallest id; rows that share an id
count as one document for what is found elsewhere, and each gets its own row; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut, join_hot, shared_dir

MIN_CHARS = 10
FAN_IN = 4
#: Batches of a run of dedup(): enough for a level to be compacted.
BATCHES = 5
HASH = ["h1", "h2"]
NULL_ID = -(2**63)
SPACE = "\x20\t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return F.trim(ascii_lower(line), F.lit(SPACE))


def _lines(docs: DataFrame) -> DataFrame:
    """A row per line that counts: doc_id, pos, h1, h2."""
    exploded = docs.select("doc_id", F.posexplode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)).alias("pos", "line"))
    keyed = exploded.where(F.length("line") >= MIN_CHARS).select("doc_id", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= MIN_CHARS)
    return keyed.select("doc_id", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


class Runs:
    """The levels of immutable runs; a run is a table (h1, h2) with as many buckets as a shuffle has partitions."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.levels, self.names = spark, [], []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, hashes: DataFrame, level: int) -> str:
        name = f"run{level}_{uuid.uuid4().hex}"
        hashes.repartition(self.buckets, *HASH).write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", f"{shared_dir(self.spark)}/{name}").saveAsTable(name)
        self.names.append(name)
        return name

    def add(self, hashes: DataFrame) -> None:
        run, level = self._write(hashes, 0), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < FAN_IN:
                return
            merged = self.spark.table(self.levels[level][0])
            for other in self.levels[level][1:]:
                merged = merged.union(self.spark.table(other))
            self.levels[level] = []
            level += 1
            run = self._write(merged, level)

    def all(self) -> list[DataFrame]:
        """The runs, the newest first; they hold disjoint sets."""
        return [self.spark.table(name) for level in self.levels for name in reversed(level)]

    def drop(self) -> None:
        """Forget the tables; their files stay with the other intermediate ones."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def dropped_lines(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Rows (doc_id, pos) of the lines that go. docs has a doc_id without nulls."""
    edges: list[int] = []
    if batches > 1:
        edges = sorted(set(docs.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 10_000).alias("q")).first()["q"] or []))
    number = sum((F.when(F.col("doc_id") > e, 1).otherwise(0) for e in edges), F.lit(0))
    # one pass over the texts; each batch then reads its own rows
    lines = cut(_lines(docs).withColumn("batch", number), "lines")
    # combined before the shuffle: a line that every document has is one row a task and batch
    firsts = lines.groupBy("batch", *HASH).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n"))
    firsts = cut(firsts, "firsts")
    runs, repeated = Runs(docs.sparkSession), None
    for k in range(len(edges) + 1):
        first = firsts.where(F.col("batch") == k)
        seen = runs.all()
        new, old = first, None
        for run in seen:
            held = new.join(run, HASH, "left_semi")
            old = held if old is None else old.union(held)
            new = new.join(run, HASH, "left_anti")
        if k < len(edges):
            new = cut(new, "new")
            runs.add(new.select(*HASH))
        part = new.where("low < high").select("batch", *HASH, "low", "n")
        if old is not None:
            part = part.union(old.select("batch", *HASH, F.lit(None).cast("long").alias("low"), "n"))
        part = cut(part, "repeated")
        repeated = part if repeated is None else repeated.union(part)
    runs.drop()
    gone = join_hot(lines, repeated, ["batch", *HASH], "n", lines.count())
    return gone.where(F.col("low").isNull() | (F.col("doc_id") > F.col("low"))).select("doc_id", "pos")


def dedup(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """A row per row of docs: doc_id, n_lines, n_dropped, kept_text."""
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    gone = dropped_lines(base, batches).groupBy("doc_id").agg(F.collect_set("pos").alias("gone"))
    lines = F.split("text", "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    out = base.join(gone, "doc_id", "left")
    return out.select(F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"), F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"))
