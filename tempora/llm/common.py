"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: One fold in five is held out from everything that is learned.
FOLDS = 5


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint directory. Where it is unset, a local session
    gets a folder of its own; a cluster does not, as a folder of the driver alone would not be shared."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tempora-"))
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys that may be called hot: those of more than a ten-thousandth of all rows, so there are at most so many.
HOT_KEYS = 10_000


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner join of rows with a table of one row a key, where column `size` says how many rows a key has.

    The rows of hot keys meet their key by broadcast, of at most HOT_KEYS rows, and stay where they are; the others are
    shuffled. So no key brings its rows into one task, and none is left out.
    """
    hot = F.col(size) > total / HOT_KEYS
    top = F.broadcast(table.where(hot))
    rest = rows.join(F.broadcast(table.where(hot).select(*keys)), keys, "left_anti").join(table.where(~hot), keys)
    out = rows.join(top, keys)
    return out.union(rest.select(out.columns))


def small_batches(spark: SparkSession, rows: int = 2000, size: int = 8 << 20) -> None:
    """Bound the Arrow batches that Python workers hold: long texts would make batches of the default row count large."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", min(rows, int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


#: What operators keep in this Python worker between tasks: by the operator's name, the function that lets it go.
KEPT: dict[str, Callable[[], None]] = {}


def trim(keep: str | None = None) -> None:
    """Give freed memory back to the system at the end of a task: a Python worker stays for the stages to come. What
    other operators than `keep` have kept for their next tasks goes too."""
    import ctypes
    import gc

    for name in KEPT.keys() - {keep}:
        KEPT.pop(name)()
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def held_out(doc_id: Column | str) -> Column:
    """True for documents whose crc32(doc_id as text) is a multiple of FOLDS; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.encode(F.coalesce(col.cast("string"), F.lit("")), "UTF-8")) % FOLDS == 0


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII texts take the fast path."""
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tag(prefix: str = "t") -> str:
    """A column name that no input has."""
    return f"__{prefix}_{uuid.uuid4().hex[:8]}"


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a long, b long): rows (id, component), the smallest id of each component, for ids in edges only.

    Large-star and small-star steps alternate until nothing changes. Every step is a min per key and a join on that
    key, so a node with many neighbours is combined before the shuffle and its join partition can be split.
    """
    shared_dir(edges.sparkSession)
    cur = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct().checkpoint()
    seen = None
    for _ in range(max_rounds):
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        nxt = small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct().checkpoint()
        state = tuple(nxt.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        cur = nxt
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not converge")
    return cur.select(F.col("u").alias("id"), F.col("v").alias("component")).union(cur.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
