"""Near-duplicates by SetSketch: banded registers propose, a joint likelihood estimate screens, full shingle sets decide.

A document's set is its distinct 5-word shingles (words lower-cased in A-Z, split at ASCII white space; fewer words make
one shingle; none make an empty set). A SetSketch keeps, for each of REGISTERS hash functions, the smallest of the
elements' exponential values, truncated to a power of BASE; sketches of parts merge by the maximum. Bands of registers
are the bucket keys.

1. Documents with the same word sequence are collapsed to one representative, whatever their number.
2. In each bucket every member is paired with the bucket's smallest id (a star: as many pairs as rows, no pair within a
   group). The pairs whose joint likelihood estimate is not far below the threshold connect rough clusters.
3. A bucket whose members are in more than one rough cluster may hide plausible pairs that the star did not try. Those
   buckets, and only those, are compared block by block on sketches; a block pair gives edges of a spanning forest at most.
   So the members of any plausible pair that shares a bucket are in one rough cluster.
4. The full sets decide. First every document is compared with one partner, the likeliest of its rough pairs: as many
   comparisons as documents, with the partners of very many salted. What that confirms is merged; a rough cluster that it
   connects is done.
5. Of the other clusters, only pairs of documents that are still apart are compared: the intersections are a product of
   0/1 matrices, computed for two blocks at a time, and a pair of blocks gives the edges of a spanning forest of its links
   at most. A block has at most BLOCK documents and about SHINGLES shingles; a confirmed group that fills blocks of its own
   is never compared with itself; and no row per pair is ever made. Links make the components.

With 32 bands of 4 registers a pair at similarity 0.75 shares no bucket with probability 6e-6, and the estimate is cut
five standard deviations below the threshold.

Defined results: empty sets link with nothing; a null doc_id counts as the smallest id; repeated rows get the same row
each (keep_one leaves one of them), and of rows that share an id but not the text each text may link; an empty table gives an empty result; extra columns are ignored by the decisions and
kept by keep_one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest, xxh3_128_digest

from .common import components, cut, small_batches, tag, trim

WORDS = 5
REGISTERS, BANDS, ROWS = 128, 32, 4
BASE, RATE = 1.001, 20.0
#: 100 * intersection >= PERCENT * union is a link.
PERCENT = 75
#: Five standard deviations of the estimate below the threshold.
FLOOR = PERCENT / 100 - 5 * (PERCENT / 100 * (1 - PERCENT / 100) / REGISTERS) ** 0.5
#: Documents that one task compares with as many others, and their shingles on average.
BLOCK = 256
SHINGLES = 500_000
#: Rows of buckets of one block each that one task takes together, on average.
PACK = 5000
#: Documents that meet one copy of their partner's set.
FAN = 1000
#: Clustered documents up to which their ids are broadcast rather than the texts shuffled.
BROADCAST_ROWS = 500_000
NULL_ID = -(2**63)

_rng = np.random.default_rng(20240607)
_MULT = _rng.integers(0, 2**32, REGISTERS, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, REGISTERS, dtype=np.uint32)
_POWERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def words(text: str | None) -> list[bytes]:
    """bytes.lower() folds A-Z only, bytes.split() splits at 0x09-0x0D and 0x20 only."""
    return (text or "").encode("utf-8", "replace").lower().split()


def shingles(tokens: list[bytes]) -> np.ndarray:
    """The distinct 64-bit hashes of a document's shingles."""
    n = len(tokens)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    if n < WORDS:
        return np.array([xxh64_intdigest(b" ".join(tokens), seed=n)], dtype=np.uint64)
    h = np.fromiter(map(xxh64_intdigest, tokens), dtype=np.uint64, count=n)
    s = np.zeros(n - WORDS + 1, dtype=np.uint64)
    for k in range(WORDS):
        s += h[k : n - WORDS + 1 + k] * _POWERS[k]
        s ^= s >> np.uint64(29)
    return np.unique(s)


def sketch(s: np.ndarray) -> np.ndarray:
    """The SetSketch registers of a non-empty set of hashes, as uint16."""
    x = ((s ^ (s >> np.uint64(32))) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    low = np.full(REGISTERS, 0xFFFFFFFF, dtype=np.uint32)
    for k in range(0, len(x), 1024):
        h = x[k : k + 1024, None] * _MULT
        h += _ADD
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        np.minimum(low, h.min(axis=0), out=low)
    value = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, 65535).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of a union."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Joint maximum likelihood estimate of the Jaccard similarity of each pair of rows, from registers and set sizes."""
    plus, minus = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - plus - minus
    u, v = na / (na + nb), nb / (na + nb)

    def p(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1)

    def likelihood(j: np.ndarray) -> np.ndarray:
        more, less = p(u - v * j), p(v - u * j)
        return plus * np.log(more) + minus * np.log(less) + same * np.log(np.clip(1 - more - less, 1e-12, 1))

    lo, hi = np.zeros(len(a)), np.minimum(u / v, v / u)
    for _ in range(25):  # the likelihood has one maximum
        third = (hi - lo) / 3
        left = likelihood(lo + third) < likelihood(hi - third)
        lo, hi = np.where(left, lo + third, lo), np.where(left, hi, hi - third)
    return (lo + hi) / 2


def _ids(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), "text")


def _profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keys, sizes, regs = [], [], []
        for text in pdf["text"]:
            tokens = words(text)
            s = shingles(tokens)
            keys.append(xxh3_128_digest(b" ".join(tokens)))
            sizes.append(len(s))
            regs.append(sketch(s).tobytes() if len(s) else None)
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "seq": pd.Series(keys, dtype=object), "n": np.array(sizes, dtype=np.int64), "regs": pd.Series(regs, dtype=object)})
    trim()


def _bands(reps: DataFrame) -> DataFrame:
    """BANDS rows (bucket, id) a representative."""
    width = 2 * ROWS
    keys = [F.xxhash64(F.lit(k), F.substring("regs", 1 + width * k, width)) for k in range(BANDS)]
    return reps.select(F.col("rep").alias("id"), F.explode(F.array(*keys)).alias("bucket"))


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for k in range(0, len(pdf), 200):
            part = pdf.iloc[k : k + 200]
            elements = pd.Series([shingles(words(t)).view(np.int64) for t in part["text"]], dtype=object, index=part.index)
            yield part.rename(columns={"doc_id": "id"})[["id", "component", "partner", "salt"]].assign(elements=elements)
    trim()


@F.pandas_udf(T.DoubleType())
def _likeness(ra: pd.Series, rb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
    if not len(ra):
        return pd.Series([], dtype=float)
    a = np.frombuffer(b"".join(ra), dtype=np.uint16).reshape(-1, REGISTERS)
    b = np.frombuffer(b"".join(rb), dtype=np.uint16).reshape(-1, REGISTERS)
    return pd.Series(estimate(a, b, na.to_numpy(float), nb.to_numpy(float)))


#: Else the optimizer copies it into the filter on its result, and each task has it computed twice, by two Python workers.
_likeness = _likeness.asNondeterministic()


def _screen(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches leave a link possible, with the estimate j."""
    left = reps.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    right = reps.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
    near = pairs.join(left, "a").join(right, "b").where(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))
    return near.select("a", "b", _likeness("ra", "rb", "na", "nb").alias("j")).where(F.col("j") >= FLOOR)


class _Forest:
    """Union-find over positions; joins() tells which edges connect two trees."""

    def __init__(self, n: int):
        self.root = list(range(n))

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def joins(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.root[max(a, b)] = min(a, b)
        return a != b


def _forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """A spanning forest of the pairs marked in a matrix, as id pairs (smaller, larger)."""
    forest, out = _Forest(len(left) + (0 if same else len(right))), []
    for i, j in zip(*np.nonzero(linked)):
        if (not same or i < j) and forest.joins(int(i), int(j) if same else len(left) + int(j)):
            out.append((min(left[i], right[j]), max(left[i], right[j])))
    return out


def _common(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """The sizes of all intersections of two lists of sets, exact."""
    if len(left) * len(right) <= 4:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in right] for a in left])
    sizes = [len(x) for x in [*left, *right]]
    value = np.concatenate([*left, *right])
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    order = np.argsort(value, kind="stable")
    value, row = value[order], row[order]
    del order
    column = np.concatenate([[0], np.cumsum(value[1:] != value[:-1], dtype=np.int32)]) if len(value) else value
    del value
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        lo, hi = np.searchsorted(column, [c, c + columns])
        m = np.zeros((len(sizes), columns), dtype=np.float32)
        m[row[lo:hi], column[lo:hi] - c] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out.astype(np.int64)


def _links(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the links between the sets of two blocks whose documents are still apart."""
    right = right.set_axis([c.removeprefix("r_") for c in right.columns], axis=1)
    pairs: list[tuple[int, int]] = []
    if len(left) and len(right):
        a, b = ([np.asarray(x, dtype=np.int64) for x in f["elements"]] for f in (left, right))
        common = _common(a, b)
        total = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None, :] - common
        apart = left["root"].to_numpy()[:, None] != right["root"].to_numpy()[None, :]
        pairs = _forest(apart & (100 * common >= PERCENT * total), left["id"].to_numpy(), right["id"].to_numpy(), False)
    return pd.DataFrame(pairs, columns=["a", "b"]).astype("int64")


def _pairs_of_blocks(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """df (key, block, blocks, ...) twice, so that block i of the first meets block j >= i of the second under (key, i, j)."""
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    rest = [c for c in df.columns if c not in (key, "block", "blocks")]
    left = df.withColumn("other", F.explode(F.filter(others, lambda o: o >= F.col("block")))).select(key, F.col("block").alias("i"), F.col("other").alias("j"), *rest)
    right = df.withColumn("other", F.explode(F.filter(others, lambda o: o <= F.col("block")))).select(key, F.col("other").alias("i"), F.col("block").alias("j"), *rest)
    return left, right.toDF(*[f"r_{c}" for c in right.columns])


def _dealt(df: DataFrame, key: str) -> DataFrame:
    """df with blocks and block: about BLOCK rows of a key are in one block."""
    size = df.groupBy(key).agg(F.count(F.lit(1)).alias("_size"))
    out = df.join(size, key).withColumn("blocks", F.ceil(F.col("_size") / BLOCK).cast("int")).drop("_size")
    return out.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))


def _small(df: DataFrame) -> DataFrame:
    """df marked for broadcast if it has at most BROADCAST_ROWS narrow rows, which is counted; else it is shuffled."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _verify(clusters: DataFrame, rough: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) by full sets that connect what is connected within each cluster (id, component)."""
    partner = rough.groupBy(F.col("b").alias("id")).agg(F.max_by("a", F.struct(F.col("j"), -F.col("a"))).alias("partner"))
    fans = cut(partner.groupBy("partner").agg(F.ceil(F.count(F.lit(1)) / FAN).cast("int").alias("salts")), "fans")
    member = clusters.join(partner, "id", "left").join(_small(fans), "partner", "left")
    salt = F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")
    member = cut(member.select("id", "component", "partner", salt.alias("salt")), "members")
    texts = _ids(docs).join(_small(member.withColumnRenamed("id", "doc_id")), "doc_id")
    sets = cut(texts.mapInPandas(_sets, "id long, component long, partner long, salt int, elements array<long>"), "sets")
    hubs = sets.select(F.col("id").alias("partner"), F.col("elements").alias("others")).join(_small(fans), "partner")
    hubs = hubs.select("partner", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "others")
    common = F.size(F.array_intersect("elements", "others"))
    pairs = sets.where("partner is not null").join(hubs, ["partner", "salt"])
    sure = pairs.where(100 * common >= PERCENT * (F.size("elements") + F.size("others") - common))
    sure = cut(sure.select(F.col("partner").alias("a"), F.col("id").alias("b")), "links")
    roots = member.join(components(sure).withColumnRenamed("component", "root"), "id", "left").select("id", "component", F.coalesce("root", "id").alias("root"))
    roots = cut(roots, "roots")
    apart = roots.groupBy("component").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("component")
    open_ = cut(sets.join(_small(roots.join(apart, "component")), ["id", "component"]).select("id", "component", "root", "elements"), "apart")
    if open_.isEmpty():
        return sure
    left, right = _pairs_apart(open_)
    more = left.groupBy("pair").cogroup(right.groupBy("r_pair")).applyInPandas(_links, "a long, b long")
    return cut(sure.union(more), "links")


def _pairs_apart(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """sets (id, component, root, elements) twice, dealt so that the two blocks of each pair meet under pair and r_pair.

    A root that fills a block has blocks of its own, which are not paired with each other; the small roots of a cluster
    share blocks, which are paired with themselves as well.
    """
    weight = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(F.size("elements")) / SHINGLES)
    roots = sets.groupBy("component", "root").agg(weight.alias("weight"))
    roots = roots.select("component", "root", F.when(F.col("weight") >= 1, F.col("root")).alias("own"), "weight")
    groups = roots.groupBy(F.col("component").alias("g_component"), F.col("own").alias("g_own")).agg(F.ceil(F.sum("weight")).cast("int").alias("blocks"))
    same = (F.col("component") == F.col("g_component")) & F.col("own").eqNullSafe(F.col("g_own"))
    roots = cut(roots.join(groups, same).select("component", "root", "own", "blocks"), "dealt")
    # the documents of a root with blocks of its own are spread by id, small roots are kept together
    number = F.pmod(F.xxhash64(F.when(F.col("own").isNull(), F.col("root")).otherwise(F.col("id"))), F.col("blocks"))
    dealt = sets.join(_small(roots), ["component", "root"]).withColumn("block", F.struct("component", "own", number.alias("k"))).select("id", "root", "elements", F.xxhash64("block.component", "block.own", "block.k", F.col("block.own").isNull()).alias("block"))
    blocks = roots.select("component", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("k")).distinct()
    blocks = blocks.select("component", "own", F.xxhash64("component", "own", "k", F.col("own").isNull()).alias("i"))
    blocks = cut(blocks, "blocks")
    other = blocks.select("component", F.col("own").alias("r_own"), F.col("i").alias("j"))
    met = (F.col("i") <= F.col("j")) & (F.col("own").isNull() & F.col("r_own").isNull() | ~F.col("own").eqNullSafe(F.col("r_own")))
    pairs = cut(blocks.join(other, "component").where(met).select("i", "j", F.xxhash64("i", "j").alias("pair")), "pairs")
    left = dealt.join(pairs.select(F.col("i").alias("block"), "pair"), "block").select("pair", "id", "root", "elements")
    right = dealt.join(pairs.select(F.col("j").alias("block"), "pair"), "block").select("pair", "id", "root", "elements")
    return left, right.toDF(*[f"r_{c}" for c in right.columns])


def _blocks(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the plausible pairs between two blocks of a bucket whose rough clusters differ."""
    right = right.set_axis([c.removeprefix("r_") for c in right.columns], axis=1)
    out: list[tuple[int, int]] = []
    if len(left) and len(right):
        a, b = (np.frombuffer(b"".join(x["regs"]), dtype=np.uint16).reshape(len(x), REGISTERS) for x in (left, right))
        na, nb = left["n"].to_numpy(), right["n"].to_numpy()
        wanted = (left["comp"].to_numpy()[:, None] != right["comp"].to_numpy()[None, :]) & (100 * np.minimum(na[:, None], nb[None, :]) >= PERCENT * np.maximum(na[:, None], nb[None, :]))
        for i in np.flatnonzero(wanted.any(axis=1)):
            j = np.flatnonzero(wanted[i])
            wanted[i] = False
            j = j[(b[j] == a[i]).sum(axis=1) >= REGISTERS * FLOOR * 0.8]
            if len(j):
                wanted[i, j] = estimate(np.repeat(a[i : i + 1], len(j), 0), b[j], np.full(len(j), float(na[i])), nb[j].astype(float)) >= FLOOR
        out = _forest(wanted | wanted.T if key[1] == key[2] else wanted, left["id"].to_numpy(), right["id"].to_numpy(), key[1] == key[2])
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _packed(pdf: pd.DataFrame) -> pd.DataFrame:
    """_blocks() of several buckets, each of one block."""
    parts = [_blocks((0, 0, 0), g, g) for _, g in pdf.groupby("bucket", sort=False)]
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"a": [], "b": []}).astype("int64")


def _residual(buckets: DataFrame, comps: DataFrame, reps: DataFrame) -> DataFrame:
    """Plausible pairs that connect the rough clusters which a bucket's members are in."""
    tagged = buckets.join(comps, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("comp"))
    size = F.count(F.lit(1)).alias("size")
    mixed = tagged.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), size, F.bit_xor(F.xxhash64("id")).alias("who")).where("lo <> hi and size > 2")
    mixed = mixed.groupBy("size", "who", "lo", "hi").agg(F.min("bucket").alias("bucket")).select("bucket")  # the same members are compared once
    member = tagged.join(mixed, "bucket", "left_semi").join(reps.select(F.col("rep").alias("id"), "n", "regs"), "id")
    dealt = cut(_dealt(member, "bucket"), "mixed")
    small = dealt.where("blocks = 1")
    packs = max(1, small.count() // PACK)
    found = small.withColumn("pack", F.pmod(F.xxhash64("bucket"), F.lit(packs))).groupBy("pack").applyInPandas(_packed, "a long, b long")
    left, right = _pairs_of_blocks(dealt.where("blocks > 1"), "bucket")
    large = left.groupBy("bucket", "i", "j").cogroup(right.groupBy("r_bucket", "r_i", "r_j")).applyInPandas(_blocks, "a long, b long")
    return found.union(large).distinct()


def assign(docs: DataFrame) -> DataFrame:
    """A row per row of docs: doc_id, n_shingles, component_id, kept."""
    small_batches(docs.sparkSession)
    profile = cut(_ids(docs).mapInPandas(_profile, "doc_id long, seq binary, n long, regs binary"), "profile")
    groups = profile.where("n > 0").groupBy("seq").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    reps = cut(groups, "reps")
    bands = _bands(reps)
    centre = bands.groupBy("bucket").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = cut(bands.join(centre, "bucket").select("bucket", "id", "low"), "buckets")
    star = buckets.where("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct()
    rough = cut(_screen(star, reps), "rough")
    comps = cut(components(rough.select("a", "b")), "clusters")
    more = cut(_residual(buckets.select("bucket", "id"), comps, reps), "residual")
    if not more.isEmpty():
        rough = rough.union(more.withColumn("j", F.lit(FLOOR)))
        comps = cut(components(rough.select("a", "b")), "clusters")
    comps = components(_verify(comps, rough, docs))
    ranked = reps.select("seq", "rep").join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    low = F.coalesce("component", "rep", "doc_id")
    out = profile.select("doc_id", "seq", "n").join(ranked, "seq", "left")
    return out.select(
        F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif(low, F.lit(NULL_ID)).alias("component_id"), (F.col("doc_id") == low).alias("kept")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, and every document with an empty set; all columns stay."""
    from pyspark.sql import Window

    decided = cut(assign(docs), "near")
    k, n = tag("id"), tag("n")
    kept = decided.where("kept").select(F.coalesce("doc_id", F.lit(NULL_ID)).alias(k)).distinct()
    out = docs.withColumn(k, F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))).join(kept, k)
    if decided.groupBy("doc_id").count().where("count > 1").isEmpty():
        return out.select(*docs.columns)
    return out.withColumn(n, F.row_number().over(Window.partitionBy(k).orderBy(F.lit(0)))).where(F.col(n) == 1).select(*docs.columns)
