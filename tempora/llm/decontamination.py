"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A mask over successive words ignores the positions marked 0, so a hash of the others survives substitutions there. The
masks are light enough that every overlap that counts holds a window that agrees under one of them: if no window did,
the runs of equal words between substitutions would have at most 3 words, and of two runs parted by one substitution one
would have at most 1; runs 3, 1, 3, 1, ... are too few words for MIN_SHARE and MIN_WORDS at any length of item.
Every position of every document is hashed under each mask and joined with the benchmark's hashes. Around each hit, the
item is laid along the document (position minus position is constant) and the words that agree are counted over the
whole item: the overlap tolerates substitutions anywhere. An item that overlaps in at least MIN_SHARE of its words (and
in MIN_WORDS of them, or all words of a shorter item) contaminates the document.

The benchmark's hashes, and the ids of documents with hits, are broadcast while there are at most BROADCAST_ROWS of them (which
is counted, so the bytes have a bound); beyond that both sides are shuffled by hash.

Items of fewer than SPAN words, all of which must be equal, use one seed: their whole word sequence, at every position of
the document.

Defined results: null or empty texts and items meet nothing; a null id is carried as null and treated as an id;
repeated rows are found each; empty tables give an empty result; extra columns are ignored by the decisions and kept by
keep_clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, tag

#: Fixed masks, 4 words read; test_every_allowed_pattern_leaves_a_hit holds them against each length of item.
MASKS = ("1111", "11011")
#: The shortest window; one that runs past the end of the text hashes the words that are there.
SPAN = min(map(len, MASKS))
MIN_SHARE = 0.75
MIN_WORDS = 8
BROADCAST_ROWS = 1_000_000


def any_case(col: Column) -> Column:
    """Case folded over all letters; by upper case first, so that ß meets SS. Pure ASCII texts take the fast path."""
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.lower(F.upper(col)))


def words(text: Column, fold=ascii_lower) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of the folded text; the fold of OP5_SQL lower-cases A-Z only."""
    return F.filter(F.split(fold(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _hashes(df: DataFrame, fold, *keep: str) -> DataFrame:
    return df.select(*keep, F.transform(words(F.col("text"), fold), lambda w: F.xxhash64(w)).alias("h"))


def _seeds(h: Column, mask: str, number: int) -> Column:
    """A hash of each window's read positions; windows that a short text cannot fill give none."""
    n = F.size(h) - SPAN + 1
    read = [i for i, c in enumerate(mask) if c == "1"]
    at = lambda i: F.xxhash64(F.lit(number), *[F.get(h, i + k) for k in read])
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(F.array().cast("array<bigint>"))


def _window(n: int):
    """A hash of the n words from a position on."""
    return lambda i: F.xxhash64(*[F.get(F.col("h"), i + k) for k in range(n)])


def item_seeds(benchmark: DataFrame, fold=ascii_lower) -> DataFrame:
    """Rows (seed, item, q, ih): a hash, the item, the position in it and the item's word hashes."""
    items = _hashes(benchmark, fold, F.col("item_id").cast("long").alias("item")).where(F.size("h") > 0).withColumn("ih", F.col("h"))
    long = items.where(F.size("h") >= SPAN)
    parts = [long.select("item", "ih", F.posexplode(_seeds(F.col("h"), m, k)).alias("q", "seed")) for k, m in enumerate(MASKS)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _short_items(benchmark: DataFrame, fold) -> DataFrame:
    return _hashes(benchmark, fold, F.col("item_id").cast("long").alias("item")).where((F.size("h") > 0) & (F.size("h") < SPAN))


def _small(df: DataFrame) -> DataFrame:
    """df marked for broadcast if it has at most BROADCAST_ROWS rows, which is counted; else it is shuffled."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _probes(docs: DataFrame, fold) -> DataFrame:
    """Rows (doc_id, p, seed): every window of every document under every mask, from one pass over the texts."""
    windows = F.size("h") - SPAN + 1
    every = F.concat(*[_seeds(F.col("h"), m, k) for k, m in enumerate(MASKS)])
    out = _hashes(docs, fold, "doc_id").where(windows > 0).select("doc_id", windows.alias("n"), F.posexplode(every).alias("k", "seed"))
    return out.select("doc_id", (F.col("k") % F.col("n")).alias("p"), "seed")


def overlaps(docs: DataFrame, benchmark: DataFrame, fold=ascii_lower) -> DataFrame:
    """Verified overlaps: doc_id, item_id, start (word position of the item's first word in the document), n_words, n_equal."""
    seeds = cut(item_seeds(benchmark, fold).select("seed", "item", "q"), "seeds")
    hits = _probes(docs, fold).join(_small(seeds), "seed").select("doc_id", "item", (F.col("p") - F.col("q")).alias("start")).distinct()
    short = _short_items(benchmark, fold)
    lengths = [r["n"] for r in short.select(F.size("h").alias("n")).distinct().collect()]  # at most SPAN - 1 lengths
    for n in sorted(lengths):
        whole = short.where(F.size("h") == n).select("item", F.xxhash64(*[F.get("h", F.lit(k)) for k in range(n)]).alias("seed"))
        at = F.transform(F.sequence(F.lit(0), F.size("h") - n), _window(n))
        probe = _hashes(docs, fold, "doc_id").where(F.size("h") >= n).select("doc_id", F.posexplode(at).alias("start", "seed"))
        hits = hits.union(probe.join(_small(whole), "seed").select("doc_id", "item", "start").distinct())
    hits = cut(hits, "hits")
    items = _hashes(benchmark, fold, F.col("item_id").cast("long").alias("item")).withColumnRenamed("h", "ih")
    # only documents with a hit are read again for the verification, and only they are hashed; null ids match null ids
    found = hits.groupBy("doc_id").agg(F.collect_set(F.struct("item", "start")).alias("hits")).withColumnRenamed("doc_id", "found_id")
    texts = docs.select("doc_id", "text").join(_small(found), F.col("doc_id").eqNullSafe(F.col("found_id"))).select("doc_id", "hits", "text")
    laid = _hashes(texts, fold, "doc_id", "hits").select("doc_id", F.col("h").alias("dh"), F.explode("hits").alias("x")).select("doc_id", "dh", "x.item", "x.start").alias("l")
    laid = laid.join(_small(items).alias("i"), F.col("l.item").eqNullSafe(F.col("i.item"))).select("l.doc_id", "l.item", "l.start", "l.dh", "i.ih")
    equal = F.size(F.filter(F.sequence(F.lit(0), F.size("ih") - 1), lambda i: (F.col("start") + i >= 0) & (F.get("dh", F.greatest(F.col("start") + i, F.lit(0))) == F.get("ih", i))))
    scored = laid.select("doc_id", F.col("item").alias("item_id"), "start", F.size("ih").alias("n_words"), equal.alias("n_equal"))
    return scored.where((F.col("n_equal") >= MIN_SHARE * F.col("n_words")) & (F.col("n_equal") >= F.least(F.lit(MIN_WORDS), F.col("n_words")))).distinct()


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item in any case of its letters, with all their columns."""
    bad = tag("bad")
    dirty = cut(overlaps(docs, benchmark, any_case).select(F.col("doc_id").alias(bad)).distinct(), "dirty")
    return docs.join(_small(dirty), F.col("doc_id").eqNullSafe(F.col(bad)), "left_anti").select(*docs.columns)
