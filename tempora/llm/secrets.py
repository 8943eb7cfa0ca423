"""Secret scans: candidate words by shape and context, false positives removed by a random forest, no Python on the rows.

A candidate is a word of a text (between ASCII white space) that carries digits in a long run of token characters, or is
the value of an assignment to a credential's name, of any length and with or without digits, or follows the head of a
private key. Its features are its length, the share of changes between character classes, how likely its letters follow
each other in the corpus, the shares of digits, capitals and distinct characters, how much of it words of the corpus
cover, the words around it and the path of the document. No feature tells an issued key by its format: formats only name
the kind of a finding. The dictionary (words of at least MIN_COUNT occurrences) and the letter transitions are counted
over all documents.

A random forest of Spark ML scores the candidates; it is trained on labelled findings, by default those that
training_findings() makes by rule from the corpus's words: credentials of several makes and lookalikes (checksums,
commit ids, UUIDs, addresses, placeholders, identifiers, plain words) with the words around them.

Everything on the main path is a DataFrame or SQL expression, or a Spark ML transformer.

Defined results: null and empty texts have no findings; a null path has no hint; very long texts are read whole, a word of
any length is one candidate; a score of exactly the threshold is a secret; repeated rows are scanned each; an empty table
gives an empty result; extra columns, whatever their names, are ignored. The secret itself is never returned, only its
SHA-256.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_hot

CREDENTIAL = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|bearer|credential|private[_-]?key)"
HARMLESS = r"(?i)(commit|sha-?\d*|md5|checksum|digest|hash|etag|uuid|guid|revision|isbn|version|build|session_count|page|photo|order)"
EXAMPLE_PATH = r"(?i)(test|example|mock|fixture|sample|demo|doc)"
#: Public formats of issued keys.
KNOWN = r"^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{20,}$|^sk_(live|test)_[A-Za-z0-9]{16,}$|^xox[abprs]-[A-Za-z0-9-]{10,}$|^AIza[A-Za-z0-9_-]{30,}$|^eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"
KEY_HEAD = r"KEY-----$"
FEATURES = ["length", "transitions", "letters", "digits", "capitals", "variety", "coverage", "hex", "address", "uuid", "dotted", "assigned", "named", "near_credential", "near_harmless", "example_path"]
#: A word of the dictionary occurs so often in the corpus.
MIN_COUNT = 5
#: Words of the dictionary that the training findings are made of.
VOCABULARY = 300
#: Characters of the transition model: a to z, and one place for all others.
LETTERS = 27
SEED = 7


@dataclass
class Corpus:
    """What is counted over all documents: the dictionary (word, n), and log probabilities of a letter after a letter."""

    dictionary: DataFrame
    after: list[float]

    @property
    def common(self) -> list[str]:
        """Its most frequent words, at most VOCABULARY."""
        return [r["word"] for r in self.dictionary.where("length(word) between 3 and 12").orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()]


def _letter(c: Column) -> Column:
    n = F.ascii(c) - 97
    return F.when((n >= 0) & (n < LETTERS - 1), n).otherwise(LETTERS - 1)


def corpus(docs: DataFrame) -> Corpus:
    """The dictionary and the transitions of all documents; at most LETTERS squared numbers reach the driver."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), 1)).alias("word"))
    dictionary = cut(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_COUNT), "dictionary")
    pairs = dictionary.select("n", "word", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("i"))
    place = _letter(F.expr("substring(word, i, 1)")) * LETTERS + _letter(F.expr("substring(word, i + 1, 1)"))
    counts = {r["place"]: r["n"] for r in pairs.groupBy(place.alias("place")).agg(F.sum("n").alias("n")).collect()}
    after = []
    for a in range(LETTERS):
        total = sum(counts.get(a * LETTERS + b, 0) for b in range(LETTERS))
        after += [math.log((counts.get(a * LETTERS + b, 0) + 1) / (total + LETTERS)) for b in range(LETTERS)]
    return Corpus(dictionary, after)


def _share(value: Column, pattern: str) -> Column:
    """The share of a value's characters in a class."""
    n = F.length(value)
    return F.when(n > 0, 1 - F.length(F.regexp_replace(value, pattern, "")) / n).otherwise(0.0)


def candidates(docs: DataFrame, path: str | None = "source") -> DataFrame:
    """Rows doc_id, word_index, word, before2, before, after, path of every candidate in the whole texts."""
    where = F.col(path) if path and path in docs.columns else F.lit(None)
    # a candidate has a digit, a credential's name or the head of a key near it: a text with none of them is never split
    likely = F.col("text").rlike("[0-9]") | F.col("text").rlike(CREDENTIAL) | F.col("text").contains("KEY-----")
    words = F.split("text", r"[\x20\x09-\x0D]+")
    split = docs.where(likely).select("doc_id", where.cast("string").alias("path"), words.alias("w"))
    shape = lambda w: (F.length(w) >= 8) & w.rlike(r"[0-9]") & w.rlike(r"[A-Za-z0-9+/_-]{14,}")
    nth = lambda i: F.when(i >= 0, F.get("w", F.greatest(i, F.lit(0)))).otherwise("")

    def assigned(i: Column) -> Column:
        """The word, or the words before it as features() reads them, assign to a credential's name."""
        own = F.get("w", i).rlike(CREDENTIAL + r"[\w-]*[\"']?[=:]+[^=:]")
        before = (nth(i - 1).rlike("[=:]$") & nth(i - 1).rlike(CREDENTIAL)) | (nth(i - 1).rlike("^[=:]+$") & nth(i - 2).rlike(CREDENTIAL)) | nth(i - 1).rlike(KEY_HEAD)
        return own | (before & F.get("w", i).rlike("[^=:]"))

    split = split.select("doc_id", "path", "w", F.explode(F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: shape(F.get("w", i)) | assigned(i))).alias("word_index"))
    at = lambda k: F.coalesce(F.get("w", F.col("word_index") + k), F.lit(""))
    back = lambda k: F.when(F.col("word_index") >= k, F.get("w", F.greatest(F.col("word_index") - k, F.lit(0)))).otherwise("")
    return split.select("doc_id", "word_index", at(0).alias("word"), back(2).alias("before2"), back(1).alias("before"), at(1).alias("after"), "path")


def _values(found: DataFrame) -> DataFrame:
    """The candidates with name and value: what is assigned, without its quotes and the punctuation after it."""
    out = found.withColumn("name", F.regexp_extract("word", r"^[\"'({\[]*([A-Za-z][\w-]*)[\"']?[=:]", 1))
    return out.withColumn("value", F.regexp_replace(F.regexp_replace("word", r"^[\"'({\[]*(?:[A-Za-z][\w-]*[\"']?[=:])?[\"'({\[<]*", ""), r"[\"')}\]>;,.!?]+$", ""))


def _coverage(values: DataFrame, dictionary: DataFrame) -> DataFrame:
    """value, n (rows that have it) and coverage: the share of its letters that are in words of the dictionary."""
    each = values.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    runs = each.select("value", F.explode(F.regexp_extract_all(F.lower("value"), F.lit("([a-z]{3,})"), 1)).alias("word"))
    known = runs.join(dictionary.select("word", F.lit(True).alias("known")), "word", "left")
    size = F.length("word")
    share = known.groupBy("value").agg((F.sum(F.when(F.col("known"), size).otherwise(0)) / F.sum(size)).alias("coverage"))
    return each.join(share, "value", "left").select("value", "n", F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def features(found: DataFrame, known: Corpus) -> DataFrame:
    """The candidates with name, value and the columns of FEATURES."""
    out = cut(_values(found), "values")
    out = join_hot(out, cut(_coverage(out, known.dictionary), "coverage"), ["value"], "n", out.count()).drop("n")
    v = F.col("value")
    assigned = (F.col("name") != "") | F.col("before").rlike(r"[=:]$")
    named = F.when(F.col("name") != "", F.col("name")).when(F.col("before").rlike(r"^[=:]+$"), F.col("before2")).when(F.col("before").rlike(r"[=:]$"), F.col("before")).when(F.col("before").rlike(KEY_HEAD), F.lit("private_key")).otherwise("")
    context = F.concat_ws(" ", "before2", "before", "after")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[a-z]+", "a"), "[A-Z]+", "B"), "[0-9]+", "1")
    size = F.greatest(F.length(v), F.lit(1))
    after = F.array(*[F.lit(x) for x in known.after])
    low = F.lower(v)
    pair = lambda i: F.get(after, _letter(F.substring(low, i, F.lit(1))) * LETTERS + _letter(F.substring(low, i + 1, F.lit(1))))
    pairs = F.when(F.length(v) > 1, F.aggregate(F.transform(F.sequence(F.lit(1), F.length(v) - 1), pair), F.lit(0.0), lambda a, x: a + x) / (F.length(v) - 1)).otherwise(0.0)
    columns = {
        "length": F.length(v),
        "transitions": (F.length(classes) - 1) / size,
        "letters": pairs,
        "digits": _share(v, "[0-9]"),
        "capitals": _share(v, "[A-Z]"),
        "variety": F.size(F.array_distinct(F.split(v, ""))) / F.least(size, F.lit(64)),
        "coverage": F.col("coverage"),
        "hex": v.rlike("^[0-9a-f]{12,}$|^[0-9A-F]{12,}$"),
        "address": v.rlike(r"@|://|^www\.|^/|\.(com|org|net|html?|png|jpe?g)\b"),
        "uuid": v.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"),
        "dotted": _share(v, r"[./_:-]"),
        "assigned": assigned,
        "named": named.rlike(CREDENTIAL),
        "near_credential": context.rlike(CREDENTIAL),
        "near_harmless": context.rlike(HARMLESS) | named.rlike(HARMLESS),
        "example_path": F.coalesce(F.col("path"), F.lit("")).rlike(EXAMPLE_PATH),
    }
    return out.withColumns({k: c.cast("double") for k, c in columns.items()})


def training_findings(spark: SparkSession, vocabulary: list[str], rows: int = 8000) -> DataFrame:
    """Labelled findings made by rule from row numbers and words of the corpus: the columns of candidates(), kind and
    secret (0 or 1)."""
    h = lambda salt: F.sha2(F.concat(F.lit(f"{salt}/"), F.col("id").cast("string")), 256)
    b64 = lambda salt, n: F.substring(F.regexp_replace(F.base64(F.unhex(F.concat(h(salt), h(salt + "b")))), "[+/=]", "x"), 1, n)
    up = lambda salt, n: F.upper(F.substring(F.regexp_replace(b64(salt, 64), "[^A-Za-z0-9]", "q"), 1, n))
    pick = lambda salt, xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(len(xs))) + 1).cast("int"))
    n = lambda salt, k: F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(k)).cast("string")
    plain = vocabulary or ["the", "with", "of", "that"]
    cred = ["password", "passwd", "token", "secret", "api_key", "auth_token", "client_secret", "access_key"]
    word = lambda salt: pick(salt, plain)
    cap = lambda salt: F.initcap(word(salt))
    sep = pick("sep", ["-", "_", "."])
    # word, word before the one before, word before, secret
    kinds = [
        (F.concat(F.lit("AKIA"), up("k1", 16)), pick("p1", plain), pick("p2", plain), 1),
        (F.concat(F.lit("ghp_"), b64("k2", 36)), pick("p1", plain), pick("p2", ["token", *plain]), 1),
        (F.concat(F.lit("sk_live_"), b64("k3", 24)), pick("p1", plain), pick("p2", plain), 1),
        (F.concat(pick("c", cred), pick("q", ["=", ":", "='"]), F.substring(h("k4"), 1, 18)), pick("p1", plain), pick("p2", plain), 1),
        (F.concat(F.lit('"'), F.substring(h("k5"), 1, 40), F.lit('"')), pick("c", cred), pick("q", ["=", ":"]), 1),
        (F.concat(F.lit('"'), b64("k6", 40), F.lit('"')), pick("c", cred), pick("q", ["=", ":"]), 1),
        (F.concat(F.lit("xoxb-"), b64("k7", 30)), pick("p1", plain), pick("p2", plain), 1),
        (F.concat(pick("c", cred), pick("q", ["=", ":"]), b64("k8", 12), n("d8", 100)), pick("p1", plain), pick("p2", plain), 1),
        (F.substring(h("n1"), 1, 40), pick("p1", plain), pick("x", ["commit", "revision", "sha1", "hash"]), 0),
        (F.md5(h("n2")), pick("p1", plain), pick("x", ["md5", "checksum", "digest", "etag", "the", "of"]), 0),
        (F.regexp_replace(h("n3"), "^(.{8})(.{4})(.{4})(.{4})(.{12}).*$", "$1-$2-$3-$4-$5"), pick("p1", plain), pick("x", ["uuid", "id", "session", "the"]), 0),
        (F.concat(pick("a", ["user", "info", "anna", "m.berg", "contact"]), n("d4", 100), F.lit("@mail"), n("e4", 10), F.lit(".example.com")), pick("p1", plain), pick("p2", plain), 0),
        (F.concat(pick("c", cred), pick("q", ["=", ":"]), pick("y", ["your_password_here1", "example1234", "changeme_12345", "xxxxxxxx1", "<token123>", "placeholder_value_1"])), pick("p1", plain), pick("p2", plain), 0),
        (F.concat(F.lit("https://www.example.com/page/"), n("d6", 100_000), F.lit("/index.html")), pick("p1", plain), pick("p2", plain), 0),
        (F.concat(pick("z", ["getUserNameFromIndex", "default_config_value_", "image-gallery-number-", "SECTION_HEADER_"]), n("d7", 1000)), pick("p1", plain), pick("p2", plain), 0),
        (F.concat(F.lit("2024-0"), n("d8", 9), F.lit("-11T12:0"), n("e8", 9), F.lit(":00.000+00:00")), pick("p1", plain), pick("p2", plain), 0),
        (F.concat(F.lit("+49-"), n("d9", 1000), F.lit("-"), n("e9", 10_000_000), n("f9", 1000)), pick("p1", plain), pick("p2", plain), 0),
        (F.concat(word("w1"), word("w2"), word("w3"), n("d10", 10_000)), word("p1"), word("p2"), 0),
        (F.concat(word("w1"), sep, word("w2"), sep, word("w3"), sep, n("d11", 100)), word("p1"), word("p2"), 0),
        (F.concat(word("w1"), cap("w2"), cap("w3"), n("d12", 1000)), word("p1"), word("p2"), 0),
        # plain words after a credential's name, and what they assign in a sentence
        (F.concat(word("w1"), pick("e1", ["", ".", ","])), word("p1"), F.concat(pick("c", cred), F.lit(":")), 0),
        (word("w1"), pick("c", cred), pick("q", ["=", ":"]), 0),
        (F.concat(pick("c", cred), pick("q", ["=", ":"]), word("w1")), word("p1"), word("p2"), 0),
        # passphrases, passwords without digits, and keys between their head and foot
        (F.concat(pick("c", cred), pick("q", ["=", ":"]), word("w1"), sep, word("w2"), sep, word("w3"), sep, word("w4")), word("p1"), word("p2"), 1),
        (F.concat(F.lit('"'), cap("w1"), F.substring(b64("k9", 40), 1, 4), pick("s1", ["!", "#", "$"]), n("d13", 100), F.lit('"')), pick("c", cred), pick("q", ["=", ":"]), 1),
        (b64("k10", 64), F.lit("PRIVATE"), F.lit("KEY-----"), 1),
        (up("k11", 32), word("p1"), F.concat(pick("c", cred), F.lit(":")), 1),
    ]
    kind = F.pmod(F.col("id"), F.lit(len(kinds)))
    choose = lambda k: F.element_at(F.array(*[x[k] if isinstance(x[k], Column) else F.lit(x[k]) for x in kinds]), (kind + 1).cast("int"))
    return spark.range(rows).select(
        F.col("id").alias("doc_id"), F.lit(0).alias("word_index"), choose(0).alias("word"), choose(1).alias("before2"), choose(2).alias("before"), pick("p3", plain).alias("after"), pick("src", ["src1", "src/main", "lib"]).alias("path"), kind.cast("int").alias("kind"), choose(3).alias("secret")
    )


def _vectors(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df)


def fit(findings: DataFrame, known: Corpus, trees: int = 30, depth: int = 9) -> RandomForestClassificationModel:
    """The forest from labelled findings (the columns of candidates() and secret)."""
    forest = RandomForestClassifier(labelCol="secret", featuresCol="features", numTrees=trees, maxDepth=depth, seed=SEED, subsamplingRate=0.8, featureSubsetStrategy="sqrt")
    # in a fixed order, so that the seed gives the same trees each time
    rows = _vectors(features(findings, known)).select("features", F.col("secret").cast("double"), "doc_id", "word").coalesce(1).sortWithinPartitions("doc_id", "word")
    return forest.fit(rows.select("features", "secret"))


def score(found: DataFrame, model: RandomForestClassificationModel, known: Corpus, threshold: float = 0.5) -> DataFrame:
    """doc_id, word_index, name, value_length, value_sha256, kind, probability, is_secret of every candidate."""
    scored = model.transform(_vectors(features(found, known)))
    v = F.col("value")
    kind = F.when(v.rlike("^(AKIA|ASIA)"), "cloud_key").when(v.rlike(KNOWN), "issued_key").when(F.col("before").rlike(KEY_HEAD), "private_key").when(F.col("named") > 0, "assignment").when(F.col("hex") > 0, "hex").when(F.col("address") > 0, "address").otherwise("other")
    p = F.round(vector_to_array("probability").getItem(1), 9)
    return scored.select("doc_id", "word_index", "name", F.col("length").cast("int").alias("value_length"), F.sha2(F.encode("value", "UTF-8"), 256).alias("value_sha256"), kind.alias("kind"), p.alias("probability"), (p >= threshold).alias("is_secret"))


def scan(docs: DataFrame, model: RandomForestClassificationModel | None = None, path: str | None = "source", known: Corpus | None = None) -> DataFrame:
    """Score every candidate of every whole text."""
    known = known or corpus(docs)
    model = model or fit(training_findings(docs.sparkSession, known.common), known)
    return score(candidates(docs, path), model, known)
