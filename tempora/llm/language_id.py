"""Language identification by interpolated Kneser-Ney character models, one per language.

Words are runs of letters, lower-cased, between boundary marks. A task counts the words of its training documents per
language; character n-grams up to ORDER are counted from the task's distinct words, and only n-grams, summed over a task,
are shuffled. They are weighted by their counts at the highest order and by the number of different left neighbours
below it, as Kneser-Ney asks. Counts, discounts, totals and probabilities are computed in DataFrame operations over all
n-grams; none is left out. A run longer than LONG letters is counted and scored in pieces that overlap by the context,
without a mark where it is cut.

The models of all languages share one sorted array of n-gram hashes, with a row of interpolated log probabilities per
language, and one of context hashes with the weights left to the shorter context, so a character costs a few binary
searches. These arrays are all that comes to the driver, 8 + 4 * languages bytes an n-gram; they grow with the number of
different n-grams of up to ORDER letters.

A text's cross-entropy per character under each model gives the language; the difference to the runner-up, scaled by a
temperature fitted on every training document, gives the score. The same documents give the rejection bound: the
smallest margin such that at most a share WRONG of the predictions with that margin or a larger one is wrong. Both come
from sums over all different margins. identify() reads each text once for calibration and prediction together.

Defined results: a null text or one without a letter is `und` with score 0; equal entropies go to the alphabetically
first language; without training documents everything is `und`; very long texts and words are read whole; repeated rows
are predicted each; an empty table gives an empty result; extra columns, whatever their names, are ignored; lang, source
and doc_id are never read by a prediction.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, held_out, small_batches, trim

ORDER = 4
#: The temperatures that are tried.
GRID = np.geomspace(0.5, 200, 60)
#: Margins are summed in bins of 1 / BINS nats up to WIDEST, so at most BINS * WIDEST rows come to the driver.
BINS, WIDEST = 1000, 50
#: The share of wrong predictions among those that the rejection bound accepts.
WRONG = 0.01
#: Letters of a run that are counted or scored together.
LONG = 60
#: Letters of the words that a task remembers with their entropies, besides those of its current texts.
CACHE = 2_000_000
BEGIN, END = "\x02", "\x03"
LETTERS = re.compile(r"[^\W\d_]+")
MIX = np.uint64(0x9E3779B97F4A7C15)
#: guess is null without a letter; label is carried along for calibration and never read.
SCHEMA = "doc_id long, guess string, margin double, entropy double, label string"


def _hash(code: np.ndarray) -> np.ndarray:
    """The hash of each row of code points."""
    h = np.full(len(code), code.shape[1] << 32, dtype=np.uint64)  # no code point reaches these bits, so none cancels the length
    for k in range(code.shape[1]):
        h = (h ^ code[:, k].astype(np.uint64)) * MIX
        h ^= h >> np.uint64(29)
    return h


def pieces(word: str) -> list[tuple[str, int]]:
    """The marked word in parts (text, characters at its beginning that are context only); most words are one part."""
    if len(word) <= LONG:
        return [(f"{BEGIN}{word}{END}", 1)]
    marked = f"{BEGIN}{word}{END}"
    return [(marked[max(0, k - ORDER + 1) : k + LONG], min(k, ORDER - 1)) for k in range(1, len(marked), LONG)]


def _codes(texts: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(texts), length)


def _find(sorted_hashes: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted array and whether each hash is there."""
    if not len(sorted_hashes):
        return np.zeros(len(h), dtype=int), np.zeros(len(h), dtype=bool)
    at = np.searchsorted(sorted_hashes, h).clip(max=len(sorted_hashes) - 1)
    return at, sorted_hashes[at] == h


@dataclass
class LanguageModel:
    langs: list[str]
    hashes: np.ndarray  # of n-grams, sorted
    logp: np.ndarray  # a row per hash, a column per language
    contexts: np.ndarray  # hashes of contexts, sorted
    logw: np.ndarray  # the weight that a context leaves to the shorter one
    floor: np.ndarray  # a character that no model has
    temperature: float = 1.0
    least: float = 0.0  # the smallest margin that is accepted

    @property
    def bound(self) -> float:
        """The score of the smallest margin that is accepted."""
        return float(_logistic(self.least, self.temperature)) if self.least else 0.0

    def entropies(self, parts: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
        """For each part: the summed negative log probability per language, and the number of characters predicted."""
        total, chars = np.zeros((len(parts), len(self.langs))), np.zeros(len(parts))
        alike: dict[tuple[int, int], list[int]] = {}
        for i, (w, skip) in enumerate(parts):
            alike.setdefault((len(w), skip), []).append(i)
        for (length, skip), rows in alike.items():
            for k in range(0, len(rows), 20_000):
                part = np.array(rows[k : k + 20_000])
                code = _codes([parts[i][0] for i in part], length)
                for j in range(skip, length):
                    todo = np.arange(len(part))
                    value = np.zeros((len(part), len(self.langs)))
                    for n in range(min(ORDER, j + 1), 0, -1):
                        at, hit = _find(self.hashes, _hash(code[todo, j - n + 1 : j + 1]))
                        value[todo[hit]] += self.logp[at[hit]]
                        todo = todo[~hit]
                        if not len(todo):
                            break
                        if n > 1:
                            at, hit = _find(self.contexts, _hash(code[todo, j - n + 1 : j]))
                            value[todo[hit]] += self.logw[at[hit]]
                    value[todo] += self.floor
                    total[part] -= value
                chars[part] = length - skip
        return total, chars


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and the sum of n over each."""
    order = np.argsort(key)
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=int)
    return key[first], np.add.reduceat(n, first) if len(first) else n


def _occurrences(parts: list[tuple[str, int, int]]) -> Iterator[tuple[list[str], list[int]]]:
    """The n-grams of each order in parts (text, characters at its beginning that are context only, times), and how often
    they occur. The last ORDER characters up to a place are one number; the shorter n-grams are sums over those."""
    if not parts:
        return
    bits = 64 // ORDER
    texts, skips, times = zip(*parts)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    number = np.zeros(0x110000, dtype=np.uint64)
    number[code] = 1
    letters = np.flatnonzero(number).astype(np.uint32)
    if len(letters) >= 1 << bits and len(parts) > 1:  # more different characters than numbers
        yield from _occurrences(parts[: len(parts) // 2])
        yield from _occurrences(parts[len(parts) // 2 :])
        return
    number[letters] = np.arange(1, len(letters) + 1, dtype=np.uint64)  # 0: none
    number = number[code]
    at = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    key = number.copy()
    for n in range(1, ORDER):
        key[n:] |= np.where(at[n:] >= n, number[:-n], np.uint64(0)) << np.uint64(bits * n)
    use = at >= np.repeat(np.array(skips), sizes)
    key, times = _summed(key[use], np.repeat(np.array(times, dtype=np.int64), sizes)[use])
    places = np.arange(ORDER, dtype=np.uint64) * np.uint64(bits)
    for n in range(1, ORDER + 1):
        own = key << np.uint64(64 - bits * n) >> np.uint64(64 - bits * n)
        there = own >> places[n - 1] > 0
        own, sums = _summed(own[there], times[there])
        text = letters[(own[:, None] >> places[:n][::-1] & np.uint64((1 << bits) - 1)).astype(np.int64) - 1].tobytes().decode("utf-32-le", "surrogatepass")
        yield [text[k : k + n] for k in range(0, len(text), n)], sums.tolist()


def _gram_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Occurrences (lang, gram, n) of the n-grams of each order in texts (lang, text), summed within a task as far as memory
    allows."""
    words: dict[str, Counter] = {}
    grams: dict[str, Counter] = {}

    def count() -> None:
        for lang, c in words.items():
            own = grams.setdefault(lang, Counter())
            items = [(*p, n) for w, n in c.items() for p in (pieces(w) if isinstance(w, str) else [w])]
            for k in range(0, len(items), 50_000):
                for found, n in _occurrences(items[k : k + 50_000]):
                    own.update(dict(zip(found, n)))
        words.clear()

    def flush() -> Iterator[pd.DataFrame]:
        for lang, c in grams.items():
            yield pd.DataFrame({"lang": pd.Series([lang] * len(c), dtype=object), "gram": pd.Series(list(c), dtype=object), "n": np.array(list(c.values()), dtype=np.int64)})
        grams.clear()

    for pdf in batches:
        for lang, text in zip(pdf["lang"], pdf["text"]):
            own = words.setdefault(lang, Counter())
            found = LETTERS.findall((text or "").lower())
            if max(map(len, found), default=0) > LONG:  # not held whole
                own.update(p for w in found if len(w) > LONG for p in pieces(w))
                found = [w for w in found if len(w) <= LONG]
            own.update(found)
            if sum(map(len, words.values())) > 200_000:
                count()
                if sum(map(len, grams.values())) > 200_000:
                    yield from flush()
    count()
    yield from flush()
    trim()


def _per_language(langs: list[str], value: Column) -> Column:
    """An array with the value of each language's row, null where it has none."""
    return F.array(*[F.max(F.when(F.col("lang") == g, value)) for g in langs])


def counted(grams: DataFrame) -> DataFrame:
    """Kneser-Ney counts (lang, gram, order, c) of occurrences (lang, gram, n): below the highest order the different
    characters seen before an n-gram, except at the beginning of a word, where there is none before it."""
    order = F.length("gram")
    before = grams.where(order > 1).select("lang", F.expr("substring(gram, 2)").alias("gram")).groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("kinds"))
    c = F.when((order == ORDER) | F.col("gram").startswith(BEGIN), F.col("n")).otherwise(F.coalesce("kinds", "n"))
    return grams.join(before, ["lang", "gram"], "left").select("lang", "gram", order.alias("order"), c.cast("double").alias("c"))


def discounts(counts: DataFrame) -> dict[tuple[str, int], float]:
    """The discount of each language and order, n1 / (n1 + 2 n2): a few rows."""
    one, two = F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)
    rows = counts.groupBy("lang", "order").agg(one.alias("one"), two.alias("two")).collect()
    return {(r["lang"], r["order"]): r["one"] / (r["one"] + 2 * r["two"]) if r["one"] else 0.5 for r in rows}


def probabilities(counts: DataFrame, langs: list[str]) -> tuple[DataFrame, DataFrame, list[float]]:
    """(gram, p), (context, w) with an array over the languages, and each language's probability of an unseen character.

    p is interpolated: max(c - d, 0) / total + d * kinds / total * p(shorter). A language without the n-gram has its
    context's weight w = d * kinds / total (1 for a context that it has not) times p(shorter).
    """
    d = discounts(counts)
    each = range(len(langs))
    ctx = F.expr("substring(gram, 1, length(gram) - 1)")
    contexts = counts.groupBy("order", ctx.alias("context")).agg(_per_language(langs, F.lit(1.0)).alias("seen"), *[F.sum(F.when(F.col("lang") == g, F.col("c"))).alias(f"t{i}") for i, g in enumerate(langs)], *[F.count_if(F.col("lang") == g).alias(f"k{i}") for i, g in enumerate(langs)])
    contexts = cut(contexts, "contexts")
    alphabet = counts.where("order = 1").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    size = {r["lang"]: r["n"] + 1 for r in alphabet}  # one more for what was never seen
    weights, values, shorter, unseen = None, None, None, []
    for n in range(1, ORDER + 1):
        here = contexts.where(F.col("order") == n)
        w = F.array(*[F.coalesce(F.lit(d.get((g, n), 0.5)) * F.col(f"k{i}") / F.col(f"t{i}"), F.lit(1.0)) for i, g in enumerate(langs)])
        here = here.select("context", w.alias("w"), F.array(*[F.col(f"t{i}") for i in each]).alias("t"))
        if n == 1:
            row = here.first()
            unseen = [row["w"][i] / size[g] for i, g in enumerate(langs)]
            low = F.array(*[F.lit(1 / size[g]) for g in langs])
        else:
            low = F.col("low")
            weights = here.select("context", "w") if weights is None else weights.union(here.select("context", "w"))
        union = counts.where(F.col("order") == n).groupBy("gram").agg(_per_language(langs, F.col("c")).alias("c"))
        union = union.withColumn("context", ctx).withColumn("tail", F.expr("substring(gram, 2)")).join(here, "context")
        if shorter is not None:
            union = union.join(shorter.select(F.col("gram").alias("tail"), F.col("p").alias("low")), "tail")
        p = F.array(*[F.coalesce(F.greatest(F.col("c")[i] - d.get((g, n), 0.5), F.lit(0.0)) / F.col("t")[i], F.lit(0.0)) + F.col("w")[i] * low[i] for i, g in enumerate(langs)])
        shorter = cut(union.select("gram", p.alias("p")), f"order{n}")
        values = shorter if values is None else values.union(shorter)
    return values, weights, unseen


def _hashed(name: str, value: str):
    """Rows (name, value) of any lengths to (h, value): the hash of the text, and the logarithms as single floats."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size = pdf[name].str.len()
            for length, part in pdf.groupby(size):
                h = _hash(_codes(part[name].tolist(), int(length))).view(np.int64)
                logs = np.log(np.maximum(np.array(part[value].tolist(), dtype=float), 1e-30)).astype(np.float32)
                yield pd.DataFrame({"h": h, "v": list(logs)})

    return run


def _arrays(df: DataFrame, name: str, value: str, langs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and their rows of logarithms."""
    got = df.mapInPandas(_hashed(name, value), "h long, v array<float>").toPandas()
    h = got["h"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(h)
    v = np.array(got["v"].tolist(), dtype=np.float32).reshape(-1, langs)
    return h[order], v[order]


def _models(docs: DataFrame) -> LanguageModel:
    """Models of every language of the training documents, not calibrated yet."""
    small_batches(docs.sparkSession)
    train = docs.where(F.col("lang").isNotNull() & ~held_out("doc_id")).select("lang", "text")
    grams = cut(train.mapInPandas(_gram_counts, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    langs = sorted(r["lang"] for r in grams.select("lang").distinct().collect())
    if not langs:
        nothing = np.zeros(0, dtype=np.uint64)
        return LanguageModel([], nothing, np.zeros((0, 0), dtype=np.float32), nothing, np.zeros((0, 0), dtype=np.float32), np.zeros(0))
    values, weights, unseen = probabilities(cut(counted(grams), "counted"), langs)
    return LanguageModel(langs, *_arrays(values, "gram", "p", len(langs)), *_arrays(weights, "context", "w", len(langs)), np.log(np.array(unseen)))


def _labelled(docs: DataFrame) -> DataFrame:
    """doc_id, text, and label: the language of a training document, null for any other."""
    return docs.select("doc_id", "text", F.when(~held_out("doc_id"), F.col("lang")).alias("label"))


def fit(docs: DataFrame) -> LanguageModel:
    """Models of every language of the training documents (the held-out fold and null languages stay out)."""
    model = _models(docs)
    if len(model.langs) > 1:
        _calibrate(model, cut(_read(_labelled(docs).where("label IS NOT NULL"), model), "calibration"))
    return model


def identify(docs: DataFrame) -> DataFrame:
    """predict() with the models fitted on the same documents, each of which is read once for both."""
    model = _models(docs)
    rows = cut(_read(_labelled(docs), model), "read")
    if len(model.langs) > 1:
        _calibrate(model, rows)
    return _judged(rows, model)


def _calibrate(model: LanguageModel, rows: DataFrame) -> None:
    """Set temperature and least margin by every prediction for a training document; a text without a letter has none."""
    right = F.col("guess") == F.col("label")
    marks = cut(rows.where("label IS NOT NULL AND guess IS NOT NULL").groupBy("margin").agg(F.count(F.lit(1)).alias("n"), F.count_if(~right).alias("bad")), "marks")
    model.temperature = _temperature(marks)
    model.least = _least(marks)


def _logistic(margin: float, temperature: float) -> float:
    return 1 / (1 + np.exp(-np.minimum(margin * temperature, 50)))


def _temperature(marks: DataFrame) -> float:
    """The scale of logistic(margin * scale) that makes the outcomes of rows (margin, n, bad) likeliest."""
    margin = F.col("margin")  # never negative, so no exponential overflows
    loss = marks.agg(*[F.sum(F.col("n") * F.log1p(F.exp(-margin * float(t))) + F.col("bad") * margin * float(t)).alias(f"t{i}") for i, t in enumerate(GRID)]).first()
    return 1.0 if loss[0] is None else float(GRID[int(np.argmin(loss))])


def _least(marks: DataFrame, wrong: float = WRONG) -> float:
    """The smallest margin of rows (margin, n, bad) such that at most a share `wrong` of those from it upwards is bad."""
    marks = marks.withColumn("bin", F.floor(F.least("margin", F.lit(float(WIDEST))) * BINS))
    bins = sorted(marks.groupBy("bin").agg(F.sum("n"), F.sum("bad")).collect(), reverse=True)
    above, n, bad = [], 0, 0
    for b, more, worse in bins:
        above.append((b, n, bad))
        n, bad = n + more, bad + worse
    if bad <= wrong * n:
        return 0.0
    # one row a bin, so the broadcast side is as small as what came to the driver
    table = F.broadcast(marks.sparkSession.createDataFrame(above, "bin long, n_above long, bad_above long"))
    w = Window.partitionBy("bin").orderBy(F.desc("margin"))
    sums = marks.join(table, "bin").select("margin", (F.col("n_above") + F.sum("n").over(w)).alias("n"), (F.col("bad_above") + F.sum("bad").over(w)).alias("bad"))
    low = sums.where(F.col("bad") <= F.lit(wrong) * F.col("n")).agg(F.min("margin")).first()[0]
    return np.inf if low is None else low


class _Numbers(dict):
    """Words by the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        return k


class _Scorer:
    """Scores texts; a word that was met before is not scored again."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.number, self.letters = _Numbers(), 0
        self.total, self.chars = np.zeros((0, len(self.model.langs))), np.zeros(0)

    def _add(self) -> None:
        """Entropies of the words that have a number but no row yet."""
        new = list(islice(self.number, len(self.chars), None))
        self.letters += sum(map(len, new))
        if new and max(map(len, new)) <= LONG:  # a part each
            total, chars = self.model.entropies([(f"{BEGIN}{w}{END}", 1) for w in new])
            self.total, self.chars = np.concatenate([self.total, total]), np.concatenate([self.chars, chars])
        elif new:
            index, begin, place = _Numbers(), [], []
            for w in new:
                begin.append(len(place))
                place += [index[p] for p in pieces(w)]
            total, chars = self.model.entropies(list(index))
            self.total = np.concatenate([self.total, np.add.reduceat(total[place], begin)])
            self.chars = np.concatenate([self.chars, np.add.reduceat(chars[place], begin)])

    def score(self, texts: list[str | None]) -> Iterator[tuple[str | None, float, float]]:
        """(language or None, margin to the runner-up, entropy per character) of each text."""
        langs = self.model.langs
        ids = [list(map(self.number.__getitem__, LETTERS.findall(t.lower()))) if isinstance(t, str) and langs else [] for t in texts]
        self._add()
        for k in ids:
            if not k:
                yield None, 0.0, 0.0
                continue
            at = np.array(k)
            mean = self.total[at].sum(axis=0) / self.chars[at].sum()
            best = int(np.argmin(mean))
            rest = np.delete(mean, best)
            yield langs[best], float(rest.min() - mean[best]) if len(rest) else 1.0, float(mean[best])
        if self.letters > CACHE:
            self.forget()


def _read(docs: DataFrame, model: LanguageModel, batch: int = 1000) -> DataFrame:
    """SCHEMA of documents (doc_id, text, label)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = _Scorer(model)
        for pdf in batches:
            texts = pdf["text"].tolist()
            for k in range(0, len(texts), batch):
                got = list(scorer.score(texts[k : k + batch]))
                part = pdf.iloc[k : k + batch]
                ids = part["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None)
                yield pd.DataFrame({"doc_id": ids, "guess": pd.Series([g for g, _, _ in got], dtype=object), "margin": [m for _, m, _ in got], "entropy": [e for *_, e in got], "label": part["label"].to_numpy(dtype=object)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "label").mapInPandas(run, SCHEMA)


def _judged(rows: DataFrame, model: LanguageModel, reject: float | None = None) -> DataFrame:
    """What predict() returns, of rows of SCHEMA."""
    score = F.when(F.col("guess").isNull(), 0.0).otherwise(1 / (1 + F.exp(-F.least(F.col("margin") * model.temperature, F.lit(50.0)))))
    lang = F.coalesce("guess", F.lit("und"))
    if reject is not None:
        lang = F.when(score < reject, "und").otherwise(lang)
    rejected = F.col("guess").isNull() | (F.col("margin") < F.lit(float(model.least)))
    return rows.select("doc_id", lang.alias("lang_pred"), score.alias("score"), "entropy", rejected.alias("rejected"))


def predict(docs: DataFrame, model: LanguageModel, reject: float | None = None, batch: int = 1000) -> DataFrame:
    """doc_id, lang_pred, score (the calibrated probability of lang_pred), the entropy per character in nats, and
    rejected: the margin is under the model's least. With `reject`, lang_pred is `und` for scores below that bound."""
    return _judged(_read(docs.select("doc_id", "text", F.lit(None).cast("string").alias("label")), model, batch), model, reject)
