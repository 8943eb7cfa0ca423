"""Toxicity scores: Levenshtein automata over a learned lexicon trie, with context windows around each hit.

A lexicon of whole words and of word stems is learned from labelled documents. Its trie is intersected with the
Levenshtein automaton of each word (one edit from 5 letters, two from 9) and made deterministic lazily, so a token costs
one dictionary step per letter and most tokens die within three. What the automaton takes for a misspelling but clean
training documents use as a word of their own is learned as an exception; what is left counts at least half as much as
the word itself, so that a spelling never seen before is caught. Around each hit a window of tokens tells quotation
(quote marks of the whole line, verbs of saying) from abuse (second person, further hits). The counts are the features
of a logistic regression; exceptions come from one half of the clean sample, the regression from the other.

Defined results: a null or empty text has no hits and gets the score that the regression gives to no hits; repeated rows
are scored each; very long texts are read whole; a word and a stem that both match count as the word, and of equally near
lexicon words any is the misspelled one, as all weigh the same; an empty table gives an empty result; without labels of
both classes the score is the share of toxic labels (0.0 without any). Columns other than doc_id and text, whatever their
names, are never read by the score.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, small_batches, trim

TOKEN = re.compile(r"[^\W_]+")
QUOTE = re.compile("[\"“”„«»‹›]")
SAYING = frozenset("said says say called calls wrote writes quote quoted quotes reported claimed dit disait sagte schrieb nannte dijo escribió".split())
SECOND_PERSON = frozenset("you your yours u ur tu toi ton ta vous votre du dich dir dein sie ihr usted te ti".split())
WINDOW = 12
#: Share of the toxic training documents that a lexicon term must be found in.
SUPPORT = 0.015
#: The least weight of a misspelled word against that of the word.
MISSPELLED = 0.5
FEATURES = 7
SCORE_SCHEMA = "doc_id long, score double, predicted int, n_exact int, n_stem int, n_fuzzy int, n_quoted int"


def edits(length: int) -> int:
    """Edits that a lexicon word of this length tolerates."""
    return 0 if length < 5 else 1 if length < 9 else 2


class LexiconAutomaton:
    """The lexicon trie crossed with Levenshtein automata, made deterministic as tokens arrive.

    run(token) gives 0 (nothing), 1 (a lexicon word), 2 (begins with a lexicon stem) or 3 (a lexicon word misspelled).
    """

    def __init__(self, words: list[str], stems: list[str], exceptions: Iterable[str] = ()):
        self.exceptions = frozenset(exceptions)
        self.child: list[dict[str, int]] = [{}]
        self.word_edits, self.is_stem, self.reach = [-1], [False], [0]
        for term, stem in [(w, False) for w in words] + [(s, True) for s in stems]:
            node = 0
            allowed = 0 if stem else edits(len(term))
            self.reach[0] = max(self.reach[0], allowed)
            for ch in term:
                nxt = self.child[node].get(ch)
                if nxt is None:
                    nxt = len(self.child)
                    self.child[node][ch] = nxt
                    self.child.append({})
                    self.word_edits.append(-1)
                    self.is_stem.append(False)
                    self.reach.append(0)
                node = nxt
                self.reach[node] = max(self.reach[node], allowed)
            if stem:
                self.is_stem[node] = True
            else:
                self.word_edits[node] = allowed
        self.alphabet = {ch for c in self.child for ch in c}
        self.ids: dict[tuple, int] = {}
        self.steps: list[dict[str, int]] = []
        self.states: list[dict[int, int]] = []
        self.end: list[int] = []
        self.stem: list[bool] = []
        self.start = self._state(self._close({0: 0}))
        self.clean: set[str] = set()
        self.found: dict[str, int] = {}

    def _close(self, state: dict[int, int]) -> dict[int, int]:
        """Add what is reached by letters that the token lacks."""
        todo = list(state.items())
        while todo:
            node, e = todo.pop()
            for nxt in self.child[node].values():
                if e + 1 <= self.reach[nxt] and e + 1 < state.get(nxt, 99):
                    state[nxt] = e + 1
                    todo.append((nxt, e + 1))
        return state

    def _state(self, state: dict[int, int]) -> int:
        if not state:
            return -1
        key = tuple(sorted(state.items()))
        if (known := self.ids.get(key)) is not None:
            return known
        self.ids[key] = number = len(self.states)
        self.states.append(state)
        self.steps.append({})
        best = min((e for n, e in state.items() if e <= self.word_edits[n]), default=9)
        self.end.append(1 if best == 0 else 3 if best < 9 else 0)
        self.stem.append(any(e == 0 and self.is_stem[n] for n, e in state.items()))
        return number

    def _step(self, at: int, ch: str) -> int:
        out: dict[int, int] = {}
        for node, e in self.states[at].items():
            if (same := self.child[node].get(ch)) is not None and e < out.get(same, 99):
                out[same] = e
            if e + 1 <= self.reach[node] and e + 1 < out.get(node, 99):
                out[node] = e + 1
            for nxt in self.child[node].values():
                if e + 1 <= self.reach[nxt] and e + 1 < out.get(nxt, 99):
                    out[nxt] = e + 1
        to = self._state(self._close(out))
        self.steps[at][ch] = to
        return to

    def run(self, token: str) -> int:
        at, stem = self.start, False
        for ch in token:
            ch = ch if ch in self.alphabet else "\0"
            to = self.steps[at].get(ch)
            if to is None:
                to = self._step(at, ch)
            if to < 0:
                return 2 if stem else 0
            stem = stem or self.stem[to]
            at = to
        found = self.end[at]
        if found == 3 and token in self.exceptions:
            found = 0
        return 1 if found == 1 else 2 if stem else found

    def matches(self, tokens: set[str]) -> set[str]:
        """Those tokens that match; their kinds are in self.found. Clean tokens are remembered up to a fixed number."""
        for token in tokens - self.clean - self.found.keys():
            kind = self.run(token)
            if kind:
                self.found[token] = kind
            else:
                self.clean.add(token)
        out = tokens & self.found.keys()
        if len(self.clean) + len(self.found) > 150_000:
            self.clean.clear()
            self.found = {t: self.found[t] for t in out}
        return out


def hits(text: str | None, automaton: LexiconAutomaton) -> np.ndarray:
    """The features of one whole text: outside quotation exact, stem, misspelled; quoted; all per 100 tokens; densest window; addressed."""
    out = np.zeros(FEATURES)
    if not text:
        return out
    low = text.lower()
    tokens = TOKEN.findall(low)
    bad = automaton.matches(set(tokens))
    if not bad:
        return out
    at = [i for i, t in enumerate(tokens) if t in bad]
    wanted, spans = set(at), {}
    for i, m in enumerate(TOKEN.finditer(low)):
        if i in wanted:
            spans[i] = m.span()
    marks = [m.start() for m in QUOTE.finditer(low)]
    for i in at:
        kind = automaton.found[tokens[i]]
        a, b = spans[i]
        inside = False
        if marks:
            line, end = low.rfind("\n", 0, a) + 1, low.find("\n", b)
            opened = bisect_left(marks, a) - bisect_left(marks, line)
            inside = opened % 2 == 1 and bisect_left(marks, b) < bisect_left(marks, end if end >= 0 else len(low))
        near = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
        if inside or any(t in SAYING for t in tokens[max(0, i - 4) : i]):
            out[3] += 1
        else:
            out[kind - 1] += 1
        if any(t in SECOND_PERSON for t in near):
            out[6] += 1
    out[4] = 100 * len(at) / max(1, len(tokens))
    lo = 0
    for hi, i in enumerate(at):
        while i - at[lo] > 2 * WINDOW:
            lo += 1
        out[5] = max(out[5], hi - lo + 1)
    return out


@dataclass
class ToxicityModel:
    words: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    exceptions: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=lambda: [0.0] * (FEATURES + 1))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.log1p(x) @ np.array(self.weights[:-1]) + self.weights[-1], -30, 30)))


def _sample(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """At most per_class labelled training documents of each class, chosen by a hash of their ids; and how many there are of each."""
    lab = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id")).select("doc_id", F.col("toxic").alias("y")).dropDuplicates(["doc_id"])
    total = {r["y"]: r["n"] for r in lab.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for y in (0, 1):
        part = lab.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.union(part)
    # 2 * per_class rows of a long and an int: the bound that makes this broadcast safe at any size of the input
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"), total


def _term_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents of each class per word and per word beginning of 4 to 7 letters, summed within the partition.

    ctx has a bit for each remainder of the hash of the word before it, in the toxic class: copies of one document
    bring the same few bits however many they are, a term in free use brings many.
    """
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    ctx: dict[str, int] = {}
    for pdf in batches:
        for text, y in zip(pdf["text"], pdf["y"]):
            tokens = TOKEN.findall((text or "").lower())
            terms = {"=" + w: p for p, w in zip(["", *tokens], tokens) if 3 <= len(w) <= 40}
            terms |= {"^" + w[1 : k + 1]: p for w, p in list(terms.items()) for k in range(4, min(8, len(w) - 1))}
            counts[y].update(terms.keys())
            if y == 1:
                for t, p in terms.items():
                    ctx[t] = ctx.get(t, 0) | 1 << (crc32(p.encode()) % 63)
    terms = list(counts[0].keys() | counts[1].keys())
    for k in range(0, len(terms), 50_000):
        part = terms[k : k + 50_000]
        columns = {n: np.array([c.get(t, 0) for t in part], dtype=np.int64) for n, c in (("n0", counts[0]), ("n1", counts[1]), ("ctx", ctx))}
        yield pd.DataFrame({"term": pd.Series(part, dtype=object), **columns})


def _misspellings(words: list[str], stems: list[str]):
    """Tokens of the texts that the automaton takes for misspellings, once a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = LexiconAutomaton(words, stems)
        for pdf in batches:
            tokens = {t for text in pdf["text"] for t in TOKEN.findall((text or "").lower())}
            yield pd.DataFrame({"token": pd.Series(sorted(t for t in automaton.matches(tokens) if automaton.found[t] == 3), dtype=object)})

    return run


def _features(words: list[str], stems: list[str], exceptions: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = LexiconAutomaton(words, stems, exceptions)
        for pdf in batches:
            x = np.array([hits(t, automaton) for t in pdf["text"]]).reshape(-1, FEATURES)
            yield pd.DataFrame({"y": pdf["y"].to_numpy(), **{f"f{i}": x[:, i] for i in range(FEATURES)}})
        del automaton
        trim()

    return run


def choose_lexicon(counts: list[tuple[str, int, int]], n0: int, n1: int, size: int = 512) -> tuple[list[str], list[str]]:
    """Words and stems that mark the toxic class: frequent enough in it, and almost never in the other.

    A stem replaces the words and longer stems that it explains; of stems with the same support the longest stays.
    """
    need = max(3, SUPPORT * n1)
    good = {t: b for t, a, b in counts if b >= need and (b + 0.5) / (n1 + 1) >= 12 * (a + 0.5) / (n0 + 1)}
    total = {t: b for t, a, b in counts}
    stems: list[str] = []
    for t, b in sorted(good.items(), key=lambda x: (-x[1], len(x[0]), x[0])):
        if t[0] != "^" or b < 2 * need or any(t[1:].startswith(s) for s in stems):
            continue
        if total.get("=" + t[1:], 0) >= 0.9 * b:
            continue
        while longer := [u for u in good if len(u) == len(t) + 1 and u.startswith(t) and good[u] >= 0.97 * b]:
            t = longer[0]
        whole = max((w for w in good if w[0] == "=" and w[1:].startswith(t[1:])), key=lambda w: good[w], default="")
        if whole and good[whole] >= 0.9 * b:
            continue
        stems.append(t[1:])
    stems = list(dict.fromkeys(stems))
    stems = [s for s in stems if not any(s != o and s.startswith(o) for o in stems)]
    words = [t[1:] for t, b in sorted(good.items(), key=lambda x: (-x[1], x[0])) if t[0] == "=" and not any(t[1:].startswith(s) for s in stems)]
    return words[:size], stems[:size]


def regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> list[float]:
    """Weighted logistic regression by Newton steps on log1p features, the constant last."""
    z = np.hstack([np.log1p(x), np.ones((len(x), 1))])
    w, keep = np.zeros(z.shape[1]), np.full(z.shape[1], ridge * weight.sum() / 100)
    keep[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (weight * (p - y)) + keep * w
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(keep + 1e-9), grad)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return [float(v) for v in w]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 5000, candidates: int = 20_000) -> ToxicityModel:
    """Learn the lexicon and the regression from at most per_class training documents of each class.

    The driver gets at most `candidates` terms and 2 * per_class rows of seven numbers, whatever the size of the input.
    """
    small_batches(docs.sparkSession)
    sample, total = _sample(docs, labels, per_class)
    n0, n1 = min(per_class, total.get(0, 0)), min(per_class, total.get(1, 0))
    if not n0 or not n1:
        share = total.get(1, 0) / max(1, sum(total.values()))
        return ToxicityModel(weights=[0.0] * FEATURES + [math.log((share + 1e-6) / (1 - share + 1e-6))])
    sample = sample.persist()
    try:
        terms = (
            sample.mapInPandas(_term_counts, "term string, n0 long, n1 long, ctx long")
            .groupBy("term")
            .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.bit_count(F.bit_or("ctx")).alias("contexts"))
            .where((F.col("n1") >= max(3, SUPPORT * n1)) & ((F.col("n1") + 0.5) / (n1 + 1) >= 12 * (F.col("n0") + 0.5) / (n0 + 1)))
            .where(F.col("contexts") >= 0.35 * F.least("n1", F.lit(63)))
            .select("term", "n0", "n1")
            .orderBy(F.desc("n1"), "term")
            .limit(candidates)
            .collect()
        )
        words, stems = choose_lexicon([tuple(r) for r in terms], n0, n1)
        half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)) == 0
        near = sample.where((F.col("y") == 0) & half).mapInPandas(_misspellings(words, stems), "token string").distinct()
        # words of at most per_class documents that are within two letters of a lexicon word
        exceptions = sorted(r["token"] for r in near.collect())
        rows = sample.where((F.col("y") == 1) | ~half).mapInPandas(_features(words, stems, exceptions), "y int, " + ", ".join(f"f{i} double" for i in range(FEATURES))).toPandas()
    finally:
        sample.unpersist()
    y = rows["y"].to_numpy(dtype=float)
    x = rows.drop(columns="y").to_numpy()
    weight = np.where(y == 1, total[1] / max(1, (y == 1).sum()), total[0] / max(1, (y == 0).sum()))
    w = regression(x, y, weight)
    off = [i for i in range(FEATURES) if w[i] < 0 and i != 3]
    if off:  # only quotation may speak for a document: what else does is noise
        x[:, off] = 0
        w = [0.0 if i in off else v for i, v in enumerate(regression(x, y, weight))]
    # training documents hold few of the spellings to come: a misspelled word counts half as much as the word at least
    w[2] = max(w[2], MISSPELLED * w[0])
    return ToxicityModel(words, stems, exceptions, w)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Score every whole text: doc_id, score, predicted and the counts behind them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = LexiconAutomaton(model.words, model.stems, model.exceptions)
        for pdf in batches:
            x = np.array([hits(t, automaton) for t in pdf["text"]]).reshape(-1, FEATURES)
            p = model.probability(x)
            n = x.astype("int32")
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": p, "predicted": (p >= 0.5).astype("int32"), "n_exact": n[:, 0], "n_stem": n[:, 1], "n_fuzzy": n[:, 2], "n_quoted": n[:, 3]})
        del automaton
        trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, SCORE_SCHEMA)


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The documents that are not rejected, with all their columns. One narrow pass: no shuffle."""

    @F.pandas_udf("double")
    def probability(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = LexiconAutomaton(model.words, model.stems, model.exceptions)
        for texts in parts:
            yield pd.Series(model.probability(np.array([hits(t, automaton) for t in texts]).reshape(-1, FEATURES)))
        del automaton
        trim()

    return docs.where(probability("text") < threshold)
