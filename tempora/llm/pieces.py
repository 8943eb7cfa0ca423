"""SentencePiece encoding and decoding with exact N-best segmentations.

Text becomes "▁" + text with spaces as "▁". Pieces and their scores come from a model file (a parameter); the score of a
segmentation is the sum of its pieces' scores, and a character without a piece falls back to its bytes at a penalty. The
best path is found by Viterbi; the forward scores are exact heuristics for an A* search that walks backwards from the
end, so it expands complete segmentations in order of score.

No piece of such a model crosses the beginning of a run of "▁" or a line end (this is checked on loading; otherwise the
whole text is one chunk). So the lattice of a text is a chain of small lattices, each distinct chunk is solved once in a
batch (numpy solves many together, the longest first), and the N best of the chain need A* only in the N - 1 chunks where
leaving the best path costs least.

Model type: the vocabulary in the tests is of a byte-pair model, whose scores are merge ranks. Here they are scores of
the lattice; the greedy merge order of that model's own encoder is not followed.

Defined results: a null or empty text has no pieces, score 0, one segmentation, and decodes to the empty text; ties go
to the longer last piece, then to the earlier chunk; U+2581 in a text decodes to a space; unpaired surrogates cannot
occur; repeated rows are encoded each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, small_batches, trim

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
N_BEST = 4
#: Chunks longer than this are solved one by one.
LONG = 40
#: Characters of the chunks that are solved together, with those that fill up the shorter ones.
TOGETHER = 100_000
#: Solved chunks that a Python worker remembers in a task, at most twice this number, and those that it keeps after it.
CACHE = 120_000
KEEP = 100_000
BASE, MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
PENALTY = 10.0


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    #: 0 ordinary, 1 byte, 2 never in text
    kinds: tuple[int, ...]

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        """Read on the driver; a vocabulary has a fixed size, and travels with the tasks."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        kinds = tuple(1 if sp.is_byte(i) else 2 if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else 0 for i in range(n))
        return cls(tuple(sp.id_to_piece(i) for i in range(n)), tuple(float(sp.get_score(i)) for i in range(n)), kinds)


class Segmenter:
    def __init__(self, v: Vocabulary):
        self.ids = {p: i for i, p in enumerate(v.pieces) if v.kinds[i] == 0}
        self.score = dict(zip(self.ids, (v.scores[i] for i in self.ids.values())))
        self.longest = max(map(len, self.ids), default=1)
        self.bytes = [next((i for i, p in enumerate(v.pieces) if v.kinds[i] == 1 and p == f"<0x{b:02X}>"), 0) for b in range(256)]
        self.unknown = min(self.score.values(), default=0.0) - PENALTY
        self.text = [bytes([int(p[3:5], 16)]) if v.kinds[i] == 1 else b"" if v.kinds[i] == 2 else p.encode() for i, p in enumerate(v.pieces)]
        crossing = any(re.search(f"[^{SPACE}]{SPACE}|\n.|.\n", p, re.S) for p in self.ids)
        self.split = re.compile(".+" if crossing else f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+", re.S).findall
        names = list(self.ids)
        h = np.array([self._hash(p) for p in names] or [0], dtype=np.uint64)
        order = np.argsort(h)
        self.sorted = h[order]
        self.sorted_ids = np.array([self.ids[p] for p in names] or [-1], dtype=np.int32)[order]
        self.sorted_scores = np.array([self.score[p] for p in names] or [-np.inf])[order]
        # by the highest bits of a hash: the first place in the sorted hashes, and whether others have the same bits
        self.shift = np.uint64(64 - max(1, (16 * len(h) - 1).bit_length()))
        prefix, first, many = np.unique(self.sorted >> self.shift, return_index=True, return_counts=True)
        self.first, self.shared = np.zeros(1 << (64 - int(self.shift)), dtype=np.int32), np.zeros(1 << (64 - int(self.shift)), dtype=bool)
        self.first[prefix], self.shared[prefix] = first, many > 1
        self.known: dict[str, tuple[bytes, float, float]] = {}
        self.older: dict[str, tuple[bytes, float, float]] = {}
        self.lists: dict[str, list[tuple[float, bytes]]] = {}

    @staticmethod
    def _hash(p: str) -> int:
        h = 0
        for c in p:
            h = (h * int(BASE) + (ord(c) + 1) * int(MIX)) & (2**64 - 1)
        return h

    # one chunk at a time -------------------------------------------------------------------------------------------

    def _edges(self, w: str, j: int) -> list[tuple[int, float]]:
        """(start, score) of the edges that end at j, the longest first."""
        out = [(i, s) for i in range(max(0, j - self.longest), j) if (s := self.score.get(w[i:j])) is not None]
        if not out or out[-1][0] != j - 1:
            out.append((j - 1, self.unknown))
        return out

    def forward(self, w: str) -> tuple[list[float], list[int]]:
        alpha, back = [0.0], [0]
        for j in range(1, len(w) + 1):
            best, at = -np.inf, j - 1
            for i, s in self._edges(w, j):
                if alpha[i] + s > best:
                    best, at = alpha[i] + s, i
            alpha.append(best)
            back.append(at)
        return alpha, back

    def _emit(self, w: str, cuts: list[int]) -> bytes:
        out = []
        for i, j in zip(cuts, cuts[1:]):
            n = self.ids.get(w[i:j])
            out += [n] if n is not None else [self.bytes[b] for b in w[i:j].encode("utf-8", "replace")]
        return np.array(out, dtype=np.int32).tobytes()

    def n_best(self, w: str, n: int) -> list[tuple[float, bytes]]:
        """The n best segmentations of a chunk: backward A* whose heuristic, the forward score, is exact.

        The first is the Viterbi path, so that it is the one that encode() gives. A search state is a lattice position
        and a link to the state it came from, never a copy of its path. No position is expanded more than n times: of
        the paths from a position to the end only the n best can belong to the answer. Of equal scores the state nearest
        to the beginning goes first, and a state that scores no more than n others already found is left out, so a run
        of equal characters costs memory in proportion to its length.
        """
        alpha, back = self.forward(w)
        best, j = [len(w)], len(w)
        while j:
            j = back[j]
            best.append(j)
        # by state: position, state it came from, score from there to the end
        at, origin, done = [len(w)], [-1], [0.0]
        heap, bar, expanded, paths = [(-alpha[-1], len(w), 0)], [], Counter(), []
        while heap and len(paths) <= n:
            _, j, k = heapq.heappop(heap)
            if j == 0:
                paths.append(k)
                continue
            if expanded[j] > n:
                continue
            expanded[j] += 1
            edges = [(alpha[i] + s + done[k], i, s) for i, s in self._edges(w, j)]
            first = max(edges)[0]
            for f, i, s in edges:
                if f < first:  # each of these stands for a path of its own
                    if len(bar) > n and f <= bar[0]:
                        continue
                    heapq.heappush(bar, f)
                    if len(bar) > n + 1:
                        heapq.heappop(bar)
                at.append(i)
                origin.append(k)
                done.append(s + done[k])
                heapq.heappush(heap, (-f, i, len(at) - 1))
        out = []
        for k in paths:
            cuts, x = [], k
            while x >= 0:
                cuts.append(at[x])
                x = origin[x]
            if cuts != best[::-1]:
                out.append((done[k], self._emit(w, cuts)))
        return [(alpha[-1], self._emit(w, best[::-1])), *out][:n]

    def _single(self, w: str) -> tuple[bytes, float, float]:
        alpha, back = self.forward(w)
        cuts, j = [len(w)], len(w)
        while j:
            j = back[j]
            cuts.append(j)
        cuts.reverse()
        chosen, beta, gap = set(zip(cuts, cuts[1:])), [-np.inf] * len(w) + [0.0], np.inf
        for j in range(len(w), 0, -1):
            for i, s in self._edges(w, j):
                beta[i] = max(beta[i], s + beta[j])
                if (i, j) not in chosen:
                    gap = min(gap, alpha[-1] - (alpha[i] + s + beta[j]))
        return self._emit(w, cuts), alpha[-1], gap

    # many chunks together ------------------------------------------------------------------------------------------

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the sorted hashes, and whether each hash is there."""
        prefix = h >> self.shift
        at = self.first[prefix]
        hit = self.sorted[at] == h
        rest = np.flatnonzero(self.shared[prefix] & ~hit)
        if len(rest):
            at[rest] = np.searchsorted(self.sorted, h[rest]).clip(max=len(self.sorted) - 1)
            hit[rest] = self.sorted[at[rest]] == h[rest]
        return at, hit

    def _together(self, chunks: list[str]) -> None:
        """Solve chunks that are sorted by length, the longest first, so that those that reach a position are a prefix."""
        n, top = len(chunks), len(chunks[0])
        code = np.frombuffer("".join([c.ljust(top, "\0") for c in chunks]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(n, top)
        code = (np.ascontiguousarray(code.T).astype(np.uint64) + np.uint64(1)) * MIX
        lengths, rows = np.array([len(c) for c in chunks]), np.arange(n)
        reach = np.searchsorted(-lengths, -np.arange(top + 1), side="right").tolist()
        alpha = np.full((top + 1, n), -np.inf)
        alpha[0] = 0
        back, last = np.zeros((top + 1, n), dtype=np.int32), np.zeros((top + 1, n), dtype=np.int32)
        edges = []  # (start, end, the rows that have it, their scores), by start
        for i in range(top):
            for j in range(i + 1, min(i + self.longest, top) + 1):
                m = reach[j]
                h = code[i, :m] if j == i + 1 else h[:m] * BASE + code[j - 1, :m]
                at, hit = self._find(h)
                if j == i + 1:
                    r, s, piece = rows[:m], np.where(hit, self.sorted_scores[at], self.unknown), np.where(hit, self.sorted_ids[at], -1)
                else:
                    r = np.flatnonzero(hit)
                    if not len(r):
                        continue
                    s, piece = self.sorted_scores[at[r]], self.sorted_ids[at[r]]
                edges.append((i, j, r, s))
                new = alpha[i][r] + s
                better = np.flatnonzero(new > alpha[j][r])  # of equal scores the longest last piece, which came first
                won = r[better]
                alpha[j][won], back[j][won], last[j][won] = new[better], i, piece[better]
        total = alpha[lengths, rows]
        on = np.zeros((top + 1, n), dtype=bool)
        pos = lengths.copy()
        while pos.any():
            on[pos, rows] = True
            pos = np.where(pos > 0, back[pos, rows], 0)
        on[0] = False
        beta = np.full((top + 1, n), -np.inf)
        beta[lengths, rows] = 0
        gap = np.full(n, np.inf)
        for i, j, r, s in reversed(edges):
            s = s + beta[j][r]
            beta[i][r] = np.maximum(beta[i][r], s)
            other = ~(on[j][r] & (back[j][r] == i))
            gap[r] = np.where(other, np.minimum(gap[r], total[r] - (alpha[i][r] + s)), gap[r])
        ends = (np.cumsum(on.sum(axis=0)) * 4).tolist()
        data = last.T[on.T].tobytes()
        odd = set(np.flatnonzero((on & (last < 0)).any(axis=0)).tolist())
        begin = 0
        for r, (end, best, lead) in enumerate(zip(ends, total.tolist(), gap.tolist())):
            ids = data[begin:end] if r not in odd else self._emit(chunks[r], [0, *np.flatnonzero(on[:, r]).tolist()])
            self.known[chunks[r]] = ids, best, lead
            begin = end

    def solve(self, chunks: set[str]) -> None:
        if len(self.known) > CACHE:
            self.older, self.known = self.known, {}
        new = []
        for c in chunks - self.known.keys():
            if (found := self.older.get(c)) is not None:
                self.known[c] = found
            elif len(c) > LONG:
                self.known[c] = self._single(c)
            else:
                new.append(c)
        new.sort(key=len, reverse=True)
        k = 0
        while k < len(new):
            step = max(64, TOGETHER // len(new[k]))
            self._together(new[k : k + step])
            k += step

    def forget(self) -> None:
        """Keep the chunks that were met first, which are the frequent ones, for the worker's next task."""
        self.known, self.older = dict(islice(self.known.items(), KEEP)), {}
        self.lists.clear()
        trim("pieces")

    # texts ---------------------------------------------------------------------------------------------------------

    def chunks(self, text: str | None) -> list[str]:
        return self.split(SPACE + text.replace(" ", SPACE)) if text else []

    def found(self, chunks: list[str]) -> tuple[tuple, tuple, tuple]:
        """The ids, scores and gaps of solved chunks."""
        return tuple(zip(*map(self.known.__getitem__, chunks))) if chunks else ((), (), ())

    def encode(self, chunks: list[str], found: tuple | None = None) -> tuple[np.ndarray, float]:
        ids, scores, _ = found or self.found(chunks)
        return np.frombuffer(b"".join(ids), dtype=np.int32), float(sum(scores))

    def alternatives(self, chunks: list[str], n: int, found: tuple | None = None) -> list[tuple[float, dict[int, bytes]]]:
        """The n best segmentations of a text: score, and the ids of the chunks that differ from the best, by position."""
        _, scores, gap = found or self.found(chunks)
        best, gaps = float(sum(scores)), np.array(gap, dtype=float)
        take = np.argsort(gaps, kind="stable")[: n - 1] if len(gaps) <= 64 else self._smallest(gaps, n - 1)
        out: list[tuple[float, dict[int, bytes]]] = [(best, {})]
        for k in sorted(int(k) for k in take if np.isfinite(gaps[k])):
            w = chunks[k]
            if w not in self.lists:
                if len(self.lists) > CACHE // 10:
                    self.lists.clear()
                self.lists[w] = self.n_best(w, n)
            mine = self.lists[w]
            more = [(s + m[0] - mine[0][0], d | {k: m[1]} if r else d) for s, d in out for r, m in enumerate(mine)]
            out = sorted(more, key=lambda x: -x[0])[:n]
        return out

    @staticmethod
    def _smallest(gaps: np.ndarray, k: int) -> np.ndarray:
        """Positions of the k smallest, ties by position."""
        limit = np.partition(gaps, k - 1)[k - 1] if k else -np.inf
        near = np.flatnonzero(gaps <= limit)
        return near[np.argsort(gaps[near], kind="stable")][:k]

    def decode(self, ids: np.ndarray | list[int]) -> str:
        data = b"".join(map(self.text.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
        text = data.decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text


_SEGMENTERS: dict[Vocabulary, Segmenter] = {}


def _segmenter(v: Vocabulary) -> Segmenter:
    """This worker's segmenter of a vocabulary; what it has solved serves the worker's next tasks too, until a task of
    another operator ends there."""
    KEPT["pieces"] = _SEGMENTERS.clear
    if v not in _SEGMENTERS:
        _SEGMENTERS.clear()
        _SEGMENTERS[v] = Segmenter(v)
    return _SEGMENTERS[v]


def _batches(texts: pd.Series, chars: int = 500_000) -> Iterator[list[str | None]]:
    """The texts in runs of about so many characters, at least one text each."""
    part: list[str | None] = []
    held = 0
    for t in texts:
        part.append(t if isinstance(t, str) else None)
        held += len(part[-1] or "") + 100
        if held >= chars:
            yield part
            part, held = [], 0
    if part:
        yield part


def encode(docs: DataFrame, path: str = MODEL, n_best: int = N_BEST) -> DataFrame:
    """doc_id, ids, score, and n_best: array of (score, ids) of whole segmentations, the best first."""
    small_batches(docs.sparkSession)
    v = Vocabulary.load(path)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = _segmenter(v)
        for pdf in parts:
            at = 0
            for texts in _batches(pdf["text"]):
                split = [s.chunks(t) for t in texts]
                s.solve({c for chunks in split for c in chunks})
                rows = []
                for chunks in split:
                    found = s.found(chunks)
                    ids, score = s.encode(chunks, found)
                    every = [{"score": a, "ids": np.frombuffer(b"".join(d.get(k, x) for k, x in enumerate(found[0])), dtype=np.int32)} for a, d in s.alternatives(chunks, n_best, found)]
                    rows.append((ids, score, every))
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[at : at + len(texts)].astype("Int64").to_numpy(dtype=object, na_value=None), "ids": [r[0] for r in rows], "score": [r[1] for r in rows], "n_best": [r[2] for r in rows]})
                at += len(texts)
        s.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, ids array<int>, score double, n_best array<struct<score double, ids array<int>>>")


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, text of rows (doc_id, ids)."""
    v = Vocabulary.load(path)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = _segmenter(v)
        for pdf in parts:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": pd.Series([s.decode(list(x)) for x in pdf["ids"]], dtype=object)})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def digest(docs: DataFrame, path: str = MODEL, n_best: int = N_BEST, ids: bool = False) -> DataFrame:
    """Encode, find the n best, decode and compare, in one pass; digests, and with `ids` the ids of the best.

    doc_id, n_pieces, score, ids_sha256 (of little-endian int32), n_best_scores, second_sha256 (null without a second
    segmentation), decoded_sha256, round_trip.
    """
    small_batches(docs.sparkSession)
    v = Vocabulary.load(path)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = _segmenter(v)
        for pdf in parts:
            at = 0
            for texts in _batches(pdf["text"]):
                split = [s.chunks(t) for t in texts]
                s.solve({c for chunks in split for c in chunks})
                rows = []
                for text, chunks in zip(texts, split):
                    found = s.found(chunks)
                    best, score = s.encode(chunks, found)
                    every = s.alternatives(chunks, n_best, found)
                    second = None
                    if len(every) > 1:
                        d = every[1][1]
                        h = hashlib.sha256()
                        start = 0
                        for k in sorted(d):
                            h.update(b"".join(found[0][start:k]))
                            h.update(d[k])
                            start = k + 1
                        h.update(b"".join(found[0][start:]))
                        second = h.hexdigest()
                    back = s.decode(best)
                    digests = hashlib.sha256(best.tobytes()).hexdigest(), [a for a, _ in every], second, hashlib.sha256(back.encode("utf-8", "replace")).hexdigest()
                    rows.append((len(best), score, *digests, back == (text or ""), best))
                out = pd.DataFrame(rows, columns=["n_pieces", "score", "ids_sha256", "n_best_scores", "second_sha256", "decoded_sha256", "round_trip", "ids"]).astype({"ids_sha256": object, "second_sha256": object, "decoded_sha256": object})
                out.insert(0, "doc_id", pdf["doc_id"].iloc[at : at + len(texts)].astype("Int64").to_numpy(dtype=object, na_value=None))
                yield out if ids else out.drop(columns="ids")
                at += len(texts)
        s.forget()

    schema = "doc_id long, n_pieces long, score double, ids_sha256 string, n_best_scores array<double>, second_sha256 string, decoded_sha256 string, round_trip boolean" + (", ids array<int>" if ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, schema)
