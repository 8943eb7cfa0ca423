import itertools
import random

import numpy as np
import pytest

from tempora.llm import pieces as P


@pytest.fixture(scope="module")
def small():
    rng = random.Random(3)
    pieces = ["<unk>", *[f"<0x{b:02X}>" for b in range(256)], "▁", *"abc", "▁a", "ab", "bc", "abc", "ca", "▁ab", "cab", "bca"]
    kinds = [2] + [1] * 256 + [0] * (len(pieces) - 257)
    return P.Segmenter(P.Vocabulary(tuple(pieces), tuple(-float(rng.randint(1, 30)) for _ in pieces), tuple(kinds)))


def every(s, w):
    """All segmentations of a chunk with their scores."""
    out = []
    for mask in itertools.product([0, 1], repeat=len(w) - 1):
        cuts = [0, *[k + 1 for k, m in enumerate(mask) if m], len(w)]
        score = 0.0
        for i, j in zip(cuts, cuts[1:]):
            x = s.score.get(w[i:j], s.unknown if j == i + 1 else None)
            if x is None:
                break
            score += x
        else:
            out.append((score, s._emit(w, cuts)))
    return sorted(out, key=lambda x: -x[0])


def test_n_best_is_exact(small):
    rng = random.Random(8)
    for _ in range(300):
        w = "▁" * rng.randint(0, 1) + "".join(rng.choices("abcé", k=rng.randint(1, 9)))
        want, got = every(small, w), small.n_best(w, 5)
        assert [a for a, _ in got] == [a for a, _ in want[:5]]
        assert {x for x in got} <= {x for x in want}
        ids, score, gap = small._single(w)
        assert score == want[0][0] and gap == (want[0][0] - want[1][0] if len(want) > 1 else np.inf)


def test_together_equals_single(small):
    rng = random.Random(9)
    chunks = list({"▁" + "".join(rng.choices("abcé", k=rng.randint(1, 12))) for _ in range(500)})
    small.solve(set(chunks))
    for c in chunks:
        assert small.known[c] == small._single(c)


def test_texts(small):
    rng = random.Random(10)
    for _ in range(60):
        text = "".join(rng.choices("abc \n", k=rng.randint(0, 9)))
        chunks = small.chunks(text)
        small.solve(set(chunks))
        w = "▁" + text.replace(" ", "▁")
        if text:
            want = every(small, w)[:4]
            assert [a for a, _ in small.alternatives(chunks, 4)] == [a for a, _ in want]
        ids, score = small.encode(chunks)
        assert small.decode(ids) == text


def test_round_trip_with_the_real_vocabulary(spark):
    texts = ["Hello  world", None, "", " ", "\n\n a", "naïve café 日本語 🙂\t\x00", "x" * 30_000, "ab " * 5000, "Hello  world"]
    docs = spark.createDataFrame([(i, t, "c", 0.5) for i, t in enumerate(texts)] + [(None, "a", "c", 0.1)], "doc_id long, text string, ids string, score double")
    enc = P.encode(docs)
    back = {r.doc_id: r.text for r in P.decode(enc).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)} | {None: "a"}
    rows = P.digest(docs).collect()
    assert len(rows) == 10 and all(r.round_trip for r in rows)
    by = {r.doc_id: r for r in enc.collect()}
    for r in rows:
        assert r.n_pieces == len(by[r.doc_id].ids) and r.n_best_scores == [x.score for x in by[r.doc_id].n_best] and sorted(r.n_best_scores, reverse=True) == r.n_best_scores
    assert P.digest(docs.limit(0)).count() == 0
    assert {r.doc_id: r.ids for r in P.digest(docs, ids=True).collect()} == {i: r.ids for i, r in by.items()}


def test_runs_of_one_character_are_bounded(small):
    for n in (7, 50, 20_000):
        got = small.n_best("a" * n, 4)
        ids, score, gap = small._single("a" * n)
        assert got[0] == (score, ids) and len(got) == 1  # one segmentation: no piece is a run of that letter
    w = "abc" * 5000
    got = small.n_best(w, 4)
    ids, score, gap = small._single(w)
    assert got[0] == (score, ids) and len({x for _, x in got}) == 4 and got[1][0] == score - gap
    assert [a for a, _ in got] == sorted((a for a, _ in got), reverse=True)


def test_kept_chunks_go_with_a_task_of_another_operator():
    from tempora.llm import common

    v = P.Vocabulary(("<unk>", "a"), (0.0, -1.0), (2, 0))
    s = P._segmenter(v)
    s.solve({"a"})
    s.forget()
    assert P._segmenter(v) is s and s.known
    common.trim()
    assert not P._SEGMENTERS and P._segmenter(v) is not s


def test_chunks_of_all_lengths_are_solved_together(small, monkeypatch):
    rng = random.Random(12)
    chunks = {"".join(rng.choices("abcé▁", k=k)) for k in range(1, P.LONG + 3) for _ in range(20)}
    s, together, groups = small, small._together, []
    s.known.clear()
    s.older.clear()
    monkeypatch.setattr(s, "_together", lambda c: (groups.append(len(c)), together(c)))
    s.solve(set(chunks))
    assert len(groups) == 1 and groups[0] == sum(len(c) <= P.LONG for c in chunks)  # not a group for each length
    assert all(s.known[c] == small._single(c) for c in chunks)
    monkeypatch.setattr(P, "TOGETHER", 300)  # in many parts: the same
    once = dict(s.known)
    s.known.clear()
    s.solve(set(chunks))
    assert s.known == once and len(groups) > 10


def test_a_text_looks_its_chunks_up_once(monkeypatch):
    looked, found = [], P.Segmenter.found
    monkeypatch.setattr(P.Segmenter, "found", lambda s, c: (looked.append(len(c)), found(s, c))[1])
    s = P.Segmenter(P.Vocabulary(("<unk>", "▁a", "a", "b", "ab"), (0.0, -1.0, -2.0, -3.0, -4.0), (2, 0, 0, 0, 0)))
    chunks = s.chunks("ab a b")
    s.solve(set(chunks))
    mine = s.found(chunks)
    assert s.encode(chunks, mine)[1] == s.alternatives(chunks, 3, mine)[0][0] and looked == [3]


def test_hashes_that_share_their_highest_bits(small):
    s = P.Segmenter(P.Vocabulary(("<unk>", "a", "b", "ab"), (0.0, -1.0, -2.0, -3.0), (2, 0, 0, 0)))
    s.first, s.shared, s.shift = np.zeros(2, dtype=np.int32), np.array([True, True]), np.uint64(63)
    h = np.concatenate([s.sorted, s.sorted + np.uint64(1), np.array([0, 2**64 - 1], dtype=np.uint64)])
    at, hit = s._find(h)
    assert hit.tolist() == np.isin(h, s.sorted).tolist() and (s.sorted[at[hit]] == h[hit]).all()
    nothing = P.Segmenter(P.Vocabulary((), (), ()))
    nothing.solve({"a", "bc", "def"})
    assert nothing.known["bc"] == nothing._single("bc")
