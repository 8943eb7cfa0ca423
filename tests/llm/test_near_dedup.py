import random
from collections import defaultdict

import numpy as np
import pytest

from tempora.llm import near_dedup as N


def brute(rows):
    """Links and components from the full sets of words, for rows (doc_id, text)."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    where = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            where[x].add(i)
    for i, s in sets.items():
        shared = defaultdict(int)
        for x in s:
            for j in where[x]:
                shared[j] += 1
        for j, n in shared.items():
            if j < i and 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_sketch_estimates():
    rng = np.random.default_rng(5)
    for j in (0.3, 0.75, 0.9):
        both = rng.integers(0, 2**63, int(2000 * j)).astype(np.uint64)
        extra = [rng.integers(0, 2**63, int(1000 * (1 - j))).astype(np.uint64) for _ in range(2)]
        a, b = (np.concatenate([both, e]) for e in extra)
        ka, kb = N.sketch(a), N.sketch(b)
        true = len(both) / (len(both) + len(extra[0]) + len(extra[1]))
        assert abs(N.estimate(ka[None], kb[None], np.array([len(a)]), np.array([len(b)]))[0] - true) < 0.16
        assert (N.merge(ka, kb) == N.sketch(np.unique(np.concatenate([a, b])))).all()


def test_against_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for g in range(12):
        base = rng.choices(vocabulary, k=rng.choice([3, 8, 40, 120]))
        for _ in range(rng.choice([1, 2, 8, 40])):
            w = list(base)
            for _ in range(rng.randint(0, max(0, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    texts += [None, "", "   \n", "one", "ONE", "one\t\ttwo three", "É x y z v w", "é x y z v w", "x " * 30_000, "x " * 29_000 + "y"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "c", i) for i, t in rows] + [(3, texts[3], "again", 0)], "doc_id long, text string, regs string, component_id int")
    want = brute(rows)
    out = N.assign(docs).collect()
    assert len(out) == len(rows) + 1
    for r in out:
        assert (r.n_shingles, r.component_id) == want[r.doc_id], r
        assert r.kept == (r.doc_id == r.component_id)
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})


def test_blocks_connect_what_a_star_misses():
    rng = np.random.default_rng(2)
    import pandas as pd

    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    member = [np.concatenate([base[:360], rng.integers(0, 2**63, 40).astype(np.uint64)]) for _ in range(3)]
    pdf = pd.DataFrame({"id": [1, 2, 3], "comp": [1, 2, 2], "n": [400] * 3, "regs": [N.sketch(m).tobytes() for m in member]})
    got = N._blocks((0, 0, 0), pdf, pdf)
    assert len(got) == 2 and (got["a"] == 1).any()


def test_intersections_by_matrices():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, rng.integers(0, 200))) for _ in range(40)]
    want = [[len(np.intersect1d(a, b)) for b in sets[20:]] for a in sets[:20]]
    assert (N._common(sets[:20], sets[20:], columns=64) == want).all()


@pytest.mark.parametrize("block, shingles, fan, floor", [(4, 500_000, 1000, N.FLOOR), (256, 150, 3, 0.3)])
def test_many_blocks(spark, monkeypatch, block, shingles, fan, floor):
    for name, value in (("BLOCK", block), ("SHINGLES", shingles), ("FAN", fan), ("FLOOR", floor)):
        monkeypatch.setattr(N, name, value)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    base = rng.choices(vocabulary, k=60)
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = rng.choice(vocabulary)
        rows.append((i, " ".join(w)))
    want = brute(rows)
    out = N.assign(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert N.assign(docs).count() == 0
    one = spark.createDataFrame([(None, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert [r.kept for r in N.assign(one).collect()] == [True, True]


def test_the_screen_is_computed_once(spark, capsys):
    reps = spark.createDataFrame([], "rep long, n long, regs binary")
    N._screen(spark.createDataFrame([], "a long, b long"), reps).explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1
