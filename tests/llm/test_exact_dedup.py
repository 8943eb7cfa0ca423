import hashlib
from collections import defaultdict

import numpy as np
import pytest

from tempora.llm import common
from tempora.llm import exact_dedup as E
from tempora.llm import fuse


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 60_000])
def test_fuse(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    data = fuse.build(keys)
    assert fuse.probe(data, keys).all()
    other = rng.integers(0, 2**63, 20_000).astype(np.uint64) * np.uint64(2)
    assert fuse.probe(data, other).mean() < 0.02
    assert len(data) < 12 + 1.5 * n + 100


def lower(t):
    return (t or "").encode().lower().decode()


@pytest.mark.parametrize("batches, hot", [(1, 10_000), (2, 10_000), (4, 3)])
def test_against_brute_force(spark, monkeypatch, batches, hot):
    monkeypatch.setattr(common, "HOT_KEYS", hot)
    texts = ["A b", "a B", "É x", "é x", None, "", "a b", "z" * 100_000, "Z" * 100_000, "\n", " "] + [f"t{i % 7}" for i in range(60)]
    rows = [(i, t, f"k{i}", i) for i, t in enumerate(texts)] + [(None, "a b", "n", 1), (5, "", "again", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sha string, keep_id int")
    groups = defaultdict(list)
    for r in rows:
        groups[lower(r[1])].append(r[0])
    out = E.assign(docs, batches).collect()
    assert len(out) == len(rows)
    want = sorted((str(r[0]), str(max(-1 if d is None else d for d in groups[lower(r[1])])), len(groups[lower(r[1])]), hashlib.sha256(lower(r[1]).encode()).hexdigest()) for r in rows)
    assert want == sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in out)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in out)
    kept = E.keep_one(docs, batches)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(max(-1 if d is None else d for d in g) for g in groups.values())


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert E.assign(docs).count() == 0 and E.keep_one(docs).count() == 0


def test_filter_positives_that_differ_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(fuse, "probe", lambda data, keys: np.ones(len(keys), dtype=bool))  # every digest passes
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(3000)], "doc_id long, text string")
    assert E.assign(docs, 2).where("group_size <> 1 or not kept").count() == 0
