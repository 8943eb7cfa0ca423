import hashlib
import random

import pytest

from tempora.llm import common
from tempora.llm import line_dedup as L

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return line.strip(SPACE).encode().lower().decode()


def brute(rows):
    where = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            where.setdefault(key(line), set()).add(d)
    out = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(key(x)) >= 10 and len(where[key(x)]) >= 2 and min(where[key(x)]) != d)]
        out[d] = (len(lines), len(lines) - len(keep), "\n".join(keep))
    return out


@pytest.mark.parametrize("batches, hot", [(1, 10_000), (7, 10_000), (6, 3)])
def test_against_brute_force(spark, monkeypatch, batches, hot):
    monkeypatch.setattr(common, "HOT_KEYS", hot)
    rng = random.Random(batches)
    pool = [f"shared line number {i}" for i in range(25)] + ["short", "É" * 10, "é" * 10, "  Padded LINE here \t", "padded line here", "a" * 9, "a" * 10, ""]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(1, 6)))) for i in range(40)]
    rows += [(40, None), (41, ""), (42, "\n\n"), (43, "long line " * 20_000), (44, "long line " * 20_000 + "\nx"), (45, "shared line number 1\r")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, pos int, low string")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in L.dedup(docs, batches).collect()}
    assert got == brute(rows)


def test_levels_stay_few_and_disjoint(spark):
    runs = L.Runs(spark)
    for k in range(9):
        runs.add(spark.range(k * 10, k * 10 + 10).selectExpr("id as h1", "-id as h2"))
    assert [len(x) for x in runs.levels] == [1, 2]
    assert sorted(r.h1 for run in runs.all() for r in run.collect()) == list(range(90))
    plan = runs.all()[0].join(runs.all()[1], L.HASH, "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan or "Broadcast" in plan
    runs.drop()
    assert not [t for t in runs.names if spark.catalog.tableExists(t)]


def test_null_ids_and_empty(spark):
    docs = spark.createDataFrame([(None, "a line that repeats"), (3, "a line that repeats"), (3, "a line that repeats")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_dropped, r.kept_text) for r in L.dedup(docs).collect())
    assert got == [("3", 1, ""), ("3", 1, ""), ("None", 0, "a line that repeats")]
    assert L.dedup(docs.limit(0)).count() == 0
    assert hashlib.sha256(b"").hexdigest()
