import random
import zlib

from tempora.llm import toxicity as T

DOCS = "doc_id long, text string, score string"


def test_automaton_kinds():
    a = T.LexiconAutomaton(["idiot", "disgusting", "scum"], ["lowei"])
    assert [a.run(w) for w in ("idiot", "idoit", "idot", "xidiot", "disgustng", "dizgustin", "scum", "scam", "loweischaft", "lowe", "")] == [1, 0, 3, 3, 3, 3, 1, 0, 2, 0, 0]


def test_automaton_against_edit_distance():
    rng = random.Random(1)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
        return row[-1]

    words = ["".join(rng.choices("abc", k=n)) for n in (3, 5, 6, 9, 10)]
    a = T.LexiconAutomaton(words, [])
    for _ in range(3000):
        w = "".join(rng.choices("abcd", k=rng.randint(1, 11)))
        best = min((d for v in words if (d := distance(v, w)) <= T.edits(len(v))), default=9)
        assert a.run(w) == (1 if best == 0 else 3 if best < 9 else 0), w


def test_quotation_is_apart_from_abuse():
    a = T.LexiconAutomaton(["moron"], [])
    assert list(T.hits('they said "moron" once', a)[:4]) == [0, 0, 0, 1]
    assert list(T.hits("you moron", a)[:4]) == [1, 0, 0, 0] and T.hits("you moron", a)[6] == 1
    assert not T.hits(None, a).any() and not T.hits("", a).any()


def test_fit_and_score(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(300):
        words = ["w" + "".join(rng.choices("aeiou", k=4)) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(40), rng.choice(["grelbin", "snorkot"]))
        rows.append((i, " ".join(words), "clash"))
        labels.append((i, int(toxic)))
    rows += [(300, None, None), (301, "", "x"), (5, rows[5][1], "again"), (None, "snorkot snorkot", None), (302, "word " * 50_000 + "snorkot grelbin", None)]
    docs, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = T.fit(docs, lab)
    assert set(model.words) == {"grelbin", "snorkot"}
    out = T.score(docs, model).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is not None and r.doc_id < 300:
            assert r.predicted == int(r.doc_id % 5 == 0)
    assert all(0 <= r.score <= 1 for r in out)
    kept = T.keep_clean(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 300} == {i for i in range(300) if i % 5}


def test_quote_marks_of_the_whole_line_count():
    a = T.LexiconAutomaton(["moron"], [])
    assert list(T.hits('"' + "word " * 200 + 'moron" once', a)[:4]) == [0, 0, 0, 1]
    assert list(T.hits('"a" ' + "word " * 200 + 'moron "b"', a)[:4]) == [1, 0, 0, 0]
    assert list(T.hits('"\nmoron"', a)[:4]) == [1, 0, 0, 0]


def test_planted_misspellings_and_quotations(spark):
    """Held out: misspelled toxic documents are caught, clean words near the lexicon and single quotations are not."""
    rng = random.Random(4)
    bad = ["grelbinous", "snorkottle", "vrimpish"]
    rows, labels, held = [], [], {}
    for i in range(900):
        w = ["w" + "".join(rng.choices("aeiou", k=4)) for _ in range(40)]
        kind = i % 6
        if kind == 0:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        elif kind == 1:
            for _ in range(4):  # a letter changed in the middle
                b, at = rng.choice(bad), rng.randrange(1, 7)
                w.insert(rng.randrange(len(w)), b[:at] + rng.choice("abcdefghijklmnopqrstuvwxyz") + b[at + 1 :])
        elif kind == 2:
            w.insert(10, rng.choice(["grelbinoud", "snorkottlo", "vrimpist"]))  # words of clean documents
        elif kind == 3 and i // 6 % 4 == 0:
            w.insert(10, f'they said "{rng.choice(bad)}" once')
        rows.append((i, " ".join(w)))
        held[i] = (kind, zlib.crc32(str(i).encode()) % 5 == 0)
        labels.append((i, int(kind in (0, 1))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = T.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert all(b in model.words or any(b.startswith(x) for x in model.stems) for b in bad)
    got = {r.doc_id: r.predicted for r in T.score(docs, model).collect()}
    share = lambda kind: [got[i] for i, (k, out) in held.items() if out and k == kind]
    for kind in (0, 1):
        assert sum(share(kind)) >= 0.9 * len(share(kind)), kind
    for kind in (2, 3, 4, 5):
        assert sum(share(kind)) <= 0.05 * len(share(kind)), kind


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    model = T.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.predicted for r in T.score(docs, model).collect()] == [0, 0]
    assert T.score(docs.limit(0), model).count() == 0
