import random

from tempora.llm import decontamination as D


def tokens(t):
    return (t or "").encode().lower().split()


def brute(docs, items):
    out = set()
    for d, t in docs:
        w = tokens(t)
        for i, b in items:
            v = tokens(b)
            for s in range(-len(v) + 1, len(w)):
                n = sum(0 <= s + k < len(w) and w[s + k] == v[k] for k in range(len(v)))
                if v and n >= D.MIN_SHARE * len(v) and n >= min(D.MIN_WORDS, len(v)):
                    out.add((d, i, s, len(v), n))
    return out


def test_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 12, 20, 45])))) for i in range(30)] + [(30, None), (31, ""), (32, "W1  w2\tw3")]
    docs = []
    for d in range(60):
        w = rng.choices(vocabulary, k=rng.choice([0, 5, 80, 300]))
        if d % 3 == 0:
            v = tokens(items[d % 30][1])
            v = [x.decode() for x in v]
            if d % 2 and len(v) >= 20:  # one word in nine replaced
                v = [x if k % 9 != 4 else "other" for k, x in enumerate(v)]
            at = rng.randint(0, len(w))
            w[at:at] = v
        docs.append((d, " ".join(w).upper() if d % 5 == 0 else "\n".join(w)))
    docs += [(60, None), (61, ""), (62, "w1 w2 w3"), (None, items[3][1])]
    df = spark.createDataFrame([(d, t, "c", 0) for d, t in docs] + [(62, "w1 w2 w3", "again", 1)], "doc_id long, text string, item string, start int")
    bench = spark.createDataFrame([(i, t, "c") for i, t in items], "item_id long, text string, h string")
    want = brute(docs, items)
    got = {tuple(r) for r in D.overlaps(df, bench).select("doc_id", "item_id", "start", "n_words", "n_equal").collect()}
    assert got == want
    kept = D.keep_clean(df, bench)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in docs if d not in {x[0] for x in want})


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.overlaps(docs, none).count() == 0 and D.keep_clean(docs, none).count() == 1
    assert D.overlaps(docs.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_shuffled_like_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(40)))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(f"w{i}" for i in range(10, 30)))], "item_id long, text string")
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    assert [tuple(r)[:3] for r in D.overlaps(docs, bench).collect()] == [(1, 7, 10)]


def test_capitals_with_accents_go_from_the_pipeline(spark):
    item = "él añadió según está aquí más allá también después así über straße größe kürzer"
    docs = spark.createDataFrame([(1, "x y " + item.upper() + " z"), (2, "x y " + item + " z"), (3, "nothing of it is in here")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    assert [r.doc_id for r in D.keep_clean(docs, bench).collect()] == [3]
    assert {r.doc_id for r in D.overlaps(docs, bench).collect()} == {2}  # as OP5_SQL folds


def least_substitutions(n):
    """The fewest substitutions in an item of n words after which no window agrees under any mask."""
    longest = max(map(len, D.MASKS))
    least = {"": 0}
    for _ in range(n):
        step = {}
        for s, e in least.items():
            for x in "01":
                w = s + x
                if any(len(w) >= len(m) and all(a == "1" for a, b in zip(w[-len(m) :], m) if b == "1") for m in D.MASKS):
                    continue
                k = w[-longest + 1 :]
                step[k] = min(step.get(k, n), e + (x == "0"))
        least = step
    return min(least.values())


def test_every_allowed_pattern_leaves_a_hit():
    for n in range(D.SPAN, 300):
        allowed = max(k for k in range(n) if n - k >= D.MIN_SHARE * n and n - k >= min(D.MIN_WORDS, n))
        assert least_substitutions(n) > allowed, n


def replaced(rng, words, k):
    out = list(words)
    for i in rng.sample(range(len(out)), k):
        out[i] = "other"
    return out


def test_random_substitutions_against_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([11, 12, 15, 16, 18, 20, 25, 40])]
    docs = []
    for i, t in items:
        n = len(t.split())
        for _ in range(12):
            docs.append((len(docs), " ".join(rng.choices(vocabulary, k=rng.choice([0, 30])) + replaced(rng, t.split(), n // 4) + rng.choices(vocabulary, k=5))))
    want = brute(docs, items)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert len(want) >= 80
    assert {tuple(r) for r in D.overlaps(df, bench).select("doc_id", "item_id", "start", "n_words", "n_equal").collect()} == want


def test_short_items_and_texts_against_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [(n, " ".join(rng.choices(vocabulary, k=n))) for n in range(1, 13)]
    docs = []
    for n, t in items:
        w = t.split()
        for k in range(3):
            around = rng.choices(vocabulary, k=6)
            for text in (around + replaced(rng, w, min(k, n)) + around, replaced(rng, w, min(k, n)), w[k:] + around, around + w[: n - k]):
                docs.append((len(docs), " ".join(text)))
    want = brute(docs, items)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert any(n == 10 and equal == 8 for _, _, _, n, equal in want)
    assert {tuple(r) for r in D.overlaps(df, bench).select("doc_id", "item_id", "start", "n_words", "n_equal").collect()} == want
