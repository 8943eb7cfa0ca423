import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


def test_stages_take_effect(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(1)
    vocabulary = ["".join(rng.choices("aeioubcdr", k=6)) for _ in range(600)]
    item = " ".join(rng.choices(vocabulary, k=30))
    docs, labels = [], []
    for i in range(120):
        w = rng.choices(vocabulary, k=60)
        if i % 6 == 0:
            for _ in range(4):
                w.insert(rng.randrange(60), rng.choice(["grelbin", "snorkot"]))
        docs.append((i, " ".join(w), "en", f"src{i % 3}", 0))
        labels.append((i, 1, int(i % 6 == 0)))
    docs.append((200, docs[1][1].upper(), "en", "src0", 0))  # an exact copy of 1: the larger id stays
    near = docs[2][1].split()
    near[30] = "changed"
    docs.append((201, " ".join(near), "en", "src0", 0))  # a near copy of 2: the smaller id stays
    docs.append((202, docs[3][1] + " " + item, "en", "src0", 0))
    docs.append((203, " ".join(rng.choices(vocabulary, k=40)) + "\n" + item, "en", "src0", 0))  # contaminated
    docs += [(204, None, None, None, None), (205, "", "en", "src0", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {r.doc_id: r for r in P.run(spark, str(tmp_path)).collect()}
    want = {i for i in range(120) if i % 6} - {1} | {200, 205}
    assert set(out) - {202, 203} == want and 203 not in out and 201 not in out
    assert all(r.round_trip for r in out.values())
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontaminate", "sentencepiece"]


def test_stages_keep_the_columns(spark, tmp_path):
    import corpus_pipeline as P

    docs = spark.createDataFrame([(1, "a b", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 1
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
