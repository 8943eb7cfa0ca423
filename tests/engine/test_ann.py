import random

import pytest

from tempora.operators import ann
from tempora.operators.retrieval import vector_top_k


def test_recall_against_the_exact_scan(spark, tmp_path):
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    rows = [(f"v{i:04d}", [c + rng.gauss(0, 0.4) for c in centres[i % 12]]) for i in range(1500)] + [("none", None)]
    df = spark.createDataFrame(rows, "id string, embedding array<float>").cache()
    index = ann.build(df, str(tmp_path / "ann"), lists=20)
    assert index.rows.count() == 1500
    hit = 0
    for i in range(0, 1500, 150):
        want = {r.id for r in vector_top_k(df, rows[i][1], 10, tie="id").collect()}
        hit += len(want & {r.id for r in index.search(rows[i][1], 10, 6).collect()})
    assert hit >= 0.9 * 100
    plan = index.search(rows[0][1], 10, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan
    assert ann.open_index(spark, str(tmp_path / "ann")).centroids == index.centroids
    with pytest.raises(ValueError):
        ann.build(df.limit(0), str(tmp_path / "empty"))
    with pytest.raises(FileNotFoundError):
        ann.open_index(spark, str(tmp_path / "empty"))
