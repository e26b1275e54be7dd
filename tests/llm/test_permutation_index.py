import math

import numpy as np

from orderlytics.llm import permutation_index, registry

SCHEMA = "vec_id long, embedding array<float>, rank int, score double"


def exact(rows, k, step):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) == 3
            and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = []
    for q in good:
        if q % step == 0:
            best = sorted(((-float(good[q] @ v), i) for i, v in good.items() if i != q))[:k]
            out += [(q, r + 1, i) for r, (_, i) in enumerate(best)]
    return sorted(out)


def test_awkward_rows_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 3)]) for i in range(60)]
    rows += [(60, None), (61, []), (62, [0.0, 0.0, 0.0]), (63, [1.0, None, 2.0]), (64, [1.0, math.nan, 1.0]),
             (65, [math.inf, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (66, [1.0, 2.0]), rows[5], rows[10]]
    df = spark.createDataFrame([(i, v, 1, 0.5) for i, v in rows], SCHEMA)
    for k in (4, 100):
        out = permutation_index.nearest(df, df["vec_id"] % 5 == 0, k=k)
        assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in out.collect()) == exact(rows, k, 5)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert permutation_index.nearest(df, df["vec_id"] % 5 == 0).collect() == []


def test_recall_in_blocks(spark, monkeypatch):
    """Recall of the production parameters, several blocks, no least number of rows."""
    monkeypatch.setattr(permutation_index, "ROWS", 600)
    monkeypatch.setattr(permutation_index, "QUERIES", 30)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    out = permutation_index.nearest(df, df["vec_id"] % 20 == 0, least=0).collect()
    rows = df.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    hit = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -9
        true = set(ids[np.argsort(-s)[:20]])
        hit += len(true & {r["vec_id"] for r in out if r["query_id"] == ids[q]})
        total += 20
    assert hit / total >= 0.9


def test_query_scores(spark):
    out = registry.op8_nearest(spark, "/root/testdata/sf0.001").collect()
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()}
    assert {r["query_id"] for r in out} == {i for i in x if i % 20 == 0}
    assert all(abs(r["score"] - x[r["query_id"]] @ x[r["vec_id"]]) < 1e-12 for r in out)
