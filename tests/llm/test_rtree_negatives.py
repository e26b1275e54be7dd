import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlytics.llm import rtree_negatives as rt



@pytest.fixture(autouse=True, scope="module")
def few_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


SCHEMA = "vec_id long, embedding array<double>, label int, rank int, id long, score string"


def brute(rows, step, positives, negatives):
    good = {}
    for i, v, label in rows:
        if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v):
            row = (label, [math.floor(256 * x) for x in v])
            good[i] = min(good.get(i, row), row)
    out = []
    for a, (label, v) in good.items():
        if a % step:
            continue
        score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in good.items() if i != a and len(w) == len(v)}
        first = sorted((i for i in score if good[i][0] == label), key=lambda i: (-score[i], i))[:positives]
        for p in first:
            fit = sorted((i for i in score if good[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]),
                         key=lambda i: (-score[i], i))[:negatives]
            out += [(a, p, r + 1, n, score[p], score[n]) for r, n in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, step=5, positives=5, negatives=3):
    df = spark.createDataFrame([(i, v, label, 1, 2, "s") for i, v, label in rows], SCHEMA)
    out = rt.mine(df, F.col("vec_id") % step == 0, positives, negatives)
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("tile,leaf,fanout", [(8192, 128, 16), (20, 3, 2)])
def test_by_brute_force(spark, monkeypatch, tile, leaf, fanout):
    """One tile and many; ties, copies, NULLs, lengths, labels of few rows."""
    for name, value in {"TILE": tile, "LEAF": leaf, "FANOUT": fanout, "ANCHORS": 17, "DIRECTORY": 3}.items():
        monkeypatch.setattr(rt, name, value)
    monkeypatch.setattr(rt.pack_order, "__defaults__", (leaf,))
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) / 8 for x in rng.integers(-3, 4, 4)], int(rng.integers(0, 3))) for i in range(200)]
    rows += [(200 + i, [0.5, 0.25, 0.0, 0.125], i % 2) for i in range(60)]           # copies
    rows += [(300, None, 1), (301, [0.1, None, 0.2, 0.3], 1), (302, [math.nan] * 4, 1), (305, [math.inf] * 4, 1),
             (310, [0.1] * 4, None), (None, [0.1] * 4, 1), (315, [0.5, 0.5], 1), (316, [0.5, 0.5], 1), (320, [0.5, 0.4], 2),
             (325, [], 1), (326, [], 1), (327, [], 2), (330, [9.0, 9.0, 9.0, 9.0], 7), rows[5], rows[10],
             (335, [0.0] * 4, 0), (340, [-9.0] * 4, 1), (345, [1e5, -1e5, 1e5, 1e5], 2)]
    assert mined(spark, rows) == brute(rows, 5, 5, 3)
    assert mined(spark, rows, 50, 1, 1) == brute(rows, 50, 1, 1)


def test_empty(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1)]) == []


def test_too_large(spark):
    with pytest.raises(Exception, match="64 bits"):
        mined(spark, [(5, [1e12, 1.0], 1), (6, [1e12, 1.0], 1)])


def test_boxes_bound_all_products():
    rng = np.random.default_rng(4)
    x, anchors = rng.integers(-50, 50, (70, 5)), rng.integers(-50, 50, (9, 5))
    order = rt.pack_order(x, 8)
    assert sorted(order) == list(range(70))
    lo, hi = rt.boxes(x[order], 8)
    least, most = rt._bounds(anchors, lo, hi)
    product = anchors @ x[order].T
    for box in range(len(lo)):
        part = product[:, 8 * box:8 * box + 8]
        assert (least[:, box] <= part.min(axis=1)).all() and (part.max(axis=1) <= most[:, box]).all()


def test_queue_leaves_far_boxes_closed():
    """Clustered vectors: one cluster's leaves are enough."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-1000, 1000, (64, 8))
    x = np.repeat(centres, 128, axis=0) + rng.integers(-5, 6, (64 * 128, 8))
    x = x[rt.pack_order(x)]
    seen = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, slice):
                seen.append(at.start)
            return np.asarray(self)[at]

    ids = np.arange(len(x)).view(Counted)
    (_, _, found, score), = rt.search_tile(ids, x, np.array([-1]), centres[:1], [[(0, -rt.FAR, rt.FAR)]], 5)
    product = x @ centres[0]
    best = np.lexsort((np.arange(len(x)), -product))[:5]
    assert found.tolist() == best.tolist() and score.tolist() == product[best].tolist()
    assert len(seen) < 16
