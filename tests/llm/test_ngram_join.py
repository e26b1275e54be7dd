import random

import numpy as np

from orderlytics.llm import ngram_join
from orderlytics.llm.components import components
from orderlytics.llm.ngram_join import divide_skip, ngram_components


def shingle_set(text, k):
    words = [w.decode() for w in "".join(c.lower() if c.isascii() else c for c in (text or "")).encode().split()]
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def expected(rows, k, percent):
    ids = [i for i, _ in rows]
    sets = {i: shingle_set(t, k) for i, t in rows}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = find(ids[x]), find(ids[y])
                root[max(p, q)] = min(p, q)
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["The", "of", "é"]
    texts = [None, "", " \t", "a", "A", "a b", "a  b", "b a", "a b c d", "a b c d e"]
    hot = [rng.choice(words) for _ in range(60)]
    for _ in range(n):
        kind = rng.random()
        if kind < 0.4:  # chains and stars of edited copies
            base = list(hot) if rng.random() < 0.7 else rng.choice([t for t in texts if t and len(t) > 20] or ["x y"]).split()
            for _ in range(rng.randrange(3)):
                base[rng.randrange(len(base))] = rng.choice(words)
            texts.append(" ".join(base))
        elif kind < 0.5:
            texts.append(rng.choice(texts))
        elif kind < 0.6:  # a common passage in unrelated texts
            texts.append(" ".join(hot[:20] + [rng.choice(words) for _ in range(rng.randrange(40))]))
        else:
            texts.append(" ".join(rng.choice(words) for _ in range(rng.choice([3, 8, 30, 90]))))
    rng.shuffle(texts)
    return list(zip(rng.sample(range(10 ** 6), len(texts)), texts))


def test_components_equal_brute_force(spark, monkeypatch):
    for seed, k, percent, asked, hot in ((1, 4, 85, 2000, 999), (2, 5, 80, 3, 20)):
        monkeypatch.setattr(ngram_join, "HOT", hot)
        monkeypatch.setattr(ngram_join, "ASKED", asked)
        rows = corpus(seed)
        df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, gram string")
        assert sorted(map(tuple, ngram_components(df, k, percent).collect())) == expected(rows, k, percent)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_components(empty).collect() == []
    rows = [(None, "a b c"), (3, "a b c"), (2, "a b c"), (2, "a b c"), (9, None), (8, "x " * 30_000)]
    out = sorted(map(tuple, ngram_components(spark.createDataFrame(rows, empty.schema)).collect()), key=str)
    assert out == sorted([(None, 1, None), (3, 1, 2), (2, 1, 2), (2, 1, 2), (9, 0, 9), (8, 1, 8)], key=str)


def test_divide_skip():
    rng = np.random.default_rng(0)
    for least in (1, 2, 5, 9):
        lists = [np.sort(rng.choice(50, rng.integers(0, 40), replace=False)) for _ in range(12)]
        n = np.bincount(np.concatenate(lists), minlength=50)
        ids, found = divide_skip(lists, least, mu=0.5)
        assert dict(zip(ids, found)) == {i: c for i, c in enumerate(n) if c >= least}


def test_component_chains(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, 3), (3, 7), (5, 5), (9, 3)]
    out = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert out == {**{i: 100 for i in range(100, 141)}, 3: 3, 7: 3, 9: 3}
