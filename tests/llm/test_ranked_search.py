import math
import re
from collections import Counter

import numpy as np
import pytest

from orderlytics.llm import ranked_search as rs

SCHEMA = "doc_id long, text string, score long, item_id long, shard long"
ITEMS = "item_id long, text string, term string"


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, items, k):
    held = [(i, words(t)) for i, t in docs if words(t)]
    n, total = len(held), sum(len(w) for _, w in held)
    df = Counter(t for _, w in held for t in set(w))
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in items:
        scored = []
        for i, w in held:
            tf, m = Counter(w), 25 + 75 * len(w) * n // total
            s = sum(weight[t] * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in words(text) if t in tf)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if gone else i, -s) for r, (s, gone, i) in enumerate(sorted(scored)[:k])]
    return out


def key(row):
    return tuple((x is None, x or 0) for x in row)


def found(spark, docs, items, k, **small):
    d = spark.createDataFrame([(i, t, 7, 8, 9) for i, t in docs], SCHEMA)
    i = spark.createDataFrame([(a, t, "x") for a, t in items], ITEMS)
    out = rs.Index(d, **small).search(i, k)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, out.collect()), key=key)


def some(rng, vocabulary, n):
    return " ".join(rng.choice(vocabulary, n))


@pytest.mark.parametrize("postings", [40, 1_000_000])
def test_by_brute_force(spark, monkeypatch, postings):
    """Several windows, blocks and shards; ties, repeated rows, NULLs, empties."""
    monkeypatch.setattr(rs, "WINDOW", 4)
    monkeypatch.setattr(rs, "BLOCK", 3)
    monkeypatch.setattr(rs, "ITEMS", 5)
    rng = np.random.default_rng(3)
    common, rare = [f"c{i}" for i in range(6)], [f"Wört{i}" for i in range(60)]
    docs = [(i, some(rng, common, 5 + i % 40) + ", " + some(rng, rare, i % 9)) for i in range(150)]
    docs += [(200, None), (201, ""), (202, "--- !!"), (None, docs[3][1]), (None, "wört1 C1"), docs[4], docs[4],
             (203, "c1 " * 5000 + "wört2"), (204, "C0c1 c2_c3-c4")]
    items = [(i, some(rng, common, 3) + " " + some(rng, rare, i % 5)) for i in range(12)]
    items += [(50, None), (51, ""), (52, "unknown"), (None, "wört3 wört3 c1"), items[2], (53, "c0 c0 c0 c1 wört1.wört2")]
    assert found(spark, docs, items, 4, postings=postings) == sorted(brute(docs, items, 4), key=key)
    assert found(spark, docs, items, 1000, postings=postings) == sorted(brute(docs, items, 1000), key=key)


def test_empty(spark):
    assert found(spark, [], [(1, "a")], 3) == []
    assert found(spark, [(1, "a")], [], 3) == []
    assert found(spark, [(1, None), (2, "!")], [(1, "a")], 3) == []


def test_blocks_are_left_packed(monkeypatch):
    """A block that cannot hold a winner is never unpacked."""
    rng = np.random.default_rng(1)
    docs = 20_000
    unpacked = Counter()
    plain = rs.Postings.unpack

    def counted(self, lo, hi, norm):
        unpacked[self.name] += hi - lo
        return plain(self, lo, hi, norm)

    monkeypatch.setattr(rs.Postings, "unpack", counted)
    ids, counts, terms, tfs, sizes = [], [], [], [], []
    for i in range(docs):
        held = {b"common": int(rng.integers(1, 4))} | ({b"rare": 5} if i % 500 == 0 else {})
        ids.append(i), counts.append(100), terms.extend(held), tfs.extend(held.values()), sizes.append(len(held))
    rows = rs.build_shard(0, ids, counts, terms, tfs, sizes, docs, docs * 100).to_pylist()
    lists = []
    for row in rows[:2]:
        p = rs.Postings(row | {"weight": 5 if row["term"] == b"common" else 6000})
        p.name = row["term"]
        lists.append((p, 1))
    norm = np.full(docs, 100)
    doc, score = rs.best_of(lists, norm, 10)
    assert len(doc) == 10 and all(d % 500 == 0 for d in doc)
    assert unpacked[b"common"] < 60 < len(lists[0][0].peak)
