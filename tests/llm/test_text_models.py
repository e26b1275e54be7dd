"""LM scores against counts by hand; toxicity and quality on held-out labels."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from orderlytics.llm import lm_score, quality, registry, toxicity
from orderlytics.llm.textscan import Scanner

SCHEMA = "doc_id long, text string, score double, ratio string"
ODD = [(1, None), (2, ""), (3, " \t"), (None, "a b"), (5, "x " * 20_000), (5, "x " * 20_000), (6, "A b  c\na B")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, "r") for i, t in rows], SCHEMA)


def by_hand(rows, target, ids):
    every = [(t or "").lower().split() for _, t in rows], [(t or "").lower().split() for _, t in target]
    count = Counter(w for c in every for t in c for w in t)
    assert len(count) <= ids - 2  # all words are in the vocabulary
    losses = {}
    for name, corpus in zip("bt", every):
        pairs = Counter((h, w) for t in corpus for h, w in zip([None, *t], t))
        heads, words = Counter(), Counter()
        for (h, w), n in pairs.items():
            heads[h] += n
            words[w] += n
        kinds = Counter(h for h, _ in pairs)
        total = sum(words.values())

        def loss(h, w, pairs=pairs, heads=heads, words=words, kinds=kinds, total=total):
            alone = (words[w] + 1) / (total + ids)
            back = 0.75 * kinds[h] / heads[h] if heads[h] else 1.0
            return -math.log((max(pairs[h, w] - 0.75, 0) / heads[h] if heads[h] else 0) + back * alone)
        losses[name] = loss
    out = []
    for i, t in rows:
        t = (t or "").lower().split()
        mean = [sum(losses[c](h, w) for h, w in zip([None, *t], t)) / max(1, len(t)) for c in "tb"]
        out.append((str(i), len(t), round(mean[0], 4), round(mean[1], 4)))
    return sorted(out)


def test_lm_score_by_hand(spark):
    target = [(1, "a b a"), (2, "c d e"), (3, None)]
    for rows in (ODD, []):
        out = lm_score.cross_entropy_difference(frame(spark, rows), frame(spark, target), frame(spark, rows), ids=64).collect()
        assert sorted((str(r["doc_id"]), r["n_tokens"], round(r["target_loss"], 4), round(r["background_loss"], 4))
                      for r in out) == by_hand(rows, target, 64)
        assert all(abs(r["score"] - (r["target_loss"] - r["background_loss"])) < 1e-9 for r in out)


def test_lm_score_learns_every_word(spark):
    """More words than any former cap of 2046; rare ones tell target from background,
    whether their pairs are broadcast or joined."""
    from orderlytics.llm import scratch
    target = [(i, f"common words with rare{i} rare{i} here") for i in range(1500)]
    back = [(i, f"common words with other{i} other{i} here") for i in range(1500)]
    docs = [(1, "rare7 rare7 here"), (2, "other7 other7 here"), (3, "rare8 other9 never seen"), (None, "rare7 rare7 here"), (4, None)]
    every = sorted(back + docs, key=str)
    want = by_hand(every, target, len({w for _, t in target + every for w in (t or "").split()}) + 2)
    for common, held in ((1 << 19, 500_000), (10, 100), (0, 500_000)):
        old, scratch.BROADCAST_ROWS = scratch.BROADCAST_ROWS, held
        try:
            docs_of = frame(spark, every)
            out = lm_score.cross_entropy_difference(docs_of, frame(spark, target), docs_of, common=common).collect()
            few = lm_score.cross_entropy_difference(
                frame(spark, [(i, f"common words with {t}") for i, t in docs]), frame(spark, target), frame(spark, back), common=common).collect()
        finally:
            scratch.BROADCAST_ROWS = old
        assert sorted((str(r["doc_id"]), r["n_tokens"], round(r["target_loss"], 4), round(r["background_loss"], 4)) for r in out) == want
        score = {r["doc_id"]: r["score"] for r in few}
        assert score[1] < 0 < score[2]


def test_lm_score_keeps_only_unusual_pairs(spark, monkeypatch):
    """Pairs that occur once, most of all, are not stored: all tables together are smaller than
    the texts. Scores are those by hand, with copies, and with words that are not broadcast,
    whether those that occur once are known or not."""
    import os

    from orderlytics.llm import scratch
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(f"word{x}" for x in rng.integers(0, 3000, 100))) for i in range(300)]
    rows += [(1000 + i, f"single{i} seen{i % 40} seen{i % 39} {rows[i][1]}") for i in range(60)] + [(5, rows[5][1])] * 3
    target = [(i, t) for i, (_, t) in enumerate(rows[:20])] + [(50, "seen1 seen2 single3 other")]
    want = by_hand(rows, target, 10_000)
    stored = []
    table = scratch.table

    def measured(df, *more):
        out = table(df, *more)
        folder = out.scratch_path.removeprefix("file:")
        stored.append(sum(os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder) if f.endswith(".parquet")))
        return out
    monkeypatch.setattr(scratch, "table", measured)
    for held, repeated, common in ((500_000, 1 << 22, 0), (50, 1 << 22, 100), (50, 0, 100), (0, 0, 1 << 19)):
        monkeypatch.setattr(scratch, "BROADCAST_ROWS", held)
        monkeypatch.setattr(lm_score, "REPEATED", repeated, raising=False)
        docs = frame(spark, rows)
        stored.clear()
        out = lm_score.cross_entropy_difference(docs, frame(spark, target), docs, ids=10_000, common=common).collect()
        assert sorted((str(r["doc_id"]), r["n_tokens"], round(r["target_loss"], 4), round(r["background_loss"], 4)) for r in out) == want
        if held == 500_000:
            assert sum(stored) < sum(len(t) for _, t in rows)


def kneser_ney_by_hand(texts, telling):
    """text -> mean log-likelihood ratio per word, with dictionaries of words."""
    runs = {c: {(b, h, w) for t, k in texts if k == c for b, h, w in zip([None, None, *t], [None, *t], t)} for c in (1, 0)}
    pairs = {c: Counter((h, w) for _, h, w in runs[c]) for c in runs}
    words = {c: Counter(w for _, w in pairs[c]) for c in runs}
    left = Counter(w for _, w in {*pairs[1], *pairs[0]})

    def stays(k, m, total):
        odds = total[1] / total[0]
        near = min(max(k / (k + m), odds / 4 / (1 + odds / 4)), odds * 4 / (1 + odds * 4))
        x = 2 * sum(a * math.log(a / (k + m) / p) for a, p in ((k, near), (m, 1 - near)) if a)
        return max(0.0, 1 - telling / x) if x > telling else 0.0

    sums = {c: sum(words[c].values()) for c in runs}

    def word(w):
        if not left[w]:
            return 0.0
        p = {c: (max(words[c][w] - 0.75, 0) + 0.75 * len(words[c]) * left[w] / sum(left.values())) / sums[c] for c in runs}
        return stays(words[1][w], words[0][w], sums) * math.log(p[1] / p[0])

    def one(h, w):
        k = {c: pairs[c][h, w] for c in runs}
        weight = stays(k[1], k[0], {c: sum(pairs[c].values()) for c in runs}) if any(k.values()) else 0.0
        p = {}
        for c in runs:
            n = sum(v for (a, _), v in pairs[c].items() if a == h)
            back = 0.75 * sum(a == h for a, _ in pairs[c]) / n if n else 1.0
            pooled = (words[1][w] + words[0][w]) / sum(sums.values())
            p[c] = max(k[c] - 0.75, 0) / max(1, n) + back * pooled * math.exp((word(w) if c else -word(w)) / 2)
        return weight * math.log(p[1] / p[0]) + (1 - weight) * word(w) if weight else word(w)

    return lambda t: sum(one(h, w) for h, w in zip([None, *t], t)) / max(1, len(t))


def test_toxicity_models_by_hand(spark):
    """Words, pairs and shrinkage of the model of all texts, and of those outside each fold."""
    rng = np.random.default_rng(5)
    texts = []
    for i in range(240):
        t = [f"w{x}" for x in rng.integers(0, 40, 25)]
        if i % 4 == 0:
            for at in rng.integers(0, 24, 3):
                t[at:at + 2] = ["bad", "thing"] if at % 2 else ["w1", f"rude{at % 5}"]
        texts.append((t, int(i % 4 == 0), i % 3))
    rows = [(" ".join(t), k, f) for t, k, f in texts] + [(None, 1, 0), ("", 0, 1)]
    counts = toxicity.Counts(spark.createDataFrame(rows, "text string, toxic int, fold int"))
    asked = [t for t, _, _ in texts[:12]] + [[], ["bad", "thing"], ["never", "seen", "bad"]]
    column = pa.array([" ".join(t) for t in asked])
    for fold in range(toxicity.FOLDS + 1):
        found = np.concatenate([toxicity.ratios(counts.model(fold, (0.5, 4.0)), w) for w in Scanner(lower=True).blocks(column)])
        for c, telling in enumerate((0.5, 4.0)):
            hand = kneser_ney_by_hand([(t, k) for t, k, f in texts if f != fold], telling)
            assert np.allclose(found[:, c], [hand(t) for t in asked], atol=1e-9)
        assert found[-2].min() > 0.5


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1), (6, 0)], "doc_id long, toxic int")
    for rows, some in ((ODD, labels), ([], labels), (ODD, labels.limit(0))):
        out = toxicity.toxicity(frame(spark, rows), some, F.lit(True)).collect()
        assert sorted(str(r["doc_id"]) for r in out) == sorted(str(i) for i, _ in rows)
        assert all(0 <= r["score"] <= 1 for r in out)


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1), (6, 0), (5, 1)], "doc_id long, quality int")
    for rows, some in ((ODD, labels), ([], labels), (ODD, labels.limit(0)), (ODD, labels.where("quality = 1"))):
        out = quality.quality(frame(spark, rows), some, F.lit(True)).collect()
        assert sorted(str(r["doc_id"]) for r in out) == sorted(str(i) for i, _ in rows)
        assert all(0 <= r["score"] <= 1 for r in out)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    out = {r["doc_id"]: r for r in registry.op3_toxicity(spark, d).collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(out[i]["held_out"] for i in held)
    toxic = [out[i]["predicted"] for i in held if labels[i]["toxic"]]
    clean = [out[i]["predicted"] for i in held if not labels[i]["toxic"]]
    assert np.mean(toxic) > 0.75 and np.mean(clean) < 0.01
    out = {r["doc_id"]: r for r in registry.op7_quality(spark, d).collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([out[i]["predicted"] == labels[i]["quality"] for i in held]) > 0.95
