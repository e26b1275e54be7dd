import random

import numpy as np

from orderlytics.llm import substring_dedup as sub

SCHEMA = "doc_id long, text string, start_word int, words string"


def make(seed=1):
    rng = random.Random(seed)
    def fresh(n):
        return [f"{rng.choice('abcdef')}{rng.randrange(100000)}" for _ in range(n)]
    passage = fresh(80)
    rows = [(i, fresh(rng.randrange(30, 200))) for i in range(30)]
    planted = {}
    for i in (4, 9, 17, 23, 28):
        text, at = rows[i][1], rng.randrange(10, 20)
        copy = list(passage)
        if i in (17, 23):  # edited: substitutions, then a word dropped and one put in
            for j in (20, 41, 62):
                copy[j] = "changed" + str(i)
            if i == 23:
                del copy[50]
                copy.insert(30, "new")
        text[at:at] = copy
        planted[i] = (at, at + len(copy))
    rows.append((50, list(rows[0][1])))  # a whole copy
    return rows, planted


def test_finds_planted_passages_and_nothing_else(spark):
    rows, planted = make()
    texts = [(i, " ".join(w) if i % 2 else "\n".join(w).upper()) for i, w in rows]
    texts += [(None, texts[4][1]), (60, None), (61, ""), (62, "  "), (63, "a b"), texts[5]]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in texts], SCHEMA)
    out = sub.passages(df).collect()
    long_copy = len(rows[0][1]) >= sub.WORDS
    assert {r["doc_id"] for r in out} == {9, 17, 23, 28} | ({50} if long_copy else set())
    covered = {}
    for r in out:
        assert r["source_id"] < r["doc_id"] and r["similarity"] >= 0.8 and r["n_words"] >= 50
        covered.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    for i in (9, 17, 23, 28):
        a, b = planted[i]
        assert len(covered[i] & set(range(a, b))) >= 0.95 * (b - a) and covered[i] <= set(range(a - 2, b + 2))
    cut = {r["doc_id"]: r for r in sub.without_passages(df.where("doc_id < 55"), sub.passages(df)).collect()}
    assert set(cut[9]["text"].split()) == set(dict(texts)[9].split()[:planted[9][0]] + dict(texts)[9].split()[planted[9][1]:])
    assert (50 in cut) != long_copy


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert sub.passages(df).collect() == []
    assert sub.without_passages(df, sub.passages(df)).columns == df.columns


def brute_chain(p, s, worth, gap):
    best = [worth] * len(p)
    for i in range(len(p)):
        for j in range(len(p)):
            if p[j] < p[i] and s[j] < s[i]:
                best[i] = max(best[i], worth + best[j] - gap * (p[i] - p[j] + s[i] - s[j]))
    return max(best)


def test_chains_are_optimal():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n = int(rng.integers(2, 40))
        p, s = np.sort(rng.integers(0, 60, n)), rng.integers(0, 60, n)
        found = sub.chains(p, s, 5, 0.15)
        want = brute_chain(p.tolist(), s.tolist(), 5, 0.15)
        if not found:
            assert want == 5
            continue
        if (np.diff(p) > 0).all() and (np.diff(s) > 0).all():
            continue
        c = found[0]
        assert (np.diff(p[c]) > 0).all() and (np.diff(s[c]) > 0).all()
        score = 5 * len(c) - 0.15 * (p[c][-1] - p[c][0] + s[c][-1] - s[c][0])
        assert abs(score - want) < 1e-9


def test_seeds_of_a_shared_run_are_shared():
    import pyarrow as pa
    from orderlytics.llm.textscan import Scanner
    shared = " ".join(f"w{i}" for i in range(12))  # WINDOW seeds
    kept = [set(sub._winnowed(next(Scanner().blocks(pa.array([t]))), sub.SEED, sub.WINDOW)[2].tolist())
            for t in (f"x y z {shared} q", f"{shared} other end of text here", "one two")]
    assert kept[0] & kept[1] and not kept[2]


def test_finds_both_passages_at_any_distance(spark):
    """Two exact passages in one pair of texts, with other words between them in one
    text or in both; alone, or with a link that crosses."""
    rng = random.Random(5)
    def fresh(n):
        return [f"{rng.choice('abcdef')}{rng.randrange(1000000)}" for _ in range(n)]
    rows, planted = [], {}
    for case, (n, there, here, cross) in enumerate([
            (n, there, here, cross) for n in (52, 60) for cross in (False, True)
            for there, here in ((30, 0), (0, 40), (60, 60), (90, 90), (60, 20), (300, 300))]):
        one, two, odd = fresh(n), fresh(n), fresh(12)
        extra = odd if cross else []
        first = extra + fresh(9) + one + fresh(there) + two + fresh(9)
        second = fresh(9) + one + fresh(here) + two + fresh(9) + extra
        rows += [(2 * case, " ".join(first)), (2 * case + 1, " ".join(second))]
        planted[2 * case + 1] = set(range(9, 9 + n)) | set(range(9 + n + here, 9 + 2 * n + here))
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows + rows[:2]], SCHEMA)
    covered = {}
    out = sub.passages(df).collect()
    for r in out:
        assert r["similarity"] >= 0.8 and r["n_words"] >= 50 and r["source_id"] == r["doc_id"] - 1
        covered.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    for i, places in planted.items():
        assert len(places - covered.get(i, set())) == 0, (i, len(places), len(covered.get(i, ())))
    assert len(out) == len({tuple(r) for r in out})


def longest_common(a, b):
    """Length of the longest common run of words, by brute force."""
    best, row = 0, [0] * (len(b) + 1)
    for u in a:
        row = [0] + [row[j] + 1 if u == v else 0 for j, v in enumerate(b)]
        best = max(best, *row)
    return best


def test_recombined_lines(spark):
    """Lines that stand alone in early documents, then together in two later ones: the
    second of these shares them all with the first."""
    rng = random.Random(11)
    def fresh(n):
        return [f"{rng.choice('abcdef')}{rng.randrange(1000000)}" for _ in range(n)]
    rows, joint = [], []
    for lines, length in [(2, 40)] * 12 + [(3, 40)] * 6 + [(4, 40)] * 6 + [(2, 30)] * 12 + [(3, 20)] * 12:
        parts = [fresh(length) for _ in range(lines)]
        rows += [fresh(5) + part + fresh(5) for part in parts]
        joint += [(fresh(6) + sum(parts, []) + fresh(6), lines * length, len(joint)) for _ in range(2)]
    texts = {i: w for i, w in enumerate(rows + [j[0] for j in joint])}
    df = spark.createDataFrame([(i, " ".join(w), 1, "x") for i, w in texts.items()], SCHEMA)
    covered = {}
    for r in sub.passages(df).collect():
        covered.setdefault((r["doc_id"], r["source_id"]), set()).update(range(r["start_word"], r["end_word"]))
    for at in range(1, len(joint), 2):
        i = len(rows) + at
        assert longest_common(texts[i], texts[i - 1]) == joint[at][1]
        found = covered.get((i, i - 1), set())
        assert set(range(6, 6 + joint[at][1])) <= found, (at, joint[at][1], len(found))


def test_rows_do_not_depend_on_the_layout(spark, monkeypatch):
    """The same rows for 1, 3 and 16 partitions, and for any number of seeds at once."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")

    def rows(parts):
        return sorted(map(tuple, sub.passages(df.repartition(parts)).collect()))

    one = rows(1)
    assert len(one) > 5
    assert rows(3) == one
    monkeypatch.setattr(sub, "UNIT", 500)
    assert rows(16) == one


def test_seeds_are_shuffled_packed(spark):
    """The shuffled bytes of an occurrence are fewer than those of its seed, document and place."""
    rng = np.random.default_rng(3)
    n = 1 << 16
    seed = np.sort(rng.integers(0, 1 << 64, n, dtype=np.uint64))
    doc, place, more = rng.integers(10**6, 10**6 + 3000, n), rng.integers(0, 800, n).astype(np.int32), rng.random(n) < 0.1
    data = sub._packed(seed, doc, place, more)
    assert len(data) < 12 * n
    for a, b in zip(sub._unpacked(data, n), (seed, doc, place, more)):
        assert (a == b).all()
    odd = np.array([0, 5, 5, 2**64 - 1], np.uint64), np.array([-2**63, 2**63 - 1, -1, 0]), np.array([0, 1, 2**31 - 1, 3], np.int32)
    for a, b in zip(sub._unpacked(sub._packed(*odd, np.ones(4, bool)), 4), odd):
        assert (a == b).all()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").coalesce(1)
    got = sub._seeds(docs, sub.SEED, sub.WINDOW).agg({"n": "sum"}).first()[0], sub._seeds(docs, sub.SEED, sub.WINDOW).collect()
    assert sum(len(r["data"]) for r in got[1]) < 14 * got[0]
