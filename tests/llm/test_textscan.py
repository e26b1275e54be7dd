import random

import numpy as np
import pyarrow as pa

from orderlytics.llm.textscan import Scanner, shingles

TEXTS = ["", None, " ", "one", "One two", "x  y\tz\x0b\nw", "é è\xa0ü ñ", " a b a b ", "a" * 5000]


def test_words_and_positions(monkeypatch):
    seen = {}
    for block in (1, 20, 1 << 21):
        monkeypatch.setattr("orderlytics.llm.textscan.BLOCK", block)
        rng = random.Random(1)
        texts = TEXTS + [" ".join(rng.choices(["ab", "ba", "the", "Ünder", "a"], k=rng.randrange(30)))
                         for _ in range(50)]
        column = pa.array(["skipped", *texts])[1:]
        got = []
        for w in Scanner().blocks(column):
            for i in range(len(w.first) - 1):
                raw = (texts[w.lo + i] or "").encode()
                a, b = w.first[i:i + 2]
                words = [raw[s:e] for s, e in zip(w.start[a:b], w.end[a:b])]
                assert words == raw.split()
                got.append(i)
                for x, h in zip(words, w.hash[a:b]):
                    assert seen.setdefault(x, h) == h
        assert len(got) == len(texts)
    assert len(set(seen.values())) == len(seen)


def test_shingles_and_case():
    lower = {}
    for text in ["A b c D e", "a B c d", "b c", "C", "", "a b c d e"]:
        w = next(Scanner(lower=True).blocks(pa.array([text])))
        of, h = shingles(w, 4)
        words = text.lower().split()
        sets = [tuple(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        assert len(h) == len(sets) and not of.any()
        for s, x in zip(sets, h):
            assert lower.setdefault(s, x) == x
    assert len(set(lower.values())) == len(lower) and np.uint64(0) not in lower.values()
