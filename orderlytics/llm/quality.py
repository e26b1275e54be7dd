"""Quality by a sparse rule ensemble over text statistics.

Shallow boosted trees are grown on a bounded sample of labelled texts. Every path
from a root is a rule, a conjunction of bounds on statistics. A logistic model with
an L1 penalty keeps few rules, and those are compiled into one Spark column over
the statistics, which a scan of the texts computes.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlytics.llm import scratch
from orderlytics.llm.textscan import Scanner, pair, per_text, previous

#: Most labelled rows that the rules are fitted on, taken in the order of a hash of the id.
SAMPLE = 12_000
TREES, DEPTH, BINS, PENALTY = 40, 3, 32, 2e-4

STATS = ("words", "word_length", "upper", "digits", "symbols", "bars", "stops", "commas", "shouts",
         "repeats", "same_before", "same_pair", "top_word", "line_words", "non_ascii", "long_words")

Rule = tuple[tuple[int, bool, float], ...]  # (statistic, at most rather than above, bound)


def _share(marked: np.ndarray, at: np.ndarray) -> np.ndarray:
    return per_text(marked, at) / np.maximum(1, np.diff(at))


def _repeats(keys: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: share of the keys that occurred in it before, share of its commonest key."""
    n = np.diff(first)
    text = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((keys, text))
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]) | (text[order][1:] != text[order][:-1])
    start = np.flatnonzero(new)
    most = np.zeros(len(n))
    np.maximum.at(most, text[order][start], np.diff(np.append(start, len(keys))))
    return 1 - per_text(new, first) / np.maximum(1, n) * (n > 0) - (n == 0), most / np.maximum(1, n)


def measure(words) -> np.ndarray:
    """The statistics of a block's texts, one row each, in the order of STATS; shares
    of bytes or words, 0 for an empty text."""
    d, at, first = words.data, words.at, words.first
    n = np.diff(first)
    letter = ((d | 32) >= 97) & ((d | 32) <= 122)
    length = words.end - words.start
    repeats, top = _repeats(words.hash, first)
    pairs, _ = _repeats(pair(previous(words), words.hash), first)
    each = np.maximum(1, n)
    same = words.hash == previous(words)
    return np.stack([
        n, per_text(length, first) / each, _share(letter & (d < 97), at), _share((d >= 48) & (d <= 57), at),
        _share((d > 32) & (d < 127) & ~letter & ~((d >= 48) & (d <= 57)), at), _share(d == 124, at),
        per_text(d == 46, at) / each, per_text(d == 44, at) / each, per_text((d == 33) | (d == 63), at) / each,
        repeats, per_text(same, first) / each, pairs, top,
        n / (1 + per_text(d == 10, at)), _share(d >= 128, at), per_text(length > 14, first) / each], 1)


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and the statistics of the whole ``text`` of every row."""
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def scan(batches):
        scanner = Scanner()
        for batch in batches:
            rows = np.concatenate([np.zeros((0, len(STATS))), *map(measure, scanner.blocks(batch.column("text")))])
            yield pa.record_batch([*(batch.column(c) for c in keep), *map(pa.array, rows.T.copy())], names=[*keep, *STATS])

    return docs.select(*keep, "text").mapInArrow(scan, ", ".join([kinds, *(f"{s} double" for s in STATS)]))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> list[Rule]:
    """The paths of boosted regression trees on the logistic loss."""
    bounds = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(b, c) for b, c in zip(bounds, x.T)], 1)
    margin, rules = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), {}

    def split(rows, rule, level):
        p = 1 / (1 + np.exp(-margin[rows]))
        g, h = y[rows] - p, p * (1 - p)
        if rule:
            rules[rule] = None
        best = (1e-3, None, None)
        if level < depth:
            for j, b in enumerate(bounds):
                G, H = (np.cumsum(np.bincount(binned[rows, j], w, len(b) + 1)) for w in (g, h))
                gain = G[:-1] ** 2 / (H[:-1] + 1) + (G[-1] - G[:-1]) ** 2 / (H[-1] - H[:-1] + 1) - G[-1] ** 2 / (H[-1] + 1)
                if len(gain) and gain.max() > best[0]:
                    best = float(gain.max()), j, int(gain.argmax())
        if best[1] is None:
            step[rows] = 0.3 * g.sum() / (h.sum() + 1)
            return
        _, j, k = best
        low = binned[rows, j] <= k
        split(rows[low], (*rule, (j, True, float(bounds[j][k]))), level + 1)
        split(rows[~low], (*rule, (j, False, float(bounds[j][k]))), level + 1)

    for _ in range(trees):
        step = np.zeros(len(y))
        split(np.arange(len(y)), (), 0)
        margin = margin + step
    return list(rules)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(and_, ((x[:, j] <= b) == most for j, most, b in rule))


def lasso(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic model with an L1 penalty (accelerated
    proximal gradient)."""
    a = np.concatenate([x, np.ones((len(x), 1))], 1).astype(np.float32)
    v = np.ones(a.shape[1], np.float32)
    for _ in range(20):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    rate = 4 * len(a) / float(np.linalg.norm(a @ v) ** 2) / 1.05
    w = z = np.zeros(a.shape[1], np.float32)
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ z, -30, 30)))
        new = z - rate * (a.T @ (p - y)).astype(np.float32) / len(a)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * penalty, 0)
        t, s = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        z, w = new + np.float32((s - 1) / t) * (new - w), new
    return w[:-1].astype(float), float(w[-1])


def compiled(rules: list[Rule], weights: np.ndarray, intercept: float) -> Column:
    """The score as one Spark expression over the statistics."""
    z = F.lit(intercept)
    for rule, weight in zip(rules, weights):
        if weight:
            held = reduce(and_, ((F.col(STATS[j]) <= F.lit(b)) if most else (F.col(STATS[j]) > F.lit(b))
                                 for j, most, b in rule))
            z = z + F.when(held, F.lit(float(weight))).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-z))


def quality(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
            label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, score (0 to 1, higher: likelier label 1).

    The rules are fitted on at most ``sample`` rows of ``labels`` (id and 0/1 label;
    of several rows with one id the larger label counts, NULLs none) for which the
    condition ``learn`` holds. The score depends on the text alone; NULL texts equal
    empty ones and have all statistics 0. With one class only, every score is that
    class; without labels it is 0.5. NULL and repeated ids are scored as they come."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    chosen = scratch.table(
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(learn)
        .where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
        .withColumn("_order", F.xxhash64("doc_id")).orderBy("_order", "doc_id").limit(sample).drop("_order"))
    seen = statistics(docs.join(F.broadcast(chosen), "doc_id"), ["label"]).limit(4 * sample).toArrow()
    y = seen.column("label").to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return docs.select("doc_id", F.lit(float(y[0]) if len(y) else 0.5).alias("score"))
    x = np.stack([seen.column(s).to_numpy() for s in STATS], 1)
    rules = grow(x, y)
    weights, intercept = lasso(np.stack([holds(r, x) for r in rules], 1), y)
    return statistics(docs, ["doc_id"]).select("doc_id", compiled(rules, weights, intercept).alias("score"))
