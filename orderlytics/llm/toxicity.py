"""Toxicity by class-conditional Kneser-Ney bigram models.

One model of toxic and one of ordinary texts. Words and pairs of words count by
after how many different words they occur in a class, so that a text's copies add
nothing. Both models discount their own counts and back off: a pair to its second
word, a word to one distribution that the classes share. An expression's log-likelihood
ratio is shrunk towards what it backs off to, by the share 1 - telling / x of it that
stays, x being a likelihood ratio test on its counts: rare expressions count for
little, none is cut off at once. ``telling`` is chosen, and the difference of the
length-normalised log-likelihoods made a score by a logistic curve, on labelled texts
that the counts have not seen: each third of the texts is met by models of the others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlytics.llm import scratch
from orderlytics.llm.textscan import Scanner, Tally, find, pair, per_text, previous, signed

#: Most labelled rows that the models are fitted on, taken in the order of a hash of the id.
SAMPLE = 12_000
#: Values of ``telling`` to choose from, by the likelihood of texts that the counts have not seen.
TELLING = (3.0, 4.0, 6.0, 8.0, 12.0, 16.0)
#: Parts of the sample; each meets the models of the others.
FOLDS = 3
CLASSES = ["toxic", "ordinary"]
#: Odds this many times the general ones, or less, tell nothing: topics and languages differ so.
MARGIN = 4.0
DISCOUNT = 0.75
#: Ratios a word above this are told apart on a logarithmic scale.
SCALE = 0.01


def _counts(labelled: DataFrame) -> DataFrame:
    """head, word (hashes; head 0 at the start of a text), toxic_i, ordinary_i: after how
    many different words the pair occurs in texts of either class outside fold i; the
    last i, FOLDS, is for all texts."""
    def count(batches):
        scanner, tally = Scanner(lower=True), Tally()
        for batch in batches:
            labels, folds = (batch.column(c).to_numpy() for c in ("toxic", "fold"))
            for w in scanner.blocks(batch.column("text")):
                head = previous(w)
                before = np.r_[np.zeros(1, np.uint64), head[:-1]] * (head != 0)
                toxic, fold = (np.repeat(x[w.lo:w.lo + len(w.first) - 1], np.diff(w.first)) for x in (labels == 1, folds))
                fold = fold.astype(np.uint64)
                tally.add(pair(pair(pair(before, head), w.hash), fold), [toxic, ~toxic], (before, head, w.hash, fold))
        if merged := tally.merge():
            _, counts, keys = merged
            for i in range(0, len(keys[0]), 1 << 17):
                cut = slice(i, i + (1 << 17))
                yield pa.record_batch([*(pa.array(signed(x)[cut]) for x in keys), *(pa.array(x[cut] > 0) for x in counts)],
                                      ["before", "head", "word", "fold", *CLASSES])

    rows = labelled.mapInArrow(count, "before long, head long, word long, fold long, toxic boolean, ordinary boolean")
    seen = rows.groupBy("before", "head", "word").agg(
        *(F.bit_or(F.expr(f"IF({c}, shiftleft(1, CAST(fold AS INT)), 0)")).alias(c) for c in CLASSES))
    every = (1 << FOLDS) - 1
    return seen.groupBy("head", "word").agg(*(
        F.count_if(F.col(c).bitwiseAND(F.lit(every & ~(1 << i))) != 0).alias(f"{c}_{i}") for i in range(FOLDS + 1) for c in CLASSES))


def _surprise(toxic: Column, ordinary: Column, share: float) -> Column:
    """Twice the log-likelihood gained by giving the expression a toxic share of its
    own, rather than the nearest one whose odds are within MARGIN times those of
    ``share``, that of all."""
    n = toxic + ordinary
    odds = share / (1 - share)
    low, high = (F.lit(o / (1 + o)) for o in (odds / MARGIN, odds * MARGIN))
    near = F.greatest(low, F.least(high, toxic / n))

    def part(k, p):
        return F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0)
    return 2 * (part(toxic, near) + part(ordinary, 1 - near))


def ratios(arrays: tuple[np.ndarray, ...], words) -> np.ndarray:
    """Per text and column of the model: log-likelihood under the toxic model less that
    under the ordinary one, per word; 0 for a text without words.

    A model is the sorted hashes of its words and pairs, far fewer than the sample has
    tokens, each with its ratios and a last row of zeros."""
    known, word_ratio, pairs, pair_ratio = arrays
    w, p = find(known, words.hash), find(pairs, pair(previous(words), words.hash))
    n = np.maximum(1, np.diff(words.first))
    return np.stack([per_text(np.where(p < len(pairs), pair_ratio[p, c], word_ratio[w, c]), words.first) / n
                     for c in range(word_ratio.shape[1])], 1)


class Counts:
    """Stored counts of the sample, from which the model of any choice of folds follows."""

    def __init__(self, labelled: DataFrame):
        self.pairs = scratch.table(_counts(labelled))
        name = [(i, c, f"{c}_{i}") for i in range(FOLDS + 1) for c in CLASSES]
        self.words = scratch.table(self.pairs.groupBy("word").agg(
            *(F.count_if(F.col(x) > 0).alias(x) for _, _, x in name),
            *(F.count_if(F.col(f"toxic_{i}") + F.col(f"ordinary_{i}") > 0).alias(f"left_{i}") for i in range(FOLDS + 1))))
        self.heads = scratch.table(self.pairs.groupBy("head").agg(
            *(F.sum(x).alias(f"head_{x}") for _, _, x in name), *(F.count_if(F.col(x) > 0).alias(f"kinds_{x}") for _, _, x in name)))
        self.sums = self.pairs.agg(*(F.sum(x).alias(x) for _, _, x in name)).first()
        self.total = self.words.agg(*(F.sum(x).alias(x) for _, _, x in name), *(F.count_if(F.col(x) > 0).alias(f"kinds_{x}") for _, _, x in name),
                                    *(F.sum(f"left_{i}").alias(f"left_{i}") for i in range(FOLDS + 1))).first()

    def model(self, i: int, telling: tuple[float, ...]) -> tuple[np.ndarray, ...]:
        """The model of the texts outside fold ``i``, a column for each of ``telling``."""
        names = [f"{c}_{i}" for c in CLASSES]
        if not all(self.total[x] for x in names):
            return (np.zeros(0, np.uint64), np.zeros((1, len(telling)))) * 2
        n = np.array([self.total[x] for x in names], float)

        def told(df, totals):
            share = float(totals[names[0]] / (totals[names[0]] + totals[names[1]]))
            toxic, ordinary = (F.col(x) for x in names)
            return (df.where(toxic + ordinary > 0).withColumn("surprise", _surprise(toxic, ordinary, share))
                    .where(F.col("surprise") > min(telling)))

        def kept(surprise):
            return np.maximum(0.0, 1 - np.array(telling) / surprise[:, None])

        found = _columns(told(self.words, self.total).select("word", *names, f"left_{i}", "surprise"))
        own = [(np.maximum(found[x] - DISCOUNT, 0) + DISCOUNT * self.total[f"kinds_{x}"] * found[f"left_{i}"] / self.total[f"left_{i}"]) / m
               for x, m in zip(names, n)]
        lower = kept(found["surprise"]) * np.log(own[0] / own[1])[:, None]
        order = np.argsort(found["word"])
        known, lower = found["word"][order], np.vstack([lower[order], np.zeros((1, len(telling)))])

        pooled = self.words.select("word", (F.col(names[0]) + F.col(names[1])).alias("pooled"))
        col = _columns(told(self.pairs, self.sums).select("head", "word", *names, "surprise")
                       .join(self.heads.select("head", *(f"{k}_{x}" for k in ("head", "kinds") for x in names)), "head").join(pooled, "word"))
        base, p = lower[find(known, col["word"])], []
        for x, sign in zip(names, (0.5, -0.5)):
            follow = np.maximum(1, col[f"head_{x}"])
            back = np.where(col[f"head_{x}"] > 0, DISCOUNT * col[f"kinds_{x}"] / follow, 1.0)
            p.append((np.maximum(col[x] - DISCOUNT, 0) / follow)[:, None] + (back * col["pooled"] / n.sum())[:, None] * np.exp(sign * base))
        stays = kept(col["surprise"])
        ratio = stays * np.log(p[0] / p[1]) + (1 - stays) * base
        code = pair(col["head"], col["word"])
        order = np.argsort(code)
        return known, lower, code[order], np.vstack([ratio[order], np.zeros((1, len(telling)))])


def _columns(df: DataFrame) -> dict[str, np.ndarray]:
    """A table bounded by the sample as numpy columns; hashes unsigned."""
    found = df.toArrow()
    return {c: found.column(c).to_numpy().astype(np.int64).view(np.uint64) if c in ("head", "word")
            else found.column(c).to_numpy().astype(float) for c in found.column_names}


def _ratios(docs: DataFrame, models: list[tuple[np.ndarray, ...]], keep: list[str], fold: str | None = None) -> DataFrame:
    """``keep`` and _ratios, an array; a row's model is that of the number in ``fold``, or the first."""
    # bounded by the sample; plain arrays, as a broadcast is read without this library
    shared = docs.sparkSession.sparkContext.broadcast(models)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def score(batches):
        scanner = Scanner(lower=True)
        for batch in batches:
            found = np.zeros((batch.num_rows, shared.value[0][1].shape[1]))
            folds = batch.column(fold).to_numpy() if fold else np.zeros(batch.num_rows, int)
            for w in scanner.blocks(batch.column("text")):
                here = slice(w.lo, w.lo + len(w.first) - 1)
                for f in np.unique(folds[here]):
                    found[here][folds[here] == f] = ratios(shared.value[f], w)[folds[here] == f]
            each = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))
            yield pa.record_batch([*(batch.column(c) for c in keep), each], names=[*keep, "_ratios"])

    needed = dict.fromkeys([*keep, "text", *([fold] if fold else [])])
    return docs.select(*needed).mapInArrow(score, f"{kinds}, _ratios array<double>")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4) -> tuple[float, float, float, float]:
    """(mean, deviation, slope, intercept) of P(y = 1) against the standardised x."""
    mean, deviation = float(x.mean()), float(x.std()) or 1.0
    a = np.stack([(x - mean) / deviation, np.ones(len(x))], 1)
    at, pull = np.zeros(2), np.array([ridge * len(x), 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ at, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(pull), a.T @ (p - y) + pull * at)
        at -= np.clip(step, -2, 2)
    return mean, deviation, float(at[0]), float(at[1])


def _misfit(x: np.ndarray, y: np.ndarray, curve: tuple[float, float, float, float]) -> float:
    """Mean negative log-likelihood of ``y`` under the curve."""
    mean, deviation, slope, intercept = curve
    z = (x - mean) / deviation * slope + intercept
    return float(np.mean(np.logaddexp(0, z) - y * z))


def toxicity(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic", sample: int = SAMPLE, telling: tuple[float, ...] = TELLING,
             keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, score (0 to 1, higher: likelier toxic), and
    the columns ``keep`` of ``docs``, with the text under the name "text".

    The models learn from at most ``sample`` rows of ``labels`` (id and 0/1 label;
    of several rows with one id the larger label counts, NULLs none) for which the
    condition ``learn`` holds; one of ``telling`` and the curve are those under which
    the sample's labels are likeliest, each of its folds seen by the models of the others. The
    score depends on the text alone. NULL texts equal empty ones, which get the
    curve's value at 0. Without labelled rows of both classes every score is 0. NULL
    ids are scored and never learnt from; repeated rows are scored each."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       *(c for c in keep if c not in (id_col, text_col)))
    carried = list(dict.fromkeys(["doc_id", *(c for c in keep if c not in (id_col, text_col)), *(["text"] if text_col in keep else [])]))
    chosen = scratch.table(
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where(learn)
        .where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .withColumn("_order", F.xxhash64("doc_id")).orderBy("_order", "doc_id").limit(sample))
    part = F.broadcast(chosen.withColumn("fold", F.pmod(F.shiftright("_order", 8), F.lit(FOLDS)).cast("int")).drop("_order"))
    labelled = docs.select("doc_id", "text").join(part, "doc_id").select("text", "toxic", "fold")  # at most ``sample`` rows are broadcast
    counts = Counts(labelled)
    models = [counts.model(i, telling) for i in range(FOLDS)]
    seen = _ratios(labelled, models, ["toxic"], "fold").limit(4 * sample).toArrow().to_pydict()
    y = np.array(seen["toxic"], float)
    if not 0 < y.sum() < len(y):
        return docs.select(*carried, F.lit(0.0).alias("score"))
    x = np.arcsinh(np.array(seen["_ratios"], float) / SCALE)
    curves = [logistic(c, y) for c in x.T]
    best = int(np.argmin([_misfit(c, y, curve) for c, curve in zip(x.T, curves)]))
    mean, deviation, slope, intercept = curves[best]
    found = _ratios(docs, [counts.model(FOLDS, telling[best:best + 1])], carried)
    z = (F.asinh(F.col("_ratios")[0] / F.lit(SCALE)) - F.lit(mean)) / F.lit(deviation) * F.lit(slope) + F.lit(intercept)
    return found.select(*carried, (1 / (1 + F.exp(-z))).alias("score"))
