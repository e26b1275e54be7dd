"""Passages that repeat across documents, exact or edited, by collinear chaining.

Winnowed k-word seeds are joined: each occurrence is linked to the seed's first one
(smallest document id and place), and so are runs of several seeds, whose first document is
often another: the one that holds the whole passage. Of the occurrences a task holds of
a seed, only the first looks for the seed's first of all; the others then join what it
found, an ordinary join that Spark splits where a seed is very common. So the links
are those of the table, however its rows are dealt. The links of two documents are chained: among links that ascend
in both texts, a Fenwick tree over places in the source finds each link's best
predecessor under a cost for the words passed over in either text. The diagonal
runs of a chain are then aligned word by word, extended at both ends while that
gains, and every stretch of runs that is long and similar enough is reported.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlytics.llm import scratch
from orderlytics.llm.textscan import Scanner, mix, pair, shingles, signed

#: Words of a seed; of this many seeds in a row, the one with the smallest hash is kept.
SEED, WINDOW = 5, 8
#: Consecutive kept seeds that are also keys, as one: the first document with a seed need
#: not have the words around it, the first with a long run of them has. About 18 and 36 words.
SPANS = (4, 8)
#: Shortest passage and least share of equal words.
WORDS, PERCENT = 50, 80
#: Cost of a word passed over in either text, as part of a seed's worth of SEED.
GAP = 0.15
#: Words by which a chain may grow at either end.
GROW = 64
#: Seeds among which a task looks for first occurrences at once.
UNIT = 1 << 20
#: Texts to a bucket of seeds, a few hundred thousand occurrences; a task takes one bucket after the other.
BUCKET = 1024


def _winnowed(words, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of the block, place, seed) of the seeds kept; a text of fewer than
    ``window`` seeds keeps all, one of fewer than ``k`` words has none."""
    counts = np.diff(words.first)
    full = counts >= k
    of, seed = shingles(words, k)
    long = full[of]
    of, seed = of[long], seed[long]
    each = np.where(full, counts - k + 1, 0)
    first = np.concatenate(([0], np.cumsum(each)))
    order = np.argsort(of, kind="stable")  # shingles() gives long texts in order already
    of, seed = of[order], seed[order]
    keep = each[of] < window
    n = len(seed) - window + 1
    if n > 0:
        low = np.lib.stride_tricks.sliding_window_view(seed, window).argmin(1) + np.arange(n)
        keep[low[of[:n] == of[window - 1:]]] = True
    at = np.flatnonzero(keep)
    return of[at], at - first[of[at]], seed[at]


def _spans(of: np.ndarray, place: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The kept seeds, and the runs of SPANS of them at the place of their first."""
    every = [(of, place, seed)]
    for m in SPANS:
        n = max(0, len(seed) - m + 1)
        key = np.full(n, m, np.uint64)
        for j in range(m):
            key = pair(key, seed[j:j + n])
        whole = of[:n] == of[len(of) - n:]
        every.append((of[:n][whole], place[:n][whole], key[whole]))
    return tuple(map(np.concatenate, zip(*every)))


def _packed(seed: np.ndarray, doc: np.ndarray, place: np.ndarray, more: np.ndarray) -> bytes:
    """Occurrences sorted by seed, compressed: the steps from seed to seed, documents and
    places, all their lowest bytes, then all the next ones, and so on."""
    step = np.diff(seed, prepend=np.uint64(0))
    columns = (step.astype("<u8"), 8), (doc.astype("<i8"), 8), (place.astype("<i4"), 4), (more.astype(np.uint8), 1)
    return pa.compress(b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(-1, n).T).tobytes() for c, n in columns),
                       "zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    planes = np.frombuffer(pa.decompress(data, 21 * n, "zstd", asbytes=True), np.uint8).reshape(21, n)
    step, doc, place = (np.ascontiguousarray(planes[lo:hi].T).view(kind).ravel() for lo, hi, kind in (
        (0, 8, "<u8"), (8, 16, "<i8"), (16, 20, "<i4")))
    return np.cumsum(step, dtype=np.uint64), doc, place, planes[20].astype(bool)


def _seeds(docs: DataFrame, k: int, window: int) -> DataFrame:
    """bucket, first, n, data: ``n`` occurrences in ``data``, packed. ``first``: each is
    the first of its seed among those that were looked at together; ``more``: there were
    others. The first ones are in the bucket of their seed, the others, which need not
    meet there, in one of their document."""
    # from the number of rows, so that a bucket's size depends on that of the texts alone
    buckets = max(scratch.partitions(docs.sparkSession), docs.count() // BUCKET)

    def bucket(hashes):
        return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)

    def emit(seed, doc, place):
        order = np.lexsort((place, doc, seed))
        seed, doc, place = seed[order], doc[order], place[order]
        new = np.ones(len(seed), dtype=bool)
        new[1:] = seed[1:] != seed[:-1]
        more = new & ~np.append(new[1:], True)
        rows = []
        for first in (True, False):
            at = np.flatnonzero(new == first)
            of = bucket(seed[at] if first else mix(doc[at].astype(np.uint64)))
            order = np.argsort(of, kind="stable")
            at, of = at[order], of[order]
            cuts = np.flatnonzero(np.diff(of, prepend=-1, append=-1))
            rows += [(int(of[lo]), first, int(hi - lo), _packed(seed[x], doc[x], place[x], more[x]))
                     for lo, hi in zip(cuts, cuts[1:]) for x in (at[lo:hi],)]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.bool_(), pa.int32(), pa.binary()))],
                              ["bucket", "first", "n", "data"])

    def scan(batches):
        scanner, waiting, size = Scanner(lower=True), [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for w in scanner.blocks(batch.column("text")):
                of, place, seed = _spans(*_winnowed(w, k, window))
                waiting.append((seed, ids[w.lo + of], place))
                size += len(seed)
                if size > UNIT:
                    yield from emit(*map(np.concatenate, zip(*waiting)))
                    waiting, size = [], 0
        if size:
            yield from emit(*map(np.concatenate, zip(*waiting)))

    return docs.mapInArrow(scan, "bucket int, first boolean, n int, data binary")


def _links(seeds: DataFrame) -> DataFrame:
    """doc, place, source, source_place: every occurrence in another document than the
    seed's first of all, with that one; stored."""
    def link(batches):
        waiting, last = [], None
        for batch in batches:
            for bucket, first, n, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "first", "n", "data"))):
                if waiting and bucket != last:
                    yield from linked(waiting)
                    waiting = []
                last = bucket
                if first:
                    waiting.append(_unpacked(data, n))
                else:  # what the others of a seed are joined by
                    seed, doc, place, _ = _unpacked(data, n)
                    yield from rows(2, seed, doc, place, np.zeros(n, np.int64), np.zeros(n, np.int32))
        if waiting:
            yield from linked(waiting)

    def linked(waiting):
        seed, doc, place, more = map(np.concatenate, zip(*waiting))
        order = np.lexsort((place, doc, seed))
        seed, doc, place, more = seed[order], doc[order], place[order], more[order]
        new = np.ones(len(seed), dtype=bool)
        new[1:] = seed[1:] != seed[:-1]
        heads = np.flatnonzero(new)[np.cumsum(new) - 1]
        for kind, at in (0, np.flatnonzero(doc[heads] != doc)), (1, np.flatnonzero(more)):  # links, what the others ask for
            yield from rows(kind, seed[at], doc[at], place[at], doc[heads[at]], place[heads[at]])

    def rows(kind, seed, *columns):
        for lo in range(0, len(seed), 1 << 16):
            part = [c[lo:lo + (1 << 16)] for c in (signed(seed), *columns)]
            yield pa.record_batch([pa.array(np.full(len(part[0]), kind, np.int8)), *map(pa.array, part)],
                                  ["kind", "seed", "doc", "place", "source", "source_place"])

    found = (seeds.repartition("bucket").sortWithinPartitions("bucket")
             .mapInArrow(link, "kind byte, seed long, doc long, place int, source long, source_place int"))
    found = scratch.table(found)
    columns = ["doc", "place", "source", "source_place"]
    # stored, as an aggregate beside the join would keep Spark from splitting a common seed
    firsts = scratch.table(found.where("kind = 1").groupBy("seed").agg(F.min(F.struct("source", "source_place")).alias("f")))
    others = found.where("kind = 2").select("seed", "doc", "place").join(firsts, "seed").select(
        "doc", "place", "f.source", "f.source_place").where("doc <> source")
    links = scratch.table(found.where("kind = 0").select(*columns).unionByName(others))
    scratch.drop(found, firsts)
    return links


def chains(place: np.ndarray, source: np.ndarray, worth: float = SEED, gap: float = GAP) -> list[np.ndarray]:
    """Links (sorted by place) of the best chain, of the best among the rest, and so
    on, while a chain has two links or more."""
    found, left = [], np.arange(len(place))
    while len(left) > 1:
        p, s = place[left], source[left]
        if (np.diff(p) > 0).all() and (np.diff(s) > 0).all():  # all in order: cut where a gap costs too much
            cost = gap * (np.diff(p) + np.diff(s))
            return found + [left[c] for c in np.split(np.arange(len(left)), np.flatnonzero(cost > 2 * worth) + 1) if len(c) > 1]
        rank = np.unique(s, return_inverse=True)[1] + 1
        tree: list = [(-1.0, -1)] * (int(rank.max()) + 1)
        score, back, by_place = [0.0] * len(p), [-1] * len(p), np.argsort(p, kind="stable")
        held: list[int] = []
        for i in by_place.tolist():
            while held and p[held[0]] < p[i]:  # links at the same place cannot follow each other
                j = held.pop(0)
                entry, r = (score[j] + gap * (float(p[j]) + float(s[j])) + 1.0, j), int(rank[j])
                while r < len(tree):
                    if tree[r] < entry:
                        tree[r] = entry
                    r += r & -r
            best, r = (-1.0, -1), int(rank[i]) - 1
            while r > 0:
                best = max(best, tree[r])
                r -= r & -r
            gain = best[0] - 1.0 - gap * (float(p[i]) + float(s[i])) + 0.0 if best[1] >= 0 else -1.0
            score[i], back[i] = (worth + gain, best[1]) if gain > 0 else (worth, -1)
            held.append(i)
        i = int(np.argmax(score))
        chain = []
        while i >= 0:
            chain.append(i)
            i = back[i]
        if len(chain) < 2:
            break
        found.append(left[chain[::-1]])
        left = np.delete(left, chain)
    return found


def _chained(links: DataFrame, k: int, least: int) -> DataFrame:
    """doc, source and runs of every chain that may grow to a passage; runs are
    (place, source place, length) of its diagonal stretches, as binary int32; a
    stretch without links parts them too."""
    def pair_chains(doc, source, place, source_place):
        new = np.ones(len(place), dtype=bool)  # a repeated row repeats its links, a span those of its seed
        new[1:] = (np.diff(place) != 0) | (np.diff(source_place) != 0)
        place, source_place = place[new], source_place[new]
        for chain in chains(place, source_place):
            p, s = place[chain].astype(np.int64), source_place[chain].astype(np.int64)
            if p[-1] + k - p[0] + 2 * GROW < least:
                continue
            cut = np.flatnonzero((np.diff(p - s) != 0) | (np.diff(p) > 2 * WINDOW)) + 1
            runs = [(r[0], q[0], r[-1] - r[0] + k) for r, q in zip(np.split(p, cut), np.split(s, cut))]
            yield doc, source, np.array(runs, "<i4").tobytes()

    def run(batches):
        waiting: list = []
        key = None
        for batch in batches:
            doc, place, source, source_place = (np.asarray(batch.column(c)) for c in ("doc", "place", "source", "source_place"))
            change = np.flatnonzero((doc[1:] != doc[:-1]) | (source[1:] != source[:-1])) + 1
            rows = []
            for lo, hi in zip([0, *change], [*change, len(doc)]):
                if hi == lo:
                    continue
                if key != (doc[lo], source[lo]):
                    if waiting:
                        rows += pair_chains(*key, *map(np.concatenate, zip(*waiting)))
                    key, waiting = (doc[lo], source[lo]), []
                waiting.append((place[lo:hi], source_place[lo:hi]))
            yield _rows(rows)
        if waiting:
            yield _rows(list(pair_chains(*key, *map(np.concatenate, zip(*waiting)))))

    def _rows(rows):
        return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                                pa.array([r[2] for r in rows], pa.binary())], ["doc", "source", "runs"])

    return (links.repartition("doc", "source").sortWithinPartitions("doc", "source", "place", "source_place")
            .mapInArrow(run, "doc long, source long, runs binary"))


def _word_table(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """node, words (32-bit hashes, binary) of the texts whose id is in ``ids``."""
    def scan(batches):
        scanner = Scanner(lower=True)
        for batch in batches:
            for w in scanner.blocks(batch.column("text")):
                rows = np.split((w.hash >> np.uint64(32)).astype("<u4"), w.first[1:-1])
                yield pa.record_batch([batch.column("doc_id").slice(w.lo, len(rows)),
                                       pa.array([r.tobytes() for r in rows], pa.binary())], ["node", "words"])

    found = docs.join(scratch.bounded(ids), "doc_id").mapInArrow(scan, "node long, words binary")
    return scratch.table(found.select("node", "words"))


def _grown(a: np.ndarray, b: np.ndarray) -> int:
    """How many of the words from here on to take in: as long as equal words pay for
    unequal ones (three to one)."""
    n = min(len(a), len(b), GROW)
    gain = np.cumsum(np.where(a[:n] == b[:n], 1, -3))
    return int(gain.argmax()) + 1 if n and gain.max() > 0 else 0


def pieces(doc: np.ndarray, source: np.ndarray, runs: np.ndarray, words: int, percent: int) -> list[tuple[int, int, int, int, int]]:
    """(start, end, source start, source end, equal words) of a chain's passages: the
    longest stretch from one run to another, grown at both ends, that has ``words``
    words and ``percent`` equal ones, and such stretches of what lies before and after
    it. Words on the runs' diagonals are compared; between two runs, those words are
    equal that stand so before or after the gap."""
    count = len(runs)
    # words of each run that lie after the one before it, and equal ones there and in the gap before
    inside, gap = np.zeros(count, np.int64), np.zeros(count, np.int64)
    starts, ends = runs[:, :2], runs[:, :2] + runs[:, 2:]
    tops = np.maximum.accumulate(ends, 0)
    whole = np.zeros(count, np.int64)
    for i, (p, s, n) in enumerate(runs):
        same = doc[p:p + n] == source[s:s + n]
        whole[i] = same.sum()
        overlap = 0
        if i:
            a, b = doc[tops[i - 1, 0]:p], source[tops[i - 1, 1]:s]
            if m := min(len(a), len(b)):
                ahead, behind = a[:m] == b[:m], a[len(a) - m:] == b[len(b) - m:]
                gap[i] = (np.concatenate(([0], np.cumsum(ahead))) + np.concatenate((np.cumsum(behind[::-1])[::-1], [0]))).max()
            overlap = max(0, *(tops[i - 1] - (p, s)))
        inside[i] = same[overlap:].sum()
    total = np.cumsum(inside + gap)
    grown = {}

    def before(i):
        if (i, 0) not in grown:
            p, s = starts[i]
            n = _grown(doc[max(0, p - GROW):p][::-1], source[max(0, s - GROW):s][::-1])
            grown[i, 0] = n, int((doc[p - n:p] == source[s - n:s]).sum())
        return grown[i, 0]

    def after(i):
        if (i, 1) not in grown:
            p, s = tops[i]
            n = _grown(doc[p:p + GROW], source[s:s + GROW])
            grown[i, 1] = n, int((doc[p:p + n] == source[s:s + n]).sum())
        return grown[i, 1]

    def stretch(i, j):
        """Bounds and equal words of the runs from i to each of j, grown."""
        (b, b_equal), a = before(i), np.array([after(x) for x in j])
        equal = whole[i] + total[j] - total[i] + b_equal + a[:, 1]
        return np.stack([np.full(len(j), starts[i, 0] - b), tops[j, 0] + a[:, 0],
                         np.full(len(j), starts[i, 1] - b), tops[j, 1] + a[:, 0], equal], 1)

    def good(x):
        n = np.maximum(x[:, 1] - x[:, 0], x[:, 3] - x[:, 2])
        return (x[:, 1] - x[:, 0] >= words) & (100 * x[:, 4] >= percent * n)

    found, left = [], [(0, count - 1)]
    while left:
        lo, hi = left.pop()
        if lo > hi or tops[hi, 0] - starts[lo, 0] + 2 * GROW < words:
            continue
        best = None
        for i in range(lo, hi + 1):
            if best is not None and tops[hi, 0] + GROW - starts[i, 0] + GROW <= best[0]:
                break  # those that begin later are shorter
            ends_at = np.arange(i, hi + 1)
            if i == lo and good(x := stretch(lo, ends_at[-1:]))[0]:
                best = (x[0, 1] - x[0, 0], lo, hi, x[0])
                break
            x = stretch(i, ends_at)
            if len(at := np.flatnonzero(good(x))):
                size = x[at, 1] - x[at, 0]
                k = int(size.argmax())
                if best is None or size[k] > best[0]:
                    best = (size[k], i, int(ends_at[at[k]]), x[at[k]])
        if best is not None:
            _, i, j, x = best
            found.append(tuple(int(v) for v in x))
            left += [(lo, i - 1), (j + 1, hi)]
    return sorted(found)


def passages(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, k: int = SEED, window: int = WINDOW,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per passage of ``words`` words or more that a document shares with an
    earlier one (smaller id): doc_id, start_word, end_word, source_id, source_start,
    source_end, n_words, similarity (equal words by the longer side; at least
    ``percent`` / 100). Case of A-Z does not count. A passage that several earlier
    documents hold is reported against the first that has it. The rows depend on the
    table alone, not on how it is dealt over tasks.

    Rows without id or text hold no passages, nor do repetitions within one text. Rows
    repeated with one id are one document: passages lie in one of their texts. An
    empty table gives an empty result."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    links = _links(_seeds(docs, k, window))
    found = scratch.table(_chained(links, k, words).withColumn("chain", F.monotonically_increasing_id()))
    table = _word_table(docs, scratch.table(
        found.select(F.col("doc").alias("doc_id")).union(found.select("source")).distinct()))
    both = (found.join(table.select(F.col("node").alias("source"), F.col("words").alias("there")), "source")
            .join(table.select(F.col("node").alias("doc"), F.col("words").alias("here")), "doc"))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                rows = []
                part = batch.slice(lo, 64)
                for chain, doc, source, runs, here, there in zip(*(part.column(c).to_pylist() for c in (
                        "chain", "doc", "source", "runs", "here", "there"))):
                    a, b = np.frombuffer(here, "<u4"), np.frombuffer(there, "<u4")
                    r = np.frombuffer(runs, "<i4").reshape(-1, 3).astype(np.int64)
                    if (r[:, 0] + r[:, 2]).max() > len(a) or (r[:, 1] + r[:, 2]).max() > len(b):
                        continue  # another text of a repeated id
                    for start, end, s0, s1, equal in pieces(a, b, r, words, percent):
                        rows.append((chain, zlib.crc32(there, zlib.crc32(here)), doc, start, end, source, s0, s1, end - start,
                                     equal / max(end - start, s1 - s0)))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(
                    zip(*rows) if rows else [[]] * 10, [pa.int64()] * 9 + [pa.float64()])],
                    ["chain", "texts", "doc_id", "start_word", "end_word", "source_id", "source_start", "source_end", "n_words", "similarity"])

    spans = both.mapInArrow(run, "chain long, texts long, doc_id long, start_word long, end_word long, source_id long, "
                                 "source_start long, source_end long, n_words long, similarity double")
    # a repeated row would repeat its passages
    once = Window.partitionBy("chain", "start_word", "end_word", "source_start").orderBy("source_end")
    return (spans.withColumn("_texts", F.min("texts").over(Window.partitionBy("chain"))).where("texts = _texts")
            .withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n", "_texts", "texts", "chain"))


def without_passages(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the words of their ``spans`` (of ``passages``) cut out of the text;
    rows that lose all their words are dropped. Other rows and columns stay."""
    cuts = scratch.table(spans.groupBy(F.col("doc_id").alias("_id")).agg(
        F.sort_array(F.collect_set(F.struct("start_word", "end_word"))).alias("_cuts"))
        .select("_id", F.col("_cuts.start_word").alias("_from"), F.col("_cuts.end_word").alias("_to")))
    joined = docs.join(scratch.bounded(cuts), docs[id_col].cast("long") == F.col("_id"), "left").drop("_id")
    schema = docs.schema

    def cut(batches):
        scanner = Scanner()
        for batch in batches:
            texts = batch.column(text_col)
            changed, keep = {}, np.ones(batch.num_rows, dtype=bool)
            hit = np.flatnonzero(np.asarray(batch.column("_from").is_valid()))
            for i in hit.tolist():
                starts, ends = batch.column("_from")[i].as_py(), batch.column("_to")[i].as_py()
                raw = (texts[i].as_py() or "").encode()
                w = next(scanner.blocks(texts.slice(i, 1)))
                gone = np.zeros(len(w.hash) + 1, dtype=bool)
                for a, b in zip(starts, ends):
                    gone[a:b] = True
                gone[-1] = False
                edge = np.append(w.start, len(raw))
                stops = np.flatnonzero(gone[:-1] != np.concatenate(([False], gone[:-2]))).tolist() if len(w.hash) else []
                if len(w.hash) and gone[len(w.hash) - 1]:
                    stops.append(len(w.hash))
                out, at = [], 0
                for a, b in zip(stops[::2], stops[1::2]):
                    out.append(raw[at:edge[a]])
                    at = edge[b]
                changed[i] = b"".join([*out, raw[at:]]).decode()
                keep[i] = not gone[:-1].all()
            if changed:
                column = texts.to_pylist()
                for i, text in changed.items():
                    column[i] = text
                texts = pa.array(column, texts.type)
            out = pa.record_batch([texts if c == text_col else batch.column(c) for c in schema.names], names=schema.names)
            yield out.filter(pa.array(keep))

    return joined.mapInArrow(cut, schema)
