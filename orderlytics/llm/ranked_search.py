"""Ranked lexical search over a sharded inverted index, by Block-Max MaxScore.

A shard is a run of documents that one task reads, bounded in postings. Its index has a
row per term: the posting list in blocks, packed as differences of document numbers and
counts in the fewest bytes, and beside it, unpacked, the first and last document of
every block, the greatest impact in it and the greatest of the list.

A task searches one shard for a block of items. The terms of an item are sorted by
their greatest possible share of a score; the leading ones that together cannot pass
the k-th score found are non-essential. Documents come from the essential lists only,
window after window. The block maxima of the non-essential lists then reject those that
cannot get in; blocks are unpacked only where one of the documents left may lie. The
best of all shards are merged.

Impacts are integers, so the scores are exact whatever the order of the sums.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlytics.llm import scratch
from orderlytics.llm.textscan import release

#: A term: letters and digits of ASCII, and all that is not ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Postings of a block; postings and documents of a shard; items that a task searches for.
BLOCK, POSTINGS, DOCS, ITEMS = 128, 1_500_000, 1 << 16, 4096
#: Documents of the first window; each is twice the one before.
WINDOW = 512
_TO_TERMS = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))
_INDEX = ("shard long, term binary, n long, top long, first binary, last binary, peak binary, doc_bytes int, "
          "tf_bytes int, packed binary")


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, A-Z as a-z."""
    return text.translate(_TO_TERMS).split()


def _packed(values: np.ndarray, at: np.ndarray, width: np.ndarray, out: np.ndarray) -> None:
    """Write the lowest ``width`` bytes of each value at its place in ``out``."""
    for byte in range(4):
        some = width > byte
        out[at[some] + byte] = (values[some] >> (8 * byte)) & 255


def _width(most: np.ndarray) -> np.ndarray:
    return np.where(most < 256, 1, np.where(most < 65536, 2, 4))


def build_shard(shard: int, ids: list, counts: list[int], terms: list[bytes], tfs: list[int], sizes: list[int],
                docs: int, total: int) -> pa.RecordBatch:
    """Index rows of one shard; the row without term holds the documents: their ids,
    whether they have one, and their length norms."""
    missing = np.array([i is None for i in ids], bool)
    number = np.array([0 if i is None else i for i in ids], np.int64)
    order = np.lexsort((number, missing))        # documents without id last
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    norm = np.array([25 + (75 * n * docs) // total for n in counts], np.int64)[order]
    names = sorted(set(terms))
    known = dict(zip(names, range(len(names))))
    term = np.fromiter(map(known.__getitem__, terms), np.int64, len(terms))
    doc, tf = np.repeat(place, sizes), np.array(tfs, np.int64)
    by = np.argsort(term * len(ids) + doc)
    term, doc, tf = term[by], doc[by], tf[by]
    impact = (1_000_000_000 * tf) // (1000 * tf + 8 * norm[doc])
    start = np.searchsorted(term, np.arange(len(names) + 1))
    n = np.diff(start)
    within = np.arange(len(term)) - start[term]
    head = within % BLOCK == 0
    delta = np.where(head, 0, np.diff(doc, prepend=0))
    heads = np.flatnonzero(head)
    blocks = np.searchsorted(term[heads], np.arange(len(names) + 1))
    ends = np.r_[heads[1:], len(term)] - 1
    peak = np.maximum.reduceat(impact, heads) if len(heads) else heads
    top = np.maximum.reduceat(impact, start[:-1]) if len(names) else n
    doc_w = _width(np.maximum.reduceat(delta, start[:-1])) if len(names) else n
    tf_w = _width(np.maximum.reduceat(tf, start[:-1])) if len(names) else n
    at = np.r_[0, np.cumsum(n * (doc_w + tf_w))]
    out = np.zeros(at[-1], np.uint8)
    _packed(delta, at[term] + within * doc_w[term], doc_w[term], out)
    _packed(tf, at[term] + (n * doc_w)[term] + within * tf_w[term], tf_w[term], out)

    def binary(values: np.ndarray, cuts: np.ndarray, more: bytes) -> pa.Array:
        data = values.tobytes() + more
        return pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(np.r_[
            cuts * values.itemsize, len(data)].astype(np.int32).tobytes()), pa.py_buffer(data)])

    table = number[order].tobytes() + missing[order].tobytes() + norm.tobytes()
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(len(names) + 1, shard)), pa.array([*names, None], pa.binary()), pa.array(np.r_[n, len(ids)]),
        pa.array(np.r_[top, 0]), binary(doc[heads].astype(np.int32), blocks, b""),
        binary(doc[ends].astype(np.int32), blocks, b""), binary(peak.astype(np.int32), blocks, b""),
        pa.array(np.r_[doc_w, 0], pa.int32()), pa.array(np.r_[tf_w, 0], pa.int32()), binary(out, at, table),
    ], names=["shard", "term", "n", "top", "first", "last", "peak", "doc_bytes", "tf_bytes", "packed"])


class Postings:
    """One term's list in a shard, unpacked by ranges of blocks."""

    def __init__(self, row: dict):
        self.n, self.weight, self.top = row["n"], row["weight"], row["top"]
        self.first, self.last, self.peak = (np.frombuffer(row[c], np.int32).astype(np.int64) for c in ("first", "last", "peak"))
        cut = self.n * row["doc_bytes"]
        self.delta = np.frombuffer(row["packed"], f"<u{row['doc_bytes']}", self.n)
        self.tf = np.frombuffer(row["packed"], f"<u{row['tf_bytes']}", self.n, cut)

    def unpack(self, lo: int, hi: int, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of the blocks ``lo`` to ``hi - 1``."""
        part = slice(lo * BLOCK, min(self.n, hi * BLOCK))
        run = np.cumsum(self.delta[part], dtype=np.int64)
        block = np.arange(len(run)) // BLOCK
        doc = run - run[::BLOCK][block] + self.first[lo:hi][block]
        tf = self.tf[part].astype(np.int64)
        return doc, (1_000_000_000 * tf) // (1000 * tf + 8 * norm[doc])

    def bound(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block each document would be in, and the greatest impact there; 0 between blocks."""
        block = np.searchsorted(self.last, doc)
        inside = block < len(self.last)
        inside[inside] = self.first[block[inside]] <= doc[inside]
        return block, np.where(inside, self.peak[np.minimum(block, len(self.peak) - 1)], 0)


def best_of(lists: list[tuple[Postings, int]], norm: np.ndarray, k: int, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Documents and scores of the ``k`` best with a score above 0, equal scores by
    ascending document. ``lists``: each term's list and how often the item has it."""
    lists = sorted(((p.weight * times, p) for p, times in lists if p.weight), key=lambda x: x[0] * x[1].top)
    reach = np.cumsum([weight * p.top for weight, p in lists])
    best, scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    at = 0
    while at < len(norm):
        end = min(len(norm), at + window)
        essential = int(np.searchsorted(reach, least, "right"))
        if essential == len(lists):
            break
        sums = np.zeros(end - at, np.int64)
        for weight, p in lists[essential:]:
            lo, hi = np.searchsorted(p.last, at), np.searchsorted(p.first, end)
            if lo < hi:
                doc, impact = p.unpack(lo, hi, norm)
                a, b = np.searchsorted(doc, [at, end])
                sums[doc[a:b] - at] += weight * impact[a:b]
        doc = np.flatnonzero(sums)
        score, doc = sums[doc], doc + at
        bounds = []
        rest = np.zeros(len(doc), np.int64)
        for weight, p in lists[:essential]:
            block, most = p.bound(doc)
            bounds.append([block, weight * most])
            rest += weight * most
        for i in range(essential - 1, -1, -1):
            good = score + rest > least
            if not good.all():
                doc, score, rest = doc[good], score[good], rest[good]
                bounds = [[block[good], most[good]] for block, most in bounds[:i + 1]]
            (weight, p), (block, most) = lists[i], bounds[i]
            rest = rest - most
            hit = np.flatnonzero(most)
            for b in np.unique(block[hit]):
                of, impact = p.unpack(b, b + 1, norm)
                mine = hit[block[hit] == b]
                found = np.searchsorted(of, doc[mine])
                found[found == len(of)] = 0
                score[mine] += np.where(of[found] == doc[mine], weight * impact[found], 0)
        good = score > least
        if good.any():
            best, scores = np.concatenate([best, doc[good]]), np.concatenate([scores, score[good]])
            top = np.lexsort((best, -scores))[:k]
            best, scores = best[top], scores[top]
            least = int(scores[-1]) if len(top) == k else 0
        at, window = end, 2 * window
    return best, scores


class Index:
    """The stored index of ``docs``, whole texts of all rows."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", postings: int = POSTINGS):
        text = F.coalesce(F.col(text_col), F.lit(""))
        sizes = docs.select(F.regexp_count(text, F.lit(TERM)).cast("long").alias("n"))
        self.docs, self.total = sizes.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        n_docs, total = self.docs, self.total

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext
            shard, held = TaskContext.get().partitionId() << 24, ([], [], [], [], [])
            ids, counts, terms, tfs, sizes = held
            for batch in batches:
                for key, words in zip(batch.column("id").to_pylist(), batch.column("text")):
                    words = terms_of(words.as_buffer().to_pybytes())
                    if not words:
                        continue
                    found = Counter(words)
                    ids.append(key)
                    counts.append(len(words))
                    terms.extend(found)
                    tfs.extend(found.values())
                    sizes.append(len(found))
                    if len(terms) >= postings or len(ids) == DOCS:
                        yield build_shard(shard, *held, n_docs, total)
                        shard += 1
                        for column in held:
                            column.clear()
                        release()
            if ids:
                yield build_shard(shard, *held, n_docs, total)
            release()

        rows = docs.select(F.col(id_col).cast("long").alias("id"), text.cast("binary").alias("text"))
        self.table = scratch.table(rows.mapInArrow(build, _INDEX))

    def search(self, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
        """item_id, rank (from 1), doc_id, score: see ``ranked``."""
        asked = scratch.table(items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"),
                                           F.monotonically_increasing_id().alias("item")))
        blocks = max(1, -(-asked.count() // ITEMS))
        block = F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")
        words = asked.select("item", F.explode(F.regexp_extract_all(
            F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))).alias("term"))
        words = words.groupBy("item", F.col("term").cast("binary").alias("term")).agg(F.count("*").alias("times"))
        # a list holds one entry per item of its block at most
        words = words.groupBy("term", block.alias("block")).agg(F.collect_list(F.struct("item", "times")).alias("items"))
        words = scratch.table(words)
        lists = self.table.where(F.col("term").isNotNull()).join(scratch.bounded(words, 100_000), "term")
        lists = scratch.table(lists)
        df = lists.dropDuplicates(["shard", "term"]) if blocks > 1 else lists
        df = df.groupBy("term").agg(F.sum("n").alias("df"))
        weight = F.floor(1000 * F.log(F.lit(2.0 * self.docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
        weights = scratch.table(df.select("term", weight.alias("weight")))
        lists = lists.join(scratch.bounded(weights), "term")
        shards = self.table.where(F.col("term").isNull()).withColumn(
            "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

        def search(table: pa.Table) -> pa.Table:
            rows = table.to_pylist()
            numbers = [r for r in rows if r["term"] is None]
            out = {"item": [], "doc_id": [], "score": []}
            if numbers:
                n, data = numbers[0]["n"], numbers[0]["packed"]
                ids = np.frombuffer(data, np.int64, n)
                missing, norm = np.frombuffer(data, bool, n, 8 * n), np.frombuffer(data, np.int64, n, 9 * n)
                asks: dict[int, list] = {}
                for row in rows:
                    if row["term"] is not None:
                        postings = Postings(row)
                        for ask in row["items"]:
                            asks.setdefault(ask["item"], []).append((postings, ask["times"]))
                for item, lists_of in asks.items():
                    doc, score = best_of(lists_of, norm, k)
                    out["item"].append(np.full(len(doc), item))
                    out["doc_id"].append(pa.array(ids[doc], mask=missing[doc]))
                    out["score"].append(score)
            item, score = (np.concatenate([np.zeros(0, np.int64), *out[c]]) for c in ("item", "score"))
            return pa.table({"item": item, "doc_id": pa.chunked_array(out["doc_id"], pa.int64()), "score": score})

        found = lists.unionByName(shards, allowMissingColumns=True).groupBy("shard", "block").applyInArrow(
            search, "item long, doc_id long, score long")
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        best = found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
        return best.join(scratch.bounded(asked.select("item", "item_id")), "item").select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: for each row of ``items`` the ``k``
    documents of the highest score above 0, equal scores by ascending doc_id.

    A document of n terms, of N documents with L terms in all, has m = 25 + 75nN div L.
    A term that df documents hold weighs floor(1000 ln((2N + 2) / (2df + 1))), and adds
    that times (10^9 tf) div (1000 tf + 8m) for each time the item has it.

    NULL and empty texts have no terms: such documents are never found and not counted,
    such items find nothing. Every row is a document or an item of its own, also rows
    repeated with one id; a NULL doc_id comes last among equal scores. Empty tables
    give an empty result; other columns are not read."""
    return Index(docs).search(items, k)
