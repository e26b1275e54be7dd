"""Components of near-equal texts: a Jaccard join of word n-gram sets by T-occurrence search.

Two sets that are similar enough share T n-grams, so both hold one of the other's
rarest few: its prefix, in any order of n-grams that all texts agree on. Prefix
n-grams are posted in inverted lists. How often each n-gram occurs is counted over
all texts in a fixed table of hash buckets; ordering by it keeps frequent n-grams
out of prefixes wherever a text has others, and so lists short.

A list of m texts is not expanded into its m * m / 2 pairs. Its most central text
(the one with most of its prefix in lists) queries all others; the answers join
components; only lists that still hold several components go on, with 4 times as
many querying texts each round, until every pair has been in one query or is
connected. A query is a T-occurrence search over the inverted lists of the texts
asked for: short lists are merged, candidates are probed for in the long ones
(DivideSkip), and those that reach the overlap are kept. Equal sets are one text
throughout.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlytics.llm import scratch
from orderlytics.llm.components import components
from orderlytics.llm.textscan import Scanner, mix, per_text, shingles, signed

#: Buckets in which n-grams are counted: 64 for each text, as a power of two between
#: these bounds (at most 16 MB); and the parts that they travel in.
LEAST_BITS, MOST_BITS, PARTS = 12, 24, 64
#: Level (see _frequency) of a bucket whose n-grams may have very long lists: 2 ** 17 texts.
HOT = 8 * 17
#: Texts that one task compares with one querying text.
ASKED = 2000
#: Narrow rows that a row with its set counts as.
WIDE = 16
#: N-grams of asked texts whose lists are in memory at once.
AT_ONCE = 1 << 18


def _sets(words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text of the block, n-gram) of every distinct n-gram, by text and n-gram."""
    of, s = shingles(words, k)
    order = np.lexsort((s, of))
    of, s = of[order], s[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (s[1:] != s[:-1]) | (of[1:] != of[:-1])
    return of[new], s[new]


def _frequency(docs: DataFrame, k: int, bits: int) -> np.ndarray:
    """Per bucket, eight times the binary logarithm of 1 + the n-grams in it."""
    size, shift = (1 << bits) // PARTS, np.uint64(64 - bits)

    def count(batches):
        scanner, total = Scanner(lower=True), np.zeros(size * PARTS, np.uint32)
        for batch in batches:
            for w in scanner.blocks(batch.column("text")):
                bucket, n = np.unique(_sets(w, k)[1] >> shift, return_counts=True)
                total[bucket.astype(np.int64)] += n.astype(np.uint32)
        rows = [(i, zlib.compress(p.astype("<u4").tobytes(), 1)) for i, p in enumerate(np.split(total, PARTS)) if p.any()]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
                              ["part", "counts"])

    def add(batches):
        totals = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts")):
                total = totals.setdefault(part, np.zeros(size, np.uint64))
                total += np.frombuffer(zlib.decompress(counts.as_buffer()), "<u4")
        for part, total in totals.items():
            level = np.minimum(255, 8 * np.log2(1.0 + total)).astype(np.uint8)
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([level.tobytes()], pa.binary())],
                                  ["part", "level"])

    parts = (docs.select("text").mapInArrow(count, "part int, counts binary").repartition("part")
             .mapInArrow(add, "part int, level binary").collect())  # PARTS rows, 16 MB in all at most
    level = np.zeros((PARTS, size), np.uint8)
    for r in parts:
        level[r["part"]] = np.frombuffer(r["level"], np.uint8)
    return level.ravel()


def _prefixes(docs: DataFrame, level, bits: int, k: int, percent: int) -> DataFrame:
    """doc_id, n, two fingerprints of the set, prefix (its rarest n-grams, the rarest
    first), hot (how many n-grams of the prefix, its last, are in hot buckets)."""
    def scan(batches):
        scanner = Scanner(lower=True)
        for batch in batches:
            for w in scanner.blocks(batch.column("text")):
                texts = len(w.first) - 1
                of, s = _sets(w, k)
                n = np.bincount(of, minlength=texts)
                start = np.concatenate(([0], np.cumsum(n)))
                print_ = [np.add.reduceat(np.append(mix(s ^ np.uint64(salt)), np.uint64(0)), start[:-1]) * (n > 0)
                          for salt in (0, 0x5851F42D4C957F2D)] if texts else []
                often = level.value[(s >> np.uint64(64 - bits)).astype(np.int64)]
                order = np.lexsort((s, often, of))
                keep = n - -(-percent * n // 100) + 1
                rank = np.arange(len(s)) - start[of]
                kept = s[order][rank < keep[of]]  # ``of`` is sorted, so it fits the new order too
                hot = per_text((often[order] >= HOT) & (rank < keep[of]), start)
                ends = np.concatenate(([0], np.cumsum(np.minimum(keep, n)))).astype(np.int32)
                yield pa.record_batch(
                    [batch.column("doc_id").slice(w.lo, texts), pa.array(n.astype(np.int64)),
                     *(pa.array(signed(p)) for p in print_), pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(kept))),
                     pa.array(hot.astype(np.int32))],
                    ["doc_id", "n", "print_a", "print_b", "prefix", "hot"])

    return docs.mapInArrow(scan, "doc_id long, n long, print_a long, print_b long, prefix array<long>, hot int")


def _full_sets(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """text, n, grams (its sorted n-grams, binary) of the texts in ``asked`` (text, print_a)."""
    def scan(batches):
        scanner = Scanner(lower=True)
        for batch in batches:
            for w in scanner.blocks(batch.column("text")):
                of, s = _sets(w, k)
                ends = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(w.first) - 1))))
                rows = [(batch.column("doc_id")[w.lo + i].as_py(), s[a:b]) for i, (a, b) in enumerate(zip(ends, ends[1:]))
                        if int(signed(mix(s[a:b]).sum(dtype=np.uint64, keepdims=True))[0]) == batch.column("print_a")[w.lo + i].as_py()]
                yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()),
                                       pa.array([len(r[1]) for r in rows], pa.int64()),
                                       pa.array([r[1].tobytes() for r in rows], pa.binary())], ["node", "n", "grams"])

    return (docs.join(scratch.bounded(asked.withColumnRenamed("node", "doc_id")), "doc_id")
            .select("doc_id", "text", "print_a").mapInArrow(scan, "node long, n long, grams binary"))


def divide_skip(lists: list[np.ndarray], least: int, mu: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """(id, occurrences) of the ids that occur in ``least`` of the sorted ``lists`` or
    more. The longest lists are only probed: an id must be in ``least`` less their
    number of the short ones, which are merged."""
    lists = sorted((x for x in lists if len(x)), key=len)
    if len(lists) < max(1, least):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    long = min(least - 1, int(least / (mu * math.log2(1 + len(lists[-1])) + 1)))
    short, probed = (lists[:-long], lists[-long:]) if long > 0 else (lists, [])
    ids, found = np.unique(np.concatenate(short), return_counts=True)
    ids, found = ids[found >= least - long], found[found >= least - long]
    for i, x in enumerate(probed):
        at = np.minimum(np.searchsorted(x, ids), len(x) - 1)
        found = found + (x[at] == ids)
        can = found >= least - (long - i - 1)
        ids, found = ids[can], found[can]
    return ids, found


def _answers(query: np.ndarray, sizes: np.ndarray, grams: np.ndarray, percent: int) -> np.ndarray:
    """Which of the sets (concatenated in ``grams``) are similar to ``query``."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = np.searchsorted(query, grams)
    at[at == len(query)] = 0
    held = query[at] == grams
    by = np.argsort(at[held], kind="stable")
    token, owner = at[held][by], owner[held][by]
    lists = np.split(owner, np.flatnonzero(np.diff(token)) + 1)
    n = len(query)
    # smallest overlap that any of the sets can need: i >= percent * (n + m - i) / 100
    least = -(-percent * (n + int(sizes.min())) // (100 + percent)) if len(sizes) else 1
    ids, overlap = divide_skip(lists, max(1, least))
    return ids[100 * overlap >= percent * (n + sizes[ids] - overlap)]


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, stored. A text asks its partners
    in blocks of about ASKED, its set first in each block."""
    rows = pairs.count()
    blocks = scratch.table(pairs.groupBy("a").agg(F.ceil(F.count("b") / F.lit(ASKED)).alias("blocks")), rows)
    cut = scratch.table(pairs.join(blocks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block")), rows)
    asking = cut.select("a", "block").distinct().join(sets.withColumnRenamed("node", "a"), "a").select(
        "a", "block", F.lit(None).cast("long").alias("b"), "n", "grams")
    asked = cut.join(sets.withColumnRenamed("node", "b"), "b").select("a", "block", "b", "n", "grams")

    def ask(batches):
        key, query = None, None
        for batch in batches:
            a, block, b = (np.asarray(batch.column(c).fill_null(-1)) for c in ("a", "block", "b"))
            asks = np.asarray(batch.column("b").is_null())
            n = np.asarray(batch.column("n"))
            _, offsets, data = batch.column("grams").buffers()
            first = np.frombuffer(offsets, np.int32)[batch.column("grams").offset:][:len(a) + 1].astype(np.int64)
            change = np.flatnonzero((a[1:] != a[:-1]) | (block[1:] != block[:-1])) + 1
            out_a, out_b = [], []
            for lo, hi in zip([0, *change], [*change, len(a)]):
                if hi == lo:
                    continue
                while lo < hi and asks[lo]:
                    key = (a[lo], block[lo])
                    query = np.frombuffer(data, np.uint64, int(n[lo]), int(first[lo])).copy()
                    lo += 1
                while lo < hi and key == (a[lo], block[lo]):
                    to = lo + max(1, int(np.searchsorted(np.cumsum(n[lo:hi]), AT_ONCE)))
                    grams = np.frombuffer(data, np.uint64, int(n[lo:to].sum()), int(first[lo]))
                    found = b[lo:to][_answers(query, n[lo:to], grams, percent)]
                    out_a.append(np.full(len(found), key[0]))
                    out_b.append(found)
                    lo = to
            yield pa.record_batch([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (out_a, out_b)], ["a", "b"])

    dealt = asking.union(asked).repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())
    # sorted partitions one after the other keep what belongs together in one piece; sets are wide rows
    found = scratch.table(scratch.few(dealt, WIDE * rows).mapInArrow(ask, "a long, b long"))
    scratch.drop(blocks, cut)
    return found


def ngram_components(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles (distinct ``k``-word sequences,
    A-Z as a-z; of a text with fewer words, one), component_id (smallest id that
    can be reached over links; a link: 100 * shared >= percent * united).

    A text without words (or NULL) has no shingles and no links. A NULL id keeps its
    row, with a NULL component, and links nothing. Rows repeated with one id are one
    document: where their texts differ, those of one of them are linked."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    bits = min(MOST_BITS, max(LEAST_BITS, (64 * docs.count()).bit_length()))
    level = spark.sparkContext.broadcast(_frequency(docs, k, bits))  # 16 MB at most
    scanned = found = scratch.table(_prefixes(docs, level, bits, k, percent))
    # equal sets: the smallest id stands for all
    same = scratch.table(found.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "print_a", "print_b")
                         .agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows"))
    found = found.join(scratch.bounded(same), ["n", "print_a", "print_b"], "left").withColumn(
        "node", F.when(F.col("n") > 0, F.coalesce("node", "doc_id")).otherwise(F.col("doc_id")))
    one = found.where("n > 0 AND doc_id = node")
    posted = one.select("node", "n", F.posexplode("prefix").alias("at", "gram"),
                        (F.size("prefix") - F.col("hot")).alias("cold")).withColumn("hot", F.expr("at >= cold"))
    kept = ["gram", "node", "n", "at"]
    # a list of one text is none; those of hot buckets are long, and not gathered to find that out
    beside = Window.partitionBy("gram").orderBy("node")
    cold = (posted.where("NOT hot").select(*kept)
            .select("*", F.lag("node").over(beside).alias("p"), F.lead("node").over(beside).alias("q"))
            .where("p IS NOT NULL OR q IS NOT NULL").drop("p", "q"))
    lists = scratch.table(cold.union(posted.where("hot").select(*kept)))
    asked = scratch.table(lists.groupBy("node").agg(F.count("gram").alias("central")))
    sets = scratch.table(_full_sets(docs, scratch.table(
        one.select("node", "print_a").join(scratch.bounded(asked.select("node")), "node", "left_semi")), k))
    before, lists = lists, scratch.table(lists.join(scratch.bounded(asked), "node"))
    found = scratch.table(found.select("doc_id", "n", "node"))
    scratch.drop(before, asked, scanned, same)
    one = posted = cold = None
    scratch.forget(spark)
    rows = lists.count()
    connected, tried, parts = None, None, []
    low, high = 0, 1
    while True:
        at = lists if connected is None else lists.join(scratch.bounded(connected), "node", "left")
        at = at.withColumn("c", F.coalesce("c", "node") if connected is not None else F.col("node"))
        best = open_ = ranked = None
        if low == 0:  # the most central text of each list, without sorting lists
            best = scratch.table(at.groupBy("gram").agg(F.min(F.struct(-F.col("central"), "node", "n", "at", "c")).alias("q")), rows)
            pairs = at.join(best, "gram").where("node <> q.node AND c <> q.c")
        else:
            open_ = scratch.table(at.groupBy("gram").agg(
                F.min("c").alias("x"), F.max("c").alias("y"), F.count("node").alias("m"))
                .where(F.expr("x <> y") & (F.col("m") > low + 1)).select("gram"), rows)
            if open_.isEmpty():
                break
            ranked = scratch.table(at.join(open_, "gram").withColumn("r", F.row_number().over(
                Window.partitionBy("gram").orderBy(F.desc("central"), "node")) - 1), rows)
            q = ranked.where((F.col("r") >= low) & (F.col("r") < high)).select(
                "gram", F.struct("node", "n", "at", "c", "r").alias("q"))
            pairs = ranked.join(q, "gram").where("r > q.r AND c <> q.c")
        # two texts share nothing before their first common n-gram, and must share enough from there on
        rest = F.least(F.col("n") - F.col("at"), F.col("q.n") - F.col("q.at"))
        pairs = pairs.where((100 + percent) * rest >= percent * (F.col("n") + F.col("q.n"))).select(
            F.col("q.node").alias("a"), F.col("node").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = scratch.table(pairs, rows)
        parts.append(pairs)
        tried = pairs if tried is None else tried.union(pairs)
        new = None if pairs.isEmpty() else _verified(pairs, sets, percent)
        if new is not None and not new.isEmpty():  # the components so far stand for the links so far
            links = new if connected is None else new.union(connected)
            before, connected = connected, scratch.table(components(links).withColumnRenamed("component", "c"))
            scratch.drop(before)
        scratch.drop(best, open_, ranked, new)
        at = links = q = None  # what a round was made of is not needed any more
        scratch.forget(spark)
        low, high = high, 4 * high + 1
    scratch.drop(lists, sets, *parts)
    rows = found
    if connected is not None:
        rows = rows.join(scratch.bounded(connected), "node", "left")
    else:
        rows = rows.withColumn("c", F.lit(None).cast("long"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(
        F.col("doc_id").isNotNull(), F.coalesce("c", "node")).alias("component_id"))
