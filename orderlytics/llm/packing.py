"""Best-fit packing of token sequences through a configuration linear program.

Only the histogram of lengths (at most ``cap`` counts) reaches the driver. There
the linear program over bin configurations is solved by multiplicative weights:
each step prices the lengths by what is still uncovered, a knapsack dynamic
program finds the dearest configuration, and its share grows. The shares are
rounded down to whole bins; what is left goes best-fit into the room left over. The
pieces of bins that are still not full are placed best-fit once more, if that saves bins.
Everything is done by length and multiplicity, so the driver's work depends on
``cap`` alone. Pieces are then placed by their rank within their length.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlytics.llm import scratch

CAP = 2048
#: The linear program measures lengths in this part of a bin, rounded up (the bins do not).
GRAIN = 256
#: Times that the multiplicative weights cover each length, and most steps they take.
ROUNDS, STEPS = 64, 8000
#: How fast a length's price falls as it gets covered; small steps near the optimum.
RATE = 0.25


# --- tokens -----------------------------------------------------------------

def token_pieces(docs: DataFrame, tokenizer: str, cap: int = CAP, end_id: int = 0,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece (from 0), start, length, ids (binary: little-endian
    unsigned 32-bit). A text is its ids under the tokenizer file, without added
    special tokens, then ``end_id``; NULL counts as empty, so no text is without a
    piece. A text longer than ``cap`` is cut so that only its first piece may be
    shorter. Rows are kept as they come: NULL and repeated ids too."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType),
                           T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
                           T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])
    end = int(end_id).to_bytes(4, "little")

    def cut(batches):
        encode = _encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                rows = [], [], [], [], []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = encode(text) + end
                    n = len(ids) // 4
                    stops = range((n - 1) % cap + 1, n + 1, cap)
                    for piece, stop in enumerate(stops):
                        start = max(0, stop - cap) if piece else 0
                        for column, value in zip(rows, (doc, piece, start, stop - start, ids[4 * start:4 * stop])):
                            column.append(value)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(
                    rows, (part.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.binary()))],
                    names=schema.names)

    return docs.mapInArrow(cut, schema)


def _byte_ranks(vocab: dict[str, int]) -> dict[bytes, int]:
    """The vocabulary by bytes: its strings spell bytes as characters, printable
    ones as themselves and the others, in order, from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spelled = {chr(b): b for b in shown}
    spelled |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    return {bytes(spelled[c] for c in word): i for word, i in vocab.items() if all(c in spelled for c in word)}


def _encoder(path: str):
    """text -> its ids as little-endian unsigned 32-bit numbers. Texts in Latin
    letters go through tiktoken over the file's vocabulary (the same ids in a
    sixth of the time), all others through the tokenizer itself."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    special = [t.content for t in model.get_added_tokens_decoder().values()]
    latin = tiktoken.Encoding("latin", pat_str=public_tokenizers.PATTERN, special_tokens={},
                              mergeable_ranks=_byte_ranks(model.get_vocab(with_added_tokens=False)))
    other = re.compile("[^\x00-\u024f]")

    def encode(text: str | None) -> bytes:
        text = text or ""
        if other.search(text) or any(t in text for t in special):
            ids = model.encode(text, add_special_tokens=False).ids
        else:
            ids = latin.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()

    return encode


# --- the linear program, on the driver --------------------------------------

def _dearest(value: np.ndarray, size: np.ndarray, room: int) -> dict[int, int]:
    """The configuration {index: copies} of largest total value within ``room``
    (unbounded knapsack; sizes ascend)."""
    worth = np.full(room + 1, -np.inf)
    worth[size] = value
    # back[room - r] is best[r]: what sizes from 1 on leave room for is a slice
    back, last = np.zeros(room + 1), np.zeros(room + 1, int)
    for r in range(int(size[0]), room + 1):
        total = worth[1:r + 1] + back[room - r + 1:]
        s = int(total.argmax())
        if total[s] > back[room - r + 1]:
            back[room - r], last[r] = total[s], s + 1
        else:
            back[room - r] = back[room - r + 1]
    place = {int(s): k for k, s in enumerate(size)}
    config, r = defaultdict(int), room
    while r > 0:
        if last[r]:
            config[place[int(last[r])]] += 1
        r -= max(1, int(last[r]))
    return config


def _configurations(demand: dict[int, int], room: int, rounds: int, steps: int) -> list[tuple[dict, float]]:
    """Fractional bins [(configuration {size: copies}, amount)] that about cover the
    demand {size: pieces}, by multiplicative weights with knapsack pricing."""
    size = np.array(sorted(demand))
    need = np.array([demand[s] for s in size], float)
    covered, amount = np.zeros(len(size)), defaultdict(float)
    for _ in range(steps):
        if covered.min() >= rounds:
            break
        # a length may not stand more often in a bin than there are pieces of it
        config = _dearest(np.exp(RATE * (covered.min() - covered)) / need, size, room)
        config = {k: min(c, int(need[k])) for k, c in config.items()}
        step = min(need[k] / c for k, c in config.items())
        for k, c in config.items():
            covered[k] += step * c / need[k]
        amount[tuple(sorted(config.items()))] += step
    scale = max(1.0, float(np.median(covered)))
    return [({int(size[k]): c for k, c in config}, a / scale) for config, a in amount.items()]


def plan(histogram: dict[int, int], cap: int = CAP, unit: int | None = None,
         rounds: int = ROUNDS, steps: int = STEPS) -> list[tuple[tuple[int, ...], int]]:
    """Kinds of bins [(lengths in the bin, number of such bins)] that hold every
    piece of the histogram {length: pieces} exactly once."""
    unit = unit or max(1, cap // GRAIN)
    left = {s: c for s, c in histogram.items() if c > 0}
    kinds = []
    if left.get(cap):
        kinds.append(((cap,), left.pop(cap)))
    classes = defaultdict(list)
    for s in sorted(left):
        classes[-(-s // unit)].append(s)
    classes = {k: v for k, v in classes.items() if k <= cap // unit}
    demand = {k: sum(left[s] for s in v) for k, v in classes.items()}
    open_bins = defaultdict(list)  # room -> [(lengths, bins)]
    rooms: list[int] = []

    def put(lengths, n):
        room = cap - sum(lengths)
        if room not in open_bins or not open_bins[room]:
            insort(rooms, room)
        open_bins[room].append((lengths, n))

    alive = sorted(left)
    found = _configurations(demand, cap // unit, rounds, steps) if demand else []
    for config, amount in sorted(found, key=lambda x: -x[1] * sum(k * c for k, c in x[0].items())):
        bins = int(amount)
        while bins > 0:
            lengths, taken, room = [], defaultdict(int), cap
            for k in sorted((k for k, c in config.items() for _ in range(c)), reverse=True)[:-1]:
                s = next((s for s in reversed(classes[k]) if left[s] > taken.get(s, 0)), None)
                if s is None:
                    break
                taken[s] += 1
                lengths.append(s)
                room -= s
            else:  # the shortest piece takes up what rounding lengths had left
                at = bisect_right(alive, room) - 1
                while at >= 0 and left[alive[at]] <= taken.get(alive[at], 0):
                    at -= 1
                if at >= 0:
                    taken[alive[at]] += 1
                    lengths.append(alive[at])
            if len(lengths) < sum(config.values()):
                break
            n = min([bins, *(left[s] // t for s, t in taken.items())])
            for s, t in taken.items():
                left[s] -= n * t
                if not left[s]:
                    del alive[bisect_left(alive, s)]
            put(tuple(lengths), n)
            bins -= n
    for s in sorted(left, reverse=True):  # the rest: best fit, longest first
        while left[s]:
            at = bisect_left(rooms, s)
            if at == len(rooms):
                each = min(cap // s, left[s])
                n = left[s] // each
                left[s] -= n * each
                put((s,) * each, n)
                continue
            room = rooms[at]
            lengths, n = open_bins[room].pop()
            if not open_bins[room]:
                rooms.pop(at)
            if n > left[s]:
                put(lengths, n - left[s])
                n = left[s]
            left[s] -= n
            put((*lengths, s), n)
    kinds += [kind for bins in open_bins.values() for kind in bins]
    loose = [(lengths, n) for lengths, n in kinds if sum(lengths) < cap]
    if not found or not loose:
        return kinds
    # bins that are not full are opened once more, where their pieces fit into fewer
    opened = defaultdict(int)
    for lengths, n in loose:
        for s in lengths:
            opened[s] += n
    again = plan(opened, cap, unit, steps=0)
    if sum(n for _, n in again) < sum(n for _, n in loose):
        kinds = [kind for kind in kinds if sum(kind[0]) == cap] + again
    return kinds


def _slots(kinds: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, copies in a bin, first sequence, offset in the
    bin) of the pieces of one length in one kind of bin."""
    rows, rank, sequence = [], defaultdict(int), 0
    for lengths, n in kinds:
        offset = 0
        for s in sorted(set(lengths), reverse=True):
            copies = lengths.count(s)
            rows.append((s, rank[s], rank[s] + n * copies, copies, sequence, offset))
            rank[s] += n * copies
            offset += copies * s
        sequence += n
    return rows


# --- placing, on the executors ----------------------------------------------

def pack(pieces: DataFrame, cap: int = CAP, n: int | None = None, **solver) -> DataFrame:
    """``pieces`` (columns doc_id, piece, length and others; read twice, so best a
    stored table) with sequence_id and offset: every piece of 1 to ``cap`` tokens
    lies in one sequence, pieces of a sequence touch from offset 0 on. Other
    lengths (NULL too) raise an error. An empty table gives an empty result.

    Ranks within a length are counted in two steps, by a hash of the piece and then
    over those parts, so that no length has all its pieces in one task."""
    spark = pieces.sparkSession
    n = n or scratch.partitions(spark)
    counted = {r["length"]: r["count"] for r in pieces.groupBy("length").count()
               .orderBy("length").limit(cap + 2).collect()}  # at most cap + 2 rows
    if any(s is None or not 0 < s <= cap for s in counted):
        raise ValueError(f"pieces must have 1 to {cap} tokens")
    slots = spark.createDataFrame(
        _slots(plan(counted, cap, **solver)),
        "_length long, _low long, _high long, _copies long, _sequence long, _offset long")
    parted = pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n)))
    before = (parted.groupBy("length", "_part").count()
              .withColumn("_before", F.sum("count").over(
                  Window.partitionBy("length").orderBy("_part")) - F.col("count")).drop("count"))
    within = Window.partitionBy("length", "_part").orderBy("doc_id", "piece")
    ranked = (parted.withColumn("_rank", F.row_number().over(within))
              .join(before, ["length", "_part"])
              .withColumn("_rank", F.col("_rank") + F.col("_before") - 1))
    placed = ranked.join(F.broadcast(slots), (F.col("length") == F.col("_length"))  # by lengths only
                         & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high")))
    turn = F.col("_rank") - F.col("_low")
    return placed.select(
        *pieces.columns, (F.col("_sequence") + F.floor(turn / F.col("_copies"))).alias("sequence_id"),
        (F.col("_offset") + turn % F.col("_copies") * F.col("length")).alias("offset"))
