"""Selection score by cross-entropy difference.

A target and a background bigram model over all words of both corpora, with the same
order, discount and smoothing. Every token costs its loss under either model; a
document's score is the mean difference: below 0, it looks more like the target.

Words are counted first. The commonest are broadcast with their counts and stand as
their rank from then on. Every token then goes, packed, to the bucket of its pair, with
a hash of its document's words; a bucket counts its pairs. Most occur once, in the
background alone: what such a pair costs follows from the counts of its two words, so
the documents' own pass adds that for every token, and the buckets keep only the pairs
that cost something else, and those with a word that is not broadcast. What these cost
more is summed by the documents' hashes. No pair and no word is left out.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlytics.llm import scratch
from orderlytics.llm.textscan import Scanner, Tally, U, Words, find, mix, pair, per_text, release, signed

DISCOUNT = 0.75
#: Most pairs that are counted and broadcast, those of the commonest words; the others are shuffled.
COMMON = 1 << 19
#: Tokens, or distinct words, that a task holds before it passes them on; about those of a bucket.
HELD = 1 << 20
#: Most words, of those not broadcast, that are known to a task by 32 bits as occurring
#: more than once. If there are more, the pairs of words that occur once are shuffled too.
REPEATED = 1 << 22
#: Counts of a word: all tokens, tokens of the corpora as head and as word.
COUNTS = ["n", "total_t", "total_b", "word_t", "word_b"]
WORD = COUNTS[-2:]
LOSSES = ["target_loss", "background_loss"]
#: Bits of a text's kind: it counts in the target, in the background; it is scored.
TARGET, BACKGROUND, SCORED = 1, 2, 4
#: Kinds of other rows among the entries: keys of a chunk's texts, counts of words that are not broadcast.
KEYS, COUNTED = -1, -2
#: Kinds of rows among the buckets' counts.
PAIRS, OFTEN, AGAIN = 0, 1, 2
PIECE = "bucket int, kind int, chunk long, n int, data binary"
#: Added to the hash of a word that is not broadcast; ranks are smaller.
AWAY = U(1 << 63)


def _texts(docs: DataFrame, target: DataFrame, background: DataFrame, text_col: str) -> DataFrame:
    """text and kind of both corpora, and of ``docs`` where they are not the background."""
    def part(df, kind):
        return df.select(F.col(text_col).alias("text"), F.lit(kind).alias("kind"))
    if docs is background:
        return part(target, TARGET).unionByName(part(docs, BACKGROUND | SCORED))
    return part(target, TARGET).unionByName(part(background, BACKGROUND)).unionByName(part(docs, SCORED))


def _words(texts: DataFrame) -> DataFrame:
    """word (hash; 0 is the start of a text) with its COUNTS."""
    def count(batches):
        def flush():
            if merged := tally.merge():
                words, counts, _ = merged
                for i in range(0, len(words), 1 << 17):
                    cut = slice(i, i + (1 << 17))
                    yield pa.record_batch([pa.array(signed(words)[cut]), *(pa.array(x[cut]) for x in counts)], ["word", *COUNTS])

        scanner, tally = Scanner(lower=True), Tally()
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            for w in scanner.blocks(batch.column("text")):
                size = np.diff(w.first)
                kind = kinds[w.lo:w.lo + len(size)]
                for k in np.unique(kind):
                    t, b, here = k & TARGET, (k & BACKGROUND) >> 1, kind == k
                    full = here & (size > 0)
                    for words, signs in ((w.hash[np.repeat(here, size)], (1, t, b, t, b)),
                                         (w.hash[w.first[1:][full] - 1], (0, -t, -b, 0, 0)),  # no head of another
                                         (np.zeros(np.count_nonzero(full), U), (1, t, b, 0, 0))):
                        words, n = np.unique(words, return_counts=True)
                        tally.add(words, [n * s for s in signs])
                if tally.size > HELD:  # merged already, where that was due
                    tally.merge()
                    if tally.size > HELD // 2:
                        yield from flush()
                        tally = Tally()
        yield from flush()

    return (texts.mapInArrow(count, "word long, " + ", ".join(f"{c} long" for c in COUNTS))
            .groupBy("word").agg(*(F.sum(c).alias(c) for c in COUNTS)))


def _common(df: DataFrame, n: Column, most: int) -> Column:
    """Condition that holds for the rows with the largest ``n``, ``most`` at most."""
    rank = F.floor(4 * F.log2(n + 1))
    least, held = 1 << 20, 0
    for r in df.groupBy(rank.alias("rank")).count().orderBy(F.desc("rank")).collect():  # a few hundred ranks
        held += r["count"]
        if held > most:
            break
        least = r["rank"]
    return rank >= least


def _numbers(hashes: np.ndarray, known: tuple) -> np.ndarray:
    """A number per word: the rank of one that is broadcast, the hash with AWAY of another
    one, or the number of ranks where that is known to occur once."""
    hot, rank, repeated = known
    out = rank[find(hot, hashes)]
    away = np.flatnonzero(out == U(len(hot)))
    if repeated is not None:
        away = away[find(repeated, (hashes[away] >> U(32)).astype(np.uint32)) < len(repeated)]
    out[away] = hashes[away] | AWAY
    return out


def _tokens(w: Words, known: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of each token's head and word; both are hashes where one is, and the other occurs once."""
    word = _numbers(w.hash, known)
    head = np.empty_like(word)
    head[1:] = word[:-1]
    head[w.first[:-1][np.diff(w.first) > 0]] = _numbers(np.zeros(1, U), known)[0]
    once = U(len(known[0]))
    head_too, word_too = np.flatnonzero((head == once) & (word >= AWAY)), np.flatnonzero((head >= AWAY) & (word == once))
    head[head_too], word[word_too] = w.hash[head_too - 1] | AWAY, w.hash[word_too] | AWAY
    return head, word


def _keys(w: Words) -> np.ndarray:
    """A hash of each text's words in order: texts of the same words share all losses."""
    size = np.diff(w.first)
    place = np.arange(len(w.hash)) - np.repeat(w.first[:-1], size)
    total = np.concatenate((np.zeros(1, U), np.cumsum(mix(pair(w.hash, place.astype(U))), dtype=U)))
    return mix(total[w.first[1:]] - total[w.first[:-1]])


def _packed(*columns: np.ndarray) -> bytes:
    """64-bit columns, compressed: all their lowest bytes, then all the next ones, and so on."""
    return pa.compress(b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns),
                       "zstd", asbytes=True)


def _unpacked(data: bytes, n: int, columns: int) -> list[np.ndarray]:
    planes = np.frombuffer(pa.decompress(data, 8 * columns * n, "zstd", asbytes=True), np.uint8).reshape(columns, 8, n)
    return [np.ascontiguousarray(c.T).view(U).ravel() for c in planes]


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def _buckets(head: np.ndarray, word: np.ndarray, buckets: int) -> np.ndarray:
    """That of a head that is not broadcast, else of such a word, else of the pair: the
    counts of these words, and all pairs of such a head, are in one bucket."""
    of = mix(np.where(head >= AWAY, head, np.where(word >= AWAY, word, pair(head, word))))
    return ((of >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["bucket", "kind", "chunk", "n", "data"])


def _cuts(of: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of every run of equal values."""
    cuts = np.flatnonzero(np.diff(of, prepend=-1, append=-1)).tolist()
    return list(zip(cuts, cuts[1:]))


def _postings(texts: DataFrame, shared, common: int, buckets: int) -> DataFrame:
    """PIECE rows: ``n`` entries in ``data``, packed: head, word, text (its place in the
    chunk from 1, in steps; 0: not scored) and how often. Pairs of the ``common`` first
    ranks are only counted; those of a word whose number says that it occurs once are left
    to the documents' pass. A KEYS row per chunk has its texts' keys; a chunk's name is a hash of them."""
    def emit(kind, head, word, size, key):
        if kind & SCORED:
            chunk = int(signed(mix(np.cumsum(mix(pair(key, np.arange(len(key), dtype=U))), dtype=U)[-1:]))[0])
            text = np.repeat(np.arange(1, len(size) + 1, dtype=U), size)
            yield _pieces([((chunk & 0x7FFFFFFF) % buckets, KEYS, chunk, len(key), _packed(key))])
        else:
            chunk, text = 0, np.zeros(len(head), U)
        often = (head < common) & (word < common)
        at = np.flatnonzero((head != once) & (word != once) & ~often)
        columns, times = [head[at], word[at], text[at]], np.ones(len(at), np.int64)
        if kind & (TARGET | BACKGROUND):
            both, n = np.unique(head[often] * U(common) + word[often], return_counts=True)
            width = U(max(common, 1))
            columns = [np.concatenate(c) for c in zip(columns, (both // width, both % width, np.zeros(len(both), U)))]
            times = np.concatenate((times, n))
        if not len(times):
            return
        code = pair(*columns[:2])
        of = _buckets(*columns[:2], buckets)
        # pairs that share these 27 bits are merely not counted together here
        order = np.argsort(of.astype(U) << U(48) | columns[2] << U(27) | code & U((1 << 27) - 1))
        code, of, columns = code[order], of[order], [c[order] for c in columns]
        start = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (columns[2][1:] != columns[2][:-1]))))
        times, of, columns = np.add.reduceat(times[order], start).view(U), of[start], [c[start] for c in columns]
        yield _pieces([(int(of[lo]), kind, chunk, hi - lo, _packed(*(c[lo:hi] for c in columns[:2]), _steps(columns[2][lo:hi]), times[lo:hi]))
                       for lo, hi in _cuts(of)])

    def scan(batches):
        scanner, waiting, known = Scanner(lower=True), {}, shared.value
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            for w in scanner.blocks(batch.column("text")):
                size = np.diff(w.first)
                head, word = _tokens(w, known)
                kind, key = kinds[w.lo:w.lo + len(size)], _keys(w)
                for k in np.unique(kind[size > 0]).tolist():
                    texts, tokens = (kind == k) & (size > 0), np.repeat(kind == k, size)
                    held = waiting.setdefault(k, [])
                    held.append((head[tokens], word[tokens], size[texts], key[texts]))
                    if sum(len(h[0]) for h in held) > HELD // 2:
                        yield from emit(k, *map(np.concatenate, zip(*waiting.pop(k))))
        for k, held in waiting.items():
            yield from emit(k, *map(np.concatenate, zip(*held)))

    once = U(len(shared.value[0]))
    return texts.mapInArrow(scan, PIECE)


def _counts(cold: DataFrame, buckets: int) -> DataFrame:
    """PIECE rows with the counts of the words in ``cold``, for the buckets of their pairs."""
    def pack(batches):
        waiting, size = [], 0
        for batch in batches:
            waiting.append([batch.column(c).to_numpy().view(U) for c in ["word", *COUNTS[1:]]])
            size += batch.num_rows
            if size > HELD:
                yield from packed(waiting)
                waiting, size = [], 0
        if size:
            yield from packed(waiting)

    def packed(waiting):
        columns = [np.concatenate(c) for c in zip(*waiting)]
        of = _buckets(columns[0], columns[0], buckets)
        order = np.argsort(of, kind="stable")
        of, columns = of[order], [c[order] for c in columns]
        yield _pieces([(int(of[lo]), COUNTED, 0, hi - lo, _packed(*(c[lo:hi] for c in columns))) for lo, hi in _cuts(of)])

    return cold.mapInArrow(pack, PIECE)


class Bucket:
    """A bucket's pairs: head, word, t, b; its entries as they came: of (their pair),
    text, times, in runs of one chunk; cold: words that are not broadcast with total, kinds, word."""

    def __init__(self, waiting: list[tuple]):
        entries, cold, runs = [], [[np.zeros(0, U)] * len(COUNTS)], []
        for kind, chunk, n, data in waiting:
            if kind == COUNTED:
                cold.append(_unpacked(data, n, len(COUNTS)))
            else:
                head, word, steps, times = _unpacked(data, n, 4)
                runs.append((chunk, n))
                entries.append((head, word, np.cumsum(steps, dtype=U).view(np.int64), times.view(np.int64),
                                *(times.view(np.int64) * bool(kind & k) for k in (TARGET, BACKGROUND))))
        entries = entries or [(np.zeros(0, U), np.zeros(0, U), *[np.zeros(0, np.int64)] * 4)]
        self.chunk, self.size = np.array(runs or [(0, 0)], np.int64).T
        head, word, self.text, self.times, t, b = map(np.concatenate, zip(*entries))
        code = pair(head, word)
        order = np.argsort(code)
        code = code[order]
        new = np.ones(len(code), dtype=bool)
        new[1:] = code[1:] != code[:-1]
        start = np.flatnonzero(new)
        self.of = np.empty(len(code), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.head, self.word = head[order[start]], word[order[start]]
        self.t, self.b = (np.add.reduceat(x[order], start) if len(start) else x for x in (t, b))
        cold = [np.concatenate(c) for c in zip(*cold)]
        order = np.argsort(cold[0])
        word, total_t, total_b, *words = (c[order] for c in cold)
        at = np.flatnonzero((self.head >= AWAY) & ((self.t > 1) | (self.b > 1)))
        place = find(word, self.head[at])
        at, place = at[place < len(word)], place[place < len(word)]
        kinds = [c - np.bincount(place, np.maximum(x[at] - 1, 0), len(word)).astype(U) for c, x in ((total_t, self.t), (total_b, self.b))]
        self.cold = [word, total_t, total_b, *kinds, *words]

    def kept(self, usual: int) -> dict:
        """The scored entries of pairs that are not 0 times in the target and ``usual``
        times in the background, or have a word that is not broadcast: a PAIRS row."""
        use = (self.t != 0) | (self.b != usual) | (self.head >= AWAY) | (self.word >= AWAY)
        use &= np.bincount(self.of, self.text > 0, len(use)) > 0
        here = (self.text > 0) & use[self.of]
        size = np.diff(np.concatenate(([0], np.cumsum(here)))[np.concatenate(([0], np.cumsum(self.size)))])
        at = np.flatnonzero(use)
        of = (np.cumsum(use) - 1)[self.of[here]]
        return {"kind": PAIRS, "n": len(at), "data": _packed(self.head[at], self.word[at], self.t[at], self.b[at]),
                "m": len(of), "entries": _packed(of, _steps(self.text[here]), self.times[here]),
                "c": len(self.cold[0]), "cold": _packed(*self.cold), "chunks": self.chunk.tolist(), "sizes": size.tolist()}


def _counted(pieces: DataFrame, common: int, usual: int) -> DataFrame:
    """KEYS rows as they come; a PAIRS row per bucket; OFTEN rows, head, word, t, b: the
    pairs of the ``common`` first ranks that are not 0 times in the target and ``usual``
    times in the background; AGAIN rows, head, t, b: how often pairs of a head that is
    broadcast come again after their first time."""
    def count(batches):
        again, size, waiting, last = [], 0, [], None
        for batch in batches:
            for bucket, *piece in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "chunk", "n", "data"))):
                if piece[0] == KEYS:
                    yield from rows([dict(zip(("kind", "chunk", "n", "data"), piece))])
                    continue
                if waiting and bucket != last:
                    yield from counted(waiting, again)
                    waiting = []
                    size = sum(len(x[0]) for x in again)
                    if size > HELD:
                        again = [merged(again)]
                        if len(again[0][0]) > HELD // 2:
                            yield from flush(again.pop())
                last = bucket
                waiting.append(piece)
        if waiting:
            yield from counted(waiting, again)
        if again:
            yield from flush(merged(again))

    def counted(waiting, again):
        x = Bucket(waiting)
        yield from rows([x.kept(usual)])
        often = np.flatnonzero((x.head < common) & (x.word < common) & ((x.t != 0) | (x.b != usual)))
        yield from flat(OFTEN, signed(x.head[often]), x.t[often], x.b[often], signed(x.word[often]))
        more = np.flatnonzero((x.head < AWAY) & ((x.t > 1) | (x.b > 1)))
        again.append((x.head[more], np.maximum(x.t[more] - 1, 0), np.maximum(x.b[more] - 1, 0)))
        release()

    def merged(again):
        head, *times = map(np.concatenate, zip(*again))
        head, of = np.unique(head, return_inverse=True)
        return head, *(np.bincount(of, c, len(head)).astype(np.int64) for c in times)

    def flush(again):
        yield from flat(AGAIN, signed(again[0]), *again[1:], np.full(len(again[0]), -1))

    def rows(found):
        yield pa.record_batch([pa.array([r.get(f.name) for r in found], f.type) for f in fields], [f.name for f in fields])

    def flat(kind, head, t, b, word):
        for lo in range(0, len(head), 1 << 16):
            c = {"head": head, "t": t, "b": b, "word": word, "kind": np.full(len(head), kind)}
            yield pa.record_batch([pa.array(c[f.name][lo:lo + (1 << 16)], f.type) if f.name in c else
                                   pa.nulls(len(head[lo:lo + (1 << 16)]), f.type) for f in fields], [f.name for f in fields])

    big = pa.int64()
    fields = pa.schema([("kind", pa.int32()), ("chunk", big), ("n", pa.int32()), ("data", pa.binary()), ("m", pa.int32()),
                        ("entries", pa.binary()), ("c", pa.int32()), ("cold", pa.binary()), ("chunks", pa.list_(big)),
                        ("sizes", pa.list_(big)), ("head", big), ("word", big), ("t", big), ("b", big)])
    return (pieces.repartition("bucket").sortWithinPartitions("bucket")
            .mapInArrow(count, "kind int, chunk long, n int, data binary, m int, entries binary, c int, cold binary, "
                               "chunks array<long>, sizes array<long>, head long, word long, t long, b long"))


def _more(pairs: DataFrame, shared, usual: int, tokens: dict[str, int]) -> DataFrame:
    """What the tokens of scored texts cost more than the documents' pass adds for them,
    from PAIRS rows. Rows with word NULL: ``n`` texts of a chunk in ``data``, packed:
    place, in steps, and both sums. Other rows: a pair of two words that are not
    broadcast in a text of a chunk, with what is known of its head."""
    def correct(batches):
        held, size = {}, 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("n", "data", "m", "entries", "c", "cold", "chunks", "sizes"))):
                n, data, m, entries, c, cold, chunks, sizes = (x.as_py() for x in row)
                of, text, times = (x.view(np.int64) for x in _unpacked(entries, m, 3))
                text = np.cumsum(text)
                head, word, t, b = _unpacked(data, n, 4)
                costs, model, both = priced(head, word, (t.view(np.int64), b.view(np.int64)), _unpacked(cold, c, 7))
                ends = np.cumsum(sizes)
                for chunk, lo, hi in zip(chunks, ends - sizes, ends):
                    here = of[lo:hi]
                    at = np.flatnonzero(both[here])
                    if len(at):
                        at += lo
                        found = {"text": text[at], "times": times[at], "chunk": np.full(len(at), chunk), "word": signed(word[of[at]]),
                                 "t": t[of[at]].view(np.int64), "b": b[of[at]].view(np.int64),
                                 **{name: x[of[at]] for name, x in zip(("heads_t", "back_t", "heads_b", "back_b"), model)}}
                        yield pa.record_batch([pa.array(found[f.name], f.type) if f.name in found else pa.nulls(len(at), f.type)
                                               for f in fields], names)
                    if hi > lo:
                        held.setdefault(chunk, []).append(_summed(text[lo:hi], *(x[here] * times[lo:hi] for x in costs)))
                        size += len(held[chunk][-1][0])
                release()
                if size > 2 * HELD:
                    yield from flush(held)
                    held, size = {}, 0
        if held:
            yield from flush(held)

    def priced(head, word, counts, cold):
        models = shared.value
        once = len(models[0][0]) - 1
        away_head, away_word = head >= AWAY, word >= AWAY
        h, w = (np.where(x >= AWAY, U(once), x).astype(np.int64) for x in (head, word))
        words, *cold = cold
        cold = [x.view(np.int64) for x in cold]
        at_head, at_word = (np.flatnonzero(x >= AWAY) for x in (head, word))
        at_head, at_word = (at[find(words, x[at]) < len(words)] for at, x in ((at_head, head), (at_word, word)))
        in_head, in_word = find(words, head[at_head]), find(words, word[at_word])
        costs, model = [], []
        for i, (x, one, (heads, back, alone)) in enumerate(zip(counts, (0, usual), models)):
            heads, back, alone = heads[h], back[h], alone[w]
            before = _loss(one, heads, back, alone)
            heads[at_head], back[at_head] = (y[in_head] for y in _weights(cold[i], cold[2 + i]))
            alone[at_word] = (cold[4 + i][in_word] + 1) / tokens["tb"[i]]
            before[away_head | away_word] = 0
            cost = _loss(x, heads, back, alone) - before
            cost[away_head & away_word] = 0  # these are joined to the counts of their word
            costs.append(cost)
            model += [heads, back]
        return costs, model, away_head & away_word

    def flush(held):
        found = []
        for chunk, sums in held.items():
            text, *sums = _summed(*map(np.concatenate, zip(*sums)))
            found.append({"chunk": chunk, "n": len(text), "data": _packed(_steps(text), *sums)})
        yield pa.record_batch([pa.array([row.get(f.name) for row in found], f.type) for f in fields], names)

    fields = pa.schema([("chunk", pa.int64()), ("n", pa.int32()), ("data", pa.binary()), ("text", pa.int64()), ("times", pa.int64()),
                        ("word", pa.int64()), ("t", pa.int64()), ("b", pa.int64()), ("heads_t", pa.int64()), ("back_t", pa.float64()),
                        ("heads_b", pa.int64()), ("back_b", pa.float64())])
    names = [f.name for f in fields]
    return pairs.mapInArrow(correct, "chunk long, n int, data binary, text long, times long, word long, t long, b long, "
                                     "heads_t long, back_t double, heads_b long, back_b double")


def _summed(text: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct texts, and the sums of the values of each."""
    most = int(text.max()) + 1
    at = np.flatnonzero(np.bincount(text, minlength=most))
    return at, *(np.bincount(text, v, most)[at] for v in values)


def _by_key(found: DataFrame) -> DataFrame:
    """key, target_loss, background_loss: the sums of a chunk's texts, under their keys."""
    def add(batches):
        waiting, last = [], None
        for batch in batches:
            for chunk, *row in zip(*(batch.column(c).to_pylist() for c in ("chunk", "kind", "n", "data", "text", *LOSSES))):
                if waiting and chunk != last:
                    yield from added(waiting)
                    waiting = []
                last = chunk
                waiting.append(row)
        if waiting:
            yield from added(waiting)

    def added(waiting):
        # chunks of one name have the same texts
        keys = next(_unpacked(data, n, 1)[0] for kind, n, data, *_ in waiting if kind == KEYS)
        sums = [np.zeros(len(keys) + 1) for _ in LOSSES]
        for kind, n, data, text, *losses in waiting:
            if data is None:
                for s, x in zip(sums, losses):
                    s[text] += x
            elif kind is None:
                steps, *values = _unpacked(data, n, 3)
                text = np.cumsum(steps, dtype=U).view(np.int64)
                for s, x in zip(sums, values):
                    s[text] += x.view(np.float64)
        yield pa.record_batch([pa.array(signed(keys)), *(pa.array(s[1:]) for s in sums)], ["key", *LOSSES])

    return (found.repartition("chunk").sortWithinPartitions("chunk")
            .mapInArrow(add, "key long, target_loss double, background_loss double"))


def _weights(total: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a head's counts are divided by, and the weight of the words alone after it."""
    heads = np.maximum(total, 1)
    return heads, np.where(total > 0, DISCOUNT * kinds / heads, 1.0)


def _loss(times: np.ndarray | int, heads: np.ndarray, back: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """-log p(word | head) of an interpolated, absolutely discounted bigram model."""
    return -np.log(np.maximum(times - DISCOUNT, 0) / heads + back * alone).astype(np.float32).astype(np.float64)


def _columns(df: DataFrame) -> list[np.ndarray]:
    table = df.toArrow()
    return [table.column(c).to_numpy() for c in df.columns]


def cross_entropy_difference(docs: DataFrame, target: DataFrame, background: DataFrame, id_col: str = "doc_id",
                             text_col: str = "text", ids: int | None = None, common: int = COMMON) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, target_loss, background_loss
    (nats a token) and score, their difference.

    The words alone are smoothed over all words of both corpora and two more, or over
    ``ids`` if that is more; no word is left out for either. ``common`` is the most
    pairs that are broadcast and changes no result. NULL and empty texts count
    nothing, and score 0 with losses 0. Empty corpora give the smoothed model without
    counts. NULL and repeated ids are scored as they come; repeated rows count as
    often as they occur."""
    sc = docs.sparkSession.sparkContext
    texts, usual = _texts(docs, target, background, text_col), int(docs is background)
    words = scratch.table(_words(texts))
    size = words.agg(F.sum("word_t"), F.sum("word_b"), F.count_if(F.expr("word_t + word_b > 0")), F.count(F.lit(1)), F.sum("n")).first()
    n = max(ids or 0, size[2] + 2)
    tokens = {"t": (size[0] or 0) + n, "b": (size[1] or 0) + n}  # what the words alone are divided by

    cold = repeated = None
    hot = words
    if size[3] > scratch.BROADCAST_ROWS:
        often = _common(words, F.col("n"), scratch.BROADCAST_ROWS)
        hot = words.where(often)
        # not: once, in a scored text
        cold = words.where(~often).where(f"NOT (total_t = 0 AND total_b <= {usual} AND word_t = 0 AND word_b = {usual})")
        if cold.count() <= REPEATED:
            repeated = np.unique(_columns(cold.select(F.shiftright("word", 32).cast("int").alias("part")))[0].view(np.uint32))
    hashes, every, *counts = _columns(hot.select("word", *COUNTS))  # at most BROADCAST_ROWS rows
    order = np.lexsort((hashes, -every))
    hashes, counts = hashes[order].view(U), [c[order] for c in counts]
    order = np.argsort(hashes)
    known = sc.broadcast((hashes[order], np.append(order, len(order)).astype(U), repeated))
    common = min(isqrt(common), len(order))
    buckets = min(max(scratch.partitions(docs.sparkSession), (size[4] or 0) // HELD), (1 << 16) - 1)
    pieces = _postings(texts, known, common, buckets)
    if cold is not None:
        cold = cold.withColumn("word", F.col("word").bitwiseOR(F.lit(-(1 << 63))))
        pieces = pieces.unionByName(_counts(cold.select("word", *COUNTS[1:]), buckets))
    pairs = scratch.table(_counted(pieces, common, usual))
    del pieces
    scratch.forget(docs.sparkSession)  # the shuffle of the tokens

    # a head has as many kinds of words after it as tokens, but for those that come again
    at, *less = _columns(pairs.where(f"kind = {AGAIN}").groupBy("head").agg(F.sum("t"), F.sum("b")))
    models = []
    for total, word, minus, one, x in zip(counts[:2], counts[2:], less, (0, usual), "tb"):
        kinds = total.copy()
        kinds[at] -= minus
        # the last: a word that occurs once
        models.append((*_weights(np.append(total, one), np.append(kinds, one)), (np.append(word, one) + 1) / tokens[x]))
    head, word, *times = _columns(pairs.where(f"kind = {OFTEN}").select("head", "word", "t", "b"))  # at most ``common`` squared
    extra = [np.zeros(common * common + 1) for _ in "tb"]
    for x, c, one, (heads, back, single) in zip(extra, times, (0, usual), models):
        known_at = heads[head], back[head], single[word]
        x[head * common + word] = _loss(c, *known_at) - _loss(one, *known_at)
    shared, extra = sc.broadcast(models), sc.broadcast(extra)

    def score(batches):
        scanner, here, models = Scanner(lower=True), known.value, shared.value
        once = len(here[0])
        for batch in batches:
            for w in scanner.blocks(batch.column("text")):
                size = np.diff(w.first)
                head, word = _tokens(w, here)
                away = (head >= AWAY) | (word >= AWAY)
                head[away] = word[away] = once
                head, word = head.view(np.int64), word.view(np.int64)
                often = np.flatnonzero((head < common) & (word < common))
                both = head[often] * common + word[often]
                sums = []
                for one, (heads, back, single), more in zip((0, usual), models, extra.value):
                    loss = _loss(one, heads[head], back[head], single[word])
                    loss[away] = 0
                    loss[often] += more[both]
                    sums.append(pa.array(per_text(loss, w.first)))
                yield pa.record_batch([batch.column("doc_id")[w.lo:w.lo + len(size)], pa.array(signed(_keys(w)), mask=size == 0),
                                       pa.array(size), *sums], ["doc_id", "key", "n", *LOSSES])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    rows = scratch.table(source.mapInArrow(score, f"doc_id {kind}, key long, n long, target_loss double, background_loss double"))
    found = scratch.table(_more(pairs.where(f"kind = {PAIRS}"), shared, usual, tokens))
    keys = pairs.where(f"kind = {KEYS}").select("chunk", "kind", "n", "data")
    sums = found.where("word IS NULL").select("chunk", "n", "data").unionByName(keys, allowMissingColumns=True)
    if cold is not None:
        def loss(x, one):
            alone = (F.coalesce(f"word_{x}", F.lit(one)) + 1) / F.lit(float(tokens[x]))
            p = F.greatest(F.col(x) - DISCOUNT, F.lit(0.0)) / F.col(f"heads_{x}") + F.col(f"back_{x}") * alone
            return (-F.ln(p)).cast("float").cast("double") * F.col("times")
        both = found.where("word IS NOT NULL").select("chunk", "text", "times", "word", "t", "b", "heads_t", "back_t", "heads_b", "back_b")
        both = both.join(cold.select("word", *WORD), "word", "left")
        sums = sums.unionByName(both.groupBy("chunk", "text").agg(*(F.sum(loss(x, one)).alias(c) for x, one, c in zip("tb", (0, usual), LOSSES))),
                                allowMissingColumns=True)
    else:
        sums = sums.select("*", F.lit(None).cast("long").alias("text"), *(F.lit(None).cast("double").alias(c) for c in LOSSES))
    # every copy of a text has asked for itself, so their sum is shared by them
    copies = rows.where("key IS NOT NULL").select("key", *(F.lit(0.0).alias(c) for c in LOSSES), F.lit(1).alias("copies"))
    more = scratch.table(_by_key(sums).withColumn("copies", F.lit(0)).unionByName(copies).groupBy("key")
                         .agg(*((F.sum(c) / F.sum("copies")).alias(f"_{c}") for c in LOSSES)))
    scratch.drop(words, pairs, found)
    each = F.greatest("n", F.lit(1))
    t, b = ((F.col(c) + F.coalesce(f"_{c}", F.lit(0.0))) / each for c in LOSSES)
    return rows.join(more, "key", "left").select("doc_id", F.col("n").alias("n_tokens"), t.alias("target_loss"),
                                                 b.alias("background_loss"), (t - b).alias("score"))
