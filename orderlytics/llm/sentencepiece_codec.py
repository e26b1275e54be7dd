"""SentencePiece encoding and decoding by suffix-array matching.

The distinct words of a batch are joined into one byte string and its suffixes are
sorted. Every piece of the model is binary-searched in them; the range found gives
all places where it occurs, as edges from its start to its end. Sorted by position,
the edges are relaxed for all words at once: of the pieces that end at a place, the
last piece of the encoding up to there is the one that can follow the last piece
of the encoding up to its start.

That pairs of neighbours decide holds for byte-pair encoding: a string of pieces is
an encoding exactly if every two neighbours are the encoding of their two strings.
Undoing the two pieces' merges from the latest one back shows it: at no moment may
the symbols at the border have an earlier merge than the one undone.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlytics.llm.textscan import release

#: Texts whose distinct words are looked up together.
TEXTS = 1024
#: Most words in one index.
WORDS = 40_000
#: Distinct words whose ids a task remembers: those of the last texts, in two generations.
KNOWN = 300_000
SPACE = "▁"
FOREIGN = -2  # a character that is no piece; spelled in bytes


class Pieces(NamedTuple):
    """What matching needs of a model; a few numbers per piece."""
    text: list[bytes]        # by id; empty for control, unknown and byte pieces
    rank: np.ndarray         # merge order by id; that of base symbols is -1
    left: np.ndarray         # the symbols of a piece's last merge, -1 for base symbols
    right: np.ndarray
    pair: np.ndarray         # left * size + right of pairs that can merge, a hash table; -1 where it is free
    merged: np.ndarray       # the rank of the piece they form
    usable: np.ndarray       # whether a piece is its own encoding
    byte: np.ndarray         # ids of the byte pieces
    chars: frozenset[str]
    sought: "Sought"         # the usable pieces, as matching looks for them


class Sought(NamedTuple):
    """Strings to be found: what their first 16 bytes lie between, as two numbers each."""
    text: list[bytes]
    id: np.ndarray
    size: np.ndarray
    least: np.ndarray
    most: np.ndarray


def sought(text: list[bytes], id_: np.ndarray) -> Sought:
    def padded(pad):
        return np.frombuffer(b"".join(q[:16].ljust(16, pad) for q in text), ">u8").reshape(-1, 2).astype(np.uint64)
    return Sought(text, id_, np.array([len(q) for q in text]), padded(b"\0"), padded(b"\xff"))


def merge(symbols: list[str], rank: dict[str, int]) -> list[tuple[str, tuple[str, str] | None]]:
    """Byte-pair merging by the book: the lowest rank first, the leftmost of equals.
    Returns the symbols left, each with the two it was merged from."""
    parts: list[tuple[str, tuple[str, str] | None]] = [(s, None) for s in symbols]
    while len(parts) > 1:
        best = min(((rank.get(a[0] + b[0], 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
        if best[0] == 1 << 60:
            break
        i = best[1]
        parts[i:i + 2] = [(parts[i][0] + parts[i + 1][0], (parts[i][0], parts[i + 1][0]))]
    return parts


def load(path: str) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    plain = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(size)]
    name = [model.id_to_piece(i) if plain[i] else "" for i in range(size)]
    ids = {s: i for i, s in enumerate(name) if s}
    score = {s: -model.get_score(i) for s, i in ids.items() if len(s) > 1}
    order = {v: r for r, v in enumerate(sorted(set(score.values())))}
    rank = {s: order[v] for s, v in score.items()}
    left, right = np.full(size, -1), np.full(size, -1)
    usable, pairs = np.zeros(size, dtype=bool), {}
    for s, i in ids.items():
        whole = merge(list(s), rank)
        usable[i] = len(whole) == 1
        if usable[i] and whole[0][1]:
            left[i], right[i] = (ids.get(x, -1) for x in whole[0][1])
        for cut in range(1, len(s)):
            if s[:cut] in ids and s[cut:] in ids:
                pairs[ids[s[:cut]] * size + ids[s[cut:]]] = rank[s]
    keys, merged = hashed(np.array(sorted(pairs), np.int64), np.array([pairs[k] for k in sorted(pairs)], np.int64))
    byte = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
    use = np.flatnonzero(usable & np.array([s != "" for s in name]))
    use = np.array(sorted(use.tolist(), key=lambda i: name[i].encode()), np.int64)  # searched for in order, which is faster
    return Pieces([s.encode() for s in name], np.array([rank.get(s, -1) for s in name]), left, right, keys, merged, usable, byte,
                  frozenset(s for s in ids if len(s) == 1), sought([name[i].encode() for i in use], use))


def _slots(keys: np.ndarray, size: int) -> np.ndarray:
    """Where each key is looked for first, in a table of ``size`` slots, a power of two."""
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def hashed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (0 or more) and their values in a table with free slots (-1) after
    every run of keys: a key stands in its slot, or in one of those that follow."""
    size = 1 << max(4, (4 * len(keys)).bit_length())
    table, held = np.full(size, -1, np.int64), np.full(size, 1 << 60, np.int64)
    slot, left = _slots(keys, size), np.arange(len(keys))
    while len(left):
        free = table[slot[left]] < 0
        at, first = np.unique(slot[left][free], return_index=True)
        table[at], held[at] = keys[left[free][first]], values[left[free][first]]
        left = left[table[slot[left]] != keys[left]]
        slot[left] = (slot[left] + 1) & (size - 1)
    return table, held


def look_up(table: np.ndarray, held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The keys' values; 1 << 60 for those that ``table`` has not."""
    slot = _slots(keys, len(table))
    found = table[slot]
    out = held[slot]  # 1 << 60 where the slot is free
    away = np.flatnonzero((found != keys) & (found >= 0))
    while len(away):
        slot[away] = (slot[away] + 1) & (len(table) - 1)
        found = table[slot[away]]
        out[away] = held[slot[away]]
        away = away[(found != keys[away]) & (found >= 0)]
    return out


def _plain(p: Pieces) -> tuple:
    """``p`` without classes of this library: a broadcast is read without it."""
    return *p[:-1], tuple(p.sought)


def _pieces(plain: tuple) -> Pieces:
    return Pieces(*plain[:-1], Sought(*plain[-1]))


def follows(p: Pieces, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether piece ``b`` can stand right after piece ``a`` in an encoding."""
    ok = np.ones(len(a), dtype=bool)
    at = np.flatnonzero((a >= 0) & (b >= 0))  # beside a border or a foreign character all can
    x, y = a[at].copy(), b[at].copy()
    limit, size = np.full(len(at), 1 << 61), len(p.text)
    loose = np.zeros(len(at), dtype=bool)  # the merge undone last was right of the border: equals go first
    while len(at):
        early = look_up(p.pair, p.merged, x * size + y)
        bad = (early < limit) & (early < 1 << 60) | loose & (early == limit)
        ok[at[bad]] = False
        later = p.rank[y] >= p.rank[x]  # of two equal merges the left one came first
        end = bad | (p.left[x] < 0) & (p.left[y] < 0)
        limit = np.where(later, p.rank[y], p.rank[x])
        x, y = np.where(later, x, p.right[x]), np.where(later, p.left[y], y)
        loose = later
        at, x, y, limit, loose = (v[~end] for v in (at, x, y, limit, loose))
    return ok


def _keys(data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The 16 bytes from each of ``n`` places on, as two ordered numbers."""
    low = np.zeros(n + 8, np.uint64)
    for j in range(8):
        low |= data[j:j + n + 8].astype(np.uint64) << np.uint64(56 - 8 * j)
    return low[:n], low[8:n + 8]


def occurrences(words: list[bytes], pieces: Sought) -> tuple[np.ndarray, np.ndarray]:
    """(start, piece) of every occurrence of the pieces in the words, which stand one
    after the other with a byte 0xFF behind each."""
    joined = b"\xff".join([*words, b""])
    n = len(joined)
    data = np.frombuffer(joined + b"\xff" * 80, np.uint8)
    high, low = _keys(data, n)
    suffix = np.lexsort((low, high))
    high, low = high[suffix], low[suffix]

    def within(key, a, b, right):  # the same search in the second numbers of each range
        while (open_ := a < b).any():
            mid = (a + b) // 2
            at = low[np.minimum(mid, n - 1)]
            up = open_ & ((at <= key) if right else (at < key))
            a, b = np.where(up, mid + 1, a), np.where(open_ & ~up, mid, b)
        return a

    # of pieces of 8 bytes or fewer, the first numbers tell all
    deep = np.flatnonzero(pieces.size > 8)
    first = np.searchsorted(high, pieces.least[:, 0], "left")
    last = np.searchsorted(high, pieces.most[:, 0], "right")
    both = np.searchsorted(high, pieces.least[deep, 0], "right")  # first numbers are equal for least and most
    first[deep], last[deep] = (within(pieces.least[deep, 1], first[deep], both, False),
                               within(pieces.most[deep, 1], first[deep], both, True))
    count = np.maximum(0, last - first)
    piece = np.repeat(np.arange(len(pieces.text)), count)
    start = suffix[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - first, count)]
    long = np.flatnonzero(pieces.size[piece] > 16)
    keep = np.ones(len(start), dtype=bool)
    keep[long] = [joined.startswith(pieces.text[piece[i]], start[i]) for i in long]
    return start[keep], piece[keep]


def encode_words(p: Pieces, words: list[str]) -> list[bytes]:
    """The ids of every word, as little-endian unsigned 32-bit numbers. Words with two
    word marks in a row, whose merges share one score, are merged by the book."""
    out: list = [None] * len(words)
    easy, names = [], None
    for i, word in enumerate(words):
        if SPACE * 2 in word:
            ids, rank = names or (_ids(p), _ranks(p))
            names = ids, rank
            out[i] = np.concatenate([[ids[s]] if s in ids else p.byte[list(s.encode())]
                                     for s, _ in merge(list(word), rank)]).astype("<u4").tobytes()
        else:
            easy.append(i)
    if not easy:
        return out
    raw = [words[i].encode() for i in easy]
    start, piece = occurrences(raw, p.sought)
    end, piece = start + p.sought.size[piece], p.sought.id[piece]
    begin = np.concatenate(([0], np.cumsum([len(w) + 1 for w in raw])))
    # the characters that are no pieces, and their places in bytes
    chars = np.frombuffer("\0".join([*(words[i] for i in easy), ""]).encode("utf-32-le"), "<u4")
    odd = np.ones(0x110000, dtype=bool)
    odd[[ord(c) for c in p.chars]] = False
    odd = odd[chars]
    odd[np.cumsum([len(words[i]) + 1 for i in easy]) - 1] = False
    odd = np.flatnonzero(odd)
    wide = 1 + (chars > 0x7F).astype(np.int64) + (chars > 0x7FF) + (chars > 0xFFFF)
    foreign, size = (np.cumsum(wide) - wide)[odd], wide[odd]
    start, end = np.r_[start, foreign], np.r_[end, foreign + size]
    piece = np.r_[piece, np.full(len(odd), FOREIGN)]
    depth = end - np.repeat(begin[:-1], np.diff(begin))[start]
    if len(depth) and depth.max() < 1 << 16:
        depth = depth.astype(np.uint16)  # sorted faster
    order = np.argsort(depth, kind="stable")
    start, end, piece, depth = start[order], end[order], piece[order], depth[order]
    last, back = np.full(begin[-1] + 1, -1), np.full(begin[-1] + 1, -1)
    cuts = np.searchsorted(depth, np.arange(1, (int(depth[-1]) if len(depth) else 0) + 2))
    for lo, hi in zip(cuts, cuts[1:]):
        s, t = start[lo:hi], piece[lo:hi]
        good = follows(p, last[s], t)
        last[end[lo:hi][good]], back[end[lo:hi][good]] = t[good], s[good]
    # read the pieces back from the ends of all words at once, each to where it begins
    at, first = begin[1:] - 1, begin[:-1]
    there = np.full(begin[-1], -1)
    while len(at):
        from_ = back[at]
        there[from_] = last[at]
        more = from_ > first
        at, first = from_[more], first[more]
    begins = there != -1
    ends = np.concatenate(([0], np.cumsum(begins)))[begin].tolist()
    at, ids = np.flatnonzero(begins), there[begins]
    if len(odd):
        n = np.ones(len(at), np.int64)
        n[ids < 0] = size  # every one of them stands alone, and is spelled in bytes
        data = np.frombuffer(b"\xff".join([*raw, b""]), np.uint8)
        ends = np.concatenate(([0], np.cumsum(n)))[ends].tolist()
        spelled = np.repeat(ids < 0, n)
        ids = np.repeat(ids, n)
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        ids[spelled] = p.byte[data[np.repeat(foreign, size) + step]]
    flat = ids.astype("<u4").tobytes()
    for i, lo, hi in zip(easy, ends, ends[1:]):
        out[i] = flat[4 * lo:4 * hi]
    return out


def _ids(p: Pieces) -> dict[str, int]:
    return {t.decode(): i for i, t in enumerate(p.text) if t}


def _ranks(p: Pieces) -> dict[str, int]:
    return {t.decode(): int(r) for t, r in zip(p.text, p.rank) if r >= 0}


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids (binary: little-endian
    unsigned 32-bit), as the model's own processor encodes the text. The model must
    be a byte-pair model with byte fallback, whose pieces hold the word mark only in
    front. NULL and empty texts have no ids; NULL and repeated ids stay as they are."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(_plain(load(model)))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import sentencepiece

        pieces = _pieces(shared.value)
        normal = sentencepiece.SentencePieceProcessor(model_file=model)
        split = re.compile(f"(?s){SPACE}*[^{SPACE}]+|{SPACE}+")
        known: dict[str, bytes] = {}
        older: dict[str, bytes] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS):
                part = batch.slice(lo, TEXTS)
                texts = [split.findall(normal.normalize(t) if t else "") for t in part.column("text").to_pylist()]
                if len(known) > KNOWN // 2:
                    known, older = {}, known
                words = set().union(*texts) - known.keys()
                known |= {w: older[w] for w in words & older.keys()}
                new = list(words - older.keys())
                for at in range(0, len(new), WORDS):
                    some = new[at:at + WORDS]
                    known.update(zip(some, encode_words(pieces, some)))
                ids = [b"".join(map(known.__getitem__, t)) for t in texts]
                yield pa.record_batch([part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()),
                                       pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])
            release()

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary")


def decode(encoded: DataFrame, model: str, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``encoded`` and text, the decoded ``ids`` (NULL: NULL).
    Bytes that are not UTF-8 become U+FFFD."""
    kinds = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in keep)
    shared = encoded.sparkSession.sparkContext.broadcast(_plain(load(model)))

    def run(batches):
        p = _pieces(shared.value)
        spelled = [t.replace(SPACE.encode(), b" ") for t in p.text]
        for b, i in enumerate(p.byte):
            spelled[i] = bytes([b])
        # after them, how they are spelled at the beginning of a text, where a blank is left out
        pieces = pa.array([*spelled, *(t.removeprefix(b" ") for t in spelled)], pa.large_binary())
        empty = np.array([t == b"" for t in spelled])

        def text(part):
            """The texts of an array of ids."""
            _, offsets, data = part.buffers()
            offsets = np.frombuffer(offsets, np.int64)[part.offset:part.offset + len(part) + 1]
            ids = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]].view("<u4") if offsets[-1] > offsets[0] else np.zeros(0, "<u4")
            begin = (offsets - offsets[0]) // 4
            ids = ids.astype(np.int64)
            lead = begin[:-1][np.diff(begin) > 0]
            if empty[ids[lead]].any():
                raise ValueError("control pieces have no text")
            ids[lead] += len(spelled)
            _, ends, data = pieces.take(pa.array(ids)).buffers()
            ends = np.frombuffer(ends, np.int64)[:len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
            return pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(ends[begin].tobytes()), data or pa.py_buffer(b"")])

        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS):
                part = batch.slice(lo, TEXTS)
                ids = part.column("ids")
                try:
                    texts = text(pc.fill_null(ids, b"").cast(pa.large_binary())).cast(pa.large_string()).cast(pa.string())
                except (pa.ArrowInvalid, ValueError):  # bytes that are not UTF-8, or control pieces: one text after the other
                    texts = pa.array([b"".join(map(spelled.__getitem__, np.frombuffer(x or b"", "<u4").tolist()))
                                      .decode(errors="replace").removeprefix(" ") for x in ids.to_pylist()], pa.string())
                yield pa.record_batch([*(part.column(c) for c in keep), pc.if_else(ids.is_valid(), texts, pa.scalar(None, pa.string()))],
                                      names=[*keep, "text"])
            release()

    return encoded.select(*dict.fromkeys([*keep, "ids"])).mapInArrow(run, f"{kinds}, text string")
