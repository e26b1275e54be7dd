"""Hard negatives by integer inner product, found with a packed R-tree.

Vectors are rounded to integers and packed by sort-tile-recursive order: Spark cuts
the vectors of a label into tiles along two coordinates, at quantiles; a tile packs
its vectors into leaves along further ones. One row of the index holds a tile: its
vectors in leaf order, and the smallest boxes around it, its inner nodes and leaves.
A box gives, coordinate by coordinate, the least and the greatest inner product that
a vector in it can have with the anchor.

A search asks for an anchor's best ``k`` scores in each of several score windows. The
directory of tile boxes names the tiles that can hold any; the most promising one is
searched first, the others only where their bound still reaches the k-th score found.
Inside a tile a best-first queue opens the box of the greatest bound, and drops boxes
that lie outside every window or strictly below its k-th score. The anchor's positives
are one search, of one window without limits over its own label; the negatives are
another, with one window per positive, over the other labels.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlytics.llm import scratch

#: Vectors of a tile and of a leaf, children of an inner node.
TILE, LEAF, FANOUT = 8192, 128, 16
#: Anchors that a task holds, tile boxes in a row of the directory, tiles searched in the first round.
ANCHORS, DIRECTORY, FIRST = 1024, 1024, 1
#: Bounds of a window without limits, and of exact arithmetic.
FAR, EXACT, LONG = 1 << 62, 1 << 53, 1 << 63
_JITTER = 1 << 20


def finite(vector: Column) -> Column:
    """Not NULL, and without NULL, NaN or infinite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _cuts(rows: DataFrame, keys: list[str], key: str, parts: str) -> DataFrame:
    """``rows`` with ``cut``: the place of ``key`` among the quantiles that divide its
    group into as many parts as ``parts`` says."""
    fine = F.percentile_approx(key, [i / 1000 for i in range(1, 1001)], 20000)
    ends = rows.groupBy(*keys).agg(fine.alias("_ends"), F.max(parts).alias("_parts"))
    ends = ends.select(*keys, F.expr("transform(sequence(1, least(_parts, 1000)), i -> element_at("
                                     "_ends, greatest(1, cast(i * 1000 / least(_parts, 1000) as int))))").alias("_ends"))
    place = F.expr(f"size(filter(slice(_ends, 1, size(_ends) - 1), e -> e < {key}))")
    return rows.join(scratch.bounded(scratch.table(ends)), keys).withColumn("cut", place).drop("_ends")


def _wide(x: np.ndarray, y: np.ndarray, d: int) -> type:
    """The type in which all products of ``x`` and ``y`` are exact."""
    most = int(np.abs(x).max(initial=0)) * int(np.abs(y).max(initial=0)) * max(d, 1)
    if most >= LONG:
        raise OverflowError("an inner product goes beyond 64 bits")
    return np.float64 if most < EXACT else np.int64


def _bounds(anchors: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner products, anchors by boxes."""
    kind = _wide(anchors, np.concatenate([lo.ravel(), hi.ravel()]), anchors.shape[1])
    up, down = np.maximum(anchors, 0).astype(kind), np.minimum(anchors, 0).astype(kind)
    lo, hi = lo.T.astype(kind), hi.T.astype(kind)
    return (up @ lo + down @ hi).astype(np.int64), (up @ hi + down @ lo).astype(np.int64)


def pack_order(x: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Sort-tile-recursive order: along the coordinate of the greatest spread into
    slabs, each slab along the next, until a part fits a leaf."""
    spread = np.argsort(-x.std(axis=0), kind="stable") if x.shape[1] else np.zeros(0, int)

    def cut(rows: np.ndarray, depth: int) -> list[np.ndarray]:
        leaves = -(-len(rows) // leaf)
        if leaves <= 1 or depth == len(spread):
            return [rows]
        slabs = leaves if depth + 1 == len(spread) else max(2, round(leaves ** (1 / min(3, len(spread) - depth))))
        size = -(-leaves // slabs) * leaf
        rows = rows[np.argsort(x[rows, spread[depth]], kind="stable")]
        return [part for at in range(0, len(rows), size) for part in cut(rows[at:at + size], depth + 1)]

    return np.concatenate(cut(np.arange(len(x)), 0)) if len(x) else np.zeros(0, int)


def boxes(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and greatest coordinates of every ``size`` rows."""
    at = np.arange(0, len(x), size)
    return np.minimum.reduceat(x, at, axis=0), np.maximum.reduceat(x, at, axis=0)


def search_tile(ids: np.ndarray, x: np.ndarray, own: np.ndarray, anchors: np.ndarray, windows: list, k: int):
    """(anchor's place, window, ids, scores): of each anchor and window the best ``k``
    rows of the tile, fewer if no more can matter. ``windows``: per anchor a list of
    (window, least score, greatest score)."""
    d = x.shape[1]
    leaf_lo, leaf_hi = boxes(x, LEAF)
    node_lo = np.minimum.reduceat(leaf_lo, np.arange(0, len(leaf_lo), FANOUT), axis=0)
    node_hi = np.maximum.reduceat(leaf_hi, np.arange(0, len(leaf_hi), FANOUT), axis=0)
    nodes, leaves = len(node_lo), len(leaf_lo)
    least, most = _bounds(anchors, np.concatenate([node_lo, leaf_lo]), np.concatenate([node_hi, leaf_hi]))
    kind = _wide(anchors, x, d)
    x, anchors = x.astype(kind), anchors.astype(kind)
    for i, (anchor, asked) in enumerate(zip(anchors, windows)):
        low, high = least[i].tolist(), most[i].tolist()
        found = {w: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for w, _, _ in asked}
        reach = {w: lo for w, lo, _ in asked}    # scores below do not count
        queue = [(-high[n], n) for n in range(nodes)]
        heapq.heapify(queue)
        while queue:
            bound, n = heapq.heappop(queue)
            if -bound < min(reach.values()):
                break
            open_to = [(w, hi) for w, _, hi in asked if -bound >= reach[w] and low[n] <= hi]
            if not open_to:
                continue
            if n < nodes:
                for child in range(nodes + n * FANOUT, nodes + min((n + 1) * FANOUT, leaves)):
                    heapq.heappush(queue, (-high[child], child))
                continue
            at = (n - nodes) * LEAF
            near, score = ids[at:at + LEAF], (x[at:at + LEAF] @ anchor).astype(np.int64)
            other = near != own[i]
            for w, hi in open_to:
                good = other & (score >= reach[w]) & (score <= hi)
                if good.any():
                    a, s = np.concatenate([found[w][0], near[good]]), np.concatenate([found[w][1], score[good]])
                    best = np.lexsort((a, -s))[:k]
                    found[w] = a[best], s[best]
                    if len(best) == k:
                        reach[w] = max(reach[w], int(s[best[-1]]))
        for w, (a, s) in found.items():
            if len(a):
                yield i, w, a, s


class RTree:
    """The index of ``rows`` (id, vec: array<long>, label): one stored row per tile."""

    def __init__(self, rows: DataFrame):
        rows = rows.withColumn("dim", F.size("vec"))
        keys = ["dim", "label"]
        sizes = rows.groupBy(*keys).count().withColumn("tiles", F.ceil(F.col("count") / TILE).cast("int"))
        sizes = sizes.withColumn("slabs", F.ceil(F.sqrt("tiles")).cast("int"))
        sizes = sizes.withColumn("each", F.ceil(F.col("tiles") / F.col("slabs")).cast("int"))
        rows = rows.join(scratch.bounded(scratch.table(sizes)), keys)
        for depth, parts in enumerate(("slabs", "each")):
            # equal coordinates are told apart by a hash of the id, so that copies fill many tiles
            place = F.try_element_at("vec", F.lit(depth + 1))
            key = F.coalesce(F.greatest(F.least(place, F.lit(1 << 40)), F.lit(-(1 << 40))), F.lit(0)) * _JITTER + F.pmod(
                F.xxhash64("id"), F.lit(_JITTER))
            rows = _cuts(rows.withColumn("_key", key), keys, "_key", parts).withColumnRenamed("cut", f"cut{depth}")
            keys = [*keys, f"cut{depth}"]

        def pack(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            ids = table.column("id").to_numpy()
            by = np.argsort(ids)
            x = table.column("vec").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[by]
            order = pack_order(x)
            x, ids = x[order], ids[by][order]
            lo, hi = (x.min(axis=0), x.max(axis=0)) if x.shape[1] else (np.zeros(0, np.int64),) * 2
            return pa.table({"dim": pa.array([x.shape[1]], pa.int32()), "label": table.column("label")[:1],
                             "n": pa.array([len(ids)], pa.int64()), "ids": [ids.tobytes()],
                             "vecs": [x.astype(np.int64).tobytes()], "lo": [lo.tobytes()], "hi": [hi.tobytes()]})

        kind = rows.schema["label"].dataType.simpleString()
        packed = rows.select(*keys, "id", "vec").groupBy(*keys).applyInArrow(
            pack, f"dim int, label {kind}, n long, ids binary, vecs binary, lo binary, hi binary")
        # stored with its number before that is used
        self.tiles = scratch.table(packed.withColumn("tile", F.monotonically_increasing_id()))
        self.count = self.tiles.count()

    def search(self, asks: DataFrame, same: bool, k: int) -> DataFrame:
        """anchor, window, id, score: the best ``k`` rows in each window of ``asks``
        (anchor, label, vec, windows: array of (window, lo, hi)) over tiles of the
        anchor's label, or of the others."""
        spark = asks.sparkSession
        blocks = max(1, -(-asks.count() // ANCHORS))
        parts = max(1, -(-self.count // DIRECTORY))
        block = F.pmod(F.xxhash64("anchor", F.lit(3)), F.lit(blocks)).cast("int")
        asks = scratch.table(asks.withColumn("block", block).withColumn("dim", F.size("vec")))
        # a row of the directory is a part of it; every block of anchors meets every part
        directory = self.tiles.select("tile", "dim", "label", "lo", "hi", F.pmod(F.xxhash64("tile"), F.lit(parts)).cast("int").alias("part"),
                                      F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        asking = asks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

        def route(asked: pa.Table, boxes_of: pa.Table) -> pa.Table:
            out = {"anchor": [], "tile": [], "low": [], "high": []}
            if len(asked) and len(boxes_of):
                a, b = asked.to_pandas(), boxes_of.to_pandas()
                for dim, tiles in b.groupby("dim"):
                    mine = a[a["dim"] == dim]
                    if not len(mine):
                        continue
                    vecs = np.array(mine["vec"].tolist(), np.int64).reshape(len(mine), dim)
                    lo, hi = (np.frombuffer(b"".join(tiles[c]), np.int64).reshape(len(tiles), dim) for c in ("lo", "hi"))
                    low, high = _bounds(vecs, lo, hi)
                    fits = (mine["label"].to_numpy()[:, None] == tiles["label"].to_numpy()[None, :]) == same
                    for i, windows in enumerate(mine["windows"]):
                        fits[i] &= np.logical_or.reduce([(high[i] >= w["lo"]) & (low[i] <= w["hi"]) for w in windows])
                    i, t = np.nonzero(fits)
                    for name, values in zip(out, (mine["anchor"].to_numpy()[i], tiles["tile"].to_numpy()[t], low[i, t], high[i, t])):
                        out[name].append(values)
            return pa.table({c: np.concatenate([np.zeros(0, np.int64), *v]).astype(np.int64) for c, v in out.items()})

        routes = asking.groupBy("part", "block").cogroup(directory.groupBy("part", "block")).applyInArrow(
            route, "anchor long, tile long, low long, high long")
        turn = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("high"), "tile"))
        routes = scratch.table(routes.withColumn("turn", turn))
        first = self._visit(asks, routes.where(F.col("turn") <= FIRST), k)
        first = scratch.table(self._best(first, k))
        if not routes.where(F.col("turn") > FIRST).limit(1).count():
            return first
        kth = first.groupBy("anchor", "window").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
        kth = kth.where(F.col("n") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("window", "kth"))).alias("kth"))
        raised = asks.join(kth, "anchor", "left").withColumn("windows", F.expr(
            "transform(windows, w -> named_struct('window', w.window, 'lo', greatest(w.lo, coalesce(kth[w.window], w.lo)), 'hi', w.hi))"))
        raised = scratch.table(raised.drop("kth"))
        rest = routes.where(F.col("turn") > FIRST).join(raised.select("anchor", "windows"), "anchor")
        rest = rest.where(F.expr("exists(windows, w -> high >= w.lo and low <= w.hi)")).drop("windows")
        return self._best(first.unionByName(self._visit(raised, rest, k)), k)

    def _best(self, found: DataFrame, k: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id"))
        return found.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")

    def _visit(self, asks: DataFrame, routes: DataFrame, k: int) -> DataFrame:
        """What each anchor finds in the tiles that ``routes`` sends it to."""
        asked = routes.select("anchor", "tile").join(asks, "anchor").select("tile", "block", "anchor", "vec", "windows")
        asked = scratch.table(asked)
        places = asked.select("tile", F.col("block").alias("to_block")).distinct()
        pages = places.join(self.tiles.select("tile", "dim", "ids", "vecs"), "tile").withColumnRenamed("tile", "page")

        def visit(asked: pa.Table, page: pa.Table) -> pa.Table:
            out = [[], [], [], []]
            if len(asked) and len(page):
                page = page.to_pylist()[0]
                ids = np.frombuffer(page["ids"], np.int64)
                x = np.frombuffer(page["vecs"], np.int64).reshape(len(ids), page["dim"])
                own = asked.column("anchor").to_numpy()
                anchors = asked.column("vec").combine_chunks().flatten().to_numpy().reshape(len(own), page["dim"])
                windows = [[(w["window"], w["lo"], w["hi"]) for w in ws] for ws in asked.column("windows").to_pylist()]
                for i, w, a, s in search_tile(ids, x, own, anchors, windows, k):
                    for column, values in zip(out, (np.full(len(a), own[i]), np.full(len(a), w), a, s)):
                        column.append(values)
            names = ("anchor", "window", "id", "score")
            return pa.table({c: np.concatenate([np.zeros(0, np.int64), *v]).astype(np.int64) for c, v in zip(names, out)})

        return asked.groupBy("tile", "block").cogroup(pages.groupBy("page", "to_block")).applyInArrow(
            visit, "anchor long, window long, id long, score long")


def _floor_div(x: Column, by: int) -> Column:
    return F.call_function("div", x - F.pmod(x, F.lit(by)), F.lit(by))


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
         scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    A component x counts as floor(scale * x); a score is the integer inner product of a
    row and an anchor; higher scores come first, ties by smaller id. The positives of
    an anchor, a row where ``is_anchor`` holds, are its first ``positives`` other rows
    of the same ``label``. For each of them come the first ``negatives`` rows of other
    labels whose score is ``low`` to ``high`` per cent of the positive's.

    Rows with a NULL id, label or vector, or with a NULL or non-finite component, take
    no part. Vectors of different lengths have no inner product: they never meet. Of
    rows repeated with one id, the least (label, vector) counts. Empty vectors score 0.
    An empty table gives an empty result; a score beyond 64 bits fails the job."""
    vector = F.col(vector_col).cast("array<double>")
    clean = rows.select(F.col(id_col).cast("long").alias("id"), (F.col("label") if label is None else label).alias("label"),
                        vector.alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    clean = clean.where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("vec")))
    clean = clean.withColumn("vec", F.transform("vec", lambda x: F.floor(x * float(scale)).cast("long")))
    clean = clean.groupBy("id").agg(F.min(F.struct("label", "vec", "asks")).alias("row")).select("id", "row.*")
    clean = scratch.table(clean)
    tree = RTree(clean.drop("asks"))
    anchors = clean.where("asks").select(F.col("id").alias("anchor"), "label", "vec")
    open_to = F.array(F.struct(F.lit(0).cast("long").alias("window"), F.lit(-FAR).alias("lo"), F.lit(FAR).alias("hi")))
    found = scratch.table(tree.search(anchors.withColumn("windows", open_to), True, positives).drop("window"))
    found = found.withColumnsRenamed({"id": "positive_id", "score": "positive_score"})
    score = F.col("positive_score")
    up = -_floor_div(-(score * low), 100)
    windows = found.select("anchor", F.col("positive_id").alias("window"), up.cast("long").alias("lo"),
                           _floor_div(score * high, 100).cast("long").alias("hi")).where("lo <= hi")
    windows = windows.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("window", "lo", "hi"))).alias("windows"))
    # a list holds at most ``positives`` windows
    negative = tree.search(anchors.join(windows, "anchor"), False, negatives)
    rank = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")).cast("int")
    negative = negative.withColumn("rank", rank)
    pairs = found.join(negative.withColumnRenamed("window", "positive_id"), ["anchor", "positive_id"])
    return pairs.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"),
                        "positive_score", F.col("score").alias("negative_score"))
