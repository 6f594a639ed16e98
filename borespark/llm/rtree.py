"""Hard negatives by an R-tree that is packed sort-tile-recursively.

Components become floor(scale * x); a score is an integer inner product. An anchor's positives are its `positives` best other rows of the same
label; for each of them the `negatives` best rows of other labels are returned whose score lies in a window set by the positive's score.

1. Equal whole-number vectors of one label are one object, with the ids that can be among the best of any anchor (the smallest ones).
2. Coarse tiles are cut along the coordinates with the largest variance, one after the other; cuts are the medians of a sample of `fit_rows` objects (every object is
   put in its tile; a tile of more than `tile_rows` objects is dealt out by hash). In a tile, each label's objects are sorted and halved along
   their widest coordinate until `leaf` remain: the leaves, written with their bounding boxes. This is the index.
3. Anchors go to all tasks in rounds of `room` bytes. A task packs the boxes of its leaves into higher levels. A box gives an interval for the
   inner product with an anchor: each coordinate's product lies between those with the box's two borders. A best-first queue takes boxes by the upper end
   and drops those whose interval misses every window, or lies strictly below the k-th score found so far (in that window); ties are kept, as a smaller id wins.
4. What tasks found is ranked: first the positives, which set the windows, then the negatives.

Higher scores come first, ties by smaller vec_id. Rows with a null id, null label, null or empty vector or a null or non-finite component take no part; vectors
of different lengths are never compared. "Other rows" are those with another vec_id. Rows that repeat vec_id, label and vector count once; an id with several
vectors or labels is several rows. Fewer candidates than asked for: all of them. An empty table gives an empty one. Further columns are ignored.
Scores are exact as long as they fit in 64 bits.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, materialize
from .embeddings import usable
from .topk import matrix, products

FAN = 8
#: Bytes of leaves that a task searches at once.
HELD = 48_000_000


# ---------------------------------------------------------------- packing


class Cuts:
    """Coarse tiles of vectors of d components: at each level one coordinate, and a cut for each tile of the level above."""

    def __init__(self, sample: np.ndarray, tiles: int):
        spread = sample.astype(float).var(0) if len(sample) else np.zeros(sample.shape[1])
        levels = max(0, int(tiles - 1).bit_length())
        self.dims = np.resize(np.argsort(-spread, kind="stable"), levels) if sample.shape[1] else np.empty(0, np.int64)
        self.cuts, code = [], np.zeros(len(sample), np.int64)
        for level, dim in enumerate(self.dims):
            cut = np.zeros(1 << level, np.int64)
            for t in range(1 << level):
                if (own := sample[code == t, dim]).size:
                    cut[t] = np.ceil(np.median(own))
            self.cuts.append(cut)
            code = 2 * code + (sample[:, dim] >= cut[code])

    def of(self, x: np.ndarray) -> np.ndarray:
        code = np.zeros(len(x), np.int64)
        for dim, cut in zip(self.dims, self.cuts, strict=True):
            code = 2 * code + (x[:, dim] >= cut[code])
        return code


def packed(x: np.ndarray, leaf: int) -> list[np.ndarray]:
    """The rows of each leaf, in order: sorted along the widest coordinate and halved at a multiple of leaf, again and again."""
    out, rest = [], [np.arange(len(x))]
    while rest:
        rows = rest.pop()
        if len(rows) <= leaf:
            out.append(rows)
            continue
        part = x[rows]
        rows = rows[np.argsort(part[:, np.argmax(part.max(0) - part.min(0))], kind="stable")]
        half = -(-len(rows) // leaf) // 2 * leaf
        rest += [rows[half:], rows[:half]]
    return out


LEAF = "label long, size int, low binary, high binary, vectors binary, counts binary, ids binary"


def leaves_of(objects: DataFrame, leaf: int) -> DataFrame:
    """objects (tile, part, label, size, vector, ids), dealt by tile and part -> rows of LEAF."""

    def pack(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        label, size, ids = np.asarray(rows.column("label")), np.asarray(rows.column("size")), rows.column("ids").to_pylist()
        for lab, d in sorted(set(zip(label.tolist(), size.tolist(), strict=True))):
            own = np.flatnonzero((label == lab) & (size == d))
            x = matrix(rows.column("vector").take(pa.array(own)), d)
            leaves = packed(x, leaf)
            box = lambda f: pa.array([f(x[k], axis=0).tobytes() for k in leaves], pa.binary())
            lists = [[ids[own[i]] for i in k] for k in leaves]
            flat = [np.array([len(i) for i in one], np.int32).tobytes() for one in lists], [np.array([v for i in one for v in i], np.int64).tobytes() for one in lists]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lab] * len(leaves), pa.int64()), pa.array([d] * len(leaves), pa.int32()), box(np.min), box(np.max), pa.array([x[k].tobytes() for k in leaves], pa.binary()), *[pa.array(f, pa.binary()) for f in flat]],
                ["label", "size", "low", "high", "vectors", "counts", "ids"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            tile, part = (np.asarray(batch.column(i)) for i in (0, 1))
            border = np.flatnonzero(np.append(True, (np.diff(tile) != 0) | (np.diff(part) != 0))) if len(batch) else []
            for a, b in zip(border, [*border[1:], len(batch)], strict=True):
                if held and (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()) != (int(tile[a]), int(part[a])):
                    yield from pack(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from pack(held)

    dealt = objects.repartition("tile", "part").sortWithinPartitions("tile", "part", "label", "h1", "h2")
    return in_arrow(dealt.select("tile", "part", "label", "size", "vector", "ids"), run, LEAF)


# ---------------------------------------------------------------- searching


class Tree:
    """Leaves of one length in a task, and boxes above them, FAN children each. Nodes from `leaves` on are higher ones."""

    def __init__(self, rows: list[dict]):
        rows.sort(key=lambda r: r["label"])
        self.d, self.leaves = rows[0]["size"], len(rows)
        self.label = np.array([r["label"] for r in rows])
        self.vectors = [np.frombuffer(r["vectors"], np.int64).reshape(-1, self.d) for r in rows]
        self.ids = [np.frombuffer(r["ids"], np.int64) for r in rows]
        self.of = [np.repeat(np.arange(len(v)), np.frombuffer(r["counts"], np.int32)) for r, v in zip(rows, self.vectors, strict=True)]
        low, high = (np.array([np.frombuffer(r[c], np.int64) for r in rows]) for c in ("low", "high"))
        first, last = self.label.copy(), self.label.copy()  # the least and the greatest label below a node
        self.children: list[np.ndarray] = []
        level = np.arange(self.leaves)
        while len(level) > 1:
            cut = np.arange(0, len(level), FAN)
            self.children += [level[c : c + FAN] for c in cut]
            box = np.minimum.reduceat(low[level], cut, axis=0), np.maximum.reduceat(high[level], cut, axis=0)
            ends = np.minimum.reduceat(first[level], cut), np.maximum.reduceat(last[level], cut)
            new = np.arange(len(low), len(low) + len(cut))
            low, high, first, last = np.vstack([low, box[0]]), np.vstack([high, box[1]]), np.append(first, ends[0]), np.append(last, ends[1])
            level = new
        self.low, self.high, self.first, self.last, self.root = low, high, first, last, int(level[0])

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of q and each node, the least and the greatest inner product that the node's box allows."""
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        return products(up, self.low) + products(down, self.high), products(up, self.high) + products(down, self.low)


class Best:
    """The k best (score, id) of a window of scores, found so far."""

    def __init__(self, k: int, low: int, high: int):
        self.k, self.low, self.high = k, low, high
        self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)
        self.least = low  # nothing strictly below is wanted

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.append(self.scores, scores), np.append(self.ids, ids)
        turn = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[turn], ids[turn]
        if len(turn) == self.k:
            self.least = max(self.low, int(self.scores[-1]))


def search(tree: Tree, q: np.ndarray, own: int, label: int, same: bool, lower: np.ndarray, upper: np.ndarray, windows: list[Best]) -> None:
    """Best-first over the tree for one anchor; same: rows of its label, else of other labels. lower, upper: its bounds for every node."""

    def wanted(node: int) -> bool:
        inside = tree.first[node] <= label <= tree.last[node] if same else not tree.first[node] == label == tree.last[node]
        return bool(inside) and any(upper[node] >= w.least and lower[node] <= w.high for w in windows)

    queue = [(-int(upper[tree.root]), tree.root)] if wanted(tree.root) else []
    while queue:
        _, node = heapq.heappop(queue)
        if not wanted(node):
            continue
        if node >= tree.leaves:
            for child in tree.children[node - tree.leaves].tolist():
                if wanted(child):
                    heapq.heappush(queue, (-int(upper[child]), child))
            continue
        score = products(tree.vectors[node], q)[:, 0][tree.of[node]]
        ids = tree.ids[node]
        for w in windows:
            hit = (score >= w.least) & (score <= w.high) & (ids != own)
            if hit.any():
                w.add(score[hit], ids[hit])


def searched(index: DataFrame, anchors: DataFrame, *, k: int, windows: Callable[[list], list[tuple[int, int, int]]], same: bool, room: int) -> DataFrame:
    """(a, label, h1, h2, place, found, score): for each anchor (a, label, h1, h2, size, vector, asked) and window the best k of each task.
    windows: asked -> (place, least score, greatest score)."""
    total = anchors.agg(F.sum(F.col("size").cast("long") * 8 + 200)).first()[0] or 0
    rounds, out = max(1, -(-total // room)), []
    schema = "a long, label long, h1 long, h2 long, place int, found long, score long"

    def work(sent: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], list[tuple[int, Best]]] = {}

        def over(rows: list[dict]) -> None:
            for d in {r["size"] for r in rows} & set(sent):
                tree, (who, q, asked) = Tree([r for r in rows if r["size"] == d]), sent[d]
                for s in range(0, len(q), 256):
                    lower, upper = tree.bounds(q[s : s + 256])
                    for i in range(s, min(s + 256, len(q))):
                        if (d, i) not in best:
                            best[d, i] = [(place, Best(k, a, b)) for place, a, b in windows(asked[i])]
                        search(tree, q[i : i + 1], who[i][0], who[i][1], same, lower[i - s], upper[i - s], [w for _, w in best[d, i]])

        held, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                held.append(row)
                size += len(row["vectors"])
                if size >= HELD:
                    over(held)
                    held, size = [], 0
        if held:
            over(held)
        for (d, i), found in best.items():
            a, label, h1, h2 = sent[d][0][i]
            n = sum(len(w.ids) for _, w in found)
            place = np.repeat([p for p, _ in found], [len(w.ids) for _, w in found]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*[pa.array(np.full(n, v, np.int64)) for v in (a, label, h1, h2)], pa.array(place), *[pa.array(np.concatenate([x, *[getattr(w, c) for _, w in found]])) for x, c in ((np.empty(0, np.int64), "ids"), (np.empty(0, np.int64), "scores"))]], ["a", "label", "h1", "h2", "place", "found", "score"])

    for r in range(rounds):
        rows, sent = anchors.where(F.pmod(F.xxhash64(F.lit(6), "a", "h1", "h2"), F.lit(rounds)) == r).toArrow(), {}
        for d in set(rows.column("size").to_pylist()):
            own = rows.filter(pa.array(np.asarray(rows.column("size")) == d))
            sent[d] = list(zip(*(own.column(c).to_pylist() for c in ("a", "label", "h1", "h2")), strict=True)), matrix(own.column("vector"), d), own.column("asked").to_pylist()
        shared = index.sparkSession.sparkContext.broadcast(sent)
        out.append(materialize(in_arrow(index, lambda batches, shared=shared: work(shared.value, batches), schema)))
        shared.unpersist()
    return reduce(DataFrame.union, out)


def hard_negatives(
    table: DataFrame, *, every: int = 100, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: int = 256, leaf: int = 128, tile_rows: int = 8192, fit_rows: int = 4096, room: int = 32_000_000
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, for table (vec_id, label, embedding). Anchors: rows whose vec_id is divisible by
    `every`. A negative's score is at least `least` and at most `most` per cent of the positive's."""
    whole = table.where(usable() & F.col("vec_id").isNotNull() & F.col("label").isNotNull()).where(F.size("embedding") > 0)
    whole = whole.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vector"))
    whole = whole.withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64(F.lit(2), "vector"))
    key = ["label", "h1", "h2"]
    few = whole.withColumn("place", F.dense_rank().over(Window.partitionBy(*key).orderBy("vec_id"))).where(F.col("place") <= max(positives + 1, negatives))
    objects = few.groupBy(*key).agg(F.sort_array(F.collect_set("vec_id")).alias("ids"), F.first("vector").alias("vector"))
    objects = materialize(objects.withColumn("size", F.size("vector")))
    count = objects.count()
    sample = objects.orderBy(F.xxhash64(F.lit(3), *key)).limit(fit_rows).select("size", "vector").toArrow()
    tiles, cuts = max(1, min(-(-count // tile_rows), len(sample) // 8)), {}
    for d in set(sample.column("size").to_pylist()):
        cuts[d] = Cuts(matrix(sample.filter(pa.array(np.asarray(sample.column("size")) == d)).column("vector"), d), tiles)

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, tile = np.asarray(batch.column(4)), np.zeros(len(batch), np.int64)
            for d in set(size.tolist()) & set(cuts):
                at = np.flatnonzero(size == d)
                tile[at] = cuts[d].of(matrix(pa.chunked_array([batch.column(5).take(pa.array(at))]), d))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tile)], [*batch.schema.names, "tile"])

    placed = in_arrow(objects.select(*key, "ids", "size", "vector"), tiled, "label long, h1 long, h2 long, ids array<long>, size int, vector array<long>, tile long")
    sizes = placed.groupBy("tile").count()
    parts = F.greatest(F.lit(1), F.round(F.col("count") / tile_rows)).cast("long")
    dealt = placed.join(F.broadcast(materialize(sizes.select("tile", parts.alias("parts")))), "tile")  # tiles: at most fit_rows
    index = materialize(leaves_of(dealt.withColumn("part", F.pmod(F.xxhash64(F.lit(5), "h1", "h2"), F.col("parts"))), leaf))

    who = ["a", "label", "h1", "h2"]
    anchors = materialize(whole.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("a"), *key, "vector", F.size("vector").alias("size")).groupBy(*who).agg(F.first("vector").alias("vector"), F.first("size").alias("size")))
    first = searched(index, anchors.withColumn("asked", F.lit(0)), k=positives, windows=lambda _: [(0, -(2**63), 2**63 - 1)], same=True, room=room)
    order = Window.partitionBy(*who).orderBy(F.desc("score"), "found")
    best = materialize(first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives).select(*who, F.col("rank").alias("place"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score")))
    asked = best.groupBy(*who).agg(F.collect_list(F.struct("place", "positive_score")).alias("asked"))
    window = lambda asked: [(x["place"], -(-least * x["positive_score"] // 100), most * x["positive_score"] // 100) for x in asked]
    second = searched(index, materialize(anchors.join(asked, who)), k=negatives, windows=window, same=False, room=room)
    order = Window.partitionBy(*who, "place").orderBy(F.desc("score"), "found")
    ranked = second.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.join(best, [*who, "place"]).select(F.col("a").alias("anchor_id"), "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
