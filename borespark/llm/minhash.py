"""Near-duplicate documents by b-bit MinHash.

A document's set is its distinct shingles of `width` words (A-Z lower-cased; words are runs of bytes that aren't white space).
Each of `rows * bands` permutations gives a minimum. Bands of `rows` minima propose candidates. Of each minimum only `BITS` low bits
are kept, packed; two documents' agreement, corrected for chance collisions (J = (p - C) / (1 - C), C = 2**-BITS), is found by
counting bits. A candidate is dropped only when so few agreements would be seen with probability under 1e-7 at the threshold,
or when the set sizes exclude it; the others are confirmed on full sets, first of 64-bit hashes made from words' digests, then, if those
say yes, of the words themselves.

Documents with equal sets are one representative from the start, so copies never form pairs. A bucket gives a spanning forest of the
members that may be similar (one of more than `block` members is dealt out as pairs of blocks); its ties are confirmed, and links found so far make components. Clusters (what ties of all buckets
connect) that hold more than one component are then tested inside, block against block; only links that join components
come out. Pairs inside a component can't change the result and aren't made.

Empty sets (null text, no words) link with nothing; fewer than `width` words make one shingle. Null doc_id: returned, component null,
kept true. A doc_id that occurs with several texts is one document whose links are those of all its texts; each row has its own
n_shingles. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, join_checked, materialize, mix64, random_words, text_parts, word_digests
from .graph import components

BITS = 2
_K1, _K2 = np.uint64(0x9DDFEA08EB382D69), np.uint64(0xC3A5C85C97CB3127)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct 64-bit shingle hashes."""
    for _, offsets, data in text_parts(column):
        h, _, first = word_digests(data, offsets, fold=True)
        n = np.diff(first)
        grams = h.copy() if width == 1 else None
        if width > 1:
            grams = np.zeros(max(0, len(h) - width + 1), np.uint64)
            for i in range(width):
                grams = mix64(grams * _K1 + h[i : len(h) - width + 1 + i])
        for d in range(len(n)):
            a, k = int(first[d]), int(n[d])
            if k >= width:
                yield np.unique(grams[a : a + k - width + 1])
            elif k:
                whole = np.array([k], np.uint64)
                for x in h[a : a + k]:
                    whole = mix64(whole * _K2 + x)
                yield whole
            else:
                yield np.empty(0, np.uint64)


def shingle_texts(text: str | None, width: int) -> set[tuple[bytes, ...]]:
    """The text's set itself."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return set(zip(*(w[i:] for i in range(width)), strict=False)) if len(w) >= width else {tuple(w)} if w else set()


def alike(x: str | None, y: str | None, width: int, share: int) -> bool:
    """Whether two texts' sets, compared word by word, satisfy 100 * intersection >= share * union."""
    a, b = shingle_texts(x, width), shingle_texts(y, width)
    same = len(a & b)
    return bool(a) and 100 * same >= share * (len(a) + len(b) - same)


class Minima:
    def __init__(self, count: int):
        r = random_words(2 * count, 5)
        self.a, self.b = (r[:count] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (r[count:] >> np.uint64(32)).astype(np.uint32)

    def of(self, s: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        x = (s >> np.uint64(32)).astype(np.uint32)
        for i in range(0, len(x), 4096):
            np.minimum(low, (self.a[:, None] * x[None, i : i + 4096] + self.b[:, None]).min(1), out=low)
        return low


def packed(low: np.ndarray) -> np.ndarray:
    """BITS low bits of each mixed minimum, as bytes; rows are documents."""
    bits = mix64(low.astype(np.uint64)) & np.uint64((1 << BITS) - 1)
    planes = np.unpackbits(bits.astype(np.uint8)[..., None], axis=-1)[..., 8 - BITS :]
    return np.packbits(planes.reshape(*low.shape[:-1], -1), axis=-1)


def signatures(docs: DataFrame, *, text: str, width: int, rows: int, bands: int) -> DataFrame:
    """(id, n, set1, set2, sig, keys): set size, two set hashes, packed signature, and a key for each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minima = Minima(rows * bands)
        salt, mul = np.arange(bands, dtype=np.uint64), random_words(rows, 9) | np.uint64(1)
        for batch in batches:
            n, set1, set2, low = [], [], [], []
            for s in shingle_sets(batch.column(1), width):
                n.append(len(s))
                set1.append(mix64(s).sum(dtype=np.uint64))
                set2.append(mix64(s * _K1 + _K2).sum(dtype=np.uint64))
                low.append(minima.of(s))
            low = np.array(low, np.uint32).reshape(len(n), rows * bands)
            keys = mix64(mix64((low.reshape(len(n), bands, rows).astype(np.uint64) * mul).sum(2, dtype=np.uint64)) * _K1 + salt).astype(np.int64)
            sig = packed(low)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(np.array(n, np.int64)), pa.array(np.array(set1, np.uint64).astype(np.int64)), pa.array(np.array(set2, np.uint64).astype(np.int64)),
                    pa.array([x.tobytes() for x in sig], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(0, len(n) * bands + 1, bands, dtype=np.int32)), pa.array(keys.ravel())),
                ],
                ["id", "n", "set1", "set2", "sig", "keys"],
            )

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("id"), F.col(text).alias("text")), run, "id long, n long, set1 long, set2 long, sig binary, keys array<long>")


def most_misses(count: int, threshold: float, risk: float = 1e-7) -> int:
    """So many disagreements are seen with probability under risk at most if the similarity is the threshold."""
    chance = 2.0**-BITS
    p = (1 - threshold) * (1 - chance)
    tail, k = 1.0, 0
    while k < count:
        tail -= math.comb(count, k) * p**k * (1 - p) ** (count - k)
        if tail < risk:
            return k
        k += 1
    return count


_POP = np.array([bin(x).count("1") for x in range(256)], np.uint8)


def disagreements(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Positions at which packed BITS = 2 signatures differ."""
    x = one ^ many
    return _POP[(x | (x >> 1)) & 0x55].sum(-1, dtype=np.int32)


def plausible(i: int, others: np.ndarray, sig: np.ndarray, n: np.ndarray, threshold: float, most: int) -> np.ndarray:
    sizes = np.minimum(n[i], n[others]) >= threshold * np.maximum(n[i], n[others]) - 1e-9
    others = others[sizes]
    return others[disagreements(sig[i], sig[others]) <= most]


def forest(sig: np.ndarray, n: np.ndarray, threshold: float, most: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of a bucket's members under "may be similar", by breadth-first search."""
    rest, line = np.arange(len(n)), []
    while len(rest):
        if not line:
            line, rest = [rest[0]], rest[1:]
        i = line.pop(0)
        near = plausible(i, rest, sig, n, threshold, most)
        for j in near:
            yield int(i), int(j)
        line += list(near)
        rest = np.setdiff1d(rest, near, assume_unique=True)


def ties_of(members: DataFrame, threshold: float, most: int) -> DataFrame:
    """Distinct (a, b), a < b, of the forests of all buckets of members (key, id, n, sig); streams through sorted buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def bucket(held: list[tuple]) -> None:
            if len(held) < 2:
                return
            ids, n = (np.array([h[k] for h in held], np.int64) for k in (1, 2))
            sig = np.array([np.frombuffer(h[3], np.uint8) for h in held])
            out.update((min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in forest(sig, n, threshold, most) if ids[i] != ids[j])

        def flush() -> pa.RecordBatch:
            rows = np.array(sorted(out), np.int64).reshape(-1, 2)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], ["a", "b"])

        out: set[tuple[int, int]] = set()
        held: list[tuple] = []
        for batch in batches:
            keys = np.asarray(batch.column(0))
            if not len(keys):
                continue
            first = np.append(0, np.flatnonzero(np.diff(keys)) + 1)
            size = np.diff(np.append(first, len(keys)))
            want = size > 1
            want[[0, -1]] = True  # these may go on in another batch
            cols = [c.to_pylist() for c in batch.filter(pa.array(np.repeat(want, size))).columns]
            a = 0
            for k in size[want]:
                if held and held[0][0] != cols[0][a]:
                    bucket(held)
                    held = []
                held += zip(*(c[a : a + k] for c in cols), strict=True)
                a += int(k)
            if len(out) > 100_000:
                yield flush()
        bucket(held)
        if out:
            yield flush()

    dealt = members.select("key", "id", "n", "sig").repartition("key").sortWithinPartitions("key", "id")
    return in_arrow(dealt, run, "a long, b long").distinct()


def dealt_out(members: DataFrame, block: int) -> DataFrame:
    """members (key, id, n, sig) with the keys of buckets over block members split: a key for each pair of the bucket's blocks."""
    hot = materialize(members.groupBy("key").count().where(F.col("count") > block))
    parts = F.coalesce(F.ceil(F.col("count") / block), F.lit(1)).cast("int")
    own = join_checked(members, hot, ["key"], "left").withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    cells = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = F.when(F.col("count").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    return cells.select(key.alias("key"), "id", "n", "sig")


def confirmed(links: DataFrame, docs: DataFrame, *, text: str, width: int, share: int) -> DataFrame:
    """The pairs whose full sets satisfy 100 * intersection >= share * union."""
    ids = materialize(links.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    base = docs.select(F.col("doc_id").cast("long").alias("id"), F.col(text).alias("text")).where("id is not null")
    if ids.count() <= 400_000:
        ids = F.broadcast(ids)
    texts = base.join(ids, "id", "left_semi")
    one = links.join(texts.withColumnRenamed("id", "a").withColumnRenamed("text", "ta"), "a")
    both = one.join(texts.withColumnRenamed("id", "b").withColumnRenamed("text", "tb"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for s in range(0, len(batch), 512):
                part = batch.slice(s, 512)
                for i, (x, y) in enumerate(zip(shingle_sets(part.column(2), width), shingle_sets(part.column(3), width), strict=True)):
                    same = len(np.intersect1d(x, y, assume_unique=True))
                    near = bool(len(x)) and 100 * same >= share * (len(x) + len(y) - same)
                    keep.append(near and alike(part.column(2)[i].as_py(), part.column(3)[i].as_py(), width, share))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return in_arrow(both.select("a", "b", "ta", "tb"), run, "a long, b long").distinct()


def across(members: DataFrame, *, width: int, share: int, most: int, block: int = 512) -> DataFrame:
    """(a, b): confirmed links between different components of a cluster, as far as they join components.

    members: cluster, size (of the cluster), id, comp, n, sig, text. A cluster of more than `block` members is dealt out as pairs
    of blocks; a task holds two blocks, tests their members' signatures and counts intersections of full sets for the rest."""
    parts = F.ceil(F.col("size") / block).cast("int")
    own = members.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = own.withColumn("cell", F.least("own", "other") * F.lit(1_000_000) + F.greatest("own", "other"))
    threshold = share / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cell(held: list[tuple]) -> list[tuple[int, int]]:
            if len(held) < 2:
                return []
            ids, comp, n, part = (np.array([h[k] for h in held], np.int64) for k in (2, 3, 4, 7))
            if (comp == comp[0]).all():
                return []
            sig = np.array([np.frombuffer(h[5], np.uint8) for h in held])
            sets = list(shingle_sets(pa.array([h[6] for h in held], pa.large_string()), width))
            size = np.array([len(x) for x in sets])
            every, flat = np.unique(np.concatenate(sets), return_inverse=True)
            first = np.cumsum(size) - size
            mark, out, one = np.zeros(len(every), np.int64), [], bool((part == part[0]).all())
            for i in range(len(held) - 1):
                later = np.arange(i + 1, len(held))
                later = later[(comp[later] != comp[i]) & (one | (part[later] != part[i])) & (size[later] > 0)]
                later = plausible(i, later, sig, n, threshold, most)
                if not len(later) or not size[i]:
                    continue
                mark[flat[first[i] : first[i] + size[i]]] = 1
                k = size[later]
                begin = np.cumsum(k) - k
                at = np.repeat(first[later] - begin, k) + np.arange(int(k.sum()))
                same = np.add.reduceat(mark[flat[at]], begin)
                mark[flat[first[i] : first[i] + size[i]]] = 0
                for j in later[100 * same >= share * (size[i] + k - same)]:
                    if comp[i] != comp[j] and alike(held[i][6], held[j][6], width, share):
                        out.append((int(ids[i]), int(ids[j])))
                        comp[comp == comp[j]] = comp[i]
            return out

        held, now, out = [], None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:2] != now:
                    out += cell(held)
                    held, now = [], row[:2]
                held.append(row)
        out += cell(held)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    dealt = cells.select("cluster", "cell", "id", "comp", "n", "sig", "text", "own").repartition("cluster", "cell").sortWithinPartitions("cluster", "cell", "id")
    return in_arrow(dealt, run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, text: str = "text", width: int = 2, share: int = 80, rows: int = 4, bands: int = 32, block: int = 4096) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs. share: per cent of the union that the intersection must reach."""
    threshold = share / 100
    most = most_misses(rows * bands, threshold)
    table = materialize(signatures(docs, text=text, width=width, rows=rows, bands=bands))
    sets = table.where("n > 0").groupBy("n", "set1", "set2").agg(F.min("id").alias("rep"), F.min(F.struct("sig", "keys")).alias("s"))
    sets = materialize(sets.where("rep is not null").select("n", "set1", "set2", "rep", "s.sig", "s.keys"))
    exploded = sets.select(F.explode("keys").alias("key"), F.col("rep").alias("id"), "n", "sig")
    ties = materialize(ties_of(dealt_out(exploded, block) if sets.count() > block else exploded, threshold, most))
    links = materialize(confirmed(ties, docs, text=text, width=width, share=share))
    comp = materialize(components(links))
    cluster = materialize(components(ties))
    inside = cluster.select(F.col("root").alias("cluster"), F.col("node").alias("rep")).union(cluster.select("root", F.col("root")).distinct())
    inside = materialize(inside.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("cluster", "rep", F.coalesce("root", "rep").alias("comp")))
    split = inside.groupBy("cluster").agg(F.count("*").alias("size"), F.min("comp").alias("least"), F.max("comp").alias("most")).where("least <> most").select("cluster", "size")
    members = materialize(join_checked(inside, materialize(split), ["cluster"], "inner").join(sets.select("rep", "n", "sig"), "rep").withColumnRenamed("rep", "id"))
    base = docs.select(F.col("doc_id").cast("long").alias("id"), F.col(text).alias("text"))
    links = materialize(links.union(across(join_checked(base, members, ["id"], "inner"), width=width, share=share, most=most)))
    comp = components(links).withColumnRenamed("node", "rep")
    known = materialize(sets.select("n", "set1", "set2", "rep").join(comp, "rep", "left").select("n", "set1", "set2", F.coalesce("root", "rep").alias("component")))
    keys = ["n", "set1", "set2"]
    out = table.select("id", *keys).join(known, keys, "left")
    component = F.when(F.col("component").isNull() | F.col("id").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
