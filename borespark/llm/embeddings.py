"""Near-duplicate embeddings by randomised-rotation binary codes.

Each vector is scaled to length 1 and turned by random rotations; the signs of the turned coordinates are its code (of TURNS rotations one
after the other), and for the first rotation f = <code / sqrt(d), turned vector> is its correction factor.

Codes and factors of the first rotation are stored with each representative, and only read from then on.

Which pairs meet at all: bands of sign bits from further rotations. Bits a band grow with the logarithm of the largest label, so
buckets keep their size; the number of bands follows from the wanted miss probability at the threshold. Then in three steps:

1. Codes alone go to the buckets, once for each band. Of two unit vectors with angle t each code bit differs with probability t / pi; a member
   goes on only if with some other one of its bucket no more bits differ than `sure` standard errors over what the threshold's angle gives.
2. The vectors of these members meet in their buckets, with the stored codes and factors. For a pair, <code_x / sqrt(d), turned_y> / f_x is an unbiased
   estimate of the cosine, with standard error about sqrt(1 - f**2) / (f * sqrt(d - 1)); only pairs whose upper confidence bound reaches the threshold go on.
3. Those are recomputed in double precision; none below the threshold is linked.

Identical vectors are one representative with a count from the start; a bucket of more than `block` rows is dealt out as
pairs of blocks. A bucket gives counts and a spanning forest, never its pairs.

Null, zero, non-finite vectors and null labels link with nothing. Vectors of different lengths are never compared. Null vec_id:
the row is returned with component null. Rows that repeat a vec_id count as vectors of their own. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, join_checked, materialize, mix64
from .graph import components


def usable(vector: str = "embedding") -> F.Column:
    """Not null, without null or non-finite components."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.col(vector).isNotNull() & F.forall(vector, ok), F.lit(False))


def rotation(d: int, which: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([d, which, 20]).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def plan(largest: int, threshold: float, miss: float = 1e-6, bucket: int = 32) -> tuple[int, int]:
    """Bits a band and bands, for the largest number of vectors under one label."""
    bits = min(24, max(6, math.ceil(math.log2(max(largest, 2) / bucket))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-agree))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(-1, d)


BLOCKS = 1 << 32  # more than a bucket's blocks; a cell is BLOCKS times the first block, and the second
TURNS_BITS = 256  # bits of a code, in whole rotations


class Coder:
    """Codes and band keys for unit vectors of d components."""

    def __init__(self, d: int, bits: int, bands: int):
        self.d, self.bits, self.bands = d, bits, bands
        turns = -(-bits * bands // d)
        self.more = np.concatenate([rotation(d, 1 + i) for i in range(turns)], 1)[:, : bits * bands]
        self.code = np.concatenate([rotation(d, 100_000 + i) for i in range(-(-TURNS_BITS // d))], 1)
        self.weights = 1 << np.arange(bits, dtype=np.uint64)

    def bands_of(self, unit: np.ndarray) -> np.ndarray:
        signs = (unit @ self.more > 0).reshape(len(unit), self.bands, self.bits)
        return (signs * self.weights).sum(2, dtype=np.uint64)

    def codes(self, unit: np.ndarray) -> np.ndarray:
        return np.packbits(unit @ self.code > 0, axis=1)


def scaled(raw: np.ndarray) -> np.ndarray:
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def spread(reps: DataFrame, bits: int, bands: int) -> DataFrame:
    """(key, rep, code, band): each representative's code once for each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, label, size, x = (batch.column(i) for i in range(4))
            sizes = np.asarray(size)
            for d in np.unique(sizes):
                take = pa.array(np.flatnonzero(sizes == d))
                coder = coder_of(int(d), bits, bands)
                for s in range(0, len(take), 1024):
                    part = take[s : s + 1024]
                    unit = scaled(matrix(x.take(part), int(d)))
                    group = mix64(np.asarray(label.take(part), np.int64).astype(np.uint64) * np.uint64(31) + np.uint64(d))
                    key = mix64(mix64(coder.bands_of(unit) + group[:, None]) + np.arange(bands, dtype=np.uint64))
                    codes = pa.array([c.tobytes() for c in coder.codes(unit)], pa.binary())
                    for b in range(bands):
                        yield pa.RecordBatch.from_arrays([pa.array(key[:, b].astype(np.int64)), rep.take(part), codes, pa.array(np.full(len(part), b), pa.int32())], ["key", "rep", "code", "band"])

    return in_arrow(reps.select("rep", "label_key", "size", "x"), run, "key long, rep long, code binary, band int")


def most_bits(n: int, threshold: float, sure: float) -> float:
    """So many of n code bits may differ at the threshold, with `sure` standard errors allowed."""
    p = math.acos(threshold) / math.pi
    return n * p + sure * math.sqrt(n * p * (1 - p))


def plausible(cells: DataFrame, threshold: float, sure: float) -> DataFrame:
    """(key, cell, rep, band, own) of the members that are near enough to another of their cell by their codes."""

    def near(code: np.ndarray) -> np.ndarray:
        n, most = len(code), most_bits(code.shape[1] * 8, threshold, sure)
        bits = np.unpackbits(code, axis=1).astype(np.float32)
        ones, hit = bits.sum(1), np.zeros(n, bool)
        for s in range(0, n, 1024):
            differ = ones[s : s + 1024, None] + ones[None, :] - 2 * (bits[s : s + 1024] @ bits.T)
            close = differ <= most
            close[np.arange(len(close)), s + np.arange(len(close))] = False
            hit[s : s + 1024] = close.any(1)
        return hit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tested(part: pa.RecordBatch) -> pa.RecordBatch:
            key, cell = np.asarray(part.column(0)), np.asarray(part.column(1))
            first = np.flatnonzero(np.append(True, (np.diff(key) != 0) | (np.diff(cell) != 0)))
            stop, codes, keep = np.append(first[1:], len(key)), part.column(5).to_pylist(), np.zeros(len(key), bool)
            for a, b in zip(first.tolist(), stop.tolist(), strict=True):
                if b - a > 1:
                    keep[a:b] = near(np.frombuffer(b"".join(codes[a:b]), np.uint8).reshape(b - a, -1))
            return part.select(["key", "cell", "rep", "band", "own"]).filter(pa.array(keep))

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            key, cell = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            cut = int(np.flatnonzero((key != key[-1]) | (cell != cell[-1]))[-1]) + 1 if ((key != key[-1]) | (cell != cell[-1])).any() else 0
            if cut or (held and (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()) != (int(key[0]), int(cell[0]))):
                whole = pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
                yield from (tested(b) for b in whole.to_batches())
                held = []
            held.append(batch.slice(cut))  # the last cell may go on in the next batch
        if held:
            yield from (tested(b) for b in pa.Table.from_batches(held).combine_chunks().to_batches())

    dealt = cells.repartition("key", "cell").sortWithinPartitions("key", "cell", "rep")
    return in_arrow(dealt.select("key", "cell", "rep", "band", "own", "code"), run, "key long, cell long, rep long, band int, own int")


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the links (a, b) reach."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def corrected(reps: DataFrame) -> DataFrame:
    """reps (rep, mult, label_key, size, x, h1, h2) with sign and factor: the code of the first rotation, and how much of the turned vector it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sign, factor = np.asarray(batch.column(0)), np.empty(len(batch), object), np.zeros(len(batch))
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                for s in range(0, len(at), 1024):
                    part = at[s : s + 1024]
                    turned = scaled(matrix(batch.column(1).take(pa.array(part)), int(d))) @ rotation_of(int(d))
                    sign[part] = [c.tobytes() for c in np.packbits(turned > 0, axis=1)]
                    factor[part] = np.abs(turned).sum(1) / math.sqrt(d)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sign.tolist(), pa.binary()), pa.array(factor)], [*batch.schema.names, "sign", "factor"])

    return in_arrow(reps.select("size", "x", "rep", "mult", "label_key", "h1", "h2"), run, "size int, x array<double>, rep long, mult long, label_key long, h1 long, h2 long, sign binary, factor double")


def linked(unit: np.ndarray, threshold: float, sure: float, own: np.ndarray | None, sign: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j with cosine >= threshold. own: block of each row, if only pairs across blocks count. sign (bits), factor: as stored."""
    n, d = unit.shape
    turned = (unit @ rotation_of(d)).astype(np.float32)
    signs = 2 * np.unpackbits(sign, axis=1, count=d).astype(np.float32) - 1
    found = []
    slack = sure * np.sqrt(np.maximum(0, 1 - factor**2)) / (factor * math.sqrt(max(d - 1, 1)))
    for s in range(0, n, 1024):
        guess = (signs[s : s + 1024] @ turned.T) / (math.sqrt(d) * factor[s : s + 1024, None])
        i, j = np.nonzero(guess + slack[s : s + 1024, None] >= threshold)
        i += s
        keep = i < j if own is None else (i < j) & (own[i] != own[j])
        i, j = i[keep], j[keep]
        for t in range(0, len(i), 200_000):
            a, b = i[t : t + 200_000], j[t : t + 200_000]
            good = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
            found.append((a[good], b[good]))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1))


_ROTATIONS: dict[int, np.ndarray] = {}


def rotation_of(d: int) -> np.ndarray:
    if d not in _ROTATIONS:
        _ROTATIONS[d] = rotation(d, 0)
    return _ROTATIONS[d]


def compare(rows: DataFrame, bits: int, bands: int, threshold: float, sure: float) -> DataFrame:
    """(rep, links, root): for every cell of rows (key, cell, rep, band, own, mult, x, sign, factor), of each linked member the links found there first, and a member
    that it hangs from."""

    def group(run: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if len(run) < 2:
            return
        rep, mult, own = (np.array([r[i] for r in run]) for i in (2, 5, 4))
        unit = scaled(np.array([r[6] for r in run], float))
        order = np.argsort(own, kind="stable")
        rep, mult, own, unit = rep[order], mult[order], own[order], unit[order]
        sign, factor = np.frombuffer(b"".join(run[i][7] for i in order), np.uint8).reshape(len(run), -1), np.array([run[i][8] for i in order])
        one, other = divmod(run[0][1], BLOCKS)
        a, b = linked(unit, threshold, sure, None if one == other else own, sign, factor)
        if not len(a):
            return
        if band := run[0][3]:
            coder = coder_of(unit.shape[1], bits, bands)
            touched, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            keys = coder.bands_of(unit[touched])[:, :band]
            x, y = at[: len(a)], at[len(a) :]
            new = np.ones(len(a), bool)
            for s in range(0, len(a), 100_000):
                new[s : s + 100_000] = ~(keys[x[s : s + 100_000]] == keys[y[s : s + 100_000]]).any(1)
            a, b = a[new], b[new]
        if not len(a):
            return
        links = np.zeros(len(rep), np.int64)
        np.add.at(links, a, mult[b])
        np.add.at(links, b, mult[a])
        root = roots(len(rep), a, b)
        hit = np.flatnonzero(links)
        yield rep[hit], links[hit], rep[root[hit]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        out: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() if i != 6 else c.to_numpy(zero_copy_only=False) for i, c in enumerate(batch.columns)), strict=True):
                mark = (row[0], row[1])
                if mark != now:
                    out += group(held)
                    held, now = [], mark
                held.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out])) for k in range(3)], ["rep", "links", "root"])
                out = []
        out += group(held)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out])) for k in range(3)], ["rep", "links", "root"])

    dealt = rows.repartition("key", "cell").sortWithinPartitions("key", "cell", "rep")
    return in_arrow(dealt.select("key", "cell", "rep", "band", "own", "mult", "x", "sign", "factor"), run, "rep long, links long, root long")


_CODERS: dict[tuple, Coder] = {}


def coder_of(d: int, bits: int, bands: int) -> Coder:
    if (d, bits, bands) not in _CODERS:
        _CODERS[d, bits, bands] = Coder(d, bits, bands)
    return _CODERS[d, bits, bands]


def near_duplicates(table: DataFrame, *, threshold: float = 0.93, sure: float = 6.0, block: int = 4096, miss: float = 1e-6) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of table (vec_id, embedding, label)."""
    base = table.select("vec_id", "embedding", "label")
    fit = usable() & F.col("label").isNotNull() & F.exists("embedding", lambda x: x != 0)
    h = [F.when(fit, F.xxhash64(F.lit(seed), F.col("label"), F.col("embedding"))).alias(f"h{seed}") for seed in (1, 2)]
    marked = base.select("vec_id", "embedding", "label", *h)
    reps = materialize(
        marked.where("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.xxhash64(F.first("label")).alias("label_key"), F.first("embedding").alias("x")).withColumn("size", F.size("x"))
    )
    whole = materialize(corrected(reps.where("rep is not null and size > 0").withColumn("x", F.col("x").cast("array<double>"))))
    largest = whole.groupBy("label_key", "size").count().agg(F.max("count")).first()[0] or 0
    bits, bands = plan(largest, threshold, miss)
    rows = spread(whole, bits, bands)
    hot = materialize(rows.groupBy("key").count().where(F.col("count") > block)) if largest > block else None
    if hot is None:
        cells = rows.withColumn("own", F.lit(0)).withColumn("cell", F.lit(0).cast("long"))
    else:
        n = F.coalesce(F.ceil(F.col("count") / block), F.lit(1)).cast("int")
        joined = join_checked(rows, hot, ["key"], "left").withColumn("n", n).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("n")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
        cells = joined.withColumn("other", other).withColumn("cell", F.least("own", "other") * F.lit(BLOCKS) + F.greatest("own", "other"))
    near = materialize(plausible(cells, threshold, sure))
    met = near.join(whole.select("rep", "mult", "x", "sign", "factor"), "rep")
    found = materialize(compare(met, bits, bands, threshold, sure).groupBy("rep", "root").agg(F.sum("links").alias("links")))
    comp = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    degree = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = whole.select("h1", "h2", "rep", "mult").join(degree, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    known = materialize(known.select("h1", "h2", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component")))
    out = join_checked(marked.select("vec_id", "h1", "h2"), known, ["h1", "h2"], "left")
    component = F.when(F.col("component").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
