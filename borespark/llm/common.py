"""Shared pieces: tables kept in the cluster's shared folder, size-checked joins, and hashing of Arrow text in numpy."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, one of our own on a single machine; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-borespark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: How to drop what worker processes keep between tasks, such as a tokenizer with the words it has learnt.
KEPT: list[Callable[[], None]] = []
_OWNER: list[str] = []


def begin_task(owner: str) -> None:
    """What another module's tasks have left in this worker process goes."""
    if _OWNER != [owner]:
        for drop in KEPT:
            drop()
        _OWNER[:] = [owner]


def end_task() -> None:
    """Memory that is free goes back to the system, so that workers of long sessions don't hold their largest task's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow(run, schema) by workers that give memory back."""
    owner = run.__module__

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task(owner)
        try:
            yield from run(batches)
        finally:
            end_task()

    return df.mapInArrow(task, schema)


def bytes_of(df: DataFrame) -> tuple[int, int]:
    """Rows of df, and about the bytes they take in memory."""
    cells = []
    for f in df.schema.fields:
        kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        cells.append(F.greatest(F.size(c), F.lit(0)) * 16 if kind in ("array", "map") else F.octet_length(c) if kind in ("string", "binary") else F.lit(0))
    each = sum((F.coalesce(c.cast("long"), F.lit(0)) for c in cells), F.lit(16 + 8 * len(cells)))
    rows, size = df.agg(F.count("*"), F.sum(each)).first()
    return rows, size or 0


def join_checked(big: DataFrame, small: DataFrame, keys: list[str], how: str, limit: int = 400_000, room: int = 48_000_000) -> DataFrame:
    """Null-safe equi-join; small (an already written table) is broadcast only if its counted rows are within limit and its bytes within room."""
    right = small.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in small.columns if c not in keys])
    rows, size = bytes_of(small)
    if rows <= limit and size <= room:
        right = F.broadcast(right)
    cond = None
    for k in keys:
        one = big[k].eqNullSafe(right[f"__{k}"])
        cond = one if cond is None else cond & one
    return big.join(right, cond, how).drop(*[f"__{k}" for k in keys])


def joined_ranges(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, those that touch or overlap joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def ranges_of_texts(found: DataFrame) -> DataFrame:
    """found (h1, h2, kind, start, stop) -> (h1, h2, first, second): for each text the joined ranges of kind 0 and those of kind 1, as start, stop, start, stop, ..."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list] = [], []
            for kind, start, stop in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                for k in (0, 1):
                    out[k].append([x for r in joined_ranges((a, b) for w, a, b in zip(kind, start, stop, strict=True) if w == k) for x in r])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(o, pa.list_(pa.int64())) for o in out]], ["h1", "h2", "first", "second"])

    rows = found.groupBy("h1", "h2").agg(F.collect_list(F.struct("kind", "start", "stop")).alias("x"))
    return in_arrow(rows.select("h1", "h2", "x.kind", "x.start", "x.stop"), run, "h1 long, h2 long, first array<long>, second array<long>")


# ---------------------------------------------------------------- hashing in numpy

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective); returns a new array."""
    x = x ^ (x >> _S)
    x *= _M1
    x ^= x >> _S
    x *= _M2
    x ^= x >> _S
    return x


def random_words(n: int, seed: int) -> np.ndarray:
    """n pseudo-random uint64 derived from a seed by a counter rule."""
    with np.errstate(over="ignore"):
        start = np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
        return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + start)


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base | 1, pow(base | 1, -1, 1 << 64), 0

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 1 << 16)
            self.up, self.down = (self.powers(b) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]

    def powers(self, b: int) -> np.ndarray:
        out = np.full(self.n, b, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)


def rolling(values: np.ndarray, width: int, powers: Powers) -> np.ndarray:
    """Mixed hash of every run of `width` consecutive values (polynomial modulo 2**64, made independent of its place)."""
    n = len(values)
    if n < width:
        return np.empty(0, np.uint64)
    up, down = powers.get(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=total[1:])
    return mix64((total[width:] - total[:-width]) * down[: n - width + 1])


def byte_table(seed: int) -> np.ndarray:
    """A random 64-bit value for each byte."""
    return random_words(256, seed)


def text_parts(array: pa.Array, most: int = 500_000):
    """(first row, byte offsets from 0, bytes) for runs of rows holding about `most` bytes; nulls count as empty."""
    for base in range(0, len(array), 1000):
        part = pc.fill_null(array.slice(base, 1000).cast(pa.large_string()), "")
        if isinstance(part, pa.ChunkedArray):
            part = part.combine_chunks()
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(part.buffers()[2], np.uint8) if part.buffers()[2] is not None and part.buffers()[2].size else np.empty(0, np.uint8)
        i = 0
        while i < len(part):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
            j = min(j, len(part))
            yield base + i, offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]
            i = j


_SOLID = np.ones(256, bool)
_SOLID[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of concatenated texts, and the number of words before each text (and in all)."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = _SOLID[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True  # a word ends with its text
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | border[:-1]))
    ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | border[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_ROUNDS = random_words(4, 31)
SHORT = 16  # bytes


def word_digests(data: np.ndarray, offsets: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two uint64 for each word of concatenated texts, and the number of words before each text (and in all). fold: A-Z as a-z.

    Words of up to SHORT bytes go through a Feistel network, a one-to-one map of their 128 bits for each length, so no two of one length meet, however they are
    made; longer ones have a cryptographic digest."""
    data = _LOWER[data] if fold else data
    starts, ends, first = words(data, offsets)
    size = ends - starts
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 9, np.dtype("<u8"), padded, strides=(1,))  # the eight bytes from each byte on
    x, y = eight[starts] & _KEEP[np.minimum(size, 8)], eight[np.minimum(starts + 8, len(data))] & _KEEP[np.clip(size - 8, 0, 8)]
    y ^= size.astype(np.uint64) << np.uint64(58)
    for i in (0, 2):
        x ^= mix64(y + _ROUNDS[i])
        y ^= mix64(x + _ROUNDS[i + 1])
    for i in np.flatnonzero(size > SHORT).tolist():
        x[i], y[i] = np.frombuffer(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=16).digest(), np.uint64)
    return x, y, first


_JOIN = np.uint64(0x9DDFEA08EB382D69)


def composed(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of `width` consecutive values, by doubling; each step mixes, so no sum of values stands for a run."""
    n = len(values)
    if n < width:
        return np.empty(0, np.uint64)
    out, done, power, length = None, 0, values, 1
    while True:
        if width & length:
            out = power.copy() if out is None else mix64(out[: n - done - length + 1] * _JOIN + power[done:])
            done += length
        if done == width:
            return out
        power, length = mix64(power[: n - 2 * length + 1] * _JOIN + power[length:]), 2 * length


def texts_once(docs: DataFrame, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(base, copies, work). base: doc_id, text and a 128-bit hash h1, h2 of the text, for each row. copies: of texts that more than
    one row has, their hash and the first row's id (null first). work: h1, h2, doc_id, text of the first rows, so that each text is worked on once
    (twice only if the very row is repeated)."""
    words = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(words).alias("h1"), F.xxhash64(F.lit(1), words).alias("h2"))
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id"))["doc_id"]
    copies = materialize(base.groupBy("h1", "h2").agg(F.count("*").alias("rows"), first.alias("first")).where("rows > 1"))
    work = join_checked(base, copies, ["h1", "h2"], "left").where("rows is null or doc_id <=> first").select("h1", "h2", "doc_id", "text")
    return base, copies, work
