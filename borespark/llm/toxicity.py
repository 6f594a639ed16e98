"""Toxicity scores by a factorization machine over hashed terms.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j / sqrt(n)), x_i = 1 if a term of bucket i occurs, n = the sum of x. The pairwise part
learns what linear weights miss, such as an insult beside the mention of a group.

Terms are lower-cased runs of letters or digits, hashed (CRC-32) into 2**bits buckets. Every bucket in five
labelled training rows or more has a place, counted by Spark over all of them; the machine is then fitted on at most `fit_rows`
rows, taken by hash. A bound on the hash, from the counted rows, leaves little more than these before any are sent to the driver.

Null or empty text: no terms, the score is sigmoid(w0). Null or other labels than 0 and 1: not used. Repeated rows count each.
No usable training rows: every score is 0. A document labelled twice is trained on twice. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import end_task, in_arrow, join_checked

TERM = re.compile(r"[^\W_]+")
MEMO = 100_000
ROWS = 250


class Terms:
    """text -> sorted array of the kept buckets' places; one dictionary lookup for each distinct term."""

    def __init__(self, bits: int, place: np.ndarray | None = None):
        self.mask, self.place, self.memo = (1 << bits) - 1, place, {}

    def of(self, text: str | None) -> np.ndarray:
        memo, out = self.memo, set()
        if len(memo) > MEMO:
            memo.clear()
        for term in set(TERM.findall(text.lower())) if text else ():
            k = memo.get(term)
            if k is None:
                k = zlib.crc32(term.encode("utf-8", "surrogatepass")) & self.mask
                memo[term] = k = int(k if self.place is None else self.place[k])
            if k >= 0:
                out.add(k)
        return np.array(sorted(out), np.int64)


def bucket_counts(rows: DataFrame, bits: int) -> DataFrame:
    """(bucket, n, n_toxic) over rows (text, toxic); each task sends one row for each bucket at most. Bucket -1 has the row counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, n, bad = Terms(bits), np.zeros((1 << bits) + 1, np.int64), np.zeros((1 << bits) + 1, np.int64)
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                at = np.append(terms.of(text.as_py()), 1 << bits)
                n[at] += 1
                bad[at] += y
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.where(at == 1 << bits, -1, at)), pa.array(n[at]), pa.array(bad[at])], ["bucket", "n", "n_toxic"])

    return in_arrow(rows, count, "bucket long, n long, n_toxic long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))


def pick_buckets(counts: DataFrame, least: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(buckets, start, pace, rows counted), for all buckets in at least `least` rows.

    start: a bucket's log odds over all rows, if its chi-square says that they aren't chance, else 0. pace: how fast the fit may
    move this linear weight; 1 for a sure bucket, a tenth for one without a signal of its own."""
    c = counts.toArrow()
    bucket, n, a = (c.column(k).to_numpy() for k in ("bucket", "n", "n_toxic"))
    big, t = int(n[bucket < 0].sum()), int(a[bucket < 0].sum())
    use = (bucket >= 0) & (n >= least) & (0 < t < big)
    order = np.argsort(bucket[use])
    bucket, n, a = bucket[use][order], n[use][order].astype(float), a[use][order].astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = np.nan_to_num((a * big - n * t) ** 2 * big / (n * t * (big - t) * (big - n)))
    if not len(bucket):
        return bucket, np.zeros(0), np.ones(0), big
    share, sure = t / big, np.where(chi > 10.8, (chi / (chi + 10.8)) ** 2, 0)
    odds = np.log((a + 4 * share) / (n - a + 4 * (1 - share)) * (1 - share) / share)
    return bucket, odds * sure, np.maximum(sure, 0.1), big


class Batch:
    """Rows of the fit, laid out once: the places they use, each row's terms as indexes into these, and the terms in the order of places."""

    def __init__(self, rows: list[tuple[np.ndarray, int]]):
        rows = [r for r in rows if len(r[0])]
        size = np.array([len(x) for x, _ in rows], np.int64)
        self.y = np.array([y for _, y in rows], np.float32)
        self.scale = (1 / np.sqrt(size)).astype(np.float32)
        self.used, flat = np.unique(np.concatenate([x for x, _ in rows]), return_inverse=True)
        self.flat = flat.astype(np.int32)
        self.first = np.cumsum(size) - size
        turn = np.argsort(flat, kind="stable")
        self.row = np.repeat(np.arange(len(rows)), size)[turn].astype(np.int32)  # by place
        self.segment = np.searchsorted(flat[turn], np.arange(len(self.used)))


def fit(rows: list[tuple[np.ndarray, int]], size: int, factors: int = 8, epochs: int = 12, batch: int = 256, rate: float = 0.05, shrink: float = 1e-4, seed: int = 7, pair_rate: float | None = None, start: np.ndarray | None = None, pace: np.ndarray | None = None) -> dict:
    """Adam on the log loss of the machine; rows are (places, label). A step moves the places of its rows alone; a place in no row
    keeps its start and has no pairs. pace slows linear weights only: pairs are learnt also by buckets without a signal of their own."""
    rng = np.random.default_rng(seed)
    mean = min(max(np.mean([y for _, y in rows]), 1e-6), 1 - 1e-6)
    start, pace = np.zeros(size) if start is None else start, np.ones(size) if pace is None else pace
    p = {"w0": np.array([np.log(mean / (1 - mean))]), "w": start.astype(np.float32), "v": rng.normal(0, 0.01, (size, factors)).astype(np.float32)}
    start, pace = p["w"].copy(), pace.astype(np.float32)
    first, second = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    times, step = np.zeros(size, np.int64), 0
    pair_rate = rate if pair_rate is None else pair_rate
    order = rng.permutation(len(rows))
    batches = [Batch([rows[i] for i in order[s : s + batch]]) for s in range(0, len(order), batch) if any(len(rows[i][0]) for i in order[s : s + batch])]

    def move(k: str, at: np.ndarray | slice, g: np.ndarray, n: np.ndarray | int, speed: np.ndarray | float) -> None:
        a, b = 0.9 * first[k][at] + 0.1 * g, 0.999 * second[k][at] + 0.001 * g * g
        first[k][at], second[k][at] = a, b
        p[k][at] -= (speed / (1 - 0.9**n)) * a / (np.sqrt(b / (1 - 0.999**n)) + 1e-8)

    for _ in range(epochs):
        for i in rng.permutation(len(batches)):
            b = batches[i]
            w, v = p["w"][b.used], p["v"][b.used]
            terms = v[b.flat]
            total = np.add.reduceat(terms, b.first, axis=0)
            pairs = (total * total - np.add.reduceat(terms * terms, b.first, axis=0)).sum(1)
            z = p["w0"][0] + np.add.reduceat(w[b.flat], b.first) + 0.5 * pairs * b.scale
            err = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - b.y) / len(b.y)).astype(np.float32)
            pair = err * b.scale
            gw = np.add.reduceat(err[b.row], b.segment) + shrink * (w - start[b.used])
            gv = np.add.reduceat((pair[:, None] * total)[b.row], b.segment, axis=0) - np.add.reduceat(pair[b.row], b.segment)[:, None] * v + shrink * v
            step += 1
            times[b.used] += 1
            n = times[b.used].astype(np.float32)
            move("w", b.used, gw, n, rate * pace[b.used])
            move("v", b.used, gv, n[:, None], pair_rate)
            move("w0", slice(None), np.array([err.sum()]), step, rate)
    p["v"][times == 0] = 0
    return p


def margins(p: dict, flat: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """w0 + linear + pairwise part, the latter as half of (sum v)**2 - sum v**2, by the root of the row's number of terms."""
    pairs = np.zeros(n)
    for v in p["v"].T:
        x = np.ascontiguousarray(v)[flat]
        pairs += np.bincount(row, x, n) ** 2 - np.bincount(row, x * x, n)
    return p["w0"][0] + np.bincount(row, p["w"][flat], n) + 0.5 * pairs / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))


def train(rows: DataFrame, *, id_col: str = "doc_id", text: str = "text", label: str = "toxic", bits: int = 18, fit_rows: int = 20_000, seed: int = 7) -> dict | None:
    """Fit on labelled rows. Bucket statistics cover all of them and give the weights to start from; the fit moves those on `fit_rows`
    rows with the least hash, in 300 steps at least."""
    use = rows.where(F.col(label).isin(0, 1)).select(F.col(text).alias("text"), F.col(label).cast("long").alias("y"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("h"))
    kept, start, pace, counted = pick_buckets(bucket_counts(use.select("text", "y"), bits))
    share = min(1.0, (fit_rows + 8 * fit_rows**0.5) / max(counted, 1))  # by eight standard deviations enough rows pass
    if share < 1:
        use = use.where(F.col("h") < int(-(2**63) + share * 2**64))
    place = np.full(1 << bits, -1, np.int32)
    place[kept] = np.arange(len(kept))
    shared = rows.sparkSession.sparkContext.broadcast(place)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(bits, shared.value)
        for b in batches:
            at = [terms.of(t.as_py()).astype("<i4").tobytes() for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.binary()), b.column(1), b.column(2)], ["at", "y", "h"])

    sample = in_arrow(use, places, "at binary, y long, h long").orderBy("h").limit(fit_rows).collect()
    if not sample:
        return None
    sample.sort(key=lambda r: (r.h, bytes(r.at)))
    data = [(np.frombuffer(r.at, "<i4"), r.y) for r in sample]
    epochs = max(6, -(-300 // -(-len(data) // 256)))
    p = fit(data, len(kept), epochs=epochs, rate=0.01, pair_rate=0.02, shrink=3e-3, seed=seed, start=start, pace=pace)
    del sample, data
    end_task()
    return p | {"place": place, "bits": bits}


def score(docs: DataFrame, model: dict | None, *, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (the id alone, by default) and score double; map-only."""
    keep = [id_col] if keep is None else keep
    if model is None:
        return docs.select(*keep, F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at_text = keep.index(text) if text in keep else len(keep)
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], *[F.col(text).alias("text")] * (text not in keep))
    schema = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        terms = Terms(p["bits"], p["place"])
        for b in (batch.slice(s, ROWS) for batch in batches for s in range(0, len(batch), ROWS)):
            at = [terms.of(t.as_py()) for t in b.column(at_text)]
            flat, row = np.concatenate([*at, np.empty(0, np.int64)]), np.repeat(np.arange(len(at)), [len(x) for x in at])
            z = margins(p, flat, row, len(at))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], [*[f"c{i}" for i in range(len(keep))], "score"])

    return in_arrow(rows, run, schema).toDF(*keep, "score")


def held_out(id_col: str = "doc_id") -> Column:
    """True for the rows kept from training: crc32 of the id as text, modulo 5, is 0. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled(docs: DataFrame, known: DataFrame) -> DataFrame:
    """docs with their labels. Texts only move if the labels are too many to be sent to them (join_checked)."""
    return join_checked(docs, known.where("doc_id is not null"), ["doc_id"], "inner")


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; trained on the labelled rows that aren't held out."""
    known = labels.where(~held_out()).select("doc_id", "toxic")
    model = train(labelled(docs.select("doc_id", "text"), known), **options)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
