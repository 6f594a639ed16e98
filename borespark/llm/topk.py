"""Exact top-k by inner product in three phases with a uniform threshold.

Components become floor(scale * x). A score is the sum of m partial scores, one from each list; list i covers the i-th part of
the components. Queries go to all tasks in rounds of `room` bytes at most; in a round each task scores its own vectors, which are
dealt out once and not copied.

1. Each list gives every query the k best entries of every task and its least partial score. The few objects named are scored in full; the
   k-th best of them is t1 (here and in t2 ranks go further by the number of different vectors that the query's id has).
2. List i gets the cutoff low_i + (t1 - sum of lows) / m: an object below the cutoff in every list sums to less than t1, so it
   can't be in the answer. Lists give all entries at or above their cutoffs; the k-th best sum is now t2.
3. Objects whose upper bound (the cutoff for lists that didn't name them) reaches t2 are scored exactly.

Equal whole-number vectors are one object as far as scores go: only those of its ids that can be among the k best, with the
query's own left out, are carried (the k + 1 smallest). Vectors that are null or hold null or non-finite components take no part. Rows
of different lengths are never compared. Rows that repeat a vec_id with the same vector count once, with different ones
as several candidates; a query's own rows are all those with its id. Null ids take no part. Fewer candidates than k: all of them.
Scores are exact as long as they fit in 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, materialize
from .embeddings import usable


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products; in floating point where no sum can pass 2**53."""
    most = max(1, np.abs(q).max(initial=0)) * max(1, np.abs(x).max(initial=0)) * max(1, q.shape[1])
    return (q.astype(float) @ x.astype(float).T).astype(np.int64) if float(most) < 2**53 else q @ x.T


def scan(vectors: DataFrame, queries: DataFrame, work, schema: str, *, room: int) -> DataFrame:
    """work(blocks of queries by size, batches of vectors) in every task, for all rounds. vectors: a written table, dealt out once for all of them. queries: q, size,
    vector and maybe cuts."""
    total = queries.agg(F.sum(F.col("size").cast("long") * 8)).first()[0] or 0
    rounds = max(1, -(-total // room))
    out = []
    for r in range(rounds):
        rows = queries.where(F.pmod(F.xxhash64(F.lit(4), "q"), F.lit(rounds)) == r).toArrow()
        blocks = {}
        for d in set(rows.column("size").to_pylist()):
            some = rows.filter(pa.array(np.asarray(rows.column("size")) == d))
            blocks[d] = tuple(matrix(some.column(c), n) if n else np.asarray(some.column(c)) for c, n in (("q", 0), ("vector", d), *[("cuts", -1)] * ("cuts" in some.column_names)))
        sent = vectors.sparkSession.sparkContext.broadcast(blocks)
        out.append(materialize(in_arrow(vectors, lambda batches, sent=sent: work(sent.value, batches), schema)))
        sent.unpersist()
    return reduce(DataFrame.union, out)


def matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    """Rows of whole numbers; d -1: as wide as the first."""
    flat = np.asarray(column.combine_chunks().flatten()) if len(column) else np.empty(0, np.int64)
    return flat.astype(np.int64).reshape(len(column), d if len(column) else max(d, 0))


def parts_of(d: int, lists: int) -> list[slice]:
    """So many even parts of d components."""
    return [slice(i * d // lists, (i + 1) * d // lists) for i in range(lists)]


def by_size(batches: Iterator[pa.RecordBatch], sizes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, objects, vectors) of batches (object, vector, size) with a size that queries have, a thousand rows at a time."""
    for batch in batches:
        size = np.asarray(batch.column(2))
        for d in set(size.tolist()) & set(sizes):
            part = batch.filter(pa.array(size == d))
            for s in range(0, len(part), 1000):
                x = part.slice(s, 1000)
                yield d, np.asarray(x.column(0)), np.asarray(x.column(1).flatten()).astype(np.int64).reshape(len(x), d)


def top_k(table: DataFrame, *, k: int = 5, every: int = 50, scale: int = 256, lists: int = 2, room: int = 32_000_000, x_block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every` its k best others."""
    whole = table.where(usable() & F.col("vec_id").isNotNull()).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vector"))
    whole = whole.where(F.size("vector") > 0).withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64(F.lit(2), "vector"))
    few = whole.withColumn("place", F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    objects = few.groupBy("h1", "h2").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"), F.first("vector").alias("vector")).drop("h1", "h2")
    objects = materialize(objects.withColumn("size", F.size("vector")).withColumn("object", F.monotonically_increasing_id()))  # a number of its own, once written
    queries = materialize(whole.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.xxhash64("vec_id", "vector").alias("q"), "vector", F.size("vector").alias("size")).distinct().withColumn("own", F.count("*").over(Window.partitionBy("query_id"))))
    parts = max(1, -(-objects.count() // x_block))
    vectors = materialize(objects.select("object", "vector", "size").repartition(parts, "object"))
    slim = queries.select("query_id", "q", "vector", "size")

    def first(blocks: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of all vectors of a task, for each query and list, the best entries and the least score."""
        best = {}
        for d, objects, x in by_size(batches, blocks):
            q = blocks[d][1]
            for i, cut in enumerate(parts_of(d, lists)):
                score = products(q[:, cut], x[:, cut])
                old = best.get((d, i))
                low, which = score.min(1), np.broadcast_to(objects, score.shape)
                if old:
                    low, score, which = np.minimum(low, old[2]), np.hstack([old[0], score]), np.hstack([old[1], which])
                if score.shape[1] > k + 1:
                    top = np.argpartition(-score, k, axis=1)[:, : k + 1]
                    score, which = np.take_along_axis(score, top, 1), np.take_along_axis(which, top, 1)
                best[d, i] = score, which, low
        for (d, i), (score, which, low) in best.items():
            n = score.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(blocks[d][0], n)), pa.array(np.full(score.size, i, np.int32)), pa.array(which.ravel()), pa.array(score.ravel()), pa.array(np.repeat(low, n))], ["q", "part", "object", "score", "low"])

    heads = scan(vectors, slim, first, "q long, part int, object long, score long, low long", room=room)
    lows = heads.groupBy("q", "part").agg(F.min("low").alias("low"))
    lows = materialize(lows.join(lows.groupBy("q").agg(F.sum("low").alias("lows")), "q"))

    def kth(entries: DataFrame, name: str) -> DataFrame:
        """The (k + own)-th best sum of each query (own: its id's different vectors), null if there are fewer."""
        sums = entries.select("q", "part", "object", "score").join(lows, ["q", "part"]).groupBy("q", "object").agg((F.sum(F.col("score") - F.col("low")) + F.first("lows")).alias("total"))
        return last(sums.join(queries.select("q", "own"), "q"), name)

    def last(sums: DataFrame, name: str) -> DataFrame:
        ranked = sums.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("total"), "object"))).where(F.col("place") <= k + F.col("own"))
        return ranked.groupBy("q").agg(F.when(F.count("*") >= k + F.max("own"), F.min("total")).alias(name))

    cut = F.when(F.col("t1").isNull(), F.lit(-(2**62))).otherwise(F.col("low") + F.floor((F.col("t1") - F.col("lows")) / lists))
    best = heads.withColumn("place", F.row_number().over(Window.partitionBy("q", "part").orderBy(F.desc("score"), "object"))).where(F.col("place") <= k + 1)
    score = F.aggregate(F.zip_with("qv", "vector", lambda a, b: a * b), F.lit(0).cast("long"), lambda a, b: a + b)
    named = best.select("q", "object").distinct().join(queries.select("q", "own", F.col("vector").alias("qv")), "q").join(objects.select("object", "vector"), "object").select("q", "own", "object", score.alias("total"))
    t1 = last(named, "t1")
    cutoffs = materialize(lows.join(t1, "q").select("q", "part", "low", "lows", cut.cast("long").alias("cut")))
    told = slim.join(cutoffs.groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "cut"))), lambda x: x["cut"]).alias("cuts")), "q")

    def second(blocks: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All entries at or above the cutoffs."""
        for d, objects, x in by_size(batches, blocks):
            q, vector, cuts = blocks[d]
            for i, cut in enumerate(parts_of(d, lists)):
                score = products(vector[:, cut], x[:, cut])
                a, b = np.nonzero(score >= cuts[:, i : i + 1])
                yield pa.RecordBatch.from_arrays([pa.array(q[a]), pa.array(np.full(len(a), i, np.int32)), pa.array(objects[b]), pa.array(score[a, b])], ["q", "part", "object", "score"])

    sent = scan(vectors, told, second, "q long, part int, object long, score long", room=room)
    bounds = cutoffs.groupBy("q").agg(F.sum("cut").alias("cut_sum"))
    upper = sent.join(cutoffs.select("q", "part", "cut"), ["q", "part"]).groupBy("q", "object").agg(F.sum("score").alias("part_sum"), F.sum("cut").alias("named"), F.count("*").alias("n"))
    open_ = upper.join(bounds, "q").join(kth(sent, "t2"), "q", "left").where(F.col("t2").isNull() | (F.col("n") == lists) & (F.col("part_sum") >= F.col("t2")) | (F.col("n") < lists) & (F.col("part_sum") + F.col("cut_sum") - F.col("named") >= F.col("t2")))
    exact = open_.join(queries.select("q", "query_id", F.col("vector").alias("qv")), "q").join(objects.select("object", "ids", "vector"), "object")
    score = F.aggregate(F.zip_with("qv", "vector", lambda a, b: a * b), F.lit(0).cast("long"), lambda a, b: a + b)
    rows = exact.select("query_id", "q", score.alias("score"), F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    order = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
