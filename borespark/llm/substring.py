"""Exact removal of repeated word windows behind a count-min prefilter.

A window is `width` consecutive words of one document. Its anchor is the run of `gram` words in it with the least hash (the
first of equal ones), so equal windows have equal anchors, at the same place within them, and two equal windows never share one
anchor position. Two count-min sketches (partition sketches, merged) only overestimate: the first counts anchors, the second counts the
windows whose anchor may be repeated. The last pass sends only windows estimated repeated, grouped by anchor, and groups
them by 128 bits of the window: words' digests, joined by mixing steps in two streams. A window that occurs once in fact is found to be so there; none that repeats is lost.

Texts that several rows have are worked on once: of the later rows every window is a repetition. Groups are streamed in order of
document and place; the state is the distinct windows of one anchor. An anchor with more than `block` runs is first grouped
within shares of the documents, as many as its count asks for; the shares' first occurrences are then dealt out window by window.

Null text: no words. "Earlier" is by doc_id (null first), then place. Rows with the same doc_id and the same text are one document,
given twice; rows with the same doc_id and other texts are ordered by a hash of the text. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import composed, in_arrow, join_checked, materialize, ranges_of_texts, text_parts, texts_once, word_digests
from .sketch import maybe_repeated, repeated_planes, width_bits

class Windows:
    """The windows of concatenated texts. doc, place: text and first word (of all) of each; anchor: its anchor's first word; key: the anchor's hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int, gram: int):
        self.width = width
        *self.halves, self.first = word_digests(data, offsets)
        n = len(self.halves[0]) - width + 1
        if n <= 0:
            self.doc = self.place = self.anchor = np.empty(0, np.int64)
            self.key = np.empty(0, np.uint64)
            return
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        grams = composed(self.halves[0], gram)
        best, at = grams[:n].copy(), np.zeros(n, np.int64)
        for i in range(1, width - gram + 1):
            less = grams[i : i + n] < best
            best[less] = grams[i : i + n][less]
            at[less] = i
        self.place = np.flatnonzero(doc[:n] == doc[width - 1 :])
        self.doc, self.anchor = doc[self.place], self.place + at[self.place]
        self.key = best[self.place]

    def anchors(self) -> np.ndarray:
        """The key of each anchor position once."""
        new = np.ones(len(self.place), bool)
        new[1:] = (np.diff(self.anchor) != 0) | (np.diff(self.doc) != 0)
        return self.key[new]

    def hashes(self, which: int) -> np.ndarray:
        """A hash of every window's words, from one half of their digests or the other."""
        return composed(self.halves[which], self.width)[self.place]

    def runs(self, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, count): runs of neighbouring windows in use (their indexes, sorted) that have one anchor."""
        new = np.ones(len(use), bool)
        new[1:] = (np.diff(self.place[use]) != 1) | (np.diff(self.anchor[use]) != 0) | (np.diff(self.doc[use]) != 0)
        run = np.flatnonzero(new)
        return run, np.diff(np.append(run, len(use)))


def flags(rows: DataFrame) -> DataFrame:
    """rows (key, share, known, doc_id, h1, h2, at, h): runs of windows, taken in order within each (key, share).
    (key, known, doc_id, h1, h2, at, h, n, state) of parts of runs. state 2: repeats an earlier window of its group; 0: the first of its kind there, with
    hashes; 1: a first one again, when its repetition is met, neighbours together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list] = {}
        now, before = None, None
        for batch in batches:
            out: list[tuple] = []
            firsts: list[list] = []
            key, share, *names, at, h = (c.to_pylist() for c in batch.columns)
            who = list(zip(*names, strict=True))
            for i in range(len(key)):
                if (key[i], share[i]) != now:
                    now, before, seen = (key[i], share[i]), None, {}
                if (who[i], at[i]) == before:
                    continue  # the same document given twice
                before = (who[i], at[i])
                s, start, state = h[i], 0, None
                n = len(s) // 16
                for j in range(n + 1):
                    w = s[16 * j : 16 * j + 16]
                    old = seen.get(w) if j < n else None
                    dup = None if j == n else old is not None
                    if dup is False:
                        seen[w] = [who[i], at[i] + j]
                    elif dup and old:
                        if firsts and firsts[-1][1] == old[0] and firsts[-1][2] + firsts[-1][3] == old[1]:
                            firsts[-1][3] += 1
                        else:
                            firsts.append([key[i], *old, 1])
                        old.clear()
                    if dup != state:
                        if state is not None:
                            out.append((key[i], *who[i], at[i] + start, None if state else s[16 * start : 16 * j], j - start, 2 if state else 0))
                        start, state = j, dup
            out += [(k, *w, a, None, n, 1) for k, w, a, n in firsts]
            if out:
                c = list(zip(*out, strict=True))
                types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types, strict=True)], ["key", "known", "doc_id", "h1", "h2", "at", "h", "n", "state"])

    order = ["key", "share", "known", "doc_id", "h1", "h2", "at"]
    dealt = rows.repartition("key", "share").sortWithinPartitions(*order)
    return in_arrow(dealt.select(*order, "h"), run, "key long, known boolean, doc_id long, h1 long, h2 long, at long, h binary, n long, state int")


def across_shares(rows: DataFrame) -> DataFrame:
    """rows (known, doc_id, h1, h2, at, h): first occurrences in the shares of anchors that have several. Dealt out by the windows themselves, so that a window meets
    only its own first occurrences, one from a share at most: (h1, h2, at, n, state), state 2 for all but the first of several, 1 for that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [np.frombuffer(h, np.int64).reshape(-1, 2) for h in batch.column(5).to_pylist()]
            n = np.array([len(h) for h in hashes], np.int64)
            take = pa.array(np.repeat(np.arange(len(n)), n))
            both = np.concatenate([*hashes, np.empty((0, 2), np.int64)])
            at = np.repeat(np.asarray(batch.column(4)) - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(take) for i in range(4)], pa.array(at), pa.array(both[:, 0]), pa.array(both[:, 1])], ["known", "doc_id", "h1", "h2", "at", "w1", "w2"])

    windows = in_arrow(rows.select("known", "doc_id", "h1", "h2", "at", "h"), run, "known boolean, doc_id long, h1 long, h2 long, at long, w1 long, w2 long")
    same = Window.partitionBy("w1", "w2")
    met = windows.withColumns({"times": F.count("*").over(same), "place": F.row_number().over(same.orderBy("known", "doc_id", "h1", "h2", "at"))}).where("times > 1")
    return met.select("h1", "h2", "at", F.lit(1).cast("long").alias("n"), F.when(F.col("place") > 1, 2).otherwise(1).alias("state"))


def remove_repeats(docs: DataFrame, *, text: str = "text", width: int = 20, gram: int = 10, block: int = 4096, passage: int = 51, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, n_passages (and kept_text, if wanted) for each row of docs. n_passages: maximal runs of
    at least `passage` words covered by windows that also start elsewhere, earlier or later."""
    base, copies, work = texts_once(docs, text)
    share = docs.sparkSession.sparkContext.broadcast
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    bits = width_bits(size // 32), width_bits(size // 16)  # anchors and windows to be expected, at a few bytes a word

    def windows_of(column: pa.Array) -> Iterator[tuple[int, Windows]]:
        for row, offsets, data in text_parts(column):
            yield row, Windows(data, offsets, width, gram)

    def anchors(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, w in windows_of(batch.column(0)):
            yield w.anchors()

    marked = share(repeated_planes(work.select("text"), anchors, bits[0]))

    def below(w: Windows) -> np.ndarray:
        return np.flatnonzero(maybe_repeated(w.key, marked.value, bits[0])) if len(w.key) else np.empty(0, np.int64)

    def counted(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, w in windows_of(batch.column(0)):
            use = below(w)
            if len(use):
                yield w.hashes(0)[use]

    planes = share(repeated_planes(work.select("text"), counted, bits[1]))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, w in windows_of(batch.column(3)):
                use = below(w)
                if not len(use):
                    continue
                one = w.hashes(0)[use]
                keep = maybe_repeated(one, planes.value, bits[1])
                use, one = use[keep], one[keep]
                if not len(use):
                    continue
                both = np.stack([one, w.hashes(1)[use]], 1).tobytes()
                run, count = w.runs(use)
                lead = use[run]
                take = pa.array(w.doc[lead] + row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w.key[lead].astype(np.int64)), *[batch.column(i).take(take) for i in range(3)], pa.array(w.place[lead] - w.first[w.doc[lead]]), pa.array([both[16 * a : 16 * (a + c)] for a, c in zip(run.tolist(), count.tolist(), strict=True)], pa.binary())],
                    ["key", "h1", "h2", "doc_id", "at", "h"],
                )

    sent = materialize(in_arrow(work, send, "key long, h1 long, h2 long, doc_id long, at long, h binary"))
    hot = materialize(sent.groupBy("key").count().where(F.col("count") > block))
    shares = F.coalesce(F.ceil(F.col("count") / block), F.lit(1))
    dealt = join_checked(sent.withColumn("known", F.col("doc_id").isNotNull()), hot, ["key"], "left").withColumn("share", F.pmod(F.xxhash64("h1", "h2"), shares)).drop("count")
    inner = materialize(flags(dealt))
    outer = across_shares(join_checked(inner.where("state = 0"), hot, ["key"], "left_semi"))
    found = inner.where("state > 0").select("h1", "h2", "at", "n", "state").unionByName(outer).select("h1", "h2", "at", (F.col("at") + F.col("n") + width - 1).alias("stop"), "state")
    kinds = F.explode(F.when(F.col("state") == 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1))))
    cuts = materialize(ranges_of_texts(found.select("h1", "h2", kinds.alias("kind"), F.col("at").alias("start"), "stop")).withColumnsRenamed({"first": "gone", "second": "met"}))
    joined = join_checked(join_checked(base, copies, ["h1", "h2"], "left"), cuts, ["h1", "h2"], "left")
    joined = joined.select("doc_id", "text", (F.col("rows") > 1).alias("copied"), (~F.col("doc_id").eqNullSafe(F.col("first"))).alias("later"), "gone", "met")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, digest, passages, kept_text = [], [], [], [], []
            for t, copied, later, *ranges in zip(batch.column(1), *(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                every = (t.as_py() or "").encode("utf-8", "surrogatepass").split()
                total.append(len(every))
                gone, met = (list(zip(r[::2], r[1::2], strict=True)) if r else [] for r in ranges)
                if copied and len(every) >= width:
                    met = [(0, len(every))]
                    gone = met if later else gone
                passages.append(sum(b - a >= passage for a, b in met))
                if gone:
                    every = [w for a, b in zip([0, *(b for _, b in gone)], [*(a for a, _ in gone), len(every)], strict=True) for w in every[a:b]]
                removed.append(total[-1] - len(every))
                out = b" ".join(every)
                digest.append(hashlib.sha256(out).hexdigest())
                if keep_text:
                    kept_text.append(out.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(passages, pa.int64()), *[pa.array(kept_text, pa.string())] * keep_text],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "n_passages", *["kept_text"] * keep_text],
            )

    return in_arrow(joined, cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, n_passages long" + ", kept_text string" * keep_text)
