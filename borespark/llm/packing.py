"""Mixture-controlled packing: deficit round-robin over source queues.

Every window of `window` tokens takes from each source's queue its quantum (window * share of the source); what a window can't
give in whole tokens stays as the source's deficit and is given by a later one. With shares fixed between exhaustions of
queues the round-robin has a closed form: by the end of window n, the queues up to s have given floor(their share * tokens so far), so a
queue's deficit is always under one token, across windows and across partitions. So only the queues' totals and the start of each
partition in its queue are needed; every task lays out its own documents.

Shares are given as weights of sources; by default a source's share is its part of all tokens, which all queues keep up to the end.
When a queue ends, the others share its part by their weights. Sources that would get less than `least` tokens a window, or stand behind
`most_queues` larger ones, have one queue together, whose own order is a round-robin over them in the same closed form, with windows
so large that each gets `least` tokens of them; what stands behind `most_queues` there has a queue of a further level. So every source keeps its
share and its own deficit. The driver holds one row for each source.

Tokens: ids of a public tokenizer without special tokens, then `end`. Documents are cut freely; every id is in exactly one piece.
All sequences but the last are full. Null text is empty (the end id alone). Null sources are a queue of their own. Repeated rows are
packed as often as they occur. Null ids are packed too. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import KEPT, in_arrow, join_checked, materialize

MEMO = 200_000
#: A full stop or comma before a blank that follows neither a letter, a digit nor white space.
JOINED = re.compile(r"[.,] (?<![^\W_][.,] )(?<!\s[.,] )")
#: Lower-case letters that no normalisation changes; such a word with signs after it, and where they meet.
PLAIN = re.compile(r"[a-zß-öø-ÿ ]*")
PAIR = re.compile(r"[a-zß-öø-ÿ]+[.,;:!?%*$&#|]+")
BORDER = re.compile(r"(?<=[a-zß-öø-ÿ])(?=[.,;:!?%*$&#|])")


def chunks_of(text: str) -> list[str]:
    """The text's chunks between blanks and line ends. The vocabulary is lower case, so text is lower-cased first, save where Python's
    rule differs or a special token may stand; a full stop or comma is a chunk of its own unless it follows another sign."""
    if "Σ" not in text and "<|" not in text:
        text = text.lower()
    text = text.replace("\n", " ")
    if not JOINED.search(text):
        text = text.replace(". ", " . ").replace(", ", " , ")
    return text.split(" ")


class Memo(dict):
    """chunk -> its number. A chunk not met before gets the next one and is listed in new."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = k = len(self)
        self.new.append(chunk)
        return k


class Encoder:
    """ids of texts. White space is dropped by the vocabulary's rules, so chunks between blanks and line ends are encoded once each.

    Words are encoded many at a time and told apart by the ids that end a word; if their number isn't as expected, one at a time.
    Words of plain lower-case letters need no normalisation and no pattern to split them, so a tokenizer without these encodes them;
    signs after such a word are a word of their own."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        ends = [i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.ends[ends] = True
        self.reset()

    def reset(self) -> None:
        self.memo = Memo()
        self.flat, self.begins, self.lengths = array("I"), array("q"), array("q")

    def learn(self) -> None:
        """Encode the chunks that have a number but no ids."""
        new, self.memo.new = self.memo.new, []
        begin, length = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        letters, pairs, others = [], [], []
        for i, c in enumerate(new):
            (letters if c.isalpha() else pairs if PAIR.fullmatch(c) else others).append(i)
        for at, each in ((letters, 1), (pairs, 2)):
            for s in range(0, len(at), 500):
                part = at[s : s + 500]
                text = " ".join([new[i] for i in part])
                if each == 2:
                    text = BORDER.sub(" ", text)
                tokenizer = self.plain if each == 2 or PLAIN.fullmatch(text) else self.tokenizer
                ids = tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
                stops = np.flatnonzero(self.ends[ids]) + 1
                if len(stops) != each * len(part) or stops[-1] != len(ids):
                    others += part
                    continue
                stops = stops[each - 1 :: each]
                length[part] = np.diff(stops, prepend=0)
                begin[part] = len(self.flat) + stops - length[part]
                self.flat.extend(ids)
        for i, e in zip(others, self.tokenizer.encode_batch([new[i] for i in others], add_special_tokens=False), strict=True):
            begin[i], length[i] = len(self.flat), len(e.ids)
            self.flat.extend(e.ids)
        self.begins.frombytes(begin.tobytes())
        self.lengths.frombytes(length.tobytes())

    def encode(self, texts: list[str | None], end: int) -> list[np.ndarray]:
        if len(self.memo) > MEMO:
            self.reset()
        number = self.memo.__getitem__
        parts = [np.fromiter(map(number, chunks), np.int64, len(chunks)) for chunks in (chunks_of(t) if t else [] for t in texts)]
        self.learn()
        flat, begins, lengths = (np.frombuffer(x, t) if len(x) else np.empty(0, t) for x, t in ((self.flat, np.uint32), (self.begins, np.int64), (self.lengths, np.int64)))
        out = []
        for which in parts:
            n = lengths[which]
            stop = np.cumsum(n)
            total = int(stop[-1]) if len(stop) else 0
            at = np.repeat(begins[which] - (stop - n), n)
            at += np.arange(total)
            ids = np.empty(total + 1, np.uint32)
            ids[:total], ids[total] = flat[at], end
            out.append(ids)
        return out


_ENCODERS: dict[str, Encoder] = {}
KEPT.append(_ENCODERS.clear)


def encoder_of(path: str) -> Encoder:
    """One for each worker process, so that what it has learnt serves its next tasks, until those of another operator begin."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokenized(docs: DataFrame, path: str, end: int) -> DataFrame:
    """(part, source, doc_id, before, n, ids): before counts the tokens of the source in the partition ahead of the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, ahead, part = encoder_of(path), {}, TaskContext.get().partitionId()
        for batch in batches:
            for s in range(0, len(batch), 256):
                piece = batch.slice(s, 256)
                sources, before, n, ids = piece.column(2).to_pylist(), [], [], []
                for source, x in zip(sources, encoder.encode(piece.column(1).to_pylist(), end), strict=True):
                    before.append(ahead.get(source, 0))
                    ahead[source] = before[-1] + len(x)
                    n.append(len(x))
                    ids.append(x.tobytes() if x.max(initial=0) > 0xFFFF else x.astype(np.uint16).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(n), pa.int64()), piece.column(2), piece.column(0), pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["part", "source", "doc_id", "before", "n", "ids"])

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")), run, "part long, source string, doc_id long, before long, n long, ids binary")


def share_of(x: np.ndarray, part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """floor(x * part / whole) in whole numbers, also where the product passes 64 bits: an estimate in floating point, mended by the remainder
    (which is right modulo 2**64). x and part up to whole, whole up to 2**50."""
    out = (x.astype(float) * part / whole).astype(np.int64)
    with np.errstate(over="ignore"):
        left = x * part - out * whole
    return out + left // whole


class Schedule:
    """How many tokens the queues up to s have given when x tokens have been given in all: piecewise linear, in whole numbers.

    A phase ends when a queue ends, which gives all its rest in it; the others give their share of that by weight (what is under a token is
    carried into the next phase). So there are no more phases than queues, and in a phase no queue is a whole token ahead or behind."""

    def __init__(self, totals: list[int], weights: list[int]):
        self.totals, rest, x = totals, list(totals), 0
        carry = [0.0] * len(rest)
        starts, bases, gifts = [], [], []
        while any(rest):
            w = [a if r else 0 for a, r in zip(weights, rest, strict=True)]
            if not any(w):
                w = [int(r > 0) for r in rest]
            k = min((i for i, a in enumerate(w) if a), key=lambda i: (Fraction(rest[i], w[i]), i))
            give = [0] * len(rest)
            for i, a in enumerate(w):
                if a:
                    want = carry[i] + rest[k] * a / w[k]
                    give[i] = rest[k] if i == k else min(rest[i], int(want))
                    carry[i] = want - give[i]
            starts.append(x)
            bases.append([t - r for t, r in zip(totals, rest, strict=True)])
            gifts.append(give)
            rest = [r - g for r, g in zip(rest, give, strict=True)]
            x += sum(give)
        self.total, self.starts = x, np.array([*starts, x], np.int64)
        none = np.zeros((len(starts), 1), np.int64)  # before the first queue
        self.bases, self.gifts = (np.hstack([none, np.cumsum(np.array(y, np.int64).reshape(len(starts), -1), axis=1)]) for y in (bases, gifts))

    def bytes(self) -> int:
        return self.starts.nbytes + self.bases.nbytes + self.gifts.nbytes

    def given(self, x: np.ndarray, s: np.ndarray) -> np.ndarray:
        """By queues 0..s-1, for each x (s = 0 gives 0)."""
        x = np.minimum(x, self.total)
        phase = np.clip(np.searchsorted(self.starts, x, "right") - 1, 0, max(len(self.bases) - 1, 0))
        start = self.starts[phase]
        return self.bases[phase, s] + share_of(x - start, self.gifts[phase, s], self.starts[phase + 1] - start)

    def taken(self, window: np.ndarray, s: np.ndarray, size: int) -> np.ndarray:
        """By queue s alone before a window begins."""
        return self.given(window * size, s + 1) - self.given(window * size, s)


def pieces(schedule: Schedule, queue: np.ndarray, start: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """(document, window, first token of the document, count, offset in the window) of documents at start in their queues."""
    windows = -(-schedule.total // size)

    own = schedule.bases[:, 1:] - schedule.bases[:, :-1]  # what each queue has given when a phase begins

    def window_of(t: np.ndarray) -> np.ndarray:
        """The window that token t of its queue stands in: the token's phase is looked up, its window bisected between the phase's borders."""
        phase = np.zeros(len(t), np.int64)
        for q in np.unique(queue):
            at = np.flatnonzero(queue == q)
            phase[at] = np.searchsorted(own[:, q], t[at], "right") - 1
        low, high = schedule.starts[phase] // size, np.minimum(-(-schedule.starts[phase + 1] // size), windows)
        while (low < high - 1).any():
            mid = (low + high) // 2
            ahead = schedule.taken(mid, queue, size) > t
            high, low = np.where(ahead, mid, high), np.where(ahead, low, mid)
        return low

    a, b = window_of(start), window_of(start + n - 1)
    many = b - a + 1
    doc = np.repeat(np.arange(len(n)), many)
    window = a[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    q = queue[doc]
    begin, stop = schedule.taken(window, q, size), schedule.taken(window + 1, q, size)
    first, last = np.maximum(begin, start[doc]), np.minimum(stop, (start + n)[doc])
    ahead = schedule.given((window + 1) * size, q) - schedule.given(window * size, q)
    keep = last > first
    return tuple(x[keep] for x in (doc, window, first - start[doc], last - first, ahead + first - begin))


class Levels:
    """Schedules one below another: the last queue of each holds the sources of the next. Queues are numbered through all levels."""

    def __init__(self, sources: list[tuple[int, int]], window: int, least: int, most: int):
        """sources: (tokens, weight), by falling weight. Where each stands: self.queue = [(level, queue)]."""
        sources = [(t, max(1, w)) for t, w in sources]
        self.schedules, self.sizes, self.queue, i = [], [], [], 0
        while i < len(sources):
            rest = sources[i:]
            total = sum(w for _, w in rest) or 1
            size = window if not self.sizes else max(window, -(-least * total // max(1, rest[:most][-1][1])))
            n = next((j for j, (_, w) in enumerate(rest[:most]) if w * size < least * total), min(most, len(rest)))
            here, below = rest[:n], rest[n:]
            queues = [*here, (sum(t for t, _ in below), max(1, sum(w for _, w in below)))] if below else here
            self.schedules.append(Schedule([t for t, _ in queues], [w for _, w in queues]))
            self.sizes.append(size)
            self.queue += [(len(self.schedules) - 1, j) for j in range(n)]
            i += n

    def pieces(self, place: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, window, first token of the document, count, offset in the window) of documents at start in their sources' queues."""
        level, queue = (np.array([self.queue[p][k] for p in place.tolist()], np.int64) for k in (0, 1))
        doc, first = np.arange(len(n)), np.zeros(len(n), np.int64)
        out = []
        for depth in range(len(self.schedules) - 1, -1, -1):
            at = np.flatnonzero(level == depth)
            d, window, f, count, offset = pieces(self.schedules[depth], queue[at], start[at], n[at], self.sizes[depth])
            found = doc[at][d], window, first[at][d] + f, count, offset
            if depth == 0:
                out.append(found)
                continue
            # the pieces' places in this level's order are places in the queue above
            keep = level != depth
            above = len(self.schedules[depth - 1].totals) - 1
            level = np.append(level[keep], np.full(len(d), depth - 1))
            queue = np.append(queue[keep], np.full(len(d), above))
            start = np.append(start[keep], window * self.sizes[depth] + offset)
            n, doc, first = np.append(n[keep], count), np.append(doc[keep], found[0]), np.append(first[keep], found[2])
        found = out[0] if out else tuple(np.empty(0, np.int64) for _ in range(5))
        turn = np.lexsort((found[2], found[0]))
        return tuple(x[turn] for x in found)


def pack(docs: DataFrame, *, path: str, window: int = 2048, end: int = 1, weights: dict[str, int] | None = None, least: int = 2, most_queues: int = 1000) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece."""
    table = materialize(tokenized(docs, path, end))
    totals = materialize(table.groupBy("source", "part").agg(F.sum("n").alias("n")))
    ranked = totals.groupBy("source").agg(F.sum("n").alias("n")).withColumn("w", F.col("n"))
    if weights is not None:
        given = F.lit(1)
        for name, value in weights.items():
            given = F.when(F.col("source") == name, int(value)).otherwise(given)
        ranked = ranked.withColumn("w", given.cast("long"))
    ranked = materialize(ranked)
    sources = sorted(((r.source, r.n, r.w) for r in ranked.collect()), key=lambda r: (-r[2], r[0]))  # one row for each source
    schedule = Levels([(n, w) for _, n, w in sources], window, least, most_queues)
    numbered = docs.sparkSession.createDataFrame([(name, i) for i, (name, _, _) in enumerate(sources)], "source string, queue long")
    parts = totals.join(numbered, "source")
    # A queue's partitions in order, summed in two levels so that no queue is one task: blocks of partitions, then within.
    block = Window.partitionBy("queue").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inner = Window.partitionBy("queue", "block").orderBy("part", "source").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("block", F.floor(F.col("part") / 1024))
    blocks = parts.groupBy("queue", "block").agg(F.sum("n").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(block), F.lit(0))).drop("n")
    at = F.col("base") + F.coalesce(F.sum("n").over(inner), F.lit(0))
    starts = materialize(parts.join(blocks, ["queue", "block"]).select("source", "part", "queue", at.alias("ahead")))
    joined = join_checked(table, starts, ["source", "part"], "inner")
    shared = docs.sparkSession.sparkContext.broadcast(schedule)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, len(batch), 2000):
                part = batch.slice(s, 2000)
                start, n, q = (np.asarray(part.column(i)).astype(np.int64) for i in (1, 2, 3))
                doc, at, first, count, offset = shared.value.pieces(q, start, n)
                ids = [np.frombuffer(x, np.uint32 if len(x) == 4 * k else np.uint16).astype("<u4").tobytes() for x, k in zip(part.column(4).to_pylist(), n, strict=True)]
                crc = [zlib.crc32(memoryview(ids[d])[4 * f : 4 * (f + c)]) for d, f, c in zip(doc.tolist(), first.tolist(), count.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(first), pa.array(count), pa.array(crc, pa.int64()), pa.array(n[doc]), pa.array(at), pa.array(offset)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    rows = joined.select("doc_id", (F.col("ahead") + F.col("before")).alias("start"), "n", F.col("queue").cast("long"), "ids")
    return in_arrow(rows, run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
