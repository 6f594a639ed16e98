"""Exact removal of repeated byte strings by merging shards' Burrows-Wheeler transforms.

Texts are cut at anchors: the anchor of a string of `passage` bytes is the run of `gram` bytes in it with the least hash, so equal
strings have equal anchors at the same place. Strings whose anchor occurs once, by a count-min sketch that never underestimates, can't
repeat. Of the others, each run with one anchor is a context: the bytes from the anchor on (`width` at most) and those before it read
backwards, spelled in symbols of SYMBOL bytes that start at the anchor.

1. Contexts are dealt out to shards by anchor and, where an anchor has more than `block` contexts, by document. A shard writes equal
   contexts once and builds the Burrows-Wheeler transform of its contexts (those to the right, those to the left), with a dictionary of its symbols.
2. Where the shards of an anchor meet, their transforms are merged by refining the interleave: it starts as the shards stand one
   after the other, and round h moves each place by its transform's symbol, stably, which orders all suffixes by h symbols; a boundary
   that appears in round h has h - 1 symbols before it in common. No suffix is sorted again and no text is compared; symbols are
   ranks in the merged dictionary, and at a boundary the two symbols give the common prefix to the byte.
3. Strings of w bytes that start o bytes before the anchor repeat exactly if they share a right interval of depth w - o and a left
   interval of depth o. That is read off for w = `width`, which is removed, and for w = `passage`, which is reported.

Texts that several rows have are worked on once; such a text is a repetition as a whole. A text of more than PORTION bytes is
anchored portion by portion. Null text: no bytes. Rows are documents of their own, also with equal doc_id; equal rows get equal results, and
each makes the other a repetition. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Powers, byte_table, in_arrow, join_checked, materialize, ranges_of_texts, rolling, text_parts, texts_once
from .sketch import maybe_repeated, repeated_planes, width_bits

SYMBOL = 40
PORTION = 2_000_000
_TABLE = byte_table(21)
_POWERS = Powers(0x9FB21C651E98DF25)


def sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` consecutive values, by prefix and suffix minima of blocks."""
    n = len(v) - width + 1
    pad = np.full(-(-len(v) // width) * width, np.iinfo(v.dtype).max, v.dtype)
    pad[: len(v)] = v
    blocks = pad.reshape(-1, width)
    front = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], front[width - 1 : width - 1 + n])


def anchored(data: np.ndarray, offsets: np.ndarray, width: int, gram: int):
    """Runs of strings of width bytes with one anchor: (text, first byte in data, count, anchor's byte in data, anchor key)."""
    size = np.diff(offsets)
    many = np.maximum(size - width + 1, 0)
    if not many.any():
        e = np.empty(0, np.int64)
        return e, e, e, e, e.astype(np.uint64)
    h = rolling(_TABLE[data], gram, _POWERS)
    low = np.uint64(0xFFFFFFFF)
    anchor = (sliding_least((h & ~low) | np.arange(len(h), dtype=np.uint64), width - gram + 1) & low).astype(np.int64)
    doc = np.repeat(np.arange(len(size)), many)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + offsets[:-1][doc]
    at = anchor[place]
    new = np.ones(len(place), bool)
    new[1:] = (np.diff(place) != 1) | (np.diff(at) != 0)
    run = np.flatnonzero(new)
    return doc[run], place[run], np.diff(np.append(run, len(place))), at[run], h[at[run]]


def portions(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int, np.ndarray]]:
    """(first row, offsets, bytes, bytes of the text before these, all bytes): short texts together, a long one in overlapping portions, so
    that each start of a string of width bytes is in one portion."""
    for row, offsets, data in text_parts(column):
        if len(data) <= PORTION:
            yield row, offsets, data, 0, data
            continue
        for s in range(0, len(data) - width + 1, PORTION):
            part = data[s : s + PORTION + width - 1]
            yield row, np.array([0, len(part)]), part, s, data


def blocks(flat: np.ndarray, begin: np.ndarray, length: np.ndarray, step: int, symbols: int) -> np.ndarray:
    """Bytes flat[begin], flat[begin + step], ... (length of them, at most symbols * SYMBOL) of each row, padded with zeros, as symbols."""
    wide = symbols * SYMBOL
    out = np.zeros((len(begin), wide), np.uint8)
    reach = np.arange(wide)[None, :]
    for s in range(0, len(begin), 2048):
        at = begin[s : s + 2048, None] + step * reach
        out[s : s + 2048] = np.where(reach < length[s : s + 2048, None], flat[np.clip(at, 0, len(flat) - 1)], 0)
    return out.view(f"S{SYMBOL}")


def transform(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The Burrows-Wheeler transform of the rows of codes (1 or more, each row followed by an end, 0), and the rows in the order of their whole suffixes."""
    n, k = codes.shape
    rank = np.zeros((n, k + 1), np.int64)
    rank[:, :k] = codes
    step = 1
    while step <= k:
        ahead = np.zeros_like(rank)
        ahead[:, : k + 1 - step] = rank[:, step:]
        rank = np.unique(rank * (int(rank.max()) + 1) + ahead, return_inverse=True)[1].reshape(n, k + 1)
        step *= 2
    row, at = np.divmod(np.argsort(rank.ravel(), kind="stable"), k + 1)
    return np.where(at > 0, codes[row, at - 1], 0).astype(np.int32), row[at == 0].astype(np.int32)


def spelled(bwt: np.ndarray, n: int, k: int) -> np.ndarray:
    """The n rows of k codes that a transform was made of."""
    ahead = np.empty(len(bwt), np.int64)
    ahead[np.argsort(bwt, kind="stable")] = np.arange(len(bwt))
    codes, at = np.empty((n, k), np.int32), np.arange(n)
    for j in range(k - 1, -1, -1):
        codes[:, j] = bwt[at]
        at = ahead[at]
    return codes


def merged(transforms: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge transforms over one alphabet by refining their interleave. For the whole suffixes, in merged order: which they are (by
    shards in turn, in each shard's own order), and the symbols each has in common with the one before it (-1 for the first)."""
    every, sizes = np.concatenate(transforms), [len(t) for t in transforms]
    n = len(every)
    from_ = np.repeat(np.arange(len(sizes), dtype=np.int16 if len(sizes) < 32768 else np.int64), sizes)
    border, common = np.zeros(n, bool), np.full(n, k, np.int64)
    border[0] = True
    place = np.empty(n, np.int64)
    for h in range(k + 1):
        place[np.argsort(from_, kind="stable")] = np.arange(n)  # a shard's suffixes stay in its own order
        if h == k:
            break
        symbol, interval = every[place], np.cumsum(border)
        turn = np.argsort(symbol, kind="stable")
        from_, symbol = from_[turn], symbol[turn]
        interval = np.where(symbol == 0, 0, interval[turn])  # behind an end nothing is compared
        new = np.ones(n, bool)
        new[1:] = (symbol[1:] != symbol[:-1]) | (interval[1:] != interval[:-1])
        common[new & ~border] = h
        border |= new
    at = np.flatnonzero(every[place] == 0)
    which = (np.cumsum(every == 0) - 1)[place[at]]
    return which, np.append(-1, np.minimum.reduceat(common[: at[-1] + 1], at[:-1] + 1)) if len(at) > 1 else np.array([-1])


def merged_order(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """parts: each shard's (dictionary, transform over it, rows in order). The rows of all shards in merged order, and the bytes each has in common
    with the one before it (-1 for the first)."""
    words, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    cut = np.cumsum([0] + [len(p[0]) for p in parts])
    mapped = [np.append(0, at[a:b] + 1)[p[1]] for p, a, b in zip(parts, cut, cut[1:], strict=False)]
    which, shared = merged(mapped, symbols)
    sizes = [len(p[2]) for p in parts]
    rows = np.concatenate([p[2] + base for p, base in zip(parts, np.cumsum([0, *sizes[:-1]]), strict=True)])
    order = rows[which]
    codes = np.concatenate([spelled(m, n, symbols) for m, n in zip(mapped, sizes, strict=True)])
    letters = words.view(np.uint8).reshape(len(words), SYMBOL)
    common = shared * SYMBOL
    open_ = np.flatnonzero((shared >= 0) & (shared < symbols))
    a, b = codes[order[open_ - 1], shared[open_]] - 1, codes[order[open_], shared[open_]] - 1
    common[open_] += (letters[a] != letters[b]).argmax(1)
    return order, np.where(shared < 0, -1, common)


def repeated_strings(right: tuple, left: tuple, before: np.ndarray, count: np.ndarray, after: np.ndarray, many: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the strings of width bytes that repeat; place 0 is the context's first. right, left: (order, common); before, after: the context's
    bytes on either side of the anchor's start; many: the context stands several times."""
    n = len(before)

    def longest(order: np.ndarray, common: np.ndarray) -> np.ndarray:
        out = np.empty(n, np.int64)
        out[order] = np.maximum(common, np.append(common[1:], -1))
        return out

    may = many | (longest(*right) + longest(*left) >= width)
    right_at, left_at = np.empty(n, np.int64), np.empty(n, np.int64)
    right_at[right[0]], left_at[left[0]] = np.arange(n), np.arange(n)
    rows, which, least = [np.empty(0, np.int64)], [np.empty(0, np.int64)], before - count + 1
    for o in range(int(before.max(initial=-1)) + 1):
        use = np.flatnonzero(may & (least <= o) & (before >= o) & (after >= width - o))
        if not len(use):
            continue
        a, b = np.cumsum(right[1] < width - o)[right_at[use]], np.cumsum(left[1] < o)[left_at[use]]
        both = a * (n + 1) + b
        turn = np.argsort(both, kind="stable")
        same = both[turn][1:] == both[turn][:-1]
        hit = np.zeros(len(use), bool)
        hit[turn] = np.append(same, False) | np.append(False, same)
        hit = use[hit | many[use]]
        rows.append(hit)
        which.append(before[hit] - o)
    return np.concatenate(rows), np.concatenate(which)


def covered(row: np.ndarray, begin: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, stop): what strings of width bytes at begin cover in each row, touching ones together."""
    turn = np.lexsort((begin, row))
    row, begin = row[turn], begin[turn]
    new = np.ones(len(row), bool)
    new[1:] = (np.diff(row) != 0) | (np.diff(begin) > width)
    first = np.flatnonzero(new)
    return row[first], begin[first], begin[np.append(first[1:], len(row)) - 1] + width if len(row) else begin


SHARD = "bucket long, n int, words_r binary, bwt_r binary, order_r binary, words_l binary, bwt_l binary, order_l binary, before binary, count binary, after binary, many binary, members binary"


def shard_transforms(contexts: DataFrame, symbols: tuple[int, int]) -> DataFrame:
    """contexts (bucket, shard, h1, h2, at, before, count, ctx) -> one row of SHARD for each (bucket, shard). members: for every place where a
    context stands its number, h1, h2 and at."""

    def build(bucket: int, rows: list[tuple]) -> dict:
        number: dict[tuple, int] = {}
        members = sorted({(number.setdefault((before, count, ctx), len(number)), h1, h2, at) for h1, h2, at, before, count, ctx in rows})
        before, count, size = (np.array(x, np.int64) for x in ([k[0] for k in number], [k[1] for k in number], [len(k[2]) for k in number]))
        flat = np.frombuffer(b"".join(k[2] for k in number), np.uint8)
        anchor = np.cumsum(size) - size + before
        out = {"bucket": bucket, "n": len(number), "before": before.tobytes(), "count": count.tobytes(), "after": (size - before).tobytes()}
        for side, begin, length, step, k in (("r", anchor, size - before, 1, symbols[0]), ("l", anchor - 1, before, -1, symbols[1])):
            words, codes = np.unique(blocks(flat, begin, length, step, k), return_inverse=True)
            bwt, order = transform(codes.reshape(-1, k) + 1)
            out |= {f"words_{side}": words.tobytes(), f"bwt_{side}": bwt.tobytes(), f"order_{side}": order.tobytes()}
        members = np.array(members, np.int64)
        return out | {"many": (np.bincount(members[:, 0], minlength=len(number)) > 1).tobytes(), "members": members.tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            bucket, shard, *cols = (c.to_pylist() for c in batch.columns)
            for i, row in enumerate(zip(*cols, strict=True)):
                if (bucket[i], shard[i]) != now:
                    if held:
                        yield pa.RecordBatch.from_pylist([build(now[0], held)], schema=schema)
                    held, now = [], (bucket[i], shard[i])
                held.append(row)
        if held:
            yield pa.RecordBatch.from_pylist([build(now[0], held)], schema=schema)

    schema = pa.schema([(name, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[kind]) for name, kind in (x.split() for x in SHARD.split(", "))])
    dealt = contexts.repartition("bucket", "shard").sortWithinPartitions("bucket", "shard")
    return in_arrow(dealt.select("bucket", "shard", "h1", "h2", "at", "before", "count", "ctx"), run, SHARD)


def repeats(shards: DataFrame, symbols: tuple[int, int], widths: tuple[int, ...]) -> DataFrame:
    """(h1, h2, kind, start, stop): byte ranges covered by repeated strings of widths[kind] bytes, from rows of SHARD."""
    types = {"bwt": np.int32, "order": np.int32, "many": bool}

    def merge(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        part = lambda name: [np.frombuffer(r[name], f"S{SYMBOL}" if name.startswith("words") else types.get(name.split("_")[0], np.int64)) for r in rows]
        before, count, after, many = (np.concatenate(part(c)) for c in ("before", "count", "after", "many"))
        base = np.cumsum([0] + [r["n"] for r in rows])
        if len(before) == 1 and not many[0]:
            return
        sides = [merged_order(list(zip(part(f"words_{s}"), part(f"bwt_{s}"), part(f"order_{s}"), strict=True)), k) for s, k in zip("rl", symbols, strict=True)]
        members = np.concatenate([m.reshape(-1, 4) + np.array([b, 0, 0, 0]) for m, b in zip(part("members"), base, strict=False)])
        members = members[np.argsort(members[:, 0], kind="stable")]
        first, last = np.searchsorted(members[:, 0], np.arange(len(before))), np.searchsorted(members[:, 0], np.arange(len(before)), "right")
        for kind, width in enumerate(widths):
            row, start, stop = covered(*repeated_strings(*sides, before, count, after, many, width), width)
            times = (last - first)[row]
            m = members[np.repeat(first[row], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)]
            yield pa.RecordBatch.from_arrays([pa.array(m[:, 1]), pa.array(m[:, 2]), pa.array(np.full(len(m), kind)), pa.array(m[:, 3] + np.repeat(start, times)), pa.array(m[:, 3] + np.repeat(stop, times))], ["h1", "h2", "kind", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                if held and held[0]["bucket"] != row["bucket"]:
                    yield from merge(held)
                    held = []
                held.append(row)
        if held:
            yield from merge(held)

    return in_arrow(shards.repartition("bucket").sortWithinPartitions("bucket"), run, "h1 long, h2 long, kind long, start long, stop long")


def whole_words(data: bytes, start: int, stop: int) -> int:
    """Words that lie wholly in data[start:stop]."""
    found = data[start:stop].split()
    cut = start > 0 and not data[start - 1 : start].isspace() and not data[start : start + 1].isspace()
    cut += stop < len(data) and not data[stop : stop + 1].isspace() and not data[stop - 1 : stop].isspace()
    return max(0, len(found) - cut)


def remove_repeats(docs: DataFrame, *, text: str = "text", width: int = 400, passage: int = 256, words: int = 51, gram: int = 64, block: int = 4096, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages (and kept bytes, if wanted) for each row of docs. n_passages: maximal runs covered by
    strings of `passage` bytes that also start elsewhere, with at least `words` whole words in them."""
    base, copies, work = texts_once(docs, text)
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    bits = width_bits(2 * size // (passage - gram + 2))
    symbols = (-(-width // SYMBOL), max(1, -(-(passage - gram) // SYMBOL)))

    def keys_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, offsets, data, _, _ in portions(batch.column(0), passage):
            yield anchored(data, offsets, passage, gram)[4]

    planes = docs.sparkSession.sparkContext.broadcast(repeated_planes(work.select("text"), keys_of, bits))

    def marked(column: pa.Array):
        for row, offsets, data, ahead, whole in portions(column, passage):
            runs = anchored(data, offsets, passage, gram)
            hit = maybe_repeated(runs[4], planes.value, bits) if len(runs[4]) else np.empty(0, bool)
            yield row, offsets, ahead, whole, *runs, hit

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, key, hit in marked(batch.column(0)):
                key, n = np.unique(key[hit], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(n)], ["key", "n"])

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, offsets, ahead, whole, doc, place, count, anchor, key, hit in marked(batch.column(2)):
                if not hit.any():
                    continue
                # A string of width bytes has further anchors in it; all of them must be marked, up to its last start.
                alone = ahead > 0 or offsets[-1] < len(whole)  # a portion of one text
                end = np.full(len(doc), len(whole)) if alone else offsets[1:][doc]
                place, anchor = place + ahead, anchor + ahead
                open_ = np.flatnonzero(~hit | np.append(doc[1:] != doc[:-1], True))
                to = open_[np.searchsorted(open_, np.arange(len(hit)))]
                reach = np.where(hit[to], end if alone else place[to] + count[to] - 1 + passage, place[to] - 1 + passage)
                last = place + count - 1
                stop = np.where(reach >= place + width, np.minimum(np.minimum(last + width, reach), end), np.minimum(last + passage, end))
                use = np.flatnonzero(hit)
                for s in range(0, len(use), 4096):
                    part = use[s : s + 4096]
                    take = pa.array(doc[part] + row)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[part].astype(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(place[part] - offsets[doc[part]]), pa.array((anchor - place)[part].astype(np.int32)), pa.array(count[part].astype(np.int32)),
                         pa.array([whole[a:b].tobytes() for a, b in zip(place[part], stop[part], strict=True)], pa.binary())],
                        ["key", "h1", "h2", "at", "before", "count", "ctx"],
                    )

    hot = materialize(in_arrow(work.select("text"), counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).groupBy(F.when(F.col("n") > block, F.col("key")).alias("key")).agg(F.sum("n").alias("n")))
    buckets = max(1, (hot.where("key is null").agg(F.sum("n")).first()[0] or 0) // 3000)
    every = in_arrow(work.select("h1", "h2", "text"), contexts, "key long, h1 long, h2 long, at long, before int, count int, ctx binary")
    sent = join_checked(every, hot.where("key is not null"), ["key"], "left")
    shares = F.coalesce(F.ceil(F.col("n") / block), F.lit(2))
    dealt = sent.withColumn("bucket", F.when(F.col("n").isNull(), F.pmod(F.xxhash64("key"), F.lit(buckets))).otherwise(F.xxhash64("key").bitwiseOR(F.lit(-(1 << 63))))).withColumn("shard", F.pmod(F.xxhash64("h1", "h2", "at"), shares))
    found = repeats(shard_transforms(dealt, symbols), symbols, (width, passage))
    cuts = materialize(ranges_of_texts(found.select("h1", "h2", "kind", "start", "stop")).withColumnsRenamed({"first": "gone", "second": "met"}))
    joined = join_checked(join_checked(base, copies, ["h1", "h2"], "left"), cuts, ["h1", "h2"], "left")
    joined = joined.select("doc_id", "text", (F.col("rows") > 1).alias("copied"), "gone", "met")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, removed, spans, digest, passages, kept = [], [], [], [], [], []
            for t, copied, *ranges in zip(batch.column(1), *(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                data = (t.as_py() or "").encode("utf-8", "surrogatepass")
                size.append(len(data))
                gone, met = (list(zip(r[::2], r[1::2], strict=True)) if r else [] for r in ranges)
                if copied:
                    gone, met = ([(0, len(data))] if len(data) >= least else [] for least in (width, passage))
                out = b"".join(data[a:b] for a, b in zip([0, *(b for _, b in gone)], [*(a for a, _ in gone), len(data)], strict=True))
                removed.append(len(data) - len(out))
                spans.append(len(gone))
                digest.append(hashlib.sha256(out).hexdigest())
                passages.append(sum(whole_words(data, a, b) >= words for a, b in met))
                if keep_text:
                    kept.append(out)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string()), pa.array(passages, pa.int64()), *[pa.array(kept, pa.binary())] * keep_text],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", *["kept"] * keep_text],
            )

    return in_arrow(joined, cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long" + ", kept binary" * keep_text)
