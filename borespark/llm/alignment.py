"""Token alignment of texts under two tokenizers, and how often token ids are linked in the whole corpus.

Tokenizer A is byte-level, tokenizer B of pieces; both encode a blank and the text. A token's bytes give its end. `aligned` puts the cumulative
ends of each side in a dictionary from end to the index behind it; the keys that both have, sorted, cut both id lists into slices,
the groups. In a slice, the A tokens and the B tokens that end where it ends are linked, each with each (one with one, unless tokens have no bytes).

Between chunks (white space and the word behind it) both tokenizers cut anyway: neither has a token that goes over such a border. So
texts of plain letters, digits and signs are aligned chunk by chunk, each distinct chunk once for a worker; texts with other characters
are encoded and aligned as a whole, by the tokenizers themselves.

1. Each text's groups, digest and links are written once.
2. Links are counted by id pair in each task, then over the corpus; for each B id the highest count is kept.
3. The written links are read again and meet their counts: pairs counted twice or more are sent to the tasks if they fit in `room` bytes (all others
   count one); beyond that, the distinct pairs of each distinct text are shuffled to their counts.

Null or empty texts, and those whose tokens' bytes aren't the blank and the text, have no tokens: zeros, and '' as digest. Special tokens'
strings are plain text. Null ids, repeated rows and equal texts are rows like others, and each counts. An empty table gives an empty one. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import accumulate, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, in_arrow, materialize

MEMO = 300_000
FLUSH = 2_000_000
BLANK = "▁"
#: Characters on whose kind all Unicode versions agree; white space among them is the blank and the line end.
PLAIN = re.compile(r"[\n\x20-\x7e¡-ɏ‐-‧‰-⁞€]*")
CHUNK = re.compile(r"[\n ]*[^\n ]+|[\n ]+")


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves, the others for letters from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def ends_of(ids: list[int], size: list[int]) -> dict[int, int]:
    """Cumulative end -> the index behind it; of tokens without bytes, the last."""
    return dict(zip(accumulate(map(size.__getitem__, ids)), count(1), strict=False))


def aligned(a: list[int], b: list[int], size_a: list[int], size_b: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(ends, p, q): the common ends of two id lists over the same bytes, and the indexes behind each end in a and in b. size: bytes of each id's token."""
    at_a, at_b = ends_of(a, size_a), ends_of(b, size_b)
    ends = sorted(at_a.keys() & at_b.keys())
    return ends, list(map(at_a.__getitem__, ends)), list(map(at_b.__getitem__, ends))


def written(a: list[str], b: list[str], p: list[int], q: list[int]) -> list[str]:
    """The groups of an alignment: a's ids and b's ids, as text, between two common ends."""
    return [a[i] + "|" + b[k] if j - i == 1 == m - k else ",".join(a[i:j]) + "|" + ",".join(b[k:m]) for i, j, k, m in zip([0, *p], p, [0, *q], q, strict=False)]


def last_of(ids: list[int], start: int, stop: int, size: list[int]) -> list[int]:
    """The tokens of a slice that end where it ends: its last with bytes, and those without bytes behind it."""
    k = stop - 1
    while k > start and not size[ids[k]]:
        k -= 1
    return ids[k:stop]


def linked(a: list[int], b: list[int], p: list[int], q: list[int], size_a: list[int], size_b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(links (n, 2), how many each slice has)."""
    if all(map(size_a.__getitem__, a)) and all(map(size_b.__getitem__, b)):  # one with one
        both = [np.array(x, np.int64)[np.array(at, np.int64) - 1] for x, at in ((a, p), (b, q))]
        return np.stack(both, 1), np.ones(len(p), np.int64)
    found = [[(x, y) for x in last_of(a, i, j, size_a) for y in last_of(b, k, m, size_b)] for i, j, k, m in zip([0, *p], p, [0, *q], q, strict=False)]
    return np.array([x for some in found for x in some], np.int64).reshape(-1, 2), np.array(list(map(len, found)), np.int64)


#: Fixed value: how byte-level vocabularies of this kind split a text before they merge.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Aligner:
    """What a worker knows: both tokenizers, and for each chunk met its groups, numbers of tokens and links."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        of = {i: t for t, i in self.a.get_vocab().items()}
        self.bytes_a = [bytes(letters[c] for c in of[i]) if i in of and all(c in letters for c in of[i]) else b"" for i in range(max(of) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = list(map(len, self.bytes_a)), list(map(len, self.bytes_b))
        self.text_of = list(map(str, range(max(len(self.bytes_a), len(self.bytes_b)))))
        self.plain_a = self.merger() or self.whole_a
        self.reset()

    def whole_a(self, text: str) -> list[int]:
        return self.a.encode(text, add_special_tokens=False).ids

    def merger(self) -> Callable[[str], list[int]] | None:
        """A faster encoder of plain text from the same vocabulary, if that is of the kind whose ids are the order of its merges."""
        import tiktoken

        model = json.loads(self.a.to_str())
        kind, merges = model["pre_tokenizer"] or {}, [m if isinstance(m, list) else m.split(" ") for m in model["model"].get("merges", [])]
        vocab, ordinary = model["model"]["vocab"], 256 + len(merges)
        if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex") or model["normalizer"] or any(vocab.get(x + y) != 256 + i for i, (x, y) in enumerate(merges)) or not all(self.bytes_a[:ordinary]):
            return None
        return tiktoken.Encoding("plain", pat_str=SPLIT, mergeable_ranks={self.bytes_a[i]: i for i in range(ordinary)}, special_tokens={}).encode_ordinary

    def groups_of(self, a: list[int], b: list[int], p: list[int], q: list[int]) -> list[str]:
        text = self.text_of.__getitem__
        return written(list(map(text, a)), list(map(text, b)), p, q)

    def reset(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.counts, self.begins, self.links = array("q"), array("q", [0]), array("q")

    def encoded(self, whole: str, encode_a: Callable[[str], list[int]]) -> tuple[list[int], list[int]] | None:
        """The ids of a blank or line end and what follows it; None if a side's tokens don't spell it. B itself writes a blank ahead of what it encodes."""
        a = encode_a(whole)
        b = [self.b.piece_to_id(BLANK)] if whole == " " else self.b.encode(whole[1:]) if whole[0] == " " else self.b.encode(whole)[1:]
        data = whole.encode("utf-8", "surrogatepass")
        return (a, b) if b"".join([self.bytes_a[x] for x in a]) == data and b"".join([self.bytes_b[x] for x in b]) == data else None

    def learn(self, chunks: list[str]) -> None:
        """Chunks one behind the other are encoded as one text, whose common ends tell them apart."""
        found = self.encoded("".join(chunks), self.plain_a)
        if found is None:
            raise ValueError(f"plain chunks that the tokenizers do not spell: {chunks[:5]!r}")
        a, b = found
        ends, p, q = aligned(a, b, self.size_a, self.size_b)
        stops = np.cumsum([len(c.encode()) for c in chunks])
        n = np.searchsorted(ends, stops, "right")
        if (np.array(ends)[n - 1] != stops).any():
            raise ValueError("a token goes over the border of a chunk")
        groups, (links, each) = self.groups_of(a, b, p, q), linked(a, b, p, q, self.size_a, self.size_b)
        self.number.update(zip(chunks, range(len(self.groups), len(self.groups) + len(chunks)), strict=True))
        cut = n.tolist()
        self.groups += [";".join(groups[i:j]) for i, j in zip([0, *cut], cut, strict=False)]
        counts = np.stack([np.array(p)[n - 1], np.array(q)[n - 1], n], 1)
        self.counts.frombytes(np.diff(counts, axis=0, prepend=0).astype(np.int64).tobytes())
        self.begins.frombytes((self.begins[-1] + np.cumsum(each)[n - 1]).astype(np.int64).tobytes())
        self.links.frombytes(links.tobytes())

    def of(self, texts: list[str | None]) -> Iterator[tuple[list[int], str, np.ndarray]]:
        """([A tokens, B tokens, groups], digest, links (n, 2)) of each text."""
        if len(self.groups) > MEMO:
            self.reset()
        parts = [CHUNK.findall(" " + t) if t and PLAIN.fullmatch(t) else None for t in texts]
        new = list(dict.fromkeys(c for p in parts if p for c in p if c not in self.number))
        words = [c for c in new if c.strip(" \n")]
        for s in range(0, len(words), 1000):
            self.learn(words[s : s + 1000])
        for c in new:
            if not c.strip(" \n"):  # white space at a text's end
                self.learn([c])
        counts, begins, links = (np.frombuffer(x, np.int64) if len(x) else np.empty(0, np.int64) for x in (self.counts, self.begins, self.links))
        counts, links = counts.reshape(-1, 3), links.reshape(-1, 2)
        for t, chunks in zip(texts, parts, strict=True):
            if chunks:
                at = list(map(self.number.__getitem__, chunks))
                text, at = ";".join(map(self.groups.__getitem__, at)), np.array(at, np.int64)
                size = begins[at + 1] - begins[at]
                stop = np.cumsum(size)
                yield counts[at].sum(0).tolist(), hashlib.sha256(text.encode()).hexdigest(), links[np.repeat(begins[at] - stop + size, size) + np.arange(stop[-1])]
            elif t and (found := self.encoded(" " + t, self.whole_a)):
                a, b = found
                ends, p, q = aligned(a, b, self.size_a, self.size_b)
                yield [len(a), len(b), len(ends)], hashlib.sha256(";".join(self.groups_of(a, b, p, q)).encode()).hexdigest(), linked(a, b, p, q, self.size_a, self.size_b)[0]
            else:
                yield [0, 0, 0], "", np.empty((0, 2), np.int64)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}
KEPT.append(_ALIGNERS.clear)


def aligner_of(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def alignments(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256, a, b for each row; a, b: the linked ids as 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner_of(path_a, path_b)
        for batch in batches:
            s = 0
            while s < len(batch):  # about a million characters at a time, one text at least
                n, size, texts = s, 0, []
                while n < len(batch) and (n == s or size < 1_000_000):
                    texts.append(batch.column(1)[n].as_py())
                    size += len(texts[-1] or "")
                    n += 1
                numbers, digests, links = zip(*known.of(texts), strict=True)
                columns = [pa.array(c, pa.int64()) for c in zip(*numbers, strict=True)]
                sides = [pa.array([x[:, k].astype("<u4").tobytes() for x in links], pa.binary()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, n - s), *columns, pa.array(digests, pa.string()), *sides], ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "a", "b"])
                s = n

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, a binary, b binary")


def pairs_of(a: bytes, b: bytes) -> np.ndarray:
    """Each link as one number: A's id above B's."""
    return (np.frombuffer(a, "<u4").astype(np.int64) << 32) | np.frombuffer(b, "<u4")


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n): how many links of all rows (a, b) hold each id pair; a task sends each of its pairs about once for FLUSH links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def emit() -> pa.RecordBatch:
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append(pairs_of(a, b))
                size += len(held[-1])
                if size >= FLUSH:
                    yield emit()
                    held, size = [], 0
        if held:
            yield emit()

    return in_arrow(links.select("a", "b"), run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def with_counts(rows: DataFrame, counts: DataFrame, best: DataFrame) -> DataFrame:
    """rows with n_links, n_best and count_sum, from counts that the tasks hold. best: the highest count of each B id, bounded by the vocabulary."""
    many = counts.where("n > 1").toArrow()  # all other pairs count one
    pair = many.column("pair").to_numpy()
    order = np.argsort(pair)
    top = best.toArrow()
    highest = np.zeros(int(max(top.column("b").to_pylist(), default=0)) + 1, np.int64)
    highest[top.column("b").to_numpy()] = top.column("n").to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast((pair[order], many.column("n").to_numpy()[order], highest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, highest = shared.value
        for batch in batches:
            out = []
            for a, b in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True):
                link, found = pairs_of(a, b), np.ones(len(a) // 4, np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, link), len(known) - 1)
                    found = np.where(known[at] == link, n[at], 1)
                out.append((len(link), int((found == highest[np.frombuffer(b, "<u4")]).sum()), int(found.sum())))
            columns = zip(*out, strict=True) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *[pa.array(c, pa.int64()) for c in columns]], [*batch.schema.names[:5], "n_links", "n_best", "count_sum"])

    return in_arrow(rows, run, "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, n_best long, count_sum long")


def joined_counts(rows: DataFrame, counts: DataFrame, best: DataFrame) -> DataFrame:
    """The same where the counts are too many to send: distinct pairs of distinct texts meet them in a join (a digest stands for its groups, and so its links)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pair, n = np.unique(pairs_of(a, b), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([digest] * len(pair), pa.string()), pa.array(pair), pa.array(n)], ["groups_sha256", "pair", "times"])

    once = rows.groupBy("groups_sha256").agg(F.first("a").alias("a"), F.first("b").alias("b"))
    held = in_arrow(once, run, "groups_sha256 string, pair long, times long").join(counts, "pair")
    held = held.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))).join(F.broadcast(best.withColumnRenamed("n", "most")), "b")
    sums = held.groupBy("groups_sha256").agg(F.sum("times").alias("n_links"), F.sum(F.when(F.col("n") == F.col("most"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_links", "n_best", "count_sum")]
    return rows.drop("a", "b").join(sums, "groups_sha256", "left").select("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", *zero)


def align(docs: DataFrame, *, path_a: str, path_b: str, text: str = "text", room: int = 64_000_000) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of docs. n_best: links whose pair has its B id's highest
    count in the corpus; count_sum: of all links' pairs."""
    rows = materialize(alignments(docs, path_a, path_b, text))
    counts = materialize(pair_counts(rows))
    best = materialize(counts.groupBy(F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b")).agg(F.max("n").alias("n")))
    small = counts.where("n > 1").count() * 16 <= room
    out = with_counts(rows, counts, best) if small else joined_counts(rows, counts, best)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
