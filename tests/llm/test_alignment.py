"""Token alignment against a version by plain ends and counters."""

import hashlib
from collections import Counter
from itertools import accumulate

import pytest

from borespark.llm import alignment
from borespark.llm.queries import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "\n", "  \n ", "a", " a", "a ", "one two  three\n\nfour \n five   ", "It's we'll don't 'tis ''s x's 12345 3.14 ½ ² ª", "<|endoftext|> <s> </s> <unk> <0x41>", "▁ a ▁b", "tab\there\r\nand there", "naïve straße ÑANDÚ façade œuvre ǆ",
    "日本語のテキスト mixed with words", "emoji 👩‍👩‍👧 and \U0001f600!", "zero​width  nbsp em", "\x00 control \x1c\x85", "é ﬁ ﬂ é", "word " * 3000, "x" * 4000, "a\n b\n  c\n   d", "same text here", "same text here", "def f(x):\n    return x**2  # ok",
]


def plain(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b, letters = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B), alignment.byte_letters()
    a.encode_special_tokens = True
    rows = []
    for t in texts:
        x, y = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        p = [bytes(letters[c] for c in a.id_to_token(i)) for i in x]
        q = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if not t or b"".join(p) != (" " + t).encode() or b"".join(q) != (" " + t).encode():
            rows.append(([], [], [], []))
            continue
        ends = [[*accumulate(map(len, z))] for z in (p, q)]
        both, groups = sorted(set(ends[0]) & set(ends[1])), []
        for low, high in zip([0, *both], both):
            groups.append(",".join(str(i) for i, e in zip(x, ends[0]) if low < e <= high) + "|" + ",".join(str(i) for i, e in zip(y, ends[1]) if low < e <= high))
        at = dict(zip(ends[1], y))
        rows.append((x, y, groups, [(i, at[e]) for i, e in zip(x, ends[0]) if e in at]))
    counts = Counter(link for r in rows for link in r[3])
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    return [(len(x), len(y), len(g), len(k), sum(counts[u] == best[u[1]] for u in k), sum(counts[u] for u in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for x, y, g, k in rows]


@pytest.mark.parametrize("room", [64_000_000, 0])
def test_alignment(spark, room):
    rows = [(i if i % 7 else None, t, 1, "x") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a long, pair string")
    found = alignment.align(docs, path_a=A, path_b=B, room=room).collect()
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = sorted((i, *w) for (i, *_), w in zip(((r[0] if r[0] is not None else -1,) for r in rows), plain(TEXTS)))
    assert sorted(tuple(-1 if r[c] is None else r[c] for c in names) for r in found) == want
    assert alignment.align(docs.limit(0), path_a=A, path_b=B, room=room).collect() == []


def test_tokens_without_bytes_share_an_end():
    size = [1, 2, 0]
    ends, p, q = alignment.aligned([0, 0, 2, 1], [1, 2, 0, 0], size, size)
    assert (ends, p, q) == ([2, 4], [3, 4], [2, 4])
    links, each = alignment.linked([0, 0, 2, 1], [1, 2, 0, 0], p, q, size, size)
    assert links[:4].tolist() == [[0, 1], [0, 2], [2, 1], [2, 2]] and each.tolist() == [4, 1]
    assert alignment.linked([0, 0], [1], [2], [1], size, size)[0].tolist() == [[0, 1]]
    assert alignment.written(list("0021"), list("1200"), p, q) == ["0,0,2|1,2", "1|0,0"]


def test_chunks_align_as_whole_texts():
    known = alignment.Aligner(A, B)
    alignment_of = list(known.of(TEXTS))
    for t, (n, digest, links) in zip(TEXTS, alignment_of):
        found = known.encoded(" " + t, known.whole_a) if t else None
        if found is None:
            assert (n, digest, len(links)) == ([0, 0, 0], "", 0)
            continue
        _, p, q = alignment.aligned(*found, known.size_a, known.size_b)
        assert digest == hashlib.sha256(";".join(known.groups_of(*found, p, q)).encode()).hexdigest() and n[:2] == [len(x) for x in found]
