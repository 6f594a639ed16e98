"""The five stages of corpus_pipeline, each on its own input, against plain Python; then run() as a whole."""

import os
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from borespark.llm import secrets, toxicity
from borespark.llm.queries import tokenizer_path

corpus_pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents with a column named score, nulls, copies, near copies, secrets and toxic texts; labels of four fifths."""
    rng, at = random.Random(12), tmp_path_factory.mktemp("tables")
    prose = lambda n: " ".join(rng.choice("abcdefgh") * 2 + rng.choice("xyzuvw") + str(rng.randrange(90)) for _ in range(n))
    texts = [None, "", "one two"]
    for i in range(150):
        t = prose(60)
        texts += [t + " scum vermin", t] if i % 5 == 0 else [t]
        if i % 7 == 0:
            texts += [t, t + " tail"]
        if i % 11 == 0:
            texts.append(f"{prose(8)} password=hunter2abc token: abcdefgh12 {prose(5)}")
    rows = [(i, t, ["en", "de", "fr", None][i % 4], f"src{i % 3}" if i % 9 else None, None if t is None else len(t), 0.5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, COLUMNS)
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int("vermin" in (t or ""))) for i, t in enumerate(texts) if i % 10 < 8], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_toxic_documents_go(spark, docs, folder):
    out = stage("toxicity")(spark, docs, folder)
    assert out.columns == docs.columns
    scores = {r.doc_id: r.score for r in toxicity.toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    kept = {r.doc_id for r in out.collect()}
    assert kept == {i for i, s in scores.items() if s < 0.5}
    toxic = {r.doc_id for r in docs.collect() if "vermin" in (r.text or "")}
    assert len(kept & toxic) <= 0.1 * len(toxic) and len(kept) >= 0.9 * (len(scores) - len(toxic))


def test_one_document_of_each_group_stays(spark, docs, folder):
    rows = docs.collect()
    sets = {}
    for r in rows:
        w = words((r.text or "").lower())
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    out = stage("minhash_near_dedup")(spark, docs, folder)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {i for i in sets if find(i) == i}


def test_secrets_are_masked(spark, docs, folder):
    want = {}
    for r in docs.collect():
        spans = sorted(m.span() for rule in secrets.RULES for m in re.finditer(rule.pattern, r.text or "") if len(m[rule.group]) >= rule.least)
        text, end, out = r.text, 0, []
        for a, b in spans:
            if a >= end:
                out += [text[end:a], "[SECRET]"]
            end = max(end, b)
        want[r.doc_id] = text if not spans else "".join([*out, text[end:]])
    out = {r.doc_id: r for r in stage("secret_scans")(spark, docs, folder).collect()}
    assert {i: r.text for i, r in out.items()} == want and sum("[SECRET]" in (t or "") for t in want.values()) == 14
    assert all(r.n_chars == (None if want[i] is None else len(want[i])) and r.score == 0.5 for i, r in out.items())


def test_sources_keep_to_their_budgets(spark, docs, folder):
    out = stage("mixing")(spark, docs, folder)
    source = {r.doc_id: r for r in docs.collect()}
    rows, taken = out.collect(), Counter()
    assert out.columns == docs.columns and max(Counter(r.doc_id for r in rows).values()) == 1
    for r in rows:
        own = words(source[r.doc_id].text)
        assert words(r.text) == own[: len(words(r.text))]
        taken[r.source or "", r.lang or ""] += len(words(r.text))
    held = Counter()
    for r in source.values():
        held[r.source or "", r.lang or ""] += len(words(r.text))
    total = sum(held.values())
    assert int(0.9 * total) - len(held) <= sum(taken.values()) <= int(0.9 * total) and all(taken[k] <= held[k] for k in taken)
    cut = Counter((r.source, r.lang) for r in rows if len(words(r.text)) < len(words(source[r.doc_id].text)))
    assert max(cut.values(), default=0) <= 1  # a leaf ends in one document


def test_windows_hold_every_token_once(spark, docs, folder):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    ids = {r.doc_id: [*t.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    check(stage("packing")(spark, docs, folder).collect(), ids)


def check(pieces, ids):
    at, windows = defaultdict(list), Counter()
    for p in pieces:
        assert zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
        at[p.doc_id].append((p.start, p.length))
        windows[p.sequence_id] += p.length
    for i, runs in at.items():
        end = 0
        for a, n in sorted(runs):
            assert a == end
            end += n
        assert end == len(ids[i])
    assert set(at) == set(ids) and sorted(windows.values())[1:] == [2048] * (len(windows) - 1)


def test_run_is_the_stages_in_order(spark, docs, folder):
    from tokenizers import Tokenizer

    out = docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        path = os.path.join(folder, f.__name__)
        f(spark, out, folder).write.parquet(path)
        out = spark.read.parquet(path)
    t = Tokenizer.from_file(tokenizer_path())
    ids = {r.doc_id: [*t.encode(r.text or "", add_special_tokens=False).ids, 1] for r in out.collect()}
    check(corpus_pipeline.run(spark, folder).collect(), ids)


def test_empty_tables(spark, docs, folder):
    out = docs.limit(0)
    for _, f in corpus_pipeline.STAGES:
        out = f(spark, out, folder)
        assert out.collect() == []
        out = out if out.columns == docs.columns else docs.limit(0)
