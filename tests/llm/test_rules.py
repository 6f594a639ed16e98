"""The rule ledger against plain counting."""

import random
import re
from collections import Counter

from borespark.llm import rules


def plain(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(w, w[1:], w[2:]))
    again = {p for i in range(len(w) - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for p in (i, i + 1, i + 2)}
    m = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(again), "n_lines": len(lines), "n_digits": len(re.findall("[0-9]", t))}
    fails = [m["n_words"] < 50, 100 * m["n_repeat_words"] > 50 * m["n_words"], 100 * m["n_symbols"] > 10 * m["n_words"], 100 * m["n_dup_lines"] > 50 * m["n_lines"], not 2 * m["n_words"] <= m["word_chars"] <= 12 * m["n_words"], 100 * m["n_digits"] > 40 * m["word_chars"]]
    return m | {"failed": sum(1 << i for i, f in enumerate(fails) if f)}


def texts():
    rng = random.Random(4)
    prose = lambda n, of=500: " ".join(f"wört{rng.randrange(of)}" for _ in range(n))
    base = prose(60)
    return [
        None, "", " \t\n\x0b\f\r", "one", "a b c", "a b c a b c", "a a a a", "a a a", "  lead\n\ntrail \n", "x\nx\r\nx\n \nx", "é\x1cß b", base, base, prose(49), prose(50), prose(400, 8), prose(200, 3), prose(20_000), "z" * 50_000, " ".join("ab" for _ in range(120)),
        "# | $ " * 30 + prose(60), "12345 67890 " * 40, "q " * 70, "longlonglongword" * 2 + " " + prose(55), "\n".join(["same line here now"] * 30 + [prose(80)]), "p q r s p q r t p q", "\U0001f600 \U0001f600 \U0001f600 \U0001f600",
    ]


def test_ledger_policies_and_ablations(spark):
    every = texts()
    docs = spark.createDataFrame([(i if i != 13 else None, t, 1, "x") for i, t in enumerate(every)], "doc_id long, text string, failed int, kept string")
    book = rules.ledger(docs)
    rows = {r.doc_id: r.asDict() for r in book.collect()}
    assert len(rows) == len(every)
    for i, t in enumerate(every):
        want, found = plain(t), rows[i if i != 13 else None]
        assert {k: found[k] for k in want} == want, t[:60] if t else t
    seen = [plain(t)["failed"] for t in every]
    for p in rules.POLICIES:
        out = rules.decide(book, p).collect()
        assert all(r.kept == (not r.failed & p.mask()) and r.base_failed == bool(r.failed & 3) and r.policy == p.version for r in out)
    for r in rules.ablations(book).collect():
        p, bit = next(p for p in rules.POLICIES if p.version == r.policy), 1 << [x.name for x in rules.RULES].index(r.rule)
        kept = lambda mask: sum(not f & mask for f in seen)
        assert (r.n_docs, r.n_kept, r.n_failed, r.n_kept_without) == (len(seen), kept(p.mask()), sum(bool(f & bit) for f in seen), kept(p.mask() & ~bit))
    own = (rules.Rule("empty", "n_words = 0"),)
    assert sum(r.failed for r in rules.ledger(docs.select("text", "doc_id"), own).collect()) == 3
    assert rules.ledger(docs.limit(0)).collect() == [] and rules.ablations(rules.ledger(docs.limit(0))).collect() == []
    assert "Python" not in rules.measured(docs)._jdf.queryExecution().toString()
