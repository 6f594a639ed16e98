"""Pad history and names within names against all pairs."""

import math
import random
from collections import defaultdict

import pyarrow as pa

from borespark.operators import match


def test_pad_history_in_cells(spark):
    rng = random.Random(3)
    vec = lambda: [float(rng.randrange(-2, 3)) for _ in range(4)]  # noqa: E731 - many ties
    events = [(f"e{i}", rng.choice(["p", "p", "p", "q"]), rng.choice(["w1", "w2", "w3", None]), rng.uniform(0, 2000), vec(), f"text {i}") for i in range(300)]
    events += [("zero", "p", "w9", 500.0, [0.0] * 4, "z"), ("none", "p", "w9", 500.0, None, "n"), ("short", "p", "w9", 500.0, [1.0, 2.0], "s"), ("lost", None, "w9", 500.0, vec(), "l")]
    queries = [(i, rng.choice(["p", "q", "r", None]), rng.choice(["w1", "w2", None]), rng.uniform(0, 12000 if i % 9 == 0 else 2000), vec()) for i in range(120)]
    h = spark.createDataFrame(events, "event_id string, pad_id string, well_id string, depth double, embedding array<double>, raw_text string")
    q = spark.createDataFrame(queries, "query_id long, pad_id string, well_id string, depth double, embedding array<double>")

    def cosine(a, b):
        if a is None or b is None or len(a) != len(b):
            return None
        n = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / n if n else None

    for tolerance, block in ((None, 16), (None, 4096), (150, 10)):
        want = set()
        for i, pad, well, depth, v in queries:
            reach = tolerance or (300 if depth < 10000 else 1000)
            near = [(cosine(v, e[4]), e[0]) for e in events if pad is not None and e[1] == pad and abs(e[3] - depth) <= reach and e[2] != well]
            near.sort(key=lambda x: (x[0] is None, -round(x[0], 12) if x[0] is not None else 0, x[1]))
            want |= {(i, k, e, None if c is None else round(c, 3) + 0.0) for k, (c, e) in enumerate(near[:5], 1)}
        found = match.pad_history_risks(q, h, tolerance=tolerance, block=block).collect()
        scores = {(r.query_id, r["rank"]): r.similarity for r in found}
        assert len(found) == len(want) and all(abs((scores[i, k] if scores[i, k] is not None else 9) - (c if c is not None else 9)) < 0.0011 for i, k, _, c in want)
        by_id = {(i, k): e for i, k, e, _ in want}
        assert sum(by_id[r.query_id, r["rank"]] == r.event_id for r in found) > 0.97 * len(found) and all(r.raw_text for r in found)
    assert match.pad_history_risks(q.limit(0), h).collect() == [] == match.pad_history_risks(q, h.limit(0)).collect()


def test_names_within_names(spark):
    rng = random.Random(9)
    name = lambda: "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 12))).strip() or "a"
    a, b = ({("f", name()) for _ in range(150)} | {("api", str(rng.randrange(30))) for _ in range(9)} for _ in range(2))
    want = {(f, x, y) for f, x in a for g, y in b if f == g and (x == y or f != "api" and (x in y or y in x))}
    e, p = (spark.createDataFrame(sorted(s), "field string, name string") for s in (a, b))
    got = {(r.field, r.entity_name, r.project_name) for r in match.name_links(e, p).collect()}
    assert got == want and len(want) > 200


def test_parts_of_names_never_go_through_the_driver(spark):
    names = lambda w: spark.createDataFrame([("well_name", f"{w} {i:09d}") for i in range(50)] + [("well_name", "7")], "field string, name string")
    plan = match.names_within(names("supplier"), names("customer"))._jdf.queryExecution().executedPlan().toString()
    sent = plan.split("BroadcastExchange")[1:]
    assert len(sent) == 1 and "explode" not in sent[0].split("Exchange")[0]  # the names of one or two letters alone


def test_members_of_names_never_go_through_the_driver(spark):
    rows = lambda key: spark.createDataFrame([(i, f"pump {i % 9}") for i in range(60)], f"{key} long, field string")
    pairs = match.project_match(rows("file_id"), rows("project_name"))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") <= 2  # one for each direction: names of one or two letters
    assert pairs.count() == sum(i % 9 == j % 9 for i in range(60) for j in range(60))


def test_pairs_are_not_shuffled(spark):
    rows = lambda key: spark.createDataFrame([(i, f"pump {i % 9}", f"rig {i % 4}") for i in range(60)], f"{key} long, field string, operator string")
    pairs = match.project_match(rows("file_id"), rows("project_name"))
    above = pairs._jdf.queryExecution().executedPlan().toString().split("FlatMapGroupsInArrow")
    assert len(above) > 1 and "Exchange" not in above[0] and "Aggregate" not in above[0] and "Join" not in above[0]
    got = {(r.file_id, r.project_name): (r.confidence, r.matched) for r in pairs.collect()}
    both = {(i, j): [f for f, n in (("field", 9), ("operator", 4)) if i % n == j % n] for i in range(60) for j in range(60)}
    assert got == {k: (0.15 * len(v), v) for k, v in both.items() if v}


def test_pairs_in_cells(spark):
    rng = random.Random(4)
    asks = sorted({(rng.randrange(70), rng.randrange(40)) for _ in range(300)} | {(7, c) for c in range(40)})
    holds = sorted({(f"p{rng.randrange(90)}", c, 1 << c % 3) for c in (min(int(rng.expovariate(0.15)), 39) for _ in range(500))})
    want = defaultdict(int)
    for e, c in asks:
        for p, k, bit in holds:
            want[e if e else None, p if p != "p0" else None] |= bit if c == k else 0
    a = spark.createDataFrame([(e or None, c) for e, c in asks], "file_id long, class long")
    h = spark.createDataFrame([(p if p != "p0" else None, c, bit) for p, c, bit in holds], "project_name string, class long, bit int")
    for rows, links in ((2**17, 2**25), (60, 400), (9, 40)):
        got = [(r.file_id, p, r.found) for r in match.pairs_in_cells(a, h, 3, rows=rows, links=links).collect() for p in r.project_names]
        assert sorted(map(str, got)) == sorted(str((*k, v)) for k, v in want.items() if v)


def test_entities_of_few_and_many_links():
    rng = random.Random(8)
    holds = sorted({(p, rng.randrange(3), 0) for p in range(9000) for _ in range(2)} | {(p, 3 + p % 500, 0) for p in range(9000)})
    asks = [(e, c) for e in range(30) for c in ((rng.randrange(3), 3 + e) if e % 3 == 0 else (0, 1, 2, 4) if e == 1 else (5 + e, 9 + e))]
    bit = lambda c: (1, 2, 4, 1)[min(c, 3)]
    of = defaultdict(list)
    for p, c, _ in holds:
        of[c].append(p)
    want = defaultdict(int)
    for e, c in asks:
        for p in of[c]:
            want[e, p] |= bit(c)
    columns = [[e for e, _ in asks] + [None] * len(holds), [None] * len(asks) + [p for p, _, _ in holds], [c for _, c in asks] + [c for _, c, _ in holds], [0] * len(asks) + [bit(c) for _, c, _ in holds]]
    cell = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["file_id", "project_name", "class", "bit"])
    for chunk in (2**18, 50):
        got = [(e, p, f) for b in match.linked_pairs(3, chunk)(iter([cell])) for e, f, names in zip(*(x.to_pylist() for x in b.columns)) for p in names]
        assert len(got) == len(want) > 30000 and {(e, p): f for e, p, f in got} == want
