"""Hard negatives against all pairs, and the tree's boxes."""

import math
from collections import defaultdict

import numpy as np

from borespark.llm import rtree


def brute(rows, every, positives, negatives):
    fine = {(i, lab, tuple(math.floor(x * 256) for x in v)) for i, lab, v in rows if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for a, lab, x in (r for r in fine if r[0] % every == 0):
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, other) for i, other, y in fine if i != a and len(y) == len(x))
        for s, p, _ in [t for t in scored if t[2] == lab][:positives]:
            window = [(-t, i) for t, i, other in scored if other != lab and 30 * -s <= 100 * -t <= 90 * -s]
            out |= {(a, p, k, i, -s, t) for k, (t, i) in enumerate(window[:negatives], 1)}
    return out


def rows():
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, 8))
    out = [(i, int(i % 4), [float(x) for x in centre[i % 6] + rng.normal(scale=0.2, size=8)]) for i in range(400)]
    out += [(400 + i, i % 4, [0.5, -0.25, 0.0, 1.0, 0.5, 0.5, -1.0, 0.125]) for i in range(150)]  # copies, ties
    out += [(600, 1, [0.0] * 8), (610, 1, None), (620, None, out[0][2]), (None, 1, out[0][2]), (630, 1, [1.0, None] * 4), (640, 2, [float("nan")] * 8), (650, 2, [float("inf")] + [0.0] * 7), (660, 1, []), (670, 1, [1.0, 2.0]), (680, 2, [0.5, 1.0]), (690, 1, [1.0, 1.5])]
    out += [out[0], out[0], (10, 2, out[40][2]), (700, 9, out[7][2])]  # a row given twice, an id with two vectors, a label of its own
    return out


def test_hard_negatives(spark):
    data = rows()
    table = spark.createDataFrame([(i, lab, v, 1, "x") for i, lab, v in data], "vec_id long, label int, embedding array<double>, size int, h1 string")
    for options in ({"leaf": 4, "tile_rows": 16, "room": 3000}, {}):
        found = rtree.hard_negatives(table, every=10, **options).collect()
        got = [(r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in found]
        assert len(got) == len(set(got)) and set(got) == brute(data, 10, 5, 10)
    assert rtree.hard_negatives(table.limit(0)).collect() == []


def test_boxes_bound_products_and_prune():
    rng = np.random.default_rng(8)
    x = rng.integers(-300, 300, (700, 6))
    centre = rng.integers(-300, 300, (20, 6))
    x[200:] = (centre[:, None] + rng.integers(-3, 4, (20, 25, 6))).reshape(-1, 6)
    leaves = rtree.packed(x, 16)
    assert sorted(np.concatenate(leaves).tolist()) == list(range(700)) and max(map(len, leaves)) <= 16
    tree = rtree.Tree([{"label": i % 3, "size": 6, "low": x[k].min(0).tobytes(), "high": x[k].max(0).tobytes(), "vectors": x[k].tobytes(), "counts": np.ones(len(k), np.int32).tobytes(), "ids": k.astype(np.int64).tobytes()} for i, k in enumerate(leaves)])
    q = x[[3, 300]]
    lower, upper = tree.bounds(q)
    for node in range(tree.leaves):
        s = q @ tree.vectors[node].T
        assert (lower[:, node] <= s.min(1)).all() and (s.max(1) <= upper[:, node]).all()
    assert upper[:, tree.root].tolist() >= (q @ x.T).max(1).tolist()
    asked, visited = defaultdict(int), rtree.products

    def counting(a, b):
        asked["blocks"] += 1
        return visited(a, b)

    rtree.products = counting
    try:
        w = rtree.Best(5, -(2**63), 2**63 - 1)
        rtree.search(tree, q[1:], -1, 99, False, lower[1], upper[1], [w])
    finally:
        rtree.products = visited
    want = sorted(((-int(s), i) for i, s in enumerate(x @ q[1])))[:5]
    assert [(-int(s), int(i)) for s, i in zip(w.scores, w.ids)] == want and asked["blocks"] < tree.leaves // 2
