"""Wells that are cut into pieces give what whole wells give."""

import random

from pyspark.sql import functions as F

from borespark.operators import hse, logs, pieces, survey


def same(a, b):
    key = lambda r: tuple((v is None, round(v, 6) if isinstance(v, float) else v) for v in r)
    return sorted(map(key, map(tuple, a.collect()))) == sorted(map(key, map(tuple, b.collect())))


def test_pieces_are_even_and_in_order(spark):
    rng = random.Random(1)
    rows = [("a", rng.expovariate(1) ** 3) for _ in range(4000)] + [("b", float(i)) for i in range(300)] + [("c", 1.0)] * 700 + [(None, float(i)) for i in range(600)] + [("a", None)]
    parts, hot = pieces.cut(spark.createDataFrame(rows, "k string, v double"), ("k",), "v", 500)
    got = [(r.k, r.v, r[pieces.PIECE]) for r in parts.collect()]
    assert hot and len(got) == len(rows)
    a = sorted((v if v is not None else -1.0, p) for k, v, p in got if k == "a")
    assert [p for _, p in a] == sorted(p for _, p in a) and len({p for _, p in a}) > 1
    assert {p for k, _, p in got if k == "b"} == {0} and len({p for k, v, p in got if k == "c"}) == 1 and len({p for k, _, p in got if k is None}) > 1
    even, _ = pieces.cut(spark.range(4000).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("v")), ("k",), "v", 500)
    sizes = [r["count"] for r in even.groupBy(pieces.PIECE).count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 520


def test_trajectories_intervals_quantiles_and_shares(spark):
    rng = random.Random(5)
    rows = [("hot", float(i), rng.random() * 90, rng.random() * 360, rng.choice([60.0, 80.0]) if i % 9 else 60.0, rng.choice([5.0, 20.0, 20.0, 20.0])) for i in range(1600)]
    rows += [(w, float(i), rng.random() * 90, rng.random() * 360, 60.0, 20.0 if i % 5 else 1.0) for w in ("x", "y") for i in range(40)]
    df = spark.createDataFrame(rows, "well_id string, md double, inc_deg double, az_deg double, gr double, rt double").repartition(5).withColumn("depth", F.col("md"))
    assert same(survey.minimum_curvature(df, rows=200), survey.minimum_curvature(df))
    for step in (False, True):
        a, b = (logs.pay_intervals(df.select("well_id", "depth", "gr", "rt"), include_step=step, rows=n) for n in (200, pieces.ROWS))
        assert same(a, b) and b.count() > 50
    long = df.select("well_id", F.lit("GR").alias("mnemonic"), F.round("inc_deg", 1).alias("value"))
    assert same(logs.curve_stats(long, rows=200), logs.curve_stats(long))
    causes = df.select("well_id", F.concat(F.lit("cause "), (F.col("md") % 900).cast("int").cast("string")).alias("description"), F.round("rt", 0).alias("duration_hrs"))
    assert same(hse.npt_pareto(causes, top=None, rows=100), hse.npt_pareto(causes, top=None))
