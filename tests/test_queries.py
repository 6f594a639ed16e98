"""Registered drilling queries against their SQL twins on the smallest tables."""

import datetime
import glob
import os

import duckdb
import pytest

from borespark.plans import registry, report_queries, rule_queries, run_queries, source_queries, table_queries

SF = "/root/testdata/sf0.001"
OWN = {f.__module__: [] for f in registry.QUERIES.values()}
for name, f in registry.QUERIES.items():
    OWN[f.__module__].append(name)


@pytest.fixture(scope="module")
def twin():
    with duckdb.connect() as c:
        for f in glob.glob(f"{SF}/*.parquet"):
            c.execute(f"create view {os.path.basename(f).removesuffix('.parquet')} as select * from read_parquet('{f}')")
        yield c


def plain(v):
    """Numbers to six figures; whatever else as text."""
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return ("number", f"{float(v) + 0.0:.6g}")
    return ("none", "") if v is None else ("text", str(v.isoformat() if isinstance(v, datetime.date) else v))


@pytest.mark.parametrize("name", [*OWN[rule_queries.__name__], *OWN[source_queries.__name__], *OWN[table_queries.__name__], *OWN[run_queries.__name__], *OWN[report_queries.__name__], "project_match", "upsert_history", "pad_history_risks", "routing_summary", "drop_finished", "curve_stats"])
def test_query_equals_its_twin(spark, twin, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    rows = twin.execute(registry.ORACLES[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == columns and found
    assert found == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in rows.fetchall())


def test_every_query_has_a_twin():
    assert set(registry.ORACLES) == set(registry.QUERIES)


def test_exact_quantiles_with_ties_and_few_values(spark):
    from borespark.operators import logs

    rows = [("a", float(v)) for v in [1, 1, 1, 2, 9]] + [("b", 4.0)] + [("c", float(v % 7)) for v in range(1000)] + [("d", None), (None, 1.0)]
    got = {r.mnemonic: (r.n, r.p10, r.p50, r.p90) for r in logs.curve_stats(spark.createDataFrame(rows, "mnemonic string, value double"), ("mnemonic",)).collect()}
    assert got == {"a": (5, 1.0, 1.0, 6.2), "b": (1, 4.0, 4.0, 4.0), "c": (1000, 0.0, 3.0, 6.0)}
