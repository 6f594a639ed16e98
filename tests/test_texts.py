"""Text queries on rows that the given tables lack."""

import random

import duckdb
from pyspark.sql import functions as F

from borespark.functions import text as T
from borespark.plans import dims, pipelines, registry, rule_queries, table_queries  # noqa: F401 - the last adds to the registry


def equals_twin(spark, name, folder, table):
    df = registry.QUERIES[name](spark, str(folder))
    with duckdb.connect() as c:
        c.execute(f"create view {table} as from read_parquet('{folder}/{table}.parquet/*.parquet')")
        want = c.execute(f"select {', '.join(df.columns)} from ({registry.ORACLES[name]})").fetchall()
    found = sorted(map(tuple, df.collect()), key=str)
    assert found == sorted(want, key=str)
    return found


def test_entities_tell_case_apart_as_the_twin_does(spark, tmp_path):
    texts = ["mail Anna.12@Host.example.com", "to Anna.12@host.example.com, 10.0.0.1", "aNNa.12@host.example.com", "ſam.1@h.example.com", "x.1@h.EXAMPLE.com", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = equals_twin(spark, "extract_entities", tmp_path, "documents")
    assert (1, "10.0.0.1", "nna.12@host.example.com") in found and found[0] == (0, None, None)


def test_context_of_well_numbers_beyond_five_digits(spark, tmp_path):
    keys = [0, 1, 89_998, 90_000, 90_001, 899_998, 5_399_998]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    found = {r[0]: r[1] for r in equals_twin(spark, "entity_context", tmp_path, "customer")}
    assert found[90_000] == "42-100-100000-0000" and found[90_001] is None


def test_reports_are_dealt_out_from_one_file(spark, tmp_path):
    spark.range(9_000).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    sizes = rule_queries.report_texts(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 9_000 and max(r["count"] for r in sizes) < 3_000


def test_patterns_find_the_same_from_their_first_letters(spark):
    rng = random.Random(4)
    bits = ["WELL", "well name", "ſtage", "Kount", "№ скв", "СКВАЖИНА", "rıg", "RİG", "Total ſtages", "mud weight", "Плотность раствора", "MD", "tvd", "API", "UWI", ":", " = ", "\n", "12,5", "9 000", " ft", " м", "42-123-12345", " ppg", " г/см3", "hrs", "NPT", "x", ","]
    docs = spark.createDataFrame([(i, "".join(rng.choice(bits) + rng.choice(["", " ", ": "]) for _ in range(40))) for i in range(300)], "file_id long, text string").cache()
    patterns = [p for _, p in dims.ENTITIES.values()] + ["(?:a|b)?x", "(?:s?x|m)d", "(x)"]
    assert sum(T.only_from(p) != p for p in patterns) == len(dims.ENTITIES)
    for p in patterns:
        whole, led = (F.regexp_extract("text", T.FOLD + q, 0) for q in (p, T.only_from(p)))
        assert docs.where(whole != led).count() == 0
    assert docs.where(F.regexp_extract("text", T.FOLD + dims.ENTITIES["stage_count"][1], 1) != "").count() > 0


def test_only_texts_with_incident_words_are_cut_into_lines(spark):
    texts = ["Routine day\nno news", "first\r\nLTI at the rig floor, 3.5 hrs\nNear Miss\n", "Инцидент: ТРАВМА", "İ near miss", "near\nmiss", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "file_id long, text string")
    cut = []
    lines = T.lines
    try:
        T.lines = lambda d, *a: cut.append({r.file_id for r in d.collect() if r.text is not None}) or lines(d, *a)
        found = {(r.file_id, r.source_line) for r in T.extract_hse_events(docs).collect()}
    finally:
        T.lines = lines
    every = lines(docs, keep=("file_id",)).where(T.contains_any(F.lower("line"), dims.INCIDENTS))
    assert found == {(r.file_id, r.line_no) for r in every.collect()} and {(1, 3), (2, 1), (3, 1)} <= found
    assert cut == [{k for k, _ in found}]


def test_drilling_values_stay_columns(spark):
    rows = [(1, "a", "Well name: W-1, \nRPM: 90 rpm\n"), (2, "a", "RPM: 95 rpm\nNPT: 2.5 hrs\n"), (3, "a", "nothing"), (1, "b", "no value"), (2, "b", None), (1, "c", "lost 4 hours of flat time"), (1, "d", "Operator: ,,,\n"), (1, "e", "СТАНОК: Уралмаш\n"), (1, "f", "Mud weight: 1.2.3 sg\n")]
    kpis, _ = pipelines.analyze_drilling(spark.createDataFrame(rows, "file_id long, well_id string, text string"))
    found = {r.well_id: r for r in kpis.collect()}
    assert set(found) == {"a", "c", "e", "f"}  # no row without a value or lost time
    assert (found["a"].well_name, found["a"].rpm, found["a"].npt_hours, found["a"].operator) == ("W-1", 95.0, 2.5, None)
    assert (found["c"].npt_hours, found["c"].rpm, found["e"].rig_name, found["f"].mud_weight_sg) == (4.0, None, "Уралмаш", None)
    plan = kpis.select("well_id", "well_name")._jdf.queryExecution().optimizedPlan().toString()
    assert "AS well_name" in plan and "AS rpm" not in plan


def test_files_are_checked_where_they_are_dealt_to(spark, tmp_path):
    spark.range(4_100).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    found = equals_twin(spark, "process_files", tmp_path, "customer")
    assert len(found) == 4_100 and sum(r[3] is not None for r in found) == 3_280
    plan = registry.QUERIES["process_files"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("REPARTITION_BY_NUM") == 2
    assert all("Filter" not in below.split("FileScan")[0] for below in plan.split("REPARTITION_BY_NUM")[1:])
