"""Commits of history, streams into it, and runs that are stopped and go on."""

import os
import signal
import subprocess
import sys
import textwrap
import threading
import time

import pytest
from pyspark.sql import functions as F

from borespark.plans import runs
from borespark.sources import sinks, versions
from borespark.streaming import ingest

ROWS = "task_id string, well_name string, created_at int"


def held(spark, path):
    rows, number = sinks.latest(spark, path)
    return {r.task_id: r.well_name for r in rows.collect()}, number


def test_upsert_delete_and_schema(spark, tmp_path):
    h = str(tmp_path / "h")
    assert sinks.latest(spark, h) == (None, 0) and sinks.delete_history(spark, h, spark.createDataFrame([("x", "", 1)], ROWS)) == 0
    assert sinks.upsert_history(spark, h, spark.createDataFrame([("t1", "a", 1), ("t2", "b", 1), ("t2", "newer", 2), (None, "none", 1)], ROWS)) == 1
    assert held(spark, h) == ({"t1": "a", "t2": "newer", None: "none"}, 1)
    sinks.upsert_history(spark, h, spark.createDataFrame([("t2", "c", 0, 7)], ROWS + ", extra int"))
    assert {(r.task_id, r.extra) for r in sinks.latest(spark, h)[0].collect()} == {("t1", None), ("t2", 7), (None, None)}
    sinks.delete_history(spark, h, spark.createDataFrame([("t1",), ("t9",)], "task_id string"))
    assert held(spark, h) == ({"t2": "c", None: "none"}, 3)
    assert {r.task_id for r in versions.read(spark, h, 1)[0].collect()} == {"t1", "t2", None}
    sinks.delete_history(spark, h, spark.createDataFrame([("t2",)], "task_id string"))
    assert held(spark, h) == ({None: "none"}, 4)


def test_only_touched_buckets_are_written(spark, tmp_path):
    h = str(tmp_path / "h")
    sinks.upsert_history(spark, h, spark.range(5000).select(F.col("id").cast("string").alias("task_id"), F.lit("a").alias("well_name"), F.lit(1).alias("created_at")))
    one = versions.version_of(versions.Store(spark, h))
    sinks.upsert_history(spark, h, spark.createDataFrame([("7", "b", 2)], ROWS))
    two = versions.version_of(versions.Store(spark, h))
    assert len(one.folders) == 64 and sum(one.folders[b] != two.folders[b] for b in one.folders) == 1
    assert sinks.latest(spark, h)[0].where("well_name = 'b'").count() == 1 and sinks.latest(spark, h)[0].count() == 5000


def test_a_failed_write_leaves_the_table_as_it_was(spark, tmp_path):
    h = str(tmp_path / "h")
    sinks.upsert_history(spark, h, spark.createDataFrame([("t1", "a", 1)], ROWS))
    bad = spark.range(100).select(F.col("id").cast("string").alias("task_id"), F.when(F.col("id") == 99, F.raise_error(F.lit("broken row"))).otherwise(F.lit("x")).alias("well_name"), F.lit(1).alias("created_at"))
    with pytest.raises(Exception, match="broken row"):
        sinks.upsert_history(spark, h, bad)
    assert held(spark, h) == ({"t1": "a"}, 1)
    sinks.upsert_history(spark, h, spark.createDataFrame([("t2", "b", 1)], ROWS))
    assert held(spark, h) == ({"t1": "a", "t2": "b"}, 2)


def test_a_killed_writer_leaves_the_table_as_it_was(spark, tmp_path):
    h = str(tmp_path / "h")
    sinks.upsert_history(spark, h, spark.createDataFrame([("t1", "a", 1)], ROWS))
    code = f"""
        import time
        from pyspark.sql import SparkSession, functions as F
        from pyspark.sql.classic.dataframe import DataFrame
        from borespark.sources import sinks
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        slow = F.udf(lambda i: (time.sleep(0 if i < 4 else 600), "x")[1])
        rows = spark.range(8).select(F.col("id").cast("string").alias("task_id"), F.lit("x").alias("well_name"), F.lit(1).alias("created_at"))
        dealt = DataFrame.repartition
        DataFrame.repartition = lambda self, *by: dealt(self, *by).withColumn("well_name", slow(F.col("task_id").cast("int")))  # the writing tasks themselves are slow
        sinks.upsert_history(spark, {h!r}, rows)
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    writer = subprocess.Popen([sys.executable, "-c", textwrap.dedent(code)], cwd=root, start_new_session=True, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    try:
        began = time.time()
        while len(os.listdir(f"{h}/data")) < 2 and time.time() - began < 240:
            assert writer.poll() is None
            time.sleep(0.2)
        time.sleep(2)
        assert len(os.listdir(f"{h}/data")) == 2 and writer.poll() is None  # in the middle of its write
    finally:
        os.killpg(writer.pid, signal.SIGKILL)
        writer.wait()
    assert held(spark, h) == ({"t1": "a"}, 1)
    sinks.upsert_history(spark, h, spark.createDataFrame([("t2", "b", 1)], ROWS))
    assert versions.sweep(spark, h, keep=1) == 0  # too young: its writer might be at work
    assert versions.sweep(spark, h, keep=1, hours=0) == 1 and held(spark, h) == ({"t1": "a", "t2": "b"}, 2)


def test_writers_at_once_all_get_in(spark, tmp_path):
    h, errors = str(tmp_path / "h"), []

    def write(i):
        try:
            sinks.upsert_history(spark, h, spark.createDataFrame([(f"t{i}", f"w{i}", 1), ("shared", f"w{i}", 1)], ROWS))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    rows, number = held(spark, h)
    assert not errors and number == 4 and set(rows) == {"shared", *(f"t{i}" for i in range(4))}
    store = versions.Store(spark, h)
    assert not store.publish("commits/000000000004.json", "{}") and versions.version_of(store).number == 4


def test_a_store_that_only_spark_reaches(spark, tmp_path):
    """By a path of another scheme the commit is a rename that doesn't replace."""
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.shelf.link./in", f"file://{tmp_path}")
    h = "viewfs://shelf/in/h"
    sinks.upsert_history(spark, h, spark.createDataFrame([("t1", "a", 1)], ROWS))
    sinks.upsert_history(spark, h, spark.createDataFrame([("t2", "b", 1)], ROWS))
    assert held(spark, h) == ({"t1": "a", "t2": "b"}, 2)
    store = versions.Store(spark, h)
    assert not store.publish("commits/000000000002.json", "{}") and held(spark, h)[1] == 2 and [n for n, _ in store.names("commits") if n[0] == "." and not n.endswith(".crc")] == []


def test_repeated_batches_change_nothing(spark, tmp_path):
    h, source, schema = str(tmp_path / "h"), str(tmp_path / "in"), ROWS
    spark.createDataFrame([("t1", "a", 1), ("t2", "b", 1)], ROWS).coalesce(1).write.parquet(source)
    stream = lambda: ingest.stream_history(spark, source, schema, h, str(tmp_path / "cp"), files_per_batch=1).awaitTermination()
    stream()
    stream()
    assert held(spark, h) == ({"t1": "a", "t2": "b"}, 1)
    spark.createDataFrame([("t2", "c", 1), ("t3", "d", 1)], ROWS).coalesce(1).write.mode("append").parquet(source)
    stream()
    assert held(spark, h) == ({"t1": "a", "t2": "c", "t3": "d"}, 2)
    ingest.history_sink(h, str(tmp_path / "cp"))(spark.createDataFrame([("t2", "stale", 1)], ROWS), 1)  # as after a crash between commit and checkpoint
    assert held(spark, h) == ({"t1": "a", "t2": "c", "t3": "d"}, 2)
    ingest.history_sink(h, "another stream")(spark.createDataFrame([("t4", "e", 1)], ROWS), 0)
    assert held(spark, h)[1] == 3


def test_a_stopped_run_goes_on(spark, tmp_path):
    path, called = str(tmp_path / "run"), []

    def job(name, fails=None):
        def work():
            called.append(name)
            if fails == "early":
                raise ValueError(f"no files for {name}")
            rows = spark.range(3).select(F.col("id").cast("string").alias("well_id"), F.lit(name).alias("field"), F.col("id").cast("double").alias("value"))
            return rows if fails is None else rows.withColumn("value", F.when(F.col("id") == 2 if "id" in rows.columns else F.col("well_id") == "2", F.raise_error(F.lit("bad file"))).otherwise(F.col("value")))

        return work

    first = runs.run_domains(spark, path, "t", {"a": job("a"), "b": job("b"), "c": job("c", "late"), "d": job("d", "early")})
    assert {(r.domain, r.status) for r in first.collect()} == {("a", "success"), ("b", "success"), ("c", "error"), ("d", "error")}
    assert {r.error for r in first.where("domain = 'd'").collect()} == {"no files for d"} and "bad file" in first.where("domain = 'c'").first().error
    assert {r.domain for r in runs.results(spark, path, "t").collect()} == {"a", "b"}
    called.clear()
    runs.run_domains(spark, path, "t", {n: job(n) for n in "abcd"})
    assert called == ["c", "d"] or called == ["d", "c"]
    assert runs.results(spark, path, "t").groupBy("domain").count().collect() and {r.domain: r["count"] for r in runs.results(spark, path, "t").groupBy("domain").count().collect()} == dict.fromkeys("abcd", 3)
    called.clear()
    runs.run_domains(spark, path, "u", {"a": job("a")})
    assert called == ["a"] and runs.results(spark, path, "t").count() == 12 and runs.results(spark, path, "u").count() == 3
    plan = sinks.load_domain_results(spark, f"{path}/results", "u")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(task_id" in plan
