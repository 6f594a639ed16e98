"""Registered queries that write, stream and resume: whole tables go through commits, streams and stopped runs, and what is read back has SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import hse, production
from ..sources import scratch, sinks
from ..streaming import ingest
from . import runs
from .registry import SERIES, query, samples, series, table

HISTORY = "task_id long, well_name long, created_at timestamp_ntz, price double"


def orders(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("task_id"), F.col("o_custkey").cast("long").alias("well_name"), F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("state"))


@query("select o_orderkey task_id, o_custkey well_name, case when o_orderkey % 3 = 0 then 0.0 else o_totalprice end price from orders where (o_orderstatus <> 'P' or o_orderkey % 3 = 0) and not (o_orderstatus = 'O' and o_orderkey % 5 = 0)")
def history_commits(spark, d):
    """Three commits: orders, then every third one again at another price, then some deleted."""
    o, path = orders(spark, d), scratch.new_folder(spark)
    sinks.upsert_history(spark, path, o.where("state <> 'P'").drop("state"))
    sinks.upsert_history(spark, path, o.where("task_id % 3 = 0").drop("state").withColumn("price", F.lit(0.0)))
    sinks.delete_history(spark, path, o.where("state = 'O' and task_id % 5 = 0").select("task_id"))
    return sinks.latest(spark, path)[0].select("task_id", "well_name", "price")


@query("select o_orderkey task_id, o_custkey well_name, case when o_orderkey % 7 = 0 then 0.0 else o_totalprice end price from orders")
def stream_history(spark, d):
    """Files of orders picked up in batches, then newer files; at last a batch that was taken already comes again, with other rows."""
    o, folder = orders(spark, d).drop("state"), scratch.new_folder(spark)
    take = lambda: ingest.stream_history(spark, f"{folder}/in", HISTORY, f"{folder}/table", f"{folder}/marks", files_per_batch=2).awaitTermination()
    o.repartition(4, "task_id").write.parquet(f"{folder}/in")
    take()
    o.where("task_id % 7 = 0").withColumn("price", F.lit(0.0)).write.mode("append").parquet(f"{folder}/in")
    take()
    ingest.history_sink(f"{folder}/table", f"{folder}/marks")(o.withColumn("price", F.lit(-1.0)), 1)
    return sinks.latest(spark, f"{folder}/table")[0].select("task_id", "well_name", "price")


def measures(kpis: DataFrame, *fields: str) -> DataFrame:
    return kpis.select(F.col("well_id").cast("string").alias("well_id"), F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields]))).where("value is not null")


@query(
    SERIES
    + ", p as (select l_suppkey w, round(avg(case when rn <= 30 then oil end), 1) ip30, round(max(oil), 1) peak from (select l_suppkey, strftime(l_shipdate, '%Y-%m') period, sum(l_quantity) oil, row_number() over (partition by l_suppkey order by strftime(l_shipdate, '%Y-%m')) rn from lineitem group by 1, 2) group by 1)"
    + ", e as (select user_id w, round(sum(value), 3) npt_hours, count(*)::double npt_events from events group by 1), s as (select user_id w, event_type, count(*)::double n from events group by 1, 2) select 'production' \"domain\", w::varchar well_id, unnest(['ip30', 'peak']) field, unnest([ip30, peak]) \"value\" from p union all select 'drilling', w::varchar, unnest(['npt_hours', 'npt_events']), unnest([npt_hours, npt_events]) from e union all select 'hse', w::varchar, event_type, n from s"
)
def resumed_run(spark, d):
    """A run of three domains that loses one to an error, and its next run, which works out that one alone."""
    path = scratch.new_folder(spark)
    severities = hse.severity_counts(samples(spark, d).withColumnRenamed("mnemonic", "severity")).select(F.col("well_id").cast("string").alias("well_id"), F.col("severity").alias("field"), F.col("n").cast("double").alias("value"))

    def broken() -> DataFrame:
        raise ValueError("a file that can't be read, or a domain worked out twice")

    jobs = {"production": lambda: measures(production.ip_metrics(series(spark, d)), "ip30", "peak"), "drilling": lambda: measures(hse.npt_total(samples(spark, d).withColumnRenamed("value", "duration_hrs")), "npt_hours", "npt_events")}
    runs.run_domains(spark, path, "all", jobs | {"hse": broken})
    runs.run_domains(spark, path, "all", dict.fromkeys(jobs, broken) | {"hse": lambda: severities})
    return runs.results(spark, path, "all").select("domain", "well_id", "field", "value")
