"""Runs of several domains under one task, whose failures are rows and which go on where a stopped run ended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import match
from ..sources import sinks, versions

STATUS = "task_id string, domain string, status string, error string, key string, created_at timestamp"


def statuses(spark: SparkSession, path: str, task_id: str) -> DataFrame:
    """task_id, domain, status, error of the domains that a task has ended."""
    rows, _ = versions.read(spark, f"{path}/status")
    rows = spark.createDataFrame([], STATUS) if rows is None else rows
    return rows.where(F.col("task_id") == task_id).select("task_id", "domain", "status", "error")


def run_domains(spark: SparkSession, path: str, task_id: str, jobs: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """Work the jobs out whose domain has not succeeded yet, each saved as it ends; the status of every domain.

    A job gives rows of one schema that all domains share. A job that fails is a status row with its error, and the others go on; with the next run it is
    tried again. A domain counts once its status is committed, which is after its rows: rows that a killed run left half written are replaced."""
    wanted = spark.createDataFrame([(task_id, d) for d in jobs], "task_id string, domain string")
    done = statuses(spark, path, task_id).where("status = 'success'")
    for domain in [r.domain for r in match.drop_finished(wanted, done).collect()]:  # as many as there are jobs
        try:
            rows = jobs[domain]()
            sinks.save_domain_results(rows.select(F.lit(task_id).alias("task_id"), F.lit(domain).alias("domain"), *rows.columns), f"{path}/results")
            ended = ("success", None)
        except (PySparkException, ValueError, KeyError) as e:
            ended = ("error", str(e).strip().splitlines()[0][:500] or type(e).__name__)
        status = spark.createDataFrame([(task_id, domain, *ended, f"{task_id}\x1f{domain}")], STATUS.rsplit(",", 1)[0]).withColumn("created_at", F.current_timestamp())
        sinks.upsert_history(spark, f"{path}/status", status, key="key")
    return statuses(spark, path, task_id)


def results(spark: SparkSession, path: str, task_id: str) -> DataFrame:
    """The rows of the task's domains that have succeeded."""
    done = statuses(spark, path, task_id).where("status = 'success'").select("domain")
    return sinks.load_domain_results(spark, f"{path}/results", task_id).join(F.broadcast(done), "domain", "left_semi")
