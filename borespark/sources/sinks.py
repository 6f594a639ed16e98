"""Writers: registry exports, history, pad events, results by task and domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import risk_level
from ..operators.history import delete, upsert
from . import versions

REGISTRY_COLUMNS = ("risk_id", "category", "title_en", "title_ru", "probability", "impact", "risk_level", "status", "mitigation_en", "linked_wells", "linked_pads")


def registry_documents(risks: DataFrame) -> DataFrame:
    """One nested record for each well: header, summary, risks by falling score."""
    per = risks.select(F.explode_outer("linked_wells").alias("well"), F.struct((-F.col("score")).alias("o"), *[c for c in risks.columns]).alias("r"))
    n = lambda level: F.count(F.when(F.col("r.risk_level") == level, 1)).alias(level)
    x = per.groupBy("well").agg(F.count("*").alias("total"), n("critical"), n("high"), n("medium"), n("low"), F.sort_array(F.collect_list("r")).alias("risks"))
    return x.select("well", F.struct("total", "critical", "high", "medium", "low").alias("summary"), F.transform("risks", lambda r: r.dropFields("o")).alias("risks"))


def write_registry_json(risks: DataFrame, path: str) -> None:
    registry_documents(risks).write.mode("overwrite").json(path)


def registry_rows(risks: DataFrame) -> DataFrame:
    return risks.select(*[F.array_join(c, ";").alias(c) if risks.schema[c].dataType.typeName() == "array" else F.col(c) for c in REGISTRY_COLUMNS])


def row_to_risk(rows: DataFrame) -> DataFrame:
    """Risks read back: score and level follow from probability and impact where both are there, whatever the row says; lists are split again."""
    both = F.col("probability").isNotNull() & F.col("impact").isNotNull()
    p, i = F.col("probability").cast("int"), F.col("impact").cast("int")
    lists = {c: F.filter(F.split(c, ";"), lambda x: x != "") for c in ("linked_wells", "linked_pads", "mitigation_en", "mitigation_ru") if c in rows.columns and rows.schema[c].dataType.typeName() == "string"}
    score = F.when(both, p * i).otherwise(F.col("score").cast("int")) if "score" in rows.columns else p * i
    level = F.when(both, risk_level(p, i)).otherwise(F.col("risk_level") if "risk_level" in rows.columns else F.lit(None))
    return rows.withColumns(lists | {"probability": p, "impact": i, "score": score, "risk_level": level})


def write_registry_csv(risks: DataFrame, path: str) -> None:
    registry_rows(risks).write.mode("overwrite").csv(path, header=True)


def upsert_history(spark: SparkSession, path: str, new: DataFrame, *, key: str = "task_id", order: str = "created_at", batch: tuple[str, int] | None = None) -> int:
    """Insert or replace by key, as one commit (versions.commit); only the hash buckets of new keys are written again. new is read more than once. The number of the version."""
    return versions.commit(spark, path, new, key, lambda old: upsert(new.limit(0) if old is None else old, new, key, order), batch=batch)


def delete_history(spark: SparkSession, path: str, keys: DataFrame, key: str = "task_id") -> int:
    """Delete by key, as one commit; without a table nothing happens."""
    old, number = versions.read(spark, path)
    return number if old is None else versions.commit(spark, path, keys, key, lambda rows: delete(rows, keys, key))


def latest(spark: SparkSession, path: str) -> tuple[DataFrame | None, int]:
    """(rows, number) of the last version; None and 0 before the first."""
    return versions.read(spark, path)


def append_npt_history(history: DataFrame, events: DataFrame) -> DataFrame:
    """Rows of events to be appended: id pad_well_number, text of 500 characters at most, ids that are there already left out."""
    rows = events.withColumn("event_id", F.concat_ws("_", "pad_id", "well_id", F.col("i").cast("string"))).withColumn("raw_text", F.substring("raw_text", 1, 500)).drop("i")
    return rows.dropDuplicates(["event_id"]).join(history.select("event_id"), "event_id", "left_anti")


def save_domain_results(results: DataFrame, path: str) -> None:
    """By task and domain; a rerun replaces its own partitions only."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("task_id", "domain").parquet(path)


def load_domain_results(spark: SparkSession, path: str, task_id: str) -> DataFrame:
    """The results of one task; other tasks' files aren't opened."""
    return spark.read.parquet(path).where(F.col("task_id") == task_id)
