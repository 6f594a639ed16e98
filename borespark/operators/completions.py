"""Frac stages: totals and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import dims

KEYS = ("well_id",)


def tables_to_stages(cells: DataFrame, keys: tuple[str, ...] = ("file_id", "table_id")) -> DataFrame:
    """keys, row_no, stage_number and fields: the stage column by exact name, others by contained names, the first column winning."""
    name = F.lower(F.trim("col_name"))
    fields = F.array_compact(F.array(F.when(name.isin(*dims.STAGE_HEADERS), F.lit("stage_number")), *[F.when(F.contains(name, F.lit(c)), F.lit(f)) for f, c in dims.STAGE_FIELDS.items()]))
    wide = cells.select(*keys, "row_no", "col_no", "value", F.explode(fields).alias("field")).groupBy(*keys, "row_no").pivot("field", ["stage_number", *dims.STAGE_FIELDS]).agg(F.min_by("value", "col_no"))
    out = wide.withColumns({c: F.col(c).try_cast("double") for c in dims.STAGE_FIELDS} | {"stage_number": F.col("stage_number").try_cast("double").try_cast("int")})
    return out.where("stage_number is not null")


def stage_summary(stages: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return stages.groupBy(*keys).agg(F.count("*").alias("stage_count_actual"), F.round(F.sum("fluid"), 2).alias("total_fluid"), F.round(F.sum("proppant"), 2).alias("total_proppant"), F.min("isip").alias("min_isip"), F.max("isip").alias("max_isip"))


def isip_check(stages: DataFrame, keys: tuple[str, ...] = KEYS, least: float = 1000, most: float = 20000) -> DataFrame:
    return stages.where((F.col("isip") < least) | (F.col("isip") > most)).select(*keys, F.col("stage_number").alias("position"), F.lit("ISIP_RANGE").alias("code"), F.col("isip").alias("value"))


def stage_count_check(wells: DataFrame, summary: DataFrame, keys: tuple[str, ...] = KEYS, slack: int = 2) -> DataFrame:
    """wells (keys, stage_count) against counted stages: differs by more than slack."""
    both = wells.join(summary, list(keys))
    return both.where(F.abs(F.col("stage_count") - F.col("stage_count_actual")) > slack).select(*keys, F.lit("STAGE_COUNT_MISMATCH").alias("code"), F.col("stage_count").cast("double").alias("value"), F.col("stage_count_actual").alias("actual"))
