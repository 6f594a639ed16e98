"""Incidents and lost time: counts, totals, shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import trir
from . import pieces

KEYS = ("well_id",)


def severity_counts(events: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return events.groupBy(*keys, "severity").agg(F.count("*").alias("n"))


def hse_summary(events: DataFrame, manhours: DataFrame | None = None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, counts (map), incidents, npt_hours, sif_count, trir."""
    one = events.groupBy(*keys, "severity").agg(F.count("*").alias("n"), F.sum("npt_hrs").alias("h"), F.sum(F.col("sif_potential").cast("long")).alias("s"))
    cases = F.sum(F.when(F.col("severity").isin("fatality", "lti", "rwc", "mtc"), F.col("n")).otherwise(0))
    out = one.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("severity", "n"))).alias("counts"), F.sum("n").alias("incidents"), F.round(F.sum("h"), 2).alias("npt_hours"), F.sum("s").alias("sif_count"), cases.alias("cases"))
    out = out.withColumn("manhours", F.lit(None).cast("double")) if manhours is None else out.join(manhours, list(keys), "left")
    return out.withColumn("trir", trir(F.col("cases"), F.col("manhours"))).drop("cases", "manhours")


def npt_total(events: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return events.groupBy(*keys).agg(F.round(F.sum(F.coalesce("duration_hrs", F.lit(0.0))), 3).alias("npt_hours"), F.count("*").alias("npt_events"))


def npt_pareto(events: DataFrame, keys: tuple[str, ...] = KEYS, *, width: int = 50, top: int | None = 8, rows: int = pieces.ROWS) -> DataFrame:
    """keys, label, hours, cumulative_pct: causes by hours, with the running share. top: a report limit for each key. A well of more than `rows` causes is cut
    into pieces by hours."""
    sums = events.groupBy(*keys, F.substring("description", 1, width).alias("label")).agg(F.sum("duration_hrs").alias("hours")).withColumn("less", -F.col("hours"))
    parts = pieces.Cut(sums, keys, ["less", "label"], rows)
    x = parts.carried(parts.df, {}, {"run": F.col("hours"), "ranks": F.lit(1)}) if parts.hot else parts.df
    order, so_far = parts.window(), lambda c: F.col(f"{c}_before") if parts.hot else F.lit(0)
    whole = sums.groupBy(*keys).agg(F.sum("hours").alias("all"))
    x = x.withColumns({"run": F.sum("hours").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + so_far("run"), "rank": (F.row_number().over(order) + so_far("ranks")).cast("int")})
    x = x.join(whole, list(keys)) if parts.hot else x.withColumn("all", F.sum("hours").over(Window.partitionBy(*keys, pieces.PIECE)))
    out = x.select(*keys, "label", F.round("hours", 3).alias("hours"), F.round(F.try_divide("run", "all") * 100, 3).alias("cumulative_pct"), "rank")
    return out if top is None else out.where(F.col("rank") <= top)
