"""Analysis history, comparisons of wells, pad roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import parse_json_or_empty, radar_normalize
from ..plans import dims


def upsert(history: DataFrame, new: DataFrame, key: str = "task_id", order: str = "created_at") -> DataFrame:
    """Rows of new replace those of history with the same key; among several new ones the newest stays; of equally
    new ones one is chosen by its contents."""
    both = history.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    tie = F.xxhash64(*sorted(c for c in both.columns if c not in (key, order, "__new")))
    w = Window.partitionBy(key).orderBy(F.desc("__new"), F.desc(order), tie)
    return both.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__new")


def delete(history: DataFrame, keys: DataFrame, key: str = "task_id") -> DataFrame:
    return history.join(keys.select(key), key, "left_anti")


def latest_per_well(history: DataFrame, wells: DataFrame | None = None, well: str = "well_name", order: tuple[str, ...] = ("created_at", "task_id")) -> DataFrame:
    use = history if wells is None else history.join(wells, well, "left_semi")
    return use.withColumn("rn", F.row_number().over(Window.partitionBy(well).orderBy(*[F.desc(c) for c in order]))).where("rn = 1").drop("rn")


def list_recent(history: DataFrame, limit: int = 50, heavy: tuple[str, ...] = ("risk_summary", "risk_registry", "metrics")) -> DataFrame:
    return history.drop(*heavy).orderBy(F.desc("created_at"), F.desc("task_id")).limit(limit)


def trend(history: DataFrame, well: str, value: str | None = None) -> DataFrame:
    out = history.where(F.col("well_name") == value) if value is not None else history
    parsed = out.withColumn("metrics", parse_json_or_empty(F.col("metrics"))) if "metrics" in out.columns and out.schema["metrics"].dataType.simpleString() == "string" else out
    return parsed.orderBy("created_at", "task_id")


def distinct_wells(history: DataFrame, well: str = "well_name") -> DataFrame:
    return history.select(well).where(F.col(well).isNotNull() & (F.col(well).cast("string") != "")).distinct().orderBy(well)


def comparison_matrix(metrics: DataFrame, wells: list[str], well: str = "well_name", fields: list[str] | None = None) -> DataFrame:
    """metric and a text column for each chosen well: whole numbers as they are, others with two places, missing as a dash."""
    fields = [f for f in (fields or dims.COMPARED) if f in metrics.columns]
    text = lambda f: F.coalesce(F.format_string("%.2f", F.col(f).cast("double")) if metrics.schema[f].dataType.simpleString() in ("double", "float") else F.col(f).cast("string"), F.lit("—"))
    long = metrics.select(F.col(well).cast("string").alias("w"), F.inline(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(f).alias("metric"), text(f).alias("v")) for i, f in enumerate(fields)])))
    wide = long.groupBy("place", "metric").pivot("w", wells).agg(F.first("v"))
    return wide.orderBy("place").select("metric", *[F.coalesce(F.col(f"`{w}`"), F.lit("—")).alias(w) for w in wells])


def risk_level_comparison(metrics: DataFrame, well: str = "well_name") -> DataFrame:
    return metrics.select(well, F.inline(F.array(*[F.struct(F.lit(n).alias("risk_level"), F.coalesce(F.col(f"{n}_count"), F.lit(0)).cast("long").alias("n")) for n in ("critical", "high", "medium", "low")])))


def radar(metrics: DataFrame, keys: tuple[str, ...] = ("well_name",), caps: dict[str, float] | None = None) -> DataFrame:
    caps = caps or dims.RADAR_CAPS
    return metrics.select(*keys, *[(radar_normalize(F.col(c), cap) if c in metrics.columns else F.lit(0.0)).alias(c) for c, cap in caps.items()])


def pad_summary(wells: DataFrame, pad: str = "pad_id", *, zero_is_missing: bool = True) -> DataFrame:
    """Averages over a pad's wells, absent metrics left out; zero rates and stage counts count as absent."""
    use = lambda c: F.nullif(F.col(c), F.lit(0).cast(wells.schema[c].dataType)) if zero_is_missing else F.col(c)
    ip, st = use("ip30"), use("stage_count")
    r = lambda c: F.round(c, 1)
    return wells.groupBy(pad).agg(F.count("*").alias("wells"), r(F.avg(ip)).alias("avg_ip30"), r(F.max(ip)).alias("max_ip30"), r(F.min(ip)).alias("min_ip30"), r(F.avg(st)).alias("avg_stages"), F.sum(st).alias("total_stages"), r(F.avg("total_net_pay")).alias("avg_net_pay"), r(F.avg("npt_hours")).alias("avg_npt"))


def well_identity(entities: DataFrame, keys: tuple[str, ...] = ("well_id",)) -> DataFrame:
    """keys, field, value: the first domain's value; within a domain the last file's. entities: keys, domain_order, file_order, field, value."""
    return entities.where(F.col("value").isNotNull() & (F.col("value") != "")).groupBy(*keys, "field").agg(F.min_by("value", F.struct(F.col("domain_order"), (-F.col("file_order")).alias("f"))).alias("value"))


def well_metrics(*, risks: DataFrame | None = None, parts: list[DataFrame] = (), key: str = "well_id") -> DataFrame:
    """One row for each well: counts of risks by level, and the columns of the parts (KPI tables by well)."""
    out = None
    if risks is not None:
        n = lambda level: F.count(F.when(F.col("risk_level") == level, 1)).alias(f"{level}_count")
        out = risks.select(F.explode("linked_wells").alias(key), "*").groupBy(key).agg(F.count("*").alias("total_risks"), n("critical"), n("high"), n("medium"), n("low"), F.round(F.avg("score"), 2).alias("risk_score"))
    for p in parts:
        out = p if out is None else out.join(p, key, "full_outer")
    return out


def comparison_metrics(features: DataFrame, risks: DataFrame | None = None, npt_events: DataFrame | None = None, stations: DataFrame | None = None, key: str = "well_id") -> DataFrame:
    """One row for each well with the 24 metrics that wells are compared by; what is absent counts as 0, of alternatives the first that isn't 0 holds.

    features: a row for each well, with any of the columns of the domains' KPI tables. risks: probability, impact, risk_level and linked_wells. npt_events (key,
    description, duration_hrs) and stations (key, md, dls) come as lists, in the order of their text and of md, each whole."""
    known = set(features.columns)
    first = lambda *cs: F.coalesce(*[F.nullif(F.col(c).cast("double"), F.lit(0.0)) for c in cs if c in known], F.lit(0.0))
    one = {
        "npt_hours": ("npt_hours",), "current_depth": ("current_depth_m", "measured_depth_m", "current_depth_ft"), "rop": ("rop_m_hr", "rop_ft_hr"), "mud_weight": ("mud_weight_sg", "mud_weight_ppg"), "max_dls": ("max_dls",), "max_inclination": ("max_inc", "max_inc_deg"), "total_md": ("total_md",), "total_tvd": ("total_tvd",),
        "total_net_pay": ("total_net_pay",), "pay_zone_count": ("pay_zone_count",), "stage_count": ("stage_count", "stage_count_actual"), "ip30": ("ip30",), "ip90": ("ip90",), "hse_incidents": ("incidents",), "hse_npt_hours": ("hse_npt_hours",),
    }
    out = features.select(key, *[first(*cs).alias(n) for n, cs in one.items()], *([first("npt_events").cast("long").alias("npt_events")] if npt_events is None else []))
    names = {"total_risks": F.lit(True)} | {f"{n}_risks": F.col("risk_level") == n for n in ("critical", "high", "medium", "low")}
    if risks is None:
        out = out.withColumns({n: F.lit(0).cast("long") for n in names} | {"risk_score": F.lit(0.0)})
    else:
        each = risks.select(F.explode("linked_wells").alias("w"), "risk_level", (F.col("probability") * F.col("impact")).alias("s"))
        counts = each.groupBy(F.col("w").cast(features.schema[key].dataType).alias(key))
        out = out.join(counts.agg(*[F.count_if(c).alias(n) for n, c in names.items()], F.round(F.avg("s"), 2).alias("risk_score")), key, "left").fillna(0, [*names, "risk_score"])
    lists = {"npt_event_details": (npt_events, F.struct(F.substring("description", 1, 100).alias("description"), F.coalesce("duration_hrs", F.lit(0.0)).alias("duration"))), "dls_stations": (stations, F.struct("md", "dls"))}
    kinds = {"npt_event_details": "array<struct<description:string,duration:double>>", "dls_stations": "array<struct<md:double,dls:double>>"}
    for name, (rows, item) in lists.items():
        if rows is not None:
            found = rows.groupBy(key).agg(F.array_sort(F.collect_list(item)).cast(kinds[name]).alias(name), *[F.count("*").alias("npt_events")] * (name == "npt_event_details"))
            out = out.join(found, key, "left")
        else:
            out = out.withColumn(name, F.lit(None).cast(kinds[name]))
        out = out.withColumn(name, F.coalesce(name, F.array().cast(kinds[name])))
    return out.fillna(0, ["npt_events"])
