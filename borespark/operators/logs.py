"""Well logs: curve statistics, pay intervals as gaps and islands, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import canonical_curve, normalize_depth_unit
from ..sources.scratch import sent_if_small, written
from . import pieces

KEYS = ("well_id",)
GAMMA = ("GR", "GRC", "SGR")
RESISTIVITY = ("RT", "RD", "RILD")


def exact_quantiles(values: DataFrame, keys: tuple[str, ...], shares: tuple[float, ...], rows: int = pieces.ROWS) -> DataFrame:
    """keys, q: array of interpolated quantiles of column v. No key of more than `rows` values is in one task: it is cut into pieces along its values, by
    their count; ranks are counts of the pieces before and places within one."""
    parts = pieces.Cut(values, keys, ["v"], rows)
    if not parts.hot:
        return values.groupBy(*keys).agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q"))
    totals = parts.df.groupBy(*keys).agg(F.count("*").alias("total"))
    x = parts.carried(parts.df, {}, {"n": F.lit(1)}).join(sent_if_small(written(totals)), list(keys))
    x = x.withColumn("rank", F.row_number().over(parts.window()) - 1 + F.col("n_before"))
    place = [(F.col("total") - 1) * F.lit(p) for p in shares]
    at = lambda rank: F.max(F.when(F.col("rank") == rank, F.col("v")))
    found = x.groupBy(*keys, "total").agg(*[at(f(p)).alias(f"{n}{i}") for i, p in enumerate(place) for n, f in (("lo", F.floor), ("hi", F.ceil))])
    return found.select(*keys, F.array(*[F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (p - F.floor(p)) for i, p in enumerate(place)]).alias("q"))


def curve_stats(samples: DataFrame, keys: tuple[str, ...] = ("well_id", "mnemonic"), *, sentinel: float = -999.25, exact: bool = True, rows: int = pieces.ROWS) -> DataFrame:
    """keys, n, min, max, mean, p10, p50, p90 of values that are neither the sentinel nor NaN. Keys that are null are left out."""
    v = F.nullif(F.nanvl("value", F.lit(None).cast("double")), F.lit(sentinel))
    shares, use = (0.1, 0.5, 0.9), samples.select(*keys, v.alias("v")).where("v is not null").dropna(subset=list(keys))
    out = use.groupBy(*keys).agg(F.count("v").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), *[] if exact else [F.percentile_approx("v", list(shares), 10000).alias("q")])
    out = out.join(exact_quantiles(use, keys, shares, rows), list(keys)) if exact else out
    return out.select(*keys, "n", "min", "max", F.round("mean", 3).alias("mean"), *[F.round(F.col("q")[i], 3).alias(n) for i, n in enumerate(("p10", "p50", "p90"))])


def channel_stats(samples: DataFrame, keys: tuple[str, ...] = ("channel",)) -> DataFrame:
    return samples.groupBy(*keys).agg(F.count("value").alias("sample_count"), F.min("value").alias("min"), F.max("value").alias("max"))


def log_table(samples: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, depth, gr, rt: GR, and the first of RT, RD, RILD that the well has."""
    wide = samples.where(F.col("mnemonic").isin("GR", *RESISTIVITY)).groupBy(*keys, "depth").pivot("mnemonic", ["GR", *RESISTIVITY]).agg(F.first("value", ignorenulls=True))
    has = {m: F.max(F.col(m).isNotNull()).over(Window.partitionBy(*keys)) for m in RESISTIVITY}
    rt = F.when(has["RT"], F.col("RT")).when(has["RD"], F.col("RD")).otherwise(F.col("RILD"))
    return wide.select(*keys, "depth", F.col("GR").alias("gr"), rt.alias("rt"))


def pay_mask(gr: Column, rt: Column, gr_cutoff: float | None = None, rt_cutoff: float | None = None) -> Column:
    """Cutoffs that aren't given are 75 API and 10 ohm m."""
    return F.coalesce((gr < (75.0 if gr_cutoff is None else gr_cutoff)) & (rt > (10.0 if rt_cutoff is None else rt_cutoff)) & ~F.isnan(gr) & ~F.isnan(rt), F.lit(False))


def pay_intervals(logs: DataFrame, keys: tuple[str, ...] = KEYS, *, gr_cutoff: float | None = None, rt_cutoff: float | None = None, unit: str = "m", least: float | None = None, include_step: bool = False, rows: int = pieces.ROWS) -> DataFrame:
    """keys, top, base, net: runs of pay samples in depth order that are thicker than 1.0 m or 3.0 ft. A well of more than `rows` samples is cut into pieces by
    depth; an interval may go over their borders."""
    least = (1.0 if unit == "m" else 3.0) if least is None else least
    parts = pieces.Cut(logs.withColumn("pay", pay_mask(F.col("gr"), F.col("rt"), gr_cutoff, rt_cutoff)), keys, ["depth"], rows)
    w = parts.window()
    x = parts.df if not parts.hot else parts.carried(parts.df, {"depth": F.col("depth")}, {"ranks": F.lit(1), "pays": F.col("pay").cast("int")})
    near = lambda f, side: F.coalesce(f("depth").over(w), F.col(f"depth_{side}")) if parts.hot else f("depth").over(w)
    x = x.withColumn("step", F.coalesce(near(F.lead, "after") - F.col("depth"), F.col("depth") - near(F.lag, "before"), F.lit(0.0)))
    # a pay sample's place among all samples less its place among pay samples is the same within a run, and only there
    place = F.row_number().over(w) + (F.col("ranks_before") if parts.hot else F.lit(0))
    own = F.row_number().over(Window.partitionBy(*keys, pieces.PIECE, "pay").orderBy("depth")) + (F.col("pays_before") if parts.hot else F.lit(0))
    x = x.withColumn("island", place - own).where("pay")
    out = x.groupBy(*keys, "island").agg(F.min("depth").alias("top"), F.max("depth").alias("base"), F.max_by("step", "depth").alias("step"))
    net = F.col("base") - F.col("top") + (F.col("step") if include_step else F.lit(0.0))
    return out.withColumn("net", net).where(F.col("net") > least).select(*keys, "top", "base", "net", F.lit(0.6).alias("confidence"))


def net_pay_summary(intervals: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return intervals.groupBy(*keys).agg(F.round(F.sum("net"), 1).alias("total_net_pay"), F.count("*").alias("pay_zone_count"))


def downsample(samples: DataFrame, most: int, keys: tuple[str, ...] = KEYS, order: tuple[str, ...] = ("depth",)) -> DataFrame:
    """Every n-th row of the whole file, n = max(1, rows div most)."""
    w = Window.partitionBy(*keys)
    x = samples.withColumns({"rn": F.row_number().over(w.orderBy(*order)), "n": F.count("*").over(w)})
    return x.where((F.col("rn") - 1) % F.greatest(F.lit(1), F.floor(F.col("n") / most)) == 0).drop("rn", "n")


def first_wins_dedupe(curves: DataFrame, keys: tuple[str, ...] = KEYS, order: tuple[str, ...] = ("file_id", "curve_no")) -> DataFrame:
    """One row for each mnemonic of a well: the first."""
    return curves.withColumn("rn", F.row_number().over(Window.partitionBy(*keys, "mnemonic").orderBy(*order))).where("rn = 1").drop("rn")


def missing_curves(curves: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, missing: GR and RT families that a well lacks."""
    has = curves.groupBy(*keys).agg(F.max(F.col("mnemonic").isin(*GAMMA)).alias("g"), F.max(F.col("mnemonic").isin(*RESISTIVITY)).alias("r"))
    return has.select(*keys, F.array_compact(F.array(F.when(~F.col("g"), F.lit("GR")), F.when(~F.col("r"), F.lit("RT")))).alias("missing")).where(F.size("missing") > 0)


def depth_ranges(wells: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, ranges, max_depth from header items (keys, file_id, key, value)."""
    per = wells.groupBy(*keys, "file_id").agg(F.max(F.when(F.col("key") == "STRT", F.col("value").try_cast("double"))).alias("start"), F.max(F.when(F.col("key") == "STOP", F.col("value").try_cast("double"))).alias("stop")).where("start is not null and stop is not null")
    return per.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("ranges"), F.max(F.greatest("start", "stop")).alias("max_depth"))


def depth_unit(wells: DataFrame, curves: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, unit: from the header's STRT, STOP, STEP, then from DEPT, DEPTH, MD."""
    items = wells.select(*keys, F.upper("key").alias("k"), "unit").unionByName(curves.select(*keys, F.upper("mnemonic").alias("k"), "unit"))
    names = ("STRT", "STOP", "STEP", "DEPT", "DEPTH", "MD")
    wide = items.groupBy(*keys).agg(*[F.max(F.when(F.col("k") == n, F.col("unit"))).alias(n) for n in names])
    return wide.select(*keys, normalize_depth_unit(*[F.col(n) for n in names]).alias("unit"))


def named_curves(curves: DataFrame) -> DataFrame:
    return curves.withColumn("canonical", canonical_curve(F.col("mnemonic")))
