"""Directional surveys: trajectories by minimum curvature, dogleg severity and station checks for any number of wells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import azimuth_mod, dls_band, valid_station
from ..plans import dims
from . import pieces

KEYS = ("well_id",)


def order(keys: tuple[str, ...], tie: tuple[str, ...]) -> Window:
    return Window.partitionBy(*keys).orderBy("md", *tie)


def stations(df: DataFrame) -> DataFrame:
    """Valid stations, azimuths within a turn."""
    n = lambda c: F.col(c).try_cast("double") if df.schema[c].dataType.simpleString() == "string" else F.col(c)
    out = df.withColumns({c: n(c) for c in ("md", "inc_deg", "az_deg")})
    return out.where(valid_station(F.col("md"), F.col("inc_deg"), F.col("az_deg"))).withColumn("az_deg", azimuth_mod(F.col("az_deg")))


def survey_deltas(df: DataFrame, keys: tuple[str, ...] = KEYS, tie: tuple[str, ...] = ()) -> DataFrame:
    """df with d_md, d_inc, d_az from the station before."""
    w = order(keys, tie)
    return df.withColumns({f"d_{n}": F.col(c) - F.lag(c).over(w) for n, c in (("md", "md"), ("inc", "inc_deg"), ("az", "az_deg"))})


def minimum_curvature(df: DataFrame, keys: tuple[str, ...] = KEYS, tie: tuple[str, ...] = (), dls_base: float = 100.0, rows: int = pieces.ROWS) -> DataFrame:
    """df with north, east, tvd (two places) and dls (three). One shuffle: all windows share keys and order. A well of more than `rows` stations is cut into
    pieces by depth; the last station and the sums so far are carried over their borders."""
    parts = pieces.Cut(df, keys, ["md", *tie], rows)
    w, before = parts.window(), ("md", "inc_deg", "az_deg")
    x = parts.df if not parts.hot else parts.carried(parts.df, {c: F.col(c) for c in before})
    lag = {c: F.lag(c).over(w) if not parts.hot else F.coalesce(F.lag(c).over(w), F.col(f"{c}_before")) for c in before}
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    i2, a2 = F.radians("inc_deg"), F.radians("az_deg")
    x = x.withColumns({"i1": F.radians(lag["inc_deg"]), "a1": F.radians(lag["az_deg"]), "dmd": F.col("md") - lag["md"]})
    i1, a1 = F.col("i1"), F.col("a1")
    cosine = F.cos(i2 - i1) - F.sin(i1) * F.sin(i2) * (1 - F.cos(a2 - a1))
    x = x.withColumn("dl", F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0))))
    factor = F.when(F.col("dl") > 1e-6, 2 / F.col("dl") * F.tan(F.col("dl") / 2)).otherwise(1.0)
    half = F.col("dmd") / 2 * factor
    steps = {"dn": half * (F.sin(i1) * F.cos(a1) + F.sin(i2) * F.cos(a2)), "de": half * (F.sin(i1) * F.sin(a1) + F.sin(i2) * F.sin(a2)), "dv": half * (F.cos(i1) + F.cos(i2))}
    x = x.withColumns({k: F.coalesce(v, F.lit(0.0)) for k, v in steps.items()})
    x = x if not parts.hot else parts.carried(x, {}, {c: F.col(c) for c in steps})
    total = lambda c: F.sum(c).over(run) + (F.col(f"{c}_before") if parts.hot else F.lit(0.0))
    dls = F.when(F.col("dmd") > 0, F.degrees("dl") * dls_base / F.col("dmd")).otherwise(0.0)
    return x.select(*df.columns, *[F.round(total(c), 2).alias(n) for n, c in (("north", "dn"), ("east", "de"), ("tvd", "dv"))], F.round(dls, 3).alias("dls"))


def trajectory_summary(traj: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return traj.groupBy(*keys).agg(F.round(F.max("md"), 1).alias("total_md"), F.round(F.max_by("tvd", "md"), 1).alias("total_tvd"), F.max("inc_deg").alias("max_inc"), F.max("dls").alias("max_dls"), F.count("*").alias("stations"))


def survey_anomalies(traj: DataFrame, keys: tuple[str, ...] = KEYS, tie: tuple[str, ...] = (), *, inc: float = 5, az: float = 15, gap: float = 100, dls: float = 8, wrap: bool = False) -> DataFrame:
    """keys, position, code, value for stations beyond the limits; traj has dls."""
    d = survey_deltas(traj, keys, tie)
    turn: Column = F.abs("d_az")
    turn = F.least(turn, 360 - turn) if wrap else turn
    one = lambda cond, code, value: F.when(cond, F.struct(F.lit(code).alias("code"), value.cast("double").alias("value")))
    found = F.array_compact(F.array(one(F.abs("d_inc") > inc, "INC_JUMP", F.abs("d_inc")), one(turn > az, "AZ_JUMP", turn), one(F.col("d_md") > gap, "SURVEY_GAP", F.col("d_md")), one(F.col("dls") > dls, "HIGH_DLS", F.col("dls"))))
    return d.select(*keys, F.col("md").alias("position"), F.inline(found))


def dls_profile(traj: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return traj.select(*keys, "md", "dls", dls_band(F.col("dls")).alias("band"))


def tables_to_stations(cells: DataFrame, keys: tuple[str, ...] = ("file_id", "table_id")) -> DataFrame:
    """keys, row_no, md, inc_deg, az_deg from long cells; tables lacking one of the three are left out."""
    name = F.lower(F.trim("col_name"))
    prio = F
    for canonical, variants in dims.STATION_HEADERS.items():
        for i, v in enumerate(variants):
            prio = prio.when(name == v, F.struct(F.lit(canonical).alias("canonical"), F.lit(i).alias("prio")))
    named = cells.withColumn("h", prio.otherwise(F.lit(None))).where("h is not null").select(*keys, "row_no", "value", "h.canonical", "h.prio")
    wide = named.groupBy(*keys, "row_no").pivot("canonical", list(dims.STATION_HEADERS)).agg(F.min_by("value", "prio"))
    return stations(wide)
