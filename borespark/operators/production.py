"""Production series: initial rates and gas-oil ratio breakthrough."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import dims

KEYS = ("well_id",)


def first_n_mean(value: str, rank: str, n: int) -> Column:
    return F.avg(F.when(F.col(rank) <= n, F.col(value)))


def ip_metrics(series: DataFrame, keys: tuple[str, ...] = KEYS, *, period: tuple[str, ...] = ("period",), rate: str = "oil_rate", spans: tuple[int, ...] = (30, 60, 90, 180, 365)) -> DataFrame:
    """keys, ip<n>: mean of the first n known rates (all, if fewer), and peak; one place."""
    known = series.where(F.col(rate).isNotNull()).withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*period)))
    return known.groupBy(*keys).agg(*[F.round(first_n_mean(rate, "rn", n), 1).alias(f"ip{n}") for n in spans], F.round(F.max(rate), 1).alias("peak"))


def half_split_mean(series: DataFrame, value: str, keys: tuple[str, ...] = KEYS, period: tuple[str, ...] = ("period",)) -> DataFrame:
    """keys, n, first_half, second_half: means of the halves in order; of an odd count the first half is the shorter."""
    w = Window.partitionBy(*keys)
    x = series.where(F.col(value).isNotNull()).withColumns({"rn": F.row_number().over(w.orderBy(*period)), "n": F.count("*").over(w)})
    first = F.col("rn") <= F.floor(F.col("n") / 2)
    return x.groupBy(*keys).agg(F.max("n").alias("n"), F.avg(F.when(first, F.col(value))).alias("first_half"), F.avg(F.when(~first, F.col(value))).alias("second_half"))


def gor_breakthrough(series: DataFrame, keys: tuple[str, ...] = KEYS, period: tuple[str, ...] = ("period",), *, least: int = 6, ratio: float = 1.5) -> DataFrame:
    """keys, code, value: the rise in per cent where the second half's mean passes ratio times the first's."""
    x = half_split_mean(series, "gor", keys, period).where((F.col("n") > least) & (F.col("second_half") > ratio * F.col("first_half")))
    return x.select(*keys, F.lit("GOR_BREAKTHROUGH").alias("code"), F.round((F.try_divide("second_half", "first_half") - 1) * 100, 1).alias("value"))


def pick_rate_column(cells: DataFrame, keys: tuple[str, ...] = ("file_id", "table_id")) -> DataFrame:
    """keys, rate_column: the column that holds the first candidate name; else the first that isn't a date."""
    name = F.lower(F.trim("col_name"))
    prio = F
    for i, c in enumerate(dims.OIL_COLUMNS):
        prio = prio.when(F.contains(name, F.lit(c)), i)
    rank = prio.when(~F.contains(name, F.lit("date")) & ~F.contains(name, F.lit("дата")), 1000)
    return cells.select(*keys, "col_no", "col_name", rank.otherwise(F.lit(None)).alias("rank")).where("rank is not null").groupBy(*keys).agg(F.min_by("col_name", F.struct("rank", "col_no")).alias("rate_column"))


def tables_to_time_series(cells: DataFrame, keys: tuple[str, ...] = ("file_id", "table_id")) -> DataFrame:
    """keys, row_no, period, oil_rate: rows of tables with a date column (exact name) and a rate column (contained name)."""
    name = F.lower(F.trim("col_name"))
    is_rate = F.lit(False)
    for r in dims.RATE_HEADERS:
        is_rate = is_rate | F.contains(name, F.lit(r))
    marked = cells.withColumns({"is_date": name.isin(*dims.DATE_HEADERS), "is_rate": is_rate})
    good = marked.groupBy(*keys).agg(F.max("is_date").alias("d"), F.max("is_rate").alias("r")).where("d and r").select(*keys)
    rate = pick_rate_column(cells, keys)
    use = marked.join(good, list(keys), "left_semi").join(rate, list(keys))
    return use.groupBy(*keys, "row_no").agg(F.max(F.when(F.col("is_date"), F.col("value"))).alias("period"), F.max(F.when(F.col("col_name") == F.col("rate_column"), F.col("value").try_cast("double"))).alias("oil_rate"))
