"""Windows over keys of any size: a key with very many rows is cut into pieces along its order, each piece is worked on alone, and what the
next piece needs (sums so far, the last row, the first row of what follows) is carried over their borders in a small table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import sent_if_small, written

ROWS = 1_000_000
PIECE = "__piece"


def cut(df: DataFrame, keys: tuple[str, ...], by: str, rows: int = ROWS) -> tuple[DataFrame, bool]:
    """(df with PIECE, whether any key was cut). A key of more than `rows` rows gets pieces of about that many, by ranges of the number `by`:
    its range is divided evenly into 32 bins a piece, and bins are put together by their counts, so equal values stay together. Null keys and nulls in `by` (first) too."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("__n"), F.min(by).cast("double").alias("__lo"), F.max(by).cast("double").alias("__hi")).where(F.col("__n") > rows)
    if sizes.isEmpty():
        return df.withColumn(PIECE, F.lit(0).cast("long")), False
    hot = written(sizes).withColumn("__bins", F.ceil(F.col("__n") / rows) * 32)
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    on = same[0]
    for c in same[1:]:
        on = on & c
    spread = F.col("__hi") - F.col("__lo")
    bin_ = F.when(F.col("__bins").isNull(), F.lit(-1)).when(F.col(by).isNull() | (spread <= 0), F.lit(0)).otherwise(F.least(F.floor((F.col(by).cast("double") - F.col("__lo")) / spread * F.col("__bins")), F.col("__bins") - 1) + 1)
    binned = df.alias("l").join(sent_if_small(hot).alias("r"), on, "left").select("l.*", bin_.cast("long").alias("__bin"))
    counts = binned.where("__bin >= 0").groupBy(*keys, "__bin").agg(F.count("*").alias("__c"))
    before = F.coalesce(F.sum("__c").over(Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = written(counts.select(*keys, "__bin", F.floor(before / rows).alias(PIECE)))
    out = binned.alias("l").join(sent_if_small(pieces).alias("r"), on & (F.col("l.__bin") == F.col("r.__bin")), "left")
    return out.select(*[F.col(f"l.{c}") for c in df.columns], F.coalesce(F.col(f"r.{PIECE}"), F.lit(0)).cast("long").alias(PIECE)), True


class Cut:
    """A table cut into pieces, ordered by `order` within its keys; the first of these is what it was cut by."""

    def __init__(self, df: DataFrame, keys: tuple[str, ...], order: list[str], rows: int = ROWS, *, least_first: str | None = None):
        self.keys, self.order = keys, order
        self.df, self.hot = cut(df, keys, least_first or order[0], rows)

    def window(self, order: list[Column] | None = None):
        return Window.partitionBy(*self.keys, PIECE).orderBy(*(order or self.order))

    def carried(self, df: DataFrame, values: dict[str, Column], sums: dict[str, Column] | None = None) -> DataFrame:
        """df with, for each of values, `<name>_before` (of the last row of the piece before) and `<name>_after` (of the first row of the next), and for each of
        sums `<name>_before` (the sum over all earlier pieces; 0 at first)."""
        at = F.struct(*self.order)
        ends = [f(v, at).alias(f"__{k}_{n}") for n, v in values.items() for k, f in (("last", F.max_by), ("first", F.min_by))]
        each = df.groupBy(*self.keys, PIECE).agg(*ends, *[F.sum(v).alias(f"__sum_{n}") for n, v in (sums or {}).items()], F.count("*").alias("__rows"))
        line = Window.partitionBy(*self.keys).orderBy(PIECE)
        found = [f for n in values for f in (F.lag(f"__last_{n}").over(line).alias(f"{n}_before"), F.lead(f"__first_{n}").over(line).alias(f"{n}_after"))]
        found += [F.coalesce(F.sum(f"__sum_{n}").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias(f"{n}_before") for n in sums or {}]
        borders = each.select(*self.keys, PIECE, *found)
        borders = sent_if_small(written(borders.where(F.col(PIECE) >= 0)))
        on = (F.col(f"l.{PIECE}") == F.col(f"r.{PIECE}"))
        for k in self.keys:
            on = on & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
        return df.alias("l").join(borders.alias("r"), on, "left").select("l.*", *[F.col(f"r.{c}") for c in borders.columns if c not in (*self.keys, PIECE)])
