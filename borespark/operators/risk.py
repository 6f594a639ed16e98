"""Risk rules in one pass, and the registry's filters, aggregates and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import level_rank, risk_level
from ..plans import dims

KEYS = ("well_id",)


def score_risks(features: DataFrame, flags: DataFrame, *, detected_at: str | None = None) -> DataFrame:
    """One row for each fired rule from features (well_id and any of pad_id, npt_hours, curves, pay_zone_count, missing, max_dls,
    fatality, lti, sif_count, patterns) and flags (well_id, code, field, message). Rules that quote flags quote the first; K15-K18
    give a row for each item. Flags are aggregated to one row for each well first; all rules are one projection."""
    known = set(features.columns)
    col = lambda c, kind: F.col(c) if c in known else F.lit(None).cast(kind)
    f = flags.select("well_id", "code", *[F.col(c) if c in flags.columns else F.lit(None).cast("string").alias(c) for c in ("field", "message")])
    first = lambda cond: F.min(F.when(cond, F.coalesce("message", "code")))
    items = lambda code: F.array_sort(F.collect_list(F.when(F.col("code") == code, F.coalesce("message", "code"))))
    quoted = {"mud": (F.col("code") == "RANGE") & F.contains(F.coalesce("field", F.lit("")), F.lit("mud_weight")), "isip": F.col("code") == "ISIP_RANGE", "mismatch": F.col("code").isin("STAGE_COUNT_MISMATCH", "VOLUME"), "gor": F.col("code") == "GOR_BREAKTHROUGH", "dls": F.col("code") == "HIGH_DLS", "inc": F.col("code") == "INC_JUMP", "gap": F.col("code") == "SURVEY_GAP"}
    listed = {"depth": "DEPTH_MISMATCH", "under": "UNDER_STIMULATION", "predicted": "PREDICTIVE_RISK"}
    per = f.groupBy("well_id").agg(*[first(c).alias(f"q_{n}") for n, c in quoted.items()], *[items(c).alias(f"l_{n}") for n, c in listed.items()])
    x = features.join(per, "well_id", "full_outer")
    npt = col("npt_hours", "double")
    text = lambda c: F.format_string("%.1f", c)
    none = F.lit(None).cast("string")

    def row(rule: str, value: Column, quote: Column) -> Column:
        return F.struct(F.lit(rule).alias("rule_id"), value.cast("string").alias("v"), quote.cast("string").alias("quote"))

    single = [
        F.when(npt > 10, row("K01", text(npt), none)),
        F.when((npt > 5) & (npt <= 10), row("K02", text(npt), none)),
        *[F.when(F.col(f"q_{n}").isNotNull(), row(k, F.format_string("%.2f", col("max_dls", "double")) if k == "K09" else none, F.col(f"q_{n}"))) for k, n in (("K03", "mud"), ("K06", "isip"), ("K07", "mismatch"), ("K08", "gor"), ("K09", "dls"), ("K10", "inc"), ("K11", "gap"))],
        F.when((F.size(col("curves", "array<string>")) > 0) & (F.coalesce(col("pay_zone_count", "long"), F.lit(0)) == 0), row("K04", none, none)),
        F.when(F.size(col("missing", "array<string>")) > 0, row("K05", F.array_join(col("missing", "array<string>"), ", "), none)),
        *[F.when(col(c, "long") > 0, row(k, col(c, "long"), none)) for k, c in (("K12", "fatality"), ("K13", "lti"), ("K14", "sif_count"))],
    ]
    def each(rule: str, values: Column) -> Column:
        return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: row(rule, v, v))

    many = [each(k, c) for k, c in (("K15", F.slice(col("patterns", "array<string>"), 1, 3)), ("K16", F.col("l_depth")), ("K17", F.col("l_under")), ("K18", F.col("l_predicted")))]
    fired = x.select("well_id", col("pad_id", "string").alias("pad_id"), F.inline(F.concat(F.array_compact(F.array(*single)), *many)))
    return finished(fired, detected_at)


def finished(fired: DataFrame, detected_at: str | None = None) -> DataFrame:
    """The risks' columns for rows (well_id, pad_id, rule_id, v, quote); texts come from the rules' dimension."""
    spark = fired.sparkSession
    rules = spark.createDataFrame([(k, *r) for k, r in dims.RULES.items()], "rule_id string, source_agent string, category string, probability int, impact int, t_en string, t_ru string, mitigation_en array<string>, mitigation_ru array<string>")
    x = fired.join(F.broadcast(rules), "rule_id")
    title = lambda c: F.replace(F.col(c), F.lit("{v}"), F.coalesce("v", F.lit("")))
    return x.select(
        F.concat(F.lit("RISK-"), F.upper(F.substring(F.sha2(F.concat_ws("‖", "well_id", "rule_id", F.coalesce("quote", "v")), 256), 1, 8))).alias("risk_id"), "rule_id", "category", "source_agent", title("t_en").alias("title_en"), title("t_ru").alias("title_ru"),
        F.coalesce("quote", title("t_en")).alias("description_en"), F.coalesce("quote", title("t_ru")).alias("description_ru"), "probability", "impact", (F.col("probability") * F.col("impact")).alias("score"), risk_level(F.col("probability"), F.col("impact")).alias("risk_level"),
        "mitigation_en", "mitigation_ru", F.lit("open").alias("status"), F.array_compact(F.array(F.col("well_id").cast("string"))).alias("linked_wells"), F.array_compact(F.array(F.col("pad_id").cast("string"))).alias("linked_pads"), F.lit(detected_at).cast("timestamp").alias("detected_at"), F.create_map(F.lit("value"), F.coalesce("v", F.lit(""))).alias("metadata"),
    )


def filter_risks(risks: DataFrame, *, category: str | None = None, level: str | None = None, status: str | None = None, min_probability: int | None = None) -> DataFrame:
    out = risks
    for c, v in (("category", category), ("risk_level", level), ("status", status)):
        out = out if v is None else out.where(F.col(c) == v)
    out = out if min_probability is None else out.where(F.col("probability") >= min_probability)
    return out.orderBy(F.desc("score"), "risk_id")


def critical_risks(risks: DataFrame) -> DataFrame:
    return risks.where(F.col("risk_level").isin("critical", "high")).orderBy(F.desc(level_rank(F.col("risk_level"))), F.desc("score"), "risk_id")


def top_risks(risks: DataFrame, k: int) -> DataFrame:
    return risks.orderBy(F.desc("score"), "risk_id").limit(k)


def risk_matrix(risks: DataFrame) -> DataFrame:
    """probability, impact, n: all 25 cells, those without risks 0; other values are ignored. From 5 down, then 1 up."""
    grid = risks.sparkSession.range(25).select((F.col("id") / 5 + 1).cast("int").alias("probability"), (F.col("id") % 5 + 1).cast("int").alias("impact"))
    counts = risks.groupBy(F.col("probability").cast("int").alias("probability"), F.col("impact").cast("int").alias("impact")).agg(F.count("*").alias("n"))
    return grid.join(counts, ["probability", "impact"], "left").select("probability", "impact", F.coalesce("n", F.lit(0)).alias("n"))


def explode_matrix(risks: DataFrame) -> DataFrame:
    return risk_matrix(risks).orderBy(F.desc("probability"), "impact")


def risk_summary(risks: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each of keys, where given): total, a count for each level and category (0 without), mean and largest score."""
    score = F.col("probability") * F.col("impact")
    n = lambda cond: F.count(F.when(cond, 1))
    return risks.groupBy(*keys).agg(
        F.count("*").alias("total"), *[n(F.col("risk_level") == name).alias(f"{name}_count") for name, *_ in dims.LEVELS], *[n(F.col("category") == c).alias(f"category_{c}") for c in dims.CATEGORIES], F.coalesce(F.round(F.avg(score), 2), F.lit(0.0)).alias("risk_score"), F.coalesce(F.max(score), F.lit(0)).alias("max_score")
    )


def level_shares(risks: DataFrame) -> DataFrame:
    counts = risks.groupBy("risk_level").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(risks.agg(F.count("*").alias("total")))).select("risk_level", "n", F.round(F.col("n") / F.col("total") * 100, 1).alias("share_pct"))


def recommendations(risks: DataFrame, *, per_risk: int = 2, cap: int = 15, lang: str = "en") -> DataFrame:
    """place, text: the first mitigations of critical, then high risks; a text counts once, where first seen. A report of cap lines."""
    rank = level_rank(F.col("risk_level"))
    rows = risks.where(F.col("risk_level").isin("critical", "high")).select(rank.alias("rank"), "score", "risk_id", F.posexplode(F.slice(f"mitigation_{lang}", 1, per_risk)).alias("p", "text"))
    seen = rows.groupBy("text").agg(F.min(F.struct((-F.col("rank")).alias("r"), (-F.col("score")).alias("s"), "risk_id", "p")).alias("o"))
    return seen.orderBy("o").limit(cap).select(F.row_number().over(Window.orderBy("o")).alias("place"), "text")


def medium_low_table(risks: DataFrame) -> DataFrame:
    """Medium, then low: title of 80 characters, score out of 25."""
    return risks.where(F.col("risk_level").isin("medium", "low")).orderBy(F.desc(level_rank(F.col("risk_level"))), F.desc("score"), "risk_id").select("risk_id", "risk_level", "category", F.substring("title_en", 1, 80).alias("title"), F.format_string("%d/25", "score").alias("score_text"))


def top_patterns(patterns: DataFrame, k: int = 3, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return patterns.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("occurrence_count"), "pattern"))).where(F.col("rn") <= k).drop("rn")
