"""Range rules, cross-domain checks, flags, QA scorecards. Flags are rows (well_id, domain, code, value, position, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import dims

KEYS = ("well_id",)


def unpivot(df: DataFrame, keys: tuple[str, ...], fields: list[str]) -> DataFrame:
    """keys, field, value."""
    return df.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value")) for c in fields])))


def range_checks(values: DataFrame, rules: list[tuple] | None = None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, field, value, code, message for values (keys, field, value) outside a rule whose key is contained in the field's name."""
    found = F.array_compact(F.array(*[F.when(F.contains(F.lower("field"), F.lit(k)) & ~F.col("value").between(float(a), float(b)), F.struct(F.lit(k).alias("rule"), F.lit(m).alias("message"))) for k, a, b, m in (rules or dims.RANGES)]))
    return values.where("value is not null").select(*keys, "field", "value", F.inline(found)).withColumn("code", F.lit("RANGE"))


def tvd_exceeds_md(df: DataFrame, pairs: list[tuple[str, str]] = (("tvd_ft", "measured_depth_ft"), ("tvd_m", "measured_depth_m")), keys: tuple[str, ...] = KEYS) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(F.col(t) > F.col(m), F.struct(F.lit(t).alias("field"), F.col(t).cast("double").alias("value"))) for t, m in pairs]))
    return df.select(*keys, F.inline(found)).withColumn("code", F.lit("TVD_EXCEEDS_MD"))


def depth_mismatch(drilling: DataFrame, logs: DataFrame, keys: tuple[str, ...] = KEYS, share: float = 0.10) -> DataFrame:
    both = drilling.join(logs, list(keys))
    gap = F.abs(F.col("max_depth") - F.col("depth")) / F.greatest(F.col("depth"), F.lit(1.0))
    return both.where(gap > share).select(*keys, F.lit("DEPTH_MISMATCH").alias("code"), F.round(gap * 100, 1).alias("value"))


def under_stimulation(completions: DataFrame, logs: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    both = completions.join(logs, list(keys))
    return both.where(F.col("stage_count_actual") < 0.5 * F.col("pay_zone_count")).select(*keys, F.lit("UNDER_STIMULATION").alias("code"), F.col("stage_count_actual").cast("double").alias("value"))


def suitable_for(df: DataFrame, needs: dict[str, tuple[str, int]], text: str = "text") -> DataFrame:
    """df with ok_<domain>: at least so many terms of a lexicon occur. needs: domain -> (lexicon name, count)."""
    from ..functions.text import hits

    return df.select("*", *[(hits(F.lower(F.coalesce(text, F.lit(""))), dims.DISCIPLINES[name]) >= n).alias(f"ok_{d}") for d, (name, n) in needs.items()])


def collect_flags(*parts: DataFrame) -> DataFrame:
    """All flags in one table, the text under its domain's bracket (not doubled)."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    tag = F.concat(F.lit("["), F.col("domain"), F.lit("] "))
    text = F.coalesce(F.col("message") if "message" in every.columns else F.lit(None), F.col("code"))
    return every.withColumn("message", F.when(text.startswith("["), text).otherwise(F.concat(F.coalesce(tag, F.lit("")), text)))


def flag_preview(flags: DataFrame, keys: tuple[str, ...] = KEYS, most: int = 20, order: tuple[str, ...] = ("domain", "code", "message")) -> DataFrame:
    """keys, preview, more: the first flags and how many follow."""
    w = Window.partitionBy(*keys)
    x = flags.withColumns({"rn": F.row_number().over(w.orderBy(*order)), "n": F.count("*").over(w)}).where(F.col("rn") <= most)
    return x.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "message"))), lambda s: s["message"]).alias("preview"), F.greatest(F.max("n") - most, F.lit(0)).alias("more"))


def flag_digest(flags: DataFrame, keys: tuple[str, ...] = KEYS, order: str = "seq") -> DataFrame:
    """keys, code, first_message, n: one line for each code."""
    return flags.groupBy(*keys, "code").agg(F.substring(F.min_by("message", order), 1, 120).alias("first_message"), F.count("*").alias("n"))


def cap_per_group(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], most: int | None = None) -> DataFrame:
    """A limit for each group where one is wanted; none by default."""
    return df if most is None else df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rn") <= most).drop("rn")


def scorecard(checked: DataFrame, checks: dict[str, dict[str, Column]], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, domain (null: overall), passed, total, pct, status from boolean columns by domain; null counts as not passed."""
    rows = F.array(*[F.struct(F.lit(d).alias("domain"), F.lit(n).alias("check"), F.coalesce(c, F.lit(False)).alias("ok")) for d, group in checks.items() for n, c in group.items()])
    out = checked.select(*keys, F.inline(rows)).rollup(*keys, "domain").agg(F.sum(F.col("ok").cast("long")).alias("passed"), F.count("*").alias("total"), F.grouping_id().alias("g")).where("g <= 1").drop("g")
    pct = F.bround(F.col("passed") / F.col("total") * 100, 0).cast("int")
    return out.withColumn("pct", pct).withColumn("status", F.when(F.col("pct") >= 80, "PASS").when(F.col("pct") >= 50, "WARN").otherwise("FAIL"))


def qa_checks(wells: DataFrame, flags: DataFrame, keys: tuple[str, ...] = KEYS) -> tuple[DataFrame, dict[str, dict[str, Column]]]:
    """(wells with their flags' codes, the 26 checks of the six domains as conditions on them); absent columns count as missing."""
    has = lambda *cols: F.coalesce(reduce(lambda a, b: a | b, [F.coalesce(F.col(c).isNotNull() & (F.col(c).cast("string") != "") & (F.col(c).cast("string") != "0") & (F.col(c).cast("string") != "0.0"), F.lit(False)) if c in known else F.lit(False) for c in cols]), F.lit(False))
    codes = flags.groupBy(*keys).agg(F.collect_set("code").alias("codes"))
    joined = wells.join(codes, list(keys), "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))
    known = set(joined.columns)
    no = lambda *cs: ~F.arrays_overlap("codes", F.array(*[F.lit(c) for c in cs]))
    zero = lambda c: (F.coalesce(F.col(c), F.lit(0)) == 0) if c in known else F.lit(True)
    in_curves = lambda *m: F.coalesce(F.arrays_overlap("curves", F.array(*[F.lit(x) for x in m])), F.lit(False)) if "curves" in known else F.lit(False)
    checks = {
        "drilling": {"Well name extracted": has("well_name"), "ROP data present": has("rop_ft_hr", "rop_m_hr"), "Mud weight present": has("mud_weight_ppg", "mud_weight_sg"), "Current depth present": has("current_depth_ft", "current_depth_m", "measured_depth_ft", "measured_depth_m"), "NPT logged": has("npt_hours", "npt_events"), "No sanity failures": no("RANGE")},
        "logs": {"GR curve present": in_curves("GR", "SGR"), "Resistivity curve present": in_curves("RT", "RD", "RILD", "ILD"), "Density curve present": in_curves("RHOB", "DEN", "RHOZ"), "Depth range valid": has("max_depth"), "Pay intervals computed": F.col("pay_zone_count").isNotNull() if "pay_zone_count" in known else F.lit(False)},
        "completions": {"Stage count present": has("stage_count", "stage_count_actual"), "Fluid volume present": has("total_fluid"), "Proppant weight present": has("total_proppant"), "ISIP data present": has("max_isip"), "No stage count mismatch": no("STAGE_COUNT_MISMATCH")},
        "production": {"Oil rate data present": has("oil_rate_bopd", "ip30"), "IP30 computed": has("ip30"), "No GOR breakthrough": no("GOR_BREAKTHROUGH")},
        "directional": {"Survey stations present": F.col("stations") >= 3 if "stations" in known else F.lit(False), "No inclination jumps": no("INC_JUMP"), "No high DLS": no("HIGH_DLS"), "No survey gaps": no("SURVEY_GAP")},
        "hse": {"No fatalities": zero("fatality"), "No LTIs": zero("lti"), "SIF potentials reviewed": zero("sif_near_miss")},
    }
    return joined, checks


def qa_scorecard(wells: DataFrame, flags: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The 26 checks of the six domains for wells with the columns of pipelines.well_features."""
    return scorecard(*qa_checks(wells, flags, keys), keys)


def qa_document(wells: DataFrame, flags: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, report: the scorecard of each well as a text, with every check under its domain. Written inside each row, nothing is gathered."""
    joined, checks = qa_checks(wells, flags, keys)
    pct = lambda n, of: F.bround(n / of * 100, 0).cast("int")
    joined = joined.select(*keys, *[F.array(*[F.struct(F.lit(name).alias("name"), F.coalesce(c, F.lit(False)).alias("ok")) for name, c in group.items()]).alias(d) for d, group in checks.items()])
    passed = {d: F.size(F.filter(d, lambda x: x["ok"])) for d in checks}
    parts = []
    for d, group in checks.items():
        share = pct(passed[d], len(group))
        status = F.when(share >= 80, "PASS").when(share >= 50, "WARN").otherwise("FAIL")
        parts += [F.lit(""), F.concat(F.lit(f"[{d.upper()}] "), status, F.format_string(f" (%d/{len(group)} checks — %d%%)", passed[d], share)), F.array_join(F.transform(d, lambda x: F.concat(F.when(x["ok"], "  ✓ ").otherwise("  ✗ "), x["name"])), "\n")]
    total, score = sum(map(len, checks.values())), sum(passed.values(), F.lit(0))
    return joined.select(*keys, F.concat_ws("\n", F.lit("QA SCORECARD"), F.lit("=" * 60), F.format_string(f"OVERALL: %d/{total} (%d%%)", score, pct(score, total)), *parts).alias("report"))


def run_status(results: DataFrame, keys: tuple[str, ...] = ("task_id",)) -> DataFrame:
    """keys, succeeded, failed, active from rows with a status."""
    n = lambda *s: F.count(F.when(F.col("status").isin(*s), 1))
    return results.groupBy(*keys).agg(n("success", "partial").alias("succeeded"), n("error").alias("failed"), n("success").alias("active"))


def aggregate_confidence(results: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return results.groupBy(*keys).agg(F.round(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))), 3).alias("confidence"))


def column_stats(cells: DataFrame, keys: tuple[str, ...] = ("file_id", "col_name")) -> DataFrame:
    v = F.col("value").try_cast("double")
    return cells.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.round(F.avg(v), 4).alias("mean"))
