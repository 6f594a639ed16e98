"""Compositions that users call: each takes tables of any number of wells and gives tables by well."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scalars import coerce_number
from ..operators import completions, history, hse, logs, match, production, quality, risk, survey
from . import dims, runs


def readable(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, status) of files (path, and content or text). A file without text, or whose content isn't UTF-8, is a status row with its error and no
    document, and the others go on; status has a row for every file."""
    text = F.try_validate_utf8(F.col("content").cast("string")) if "content" in files.columns else F.col("text")
    told = files.select(F.col("path").alias("file_id"), text.alias("text"), *([F.col("content").isNull().alias("empty")] if "content" in files.columns else [F.lit(True).alias("empty")]))
    error = F.when(F.col("text").isNull(), F.when(F.col("empty"), "no content").otherwise("content is not UTF-8 text"))
    status = told.select("file_id", F.when(error.isNull(), "success").otherwise("error").alias("status"), error.alias("error"))
    return told.where("text is not null").select("file_id", "text"), status


def process_files(files: DataFrame, projects: DataFrame | None = None) -> dict[str, DataFrame]:
    """files (path, and text or content): documents with their discipline, found values (entities: a column for each field, values: a row for each found one), events,
    sections, range flags, project, and the status of every file."""
    docs, status = readable(files)
    entities = T.extract_entities(docs)
    values = T.bucket_entities(entities)
    out = {
        "status": status, "entities": entities,
        "disciplines": T.classify_discipline(docs).drop("text"), "values": values, "context": T.entity_context(docs), "npt": T.extract_npt_events(docs), "bha": T.extract_bha(docs), "casing": T.extract_casing_points(docs),
        "flags": quality.range_checks(values.select("file_id", "field", F.col("number").alias("value")), keys=("file_id",)),
    }
    if projects is not None:
        known = entities.select("file_id", *[c for c in ("api", "well_name", "field", "operator") if c in projects.columns])
        out["projects"] = match.best_project(match.project_match(known, projects))
    return out


def analyze_drilling(docs: DataFrame, current: DataFrame | None = None, pad_history: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(KPIs by well, flags) from report texts (file_id, well_id, text); with pad history also predictions. A field's value is that of the last file that tells it; a well
    without values and lost time has no row. Fields stay columns, so patterns of fields that nobody selects are not tried."""
    keep, patterns = ("well_id", "file_id"), {f: (d, p) for f, (d, p) in dims.ENTITIES.items() if d == "drilling"}
    values = T.bucket_entities(T.extract_entities(docs, keep=keep), keep).where("domain = 'drilling'")
    any_value = lambda x: reduce(or_, [T.entity(x, p) != "" for _, p in patterns.values()])  # noqa: E731 - ends at the first field found
    told = F.exists(F.array("text"), any_value)  # of a variable: patterns that the columns share would make Spark's planning very long
    found = T.extract_entities(docs.select(*keep, "text", told.alias("told")), patterns, keep=(*keep, "told"))
    last = lambda f: F.max_by(f, F.when(F.col(f).isNotNull(), F.col("file_id")))
    kpis = found.groupBy("well_id").agg(F.max("told").alias("told"), *[last(f).alias(f) for f in patterns]).where("told").drop("told")
    kpis = kpis.withColumns({f: coerce_number(F.col(f)) for f in patterns if f not in dims.TEXT_FIELDS})
    npt = hse.npt_total(T.extract_npt_events(docs, keep=keep))
    kpis = kpis.withColumnRenamed("npt_hours", "npt_stated").join(npt, "well_id", "full_outer").withColumn("npt_hours", F.coalesce("npt_hours", "npt_stated"))
    flags = quality.range_checks(values.select("well_id", "field", F.col("number").alias("value"))).withColumn("domain", F.lit("drilling"))
    if current is not None and pad_history is not None:
        found = match.predictive_flags(match.pad_history_risks(current, pad_history))
        told = current.select("query_id", "well_id").join(found, "query_id").select("well_id", "code", "message", F.lit("drilling").alias("domain"))
        flags = flags.unionByName(told, allowMissingColumns=True)
    return kpis, flags


def analyze_logs(samples: DataFrame, **cutoffs) -> tuple[DataFrame, DataFrame]:
    """(KPIs by well, pay intervals) from samples (well_id, depth, mnemonic, value)."""
    pay = logs.pay_intervals(logs.log_table(samples), **cutoffs)
    names = samples.groupBy("well_id").agg(F.collect_set("mnemonic").alias("curves"), F.max("depth").alias("max_depth"))
    kpis = names.join(logs.net_pay_summary(pay), "well_id", "left").withColumn("pay_zone_count", F.coalesce("pay_zone_count", F.lit(0)))
    return kpis.join(logs.missing_curves(samples), "well_id", "left"), pay


def analyze_completions(stages: DataFrame, headers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(KPIs by well, flags) from stages and, if there are any, stated stage counts (well_id, stage_count)."""
    kpis = completions.stage_summary(stages)
    flags = completions.isip_check(stages).withColumn("domain", F.lit("completions"))
    if headers is not None:
        flags = flags.unionByName(completions.stage_count_check(headers, kpis).withColumn("domain", F.lit("completions")), allowMissingColumns=True)
        kpis = kpis.join(headers, "well_id", "left")
    return kpis, flags


def analyze_production(series: DataFrame) -> tuple[DataFrame, DataFrame]:
    return production.ip_metrics(series), production.gor_breakthrough(series).withColumn("domain", F.lit("production"))


def analyze_directional(stations: DataFrame, tie: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(KPIs by well, flags, trajectory)."""
    traj = survey.minimum_curvature(survey.stations(stations), tie=tie)
    return survey.trajectory_summary(traj), survey.survey_anomalies(traj, tie=tie).withColumn("domain", F.lit("directional")), traj


def analyze_hse(docs: DataFrame, manhours: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(KPIs by well, events) from texts (file_id, well_id, text)."""
    events = T.extract_hse_events(docs, keep=("well_id", "file_id"))
    kpis = hse.hse_summary(events, manhours).withColumns({c: F.coalesce(F.try_element_at("counts", F.lit(c)), F.lit(0)) for c in ("fatality", "lti")})
    near = events.groupBy("well_id").agg(F.count(F.when((F.col("severity") == "near_miss") & F.col("sif_potential"), 1)).alias("sif_near_miss"))
    listed = risk.top_patterns(T.recurring_patterns(events)).groupBy("well_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("occurrence_count")).alias("o"), "pattern"))), lambda x: x["pattern"]).alias("patterns"))
    return kpis.withColumnRenamed("npt_hours", "hse_npt_hours").join(near, "well_id", "left").join(listed, "well_id", "left"), events


def cross_domain(drilling: DataFrame, log_kpis: DataFrame, completion_kpis: DataFrame) -> DataFrame:
    """Flags that compare domains."""
    depth = drilling.select("well_id", F.coalesce("measured_depth_m", "current_depth_m", "measured_depth_ft", "current_depth_ft").alias("depth")).where("depth is not null")
    return quality.depth_mismatch(depth, log_kpis.select("well_id", "max_depth")).unionByName(quality.under_stimulation(completion_kpis, log_kpis.select("well_id", "pay_zone_count"))).withColumn("domain", F.lit("report"))


def well_performance(*, docs: DataFrame, stations: DataFrame, samples: DataFrame, series: DataFrame, stages: DataFrame, tie: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """All domains, cross-checks and risks: features (one row for each well), flags, risks."""
    drilling, f1 = analyze_drilling(docs)
    log_kpis, _ = analyze_logs(samples)
    comp, f2 = analyze_completions(stages)
    prod, f3 = analyze_production(series)
    direct, f4, _ = analyze_directional(stations, tie)
    safety, _ = analyze_hse(docs)
    features = match.merge_domains([drilling, log_kpis, comp, prod, direct, safety])
    flags = quality.collect_flags(f1, f2, f3, f4, cross_domain(drilling, log_kpis, comp))
    return {"features": features, "flags": flags, "risks": risk.score_risks(features, flags)}


def full_run(spark: SparkSession, path: str, task_id: str, *, docs: DataFrame, stations: DataFrame, samples: DataFrame, series: DataFrame, stages: DataFrame, tie: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(status of every domain, KPIs as rows task_id, domain, well_id, field, value as text) of all domains under one task; a domain that fails is a status row, the others
    go on, and the next run with this path and task works out only what is missing."""
    jobs = {
        "drilling": lambda: analyze_drilling(docs)[0], "logs": lambda: analyze_logs(samples)[0], "completions": lambda: analyze_completions(stages)[0], "production": lambda: analyze_production(series)[0],
        "directional": lambda: analyze_directional(stations, tie)[0], "hse": lambda: analyze_hse(docs)[0],
    }

    def long(kpis: DataFrame) -> DataFrame:
        text = lambda f: F.to_json(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name).cast("string")
        cells = F.array(*[F.struct(F.lit(f.name).alias("field"), text(f).alias("value")) for f in kpis.schema.fields if f.name != "well_id"])
        return kpis.select(F.col("well_id").cast("string").alias("well_id"), F.inline(cells)).where("value is not null")

    status = runs.run_domains(spark, path, task_id, {d: (lambda job=job: long(job())) for d, job in jobs.items()})
    return status, runs.results(spark, path, task_id)


def qa_report(result: dict[str, DataFrame]) -> DataFrame:
    """The scorecard of each well as a text."""
    return quality.qa_document(result["features"], result["flags"])


def pad_analysis(features: DataFrame, wells: DataFrame) -> DataFrame:
    """wells: well_id, pad_id."""
    joined = features.join(wells, "well_id")
    named = joined if "stage_count" in joined.columns else joined.withColumnRenamed("stage_count_actual", "stage_count")
    return history.pad_summary(named)


DOMAINS = ("data_manager", "drilling", "logs", "completions", "production", "directional", "hse")


def well_report(identity: DataFrame, results: DataFrame, flags: DataFrame, files: DataFrame | None = None, *, most: int = 20) -> DataFrame:
    """well_id, report: a document for each well, its parts in fixed order.

    identity: well_id and any of well_name, api, operator, field, rig_name. results: well_id, domain, status, summary; skipped and failed domains and empty
    summaries have no section, but count. flags: well_id, domain, code, message; the first `most` are written, the rest counted. files: well_id, files (how many were read)."""
    known = set(identity.columns)
    order = F.array_position(F.array(*map(F.lit, DOMAINS)), F.col("domain"))
    shown = (order > 0) & ~F.col("status").isin("skipped", "error") & (F.coalesce("summary", F.lit("")) != "")
    section = F.concat(F.lit("["), F.upper(F.replace("domain", F.lit("_"), F.lit(" "))), F.lit("]\n"), "summary", F.lit("\n"))
    told = results.groupBy("well_id").agg(F.array_sort(F.collect_list(F.when(shown, F.struct(order.alias("o"), section.alias("text"))))).alias("sections"), F.count_if(F.col("status") == "success").alias("active"), F.count("*").alias("run"))
    previews = quality.flag_preview(flags, most=most).select("well_id", "preview", "more")
    x = identity.join(told, "well_id", "left").join(previews, "well_id", "left")
    x = x.withColumn("files", F.lit(0).cast("long")) if files is None else x.join(files, "well_id", "left")
    name = F.coalesce("well_name", F.lit("Unknown Well")) if "well_name" in known else F.lit("Unknown Well")
    head = F.concat(F.lit("WELL REPORT — "), name, F.coalesce(F.concat(F.lit(" ("), "api", F.lit(")")), F.lit("")) if "api" in known else F.lit(""))
    fields = [F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{label}: "), c)) for c, label in (("operator", "Operator"), ("field", "Field"), ("rig_name", "Rig Name")) if c in known]
    n = F.coalesce(F.size("preview"), F.lit(0)) + F.coalesce("more", F.lit(0))
    listed = F.concat(F.format_string("QUALITY FLAGS (%d total)\n", n), F.lit("-" * 40 + "\n"), F.array_join(F.transform("preview", lambda m: F.concat(F.lit("  "), m)), "\n"), F.when(F.col("more") > 0, F.format_string("\n  ... and %d more", "more")).otherwise(F.lit("")))
    counts = [F.lit(""), F.format_string("Files processed: %d", F.coalesce("files", F.lit(0))), F.format_string("Domains succeeded: %d/%d", F.coalesce("active", F.lit(0)), F.coalesce("run", F.lit(0)))]
    return x.select("well_id", F.concat_ws("\n", head, F.lit("=" * 60), *fields, F.lit(""), F.when(F.size("sections") > 0, F.array_join(F.transform("sections", lambda s: s["text"]), "\n")), F.when(n > 0, listed), *counts).alias("report"))


def end_of_well(identity: DataFrame, results: DataFrame, flags: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """well_id, report: the well's report, then a lesson for each kind of flag (the first message of 120 characters, kinds in order), and the run's counts."""
    lessons = quality.flag_digest(flags.withColumn("seq", F.col("message"))).groupBy("well_id").agg(F.array_sort(F.collect_list(F.format_string("  %s: %s", "code", "first_message"))).alias("lessons"))
    ended = results.groupBy("well_id").agg(F.count_if(F.col("status") == "error").alias("failed"))
    x = well_report(identity, results, flags, files).join(lessons, "well_id", "left").join(ended, "well_id", "left")
    learnt = F.when(F.size("lessons") > 0, F.concat(F.lit("\nLESSONS LEARNED / OBSERVATIONS\n" + "-" * 40 + "\n"), F.array_join("lessons", "\n")))
    return x.select("well_id", F.concat_ws("\n", "report", F.lit("\nEND-OF-WELL SUMMARY"), F.lit("=" * 60), learnt, F.format_string("Domains failed: %d", F.coalesce("failed", F.lit(0)))).alias("report"))


def compare_wells(metrics: DataFrame, wells: list[str], well: str = "well_name") -> dict[str, DataFrame]:
    chosen = metrics.where(F.col(well).isin(wells))
    return {"matrix": history.comparison_matrix(chosen, wells, well), "levels": history.risk_level_comparison(chosen, well), "radar": history.radar(chosen, (well,))}


def risk_analysis(features: DataFrame, flags: DataFrame, *, detected_at: str | None = None) -> dict[str, DataFrame]:
    """All rules on all wells: the registry, and its summary for each well."""
    risks = risk.score_risks(features, flags, detected_at=detected_at)
    return {"risks": risks, "summary": risk.risk_summary(risks.withColumn("well_id", F.explode("linked_wells")), ("well_id",))}


def risk_report(risks: DataFrame, flags: DataFrame, lang: str = "en") -> dict[str, DataFrame]:
    return {"summary": risk.risk_summary(risks), "shares": risk.level_shares(risks), "matrix": risk.explode_matrix(risks), "critical": risk.critical_risks(risks), "recommendations": risk.recommendations(risks, lang=lang), "others": risk.medium_low_table(risks), "appendix": quality.flag_preview(flags)}
