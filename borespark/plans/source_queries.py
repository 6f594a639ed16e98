"""Registered queries for readers, writers and whole analyses: log, table and report texts are written by Spark from table rows and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import match
from ..sources import files, scratch, sinks
from . import dims, pipelines
from .registry import ORACLES, RISKS, STAGES, SURVEY, query, ranked_logs, risks, samples, series, stages, stations, table
from .rule_queries import report_texts

_LAS = "(case when cast(json_extract_string(props, '$.k') as int) = 0 then null else floor(value) end)::double"


def log_texts(spark, d, named: bool = False) -> DataFrame:
    """A log file for each well: depth, GR (the null value where k is 0) and RT. named: its header tells the well."""
    x = ranked_logs(spark, d).select("well_id", "depth", F.concat_ws(" ", F.col("depth").cast("int"), F.when(F.col("rt") == 0, "-999.25").otherwise(F.floor("gr").cast("string")), F.col("rt").cast("int")).alias("line"))
    rows = x.groupBy("well_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "line"))), lambda r: r["line"]), "\r\n").alias("rows"), F.max("depth").alias("stop"))
    well = F.concat(F.lit("WELL. "), F.col("well_id").cast("string"), F.lit(" : well\n")) if named else F.lit("")
    head = F.concat(F.lit("~Version\nVERS. 2.0 : CWLS\n~Well\n"), well, F.lit("STRT.M 1 : start\nSTOP.M "), F.col("stop").cast("int").cast("string"), F.lit(" : stop\nNULL. -999.25 : null\n# remark\n~Curve\nDEPT.M : depth\nGR.API : gamma ray\nRT.OHMM : resistivity\n~A\n"))
    return rows.select("well_id", F.concat(head, "rows").alias("text"))


@query(f"with e as (select user_id well_id, (row_number() over (partition by user_id order by ts, event_id))::double depth, {_LAS} gr, cast(json_extract_string(props, '$.k') as double) rt from events) select well_id, depth, mnemonic, \"value\" from (select well_id, depth, unnest(['DEPT', 'GR', 'RT']) mnemonic, unnest([depth, gr, rt]) \"value\" from e)")
def las_samples(spark, d):
    return files.las_tables(log_texts(spark, d), ("well_id",))[2]


@query("with e as (select user_id well_id, count(*) n from events group by 1) select well_id, unnest(['STRT', 'STOP', 'NULL']) \"key\", unnest(['M', 'M', null]) unit, unnest(['1', n::varchar, '-999.25']) \"value\" from e")
def las_header(spark, d):
    return files.las_tables(log_texts(spark, d), ("well_id",))[0]


@query("with o as (select o_custkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 row_no, o_orderkey, o_orderpriority from orders) select o_custkey, row_no::int row_no, col_no, col_name, unit, \"value\" from (select o_custkey, row_no, unnest([0, 1, 2]) col_no, unnest(['Depth', 'Rate', 'Note']) col_name, unnest(['ft', 'bopd', null]) unit, unnest([o_orderkey::varchar, (o_orderkey % 7)::varchar, o_orderpriority]) \"value\" from o)")
def delimited_cells(spark, d):
    """A table file for each customer, its delimiter by key; a unit row below the header."""
    sep = F.element_at(F.array(F.lit(","), F.lit("\t"), F.lit("|"), F.lit(";")), (F.col("o_custkey") % 4 + 1).cast("int"))
    line = F.concat(F.col("o_orderkey").cast("string"), sep, (F.col("o_orderkey") % 7).cast("string"), sep, F.lit('"'), F.col("o_orderpriority"), F.lit('"'))
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))), lambda r: r["line"]), "\n").alias("rows"))
    text = F.concat(F.lit("Depth"), sep, F.lit("Rate"), sep, F.lit("Note\nft"), sep, F.lit("bopd"), sep, F.lit("\n\n"), "rows")
    return files.delimited_cells(rows.select("o_custkey", text.alias("text")), ("o_custkey",))


@query(ORACLES["las_samples"])
def las_files(spark, d):
    """The same logs in files, one behind another, so that the number of files follows their bytes and not the wells; many tasks read them in blocks."""
    folder = scratch.new_folder(spark)
    log_texts(spark, d, named=True).select("text").write.text(folder)
    return files.read_las_bundles(spark, folder, ("WELL",))[2].select(F.col("WELL").cast("long").alias("well_id"), "depth", "mnemonic", "value")


@query("with o as (select o_orderkey % 20 sheet, row_number() over (partition by o_orderkey % 20 order by o_orderkey) - 1 row_no, o_orderkey, o_orderpriority from orders) select sheet, row_no, col_no, col_name, unit, \"value\" from (select sheet, row_no, unnest([0, 1, 2]) col_no, unnest(['Depth', 'Rate', 'Note']) col_name, unnest(['ft', 'bopd', null]) unit, unnest([o_orderkey::varchar, (o_orderkey % 7)::varchar, o_orderpriority]) \"value\" from o)")
def delimited_files(spark, d):
    """Twenty table files, each with its own delimiter, read in blocks."""
    folder, sheet = scratch.new_folder(spark), F.col("o_orderkey") % 20
    sep = F.element_at(F.array(F.lit(","), F.lit("\t"), F.lit("|"), F.lit(";")), (sheet % 4 + 1).cast("int"))
    line = F.concat(F.col("o_orderkey").cast("string"), sep, (F.col("o_orderkey") % 7).cast("string"), sep, F.lit('"'), F.col("o_orderpriority"), F.lit('"'))
    rows = table(spark, d, "orders").select(sheet.alias("sheet"), F.col("o_orderkey").alias("at"), line.alias("line"))
    heads = rows.select("sheet").distinct().withColumn("o_orderkey", F.col("sheet")).select("sheet", F.lit(-1).cast("long").alias("at"), F.concat(F.lit("Depth"), sep, F.lit("Rate"), sep, F.lit("Note\nft"), sep, F.lit("bopd"), sep, F.lit("\n")).alias("line"))
    rows.unionByName(heads).repartition(20, "sheet").sortWithinPartitions("sheet", "at").select("sheet", "line").write.partitionBy("sheet").text(folder)
    found = files.read_delimited(spark, folder)
    return found.select(F.regexp_extract("file_id", r"sheet=(\d+)", 1).cast("long").alias("sheet"), "row_no", "col_no", "col_name", "unit", "value")


_TYPES = [("well.las", "x", "las_well_log", 0.99), ("log.dat", "~Version 2.0", "las_well_log", 0.95), ("frame.bin", "xx DLIS", "dlis_log_container", 0.80), ("book.xlsx", "x", "spreadsheet", 0.99), ("rates.csv", "x", "csv_data", 0.99), ("site.xml", "<WITSML version>", "witsml_export", 0.90), ("other.xml", "<a/>", "xml_document", 0.70), ("notes.txt", "x", "text_file", 0.85), ("what", "x", "unknown", 0.10)]


@query("select doc_id, t.kind detected_type, t.sure confidence from (select doc_id, [" + ", ".join(f"{{'kind': '{k}', 'sure': {c}::double}}" for _, _, k, c in _TYPES) + f"][doc_id % {len(_TYPES)} + 1] t from documents)")
def detect_file_content(spark, d):
    """Types from names and first bytes: each document behind a head of one kind."""
    kind = F.element_at(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(h).alias("head")) for n, h, _, _ in _TYPES]), (F.col("doc_id") % len(_TYPES) + 1).cast("int"))
    x = table(spark, d, "documents").withColumn("k", kind)
    text = F.when(F.col("k.head") == "x", "x").otherwise(F.concat("k.head", F.lit("\n"), F.coalesce("text", F.lit(""))))
    return files.detect_file_type(x.select("doc_id", F.concat(F.lit("in/"), F.col("doc_id").cast("string"), F.lit("/"), "k.name").alias("path"), text.cast("binary").alias("content"))).select("doc_id", "detected_type", "confidence")


@query("select o_orderkey::varchar path, 'FILE_NOT_FOUND' code from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'A')")
def missing_inputs(spark, d):
    asked = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"))
    return files.missing_inputs(asked, table(spark, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").cast("string").alias("path")))


@query("select o_orderkey path, o_orderdate \"modificationTime\" from orders where o_orderstatus <> 'F' or o_orderkey % 2 = 1")
def unprocessed_files(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderdate").alias("modificationTime"), "o_orderstatus")
    return files.unprocessed_files(o.drop("o_orderstatus"), o.where("o_orderstatus = 'F' and path % 2 = 0").drop("o_orderstatus"))


_REGISTRY = "linked_wells array<bigint>, linked_pads array<string>, mitigation_en array<string>, title_en string, title_ru string"


def registry(spark, d) -> DataFrame:
    empty = {c: F.lit(None).cast(t) for c, t in (x.split(" ") for x in _REGISTRY.split(", "))}
    return risks(spark, d).withColumns(empty | {"linked_wells": F.array("well"), "title_en": F.concat(F.lit("Order "), "risk_id")}).drop("well")


@query(RISKS + "select well, count(*) total, count(*) filter (risk_level = 'critical') critical, count(*) filter (risk_level = 'low') low, arg_max(risk_id, (score, -cast(substr(risk_id, 2) as bigint))) first_risk from r group by 1")
def registry_documents(spark, d):
    """One record for each well, risks by falling score."""
    x = sinks.registry_documents(registry(spark, d).select("risk_id", "score", "risk_level", "linked_wells"))
    return x.select("well", "summary.total", "summary.critical", "summary.low", F.col("risks")[0]["risk_id"].alias("first_risk"))


@query(RISKS + "select risk_id, category, risk_level, 'Order ' || risk_id title_en, well::varchar linked_wells from r")
def registry_rows(spark, d):
    return sinks.registry_rows(registry(spark, d)).select("risk_id", "category", "risk_level", "title_en", "linked_wells")


# ------------------------------------------------------------------ whole analyses


@query("select c_custkey::varchar well_id, concat('BORE-', c_custkey) well_name, case when c_custkey % 2 = 0 then 50 + c_custkey % 60 end::double rop_ft_hr, case when c_custkey % 2 = 1 then 1 + (10 + c_custkey % 80) / 100.0 end::double mud_weight_sg, case when c_custkey % 3 > 0 then c_custkey % 24 + 0.5 end::double npt_hours from customer")
def analyze_drilling(spark, d):
    docs = report_texts(spark, d).select(F.col("c_custkey").cast("string").alias("well_id"), F.col("c_custkey").alias("file_id"), "text")
    return pipelines.analyze_drilling(docs)[0].select("well_id", "well_name", "rop_ft_hr", "mud_weight_sg", F.round("npt_hours", 3).alias("npt_hours"))


@query("with l as (select user_id well_id, cast(row_number() over (partition by user_id order by ts, event_id) as double) depth, value < 75 and cast(json_extract_string(props, '$.k') as int) > 10 pay from events), i as (select *, row_number() over (partition by well_id order by depth) - row_number() over (partition by well_id, pay order by depth) island from l), p as (select well_id, max(depth) - min(depth) net from i where pay group by well_id, island having max(depth) - min(depth) > 1), s as (select well_id, round(sum(net), 1) total, count(*) n from p group by 1) select well_id, 'GR,RT' curves, max(depth) max_depth, max(total) total_net_pay, coalesce(max(n), 0)::bigint pay_zone_count from l left join s using (well_id) group by 1")
def analyze_logs(spark, d):
    x = ranked_logs(spark, d).select("well_id", "depth", F.inline(F.array(F.struct(F.lit("GR").alias("mnemonic"), F.col("gr").alias("value")), F.struct(F.lit("RT").alias("mnemonic"), F.col("rt").alias("value")))))
    return pipelines.analyze_logs(x)[0].select("well_id", F.array_join(F.array_sort("curves"), ",").alias("curves"), "max_depth", "total_net_pay", "pay_zone_count")


@query(STAGES + ", k as (select well_id, count(*) n from s group by 1) select code, count(*) n from (select 'ISIP_RANGE' code from s where isip < 1000 or isip > 20000 union all select 'STAGE_COUNT_MISMATCH' from k join orders on o_orderkey = well_id where abs(o_orderkey % 7 - n) > 2) group by 1")
def analyze_completions(spark, d):
    stated = table(spark, d, "orders").select(F.col("o_orderkey").alias("well_id"), (F.col("o_orderkey") % 7).alias("stage_count"))
    return pipelines.analyze_completions(stages(spark, d), stated)[1].groupBy("code").agg(F.count("*").alias("n"))


@query(SURVEY + ", a as (select well_id, count(*) filter (d_inc > 5) jumps, count(*) filter (dls > 8) high from t group by 1) select t.well_id, count(*) stations, max(dls) max_dls, any_value(jumps) inc_jumps, any_value(high) high_dls from t join a using (well_id) group by 1")
def analyze_directional(spark, d):
    kpis, flags, _ = pipelines.analyze_directional(stations(spark, d), ("event_id",))
    n = lambda code: F.count(F.when(F.col("code") == code, 1))
    counts = flags.groupBy("well_id").agg(n("INC_JUMP").alias("inc_jumps"), n("HIGH_DLS").alias("high_dls"))
    return kpis.join(counts, "well_id", "left").select("well_id", "stations", "max_dls", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("inc_jumps", "high_dls")])


_ANY = lambda terms, c="low": "(" + " or ".join(f"contains({c}, '{t}')" for t in terms) + ")"
_SEVERITY = "case " + " ".join(f"when {_ANY(t)} then '{s}'" for s, t in dims.SEVERITIES.items()) + " else 'unsafe' end"
NOTES = ("Near miss with dropped object", "LTI at the rig floor, injury", "First aid, slip on stairs", "Fatality: struck by vehicle", "H2S alarm, evacuation", "Routine day", "Medical treatment after fall, 3.5 hrs", "Инцидент: травма, первая помощь")
_EVENTS = f"with i as (select o_custkey well_id, lower([{', '.join(f"'{n}'" for n in NOTES)}][o_orderkey % {len(NOTES)} + 1]) low from orders), e as (select well_id, {_SEVERITY} severity, {_ANY(dims.SERIOUS)} sif, case when contains(low, '3.5 hrs') then 3.5::double end lost from i where {_ANY(dims.INCIDENTS)}) "


@query(_EVENTS + "select well_id, count(*) incidents, sum(lost) hse_npt_hours, count(*) filter (sif) sif_count, count(*) filter (severity = 'fatality') fatality, count(*) filter (severity = 'lti') lti, count(*) filter (severity = 'near_miss' and sif) sif_near_miss from e group by 1")
def analyze_hse(spark, d):
    """Incident lines of shift reports, two orders' notes in a customer's each."""
    note = F.element_at(F.array(*map(F.lit, NOTES)), (F.col("o_orderkey") % len(NOTES) + 1).cast("int"))
    docs = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("well_id"), F.floor(F.col("o_orderkey") / 2).alias("file_id")).agg(F.array_join(F.array_sort(F.collect_list(note)), "\r\n").alias("text"))
    return pipelines.analyze_hse(docs)[0].select("well_id", "incidents", "hse_npt_hours", "sif_count", "fatality", "lti", "sif_near_miss")


@query("with m as (select l_suppkey well_id, strftime(l_shipdate, '%Y-%m') period, sum(l_quantity) oil from lineitem group by 1, 2), ip as (select well_id, round(avg(oil) filter (rn <= 30), 1) ip30 from (select *, row_number() over (partition by well_id order by period) rn from m) group by 1), t as (select user_id well_id, round(sum(value), 3) npt_hours from events group by 1) select s_nationkey pad_id, count(*) wells, round(avg(ip30), 1) avg_ip30, round(avg(npt_hours), 1) avg_npt from ip join supplier on s_suppkey = ip.well_id left join t on t.well_id = ip.well_id group by 1")
def pad_analysis(spark, d):
    from ..operators import hse, production

    parts = [production.ip_metrics(series(spark, d)), hse.npt_total(samples(spark, d).withColumnRenamed("value", "duration_hrs"))]
    features = match.merge_domains(parts).where("ip30 is not null").withColumns({"stage_count": F.lit(None).cast("int"), "total_net_pay": F.lit(None).cast("double")})
    wells = table(spark, d, "supplier").select(F.col("s_suppkey").alias("well_id"), F.col("s_nationkey").alias("pad_id"))
    return pipelines.pad_analysis(features, wells).select("pad_id", "wells", "avg_ip30", "avg_npt")
