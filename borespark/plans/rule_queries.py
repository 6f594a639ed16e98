"""Further registered queries: every risk rule, the 26 QA checks, shipped text patterns, report tables and small functions, with SQL twins.

Wells are customers, their flags come from orders; texts are written by Spark from table rows, so that the twin knows what they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as T
from ..operators import completions, history, hse, logs, match, production, quality, risk, survey
from ..sources import scratch
from . import dims, pipelines
from .registry import RISKS, SERIES, SURVEY, query, risks, samples, series, stages, table, trajectory

CODES = ("RANGE", "ISIP_RANGE", "STAGE_COUNT_MISMATCH", "VOLUME", "GOR_BREAKTHROUGH", "HIGH_DLS", "INC_JUMP", "SURVEY_GAP", "DEPTH_MISMATCH", "UNDER_STIMULATION", "PREDICTIVE_RISK", "AZ_JUMP")

#: well columns as expressions that Spark and the twin read alike
WELL = {
    "npt_hours": "cast(floor(c_acctbal / 500) as double)", "pay_zone_count": "c_custkey % 3", "max_dls": "cast(c_custkey % 12 as double)", "fatality": "case when c_custkey % 97 = 0 then 1 else 0 end", "lti": "case when c_custkey % 11 = 0 then 2 else 0 end",
    "sif_count": "c_custkey % 7 - 5", "rop_ft_hr": "nullif(c_custkey % 5, 0)", "mud_weight_sg": "case when c_custkey % 4 > 0 then 1.25 end", "current_depth_m": "c_custkey % 2", "max_depth": "nullif(c_custkey % 13, 0)", "stage_count": "c_custkey % 6",
    "total_fluid": "case when c_acctbal > 0 then c_acctbal end", "total_proppant": "nullif(c_custkey % 3, 1)", "max_isip": "nullif(c_custkey % 9, 0)", "ip30": "nullif(c_custkey % 8, 0)", "stations": "c_custkey % 10", "sif_near_miss": "nullif(c_custkey % 17, 0) - 3",
}
PATTERN_LIST = ("pump", "h2s", "fire", "spill")
_LIST = "[" + ", ".join(f"'{c}'" for c in CODES) + "]"
WELLS = f"""with w as (select cast(c_custkey as varchar) well_id, c_custkey, c_name well_name, c_nationkey, {', '.join(f'{e} {n}' for n, e in WELL.items())} from customer),
f as (select cast(o_custkey as varchar) well_id, {_LIST}[o_orderkey % 12 + 1] code, case when o_orderkey % 2 = 0 then 'mud_weight_ppg' else 'rop_ft_hr' end field, o_orderpriority || ' ' || o_orderkey message from orders)
"""


def wells(spark, d) -> DataFrame:
    c = table(spark, d, "customer")
    empty = F.array().cast("array<string>")
    return c.select(
        F.col("c_custkey").cast("string").alias("well_id"), F.col("c_name").alias("well_name"), F.col("c_nationkey").cast("string").alias("pad_id"), *[F.expr(e).alias(n) for n, e in WELL.items()],
        F.when(F.expr("c_custkey % 2 = 0"), F.array(F.lit("GR"), F.lit("RHOB"))).otherwise(empty).alias("curves"), F.when(F.expr("c_custkey % 5 = 0"), F.array(F.lit("RT"))).otherwise(empty).alias("missing"),
        F.slice(F.array(*map(F.lit, PATTERN_LIST)), F.lit(1), F.expr("cast(c_custkey % 5 as int)")).alias("patterns"),
    )


def well_flags(spark, d) -> DataFrame:
    code = F.element_at(F.array(*map(F.lit, CODES)), F.expr("cast(o_orderkey % 12 + 1 as int)"))
    return table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("well_id"), code.alias("code"), F.expr("case when o_orderkey % 2 = 0 then 'mud_weight_ppg' else 'rop_ft_hr' end").alias("field"), F.concat("o_orderpriority", F.lit(" "), F.col("o_orderkey").cast("string")).alias("message"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_RULES = ", ".join(f"('{k}', {', '.join(_quoted(x) if isinstance(x, str) else str(x) for x in r[:5])}, {len(r[6])})" for k, r in dims.RULES.items())
_FIRST = {"mud": "code = 'RANGE' and contains(field, 'mud_weight')", "isip": "code = 'ISIP_RANGE'", "mismatch": "code in ('STAGE_COUNT_MISMATCH', 'VOLUME')", "gor": "code = 'GOR_BREAKTHROUGH'", "dls": "code = 'HIGH_DLS'", "inc": "code = 'INC_JUMP'", "gap": "code = 'SURVEY_GAP'"}
_EACH = {"K16": "DEPTH_MISMATCH", "K17": "UNDER_STIMULATION", "K18": "PREDICTIVE_RISK"}
FIRED = WELLS + f""", q as (select well_id, {', '.join(f'min(message) filter ({c}) q_{n}' for n, c in _FIRST.items())} from f group by 1),
x as (select coalesce(w.well_id, q.well_id) id, w.* exclude (well_id), q.* exclude (well_id) from w full join q using (well_id)),
fired as (
select id, 'K01' rule_id, printf('%.1f', npt_hours) v, null::varchar quote from x where npt_hours > 10
union all select id, 'K02', printf('%.1f', npt_hours), null from x where npt_hours > 5 and npt_hours <= 10
{' '.join(f"union all select id, '{k}', {v}, q_{n} from x where q_{n} is not null" for k, n, v in (('K03', 'mud', 'null'), ('K06', 'isip', 'null'), ('K07', 'mismatch', 'null'), ('K08', 'gor', 'null'), ('K09', 'dls', "printf('%.2f', max_dls)"), ('K10', 'inc', 'null'), ('K11', 'gap', 'null')))}
union all select id, 'K04', null, null from x where c_custkey % 2 = 0 and pay_zone_count = 0
union all select id, 'K05', 'RT', null from x where c_custkey % 5 = 0
{' '.join(f"union all select id, '{k}', cast({c} as varchar), null from x where {c} > 0" for k, c in (('K12', 'fatality'), ('K13', 'lti'), ('K14', 'sif_count')))}
union all select id, 'K15', p, p from (select id, unnest(list_slice(list_slice(['pump', 'h2s', 'fire', 'spill'], 1, c_custkey % 5), 1, 3)) p from x where c_custkey % 5 > 0)
{' '.join(f"union all select well_id, '{k}', message, message from f where code = '{c}'" for k, c in _EACH.items())}),
rules (rule_id, source_agent, category, probability, impact, title, n) as (values {_RULES}),
r as (select id well_id, fired.rule_id, category, source_agent, replace(title, '{{v}}', coalesce(v, '')) title_en, coalesce(quote, replace(title, '{{v}}', coalesce(v, ''))) description_en, probability, impact, probability * impact score,
case when probability * impact >= 16 then 'critical' when probability * impact >= 9 then 'high' when probability * impact >= 4 then 'medium' else 'low' end risk_level, 'RISK-' || upper(substr(sha256(concat_ws('‖', id, fired.rule_id, coalesce(quote, v))), 1, 8)) risk_id, n mitigations from fired join rules using (rule_id))
"""


def all_risks(spark, d) -> DataFrame:
    return pipelines.risk_analysis(wells(spark, d), well_flags(spark, d))["risks"]


@query(FIRED + "select * from r")
def risk_rules(spark, d):
    """Every rule K01-K18 on every well."""
    return all_risks(spark, d).select(F.col("linked_wells")[0].alias("well_id"), "rule_id", "category", "source_agent", "title_en", "description_en", "probability", "impact", "score", "risk_level", "risk_id", F.size("mitigation_en").alias("mitigations"))


@query(FIRED + "select well_id, count(*) total, count(*) filter (risk_level = 'critical') critical_count, count(*) filter (category = 'hse') category_hse, round(avg(score), 2) risk_score, max(score) max_score from r group by 1")
def risk_analysis(spark, d):
    """Q09: registry summary of every well."""
    return pipelines.risk_analysis(wells(spark, d), well_flags(spark, d))["summary"].select("well_id", "total", "critical_count", "category_hse", "risk_score", "max_score")


_HAS = {
    "drilling": ["true", "coalesce(rop_ft_hr, 0) <> 0", "mud_weight_sg is not null", "current_depth_m <> 0", "npt_hours <> 0", "not list_contains(codes, 'RANGE')"],
    "logs": ["c_custkey % 2 = 0", "false", "c_custkey % 2 = 0", "max_depth is not null", "true"],
    "completions": ["stage_count <> 0", "total_fluid is not null", "coalesce(total_proppant, 0) <> 0", "max_isip is not null", "not list_contains(codes, 'STAGE_COUNT_MISMATCH')"],
    "production": ["ip30 is not null", "ip30 is not null", "not list_contains(codes, 'GOR_BREAKTHROUGH')"],
    "directional": ["stations >= 3", "not list_contains(codes, 'INC_JUMP')", "not list_contains(codes, 'HIGH_DLS')", "not list_contains(codes, 'SURVEY_GAP')"],
    "hse": ["fatality = 0", "lti = 0", "coalesce(sif_near_miss, 0) = 0"],
}
_SUM = {k: " + ".join(f"({c})::int" for c in v) for k, v in _HAS.items()}
_QA = " union all ".join(f"select well_id, '{k}' \"domain\", {s} passed, {len(_HAS[k])} total from j" for k, s in _SUM.items()) + f" union all select well_id, null, {' + '.join(_SUM.values())}, 26 from j"


@query(WELLS + f", c as (select well_id, list(distinct code) codes from f group by 1), j as (select w.*, coalesce(codes, []) codes from w left join c using (well_id)), s as ({_QA}) select well_id, \"domain\", passed::bigint passed, total::bigint total, round_even(passed * 100.0 / total, 0)::int pct, case when round_even(passed * 100.0 / total, 0) >= 80 then 'PASS' when round_even(passed * 100.0 / total, 0) >= 50 then 'WARN' else 'FAIL' end status from s")
def qa_checks(spark, d):
    """The 26 checks of the six domains."""
    return quality.qa_scorecard(wells(spark, d), well_flags(spark, d))


# ------------------------------------------------------------------ report texts

_K, _M = "c_custkey", "c_custkey % 2 = 1"
#: field -> (line of the report with {} for the value, value, condition); values as expressions that Spark and the twin read alike
REPORT = {
    "well_name": ("Well name: {}", "concat('BORE-', c_custkey)", None), "api": ("API: {}", "concat('42-', 100 + c_custkey % 900, '-', 10000 + c_custkey % 90000)", None), "rig_name": ("Rig name: {}", "concat('Rotary ', c_custkey % 9)", None), "operator": ("Operator: {}", "concat('Acme & Co ', c_custkey % 7)", None),
    "field": ("Месторождение: {}", "concat('Delta-', c_custkey % 5)", None), "report_date": ("Report date: {}", "concat('2024-01-', 10 + c_custkey % 20)", None),
    "current_depth_ft": ("Current depth: {} ft", "concat(5 + c_custkey % 9, ',', 100 + c_custkey % 900)", "c_custkey % 2 = 0"), "current_depth_m": ("Глубина забоя: {} м", "concat(1000 + c_custkey % 900, '.5')", _M),
    "measured_depth_ft": ("MD = {} feet", "cast(9000 + c_custkey % 700 as string)", "c_custkey % 2 = 0"), "measured_depth_m": ("МГТ: {} метр", "cast(3000 + c_custkey % 700 as string)", _M), "tvd_ft": ("True vertical depth: {} ft", "cast(8000 + c_custkey % 600 as string)", "c_custkey % 2 = 0"), "tvd_m": ("ТВГ: {} м", "cast(2500 + c_custkey % 600 as string)", _M),
    "rop_ft_hr": ("Avg ROP: {} ft/hr", "cast(50 + c_custkey % 60 as string)", "c_custkey % 2 = 0"), "rop_m_hr": ("Механическая скорость: {} м/ч", "concat(10 + c_custkey % 20, '.25')", _M), "wob_klbs": ("WOB: {} klbs", "cast(20 + c_custkey % 20 as string)", "c_custkey % 2 = 0"), "wob_tons": ("Осевая нагрузка: {} т", "cast(8 + c_custkey % 9 as string)", _M),
    "rpm": ("RPM: {} rpm", "cast(90 + c_custkey % 80 as string)", None), "spp_psi": ("Standpipe pressure: {} psi", "concat(3, ',', 100 + c_custkey % 800)", "c_custkey % 2 = 0"), "spp_kpa": ("Давление на стояке: {} кПа", "cast(20000 + c_custkey % 999 as string)", _M), "flow_rate_gpm": ("Flow rate: {} gpm", "cast(500 + c_custkey % 99 as string)", None),
    "mud_weight_ppg": ("Mud weight: {} ppg", "concat(9 + c_custkey % 5, '.5')", "c_custkey % 2 = 0"), "mud_weight_sg": ("Плотность раствора: {} г/см3", "concat(1, '.', 10 + c_custkey % 80)", _M), "npt_hours": ("NPT (total): {} hrs", "concat(c_custkey % 24, '.5')", "c_custkey % 3 > 0"),
    "stage_count": ("Total stages: {}", "cast(20 + c_custkey % 40 as string)", None), "total_fluid_bbls": ("Total fluid: {} bbls", "concat(100 + c_custkey % 200, ',', 100 + c_custkey % 900)", None), "total_proppant_lbs": ("Масса проппанта: {} т", "cast(500 + c_custkey % 100 as string)", None), "isip_psi": ("ISIP: {} psi", "cast(4000 + c_custkey % 999 as string)", "c_custkey % 5 > 0"),
    "oil_rate_bopd": ("Oil rate: {} bopd", "cast(300 + c_custkey % 700 as string)", None), "gas_rate_mcfd": ("Дебит газа: {} mcf/d", "cast(900 + c_custkey % 99 as string)", None), "water_rate_bwpd": ("Water rate: {} bwpd", "cast(40 + c_custkey % 50 as string)", "c_custkey % 7 > 0"),
}
_TRUTH = ", ".join(f"{f'case when {c} then {v} end' if c else v} {f}" for f, (_, v, c) in ((f, (a, v.replace(" as string)", " as varchar)"), c)) for f, (a, v, c) in REPORT.items()))


def report_texts(spark, d) -> DataFrame:
    """A report for each customer. Thirty patterns are looked for in each, so keys are dealt out before the texts are made."""
    parts = []
    for line, value, when in REPORT.values():
        before, after = line.split("{}")
        text = F.concat(F.lit(before), F.expr(value), F.lit(after + "\n"))
        parts.append(text if when is None else F.when(F.expr(when), text).otherwise(F.lit("")))
    return scratch.dealt(table(spark, d, "customer").select("c_custkey"), "c_custkey").select("c_custkey", F.concat(*parts).alias("text"))


@query(f"select c_custkey, {_TRUTH} from customer")
def report_entities(spark, d):
    """The 30 shipped patterns, English and Russian, on report texts."""
    return T.extract_entities(report_texts(spark, d), keep=("c_custkey",))


_NUMBERS = {f: v for f, (_, v, c) in REPORT.items() if f not in dims.TEXT_FIELDS}
_DOMAIN = {f: p[0] for f, p in dims.ENTITIES.items()}


@query(f"with t as (select {_TRUTH} from customer) " + " union all ".join(f"select '{_DOMAIN[f]}' \"domain\", '{f}' field, count({f}) n, round(sum(cast(replace({f}, ',', '') as double)), 2) total from t" for f in _NUMBERS))
def entity_values(spark, d):
    """Found values by domain and field, as numbers."""
    values = T.bucket_entities(T.extract_entities(report_texts(spark, d), keep=("c_custkey",)), ("c_custkey",))
    return values.where("number is not null").groupBy("domain", "field").agg(F.count("*").alias("n"), F.round(F.sum("number"), 2).alias("total"))


def lost_time_texts(spark, d) -> DataFrame:
    hours = F.concat((F.col("o_orderkey") % 9 + 1).cast("string"), F.lit(".5"))
    text = F.concat(F.lit("Morning report\n\nNPT: pump washout "), hours, F.lit(" hrs\nWaiting on cement "), (F.col("o_orderkey") % 4).cast("string"), F.lit(" hours\nno figure here\n\nTotal NPT 40 hours\nremark\n\nНПТ: прихват "), hours, F.lit(" ч"))
    return table(spark, d, "orders").select("o_orderkey", text.alias("text"))


@query("select o_orderkey, line_no, description, hours duration_hrs from (select o_orderkey, unnest([{'line_no': 3, 'description': 'NPT: pump washout ' || (o_orderkey % 9 + 1) || '.5 hrs', 'hours': o_orderkey % 9 + 1.5::double}, {'line_no': 10, 'description': 'НПТ: прихват ' || (o_orderkey % 9 + 1) || '.5 ч', 'hours': o_orderkey % 9 + 1.5::double}], recursive := true) from orders)")
def npt_events_strict(spark, d):
    return T.extract_npt_events(lost_time_texts(spark, d), keep=("o_orderkey",))


@query("select o_orderkey, line_no, description, hours duration_hrs from (select o_orderkey, unnest([{'line_no': 10001, 'description': 'pump washout ' || (o_orderkey % 9 + 1) || '.5 hrs', 'hours': o_orderkey % 9 + 1.5::double}, {'line_no': 10002, 'description': 'Waiting on cement ' || (o_orderkey % 4) || ' hours', 'hours': (o_orderkey % 4)::double}, {'line_no': 10003, 'description': 'no figure here', 'hours': null}, {'line_no': 20001, 'description': '40 hours', 'hours': 40.0::double}, {'line_no': 20002, 'description': 'remark', 'hours': null}, {'line_no': 30001, 'description': 'прихват ' || (o_orderkey % 9 + 1) || '.5 ч', 'hours': o_orderkey % 9 + 1.5::double}], recursive := true) from orders)")
def npt_events(spark, d):
    """From each trigger to the next blank line."""
    return T.extract_npt_events(lost_time_texts(spark, d), strict=False, keep=("o_orderkey",))


# ------------------------------------------------------------------ checks across domains, flags, report tables


@query("with k as (select l_suppkey well_id, count(*) n, max(l_quantity) q from lineitem group by 1) select well_id, 'DEPTH_MISMATCH' code, round(abs(s_acctbal - n) / greatest(n, 1.0) * 100, 1) \"value\" from k join supplier on s_suppkey = well_id where abs(s_acctbal - n) / greatest(n, 1.0) > 0.10 union all select well_id, 'UNDER_STIMULATION', n::double from k join supplier on s_suppkey = well_id where n < 0.5 * (s_suppkey % 7 * 200)")
def cross_domain_checks(spark, d):
    k = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("well_id")).agg(F.count("*").alias("n"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("well_id"), F.col("s_acctbal").alias("max_depth"), (F.col("s_suppkey") % 7 * 200).alias("pay_zone_count"))
    return quality.depth_mismatch(k.select("well_id", F.col("n").cast("double").alias("depth")), s).unionByName(quality.under_stimulation(k.withColumnRenamed("n", "stage_count_actual"), s))


_MNEMONICS = "['GR', 'SP', 'RT', 'CALI', 'RILD']"


@query(f"with c as (select user_id well_id, {_MNEMONICS}[user_id * 7 % 4 + event_id % 2 + 1] m from events), h as (select well_id, bool_or(m in ('GR', 'GRC', 'SGR')) g, bool_or(m in ('RT', 'RD', 'RILD')) r from c group by 1) select well_id, case when not g and not r then 'GR,RT' when not g then 'GR' else 'RT' end missing from h where not g or not r")
def missing_curves(spark, d):
    m = F.element_at(F.array(*map(F.lit, ("GR", "SP", "RT", "CALI", "RILD"))), F.expr("cast(user_id * 7 % 4 + event_id % 2 + 1 as int)"))
    return logs.missing_curves(table(spark, d, "events").select(F.col("user_id").alias("well_id"), m.alias("mnemonic"))).select("well_id", F.array_join("missing", ",").alias("missing"))


@query(f"select m mnemonic, lower(m) lowered, case m when 'GR' then 'gamma_ray_api' when 'SP' then 'spontaneous_potential_mv' when 'RT' then 'true_resistivity_ohmm' when 'CALI' then 'caliper_in' else 'deep_induction_ohmm' end canonical, count(*) n from (select {_MNEMONICS}[event_id % 5 + 1] m from events) group by 1, 2, 3")
def named_curves(spark, d):
    m = F.element_at(F.array(*map(F.lit, ("GR", "SP", "RT", "CALI", "RILD"))), F.expr("cast(event_id % 5 + 1 as int)"))
    x = logs.named_curves(table(spark, d, "events").select(F.lower(m).alias("mnemonic")))
    return x.groupBy(F.upper("mnemonic").alias("mnemonic"), F.col("mnemonic").alias("lowered"), "canonical").agg(F.count("*").alias("n"))


@query(WELLS + ", g as (select well_id, '[drilling] ' || message message, code from f where code = 'RANGE' union all select well_id, case when o % 2 = 0 then '[seen] ' || message else '[report] ' || message end, code from (select *, cast(split_part(message, ' ', -1) as bigint) o from f where code = 'DEPTH_MISMATCH')), n as (select *, row_number() over (partition by well_id order by dom, code, message) rn, count(*) over (partition by well_id) n from (select well_id, code, message, case when code = 'RANGE' then 'drilling' else 'report' end dom from g)) select well_id, string_agg(message, '|' order by rn) filter (rn <= 2) preview, greatest(max(n) - 2, 0)::bigint more from n group by 1")
def flag_preview(spark, d):
    """U01 and L08: flags of two domains in one table, the first two of each well and the number of the rest."""
    f = well_flags(spark, d)
    told = f.where("code = 'DEPTH_MISMATCH'").withColumn("message", F.when(F.split("message", " ")[F.size(F.split("message", " ")) - 1].cast("long") % 2 == 0, F.concat(F.lit("[seen] "), "message")).otherwise(F.col("message"))).withColumn("domain", F.lit("report"))
    every = quality.collect_flags(f.where("code = 'RANGE'").withColumn("domain", F.lit("drilling")), told)
    return quality.flag_preview(every, most=2).select("well_id", F.array_join("preview", "|").alias("preview"), F.col("more").cast("long").alias("more"))


@query(FIRED + f", m (rule_id, p, text) as (values {', '.join(f'({_quoted(k)}, {i}, {_quoted(t)})' for k, r in dims.RULES.items() for i, t in enumerate(r[6][:2]))}), o as (select text, min((case risk_level when 'critical' then 0 else 1 end, -score, risk_id, p)) o from r join m using (rule_id) where risk_level in ('critical', 'high') group by 1) select row_number() over (order by o)::int place, text from o order by o limit 15")
def recommendations(spark, d):
    return risk.recommendations(all_risks(spark, d)).select(F.col("place").cast("int").alias("place"), "text")


@query(FIRED + "select risk_id, risk_level, category, substr(title_en, 1, 80) title, score || '/25' score_text from r where risk_level in ('medium', 'low')")
def medium_low_table(spark, d):
    return risk.medium_low_table(all_risks(spark, d))


@query(RISKS + "select p.x probability, i.x impact, count(risk_id) n from (select unnest(range(1, 6))::int x) p cross join (select unnest(range(1, 6))::int x) i left join r on probability = p.x and impact = i.x and category = 'technical' group by 1, 2")
def explode_matrix(spark, d):
    return risk.explode_matrix(risks(spark, d).where("category = 'technical'"))


@query("select user_id well_id, pattern, n occurrence_count from (select *, row_number() over (partition by user_id order by n desc, pattern) rn from (select user_id, event_type pattern, count(*) n from events group by 1, 2)) where rn <= 2")
def top_patterns(spark, d):
    x = table(spark, d, "events").groupBy(F.col("user_id").alias("well_id"), F.col("event_type").alias("pattern")).agg(F.count("*").alias("occurrence_count"))
    return risk.top_patterns(x, 2)


@query("select o_custkey well_name, o_orderkey task_id from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) rn from orders) where rn <= 3")
def cap_per_group(spark, d):
    x = table(spark, d, "orders").select(F.col("o_custkey").alias("well_name"), F.col("o_orderkey").alias("task_id"), "o_orderdate")
    return quality.cap_per_group(x, ("well_name",), ("o_orderdate", "task_id"), 3).drop("o_orderdate")


@query("select o_orderkey task_id, o_custkey well_name, case when o_orderkey % 3 > 0 then o_orderstatus end status from orders")
def trend(spark, d):
    """Every well's analyses in time, stored metrics parsed; broken JSON gives no metrics."""
    o = table(spark, d, "orders")
    metrics = F.when(F.expr("o_orderkey % 3 > 0"), F.concat(F.lit('{"status": "'), "o_orderstatus", F.lit('"}'))).otherwise(F.lit("{broken"))
    x = history.trend(o.select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("well_name"), F.col("o_orderdate").alias("created_at"), metrics.alias("metrics")), "well_name")
    return x.select("task_id", "well_name", F.try_element_at("metrics", F.lit("status")).alias("status"))


@query(RISKS + ", m as (select well, count(*) filter (risk_level = 'critical') a, count(*) filter (risk_level = 'high') b, count(*) filter (risk_level = 'medium') c, count(*) filter (risk_level = 'low') e from r group by 1) select well, unnest(['critical', 'high', 'medium', 'low']) risk_level, unnest([a, b, c, e]) n from m")
def risk_level_comparison(spark, d):
    m = history.well_metrics(risks=risks(spark, d).withColumn("linked_wells", F.array("well")).drop("well"), key="well")
    return history.risk_level_comparison(m, "well")


# ------------------------------------------------------------------ wells: identity, merged domains, comparison


@query("select l_suppkey well_id, field, min_by(v, o) \"value\" from (select l_suppkey, 'flag' field, nullif(l_returnflag, 'N') v, (l_linenumber % 3, -(l_orderkey * 10 + l_linenumber)) o from lineitem union all select l_suppkey, 'status', l_linestatus, (l_linenumber % 3, -(l_orderkey * 10 + l_linenumber)) from lineitem) where v is not null group by 1, 2")
def well_identity(spark, d):
    seq = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = F.array(F.struct(F.lit("flag").alias("field"), F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")).alias("value")), F.struct(F.lit("status").alias("field"), F.col("l_linestatus").alias("value")))
    return history.well_identity(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("well_id"), (F.col("l_linenumber") % 3).alias("domain_order"), seq.alias("file_order"), F.inline(rows)))


@query(SERIES + ", ip as (select well_id, round(avg(case when rn <= 30 then oil end), 1) ip30 from r group by 1), t as (select user_id well_id, count(*) npt_events from events group by 1), s as (select l_orderkey well_id, count(*) stage_count_actual from lineitem group by 1) select coalesce(ip.well_id, t.well_id, s.well_id) well_id, ip30, npt_events, stage_count_actual from ip full join t using (well_id) full join s on s.well_id = coalesce(ip.well_id, t.well_id)")
def merged_domains(spark, d):
    """KPI tables of three domains side by side; any may be absent."""
    parts = [production.ip_metrics(series(spark, d)).select("well_id", "ip30"), hse.npt_total(samples(spark, d).withColumnRenamed("value", "duration_hrs")).select("well_id", "npt_events"), completions.stage_summary(stages(spark, d)).select("well_id", "stage_count_actual")]
    return match.merge_domains(parts)


_COMPARED = ("npt_hours", "max_dls", "pay_zone_count", "stage_count", "ip30")
_CELL = {c: f"coalesce({'printf(' + _quoted('%.2f') + f', {c})' if c in ('npt_hours', 'max_dls') else f'cast({c} as varchar)'}, '—')" for c in _COMPARED}


@query(WELLS + " select metric, " + ", ".join(f"max(case when well_id = '{w}' then v end) \"{w}\"" for w in "123") + " from (" + " union all ".join(f"select well_id, '{c}' metric, {_CELL[c]} v from w" for c in _COMPARED) + ") group by 1")
def comparison_matrix(spark, d):
    """Three chosen wells side by side."""
    return history.comparison_matrix(wells(spark, d), ["1", "2", "3"], "well_id", list(_COMPARED))


@query(SURVEY + "select well_id, md, dls, case when dls > 8 then 'danger' when dls > 5 then 'caution' else 'safe' end band from t")
def dls_profile(spark, d):
    return survey.dls_profile(trajectory(spark, d))


@query("with c as (select o_custkey well_id, o_orderkey file_id, case when o_orderkey % 3 > 0 then o_totalprice end a, case when o_orderkey % 4 > 0 then o_totalprice * 2 end b from orders) select well_id, count(*) ranges, max(greatest(a, b)) max_depth from c where a is not null and b is not null group by 1")
def depth_ranges(spark, d):
    items = F.array(F.struct(F.lit("STRT").alias("key"), F.expr("case when o_orderkey % 3 > 0 then cast(o_totalprice as string) end").alias("value")), F.struct(F.lit("STOP").alias("key"), F.expr("case when o_orderkey % 4 > 0 then cast(o_totalprice * 2 as string) end").alias("value")))
    x = logs.depth_ranges(table(spark, d, "orders").select(F.col("o_custkey").alias("well_id"), F.col("o_orderkey").alias("file_id"), F.inline(items)))
    return x.select("well_id", F.size("ranges").cast("long").alias("ranges"), "max_depth")


@query("select l_orderkey file_id, l_suppkey project_name, c confidence from (select l_orderkey, l_suppkey, max(l_discount) c, row_number() over (partition by l_orderkey order by max(l_discount) desc, l_suppkey) rn from lineitem group by 1, 2) where rn = 1")
def best_project(spark, d):
    x = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("file_id"), F.col("l_suppkey").alias("project_name")).agg(F.max("l_discount").alias("confidence"))
    return match.best_project(x)


@query("select o_custkey query_id, 'PREDICTIVE_RISK' code, 'Similar event on pad ' || (o_orderkey % 7) || ' (similarity ' || o_orderkey || '): ' || o_orderpriority message from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) rank from orders) where rank = 1")
def predictive_flags(spark, d):
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return match.predictive_flags(table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), rank.alias("rank"), (F.col("o_orderkey") % 7).alias("pad_id"), F.col("o_orderkey").alias("similarity"), F.col("o_orderpriority").alias("raw_text")))


# ------------------------------------------------------------------ small functions


@query("select p_partkey, case p_partkey % 4 when 0 then 'm' when 1 then 'ft' when 2 then 'fathom' else 'ft' end depth_unit, coalesce(nullif(p_size % 3, 0), p_size) first_available, cast(p_size * 37 as double) % 360 azimuth, case when p_partkey % 3 = 0 then 'Критический' when p_partkey % 3 = 1 then 'Низкий' else 'Средний' end label, case when p_partkey % 2 = 0 then p_name else 'none' end local, case when p_size % 5 > 0 then round(p_retailprice / (p_size % 5), 1) end loading, case when p_partkey % 7 > 0 then 'Rate ' || p_size end header, case when p_partkey % 7 > 0 then case when p_size % 2 = 0 then 'm3/d' end end unit, case when p_size % 4 > 0 then p_retailprice end clean from part")
def small_functions(spark, d):
    p = table(spark, d, "part")
    unit = F.expr("case p_partkey % 4 when 0 then ' Meters ' when 1 then 'FEET' when 2 then 'Fathom' end")
    level = F.expr("case p_partkey % 3 when 0 then 'critical' when 1 then 'low' else 'medium' end")
    parts = S.extract_units(F.expr("case when p_partkey % 7 > 0 then concat('Rate ', p_size, case when p_size % 2 = 0 then ' [m3/d]' else '' end) end"))
    return p.select(
        "p_partkey", S.normalize_depth_unit(F.lit(" "), unit).alias("depth_unit"), S.first_available(F.expr("p_size % 3"), F.col("p_size"), zero_is_missing=True).alias("first_available"), S.azimuth_mod(F.expr("p_size * 37.0D")).alias("azimuth"),
        S.level_label(level, "ru").alias("label"), S.localize(F.expr("case when p_partkey % 2 = 0 then p_name end"), F.lit("none"), "ru").alias("local"), S.proppant_loading(F.col("p_retailprice"), F.expr("p_size % 5")).alias("loading"),
        parts["name"].alias("header"), parts["unit"].alias("unit"), S.null_sentinel(F.expr("case when p_size % 4 > 0 then p_retailprice else -999.25D end")).alias("clean"),
    )


@query("select s_suppkey, s_acctbal::double acct, case when s_suppkey % 3 > 0 then null else 'depth' end cast_failed, case when s_suppkey % 3 > 0 then s_suppkey::double end depth from supplier")
def cast_to_schema(spark, d):
    x = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").cast("string").alias("acct"), F.expr("case when s_suppkey % 3 > 0 then cast(s_suppkey as string) else 'n/a' end").alias("depth"))
    return S.cast_to_schema(x, {"acct": "double", "depth": "double"}).select("s_suppkey", "acct", F.nullif(F.array_join("cast_failed", ","), F.lit("")).alias("cast_failed"), "depth")


@query("select o_orderkey, path, \"value\" from (select o_orderkey, unnest(['a.b.price', 'a.status', 'key']) path, unnest([cast(o_custkey as varchar), o_orderstatus, cast(o_custkey % 5 as varchar)]) \"value\" from orders)")
def flatten_struct(spark, d):
    o = table(spark, d, "orders")
    return S.flatten_struct(o.select("o_orderkey", F.struct(F.struct(F.col("o_custkey").alias("price")).alias("b"), F.col("o_orderstatus").alias("status")).alias("a"), (F.col("o_custkey") % 5).alias("key")), ("o_orderkey",))


@query("with r as (select o_orderkey k, 6 - cast(substr(o_orderpriority, 1, 1) as int) p, cast(least(5, 1 + floor(o_totalprice / 100000)) as int) i from orders) select printf('R%09d', k) risk_id, p probability, i impact, p * i score, case when p * i >= 16 then 'critical' when p * i >= 9 then 'high' when p * i >= 4 then 'medium' else 'low' end risk_level from r")
def risk_rows(spark, d):
    """P23: risks written as rows and read back; a level that doesn't follow from probability and impact is computed anew."""
    from ..sources import sinks

    return sinks.row_to_risk(risks(spark, d).withColumn("risk_level", F.lit("medium"))).select("risk_id", "probability", "impact", "score", "risk_level")


@query("select well_id, count(*) rows, count(distinct file_id) files from (select l_suppkey well_id, 'a' file_id from lineitem where l_linenumber % 2 = 0 union all select l_suppkey, 'b' from lineitem where l_linenumber % 2 = 1) group by 1")
def concat_domain_rows(spark, d):
    """U03: rows of several files of a well in one table."""
    x = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("well_id"), "l_linenumber", "l_quantity")
    return match.concat_domain_rows({"a": x.where("l_linenumber % 2 = 0"), "b": x.where("l_linenumber % 2 = 1").drop("l_quantity")}).groupBy("well_id").agg(F.count("*").alias("rows"), F.countDistinct("file_id").alias("files"))
