"""Registered queries for tables and texts found in files: headers to canonical columns, sheets, sections of reports, identities, appended events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import completions, logs, production, survey
from ..sources import files, sinks
from .registry import query, table

FILE = ("o_custkey",)


def order_cells(spark, d, columns: list[tuple[str, str]]) -> DataFrame:
    """Cells of a table for each customer, a row for each order: columns are (header, value as an expression)."""
    cells = F.array(*[F.struct(F.lit(i).alias("col_no"), F.lit(name).alias("col_name"), F.expr(f"cast({e} as string)").alias("value")) for i, (name, e) in enumerate(columns)])
    return table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("row_no"), F.inline(cells))


@query("select o_custkey, o_orderkey row_no, (o_orderkey % 5000)::double md, (o_orderkey % 181)::double inc_deg, ((o_orderkey * 7) % 360)::double az_deg from orders where o_orderkey % 11 > 0")
def tables_to_stations(spark, d):
    cells = order_cells(spark, d, [("Note", "'x'"), (" MD ", "o_orderkey % 5000"), ("Зенитный угол", "case when o_orderkey % 11 = 0 then 'n/a' else cast(o_orderkey % 181 as string) end"), ("Azimuth", "o_orderkey * 7")])
    return survey.tables_to_stations(cells, FILE).select("o_custkey", "row_no", "md", "inc_deg", "az_deg")


@query("select o_custkey, o_orderkey row_no, (o_orderkey % 40)::int stage_number, (o_orderkey % 900)::double fluid, case when o_orderkey % 4 > 0 then 4000.5 end::double isip from orders where o_orderkey % 3 > 0")
def tables_to_stages(spark, d):
    cells = order_cells(spark, d, [("Stage #", "case when o_orderkey % 3 = 0 then 'total' else cast(o_orderkey % 40 as string) end"), ("Slurry fluid (bbl)", "o_orderkey % 900"), ("ISIP psi", "case when o_orderkey % 4 > 0 then '4000.5' else '-' end"), ("2nd fluid", "1")])
    return completions.tables_to_stages(cells, FILE).select("o_custkey", "row_no", "stage_number", "fluid", "isip")


@query("select o_custkey, o_orderkey row_no, strftime(o_orderdate, '%Y-%m-%d') period, case when o_custkey % 2 = 0 then (o_orderkey % 700)::double end oil_rate from orders where o_custkey % 3 > 0")
def tables_to_time_series(spark, d):
    """Tables with a date and a rate column; where the first rate column holds no numbers the rate is null."""
    cells = order_cells(spark, d, [("Date", "date_format(o_orderdate, 'yyyy-MM-dd')"), ("Gas", "7"), ("Oil rate bopd", "case when o_custkey % 2 = 0 then o_orderkey % 700 end")])
    other = cells.where("o_custkey % 3 = 0 and col_no <> 0")
    return production.tables_to_time_series(cells.where("o_custkey % 3 > 0").unionByName(other), FILE).select("o_custkey", "row_no", "period", "oil_rate")


_HEADERS = {"drilling": ("ROP", "WOB", "Bit"), "directional": ("Inclination", "Azimuth", "TVD"), "production": ("Oil", "Gas", "Choke"), "petrophysics": ("Gamma", "RHOB", "NPHI")}


@query("select distinct o_custkey, ['drilling', 'directional', 'production', 'petrophysics', 'unknown'][o_custkey % 5 + 1] \"domain\" from orders")
def classify_headers(spark, d):
    names = F.array(*[F.array(*map(F.lit, x)) for x in (*_HEADERS.values(), ("Foo", "Baz", "Zip"))])
    heads = table(spark, d, "orders").select("o_custkey").distinct().select("o_custkey", F.posexplode(F.element_at(names, (F.col("o_custkey") % 5 + 1).cast("int"))).alias("col_no", "col_name"))
    return T.classify_headers(heads, ["o_custkey"])


_SHEETS = {"Frac": "cluster count", "Params": "rop and mud weight", "Casing": "grade and shoe", "Misc": "zzz"}


@query("select distinct o_custkey, sheet, kind sheet_type from (select o_custkey, unnest(['Frac', 'Params', 'Casing', 'Misc']) sheet, unnest(['completion_design', 'drilling_parameters', 'casing_design', 'unknown']) kind from orders)")
def classify_sheets(spark, d):
    x = table(spark, d, "orders").select("o_custkey").distinct()
    rows = x.select("o_custkey", F.inline(F.array(*[F.struct(F.lit(k).alias("sheet"), F.lit(i).alias("row_no"), F.lit(0).alias("col_no"), F.lit(v if i < 5 else "oil gas water rate").alias("value")) for k, v in _SHEETS.items() for i in (1, 9)])))
    return T.classify_sheet(rows, ["o_custkey", "sheet"])


@query("with o as (select o_custkey, max(o_orderkey) k from orders group by 1) select o_custkey, field, \"value\" from (select o_custkey, unnest(['stage_count', 'total_fluid_bbls', 'rop_ft_hr', 'mud_weight_sg']) field, unnest([(k % 50)::double, (k % 9000)::double, (51 + k % 100)::double, 1.5::double]) \"value\" from o)")
def sheet_key_values(spark, d):
    """Totals beside their names, and drilling parameters with the unit told by size; the last row wins."""
    one = lambda sheet, row, cells: F.array(*[F.struct(F.lit(sheet).alias("sheet_type"), (F.col("o_orderkey") * 10 + row).alias("row_no"), F.lit(i).alias("col_no"), F.expr(f"cast({c} as string)").alias("value")) for i, c in enumerate(cells)])
    cells = F.concat(
        one("completion_design", 0, ["'Total stages'", "o_orderkey % 50"]), one("completion_design", 1, ["'Fluid, bbl'", "o_orderkey % 9000"]), one("drilling_parameters", 0, ["'ROP'", "51 + o_orderkey % 100"]), one("drilling_parameters", 1, ["'Плотность'", "'1.5'"])
    )
    return T.sheet_key_values(table(spark, d, "orders").select("o_custkey", F.inline(cells)), FILE)


@query("with o as (select *, row_number() over (partition by o_custkey order by o_orderkey) rn from orders) select o_custkey, rn + 2 row_no, col_no, col_name, \"value\" from (select o_custkey, rn, unnest([0, 1]) col_no, unnest(['Key', 'col_1']) col_name, unnest([o_orderkey::varchar, case when o_orderkey % 3 > 0 then o_orderstatus end]) \"value\" from o) where \"value\" is not null")
def sheet_tables(spark, d):
    """Raw cells with empty rows above the header, an unnamed column and empty cells."""
    rn = F.expr("row_number() over (partition by o_custkey order by o_orderkey)")
    body = table(spark, d, "orders").withColumn("row_no", (rn + 2).cast("long")).select("o_custkey", "row_no", F.inline(F.array(F.struct(F.lit(0).alias("col_no"), F.col("o_orderkey").cast("string").alias("value")), F.struct(F.lit(1).alias("col_no"), F.expr("case when o_orderkey % 3 > 0 then o_orderstatus else 'NaN' end").alias("value")))))
    head = body.select("o_custkey").distinct().select("o_custkey", F.inline(F.array(F.struct(F.lit(1).cast("long").alias("row_no"), F.lit(0).alias("col_no"), F.lit("  ").alias("value")), F.struct(F.lit(2).cast("long").alias("row_no"), F.lit(0).alias("col_no"), F.lit("Key").alias("value")))))
    return files.sheet_tables(head.unionByName(body), FILE).select("o_custkey", "row_no", "col_no", "col_name", "value")


@query("select name, canonical, count(*) n from (select unnest(['ROP', 'обороты', 'Mud weight', 'note']) name, unnest(['rop_ft_hr', 'rpm', 'mud_weight_ppg', null]) canonical from orders) group by 1, 2")
def canonical_columns(spark, d):
    cells = order_cells(spark, d, [(n, "1") for n in ("ROP", "обороты", "Mud weight", "note")])
    return files.canonical_columns(cells, "drilling").groupBy(F.col("col_name").alias("name"), "canonical").agg(F.count("*").alias("n"))


@query("select c_custkey, case when c_custkey % 2 = 0 then concat('42-', 100 + c_custkey % 900, '-', 10000 + c_custkey, '-0', c_custkey % 10, '00') end api, case when c_custkey % 2 = 1 then concat(c_custkey, 'А') end well_name, concat('К', c_custkey % 9) pad, case when c_custkey % 3 = 0 then concat('Jan ', 10 + c_custkey % 18, ', 2024') when c_custkey % 3 = 1 then concat(10 + c_custkey % 18, '.03.2024') else concat(10 + c_custkey % 18, ' марта 2024') end report_date from customer")
def entity_context(spark, d):
    k = "cast(c_custkey as string)"
    well = F.expr(f"case when c_custkey % 2 = 0 then concat('UWI 42-', 100 + c_custkey % 900, '-', 10000 + c_custkey, '-0', c_custkey % 10, '00') else concat('Скважина: № ', {k}, 'А') end")
    date = F.expr("case when c_custkey % 3 = 0 then concat('Jan ', 10 + c_custkey % 18, ', 2024') when c_custkey % 3 = 1 then concat(10 + c_custkey % 18, '.03.2024') else concat(10 + c_custkey % 18, ' марта 2024') end")
    return T.entity_context(table(spark, d, "customer").select("c_custkey", F.concat(well, F.expr("concat('\nКуст № К', c_custkey % 9, '\nнаписано ')"), date, F.lit(" г.")).alias("text")), keep=("c_custkey",))


@query("select c_custkey, item_no, component from (select c_custkey, unnest([0, 1]) item_no, unnest(['PDC bit ' || c_custkey, 'Motor, 6 joints']) component from customer)")
def extract_bha(spark, d):
    text = F.concat(F.lit("Report\n\nBHA: PDC bit "), F.col("c_custkey").cast("string"), F.lit("\nsub\nMotor, 6 joints\n\nBit record\nnone of it"))
    return T.extract_bha(table(spark, d, "customer").select("c_custkey", text.alias("text")), keep=("c_custkey",))


@query("select c_custkey, item_no, casing_string, set_depth from (select c_custkey, unnest([0, 1]) item_no, unnest(['13-3/8 in surface casing', '9-5/8 in intermediate casing']) casing_string, unnest([(1000 + c_custkey % 900)::double, 9500.0::double]) set_depth from customer)")
def extract_casing_points(spark, d):
    text = F.concat(F.lit("13-3/8 in surface casing was set at "), (1000 + F.col("c_custkey") % 900).cast("string"), F.lit(" ft\nthen drilled\n9-5/8 in intermediate casing cemented to 9,500 ft"))
    return T.extract_casing_points(table(spark, d, "customer").select("c_custkey", text.alias("text")), keep=("c_custkey",)).select("c_custkey", "item_no", "casing_string", "set_depth")


@query("select c_custkey, 'Name: ' || c_name || case when c_custkey % 3 > 0 then ' | Nation: ' || c_nationkey else '' end summary from customer")
def summaries(spark, d):
    x = table(spark, d, "customer").withColumn("n", F.expr("case when c_custkey % 3 > 0 then c_nationkey end"))
    return T.summaries(x, {"c_name": "Name", "n": "Nation"}, ("c_custkey",))


@query("select doc_id, " + ", ".join(f"({' + '.join(f'contains(lower(coalesce(text, {chr(39)*2})), {chr(39)}{t}{chr(39)})::int' for t in ts)}) / {float(len(ts))} score_{c}" for c, ts in (("en", ("the", "and", "of", "is")), ("es", ("que", "los", "una")))) + " from documents")
def keyword_score(spark, d):
    return T.keyword_score(table(spark, d, "documents").select("doc_id", "text"), {"en": ["the", "and", "of", "is"], "es": ["que", "los", "una"]}).drop("text")


@query("select o_custkey, case o_custkey % 3 when 0 then 'm' when 1 then 'ft' else 'ft' end unit from orders group by 1")
def depth_unit(spark, d):
    """From the header, then from the depth curve, else feet."""
    x = table(spark, d, "orders").select("o_custkey").distinct()
    heads = x.select("o_custkey", F.lit("Strt").alias("key"), F.expr("case when o_custkey % 3 = 0 then 'METERS' end").alias("unit"))
    curves = x.select("o_custkey", F.lit("DEPT").alias("mnemonic"), F.expr("case when o_custkey % 3 = 0 then 'ft' when o_custkey % 3 = 1 then 'Feet' end").alias("unit"))
    return logs.depth_unit(heads, curves, FILE)


@query("select concat_ws('_', o_custkey % 25, o_custkey, i) event_id, substr(repeat(o_orderpriority, 60), 1, 500) raw_text from (select *, o_orderkey i from orders) where o_orderkey % 4 > 0")
def append_npt_history(spark, d):
    """New events only; given twice they are added once."""
    o = table(spark, d, "orders").select((F.col("o_custkey") % 25).alias("pad_id"), F.col("o_custkey").alias("well_id"), F.col("o_orderkey").alias("i"), F.repeat("o_orderpriority", F.lit(60)).alias("raw_text"))
    old = o.where("i % 4 = 0").select(F.concat_ws("_", "pad_id", "well_id", F.col("i").cast("string")).alias("event_id"))
    return sinks.append_npt_history(old, o.union(o)).select("event_id", "raw_text")
