"""Files as tables: listing and typing, report texts, delimited tables, well logs, sheets; all files of a folder in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import extract_units
from ..functions.text import FOLD
from .scratch import sent_if_small, written

MIME = {"csv": "text/csv", "json": "application/json", "pdf": "application/pdf", "txt": "text/plain", "log": "text/plain", "xml": "application/xml", "html": "text/html", "doc": "application/msword", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xls": "application/vnd.ms-excel", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "ods": "application/vnd.oasis.opendocument.spreadsheet"}


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """path, modificationTime, length, content of every file below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def detect_file_type(files: DataFrame) -> DataFrame:
    """files (path, and content if there is one) with extension, mime_type, detected_type, confidence; the first rule that fits holds."""
    has = "content" in files.columns
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    head = F.decode(F.substring("content", 1, 256), "ISO-8859-1") if has else F.lit("")
    sample = F.decode(F.substring("content", 1, 2000), "ISO-8859-1") if has else F.lit("")
    kind = lambda name, c: F.struct(F.lit(name).alias("detected_type"), F.lit(c).alias("confidence"))
    found = (
        F.when(ext == "las", kind("las_well_log", 0.99)).when(ext.isin("dlis", "lis"), kind("dlis_log_container", 0.99)).when(F.contains(head, F.lit("~Version")), kind("las_well_log", 0.95)).when(F.contains(head, F.lit("DLIS")) & ext.isin("bin", ""), kind("dlis_log_container", 0.80))
        .when(ext.isin("xlsx", "xls", "ods"), kind("spreadsheet", 0.99)).when(ext == "csv", kind("csv_data", 0.99)).when(ext == "json", kind("json_export", 0.99)).when(ext.isin("docx", "doc"), kind("word_document", 0.99)).when(ext == "pdf", kind("pdf_document", 0.90)).when(ext.isin("txt", "log", "dat"), kind("text_file", 0.85))
        .when((ext == "xml") & F.contains(F.lower(sample), F.lit("witsml")), kind("witsml_export", 0.90)).when(ext == "xml", kind("xml_document", 0.70)).otherwise(kind("unknown", 0.10))
    )
    mime = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return files.withColumn("t", found).select(*files.columns, ext.alias("extension"), F.coalesce(F.try_element_at(mime, ext), F.lit("application/octet-stream")).alias("mime_type"), "t.detected_type", "t.confidence")


def missing_inputs(requested: DataFrame, listing: DataFrame) -> DataFrame:
    return requested.join(listing, "path", "left_anti").select("path", F.lit("FILE_NOT_FOUND").alias("code"))


def unprocessed_files(listing: DataFrame, processed: DataFrame) -> DataFrame:
    return listing.join(processed, ["path", "modificationTime"], "left_anti")


def read_report_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file_id"), F.col("value").alias("text"))


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """file_id, block, at, line of the text files below a folder. Spark cuts large files into blocks for its tasks; at orders the lines of a block."""
    read = spark.read.text(path, recursiveFileLookup=True)
    return read.select(F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def numbered_lines(lines: DataFrame) -> DataFrame:
    """file_id, line_no, line: the place of each line in its file, from the counts of the blocks before and its place in its own block."""
    counts = lines.groupBy("file_id", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = sent_if_small(written(counts.select("file_id", "block", before.alias("before"))))
    place = F.col("before") + F.row_number().over(Window.partitionBy("file_id", "block").orderBy("at")) - 1
    return lines.join(blocks, ["file_id", "block"]).select("file_id", place.alias("line_no"), "line")


UNIT = r"^\(?\[?(?:ft|m|ft/hr|m/hr|ppg|sg|g/cm3|psi|kPa|MPa|bbls?|m3|lbs?|klbs?|tons?|deg|rpm|gpm|API|ohmm|м|фут|т|бар|bopd|mcfd|bwpd|hrs?|ч)\)?\]?$"


def split_cells(line: Column, quoted: Column) -> Column:
    return F.transform(F.split(line, quoted), lambda x: F.regexp_replace(F.trim(x), '^"(.*)"$', "$1"))


def delimited_heads(rows: Column) -> dict[str, Column]:
    """quoted, header, units of a table whose first lines (ten at least, if it has them) that aren't empty are rows: the delimiter is the one counted most in the
    first ten (comma, tab, bar, semicolon, in this order on ties); a second line of which over 30 % look like units is the unit row."""
    head = F.array_join(F.slice(rows, 1, 10), "\n")
    count = lambda d: F.length(head) - F.length(F.replace(head, F.lit(d), F.lit("")))
    best = F.array_max(F.array(*[F.struct(count(d).alias("n"), F.lit(4 - i).alias("r"), F.lit(p).alias("d")) for i, (d, p) in enumerate(((",", ","), ("\t", "\t"), ("|", r"\|"), (";", ";")))]))["d"]
    quoted = F.concat(F.lit("(?:"), best, F.lit(')(?=(?:[^"]*"[^"]*")*[^"]*$)'))
    header, second = split_cells(rows[0], quoted), split_cells(F.get(rows, F.lit(1)), quoted)
    has_units = F.coalesce(F.size(F.filter(second, lambda x: x.rlike(FOLD + UNIT))) > 0.3 * F.size(header), F.lit(False))
    return {"quoted": quoted, "header": header, "units": F.when(has_units, second)}


def named_cells(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, row_no, col_no, col_name, unit, value from rows (keys, row_no, cells, header, units)."""
    zipped = F.arrays_zip(F.col("header").alias("h"), F.col("cells").alias("v"), F.coalesce("units", F.transform("header", lambda x: F.lit(None).cast("string"))).alias("u"))
    cells = rows.select(*keys, "row_no", F.posexplode(zipped).alias("col_no", "x"))
    named = extract_units(F.col("x.h"))
    return cells.where("x.h is not null").select(*keys, "row_no", "col_no", named["name"].alias("col_name"), F.coalesce(F.nullif("x.u", F.lit("")), named["unit"]).alias("unit"), F.nullif("x.v", F.lit("")).alias("value"))


def delimited_cells(texts: DataFrame, keys: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """keys, row_no, col_no, col_name, unit, value from texts (keys, text), whole tables each."""
    rows = F.filter(F.split(F.regexp_replace("text", "\r\n|\r", "\n"), "\n"), lambda x: F.trim(x) != "")
    t = texts.select(*keys, rows.alias("rows")).where(F.size("rows") > 0).withColumns(delimited_heads(F.col("rows")))
    body = t.select(*keys, "quoted", "header", "units", F.posexplode(F.slice("rows", F.when(F.col("units").isNull(), 2).otherwise(3), F.size("rows"))).alias("row_no", "row"))
    return named_cells(body.withColumn("cells", split_cells(F.col("row"), F.col("quoted"))), keys)


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """file_id, row_no, col_no, col_name, unit, value of the delimited files below a folder. A file of any size is read in blocks by many tasks; only its first ten
    lines meet, to tell delimiter, header and units. A quoted cell doesn't go over a line's end."""
    lines = numbered_lines(split_lines(spark, path).where(F.trim("line") != ""))
    first = lines.where("line_no < 10").groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("rows"))
    heads = sent_if_small(written(first.withColumns(delimited_heads(F.col("rows"))).drop("rows")))
    body = lines.join(heads, "file_id").withColumn("row_no", F.col("line_no") - F.when(F.col("units").isNull(), 1).otherwise(2)).where("row_no >= 0")
    return named_cells(body.withColumn("cells", split_cells(F.col("line"), F.col("quoted"))), ("file_id",))


def canonical_columns(cells: DataFrame, domain: str) -> DataFrame:
    """cells with canonical: the KPI column that a header is an exact variant of, first variant first."""
    from ..plans import dims

    prio = F
    for d, canonical, variants in dims.HEADERS:
        if d == domain:
            for i, v in enumerate(variants):
                prio = prio.when(F.lower(F.trim("col_name")) == v, F.struct(F.lit(canonical).alias("canonical"), F.lit(i).alias("prio")))
    return cells.withColumn("x", prio.otherwise(F.lit(None))).select("*", "x.canonical", "x.prio").drop("x")


def sheet_tables(cells: DataFrame, keys: tuple[str, ...] = ("file_id", "sheet")) -> DataFrame:
    """keys, row_no, col_no, col_name, value from raw cells: empty rows left out, the first other row is the header, unnamed columns col_<j>."""
    v = F.nullif(F.trim("value"), F.lit(""))
    some = cells.withColumn("value", F.when(F.lower(v) != "nan", v)).where("value is not null")
    first = some.groupBy(*keys).agg(F.min("row_no").alias("head"))
    x = some.join(first, list(keys))
    names = x.where("row_no = head").select(*keys, "col_no", F.col("value").alias("col_name"))
    return x.where("row_no > head").join(names, [*keys, "col_no"], "left").select(*keys, "row_no", "col_no", F.coalesce("col_name", F.format_string("col_%d", "col_no")).alias("col_name"), "value")


def las_section(line: Column) -> Column:
    return F.when(F.startswith(line, F.lit("~")), F.upper(F.substring(line, 2, 1)))


def las_lines(texts: DataFrame, keys: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """keys, line_no, section, line of log texts, comments and section headers left out."""
    x = texts.select(*keys, F.posexplode(F.split(F.regexp_replace("text", "\r\n|\r", "\n"), "\n")).alias("line_no", "line"))
    x = x.withColumn("line", F.trim("line")).where("line <> '' and line not like '#%'")
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return x.withColumn("section", F.last(las_section(F.col("line")), ignorenulls=True).over(w)).where("line not like '~%' and section is not null")


def las_split_lines(lines: DataFrame) -> DataFrame:
    """The same from split_lines, with log_no: a block begins in the section that the last header before it opened, and in the log that the last version header opened."""
    x = lines.withColumn("line", F.trim("line")).where("line <> '' and line not like '#%'").withColumn("opened", las_section(F.col("line")))
    last = x.groupBy("file_id", "block").agg(F.max_by("opened", F.when(F.col("opened").isNotNull(), F.col("at"))).alias("opened"), F.count_if(F.col("opened") == "V").alias("logs"))
    earlier = Window.partitionBy("file_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.last("opened", ignorenulls=True).over(earlier).alias("carried"), F.coalesce(F.sum("logs").over(earlier), F.lit(0)).alias("before")
    blocks = sent_if_small(written(last.select("file_id", "block", *carried)))
    so_far = Window.partitionBy("file_id", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = {"own": F.last("opened", ignorenulls=True).over(so_far), "logs": F.count_if(F.col("opened") == "V").over(so_far)}
    x = x.withColumns(own).join(blocks, ["file_id", "block"])
    order = F.struct("block", "at")
    return x.select("file_id", (F.col("before") + F.col("logs")).alias("log_no"), order.alias("line_no"), F.coalesce("own", "carried").alias("section"), "line").where("line not like '~%' and section is not null")


def las_tables_of(rows: DataFrame, keys: tuple[str, ...], sentinel: float = -999.25, items: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(header items, curves, samples) of log lines (keys, line_no, section, line): keys, key, unit, value / keys, curve_no, mnemonic, unit, descr / keys, depth,
    mnemonic, value. Samples meet one row of names and null value for each file, so a large file isn't gathered. items: header keys whose values samples have as columns."""
    item = r"^([^.\s]+)\s*\.(\S*)\s*(.*?)\s*(?::\s*(.*))?$"
    part = lambda i: F.regexp_extract("line", item, i)
    wells = rows.where("section = 'W'").select(*keys, F.upper(part(1)).alias("key"), F.nullif(part(2), F.lit("")).alias("unit"), F.nullif(part(3), F.lit("")).alias("value"))
    order = Window.partitionBy(*keys).orderBy("line_no")
    curves = rows.where("section = 'C'").select(*keys, (F.row_number().over(order) - 1).alias("curve_no"), F.upper(part(1)).alias("mnemonic"), F.nullif(part(2), F.lit("")).alias("unit"), F.nullif(part(4), F.lit("")).alias("descr"))
    names = curves.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("curve_no", "mnemonic"))), lambda x: x["mnemonic"]).alias("names"))
    said = lambda key: F.when(F.col("key") == key, F.col("value"))
    null = wells.where(F.col("key").isin("NULL", *items)).groupBy(*keys).agg(F.min(said("NULL").try_cast("double")).alias("sentinel"), *[F.min(said(i)).alias(i) for i in items])
    heads = sent_if_small(written(names.join(null, list(keys), "left")))
    values = rows.where("section = 'A'").select(*keys, F.split("line", r"\s+").alias("v"))
    cells = values.join(heads, list(keys)).select(*keys, *items, "sentinel", F.col("v")[0].try_cast("double").alias("depth"), F.inline(F.arrays_zip(F.col("names").alias("mnemonic"), F.slice("v", F.lit(1), F.size("names")).alias("text")))).where("text is not null")
    number = F.col("text").try_cast("double")
    samples = cells.select(*keys, *items, "depth", "mnemonic", F.when(number != F.coalesce("sentinel", F.lit(sentinel)), number).alias("value"))
    return wells, curves, samples


def las_tables(texts: DataFrame, keys: tuple[str, ...] = ("file_id",), sentinel: float = -999.25) -> tuple[DataFrame, DataFrame, DataFrame]:
    """las_tables_of for texts (keys, text), whole files each."""
    return las_tables_of(las_lines(texts, keys), keys, sentinel)


def read_las(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """las_tables_of for the log files below a folder. A file of any size is read in blocks by many tasks, the section carried over their borders."""
    return las_tables_of(las_split_lines(split_lines(spark, path)), ("file_id",))


def read_las_bundles(spark: SparkSession, path: str, items: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same for files that hold any number of logs one behind another, each from its version header on: keys are file_id, log_no (from 1; 0 before the first
    version header). Short logs kept so need far fewer files, each of which costs the driver a commit and a listing."""
    return las_tables_of(written(las_split_lines(split_lines(spark, path))), ("file_id", "log_no"), items=items)
