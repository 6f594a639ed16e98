"""Column -> Column functions: numbers, units, null handling, levels and bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import dims


def coerce_number(c: Column) -> Column:
    """Text -> double. A comma before exactly three digits is a thousands sign, any other a decimal one; bad -> null."""
    plain = F.regexp_replace(F.trim(c), r",(?=[0-9]{3}(?:[^0-9]|$))", "")
    return F.regexp_replace(plain, ",", ".").try_cast("double")


def coerce_cell(c: Column) -> Column:
    """A cell as struct (number, text): one comma among digits and dots is a decimal comma; empty -> null."""
    t = F.trim(c)
    one = (F.length(t) - F.length(F.replace(t, F.lit(","), F.lit(""))) == 1) & t.rlike(r"^[-+]?[0-9.,]*$")
    number = F.when(one, F.replace(t, F.lit(","), F.lit("."))).otherwise(t).try_cast("double")
    return F.struct(number.alias("number"), F.when(number.isNull() & (t != ""), t).alias("text"))


def convert_depth(c: Column, unit: Column | str, to: str) -> Column:
    u = F.lit(unit) if isinstance(unit, str) else unit
    return F.when((u == "ft") & F.lit(to == "m"), c * 0.3048).when((u == "m") & F.lit(to == "ft"), c / 0.3048).otherwise(c)


def convert_mud_weight(c: Column, unit: Column | str, to: str) -> Column:
    u = F.lit(unit) if isinstance(unit, str) else unit
    return F.when((u == "ppg") & F.lit(to == "sg"), c * 0.1198).when((u == "sg") & F.lit(to == "ppg"), c / 0.1198).otherwise(c)


def normalize_depth_unit(*units: Column) -> Column:
    """The first given unit, as m or ft; others lower-cased; none -> ft. Give STRT, STOP, STEP, DEPT, DEPTH, MD in this order."""
    u = F.lower(F.trim(F.coalesce(*[F.when(F.trim(x) != "", x) for x in units])))
    return F.when(u.isin("m", "meter", "meters"), "m").when(u.isin("ft", "feet", "foot"), "ft").otherwise(F.coalesce(u, F.lit("ft")))


def first_available(*cols: Column, zero_is_missing: bool = False) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit(0)) if zero_is_missing else c for c in cols])


def azimuth_mod(c: Column) -> Column:
    return F.pmod(c, F.lit(360.0))


def valid_station(md: Column, inc: Column, az: Column) -> Column:
    return md.isNotNull() & inc.isNotNull() & az.isNotNull() & (md >= 0) & inc.between(0, 180)


def null_sentinel(c: Column, sentinel: float = -999.25, places: int = 4) -> Column:
    return F.round(F.nullif(F.nanvl(c, F.lit(None).cast("double")), F.lit(sentinel)), places)


def flatten_struct(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, path, value: each leaf of the nested columns under its dotted path, as text."""
    from pyspark.sql.types import StructType

    def leaves(kind, path):
        for f in kind.fields:
            if isinstance(f.dataType, StructType):
                yield from leaves(f.dataType, [*path, f.name])
            else:
                yield [*path, f.name]

    paths = [p for p in leaves(df.schema, []) if p[0] not in keys]
    cells = F.array(*[F.struct(F.lit(".".join(p)).alias("path"), dig(df, ".".join(p)).cast("string").alias("value")) for p in paths])
    return df.select(*keys, F.inline(cells))


def dig(df: DataFrame, path: str) -> Column:
    """Null-safe nested access; an unknown path gives null."""
    first, *rest = path.split(".")
    kind, c = df.schema[first].dataType if first in df.columns else None, df[first] if first in df.columns else F.lit(None)
    for name in rest:
        if kind is None or not hasattr(kind, "fieldNames") or name not in kind.fieldNames():
            return F.lit(None)
        c, kind = c.getField(name), kind[name].dataType
    return c


def risk_level(probability: Column, impact: Column) -> Column:
    s = probability * impact
    return F.when(s >= 16, "critical").when(s >= 9, "high").when(s >= 4, "medium").otherwise("low")


def level_rank(level: Column) -> Column:
    return F.when(level == "critical", 4).when(level == "high", 3).when(level == "medium", 2).otherwise(1)


def level_label(level: Column, lang: str = "en") -> Column:
    out = level
    for name, _, en, ru, _ in dims.LEVELS:
        out = F.when(level == name, ru if lang == "ru" else en).otherwise(out)
    return out


def localize(ru: Column, en: Column, lang: str) -> Column:
    return F.coalesce(ru, en) if lang == "ru" else F.coalesce(en, ru)


def dls_band(dls: Column) -> Column:
    return F.when(dls > 8, "danger").when(dls > 5, "caution").otherwise("safe")


def radar_normalize(value: Column, cap: float) -> Column:
    return F.coalesce(F.round(F.least(value / cap, F.lit(1.0)) * 100, 1), F.lit(0.0))


def proppant_loading(total: Column, lateral: Column) -> Column:
    return F.round(F.try_divide(total, lateral), 1)


def trir(cases: Column, manhours: Column) -> Column:
    return F.round(F.try_divide(cases * 200000.0, manhours), 2)


def parse_json_or_empty(c: Column, schema: str = "map<string,string>") -> Column:
    return F.coalesce(F.from_json(c, schema), F.create_map().cast("map<string,string>") if schema == "map<string,string>" else F.from_json(F.lit("{}"), schema))


def canonical_curve(mnemonic: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in dims.CURVES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, F.upper(F.trim(mnemonic))), F.lower(F.trim(mnemonic)))


def extract_units(header: Column) -> Column:
    """struct (name, unit) of a header like `Depth (ft)` or `Rate [m3/d]`."""
    inside = r"[(\[]\s*+([^()\[\]\s]++)\s*+[)\]]"  # one word in round or square brackets
    unit = F.regexp_extract(header, inside, 1)
    name = F.trim(F.regexp_replace(header, r"\s*+[(\[][^()\[\]]*+[)\]]", ""))
    return F.struct(name.alias("name"), F.nullif(unit, F.lit("")).alias("unit"))


def cast_to_schema(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Each named field cast on its own; a bad one is null and listed in cast_failed. Other fields stay as they are."""
    bad = F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull(), F.lit(c)) for c, t in fields.items() if c in df.columns]))
    return df.select(*[F.col(c).try_cast(fields[c]).alias(c) if c in fields else F.col(c) for c in df.columns], bad.alias("cast_failed"))
