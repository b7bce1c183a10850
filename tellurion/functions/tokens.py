"""JSON tokens as columns. A row of LogsQL is a map from dotted path to the compact JSON text of a leaf, so types stay apart: 1, 1.0, "1" and true differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$"
DEPTH = 5
UNITS_NS = {"ns": 1.0, "us": 1e3, "µs": 1e3, "ms": 1e6, "s": 1e9, "m": 6e10, "h": 3.6e12, "d": 8.64e13, "w": 6.048e14, "y": 3.1536e16}
SIZES = {"B": 1.0, "K": 1e3, "KB": 1e3, "Ki": 1024.0, "KiB": 1024.0, "M": 1e6, "MB": 1e6, "Mi": 2.0**20, "MiB": 2.0**20, "G": 1e9, "GB": 1e9, "Gi": 2.0**30, "GiB": 2.0**30, "T": 1e12, "TB": 1e12, "Ti": 2.0**40, "TiB": 2.0**40}
TIME = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"


def quote(text: Column) -> Column:
    inside = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(inside, F.lit(2), F.length(inside) - 2))


def is_string(token: Column) -> Column:
    return token.startswith('"')


def text(token: Column) -> Column:
    """Null and missing are empty, a string is its text, all else its JSON."""
    plain = F.substring(token, F.lit(2), F.length(token) - 2)
    decoded = F.when(token.contains("\\"), F.get_json_object(F.concat(F.lit('{"a":'), token, F.lit("}")), "$.a")).otherwise(plain)
    return F.when(token.isNull() | (token == "null"), "").when(is_string(token), decoded).otherwise(token)


def number(token: Column) -> Column:
    """A JSON number as a double, else null."""
    return F.when(token.rlike(NUMBER), token.try_cast("double"))


def integer(token: Column) -> Column:
    return F.when(token.rlike(r"^-?\d{1,38}$"), token.try_cast("decimal(38,0)"))


def of_number(value: Column) -> Column:
    """A double as JSON writes it: whole numbers without a fraction."""
    whole = (F.abs(value) < 1e15) & (value == F.floor(value))
    return F.when(whole, value.cast("long").cast("string")).otherwise(value.cast("string"))


def micros(ts: Column) -> Column:
    """RFC 3339 of microseconds, without trailing zeros."""
    base = F.date_format(F.timestamp_micros(ts), "yyyy-MM-dd'T'HH:mm:ss")
    part = F.rtrim(F.lpad(F.pmod(ts, F.lit(1_000_000)).cast("string"), 6, "0"), F.lit("0"))
    return F.concat(base, F.when(part == "", "").otherwise(F.concat(F.lit("."), part)), F.lit("Z"))


def flatten(metadata: Column) -> Column:
    """Leaves of a JSON object by dotted path; arrays and empty objects are leaves, a dot within a key is escaped."""
    kind = "map<string,variant>"

    def entries(v: Column, prefix: Column | None) -> Column:
        name = lambda k: F.replace(k, F.lit("."), F.lit("\\."))
        whole = F.map_entries(F.try_variant_get(v, "$", kind))
        return F.transform(whole, lambda e: F.struct((name(e["key"]) if prefix is None else F.concat(prefix, F.lit("."), name(e["key"]))).alias("k"), e["value"].alias("v")))

    found = F.coalesce(entries(F.try_parse_json(metadata), None), F.array().cast("array<struct<k:string,v:variant>>"))
    for _ in range(DEPTH - 1):
        deeper = lambda e: F.when(F.schema_of_variant(e["v"]).startswith("OBJECT<") & (F.schema_of_variant(e["v"]) != "OBJECT<>"), entries(e["v"], e["k"])).otherwise(F.array(e))
        found = F.flatten(F.transform(found, deeper))
    return F.map_from_entries(F.transform(found, lambda e: F.struct(e["k"], F.coalesce(F.to_json(e["v"]), F.lit("null")))))


def measure(t: Column) -> Column:
    """A text's value as number, duration in ns, or byte size; else null."""
    parts = F.regexp_extract_all(t, F.lit(r"(\d+(?:\.\d+)?)(?:ns|us|µs|ms|s|m|h|d|w|y)"), F.lit(1))
    units = F.regexp_extract_all(t, F.lit(r"\d+(?:\.\d+)?(ns|us|µs|ms|s|m|h|d|w|y)"), F.lit(1))
    scale = F.create_map(*[x for k, v in UNITS_NS.items() for x in (F.lit(k), F.lit(v))])
    whole = F.aggregate(F.zip_with(parts, units, lambda a, u: a.try_cast("double") * F.try_element_at(scale, u)), F.lit(0.0), lambda s, x: s + x)
    duration = F.when(t.startswith("-"), -whole).otherwise(whole)
    sizes = F.create_map(*[x for k, v in SIZES.items() for x in (F.lit(k), F.lit(v))])
    size = F.regexp_extract(t, r"^(-?\d+(?:\.\d+)?)([KMGT]i?B?|B)$", 1).try_cast("double") * F.try_element_at(sizes, F.regexp_extract(t, r"^(-?\d+(?:\.\d+)?)([KMGT]i?B?|B)$", 2))
    return F.when(t.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), t.try_cast("double")).when(t.rlike(r"^-?(\d+(\.\d+)?(ns|us|µs|ms|s|m|h|d|w|y))+$"), duration).when(t.rlike(r"^-?\d+(\.\d+)?([KMGT]i?B?|B)$"), size)


def ipv4(t: Column) -> Column:
    parts = F.split(t, r"\.")
    byte = lambda i: parts[i].try_cast("long")
    value = byte(0) * (1 << 24) + byte(1) * (1 << 16) + byte(2) * 256 + byte(3)
    small = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    return F.when(t.rlike(rf"^{small}(\.{small}){{3}}$"), value)


def natural(t: Column) -> Column:
    """Sorts texts as people do: integers, then times, then numbers, durations and sizes, then text."""
    is_int, is_time = t.rlike(r"^-?\d{1,30}$"), t.rlike(TIME)
    value = measure(t)
    rank = F.when(is_int, 0).when(is_time, 2).when(value.isNotNull(), 3).otherwise(4)
    exact = F.when(is_int, t.try_cast("decimal(38,0)")).when(is_time, F.unix_micros(t.try_cast("timestamp")).cast("decimal(38,0)"))
    return F.struct(rank.alias("r"), exact.alias("i"), F.when(rank == 3, value).alias("d"), t.alias("s"))
