"""Text formats into the frames of the three signals, by column expressions. Lines that can't be read are kept apart, not dropped silently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = {
    "emerg": "emergency", "panic": "emergency", "emergency": "emergency", "alert": "alert", "crit": "critical", "fatal": "critical", "critical": "critical", "err": "error", "error": "error", "warn": "warning", "warning": "warning",
    "notice": "notice", "info": "info", "information": "info", "debug": "debug", "trace": "debug",
}
SAMPLE = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\{(.*)\})?\s+(\S+)(?:\s+(-?\d+))?\s*$"
LABEL = r'([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*"((?:\\.|[^"\\])*)"'
OTLP = "resourceSpans array<struct<resource:string,scopeSpans:array<struct<scope:string,spans:array<struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:string,startTimeUnixNano:string,endTimeUnixNano:string,status:struct<code:string,message:string>,attributes:string,events:string,links:string>>>>>>"
KINDS = {"0": "unspecified", "1": "internal", "2": "server", "3": "client", "4": "producer", "5": "consumer"}


def _value(text: Column) -> Column:
    lower = F.lower(text)
    return F.when(lower.isin("+inf", "inf"), float("inf")).when(lower == "-inf", -float("inf")).when(lower == "nan", float("nan")).otherwise(text.try_cast("double"))


def prometheus_text(lines: DataFrame, now_ms: int, column: str = "value") -> DataFrame:
    """metric, labels, ts_ms, value, and error: true for a line that is neither a sample nor a comment. A missing or zero time is now."""
    line = F.trim(F.col(column))
    rows = lines.select(line.alias("line")).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    part = lambda i: F.regexp_extract("line", SAMPLE, i)
    unescaped = lambda v: F.replace(F.replace(F.replace(v, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    keys, values = F.regexp_extract_all(part(2), F.lit(LABEL), F.lit(1)), F.regexp_extract_all(part(2), F.lit(LABEL), F.lit(2))
    ts = part(4).try_cast("long")
    return rows.select(
        part(1).alias("metric"), F.map_from_arrays(F.array_distinct(keys), F.slice(F.transform(values, unescaped), 1, F.size(F.array_distinct(keys)))).alias("labels"),
        F.when(F.coalesce(ts, F.lit(0)) == 0, F.lit(now_ms)).otherwise(ts).alias("ts_ms"), _value(part(3)).alias("value"), F.col("line"),
    ).withColumn("error", (F.col("metric") == "") | F.col("value").isNull())


def victoria_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """{"metric": {...}, "values": [...], "timestamps": [...]} as samples."""
    kind = "metric map<string,string>, values array<double>, timestamps array<long>"
    rows = lines.select(F.from_json(column, kind).alias("j")).where("j.metric is not null")
    zipped = rows.select("j.metric", F.explode(F.arrays_zip("j.values", "j.timestamps")).alias("p"))
    labels = F.map_filter("metric", lambda k, v: k != "__name__")
    return zipped.select(F.coalesce(F.try_element_at("metric", F.lit("__name__")), F.lit("")).alias("metric"), labels.alias("labels"), F.col("p.timestamps").alias("ts_ms"), F.col("p.values").alias("value")).where("ts_ms is not null and value is not null")


def victoria_export(samples: DataFrame) -> DataFrame:
    """The same lines, one for each series, its points in order."""
    full = F.map_concat(F.create_map(F.lit("__name__"), F.col("metric")), F.col("labels"))
    keyed = samples.select(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(full)))).alias("names"), "ts_ms", "value")
    points = F.array_sort(F.collect_list(F.struct("ts_ms", "value")))
    rows = keyed.groupBy("names").agg(points.alias("p"))
    return rows.select(F.concat(F.lit('{"metric":'), "names", F.lit(',"values":'), F.to_json("p.value"), F.lit(',"timestamps":'), F.to_json("p.ts_ms"), F.lit("}")).alias("value"))


def micros(text: Column) -> Column:
    """RFC 3339, or a number in the unit that its magnitude tells: s, ms, µs, ns."""
    n = text.try_cast("double")
    size = F.abs(n)
    number = F.when(size < 1e11, n * 1e6).when(size < 1e14, n * 1e3).when(size < 1e17, n).otherwise(n / 1e3).cast("long")
    return F.coalesce(number, F.unix_micros(text.try_cast("timestamp")))


def ndjson_logs(lines: DataFrame, now_us: int, message: str = "_msg", time: str = "_time", column: str = "value") -> DataFrame:
    """ts, level, message, metadata: what other fields the line has. An unknown level is info; lines that are no objects have error true."""
    v = F.try_parse_json(F.col(column))
    whole = F.try_variant_get(v, "$", "map<string,variant>")
    field = lambda name: F.get_json_object(column, f"$['{name}']")
    level = F.lower(F.coalesce(field("level"), field("severity"), F.lit("info")))
    known = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])
    rest = F.map_filter(whole, lambda k, _: ~k.isin(message, time, "level"))
    entries = F.transform(F.map_entries(rest), lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), F.coalesce(F.to_json(e["value"]), F.lit("null"))))
    return lines.select(
        F.coalesce(micros(field(time)), F.lit(now_us)).alias("ts"), F.coalesce(F.try_element_at(known, level), F.lit("info")).alias("level"), F.coalesce(field(message), F.lit("")).alias("message"),
        F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}")).alias("metadata"), whole.isNull().alias("error"),
    )


def otlp_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """Spans of OTLP JSON requests. A span with a bad id, or that ends before it starts, has error true."""
    rows = lines.select(F.from_json(column, OTLP).alias("j")).select(F.explode("j.resourceSpans").alias("r"))
    rows = rows.select(F.col("r.resource").alias("resource"), F.explode("r.scopeSpans").alias("s")).select("resource", F.col("s.scope").alias("scope"), F.explode("s.spans").alias("x"))
    attributes = F.from_json(F.get_json_object("resource", "$.attributes"), "array<struct<key:string,value:struct<stringValue:string>>>")
    service = F.filter(attributes, lambda a: a["key"] == "service.name")
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    kind = F.coalesce(F.try_element_at(kinds, F.col("x.kind")), F.lower(F.replace("x.kind", F.lit("SPAN_KIND_"), F.lit(""))), F.lit("unspecified"))
    status = F.when(F.col("x.status.code").isin("2", "STATUS_CODE_ERROR"), "error").when(F.col("x.status.code").isin("1", "STATUS_CODE_OK"), "ok").otherwise("unset")
    start, end = F.col("x.startTimeUnixNano").try_cast("long"), F.col("x.endTimeUnixNano").try_cast("long")
    hexes = lambda c, n: F.coalesce(F.col(c).rlike(f"^[0-9a-fA-F]{{{n}}}$") & ~F.col(c).rlike("^0*$"), F.lit(False))
    return rows.select(
        F.lower("x.traceId").alias("trace_id"), F.lower("x.spanId").alias("span_id"), F.nullif(F.lower("x.parentSpanId"), F.lit("")).alias("parent_span_id"), F.coalesce(F.try_element_at(service, F.lit(1))["value"]["stringValue"], F.lit("")).alias("service"),
        F.col("x.name").alias("name"), kind.alias("kind"), status.alias("status"), start.alias("start_ts"), (end - start).alias("duration_ns"), F.col("x.attributes").alias("attributes"), F.col("x.events").alias("events"), F.col("x.links").alias("links"), "resource", "scope",
        ~(hexes("x.traceId", 32) & hexes("x.spanId", 16) & F.coalesce(end >= start, F.lit(False))).alias("error"),
    )
