"""Trace queries over spans."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellurion.errors import QueryError

KINDS, STATUSES = ("internal", "server", "client", "producer", "consumer", "unspecified"), ("unset", "ok", "error")
UNITS_NS = {"ns": 1, "us": 1_000, "µs": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000}


def duration_ns(text: str) -> int:
    """1.5ms, 100us, 2s."""
    m = re.fullmatch(r"(\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h)", text.strip())
    if not m:
        raise QueryError(f"bad duration {text!r}")
    return int(float(m[1]) * UNITS_NS[m[2]])


def services(spans: DataFrame) -> DataFrame:
    return spans.select("service").where("service is not null and service <> ''").distinct().orderBy("service")


def operations(spans: DataFrame, service: str | None = None) -> DataFrame:
    rows = spans if service is None else spans.where(F.col("service") == service)
    return rows.select("name").distinct().orderBy("name")


def trace(spans: DataFrame, trace_id) -> DataFrame:
    return spans.where(F.col("trace_id") == F.lit(trace_id)).orderBy("start_ts", "span_id")


def jaeger_trace(spans: DataFrame, trace_id) -> DataFrame:
    """One row, the trace as Jaeger's JSON has it: spans with references, times in µs, and their processes."""
    us = lambda c: F.floor(F.col(c) / 1000).cast("long")
    reference = F.struct(F.lit("CHILD_OF").alias("refType"), F.col("trace_id").cast("string").alias("traceID"), F.col("parent_span_id").cast("string").alias("spanID"))
    tag = lambda k, v: F.struct(F.lit(k).alias("key"), F.lit("string").alias("type"), v.cast("string").alias("value"))
    tags = F.filter(F.array(tag("span.kind", F.col("kind")), tag("otel.status_code", F.upper("status"))), lambda t: t["value"].isNotNull())
    span = F.struct(
        F.col("trace_id").cast("string").alias("traceID"), F.col("span_id").cast("string").alias("spanID"), F.col("name").alias("operationName"), F.when(F.col("parent_span_id").isNotNull(), F.array(reference)).otherwise(F.array()).alias("references"),
        us("start_ts").alias("startTime"), us("duration_ns").alias("duration"), F.col("service").alias("processID"), tags.alias("tags"),
    )
    rows = spans.where(F.col("trace_id") == F.lit(trace_id))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("start_ts", "span_id", span.alias("span")))), lambda x: x["span"])
    process = F.sort_array(F.collect_set("service"))
    one = rows.groupBy(F.col("trace_id").cast("string").alias("traceID")).agg(ordered.alias("spans"), process.alias("p"))
    processes = F.map_from_arrays("p", F.transform("p", lambda s: F.struct(s.alias("serviceName"))))
    return one.select("traceID", F.to_json(F.struct("traceID", "spans", processes.alias("processes"))).alias("trace"))


def attribute(column: str, pointer: str, value) -> Column:
    """Typed equality at a JSON pointer: 1, 1.0, "1" and true all differ."""
    if not pointer.startswith("/"):
        raise QueryError("a JSON pointer begins with /")
    steps = [x.replace("~1", "/").replace("~0", "~") for x in pointer[1:].split("/")]
    path = "$" + "".join(f"[{x}]" if x.isdigit() else f"['{x}']" for x in steps)
    text = F.get_json_object(column, path)
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(F.col(column)), path, "variant"))
    if isinstance(value, bool):
        return F.coalesce((text == str(value).lower()) & (kind == "BOOLEAN"), F.lit(False))
    if isinstance(value, str):
        return F.coalesce((text == value) & (kind == "STRING"), F.lit(False))
    if isinstance(value, int):
        return F.coalesce((text == str(value)) & (kind == "BIGINT"), F.lit(False))
    if isinstance(value, float):
        return F.coalesce((text.try_cast("double") == value) & text.rlike(r"[.eE]"), F.lit(False))
    raise QueryError("attributes are compared with scalars")


def search(spans: DataFrame, service: str | None = None, operation: str | None = None, start_us: int | None = None, end_us: int | None = None, min_duration: str | None = None, max_duration: str | None = None, attributes: dict | None = None, limit: int = 20) -> DataFrame:
    """The newest `limit` spans that match, grouped by trace: the newest trace first. A trace may come in part."""
    if not 0 < limit <= 1_000_000:
        raise QueryError("the limit is out of range")
    found = matching(spans, service, operation, start_us, end_us, min_duration, max_duration, attributes)
    newest = found.orderBy(F.desc("start_ts"), F.desc("span_id")).limit(limit)
    return newest.groupBy("trace_id").agg(F.count("*").alias("spans"), F.min("start_ts").alias("start_ts"), F.max(F.col("start_ts") + F.col("duration_ns")).alias("end_ts"), F.sort_array(F.collect_list("span_id")).alias("span_ids")).orderBy(F.desc("start_ts"), "trace_id")


def matching(spans: DataFrame, service=None, operation=None, start_us=None, end_us=None, min_duration=None, max_duration=None, attributes=None) -> DataFrame:
    rows = spans
    for column, value in (("service", service), ("name", operation)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if start_us is not None:
        rows = rows.where(F.col("start_ts") >= start_us * 1000)
    if end_us is not None:
        rows = rows.where(F.col("start_ts") <= end_us * 1000)
    if min_duration is not None:
        rows = rows.where(F.col("duration_ns") >= duration_ns(min_duration))
    if max_duration is not None:
        rows = rows.where(F.col("duration_ns") <= duration_ns(max_duration))
    for (column, pointer), value in (attributes or {}).items():
        rows = rows.where(attribute(column, pointer, value))
    return rows


def of_kind(rows: DataFrame, kind: str | None, status: str | None) -> DataFrame:
    """Spans of a kind and status; names that are neither are an error."""
    for column, value, known in (("kind", kind, KINDS), ("status", status, STATUSES)):
        if value is not None:
            if value not in known:
                raise QueryError(f"unknown {column} {value!r}")
            rows = rows.where(F.col(column) == value)
    return rows


def span_search(spans: DataFrame, kind: str | None = None, status: str | None = None, text: str | None = None, limit: int = 100, offset: int = 0, descending: bool = True, **filters) -> DataFrame:
    """A page of spans and has_more. text: part of the name or, where the column is there, of a string value among the attributes, at any depth; keys and numbers don't count."""
    rows = of_kind(matching(spans, **filters), kind, status)
    if text is not None:
        wanted = F.lower(F.lit(text))
        found = F.contains(F.lower("name"), wanted)
        if "attributes" in spans.columns:
            # a string of JSON is a value unless a colon follows it
            values = F.regexp_extract_all(F.coalesce("attributes", F.lit("")), F.lit(r'("(?:[^"\\]|\\.)*+")(?!\s*:)'), F.lit(1))
            decoded = lambda v: F.coalesce(F.get_json_object(F.concat(F.lit('{"a":'), v, F.lit("}")), "$.a"), v)
            found = found | F.exists(values, lambda v: F.contains(F.lower(decoded(v)), wanted))
        rows = rows.where(found)
    keys = [F.desc(c) if descending else F.asc(c) for c in ("start_ts", "span_id")]
    # the row after the page tells whether there is more; the page is ordered in one step, so a window over it is over limit + 1 rows
    page = rows.orderBy(*keys).offset(offset).limit(limit + 1)
    ranked = page.withColumn("__n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*keys))).withColumn("has_more", F.count("*").over(Window.partitionBy(F.lit(0))) > limit)
    return ranked.where(F.col("__n") <= limit).drop("__n")


def buckets(spans: DataFrame, start: int, stop: int, step: int) -> DataFrame:
    """Of each bucket [b, b + step) aligned to start, and service: spans, errors, and durations with nearest-rank percentiles."""
    rows = spans.where(F.col("start_ts").between(start, stop))
    bucket = F.lit(start) + F.floor((F.col("start_ts") - start) / step).cast("long") * step
    d, keys = F.col("duration_ns"), ["bucket", "service"]
    # how often each duration occurs, combined on the map side; what is ranked is these counts, in an order that a hot service shares among no more tasks than it has, but spills
    counts = rows.groupBy(bucket.alias("bucket"), "service", "duration_ns").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "error").alias("errors"))
    own = Window.partitionBy(*keys)
    ranked = counts.select("*", F.sum("n").over(own.orderBy("duration_ns").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("n").over(own).alias("all"))
    at = lambda p: F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * p), d))
    return ranked.groupBy(*keys).agg(
        F.sum("n").alias("spans"), F.sum("errors").alias("errors"), F.sum(d * F.col("n")).alias("dur_sum"), F.min(d).alias("dur_min"), F.max(d).alias("dur_max"),
        at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"),
    )


def summaries(spans: DataFrame) -> DataFrame:
    """A row for each trace: its spans, errors, extent, services and root; root_state is unique, missing or ambiguous."""
    root = F.col("parent_span_id").isNull()
    # first by span, then by trace: both aggregations go by the trace, so the spans are shuffled once
    one = spans.repartition("trace_id").groupBy("trace_id", "span_id").agg(
        F.count("*").alias("rows"), F.count_if(F.col("status") == "error").alias("errors"), F.min("start_ts").alias("start_ts"), F.max(F.col("start_ts") + F.col("duration_ns")).alias("end_ts"),
        F.collect_set("service").alias("services"), F.count_if(root).alias("roots"), F.min(F.when(root, F.col("name"))).alias("root_name"), F.min(F.when(root, F.col("service"))).alias("root_service"),
    )
    return one.groupBy("trace_id").agg(
        F.sum("rows").alias("rows"), F.count_if(F.col("span_id").isNotNull()).alias("spans"), F.sum("errors").alias("errors"), F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"),
        F.size(F.array_distinct(F.flatten(F.collect_set("services")))).cast("long").alias("service_count"), F.sum("roots").alias("roots"), F.min("root_name").alias("root_name"), F.min("root_service").alias("root_service"),
    ).select(
        "trace_id", "rows", "spans", "errors", "start_ts", "end_ts", (F.col("end_ts") - F.col("start_ts")).alias("duration_ns"), "service_count",
        F.when(F.col("roots") == 1, "unique").when(F.col("roots") == 0, "missing").otherwise("ambiguous").alias("root_state"), F.when(F.col("roots") == 1, F.col("root_name")).alias("root_name"), F.when(F.col("roots") == 1, F.col("root_service")).alias("root_service"),
    )


def parse_attributes(text: str) -> dict:
    """{"span:/http.status": 200} as search() takes it."""
    try:
        raw = json.loads(text)
    except ValueError as e:
        raise QueryError(f"bad attributes: {e}") from None
    return {(k.split(":", 1)[0], k.split(":", 1)[1]): v for k, v in raw.items()}
