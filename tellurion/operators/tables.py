"""Table functions over samples, logs and spans: what a SQL user calls.

Samples: metric, labels, ts_ms, value. Logs: ts (an integer), level, message, metadata (JSON). Spans: trace_id, span_id, parent_span_id, service, name, kind,
status, start_ts and duration_ns. Matchers are the JSON filter grammar of functions.labels; time bounds are inclusive.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tellurion.errors import QueryError
from tellurion.functions import ieee, labels as L
from tellurion.operators import windows
from tellurion.operators.windows import Grid

LEVELS = ["emergency", "alert", "critical", "error", "warning", "notice", "info", "debug"]


def selected(samples: DataFrame, metric: str, filter: str | None = None, start: int | None = None, stop: int | None = None) -> DataFrame:
    rows = samples.where(F.col("metric") == metric).where(L.filter_grammar(filter, F.col("labels")))
    if start is not None:
        rows = rows.where(F.col("ts_ms") >= start)
    if stop is not None:
        rows = rows.where(F.col("ts_ms") <= stop)
    return rows


def _series(rows: DataFrame) -> DataFrame:
    """lkey, labels, ts, seq, v."""
    lkey = F.col("lkey") if "lkey" in rows.columns else L.key(F.col("labels"))
    seq = F.col("seq").cast("long") if "seq" in rows.columns else F.lit(0).cast("long")
    return rows.select(lkey.alias("lkey"), "labels", F.col("ts_ms").alias("ts"), seq.alias("seq"), F.col("value").alias("v"))


def labelled(found: DataFrame, *columns: str | Column) -> DataFrame:
    """lkey, its labels but the metric's name, and the columns."""
    return found.select("lkey", L.drop(L.of(F.col("lkey")), ["__name__"]).alias("labels"), *columns)


def raw(samples: DataFrame, metric: str, filter: str | None = None, start: int | None = None, stop: int | None = None) -> DataFrame:
    return selected(samples, metric, filter, start, stop).select("metric", "labels", "ts_ms", "value")


def raw_batches(samples: DataFrame, metric: str, filter: str | None = None, start: int | None = None, stop: int | None = None) -> DataFrame:
    """A row for each series with its points in order."""
    rows = _series(selected(samples, metric, filter, start, stop))
    points = F.transform(F.array_sort(F.collect_list(F.struct("ts", "seq", "v"))), lambda p: F.struct(p["ts"].alias("ts"), p["v"].alias("value")))
    return labelled(rows.groupBy("lkey").agg(points.alias("points")), "points")


def latest(samples: DataFrame, metric: str, filter: str | None = None, start: int | None = None, stop: int | None = None) -> DataFrame:
    """The newest point of each series; of equal times the last written."""
    rows = _series(selected(samples, metric, filter, start, stop))
    found = rows.groupBy("lkey").agg(F.max_by(F.struct("ts", "v"), F.struct("ts", "seq")).alias("p"))
    return labelled(found, F.col("p.ts").alias("ts_ms"), F.col("p.v").alias("value"))


def aggregate(samples: DataFrame, metric: str, op: str, filter: str | None = None, start: int | None = None, stop: int | None = None) -> DataFrame:
    v = F.col("v")
    ops = {"avg": F.avg(v), "sum": F.sum(v), "min": ieee.extreme(F.min, v), "max": ieee.extreme(F.max, v), "count": F.count(v).cast("double")}
    if op not in ops:
        raise QueryError(f"unknown aggregate {op!r}")
    return labelled(_series(selected(samples, metric, filter, start, stop)).groupBy("lkey").agg(ops[op].alias("value")), "value")


def grid(samples: DataFrame, metric: str, start: int, stop: int, step: int, lookback: int, filter: str | None = None, fill: str = "none") -> DataFrame:
    """The last sample in (t - lookback, t] at each t. fill='null': a row for each t of a series, found or not."""
    if fill not in ("none", "null"):
        raise QueryError(f"unknown fill {fill!r}")
    g = Grid(start, stop, step)
    rows = _series(selected(samples, metric, filter))
    found = windows.reduce(rows, g, lookback, 0, {"value": windows.last(F.col("v"), F.struct("ts", "seq"))}).select("lkey", L.drop(F.col("labels"), ["__name__"]).alias("labels"), "t", "value")
    if fill == "null":
        series = labelled(found.select("lkey").distinct(), g.times().alias("t"))
        found = series.join(found.select("lkey", "t", "value"), ["lkey", "t"], "left").select("lkey", L.drop(F.col("labels"), ["__name__"]).alias("labels"), "t", "value")
    return found


def window(samples: DataFrame, metric: str, op: str, start: int, stop: int, step: int, width: int, filter: str | None = None) -> DataFrame:
    """A reduction over (t - width, t]: sum min max count avg delta increase rate, pNN (nearest rank), tavg:N (a mean without N % at each end)."""
    g = Grid(start, stop, step)
    rows = windows.between(_series(selected(samples, metric, filter)), g, width)
    v, order = F.col("v"), F.struct("ts", "seq")
    simple = {"sum": windows.total(v), "count": windows.count(v), "avg": windows.mean(v)}
    if op in simple:
        return windows.reduce(rows, g, width, 0, {"value": simple[op]}).select("lkey", L.drop(F.col("labels"), ["__name__"]).alias("labels"), "t", F.col("value").cast("double").alias("value"))
    if op == "delta":
        found = windows.reduce(rows, g, width, 0, {"a": windows.last(v, order), "b": windows.first(v, order)})
        return found.select("lkey", L.drop(F.col("labels"), ["__name__"]).alias("labels"), "t", (F.col("a") - F.col("b")).alias("value"))
    if op in ("min", "max"):
        found = windows.reduce(rows, g, width, 0, {"a": (windows.least if op == "min" else windows.most)(F.when(~F.isnan(v), v))})
        return found.select("lkey", L.drop(F.col("labels"), ["__name__"]).alias("labels"), "t", F.coalesce("a", F.lit(ieee.NAN)).alias("value"))
    if op in ("increase", "rate"):
        gain = F.when(v.isNotNull(), F.when(F.col("prev_v").isNull(), 0.0).when(v < F.col("prev_v"), v).otherwise(v - F.col("prev_v")))
        found = windows.reduce(windows.with_previous(rows), g, width, 0, {"a": windows.total(gain), "b": windows.first(gain, order)})
        value = F.col("a") - F.col("b")
        return found.select("lkey", L.drop(F.col("labels"), ["__name__"]).alias("labels"), "t", (value / (width / 1000) if op == "rate" else value).alias("value"))
    found = windows.reduce(rows, g, width, 0, {"a": F.collect_list(v)})
    values = F.sort_array(F.filter("a", lambda x: ~F.isnan(x)))
    n = F.size(values)
    if op.startswith("p") and op[1:].replace(".", "", 1).isdigit() and 0 < float(op[1:]) <= 100:
        rank = F.greatest(F.ceil(n * (float(op[1:]) / 100)).cast("int"), F.lit(1))
        value = F.when(n > 0, F.element_at(values, F.least(rank, F.greatest(n, F.lit(1)))))
    elif op.startswith("tavg:") and op[5:].isdigit() and 0 <= int(op[5:]) < 50:
        cut = F.floor(F.size("a") * int(op[5:]) / 100).cast("int")
        kept = F.slice(F.sort_array("a"), cut + 1, F.greatest(F.size("a") - 2 * cut, F.lit(0)))
        value = F.when(2 * cut < F.size("a"), F.aggregate(kept, F.lit(0.0), lambda s, x: s + x) / F.size(kept))
    else:
        raise QueryError(f"unknown window reduction {op!r}")
    return found.select("lkey", L.drop(F.col("labels"), ["__name__"]).alias("labels"), "t", value.alias("value"))


def tumbling(samples: DataFrame, metric: str, op: str, start: int, stop: int, step: int, filter: str | None = None) -> DataFrame:
    """Buckets [b, b + step) aligned to start: avg sum min max count first last rate. rate carries the last point of the bucket before and skips decreases."""
    rows = _series(selected(samples, metric, filter, start, stop))
    bucket = F.lit(start) + F.floor((F.col("ts") - start) / step).cast("long") * step
    v, order = F.col("v"), F.struct("ts", "seq")
    if op == "rate":
        own = Window.partitionBy("lkey").orderBy("ts", "seq")
        rows = rows.withColumn("dv", v - F.lag("v").over(own)).withColumn("dt", (F.col("ts") - F.lag("ts").over(own)) / 1000)
        rises = (F.col("dv") >= 0) & (F.col("dt") > 0)
        value = F.try_divide(F.sum(F.when(rises, F.col("dv"))), F.sum(F.when(rises, F.col("dt"))))
    else:
        table = {"avg": F.avg(v), "sum": F.sum(v), "min": ieee.extreme(F.min, v), "max": ieee.extreme(F.max, v), "count": F.count(v).cast("double"), "first": F.min_by(v, order), "last": F.max_by(v, order)}
        if op not in table:
            raise QueryError(f"unknown aggregate {op!r}")
        value = table[op]
    return labelled(rows.groupBy("lkey", bucket.alias("bucket_ms")).agg(value.alias("value")).where("value is not null"), "bucket_ms", "value")


def rollup_tier(samples: DataFrame, resolution: int) -> DataFrame:
    """count, sum, min, max, last_ts and last_value of each series and bucket of `resolution` ms."""
    rows = samples.select("metric", "labels", L.key(F.col("labels")).alias("lkey"), "ts_ms", "value", (F.floor(F.col("ts_ms") / resolution).cast("long") * resolution).alias("bucket_ms"))
    return rows.groupBy("metric", "lkey", "bucket_ms").agg(
        F.count("*").alias("n"), F.sum("value").alias("total"), ieee.extreme(F.min, F.col("value")).alias("low"), ieee.extreme(F.max, F.col("value")).alias("high"),
        F.max_by(F.struct("ts_ms", "value"), "ts_ms").alias("end"),
    ).select("metric", "lkey", L.of(F.col("lkey")).alias("labels"), "bucket_ms", "n", "total", "low", "high", F.col("end.ts_ms").alias("last_ts"), F.col("end.value").alias("last_value"))


def coarser(tier: DataFrame, resolution: int) -> DataFrame:
    """The next step of a rollup ladder, from the tier below it alone."""
    at = F.floor(F.col("bucket_ms") / resolution).cast("long") * resolution
    return tier.groupBy("metric", "lkey", at.alias("bucket_ms")).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), ieee.extreme(F.min, F.col("low")).alias("low"), ieee.extreme(F.max, F.col("high")).alias("high"),
        F.max_by(F.struct("last_ts", "last_value"), "last_ts").alias("end"),
    ).select("metric", "lkey", L.of(F.col("lkey")).alias("labels"), "bucket_ms", "n", "total", "low", "high", F.col("end.last_ts").alias("last_ts"), F.col("end.last_value").alias("last_value"))


def rollup(tier: DataFrame, metric: str, op: str, start: int, stop: int, filter: str | None = None) -> DataFrame:
    value = {"avg": F.col("total") / F.col("n"), "sum": F.col("total"), "min": F.col("low"), "max": F.col("high"), "count": F.col("n").cast("double"), "last": F.col("last_value")}
    if op not in value:
        raise QueryError(f"unknown rollup {op!r}")
    rows = tier.where((F.col("metric") == metric) & F.col("bucket_ms").between(start, stop)).where(L.filter_grammar(filter, F.col("labels")))
    return rows.select("lkey", "labels", "bucket_ms", value[op].alias("value"))


def series(samples: DataFrame, metric: str | None = None, filter: str | None = None) -> DataFrame:
    rows = samples if metric is None else samples.where(F.col("metric") == metric)
    keyed = rows.where(L.filter_grammar(filter, F.col("labels"))).withColumn("lkey", L.key(F.col("labels")))
    return keyed.groupBy("metric", "lkey").agg(F.min("ts_ms").alias("min_ts"), F.max("ts_ms").alias("max_ts"), F.count("*").alias("points")).select("metric", "lkey", L.of(F.col("lkey")).alias("labels"), "min_ts", "max_ts", "points")


def label_values(samples: DataFrame, metric: str, label: str) -> DataFrame:
    value = L.get(F.col("labels"), label)
    return samples.where(F.col("metric") == metric).select(value.alias("value")).where("value <> ''").distinct().orderBy("value")


def stats(rows: DataFrame, time: str) -> DataFrame:
    """Rows and the range of the time column, as key and value."""
    one = rows.agg(F.count("*").alias("rows"), F.min(time).alias("ts_min"), F.max(time).alias("ts_max"))
    return one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, one.columns)), F.array(*[F.col(c).cast("long") for c in one.columns]))).alias("key", "value"))


def capabilities(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(json.dumps({"languages": ["promql", "metricsql", "logsql"], "signals": ["logs", "metrics", "traces"]}, sort_keys=True)).alias("capabilities"))


# logs


def field(name: str) -> Column:
    """A top-level field of metadata as text; a missing one is null."""
    return F.get_json_object("metadata", "$." + name if name.isidentifier() else f"$['{name}']")


def log_rows(logs: DataFrame, level: str | None = None, contains: str | None = None, like: str | None = None, start: int | None = None, stop: int | None = None, fields: dict[str, str] | None = None, descending: bool = False, limit: int | None = None, offset: int = 0) -> DataFrame:
    rows = logs
    if start is not None:
        rows = rows.where(F.col("ts") >= start)
    if stop is not None:
        rows = rows.where(F.col("ts") <= stop)
    if level is not None:
        rows = rows.where(F.col("level") == level)
    if contains is not None:
        rows = rows.where(F.contains(F.lower("message"), F.lit(contains.lower())))
    if like is not None:
        rows = rows.where(F.col("message").ilike(like))
    for name, value in (fields or {}).items():
        rows = rows.where(field(name) == value)
    if limit is not None or offset:
        keys = ["ts", *(["seq"] if "seq" in logs.columns else [])]
        rows = rows.orderBy(*[F.col(k).desc() if descending else F.col(k).asc() for k in keys])
        rows = rows.offset(offset) if offset else rows
        rows = rows.limit(limit) if limit is not None else rows
    return rows


def log_count(logs: DataFrame, **filters) -> DataFrame:
    return log_rows(logs, **filters).agg(F.count("*").alias("n"))


def log_values(logs: DataFrame, name: str, limit: int = 1000, **filters) -> DataFrame:
    value = F.col("level") if name == "level" else field(name)
    return log_rows(logs, **filters).select(value.alias("value")).where("value is not null").distinct().orderBy("value").limit(limit)


def log_buckets(logs: DataFrame, start: int, stop: int, step: int, by: str = "level", **filters) -> DataFrame:
    """Counts in [b, b + step) aligned to start, by level or a field."""
    rows = log_rows(logs, start=start, stop=stop, **filters)
    bucket = F.lit(start) + F.floor((F.col("ts") - start) / step).cast("long") * step
    value = F.col("level") if by == "level" else F.coalesce(field(by), F.lit(""))
    return rows.groupBy(bucket.alias("bucket"), value.alias("key")).agg(F.count("*").alias("n"))


# health


def health_now(samples: DataFrame) -> DataFrame:
    """The newest value of each series."""
    rows = samples.select("metric", L.key(F.col("labels")).alias("lkey"), "ts_ms", "value")
    return rows.groupBy("metric", "lkey").agg(F.max_by(F.struct("ts_ms", "value"), "ts_ms").alias("p")).select("metric", "lkey", F.col("p.ts_ms").alias("ts_ms"), F.col("p.value").alias("value"))


def health_trends(samples: DataFrame) -> DataFrame:
    """First and last value of each series and the change in a second."""
    rows = samples.select("metric", L.key(F.col("labels")).alias("lkey"), "ts_ms", "value")
    ends = rows.groupBy("metric", "lkey").agg(F.min_by(F.struct("ts_ms", "value"), "ts_ms").alias("a"), F.max_by(F.struct("ts_ms", "value"), "ts_ms").alias("z"))
    slope = F.try_divide((F.col("z.value") - F.col("a.value")) * 1000, (F.col("z.ts_ms") - F.col("a.ts_ms")).cast("double"))
    return ends.select("metric", "lkey", F.col("a.value").alias("first_value"), F.col("z.value").alias("last_value"), slope.alias("per_second"))


def health_report(samples: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """Of health_now() the state by (warning, critical) limits of the metric: ok, warning, critical."""
    now = health_now(samples)
    state = F.lit("ok")
    for metric, (warning, critical) in limits.items():
        own = F.col("metric") == metric
        state = F.when(own & (F.col("value") >= critical), "critical").when(own & (F.col("value") >= warning), "warning").otherwise(state)
    return now.withColumn("state", state)


def register(spark: SparkSession, samples: str, logs: str, spans: str) -> None:
    """Views of the newest points, the series and the trace summaries over tables of these names, for SQL users."""
    from tellurion.operators import traces

    series(spark.table(samples)).createOrReplaceTempView(f"{samples}_series")
    health_now(spark.table(samples)).createOrReplaceTempView(f"{samples}_latest")
    spark.table(logs).groupBy("level").count().createOrReplaceTempView(f"{logs}_levels")
    traces.summaries(spark.table(spans)).createOrReplaceTempView(f"{spans}_summaries")
