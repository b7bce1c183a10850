"""Lowers a PromQL tree to one lazy DataFrame (labels, t, v)."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellurion.errors import LimitError, QueryError, UnsupportedError
from tellurion.functions import ieee, labels as L
from tellurion.operators import windows
from tellurion.operators.windows import Grid
from tellurion.plans import promql as P

LOOKBACK, SUBQUERY_STEP, MOST_POINTS = 300_000, 15_000, 11_000
BROADCAST_POINTS = 20_000
NAME = "__name__"
COUNTERS = ("_total", "_sum", "_count", "_bucket")


@dataclass
class Scalar:
    """An expression over t, and frames (t, value) that it needs joined."""

    expr: Column
    frames: list[DataFrame] = field(default_factory=list)
    constant: float | None = None

    def join(self, df: DataFrame) -> DataFrame:
        for f in self.frames:
            df = df.join(f, "t", "left")
        return df


@dataclass
class Context:
    samples: DataFrame  # metric, labels, ts_ms, value; perhaps seq and lkey
    grid: Grid
    lookback: int = LOOKBACK
    metricsql: bool = False
    instant: bool = False
    compensated: bool = False  # sums that carry what rounding loses, by an ordered fold: exact, but each group in one row
    annotations: list[str] = field(default_factory=list)
    counter: list[int] = field(default_factory=lambda: [0])

    def name(self) -> str:
        self.counter[0] += 1
        return f"__s{self.counter[0]}"

    def warn(self, text: str) -> None:
        if text not in self.annotations:
            self.annotations.append(text)

    @property
    def spark(self):
        return self.samples.sparkSession


def evaluate(c: Context, node):
    """A DataFrame (labels, t, v), or a Scalar."""
    match node:
        case P.Number(value):
            return Scalar(F.lit(value), constant=value)
        case P.Negate(expr):
            found = evaluate(c, expr)
            return Scalar(-found.expr, found.frames) if isinstance(found, Scalar) else vector(found, v=-F.col("v"), unnamed=True)
        case P.Selector():
            return instant(c, node)
        case P.Binary():
            return binary(c, node)
        case P.Aggregate():
            return aggregate(c, node)
        case P.Call():
            return call(c, node)
    raise QueryError(f"{type(node).__name__} can't be evaluated here")


def vector(df: DataFrame, v: Column | None = None, labels: Column | None = None, unnamed: bool = False, keep: bool = False) -> DataFrame:
    labels = labels if labels is not None else F.col("labels")
    if unnamed and not keep:
        labels = L.drop(labels, [NAME])
    return df.select(labels.alias("labels"), "t", (v if v is not None else F.col("v")).cast("double").alias("v"))


def leaf(c: Context, s: P.Selector) -> DataFrame:
    """lkey, labels, ts, seq, v of the series that match; name and labels are filtered at the scan."""
    df = c.samples
    for m in s.matchers:
        df = df.where(L.matches(F.col("metric") if m.label == NAME else L.get(F.col("labels"), m.label), m.op, m.value))
    full = F.map_concat(F.create_map(F.lit(NAME), F.col("metric")), F.col("labels"))
    lkey = F.col("lkey") if "lkey" in df.columns else L.key(full)
    seq = F.col("seq").cast("long") if "seq" in df.columns else F.lit(0).cast("long")
    return df.select(lkey.alias("lkey"), full.alias("labels"), F.col("ts_ms").alias("ts"), seq.alias("seq"), F.col("value").alias("v"))


def moment(c: Context, node) -> int | None:
    return {"start": c.grid.start, "end": c.grid.end}.get(node.at, node.at) if node.at is not None else None


def instant(c: Context, s: P.Selector, source_time: bool = False) -> DataFrame:
    last = windows.last(F.struct("v", "ts"), F.struct("ts", "seq"))
    found = windows.reduce(leaf(c, s), c.grid, c.lookback, s.offset, {"last": last}, moment(c, s))
    return found.select("labels", "t", (F.col("last.ts") / 1000 if source_time else F.col("last.v")).alias("v"))


def matrix(c: Context, node) -> tuple[DataFrame, int, int, int | None]:
    """Samples, window, offset, fixed time."""
    if isinstance(node, P.Selector):
        return leaf(c, node), node.range, node.offset, moment(c, node)
    step = node.step or SUBQUERY_STEP
    at = moment(c, node)
    first, last = (at, at) if at is not None else (c.grid.start, c.grid.last)
    begin = (first - node.offset - node.range) // step * step + step  # aligned globally, the first point lies after start - range
    end = last - node.offset
    if begin > end:
        begin = end = begin  # no point: an empty window
    inner = replace_grid(c, Grid(begin, max(begin, end), step))
    found = evaluate(inner, node.expr)
    if isinstance(found, Scalar):
        found = found.join(inner.grid.frame(c.spark)).select(L.empty().alias("labels"), "t", found.expr.cast("double").alias("v"))
    samples = found.select(L.key(F.col("labels")).alias("lkey"), "labels", F.col("t").alias("ts"), F.lit(0).cast("long").alias("seq"), "v")
    return samples, node.range, node.offset, at


def replace_grid(c: Context, grid: Grid) -> Context:
    return replace(c, grid=grid)


def call(c: Context, node: P.Call):
    name, args = node.name, node.args
    if c.metricsql and name in P.METRICSQL:
        from tellurion.operators import metricsql

        found = metricsql.call(c, node)
        if found is not None:
            return found
    if name in P.RANGE_FUNCTIONS:
        return over_time(c, node)
    if name == "time":
        return Scalar(F.col("t") / 1000)
    if name == "pi":
        return Scalar(F.lit(math.pi), constant=math.pi)
    if name == "vector":
        s = evaluate(c, args[0])
        return s.join(c.grid.frame(c.spark)).select(L.empty().alias("labels"), "t", s.expr.cast("double").alias("v"))
    if name == "scalar":
        df = evaluate(c, args[0])
        if isinstance(df, Scalar):
            return df
        column = c.name()
        one = df.groupBy("t").agg(F.when(F.count("*") == 1, F.first("v")).otherwise(ieee.NAN).alias(column))
        return Scalar(F.coalesce(column, F.lit(ieee.NAN)), [F.broadcast(one) if c.grid.count <= BROADCAST_POINTS else one])
    if name in P.CALENDAR:
        df = evaluate(c, args[0]) if args else evaluate(c, P.Call("vector", (P.Call("time", ()),)))
        return vector(df, calendar(name, F.col("v")), unnamed=True, keep=node.keep_names)
    if name in P.DROPPED_HISTOGRAM:
        return vector(evaluate(c, args[0])).limit(0)
    if name == "timestamp":
        if isinstance(args[0], P.Selector):
            return vector(instant(c, args[0], True), unnamed=True, keep=node.keep_names)
        return vector(evaluate(c, args[0]), F.col("t") / 1000, unnamed=True, keep=node.keep_names)
    if name == "absent":
        return absent(c, evaluate(c, args[0]), args[0])
    if name in ("sort", "sort_desc"):
        df = evaluate(c, args[0])
        by = F.col("v").asc() if name == "sort" else F.col("v").desc()
        return df.orderBy(F.isnan("v"), by, L.key(F.col("labels")))
    if name == "histogram_quantile":
        from tellurion.operators import histograms

        return histograms.quantile(c, evaluate(c, args[0]), evaluate(c, args[1]))
    if name == "histogram_fraction":
        from tellurion.operators import histograms

        return histograms.fraction(c, *(evaluate(c, a) for a in args))
    if name == "label_replace":
        return label_replace(evaluate(c, args[0]), *(a.value for a in args[1:]))
    if name == "label_join":
        into, between, *names = (a.value for a in args[1:])
        value = F.concat_ws(between, *[L.get(F.col("labels"), n) for n in names]) if names else F.lit("")
        return vector(evaluate(c, args[0]), labels=L.put(F.col("labels"), into, value))
    return elementwise(c, node)


def elementwise(c: Context, node: P.Call):
    first = evaluate(c, node.args[0])
    rest = [evaluate(c, a) for a in node.args[1:]]
    if isinstance(first, Scalar):  # MetricsQL
        return Scalar(math_function(c, node.name, ieee.d(first.expr), rest), first.frames + [f for r in rest for f in r.frames])
    df = reduce(lambda d, s: s.join(d), rest, first)
    if node.name == "clamp":
        low, high = rest
        df = df.where(~(ieee.d(low.expr) > ieee.d(high.expr)) | F.isnan(ieee.d(low.expr)) | F.isnan(ieee.d(high.expr)))
    return vector(df, math_function(c, node.name, F.col("v"), rest), unnamed=True, keep=node.keep_names)


def math_function(c: Context, name: str, v: Column, rest: list[Scalar]) -> Column:
    x = [ieee.d(r.expr) for r in rest]
    if name in ("abs", "sqrt", "exp", "acos", "acosh", "asin", "asinh", "atan", "atanh", "cos", "cosh", "sin", "sinh", "tan", "tanh"):
        return getattr(F, name)(v)
    if name in ("ceil", "floor"):
        return ieee.whole(v, getattr(F, name))
    if name in ("ln", "log2", "log10"):
        return ieee.logarithm(v, {"ln": F.log, "log2": F.log2, "log10": F.log10}[name])
    if name == "sgn":
        return F.when(F.isnan(v), v).when(v > 0, 1.0).when(v < 0, -1.0).otherwise(v)
    if name == "deg":
        return v * 180 / math.pi
    if name == "rad":
        return v * math.pi / 180
    if name == "round":
        inverse = 1 / x[0] if x else ieee.d(1.0)
        inverse = ieee.divide(ieee.d(1.0), x[0]) if x else inverse
        return ieee.divide(ieee.whole(v * inverse + 0.5, F.floor), inverse)
    lower = {"clamp": 0, "clamp_min": 0}.get(name)
    upper = {"clamp": 1, "clamp_max": 0}.get(name)
    out = v
    if lower is not None:
        out = F.when(F.isnan(x[lower]) | F.isnan(out), ieee.NAN).otherwise(F.greatest(out, x[lower]))
    if upper is not None:
        out = F.when(F.isnan(x[upper]) | F.isnan(out), ieee.NAN).otherwise(F.least(out, x[upper]))
    return out


def calendar(name: str, v: Column) -> Column:
    seconds = F.when(ieee.finite(v) & (F.abs(v) < 2.0**53), v).otherwise(F.lit(None)).cast("long")
    day = F.date_from_unix_date(F.floor(seconds / 86400).cast("int"))
    value = {
        "minute": F.pmod(F.floor(seconds / 60), F.lit(60)), "hour": F.pmod(F.floor(seconds / 3600), F.lit(24)), "day_of_week": F.dayofweek(day) - 1, "day_of_month": F.day(day),
        "day_of_year": F.dayofyear(day), "days_in_month": F.day(F.last_day(day)), "month": F.month(day), "year": F.year(day),
    }[name]
    # what isn't finite becomes the largest 64-bit second, in the year 292277026596
    far = {"minute": 30, "hour": 15, "day_of_week": 0, "day_of_month": 4, "day_of_year": 339, "days_in_month": 31, "month": 12, "year": 292277026596}[name]
    return F.coalesce(value.cast("double"), F.when(v.isNotNull(), F.lit(float(far))))


def absent(c: Context, df: DataFrame, node) -> DataFrame:
    known: dict[str, str | None] = {}
    if isinstance(node, P.Selector):
        for m in node.matchers:
            if m.label != NAME:
                known[m.label] = m.value if m.op == "=" and m.label not in known and m.value else None
    pairs = [F.lit(x) for k, v in known.items() if v for x in (k, v)]
    there = F.create_map(*pairs) if pairs else L.empty()
    return c.grid.frame(c.spark).join(df.select("t").distinct(), "t", "left_anti").select(there.alias("labels"), "t", F.lit(1.0).alias("v"))


def label_replace(df: DataFrame, into: str, replacement: str, source: str, pattern: str) -> DataFrame:
    value, anchored = L.get(F.col("labels"), source), L.anchored(pattern).removesuffix("$") + r"\z"
    new = F.regexp_replace(value, "(?s)" + anchored, replacement)
    return vector(df, labels=F.when(value.rlike(anchored), L.put(F.col("labels"), into, new)).otherwise(F.col("labels")))


def over_time(c: Context, node: P.Call) -> DataFrame:
    name = node.name
    source = next(a for a in node.args if a.type != "scalar")
    parameter = next((evaluate(c, a) for a in node.args if a.type == "scalar"), None)
    if source.type == "vector":  # MetricsQL: the window is the step
        if not isinstance(source, P.Selector):
            source = P.Subquery(source, c.grid.step, c.grid.step)
        else:
            from tellurion.operators import metricsql

            return metricsql.dynamic(c, name, source, node.keep_names)
    if isinstance(source, P.Selector) and name in ("rate", "irate", "increase", "resets"):
        metric = next((m.value for m in source.matchers if m.label == NAME and m.op == "="), None)
        if metric and not metric.endswith(COUNTERS):
            c.warn(f"metric might not be a counter, name does not end in _total/_sum/_count/_bucket: {metric!r}")
    samples, width, offset, at = matrix(c, source)
    if name == "absent_over_time":
        found = windows.reduce(samples, c.grid, width, offset, {"n": F.count("v")}, at)
        return absent(c, found, source)
    needs_previous = name in ("rate", "increase", "irate", "idelta", "changes", "resets")
    if needs_previous:
        samples = windows.with_previous(windows.between(samples, c.grid, width, offset) if at is None else samples.where((F.col("ts") > at - offset - width) & (F.col("ts") <= at - offset)))
    found = windows.reduce(samples, c.grid, width, offset, range_aggregates(c, name), at)
    if parameter is not None:
        found = parameter.join(found)
    base = F.lit(at) if at is not None else F.col("t")
    v = range_value(c, name, base - offset, width, parameter)
    keep_name = name == "last_over_time" or node.keep_names
    return vector(found.withColumn("v", v).where("v is not null"), unnamed=True, keep=keep_name)


def range_aggregates(c: Context, name: str) -> dict[str, Column]:
    v, order = F.col("v"), F.struct("ts", "seq")
    first, last = windows.first(v, order), windows.last(v, order)
    x = (F.col("ts") - c.grid.start) / 1000
    match name:
        case "avg_over_time" | "sum_over_time":
            if c.compensated:
                return {"a": F.collect_list(F.struct("ts", "seq", "v"))}
            return {"a": windows.mean(v) if name == "avg_over_time" else windows.total(v)}
        case "min_over_time":
            return {"a": windows.least(F.when(~F.isnan(v), v)), "n": windows.count(v)}
        case "max_over_time":
            return {"a": windows.most(F.when(~F.isnan(v), v)), "n": windows.count(v)}
        case "count_over_time" | "present_over_time":
            return {"a": windows.count(v)}
        case "last_over_time":
            return {"a": last}
        case "stddev_over_time":
            return {"a": F.stddev_pop(v)}
        case "stdvar_over_time":
            return {"a": F.var_pop(v)}
        case "quantile_over_time":
            return {"a": F.collect_list(v)}
        case "rate" | "increase" | "delta":
            own = {"n": windows.count(v), "first": first, "last": last, "first_ts": windows.least(F.when(v.isNotNull(), F.col("ts"))), "last_ts": windows.most(F.when(v.isNotNull(), F.col("ts")))}
            if name != "delta":
                drop = F.when(F.col("prev_v") > v, F.col("prev_v")).otherwise(F.when(v.isNotNull(), 0.0))
                own |= {"drops": windows.total(drop), "first_drop": windows.first(drop, order)}
            return own
        case "irate" | "idelta":
            return {"n": windows.count(v), "a": windows.last(F.struct("v", "ts", "prev_v", "prev_ts"), order)}
        case "changes" | "resets":
            differ = (F.col("prev_v") != v) & ~(F.isnan("prev_v") & F.isnan(v)) if name == "changes" else (F.col("prev_v") > v) & ~F.isnan("prev_v")
            flag = F.when(v.isNotNull(), F.when(F.coalesce(differ, F.lit(False)), 1.0).otherwise(0.0))
            return {"a": windows.total(flag), "b": windows.first(flag, order)}
        case "deriv" | "predict_linear":
            return {"n": F.count(v), "sxy": F.covar_pop(x, v), "sxx": F.var_pop(F.when(v.isNotNull(), x)), "mx": F.avg(F.when(v.isNotNull(), x)), "my": F.avg(v), "low": F.min(v), "high": F.max(v)}
    raise QueryError(f"unknown function {name}")


def range_value(c: Context, name: str, end: Column, width: int, parameter: Scalar | None) -> Column:
    """From the aggregates; `end` is the time that the window ends at."""
    a, n = F.col("a"), F.col("n")
    match name:
        case "avg_over_time" | "sum_over_time" if c.compensated:
            values = F.filter(a, lambda x: x["v"].isNotNull())
            return ieee.compensated(F.transform(F.array_sort(values), lambda x: x["v"])) / (F.size(values) if name == "avg_over_time" else F.lit(1))
        case "min_over_time" | "max_over_time":
            return F.coalesce(a, F.when(n > 0, ieee.NAN))
        case "count_over_time":
            return a.cast("double")
        case "present_over_time":
            return F.lit(1.0)
        case "quantile_over_time":
            if parameter.constant is not None and not 0 <= parameter.constant <= 1:
                c.warn(f"quantile value should be between 0 and 1, got {parameter.constant}")
            return quantile_of(a, ieee.d(parameter.expr))
        case "irate" | "idelta":
            step = a["v"] - a["prev_v"]
            if name == "irate":
                step = F.when(a["v"] < a["prev_v"], a["v"]).otherwise(step)
                step = F.try_divide(step * 1000, (a["ts"] - a["prev_ts"]).cast("double"))
            return F.when((n >= 2) & (a["ts"] > a["prev_ts"]), step)
        case "changes" | "resets":
            return a - F.col("b")
        case "rate" | "increase" | "delta":
            change = F.col("last") - F.col("first")
            if name != "delta":
                change = change + F.col("drops") - F.col("first_drop")
            return F.when((n >= 2) & (F.col("last_ts") > F.col("first_ts")), extrapolated(change, end, width, name))
        case "deriv" | "predict_linear":
            flat = (F.col("low") == F.col("high")) & ieee.finite(F.col("low"))
            slope = F.when(flat, 0.0).when(F.col("low") == F.col("high"), ieee.NAN).otherwise(ieee.divide(F.col("sxy"), F.col("sxx")))
            if name == "deriv":
                return F.when(n >= 2, slope)
            at = (end - c.grid.start) / 1000 - F.col("mx")
            return F.when(n >= 2, F.when(flat, F.col("low")).otherwise(F.col("my") + slope * (at + ieee.d(parameter.expr))))
    return a


def extrapolated(change: Column, end: Column, width: int, name: str) -> Column:
    """To the window's edges, if the samples reach near them; a counter isn't followed below zero."""
    sampled = (F.col("last_ts") - F.col("first_ts")) / 1000
    average = sampled / (F.col("n") - 1)
    to_start = (F.col("first_ts") - (end - width)) / 1000
    to_end = (end - F.col("last_ts")) / 1000
    limit = average * 1.1
    to_start = F.when(to_start >= limit, average / 2).otherwise(to_start)
    if name != "delta":
        zero = sampled * (F.col("first") / change)
        to_start = F.when((change > 0) & (F.col("first") >= 0) & (zero < to_start), zero).otherwise(to_start)
    to_end = F.when(to_end >= limit, average / 2).otherwise(to_end)
    out = change * ((sampled + to_start + to_end) / sampled)
    return out / (width / 1000) if name == "rate" else out


def quantile_of(values: Column, q: Column) -> Column:
    """Interpolated between ranks; NaN is the smallest value."""
    ordered = F.concat(F.filter(values, F.isnan), F.sort_array(F.filter(values, lambda x: ~F.isnan(x))))
    n = F.size(values)
    rank = F.least(F.greatest(q, F.lit(0.0)), F.lit(1.0)) * (n - 1)
    low = F.floor(rank).cast("int")
    high = F.least(low + 1, n - 1)
    weight = rank - low
    mid = ordered[low] * (1 - weight) + ordered[high] * weight
    return F.when(n == 0, ieee.NAN).when(F.isnan(q), ieee.NAN).when(q < 0, -ieee.INF).when(q > 1, ieee.INF).otherwise(mid)


def aggregate(c: Context, node: P.Aggregate) -> DataFrame:
    df = evaluate(c, node.expr)
    if isinstance(df, Scalar):
        df = evaluate(c, P.Call("vector", (node.expr,)))
    v = F.col("v")
    if node.without:
        group = {"__g": L.key(L.drop(F.col("labels"), [*node.labels, NAME]))}
        labels = L.of(F.col("__g"))
    else:
        group = {f"__g{i}": L.get(F.col("labels"), n) for i, n in enumerate(node.labels)}
        pairs = [x for i, n in enumerate(node.labels) for x in (F.lit(n), F.col(f"__g{i}"))]
        labels = L.keep(F.create_map(*pairs), list(node.labels)) if pairs else L.empty()
    keyed = df.withColumns(group) if group else df
    keys = ["t", *group]
    if node.op in ("topk", "bottomk"):
        k = evaluate(c, node.parameter)
        keyed = k.join(keyed)
        by = v.desc() if node.op == "topk" else v.asc()
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.isnan("v"), by, L.key(F.col("labels"))))
        if k.constant is not None:
            if math.isnan(k.constant):
                raise QueryError("parameter k is NaN")
            most: Column | int = int(max(0, min(k.constant, 2**31 - 1)))
        else:
            most = F.when(F.isnan(ieee.d(k.expr)), F.raise_error(F.lit("parameter k is NaN")).cast("double")).otherwise(ieee.d(k.expr))
        return vector(keyed.withColumn("__n", rank).where(F.col("__n") <= most))
    if node.op == "count_values":
        values = keyed.withColumn("__v", ieee.as_go(v)).groupBy(*keys, "__v").agg(F.count("*").cast("double").alias("v"))
        return vector(values, labels=L.put(labels, node.parameter.value, F.col("__v")))
    value: Column
    match node.op:
        case "sum" | "avg" if c.compensated:
            value = F.collect_list(F.struct(L.key(F.col("labels")).alias("k"), v.alias("v")))
            value = ieee.compensated(F.transform(F.array_sort(value), lambda x: x["v"])) / (F.count("*") if node.op == "avg" else F.lit(1))
        case "sum":
            value = F.sum(v)
        case "avg":
            value = F.avg(v)
        case "min":
            value = ieee.extreme(F.min, v)
        case "max":
            value = ieee.extreme(F.max, v)
        case "count":
            value = F.count("*").cast("double")
        case "group":
            value = F.max(F.lit(1.0))
        case "stddev":
            value = F.stddev_pop(v)
        case "stdvar":
            value = F.var_pop(v)
        case _:
            value = F.collect_list(v)
    grouped = keyed.groupBy(*keys).agg(value.alias("v"))
    if node.op == "quantile":
        q = evaluate(c, node.parameter)
        if q.constant is not None and not 0 <= q.constant <= 1:
            c.warn(f"quantile value should be between 0 and 1, got {q.constant}")
        grouped = q.join(grouped).withColumn("v", quantile_of(F.col("v"), ieee.d(q.expr)))
    return vector(grouped, labels=labels)


def match_key(node: P.Binary) -> Column:
    own = L.keep(F.col("labels"), list(node.labels)) if node.on else L.drop(F.col("labels"), [*node.labels, NAME])
    return L.key(own)


def binary(c: Context, node: P.Binary):
    left, right = evaluate(c, node.left), evaluate(c, node.right)
    if node.op in P.EXTENDED:
        from tellurion.operators import metricsql

        return metricsql.extended(c, node, left, right)
    scalars = isinstance(left, Scalar), isinstance(right, Scalar)
    compares = node.op in P.COMPARISONS
    if all(scalars):
        a, b = ieee.d(left.expr), ieee.d(right.expr)
        out = ieee.compare(a, node.op, b).cast("double") if compares else ieee.arithmetic(a, node.op, b)
        return Scalar(out, left.frames + right.frames)
    if any(scalars):
        if node.op in P.SETS:
            raise QueryError("set operators take instant vectors")
        scalar, df = (left, right) if scalars[0] else (right, left)
        df = scalar.join(df)
        a, b = (ieee.d(scalar.expr), F.col("v")) if scalars[0] else (F.col("v"), ieee.d(scalar.expr))
        if not compares:
            return vector(df, ieee.arithmetic(a, node.op, b), unnamed=True, keep=node.keep_names)
        holds = ieee.compare(a, node.op, b)
        return vector(df, holds.cast("double"), unnamed=True, keep=node.keep_names) if node.bool else vector(df.where(holds))
    left, right = left.withColumn("mkey", match_key(node)), right.withColumn("mkey", match_key(node))
    if node.op in P.SETS:
        seen = lambda df: df.select("t", "mkey").distinct()
        if node.op == "and":
            return vector(left.join(seen(right), ["t", "mkey"], "left_semi"))
        if node.op == "unless":
            return vector(left.join(seen(right), ["t", "mkey"], "left_anti"))
        return vector(left).union(vector(right.join(seen(left), ["t", "mkey"], "left_anti")))
    many, one = (right, left) if node.group == "right" else (left, right)
    side = "left" if node.group == "right" else "right"
    one = single(one, f"found duplicate series for the match group on the {side} hand-side of the operation").select("t", "mkey", F.col("labels").alias("o_labels"), F.col("v").alias("o_v"))
    if not node.group:
        many = single(many, "multiple matches for labels: many-to-one matching must be explicit (group_left/group_right)")
    both = many.join(one, ["t", "mkey"])
    a, b = (F.col("o_v"), F.col("v")) if node.group == "right" else (F.col("v"), F.col("o_v"))
    labels = F.col("labels")
    if not compares or node.bool:
        labels = labels if node.keep_names else L.drop(labels, [NAME])
    if not node.group:
        labels = L.keep(labels, [*node.labels, *([NAME] if node.keep_names else [])]) if node.on else L.drop(labels, list(node.labels))
    for name in node.include:
        labels = L.put(labels, name, L.get(F.col("o_labels"), name))
    if not compares:
        return vector(both, ieee.arithmetic(a, node.op, b), labels)
    holds = ieee.compare(a, node.op, b)
    return vector(both, holds.cast("double"), labels) if node.bool else vector(both.where(holds), a, labels)


def single(df: DataFrame, message: str) -> DataFrame:
    """One row for each (t, mkey); more raise when they are read."""
    one = df.groupBy("t", "mkey").agg(F.count("*").alias("__n"), F.any_value("labels").alias("labels"), F.any_value("v").alias("v"))
    return one.withColumn("v", F.when(F.col("__n") > 1, F.raise_error(F.lit(message)).cast("double")).otherwise(F.col("v"))).drop("__n")


def as_vector(c: Context, found) -> DataFrame:
    if isinstance(found, Scalar):
        return found.join(c.grid.frame(c.spark)).select(L.empty().alias("labels"), "t", found.expr.cast("double").alias("v"))
    return found


def run(samples: DataFrame, text: str, start: int, end: int, step: int, lookback: int = LOOKBACK, metricsql: bool = False, most_points: int = MOST_POINTS, compensated: bool = False, annotations: list[str] | None = None) -> DataFrame:
    grid = Grid(start, end, step)
    if grid.count > most_points:
        raise LimitError(f"exceeded maximum resolution of {most_points} points per series")
    node = P.parse_metricsql(text, start, end, step) if metricsql else P.parse(text)
    if node.type in ("matrix", "string") and not (metricsql and node.type == "matrix"):
        raise QueryError(f"invalid expression type {node.type!r} for range query, must be scalar or instant vector")
    c = Context(samples, grid, lookback, metricsql, compensated=compensated, annotations=annotations if annotations is not None else [])
    return as_vector(c, evaluate(c, node))


def run_instant(samples: DataFrame, text: str, at: int, lookback: int = LOOKBACK, metricsql: bool = False, compensated: bool = False, annotations: list[str] | None = None):
    """A DataFrame (labels, t, v); of a range selector the samples in its window; of a string literal the string."""
    node = P.parse_metricsql(text, at, at, lookback) if metricsql else P.parse(text)
    c = Context(samples, Grid(at, at, lookback if metricsql else 1), lookback, metricsql, True, compensated, annotations if annotations is not None else [])
    if node.type == "string":
        return node.value
    if node.type == "matrix":
        rows, width, offset, fixed = matrix(c, node)
        end = (fixed if fixed is not None else at) - offset
        return rows.where((F.col("ts") > end - width) & (F.col("ts") <= end)).select("labels", F.col("ts").alias("t"), "v")
    return as_vector(c, evaluate(c, node))


__all__ = ["Context", "Scalar", "UnsupportedError", "evaluate", "run", "run_instant"]
