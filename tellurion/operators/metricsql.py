"""What MetricsQL adds to PromQL: default, if, ifnot; unions; label editing; rollups without a window; ranges over the whole grid."""

from __future__ import annotations

import struct
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tellurion.errors import QueryError
from tellurion.functions import ieee, labels as L
from tellurion.operators import promql as Q
from tellurion.operators import windows
from tellurion.plans import promql as P

SILENCE, STALE_BITS = 300_000, 0x7FF0000000000002
ADJUSTS = {"default", "rate", "irate", "deriv", "timestamp"}
NEEDS_HISTORY = {"default", "rate", "irate", "increase", "delta", "idelta", "changes", "resets"}
STRIPS_RESETS = {"rate", "irate", "increase"}
KEEPS_NAME = {"default", "avg", "min", "max", "first", "last"}


def call(c: Q.Context, node: P.Call):
    """None: the function is PromQL's own."""
    name, args = node.name, node.args
    if name == "union":
        return union(c, [Q.as_vector(c, Q.evaluate(c, a)) for a in args])
    if name == "alias":
        return Q.vector(Q.as_vector(c, Q.evaluate(c, args[0])), labels=F.create_map(F.lit("__name__"), F.lit(args[1].value)))
    if name in ("label_set", "label_del"):
        df = Q.as_vector(c, Q.evaluate(c, args[0]))
        texts = [a.value for a in args[1:]]
        if name == "label_del":
            return Q.vector(df, labels=L.drop(F.col("labels"), texts))
        if len(texts) % 2:
            raise QueryError("label_set takes pairs of names and values")
        labels = F.col("labels")
        for label, value in zip(texts[::2], texts[1::2]):
            labels = L.put(labels, label, F.lit(value))
        return Q.vector(df, labels=labels)
    if name in ("default_rollup", "first_over_time"):
        source = args[0]
        if isinstance(source, P.Selector) and source.range is None:
            return dynamic(c, name, source, node.keep_names)
        samples, width, offset, at = Q.matrix(c, source)
        order = F.struct("ts", "seq")
        value = (F.min_by if name == "first_over_time" else F.max_by)("v", order)
        return Q.vector(windows.reduce(samples, c.grid, width, offset, {"v": value}, at))
    if name == "timestamp" and isinstance(args[0], P.Selector) and args[0].range is None and not c.instant:
        return dynamic(c, name, args[0], node.keep_names)
    if name.startswith(("range_", "running_")):
        return over_grid(c, name, Q.as_vector(c, Q.evaluate(c, args[0])), node.keep_names)
    if name == "histogram_quantiles":
        return histogram_quantiles(c, node)
    return None


def union(c: Q.Context, parts: list[DataFrame]) -> DataFrame:
    """The first part that has a label set wins it, over the whole grid."""
    both = None
    for i, df in enumerate(parts):
        own = df.select("labels", "t", "v", F.lit(i).alias("__part"), L.key(F.col("labels")).alias("__k"))
        both = own if both is None else both.union(own)
    first = F.min("__part").over(Window.partitionBy("__k"))
    return Q.vector(both.withColumn("__first", first).where("__part = __first"))


def extended(c: Q.Context, node: P.Binary, left, right):
    """default, if, ifnot. What is missing or NaN is absent."""
    scalar = isinstance(left, Q.Scalar), isinstance(right, Q.Scalar)
    if all(scalar):
        a, b = ieee.d(left.expr), ieee.d(right.expr)
        out = {"default": F.when(F.isnan(a), b).otherwise(a), "if": F.when(F.isnan(b), ieee.NAN).otherwise(a), "ifnot": F.when(F.isnan(b), a).otherwise(ieee.NAN)}[node.op]
        return Q.Scalar(out, left.frames + right.frames)
    df = Q.as_vector(c, left)
    if scalar[1]:
        held, other = right.join(df.where(~F.isnan("v"))), ieee.d(right.expr)
        if node.op == "default":
            series = df.select("labels", L.key(F.col("labels")).alias("__k")).groupBy("__k").agg(F.any_value("labels").alias("labels"))
            grid = series.select("__k", "labels", c.grid.times().alias("t"))
            own = df.where(~F.isnan("v")).select(L.key(F.col("labels")).alias("__k"), "t", "v")
            return Q.vector(right.join(grid.join(own, ["__k", "t"], "left")), F.coalesce("v", other))
        return Q.vector(held.where(~F.isnan(other) if node.op == "if" else F.isnan(other)))
    key = Q.match_key(node)
    a, b = df.where(~F.isnan("v")).withColumn("mkey", key), right.where(~F.isnan("v")).withColumn("mkey", key)
    seen = b.select("t", "mkey").distinct()
    if node.op == "if":
        return Q.vector(a.join(seen, ["t", "mkey"], "left_semi"))
    if node.op == "ifnot":
        return Q.vector(a.join(seen, ["t", "mkey"], "left_anti"))
    # default: where the left has no value, the right's under the left's labels if it has the series, else under its own
    names = df.withColumn("mkey", key).groupBy("mkey").agg(F.any_value("labels").alias("l_labels"))
    rest = b.join(a.select("t", "mkey").distinct(), ["t", "mkey"], "left_anti").join(names, "mkey", "left")
    return Q.vector(a).union(Q.vector(rest, labels=F.coalesce("l_labels", "labels")))


def over_grid(c: Q.Context, name: str, df: DataFrame, keep: bool) -> DataFrame:
    """range_* over all points of a series, running_* up to each, on every grid point from its first."""
    kind, op = name.split("_")
    keyed = df.where(~F.isnan("v")).select(L.key(F.col("labels")).alias("__k"), "labels", "t", "v")
    series = keyed.groupBy("__k").agg(F.any_value("labels").alias("labels"), F.min("t").alias("__from"))
    dense = series.select("__k", "labels", "__from", c.grid.times().alias("t"))
    dense = dense.join(keyed.select("__k", "t", "v"), ["__k", "t"], "left")
    ordered = Window.partitionBy("__k").orderBy("t")
    frame = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing if kind == "range" else 0)
    value = {"min": F.min("v"), "max": F.max("v"), "sum": F.sum("v"), "avg": F.avg("v")}[op].over(frame)
    if kind == "running":
        dense = dense.where("t >= __from")
    labels = F.col("labels") if keep or op in ("min", "max", "avg") else L.drop(F.col("labels"), ["__name__"])
    return Q.vector(dense.select("labels", "t", value.alias("v")).where("v is not null"), labels=labels)


def histogram_quantiles(c: Q.Context, node: P.Call) -> DataFrame:
    from tellurion.operators import histograms

    label, *phis, source = node.args
    rows = histograms.buckets(c, from_vmrange(Q.as_vector(c, Q.evaluate(c, source))))
    pairs = []
    for p in phis:
        q = Q.evaluate(c, p)
        if q.constant is None:
            raise QueryError("histogram_quantiles takes constant quantiles")
        pairs.append(F.struct(F.lit(f"{q.constant:g}").alias("name"), F.lit(float(q.constant)).alias("q")))
    each = rows.withColumn("p", F.explode(F.array(*pairs)))
    return each.select(L.put(F.col("labels"), label.value, F.col("p.name")).alias("labels"), "t", histograms.quantile_value(F.col("b"), F.col("p.q")).cast("double").alias("v"))


def from_vmrange(df: DataFrame) -> DataFrame:
    """Buckets named by a range become cumulative ones named by their upper bound."""
    span = L.get(F.col("labels"), "vmrange")
    plain = df.where(span == "")
    ranged = df.where(span != "").select(L.drop(F.col("labels"), ["vmrange", "le"]).alias("labels"), "t", "v", F.split_part(span, F.lit("..."), F.lit(2)).alias("up"))
    ranged = ranged.withColumn("k", L.key(F.col("labels"))).withColumn("n", histograms_bound(F.col("up")))
    total = Window.partitionBy("k", "t")
    upto = ranged.withColumn("v", F.sum("v").over(total.orderBy("n").rangeBetween(Window.unboundedPreceding, 0)))
    top = ranged.groupBy("k", "t").agg(F.any_value("labels").alias("labels"), F.sum("v").alias("v")).select(L.put(F.col("labels"), "le", F.lit("+Inf")).alias("labels"), "t", "v")
    below = upto.where("n < double('Infinity')").select(L.put(F.col("labels"), "le", F.col("up")).alias("labels"), "t", "v")
    return plain.select("labels", "t", "v").union(below).union(top)


def histograms_bound(text):
    from tellurion.operators import histograms

    return histograms.bound(text)


def dynamic(c: Q.Context, name: str, s: P.Selector, keep: bool) -> DataFrame:
    """A rollup without a window: it follows from each series' own spacing, so each series is walked by itself."""
    op = {"default_rollup": "default", "timestamp": "timestamp"}.get(name, name.removesuffix("_over_time"))
    if op not in ADJUSTS | NEEDS_HISTORY | {"avg", "min", "max", "sum", "count", "present", "stddev", "stdvar", "first", "last"}:
        raise QueryError(f"{name} needs a window")
    grid, at, look = c.grid, Q.moment(c, s), c.lookback if c.lookback != Q.LOOKBACK else 0
    history = max(SILENCE, look) + grid.step if op in NEEDS_HISTORY else grid.step
    first, last = (at, at) if at is not None else (grid.start, grid.last)
    samples = Q.leaf(c, s).where((F.col("ts") >= first - s.offset - history) & (F.col("ts") <= last - s.offset))
    start, step, count, offset, instant = grid.start, grid.step, grid.count, s.offset, c.instant

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "seq"])
        series = Series(op, pdf["ts"].to_numpy(np.int64), pdf["v"].to_numpy(np.float64), step, instant, look)
        t = start + step * np.arange(count)
        v = [series.at(int(x)) for x in ((t if at is None else np.full(count, at)) - offset)]
        some = [i for i, x in enumerate(v) if x is not None]
        labels = pdf["names"].iloc[0]
        return pd.DataFrame({"names": [labels] * len(some), "t": t[some], "v": [float(v[i]) for i in some]})

    found = samples.select("lkey", F.to_json("labels").alias("names"), "ts", "seq", "v").groupBy("lkey").applyInPandas(walk, "names string, t long, v double")
    df = found.select(F.from_json("names", "map<string,string>").alias("labels"), "t", "v")
    return Q.vector(df, unnamed=op not in KEEPS_NAME, keep=keep)


def spacing(ts: np.ndarray, otherwise: int) -> int:
    """The 0.6 quantile of the last 20 gaps."""
    if len(ts) < 2:
        return otherwise
    found = int(np.quantile(np.diff(ts[-21:]).astype(float), 0.6))
    return found if found > 0 else otherwise


def jitter(interval: int) -> int:
    for most, factor in ((2_000, 5.0), (4_000, 3.0), (8_000, 2.0), (16_000, 1.5), (32_000, 1.25)):
        if interval <= most:
            return int(interval * factor)
    return interval + interval // 8


def is_stale(v: float) -> bool:
    return struct.pack("<d", v) == struct.pack("<Q", STALE_BITS)


class Series:
    def __init__(self, op: str, ts: np.ndarray, v: np.ndarray, step: int, instant: bool, look: int):
        self.op, self.ts, self.v, self.look = op, ts, v.copy(), look
        self.before = step if instant else jitter(spacing(ts, step))
        if look:
            self.before = min(self.before, look)
        self.window = max(step, self.before) if op in ADJUSTS else step
        if op == "default" and look:
            self.window = min(self.window, look)
        if op in STRIPS_RESETS:
            self.strip()

    def strip(self) -> None:
        """Adds up what counters lost at resets; a small loss counts as noise that is made good alone."""
        added, previous, reached = 0.0, None, None
        for i, x in enumerate(self.v.tolist()):
            gap = i and self.look and self.ts[i] - self.ts[i - 1] > self.look
            if x != x or previous is None:
                added, reached = 0.0, x
            else:
                if x < previous:
                    added += previous - x if (previous - x) * 8 < previous else previous
                if gap:
                    added, reached = 0.0, x
                else:
                    self.v[i] = x + added
                    if reached == reached and self.v[i] < reached:
                        self.v[i] = reached
                    reached = self.v[i]
            previous = x

    def at(self, end: int) -> float | None:
        op, ts, v = self.op, self.ts, self.v
        lower = end - self.window
        lo, hi = int(np.searchsorted(ts, lower, "right")), int(np.searchsorted(ts, end, "right"))
        if op in ("default", "last", "first", "timestamp"):
            if lo == hi:
                return None
            i = lo if op == "first" else hi - 1
            return None if is_stale(v[i]) else ts[i] / 1000 if op == "timestamp" else v[i]
        t, x = ts[lo:hi], v[lo:hi]
        if np.isnan(x).any():
            stale = [i for i, y in enumerate(x) if is_stale(y)]
            begin = stale[-1] + 1 if stale else 0
            t, x = t[begin:], x[begin:]
            t, x = t[~np.isnan(x)], x[~np.isnan(x)]
        n = len(x)
        if op in ("avg", "min", "max", "sum", "count", "present", "stddev", "stdvar"):
            if not n:
                return None
            return {"avg": np.mean, "min": np.min, "max": np.max, "sum": np.sum, "count": len, "present": lambda _: 1.0, "stddev": np.std, "stdvar": np.var}[op](x)
        if op == "deriv":
            if n < 2:
                return 0.0 if n else None
            s = (t - t[0]) / 1000
            spread = ((s - s.mean()) ** 2).sum()
            return 0.0 if (x == x[0]).all() else ((s - s.mean()) * (x - x.mean())).sum() / spread if spread else float("nan")
        previous = (ts[lo - 1], v[lo - 1]) if lo and ts[lo - 1] > lower - self.before and v[lo - 1] == v[lo - 1] else None
        if not n:
            return None if op == "irate" or previous is None else 0.0
        real = v[lo - 1] if lo and v[lo - 1] == v[lo - 1] and not (self.look and t[0] - ts[lo - 1] >= self.look) else None
        if op in ("rate", "irate"):
            first = previous or ((t[0], x[0]) if n > 1 else None)
            if op == "irate":
                first = (t[-2], x[-2]) if n > 1 else previous
            if first is None or t[-1] <= first[0]:
                return None
            return (x[-1] - first[1]) / ((t[-1] - first[0]) / 1000)
        if op == "idelta":
            return x[-1] - x[-2] if n > 1 else x[-1] - previous[1] if previous else x[-1]
        if op in ("increase", "delta"):
            if previous or real is not None:
                return x[-1] - (previous[1] if previous else real)
            following = v[hi] if hi < len(v) and v[hi] == v[hi] else None
            change = x[1] - x[0] if n > 1 else following - x[0] if following is not None else 0.0
            base = 0.0 if abs(x[0]) < 10 * (abs(change) + 1) else x[0]
            return x[-1] - base if base == 0.0 or n > 1 else 0.0
        differ = lambda a, b: a != b and abs(b - a) >= 1e-12 * abs(b)
        total = 0
        if op == "changes":
            prior = previous[1] if previous else real
            if prior is None:
                total, prior, x = 1, x[0], x[1:]
            for y in x:
                if differ(prior, y):
                    total, prior = total + 1, y
            return float(total)
        prior = previous[1] if previous else x[0]
        for y in x if previous else x[1:]:
            total, prior = total + (y < prior and differ(prior, y)), y
        return float(total)
