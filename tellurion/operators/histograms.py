"""Classic histograms: series that differ in `le` are the cumulative buckets of one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellurion.functions import ieee, labels as L

NAME = "__name__"
TOLERANCE = 1e-12


def bound(le: Column) -> Column:
    return F.when(F.lower(le).isin("+inf", "inf"), ieee.INF).when(F.lower(le) == "-inf", -ieee.INF).when(F.lower(le) == "nan", None).otherwise(le.try_cast("double"))


def buckets(c, df: DataFrame) -> DataFrame:
    """labels (without le and name), t, b: ascending structs of le and count, equal bounds added up, never falling."""
    le = L.get(F.col("labels"), "le")
    named = df.select(L.drop(F.col("labels"), ["le"]).alias("labels"), "t", "v", bound(le).alias("le")).where("le is not null")
    keyed = named.withColumn("lkey", L.key(F.col("labels")))
    added = keyed.groupBy("lkey", "t", "le").agg(F.sum("v").alias("count"))
    rows = added.groupBy("lkey", "t").agg(F.array_sort(F.collect_list(F.struct("le", "count"))).alias("b"))
    zero = F.struct(F.lit(None).cast("double").alias("top"), F.array().cast("array<struct<le:double,count:double>>").alias("out"))

    def rise(s: Column, x: Column) -> Column:
        near = F.abs(x["count"] - s["top"]) <= TOLERANCE * (F.abs(x["count"]) + F.abs(s["top"]))
        count = F.when(s["top"].isNotNull() & ((x["count"] < s["top"]) | near), s["top"]).otherwise(x["count"])
        return F.struct(count.alias("top"), F.concat(s["out"], F.array(F.struct(x["le"].alias("le"), count.alias("count")))).alias("out"))

    return rows.select(L.drop(L.of(F.col("lkey")), [NAME]).alias("labels"), "t", F.aggregate("b", zero, rise)["out"].alias("b"))


def usable(b: Column) -> Column:
    last = F.element_at(b, -1)
    return (F.size(b) >= 2) & (last["le"] == ieee.INF) & (last["count"] > 0)


def quantile_value(b: Column, q: Column) -> Column:
    n = F.size(b)
    rank = q * F.element_at(b, -1)["count"]
    below = F.size(F.filter(F.slice(b, 1, n - 1), lambda x: x["count"] < rank))  # ascending, so these come first
    at, before = b[below], b[F.greatest(below - 1, F.lit(0))]
    low = F.when(below == 0, 0.0).otherwise(before["le"])
    under = F.when(below == 0, 0.0).otherwise(before["count"])
    inside = low + (at["le"] - low) * ieee.divide(rank - under, at["count"] - under)
    value = F.when(below == n - 1, before["le"]).when((below == 0) & (at["le"] <= 0), at["le"]).otherwise(inside)
    return F.when(F.isnan(q), ieee.NAN).when(q < 0, -ieee.INF).when(q > 1, ieee.INF).when(usable(b), value).otherwise(ieee.NAN)


def quantile(c, q, df: DataFrame) -> DataFrame:
    if q.constant is not None and not 0 <= q.constant <= 1:
        c.warn(f"quantile value should be between 0 and 1, got {q.constant}")
    rows = q.join(buckets(c, df))
    return rows.select("labels", "t", quantile_value(F.col("b"), ieee.d(q.expr)).cast("double").alias("v"))


def rank_below(b: Column, x: Column) -> Column:
    """Observations up to x, interpolated within its bucket."""
    n = F.size(b)
    below = F.size(F.filter(b, lambda k: k["le"] < x))
    at, before = b[F.least(below, n - 1)], b[F.greatest(below - 1, F.lit(0))]
    low = F.when(below == 0, F.when(at["le"] > 0, 0.0).otherwise(-ieee.INF)).otherwise(before["le"])
    under = F.when(below == 0, 0.0).otherwise(before["count"])
    inside = under + (at["count"] - under) * ieee.divide(x - low, at["le"] - low)
    return F.when(x <= low, under).when(at["le"] == ieee.INF, F.when(x == ieee.INF, at["count"]).otherwise(under)).when(low == -ieee.INF, F.when(x >= at["le"], at["count"]).otherwise(0.0)).otherwise(inside)


def fraction(c, low, high, df: DataFrame) -> DataFrame:
    rows = high.join(low.join(buckets(c, df)))
    a, z, b = ieee.d(low.expr), ieee.d(high.expr), F.col("b")
    share = ieee.divide(rank_below(b, z) - rank_below(b, a), F.element_at(b, -1)["count"])
    value = F.when(F.isnan(a) | F.isnan(z), ieee.NAN).when(~usable(b), ieee.NAN).when(a >= z, 0.0).otherwise(share)
    return rows.select("labels", "t", value.cast("double").alias("v"))
