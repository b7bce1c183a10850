"""IEEE arithmetic under ANSI Spark, which raises or gives null where floating point has an answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def d(x: Column | float) -> Column:
    return (x if isinstance(x, Column) else F.lit(float(x))).cast("double")


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != INF)


def divide(a: Column, b: Column) -> Column:
    signed = F.when(F.isnan(a) | (a == 0), NAN).otherwise(F.signum(a) * F.when(b.cast("string").startswith("-"), -INF).otherwise(INF))
    return F.when(b == 0, signed).otherwise(F.try_divide(a, b))


def modulo(a: Column, b: Column) -> Column:
    """Go's math.Mod: the sign of the dividend."""
    return F.when((b == 0) | F.isnan(a) | F.isnan(b) | (F.abs(a) == INF), NAN).when(F.abs(b) == INF, a).otherwise(F.try_mod(a, b))


def logarithm(x: Column, f) -> Column:
    return F.when(F.isnan(x) | (x < 0), NAN).when(x == 0, -INF).otherwise(f(x))


def whole(x: Column, f) -> Column:
    """ceil and floor; beyond 2**53 a double is whole."""
    return F.when(F.isnan(x) | (F.abs(x) >= 2.0**53), x).otherwise(f(x).cast("double"))


def compare(a: Column, op: str, b: Column) -> Column:
    """NaN differs from all, itself included, and is in no order."""
    some = F.isnan(a) | F.isnan(b)
    if op == "!=":
        return some | (a != b)
    found = {"==": a == b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]
    return ~some & found


def arithmetic(a: Column, op: str, b: Column) -> Column:
    if op == "/":
        return divide(a, b)
    if op == "%":
        return modulo(a, b)
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "^": lambda: F.pow(a, b), "atan2": lambda: F.atan2(a, b)}[op]()


def extreme(agg, v: Column) -> Column:
    """min and max of what isn't NaN; NaN if nothing else is there."""
    return F.coalesce(agg(F.when(~F.isnan(v), v)), F.when(F.count(v) > 0, F.lit(NAN)))


def as_go(v: Column) -> Column:
    """Shortest decimal text without exponent, as strconv writes it with 'f'."""
    text = v.cast("string")
    plain = F.regexp_replace(F.when(F.abs(v) < 1e15, v.cast("decimal(38,18)").cast("string")).otherwise(v.cast("decimal(38,0)").cast("string")), r"(\.\d*?)0+$", "$1")
    expanded = F.regexp_replace(F.when(text.contains("E"), plain).otherwise(text), r"\.0*$", "")
    return F.when(F.isnan(v), "NaN").when(v == INF, "+Inf").when(v == -INF, "-Inf").otherwise(expanded)


def compensated(values: Column) -> Column:
    """Neumaier's sum of an array of doubles, in its order."""

    def add(s: Column, x: Column) -> Column:
        total = s["sum"] + x
        lost = F.when(F.abs(s["sum"]) >= F.abs(x), (s["sum"] - total) + x).otherwise((x - total) + s["sum"])
        return F.struct(total.alias("sum"), F.when(finite(total), s["lost"] + lost).otherwise(0.0).alias("lost"))

    return F.aggregate(values, F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("lost")), add, lambda s: s["sum"] + s["lost"])
