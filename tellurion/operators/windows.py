"""Kernels over samples (lkey, ts, seq, v): reductions over (t - width, t] for every t of a grid.

panes: where the width is a multiple of the step, samples are first reduced to panes (t - step, t], on the map side, and the panes to windows. Takes folds, which say how
    parts are put together; a long window costs its panes, not its samples.
explode: a sample goes to each grid point whose window holds it, then one hash aggregation, which combines on the map side. For windows of few steps.
frame: one marker row for each grid point and series joins the samples; a range frame looks back. For windows of many steps.
All take the same reductions. The label map is read from the series' key in the result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellurion.errors import LimitError
from tellurion.functions import labels as L

MOST_POINTS = 1_000_000
EXPLODE_STEPS = 6
PANES = 64

Parts = Callable[[str], Column]


@dataclass(frozen=True)
class Fold:
    """A reduction of samples; those of its parts; and the same reduction of the parts' columns."""

    whole: Column
    parts: dict[str, Column]
    merged: Callable[[Parts], Column]


def total(x: Column) -> Fold:
    return Fold(F.sum(x), {"s": F.sum(x)}, lambda part: F.sum(part("s")))


def count(x: Column) -> Fold:
    return Fold(F.count(x), {"n": F.count(x)}, lambda part: F.sum(part("n")))


def mean(x: Column) -> Fold:
    return Fold(F.avg(x), {"s": F.sum(x), "n": F.count(x)}, lambda part: F.try_divide(F.sum(part("s")), F.sum(part("n"))))


def least(x: Column) -> Fold:
    return Fold(F.min(x), {"x": F.min(x)}, lambda part: F.min(part("x")))


def most(x: Column) -> Fold:
    return Fold(F.max(x), {"x": F.max(x)}, lambda part: F.max(part("x")))


def first(x: Column, order: Column) -> Fold:
    return Fold(F.min_by(x, order), {"x": F.min_by(x, order), "o": F.min(order)}, lambda part: F.min_by(part("x"), part("o")))


def last(x: Column, order: Column) -> Fold:
    return Fold(F.max_by(x, order), {"x": F.max_by(x, order), "o": F.max(order)}, lambda part: F.max_by(part("x"), part("o")))


@dataclass(frozen=True)
class Grid:
    """Evaluation times in ms: start, start + step, ... up to end."""

    start: int
    end: int
    step: int

    def __post_init__(self) -> None:
        if self.step <= 0:
            raise LimitError("the step must be greater than 0")
        if self.end < self.start:
            raise LimitError("the end lies before the start")
        if self.count > MOST_POINTS:
            raise LimitError(f"the grid has more than {MOST_POINTS} points")

    @property
    def count(self) -> int:
        return (self.end - self.start) // self.step + 1

    @property
    def last(self) -> int:
        return self.start + (self.count - 1) * self.step

    def frame(self, spark) -> DataFrame:
        return spark.range(self.count).select((F.lit(self.start) + F.col("id") * self.step).alias("t"))

    def times(self) -> Column:
        return F.explode(F.sequence(F.lit(self.start), F.lit(self.last), F.lit(self.step))) if self.count > 1 else F.lit(self.start)


def between(samples: DataFrame, grid: Grid, width: int, offset: int = 0) -> DataFrame:
    """The samples that any window of the grid holds: a range of ts, which reaches the scan."""
    return samples.where((F.col("ts") > grid.start - offset - width) & (F.col("ts") <= grid.last - offset))


def with_previous(samples: DataFrame) -> DataFrame:
    """prev_ts, prev_v: the sample before, in its series."""
    own = Window.partitionBy("lkey").orderBy("ts", "seq")
    return samples.withColumn("prev_ts", F.lag("ts").over(own)).withColumn("prev_v", F.lag("v").over(own))


def spread(rows: DataFrame, grid: Grid, low: Column, high: Column) -> DataFrame:
    """t: the grid's points from number low to number high."""
    low, high = F.greatest(F.lit(0), low).cast("long"), F.least(F.lit(grid.count - 1), high).cast("long")
    placed = rows.withColumn("__low", low).withColumn("__high", high).where("__low <= __high").withColumn("__i", F.explode(F.sequence("__low", "__high")))
    return placed.withColumn("t", F.lit(grid.start) + F.col("__i") * grid.step)


def explode(samples: DataFrame, grid: Grid, width: int, offset: int, aggregates: list[Column]) -> DataFrame:
    """lkey, t and the aggregates, which may use ts, seq, v and t."""
    at = F.col("ts") + (offset - grid.start)
    low, high = F.ceil(at / grid.step), F.floor((at + width - 1) / grid.step)
    if width <= grid.step:
        placed = samples.withColumn("__i", F.greatest(F.lit(0), low).cast("long")).where((F.col("__i") <= high) & (F.col("__i") < grid.count)).withColumn("t", F.lit(grid.start) + F.col("__i") * grid.step)
    else:
        placed = spread(samples, grid, low, high)
    return placed.groupBy("lkey", "t").agg(*aggregates)


def panes(samples: DataFrame, grid: Grid, width: int, offset: int, folds: dict[str, Fold]) -> DataFrame:
    number = F.ceil((F.col("ts") + (offset - grid.start)) / grid.step).cast("long")
    parts = [x.alias(f"__{name}_{part}") for name, fold in folds.items() for part, x in fold.parts.items()]
    reduced = samples.groupBy("lkey", number.alias("__pane")).agg(*parts)
    placed = spread(reduced, grid, F.col("__pane"), F.col("__pane") + (width // grid.step - 1))
    part = lambda name: lambda p: F.col(f"__{name}_{p}")
    return placed.groupBy("lkey", "t").agg(*[fold.merged(part(name)).alias(name) for name, fold in folds.items()])


def frame(samples: DataFrame, grid: Grid, width: int, offset: int, aggregates: list[tuple[str, Column]]) -> DataFrame:
    columns = [c for c in samples.columns if c not in ("lkey", "labels")]
    markers = samples.select("lkey").distinct().select("lkey", grid.times().alias("t"))
    left = samples.select("lkey", (F.col("ts") + offset).alias("__order"), F.lit(None).cast("long").alias("t"), *columns)
    right = markers.select("lkey", F.col("t").alias("__order"), "t", *[F.lit(None).cast(samples.schema[c].dataType).alias(c) for c in columns])
    look = Window.partitionBy("lkey").orderBy("__order").rangeBetween(-(width - 1), 0)
    found = left.union(right).select("lkey", "t", *[x.over(look).alias(name) for name, x in aggregates], F.count("v").over(look).alias("__n"))
    return found.where("t is not null and __n > 0").drop("__n")


def reduce(samples: DataFrame, grid: Grid, width: int, offset: int, aggregates: dict[str, Column | Fold], at: int | None = None) -> DataFrame:
    """lkey, labels, t and the aggregates. at: a fixed evaluation time; the result is the same at each grid point."""
    whole = {name: x.whole if isinstance(x, Fold) else x for name, x in aggregates.items()}
    if at is not None:
        point = Grid(at, at, 1)
        found = explode(between(samples, point, width, offset), point, width, offset, [x.alias(n) for n, x in whole.items()])
        return found.drop("t").select("lkey", L.of(F.col("lkey")).alias("labels"), *aggregates, grid.times().alias("t"))
    samples = between(samples, grid, width, offset)
    steps = -(-width // grid.step)
    if all(isinstance(x, Fold) for x in aggregates.values()) and width % grid.step == 0 and 1 < steps <= PANES and grid.count > 1:
        found = panes(samples, grid, width, offset, aggregates)
    elif grid.count == 1 or steps <= EXPLODE_STEPS:
        found = explode(samples, grid, width, offset, [x.alias(n) for n, x in whole.items()])
    else:
        found = frame(samples, grid, width, offset, list(whole.items()))
    return found.select("lkey", L.of(F.col("lkey")).alias("labels"), "t", *aggregates)
