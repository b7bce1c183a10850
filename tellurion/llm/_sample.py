"""Bounded samples of labelled rows, drawn by hash: the same ones however the table is split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellurion.llm import _spark

BUCKETS = 1 << 30
#: Values whose counts are sent to all executors; with more, they are joined by a shuffle.
MOST_VALUES = 20_000


def sample(rows: DataFrame, by: str, key: Column, size: int) -> tuple[DataFrame, int]:
    """Of each value of column `by` the `size` rows with the smallest hash of `key`; and how many values there are.

    A first pass counts; a cut-off by the counts then leaves about twice `size` rows of each value before any are ranked.
    """
    counts = _spark.cut(rows.groupBy(by).agg(F.count("*").alias("__n")))
    drawn = F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(BUCKETS))
    few = _spark.join_small(rows, counts, [by], MOST_VALUES).withColumn("__drawn", drawn).where(F.col("__drawn") * F.col("__n") < F.lit(float(BUCKETS) * (2 * size + 50)))
    first = Window.partitionBy(by).orderBy("__drawn", key)
    return few.withColumn("__nth", F.row_number().over(first)).where(F.col("__nth") <= size).drop("__drawn", "__nth", "__n"), counts.count()


def within(rows: DataFrame, by: str, order: list[Column], size: int, n_bytes: int, length: Column | None = None) -> DataFrame:
    """Of each value of `by` the first rows, whole, until there are `size` of them or they reach n_bytes. The first row stays, however long it is.

    length: of a row's text, if it isn't among the columns. One task holds all rows of a value in memory.
    """
    first = Window.partitionBy(by).orderBy(*order)
    before = F.sum((F.octet_length("text") if length is None else length).cast("long")).over(first.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumns({"__nth": F.row_number().over(first), "__before": F.coalesce(before, F.lit(0))}).where((F.col("__nth") <= size) & (F.col("__before") < n_bytes)).drop("__nth", "__before")


def remainder(key: Column, divisor: int) -> Column:
    """crc32 of the key as text, modulo; null for a null key."""
    return F.crc32(key.cast("string")) % divisor
