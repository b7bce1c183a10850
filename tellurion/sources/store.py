"""Frames as partitioned Parquet: append, retention by the newest row, compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNITS = {"ts_ms": 1_000, "ts": 1_000_000, "start_ts": 1_000_000_000}


def append(df: DataFrame, path: str, time: str) -> None:
    """A folder for each day, so that time ranges prune folders. Rows of a day are sorted by time for the files' statistics."""
    day = F.date_from_unix_date(F.floor(F.col(time) / (86_400 * UNITS[time])).cast("int"))
    dated = df.withColumn("day", day)
    dated.repartition("day", F.pmod(F.xxhash64(time), F.lit(8))).sortWithinPartitions("day", time).write.mode("append").partitionBy("day").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def retain(df: DataFrame, time: str, keep: int) -> DataFrame:
    """Rows not older than the newest one less `keep` units of the time column. What is late doesn't move the limit."""
    newest = df.agg(F.max(time)).first()[0]
    return df if newest is None else df.where(F.col(time) >= newest - keep)


def compact(spark: SparkSession, path: str, into: str, time: str, files_per_day: int = 1) -> None:
    """The same rows in few files a day, written beside the old ones; the caller swaps the folders."""
    rows = spark.read.parquet(path)
    rows.repartition("day", F.pmod(F.xxhash64(time), F.lit(files_per_day))).sortWithinPartitions("day", time).write.partitionBy("day").parquet(into)
