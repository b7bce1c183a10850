"""Structured Streaming: live tails and rollups of what has settled."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellurion.errors import QueryError
from tellurion.functions import ieee, labels as L
from tellurion.logs import Logs
from tellurion.operators import traces
from tellurion.plans.promql import duration_ms


def tail_logs(entries: DataFrame, query: str = "*", now: int = 0) -> DataFrame:
    """Entries of a stream that a LogsQL filter selects; pipes are rejected."""
    return Logs(entries).filter(query, now)


def tail_spans(spans: DataFrame, service: str | None = None, name: str | None = None, kind: str | None = None, status: str | None = None, attributes: dict | None = None) -> DataFrame:
    rows = traces.matching(spans, service, name, attributes=attributes)
    for column, value in (("kind", kind), ("status", status)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def settled_rollup(samples: DataFrame, resolution_ms: int, late_ms: int = 0) -> DataFrame:
    """Buckets of a stream of samples, each once and for all when the watermark has passed it."""
    at = F.timestamp_millis("ts_ms")
    rows = samples.select("metric", L.key(F.col("labels")).alias("lkey"), "ts_ms", "value", at.alias("at")).withWatermark("at", f"{late_ms} milliseconds")
    grouped = rows.groupBy("metric", "lkey", F.window("at", f"{resolution_ms} milliseconds"))
    out = grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"), F.max_by(F.struct("ts_ms", "value"), "ts_ms").alias("end"))
    return out.select("metric", "lkey", F.unix_millis("window.start").alias("bucket_ms"), "n", "total", "low", "high", F.col("end.ts_ms").alias("last_ts"), F.col("end.value").alias("last_value"))


def ladder(spec: str) -> list[tuple[int, int]]:
    """`5m@90d,1h@0`: resolutions and how long each is kept (0: for ever), ascending, each a multiple of the one before."""
    out: list[tuple[int, int]] = []
    for part in spec.split(","):
        m = re.fullmatch(r"\s*(\d+[smhdw])@(0|\d+[smhdw])\s*", part)
        if not m:
            raise QueryError(f"bad rollup tier {part!r}")
        tier = duration_ms(m[1]), 0 if m[2] == "0" else duration_ms(m[2])
        if out and (tier[0] <= out[-1][0] or tier[0] % out[-1][0]):
            raise QueryError("rollup tiers must ascend, each a multiple of the one before")
        out.append(tier)
    return out


def write_ladder(tier: DataFrame, spec: str, folder: str):
    """A stream query that writes each settled bucket of the first tier and folds it into the coarser ones, batch by batch."""
    steps = ladder(spec)

    def batch(df: DataFrame, _: int) -> None:
        kept = df.persist()
        kept.write.mode("append").parquet(f"{folder}/{steps[0][0]}")
        for resolution, _keep in steps[1:]:
            at = (F.floor(F.col("bucket_ms") / resolution) * resolution).cast("long")
            kept.groupBy("metric", "lkey", at.alias("bucket_ms")).agg(
                F.sum("n").alias("n"), F.sum("total").alias("total"), ieee.extreme(F.min, F.col("low")).alias("low"), ieee.extreme(F.max, F.col("high")).alias("high"), F.max_by(F.struct("last_ts", "last_value"), "last_ts").alias("end")
            ).select("metric", "lkey", "bucket_ms", "n", "total", "low", "high", F.col("end.last_ts").alias("last_ts"), F.col("end.last_value").alias("last_value")).write.mode("append").parquet(f"{folder}/{resolution}")  # parts of a bucket: readers merge them by tables.coarser()
        kept.unpersist()

    return tier.writeStream.outputMode("append").foreachBatch(batch)
