"""Metrics: PromQL and MetricsQL over a DataFrame of samples.

Samples: metric STRING, labels MAP<STRING,STRING> (without the name), ts_ms BIGINT, value DOUBLE; optionally seq, which orders samples
of one time, and lkey, the canonical text of the full label set (functions.labels.key), to save computing it for each query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellurion.functions import labels as L
from tellurion.operators import promql


class Metrics:
    def __init__(self, samples: DataFrame, lookback: int = promql.LOOKBACK, most_points: int = promql.MOST_POINTS, compensated: bool = False):
        self.samples, self.lookback, self.most_points, self.compensated = samples, lookback, most_points, compensated
        self.annotations: list[str] = []

    def query(self, text: str, time: int, metricsql: bool = False):
        """At one time in ms. Labels, t and v; for a string literal the string."""
        self.annotations = []
        return promql.run_instant(self.samples, text, time, self.lookback, metricsql, self.compensated, self.annotations)

    def query_range(self, text: str, start: int, end: int, step: int, metricsql: bool = False) -> DataFrame:
        self.annotations = []
        return promql.run(self.samples, text, start, end, step, self.lookback, metricsql, self.most_points, self.compensated, self.annotations)

    def metricsql(self, text: str, time: int):
        return self.query(text, time, True)

    def metricsql_range(self, text: str, start: int, end: int, step: int) -> DataFrame:
        return self.query_range(text, start, end, step, True)

    def series(self, *selectors: str, start: int | None = None, end: int | None = None) -> DataFrame:
        """Distinct label sets, the name included."""
        rows = self._selected(selectors, start, end)
        full = F.map_concat(F.create_map(F.lit("__name__"), F.col("metric")), F.col("labels"))
        return rows.select(full.alias("labels")).groupBy(L.key(F.col("labels")).alias("lkey")).agg(F.any_value("labels").alias("labels"))

    def labels(self, *selectors: str, start: int | None = None, end: int | None = None) -> DataFrame:
        names = self._selected(selectors, start, end).select(F.explode(F.concat(F.array(F.lit("__name__")), F.map_keys("labels"))).alias("label"))
        return names.distinct().orderBy("label")

    def label_values(self, name: str, *selectors: str, start: int | None = None, end: int | None = None) -> DataFrame:
        value = F.col("metric") if name == "__name__" else L.get(F.col("labels"), name)
        return self._selected(selectors, start, end).select(value.alias("value")).where("value <> ''").distinct().orderBy("value")

    def _selected(self, selectors: tuple[str, ...], start: int | None, end: int | None) -> DataFrame:
        from tellurion.plans.promql import parse

        rows = self.samples
        if start is not None:
            rows = rows.where(F.col("ts_ms") >= start)
        if end is not None:
            rows = rows.where(F.col("ts_ms") <= end)
        some = F.lit(not selectors)
        for text in selectors:
            own = F.lit(True)
            for m in parse(text).matchers:
                own = own & L.matches(F.col("metric") if m.label == "__name__" else L.get(F.col("labels"), m.label), m.op, m.value)
            some = some | own
        return rows.where(some)
