"""The registered queries of the engine, each with the SQL that gives the same rows.

The supplied tables stand for the three signals: `events` are a gauge and a counter of each type and shard and a log, `lineitem` are spans, `documents` a log of
prose. Values in results are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurion.logs import Logs
from tellurion.metrics import Metrics
from tellurion.operators import tables, traces

DAY, HOUR, SIX = 86_400_000, 3_600_000, 21_600_000
START, STOP = 1_704_067_200_000, 1_704_067_200_000 + 29 * DAY
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events_value, a gauge, by event_type and shard."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    labels = F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("shard"), (F.col("user_id") % 10).cast("string"))
    key = F.concat(F.lit('{"__name__":"events_value","event_type":"'), "event_type", F.lit('","shard":"'), (F.col("user_id") % 10).cast("string"), F.lit('"}'))
    return e.select(F.lit("events_value").alias("metric"), labels.alias("labels"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("value"), F.col("event_id").alias("seq"), key.alias("lkey"))


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events_total: a counter that starts anew after each 50 events of a series."""
    from pyspark.sql import Window

    rows = samples(spark, sf_dir)
    nth = F.row_number().over(Window.partitionBy("lkey").orderBy("ts_ms", "seq"))
    return rows.select(F.lit("events_total").alias("metric"), "labels", "ts_ms", (nth % 50).cast("double").alias("value"), "seq", F.replace("lkey", F.lit("events_value"), F.lit("events_total")).alias("lkey"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "notice").when(F.col("event_type") == "purchase", "warning").when(F.col("event_type") == "click", "info").otherwise("debug")
    message = F.concat_ws(" ", "event_type", F.lit("user"), F.col("user_id").cast("string"))
    metadata = F.concat(F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit(',"user_id":'), F.col("user_id").cast("string"), F.lit(',"event_type":"'), "event_type", F.lit('"}'))
    return e.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("seq"), level.alias("level"), message.alias("message"), metadata.alias("metadata"))


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select((F.col("doc_id") * 1_000_000).alias("ts"), F.col("doc_id").alias("seq"), F.lit("info").alias("level"), F.col("text").alias("message"), F.to_json(F.struct("lang", "source")).alias("metadata"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return line.select(
        F.col("l_orderkey").alias("trace_id"), F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string")).alias("span_id"), F.when(F.col("l_linenumber") > 1, F.col("l_orderkey").cast("string")).alias("parent_span_id"),
        F.col("l_returnflag").alias("service"), F.concat(F.lit("part-"), (F.col("l_partkey") % 20).cast("string")).alias("name"), F.when(F.col("l_linenumber") == 1, "server").otherwise("internal").alias("kind"), F.when(F.col("l_linestatus") == "O", "error").otherwise("ok").alias("status"),
        (F.unix_micros(F.col("l_shipdate").cast("timestamp")) * 1000).alias("start_ts"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("duration_ns"),
    )


SAMPLES = "SELECT event_type, (user_id % 10)::VARCHAR AS shard, epoch_us(ts) // 1000 AS ts, value AS v, event_id AS seq FROM events"
GRID = f"SELECT unnest(generate_series({START}::BIGINT, {STOP}::BIGINT, {SIX}::BIGINT)) AS t"
COUNTERS = f"SELECT event_type, shard, ts, seq, (row_number() OVER (PARTITION BY event_type, shard ORDER BY ts, seq) % 50)::DOUBLE AS v FROM ({SAMPLES})"
ENTRIES = """SELECT epoch_us(ts) AS ts, event_id AS seq, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'notice' WHEN 'purchase' THEN 'warning' WHEN 'click' THEN 'info' ELSE 'debug' END AS level,
event_type || ' user ' || user_id AS message, json_extract(props, '$.k')::BIGINT AS k, user_id, event_type FROM events"""
SPANS = """SELECT l_orderkey AS trace_id, l_partkey || '-' || l_suppkey || '-' || l_linenumber AS span_id, CASE WHEN l_linenumber > 1 THEN l_orderkey::VARCHAR END AS parent_span_id, l_returnflag AS service, 'part-' || (l_partkey % 20) AS name,
CASE WHEN l_linenumber = 1 THEN 'server' ELSE 'internal' END AS kind, CASE WHEN l_linestatus = 'O' THEN 'error' ELSE 'ok' END AS status, epoch_us(l_shipdate) * 1000 AS start_ts, round(l_extendedprice * 100)::BIGINT AS duration_ns FROM lineitem"""


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def shown(df: DataFrame, *labels: str, digits: int = 6) -> DataFrame:
    """Labels as columns, t and the rounded value."""
    return df.select(*[F.coalesce(F.try_element_at("labels", F.lit(n)), F.lit("")).alias(n) for n in labels], "t", F.round("v", digits).alias("v"))


def prom(name: str, text: str, labels: tuple[str, ...], sql: str, source=samples, step: int = SIX, lookback: int = 12 * HOUR, metricsql: bool = False, start: int = START, stop: int = STOP) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shown(Metrics(source(spark, sf_dir), lookback).query_range(text, start, stop, step, metricsql), *labels)

    run.__name__ = name
    run.__doc__ = text
    query(sql)(run)


def windowed(agg: str, width: int, where: str = "true", keys: str = "event_type, shard", source: str = SAMPLES) -> str:
    return f"SELECT {keys}, t, {agg} AS v FROM ({source}) s JOIN ({GRID}) g ON s.ts > t - {width} AND s.ts <= t WHERE {where} GROUP BY {keys}, t"


LAST = windowed("arg_max(v, ts)", 12 * HOUR)
prom("promql_instant_selector", 'events_value{event_type="click"}', ("event_type", "shard"), f"SELECT event_type, shard, t, round(v, 6) AS v FROM ({LAST}) WHERE event_type = 'click'")
prom("promql_matchers", '{__name__=~"events_.*",event_type!="view",shard=~"[0-4]",shard!~"2|3"}', ("event_type", "shard"), f"SELECT event_type, shard, t, round(v, 6) AS v FROM ({LAST}) WHERE event_type <> 'view' AND shard IN ('0', '1', '4')")
prom("promql_offset", "events_value offset 6h", ("event_type", "shard"), f"SELECT event_type, shard, t, round(arg_max(v, ts), 6) AS v FROM ({SAMPLES}) s JOIN ({GRID}) g ON s.ts > t - {18 * HOUR} AND s.ts <= t - {SIX} GROUP BY ALL")
prom("promql_at_modifier", f"events_value @ {START // 1000 + 86400 * 10}", ("event_type", "shard"), f"SELECT event_type, shard, t, round(x, 6) AS v FROM (SELECT event_type, shard, arg_max(v, ts) AS x FROM ({SAMPLES}) WHERE ts > {START + 10 * DAY - 12 * HOUR} AND ts <= {START + 10 * DAY} GROUP BY ALL), ({GRID})")
for _f, _agg in {
    "avg": "avg(v)", "min": "min(v)", "max": "max(v)", "sum": "sum(v)", "count": "count(v)::DOUBLE", "last": "arg_max(v, ts)", "present": "1.0::DOUBLE", "stddev": "stddev_pop(v)", "stdvar": "var_pop(v)",
}.items():
    prom(f"promql_{_f}_over_time", f"{_f}_over_time(events_value[1d])", ("event_type", "shard"), f"SELECT event_type, shard, t, round(v, 6) AS v FROM ({windowed(_agg, DAY)})")
prom("promql_quantile_over_time", "quantile_over_time(0.9, events_value[1d])", ("event_type", "shard"), f"SELECT event_type, shard, t, round(v, 6) AS v FROM ({windowed('quantile_cont(v, 0.9)', DAY)})")
prom("promql_avg_long_window", "avg_over_time(events_value[7d])", ("event_type", "shard"), f"SELECT event_type, shard, t, round(v, 6) AS v FROM ({windowed('avg(v)', 7 * DAY)})")
_PAIRS = f"SELECT *, lag(v) OVER w AS pv, lag(ts) OVER w AS pt FROM ({COUNTERS}) WINDOW w AS (PARTITION BY event_type, shard ORDER BY ts, seq)"
_EDGE = f"SELECT event_type, shard, t, count(*) AS n, arg_min(v, ts) AS f, arg_max(v, ts) AS l, min(ts) AS ft, max(ts) AS lt, coalesce(sum(CASE WHEN pv > v THEN pv ELSE 0 END), 0) - arg_min(CASE WHEN pv > v THEN pv ELSE 0 END, ts) AS drops FROM ({_PAIRS}) s JOIN ({GRID}) g ON s.ts > t - {DAY} AND s.ts <= t GROUP BY ALL HAVING count(*) >= 2 AND max(ts) > min(ts)"
_PARTS = f"SELECT *, l - f + drops AS c, (lt - ft) / 1000.0 AS sp, (ft - (t - {DAY})) / 1000.0 AS a, (t - lt) / 1000.0 AS b, (lt - ft) / 1000.0 / (n - 1) AS av FROM ({_EDGE})"
_CLAMP = f"SELECT *, CASE WHEN a >= av * 1.1 THEN av / 2 ELSE a END AS a1, CASE WHEN b >= av * 1.1 THEN av / 2 ELSE b END AS b1 FROM ({_PARTS})"
_INCREASE = f"SELECT event_type, shard, t, c * (sp + CASE WHEN c > 0 AND f >= 0 AND sp * (f / c) < a1 THEN sp * (f / c) ELSE a1 END + b1) / sp AS v FROM ({_CLAMP})"
prom("promql_rate", "rate(events_total[1d])", ("event_type", "shard"), f"SELECT event_type, shard, t, round(v / 86400, 6) AS v FROM ({_INCREASE})", counters)
prom("promql_increase", "increase(events_total[1d])", ("event_type", "shard"), f"SELECT event_type, shard, t, round(v, 6) AS v FROM ({_INCREASE})", counters)
prom("promql_delta", "delta(events_value[1d])", ("event_type", "shard"), f"SELECT event_type, shard, t, round((l - f) * (sp + a1 + b1) / sp, 6) AS v FROM ({_CLAMP.replace(COUNTERS, SAMPLES)})")
_INNER = f"SELECT * FROM ({_PAIRS}) s JOIN ({GRID}) g ON s.ts > t - {DAY} AND s.ts <= t"
prom("promql_changes", "changes(events_total[1d])", ("event_type", "shard"), f"SELECT event_type, shard, t, (sum(CASE WHEN pv <> v THEN 1 ELSE 0 END) - arg_min(CASE WHEN pv <> v THEN 1 ELSE 0 END, ts))::DOUBLE AS v FROM ({_INNER}) GROUP BY ALL", counters)
prom("promql_resets", "resets(events_total[1d])", ("event_type", "shard"), f"SELECT event_type, shard, t, (sum(CASE WHEN pv > v THEN 1 ELSE 0 END) - arg_min(CASE WHEN pv > v THEN 1 ELSE 0 END, ts))::DOUBLE AS v FROM ({_INNER}) GROUP BY ALL", counters)
_TWO = f"SELECT event_type, shard, t, count(*) AS n, arg_max(v, ts) AS l, arg_max(pv, ts) AS p, max(ts) AS lt, arg_max(pt, ts) AS pt FROM ({_INNER}) GROUP BY ALL HAVING count(*) >= 2"
prom("promql_irate", "irate(events_total[1d])", ("event_type", "shard"), f"SELECT event_type, shard, t, round(CASE WHEN l < p THEN l ELSE l - p END * 1000 / (lt - pt), 6) AS v FROM ({_TWO}) WHERE lt > pt", counters)
prom("promql_idelta", "idelta(events_value[1d])", ("event_type", "shard"), f"SELECT event_type, shard, t, round(l - p, 6) AS v FROM ({_TWO.replace(COUNTERS, SAMPLES)}) WHERE lt > pt")
prom("promql_deriv", "deriv(events_value[1d])", ("event_type", "shard"), f"SELECT event_type, shard, t, round(regr_slope(v, (ts - {START}) / 1000.0), 6) AS v FROM ({SAMPLES}) s JOIN ({GRID}) g ON s.ts > t - {DAY} AND s.ts <= t GROUP BY ALL HAVING count(*) >= 2")
prom("promql_predict_linear", "predict_linear(events_value[1d], 3600)", ("event_type", "shard"), f"SELECT event_type, shard, t, round(m + b * ((t - {START}) / 1000.0 - x + 3600), 4) AS v FROM (SELECT event_type, shard, t, avg(v) AS m, regr_slope(v, (ts - {START}) / 1000.0) AS b, avg((ts - {START}) / 1000.0) AS x FROM ({SAMPLES}) s JOIN ({GRID}) g ON s.ts > t - {DAY} AND s.ts <= t GROUP BY ALL HAVING count(*) >= 2)")
QUERIES["promql_predict_linear"] = lambda spark, d: shown(Metrics(samples(spark, d), 12 * HOUR).query_range("predict_linear(events_value[1d], 3600)", START, STOP, SIX), "event_type", "shard", digits=4)
prom("promql_subquery", "max_over_time(sum by (shard) (events_value)[1d:6h])", ("shard",), f"""WITH g2 AS (SELECT unnest(generate_series({START - DAY + SIX}::BIGINT, {STOP}::BIGINT, {SIX}::BIGINT)) AS u),
inner_ AS (SELECT shard, u, sum(x) AS v FROM (SELECT event_type, shard, u, arg_max(v, ts) AS x FROM ({SAMPLES}) s JOIN g2 ON s.ts > u - {12 * HOUR} AND s.ts <= u GROUP BY ALL) GROUP BY ALL)
SELECT shard, t, round(max(v), 6) AS v FROM inner_ JOIN ({GRID}) g ON u > t - {DAY} AND u <= t GROUP BY ALL""")  # fmt: skip
for _f, _agg in {"sum": "sum(v)", "avg": "avg(v)", "min": "min(v)", "max": "max(v)", "count": "count(*)::DOUBLE", "group": "1.0::DOUBLE", "stddev": "stddev_pop(v)", "stdvar": "var_pop(v)"}.items():
    prom(f"promql_agg_{_f}", f"{_f} by (shard) (events_value)", ("shard",), f"SELECT shard, t, round({_agg}, 6) AS v FROM ({LAST}) GROUP BY ALL")
prom("promql_agg_without", "sum without (shard) (events_value)", ("event_type",), f"SELECT event_type, t, round(sum(v), 6) AS v FROM ({LAST}) GROUP BY ALL")
prom("promql_agg_quantile", "quantile by (event_type) (0.75, events_value)", ("event_type",), f"SELECT event_type, t, round(quantile_cont(v, 0.75), 6) AS v FROM ({LAST}) GROUP BY ALL")
prom("promql_topk", "topk by (event_type) (2, events_value)", ("event_type", "shard"), f"SELECT event_type, shard, t, round(v, 6) AS v FROM ({LAST}) QUALIFY row_number() OVER (PARTITION BY t, event_type ORDER BY v DESC, shard) <= 2")
prom("promql_bottomk", "bottomk(3, events_value)", ("event_type", "shard"), f"SELECT event_type, shard, t, round(v, 6) AS v FROM ({LAST}) QUALIFY row_number() OVER (PARTITION BY t ORDER BY v, event_type, shard) <= 3")
prom("promql_count_values", 'count_values by (event_type) ("n", floor(events_value / 100))', ("event_type", "n"), f"SELECT event_type, floor(v / 100)::BIGINT::VARCHAR AS n, t, count(*)::DOUBLE AS v FROM ({LAST}) GROUP BY ALL")
prom("promql_arithmetic", "-(events_value * 2 + 1) / 4 - events_value % 7 ^ 1", ("event_type", "shard"), f"SELECT event_type, shard, t, round(-(v * 2 + 1) / 4 - fmod(v, 7), 6) AS v FROM ({LAST})")
prom("promql_comparison", "events_value > 50", ("event_type", "shard"), f"SELECT event_type, shard, t, round(v, 6) AS v FROM ({LAST}) WHERE v > 50")
prom("promql_comparison_bool", "events_value >= bool 50", ("event_type", "shard"), f"SELECT event_type, shard, t, (v >= 50)::INT::DOUBLE AS v FROM ({LAST})")
_CLICK, _VIEW = f"SELECT * FROM ({LAST}) WHERE event_type = 'click'", f"SELECT * FROM ({LAST}) WHERE event_type = 'view'"
prom("promql_one_to_one", 'events_value{event_type="click"} / ignoring(event_type) events_value{event_type="view"}', ("shard",), f"SELECT a.shard, a.t, round(a.v / b.v, 6) AS v FROM ({_CLICK}) a JOIN ({_VIEW}) b USING (shard, t)")
prom("promql_group_left", 'events_value / on(shard) group_left sum by (shard) (events_value)', ("event_type", "shard"), f"SELECT a.event_type, a.shard, a.t, round(a.v / b.v, 6) AS v FROM ({LAST}) a JOIN (SELECT shard, t, sum(v) AS v FROM ({LAST}) GROUP BY ALL) b USING (shard, t)")
prom("promql_and", 'events_value{event_type="click"} and on(shard) events_value{event_type="view"} > 60', ("event_type", "shard"), f"SELECT event_type, shard, t, round(v, 6) AS v FROM ({_CLICK}) a WHERE EXISTS (SELECT 1 FROM ({_VIEW}) b WHERE a.shard = b.shard AND a.t = b.t AND b.v > 60)")
prom("promql_unless", 'events_value{event_type="click"} unless on(shard) events_value{event_type="view"} > 60', ("event_type", "shard"), f"SELECT event_type, shard, t, round(v, 6) AS v FROM ({_CLICK}) a WHERE NOT EXISTS (SELECT 1 FROM ({_VIEW}) b WHERE a.shard = b.shard AND a.t = b.t AND b.v > 60)")
prom("promql_or", 'events_value{event_type="click"} > 80 or on(shard) events_value{event_type="view"}', ("event_type", "shard"), f"WITH a AS (SELECT * FROM ({_CLICK}) WHERE v > 80) SELECT event_type, shard, t, round(v, 6) AS v FROM (SELECT * FROM a UNION ALL SELECT * FROM ({_VIEW}) b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.shard = b.shard AND a.t = b.t))")
for _f, _sql in {
    "abs": "abs(v - 50)", "ceil": "ceil(v - 50)", "floor": "floor(v - 50)", "sqrt": "sqrt(v)", "exp": "exp((v - 50) / 100)", "ln": "ln(v)", "log2": "log2(v)", "log10": "log10(v)", "sgn": "sign(v - 50)::DOUBLE",
    "sin": "sin(v)", "cos": "cos(v)", "tan": "tan(v)", "atan": "atan(v)", "sinh": "(exp(v/50) - exp(-v/50)) / 2", "cosh": "(exp(v/50) + exp(-v/50)) / 2", "tanh": "(exp(v/50) - exp(-v/50)) / (exp(v/50) + exp(-v/50))", "asinh": "ln(v + sqrt(v * v + 1))", "acosh": "ln(v + 1 + sqrt((v + 1) * (v + 1) - 1))",
    "asin": "asin((v - 50) / 1000)", "acos": "acos((v - 50) / 1000)", "atanh": "0.5 * ln((1 + (v - 50) / 1000) / (1 - (v - 50) / 1000))", "deg": "degrees(v)", "rad": "radians(v)",
}.items():
    _arg = {**dict.fromkeys(("abs", "ceil", "floor", "sgn"), "events_value - 50"), "exp": "(events_value - 50) / 100", **dict.fromkeys(("sinh", "cosh", "tanh"), "events_value / 50"), "acosh": "events_value + 1", **dict.fromkeys(("asin", "acos", "atanh"), "(events_value - 50) / 1000")}.get(_f, "events_value")
    _less = 'event_type="click"'
    prom(f"promql_fn_{_f}", f"{_f}({_arg.replace('events_value', 'events_value{' + _less + '}')})", ("shard",), f"SELECT shard, t, round({_sql}, 6) AS v FROM ({_CLICK})")
prom("promql_round", "round(events_value, 5)", ("event_type", "shard"), f"SELECT event_type, shard, t, round(floor(v * 0.2 + 0.5) / 0.2, 6) AS v FROM ({LAST})")
prom("promql_clamp", "clamp(events_value, 20, 60)", ("event_type", "shard"), f"SELECT event_type, shard, t, round(least(greatest(v, 20), 60), 6) AS v FROM ({LAST})")
prom("promql_label_replace", 'label_replace(events_value, "kind", "$1-$2", "event_type", "(.)(.*)")', ("event_type", "kind", "shard"), f"SELECT event_type, event_type[1] || '-' || event_type[2:] AS kind, shard, t, round(v, 6) AS v FROM ({LAST})")
prom("promql_label_join", 'label_join(events_value, "both", "/", "event_type", "shard")', ("both",), f"SELECT event_type || '/' || shard AS both, t, round(v, 6) AS v FROM ({LAST})")
prom("promql_absent", 'absent(events_value{event_type="click",shard="3"} > 50)', (), f"SELECT t, 1.0::DOUBLE AS v FROM ({GRID}) WHERE t NOT IN (SELECT t FROM ({_CLICK}) WHERE shard = '3' AND v > 50)")
prom("promql_absent_over_time", 'absent_over_time(events_value{event_type="signup",shard="3"}[6h])', ("event_type", "shard"), f"SELECT 'signup' AS event_type, '3' AS shard, t, 1.0::DOUBLE AS v FROM ({GRID}) g WHERE NOT EXISTS (SELECT 1 FROM ({SAMPLES}) s WHERE event_type = 'signup' AND shard = '3' AND s.ts > t - {SIX} AND s.ts <= t)")
prom("promql_scalar_vector_time", 'vector(scalar(sum(events_value)) + time() - time() + pi() * 0)', (), f"SELECT t, round(sum(v), 4) AS v FROM ({LAST}) GROUP BY t")
QUERIES["promql_scalar_vector_time"] = lambda spark, d: shown(Metrics(samples(spark, d), 12 * HOUR).query_range("vector(scalar(sum(events_value)) + time() - time() + pi() * 0)", START, STOP, SIX).where(~F.isnan("v")), digits=4)
prom("promql_timestamp", "timestamp(events_value)", ("event_type", "shard"), f"SELECT event_type, shard, t, round(v / 1000.0, 6) AS v FROM ({windowed('max(ts)', 12 * HOUR)})")
prom("promql_calendar", "hour() + day_of_week() * 100 + day_of_month() * 1000 + month() * 100000 + minute() * 0 + day_of_year() * 0 + days_in_month() * 0 + year() * 0", (), f"SELECT t, (hour(d) + dayofweek(d) * 100 + day(d) * 1000 + month(d) * 100000)::DOUBLE AS v FROM (SELECT t, make_timestamp(t * 1000) AS d FROM ({GRID}))")
prom("metricsql_default", 'events_value{event_type="click"} > 80 default 0', ("event_type", "shard"), f"WITH a AS (SELECT * FROM ({_CLICK}) WHERE v > 80), k AS (SELECT DISTINCT event_type, shard FROM a) SELECT event_type, shard, t, round(coalesce(v, 0), 6) AS v FROM (SELECT * FROM k, ({GRID})) LEFT JOIN a USING (event_type, shard, t)", metricsql=True)
prom("metricsql_if", 'events_value{event_type="click"} if on(shard) (events_value{event_type="view"} > 60)', ("event_type", "shard"), ORACLE_SQL["promql_and"], metricsql=True)
prom("metricsql_ifnot", 'events_value{event_type="click"} ifnot on(shard) (events_value{event_type="view"} > 60)', ("event_type", "shard"), ORACLE_SQL["promql_unless"], metricsql=True)
prom("metricsql_union_labels", '(label_set(sum(events_value{event_type="click"}), "x", "a"), label_del(label_set(sum(events_value{event_type="view"}), "x", "b", "y", "c"), "y"),)', ("x",), f"SELECT 'a' AS x, t, round(sum(v), 6) AS v FROM ({_CLICK}) GROUP BY t UNION ALL SELECT 'b', t, round(sum(v), 6) FROM ({_VIEW}) GROUP BY t", metricsql=True)
prom("metricsql_range_sum", "range_sum(sum by (shard) (events_value))", ("shard",), f"SELECT shard, t, round(v, 4) AS v FROM (SELECT shard, sum(v) AS v FROM ({LAST}) GROUP BY shard), ({GRID})", metricsql=True)
QUERIES["metricsql_range_sum"] = lambda spark, d: shown(Metrics(samples(spark, d), 12 * HOUR).query_range("range_sum(sum by (shard) (events_value))", START, STOP, SIX, True), "shard", digits=4)
prom("metricsql_running_max", "running_max(sum by (shard) (events_value))", ("shard",), f"WITH a AS (SELECT shard, t, sum(v) AS v FROM ({LAST}) GROUP BY ALL), k AS (SELECT shard, min(t) AS f FROM a GROUP BY shard) SELECT shard, t, round(max(v) OVER (PARTITION BY shard ORDER BY t), 6) AS v FROM (SELECT shard, t FROM k, ({GRID}) g WHERE t >= f) LEFT JOIN a USING (shard, t)", metricsql=True)
prom("metricsql_step_durations", "sum by (shard) (sum_over_time(events_value[4i]))", ("shard",), f"SELECT shard, t, round(sum(v), 4) AS v FROM ({SAMPLES}) s JOIN ({GRID}) g ON s.ts > t - {DAY} AND s.ts <= t GROUP BY ALL", metricsql=True)
QUERIES["metricsql_step_durations"] = lambda spark, d: shown(Metrics(samples(spark, d), 12 * HOUR).query_range("sum by (shard) (sum_over_time(events_value[4i]))", START, STOP, SIX, True), "shard", digits=4)
prom("metricsql_sum_rollup", "sum(sum_over_time(events_value)) by (shard)", ("shard",), f"SELECT shard, t, round(sum(v), 4) AS v FROM ({SAMPLES}) s JOIN ({GRID}) g ON s.ts > t - {SIX} AND s.ts <= t GROUP BY ALL", metricsql=True)
QUERIES["metricsql_sum_rollup"] = lambda spark, d: shown(Metrics(samples(spark, d), 0).query_range("sum(sum_over_time(events_value)) by (shard)", START, STOP, SIX, True), "shard", digits=4)
prom("metricsql_default_rollup", "default_rollup(events_value)", ("event_type", "shard"), "", metricsql=True)


@query(f"""WITH b AS (SELECT event_type, t, le, count(*) FILTER (v <= le) AS c FROM ({SAMPLES}) s JOIN ({GRID}) g ON s.ts > t - {DAY} AND s.ts <= t, (SELECT unnest([10.0, 50.0, 100.0, 'Infinity'::DOUBLE]) AS le) GROUP BY ALL),
p AS (SELECT *, lag(c, 1, 0) OVER w AS pc, lag(le, 1, 0) OVER w AS pl, max(c) OVER (PARTITION BY event_type, t) AS n FROM b WINDOW w AS (PARTITION BY event_type, t ORDER BY le)),
f AS (SELECT *, row_number() OVER (PARTITION BY event_type, t ORDER BY le) AS r FROM p WHERE c >= 0.9 * n)
SELECT event_type, t, round(CASE WHEN isinf(le) THEN pl ELSE pl + (le - pl) * (0.9 * n - pc) / (c - pc) END, 6) AS v FROM f WHERE r = 1 AND n > 0""")  # fmt: skip
def promql_histogram_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A classic histogram from the gauge: counts at fixed bounds over a day."""
    rows = samples(spark, sf_dir)
    bounds = F.explode(F.array(*[F.struct(F.lit(t).alias("le"), F.lit(x).alias("x")) for t, x in (("10", 10.0), ("50", 50.0), ("100", 100.0), ("+Inf", float("inf")))]))
    marked = rows.select(F.lit("events_bucket").alias("metric"), F.col("labels.event_type").alias("e"), "ts_ms", "value", "seq", bounds.alias("b"))
    buckets = marked.select("metric", F.create_map(F.lit("event_type"), F.col("e"), F.lit("le"), F.col("b.le")).alias("labels"), "ts_ms", (F.col("value") <= F.col("b.x")).cast("double").alias("value"), "seq")
    return shown(Metrics(buckets).query_range("histogram_quantile(0.9, sum_over_time(events_bucket[1d]))", START, STOP, SIX), "event_type")


# table functions


def by_label(df: DataFrame, *rest: str) -> DataFrame:
    return df.select(F.col("labels.event_type").alias("event_type"), F.col("labels.shard").alias("shard"), *[F.round(c, 6).alias(c) if c == "value" else F.col(c) for c in rest])


@query(f"SELECT event_type, shard, ts AS ts_ms, round(v, 6) AS value FROM ({SAMPLES}) WHERE event_type = 'click' AND ts BETWEEN {START} AND {START + 5 * DAY}")
def table_raw(spark, sf_dir):
    return by_label(tables.raw(samples(spark, sf_dir), "events_value", '{"event_type": "click"}', START, START + 5 * DAY), "ts_ms", "value")


@query(f"SELECT event_type, shard, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM ({SAMPLES}) GROUP BY ALL")
def table_raw_batches(spark, sf_dir):
    batches = tables.raw_batches(samples(spark, sf_dir), "events_value")
    return by_label(batches.withColumns({"n": F.size("points").cast("long"), "first_ts": F.col("points")[0]["ts"], "last_ts": F.element_at("points", -1)["ts"]}), "n", "first_ts", "last_ts")


@query(f"SELECT event_type, shard, max(ts) AS ts_ms, round(arg_max(v, ts), 6) AS value FROM ({SAMPLES}) WHERE event_type IN ('click', 'error') GROUP BY ALL")
def table_latest(spark, sf_dir):
    return by_label(tables.latest(samples(spark, sf_dir), "events_value", '{"event_type": {"re": "click|error"}}'), "ts_ms", "value")


@query(f"SELECT event_type, shard, round(avg(v), 6) AS value FROM ({SAMPLES}) WHERE event_type <> 'click' GROUP BY ALL")
def table_aggregate(spark, sf_dir):
    return by_label(tables.aggregate(samples(spark, sf_dir), "events_value", "avg", '{"event_type": {"neq": "click"}}'), "value")


@query(f"WITH f AS ({LAST}), k AS (SELECT DISTINCT event_type, shard FROM f) SELECT event_type, shard, t, round(v, 6) AS value FROM (SELECT * FROM k, ({GRID})) LEFT JOIN f USING (event_type, shard, t)")
def table_grid(spark, sf_dir):
    return by_label(tables.grid(samples(spark, sf_dir), "events_value", START, STOP, SIX, 12 * HOUR, fill="null"), "t", "value")


@query(f"SELECT event_type, shard, t, round(v, 6) AS value FROM ({windowed('quantile_disc(v, 0.95)', DAY)})")
def table_window_p95(spark, sf_dir):
    return by_label(tables.window(samples(spark, sf_dir), "events_value", "p95", START, STOP, SIX, DAY), "t", "value")


@query(f"SELECT event_type, shard, t, round(sum(CASE WHEN pv IS NULL THEN 0 WHEN v < pv THEN v ELSE v - pv END) - arg_min(CASE WHEN pv IS NULL THEN 0 WHEN v < pv THEN v ELSE v - pv END, ts), 6) AS value FROM ({_INNER}) GROUP BY ALL")
def table_window_increase(spark, sf_dir):
    return by_label(tables.window(counters(spark, sf_dir), "events_total", "increase", START, STOP, SIX, DAY), "t", "value")


@query(f"SELECT event_type, shard, t, round(list_avg(list_sort(l)[1 + (len(l) * 10) // 100 : len(l) - (len(l) * 10) // 100]), 6) AS value FROM ({windowed('list(v)', DAY).replace('AS v FROM', 'AS l FROM')})")
def table_window_tavg(spark, sf_dir):
    return by_label(tables.window(samples(spark, sf_dir), "events_value", "tavg:10", START, STOP, SIX, DAY), "t", "value")


@query(f"SELECT event_type, shard, {START} + (ts - {START}) // {DAY} * {DAY} AS bucket_ms, round(arg_max(v, ts), 6) AS value FROM ({SAMPLES}) WHERE ts BETWEEN {START} AND {STOP} GROUP BY ALL")
def table_tumbling_last(spark, sf_dir):
    return by_label(tables.tumbling(samples(spark, sf_dir), "events_value", "last", START, STOP, DAY), "bucket_ms", "value")


@query(f"SELECT event_type, shard, ts // {DAY} * {DAY} AS bucket_ms, count(*) AS n, round(sum(v), 6) AS total, round(min(v), 6) AS low, round(max(v), 6) AS high, max(ts) AS last_ts FROM ({SAMPLES}) GROUP BY ALL")
def table_rollup_ladder(spark, sf_dir):
    tier = tables.coarser(tables.rollup_tier(samples(spark, sf_dir), HOUR), DAY)
    return by_label(tier.select("*", *[F.round(c, 6).alias(f"r_{c}") for c in ("total", "low", "high")]).drop("total", "low", "high").withColumnsRenamed({f"r_{c}": c for c in ("total", "low", "high")}), "bucket_ms", "n", "total", "low", "high", "last_ts")


@query(f"SELECT event_type, shard, min(ts) AS min_ts, max(ts) AS max_ts, count(*) AS points FROM ({SAMPLES}) GROUP BY ALL")
def table_series(spark, sf_dir):
    return by_label(tables.series(samples(spark, sf_dir), "events_value"), "min_ts", "max_ts", "points")


@query("SELECT DISTINCT event_type AS value FROM events")
def table_label_values(spark, sf_dir):
    return tables.label_values(samples(spark, sf_dir), "events_value", "event_type")


@query("SELECT DISTINCT unnest(['__name__', 'event_type', 'shard']) AS label FROM events")
def metrics_labels(spark, sf_dir):
    return Metrics(samples(spark, sf_dir)).labels("events_value")


@query(f"SELECT count(*) AS n FROM ({ENTRIES}) WHERE level = 'error' AND message ILIKE '%user 1%' AND ts <= {(START + 10 * DAY) * 1000}")
def table_log_count(spark, sf_dir):
    return tables.log_count(entries(spark, sf_dir), level="error", contains="User 1", stop=(START + 10 * DAY) * 1000)


@query(f"SELECT DISTINCT user_id::VARCHAR AS value FROM ({ENTRIES}) WHERE level = 'notice' ORDER BY 1 LIMIT 50")
def table_log_values(spark, sf_dir):
    return tables.log_values(entries(spark, sf_dir), "user_id", 50, level="notice")


@query(f"SELECT {START * 1000} + (ts - {START * 1000}) // {DAY * 1000} * {DAY * 1000} AS bucket, level AS key, count(*) AS n FROM ({ENTRIES}) WHERE ts BETWEEN {START * 1000} AND {STOP * 1000} GROUP BY ALL")
def table_log_buckets(spark, sf_dir):
    return tables.log_buckets(entries(spark, sf_dir), START * 1000, STOP * 1000, DAY * 1000)


@query(f"SELECT ts, seq, level FROM ({ENTRIES}) WHERE message LIKE 'view%' ORDER BY ts DESC, seq DESC LIMIT 20 OFFSET 5")
def table_log_rows(spark, sf_dir):
    return tables.log_rows(entries(spark, sf_dir), like="view%", descending=True, limit=20, offset=5).select("ts", "seq", "level")


# LogsQL

NOW = (START + 30 * DAY) * 1000


def logsql(name: str, text: str, fields: dict[str, str], sql: str, source=entries) -> None:
    """fields: the result's columns, with their types."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = Logs(source(spark, sf_dir)).query(text, NOW, *fields, ordered=False)
        return df.select(*[(F.round(F.col(f"`{c}`").try_cast("double"), 6) if k == "double" else F.col(f"`{c}`").try_cast(k)).alias(c.replace(".", "_")) for c, k in fields.items()])

    run.__name__ = name
    run.__doc__ = text
    query(sql)(run)


E, B = f"({ENTRIES})", "bigint"
logsql("logsql_word_level", 'level:error user | fields _msg, k', {"_msg": "string", "k": B}, f"SELECT message AS _msg, k FROM {E} WHERE level = 'error'")
logsql("logsql_phrase", '"user 7" | count() as n', {"n": B}, f"SELECT count(*) AS n FROM {E} WHERE user_id = 7")
logsql("logsql_prefix", '"user 7"* -click | stats by (event_type) count() as n', {"event_type": "string", "n": B}, f"SELECT event_type, count(*) AS n FROM {E} WHERE user_id::VARCHAR LIKE '7%' AND event_type <> 'click' GROUP BY ALL")
logsql("logsql_boolean", '(click or view) user_id:in(1, 2, 3) !level:debug | stats by (user_id) count() n', {"user_id": B, "n": B}, f"SELECT user_id, count(*) AS n FROM {E} WHERE event_type = 'click' AND user_id IN (1, 2, 3) GROUP BY ALL")
logsql("logsql_regexp", '~"^(error|signup) user [0-9]$" | stats by (level) count() n', {"level": "string", "n": B}, f"SELECT level, count(*) AS n FROM {E} WHERE regexp_full_match(message, '(error|signup) user [0-9]') GROUP BY ALL")
logsql("logsql_compare", "k:>=50 user_id:range(10, 20] | stats by (event_type) count() n, min(k) lo, max(k) hi", {"event_type": "string", "n": B, "lo": B, "hi": B}, f"SELECT event_type, count(*) AS n, min(k) AS lo, max(k) AS hi FROM {E} WHERE k >= 50 AND user_id > 10 AND user_id <= 20 GROUP BY ALL")
logsql("logsql_time_range", "_time:[2024-01-03, 2024-01-05) | stats by (level) count() n", {"level": "string", "n": B}, f"SELECT level, count(*) AS n FROM {E} WHERE ts >= {(START + 2 * DAY) * 1000} AND ts < {(START + 4 * DAY) * 1000} GROUP BY ALL")
logsql("logsql_relative_time", "_time:5d | count() n", {"n": B}, f"SELECT count(*) AS n FROM {E} WHERE ts >= {NOW - 5 * DAY * 1000} AND ts < {NOW}")
logsql("logsql_day_week_range", "_time:day_range[08:00, 18:00) _time:week_range[Mon, Fri] | count() n", {"n": B}, f"SELECT count(*) AS n FROM {E} WHERE ts // 1000000 % 86400 >= 28800 AND ts // 1000000 % 86400 < 64800 AND (ts // 86400000000 + 4) % 7 BETWEEN 1 AND 5")
logsql("logsql_sort_limit", "level:notice | sort by (k desc, _time) limit 20 | fields k, _time", {"k": B, "_time": "timestamp"}, f"SELECT k, make_timestamp(ts) AS _time FROM {E} WHERE level = 'notice' ORDER BY k DESC, ts, seq LIMIT 20")
QUERIES["logsql_sort_limit"] = lambda spark, d: Logs(entries(spark, d)).query("level:notice | sort by (k desc, _time) limit 20", NOW, "k", "user_id").select(F.col("k").cast("long").alias("k"), F.col("user_id").cast("long").alias("user_id"))
ORACLE_SQL["logsql_sort_limit"] = f"SELECT k, user_id FROM {E} WHERE level = 'notice' ORDER BY k DESC, ts, seq LIMIT 20"
logsql("logsql_stats", "* | stats by (event_type) count() n, sum(k) s, avg(k) a, count_uniq(user_id) u, stddev(k) d, sum_len(event_type) b", {"event_type": "string", "n": B, "s": B, "a": "double", "u": B, "d": "double", "b": B}, f"SELECT event_type, count(*) AS n, sum(k)::BIGINT AS s, round(avg(k), 6) AS a, count(DISTINCT user_id) AS u, round(stddev_pop(k), 6) AS d, sum(strlen(event_type))::BIGINT AS b FROM {E} GROUP BY ALL")
logsql("logsql_stats_if", "* | stats by (level) count() if (k:>50) n, count_empty(nothing) e", {"level": "string", "n": B, "e": B}, f"SELECT level, count(*) FILTER (k > 50) AS n, count(*) AS e FROM {E} GROUP BY ALL")
logsql("logsql_quantile", "* | stats by (event_type) quantile(0.9, k) q", {"event_type": "string", "q": B}, f"SELECT event_type, l[least(floor(len(l) * 0.9)::BIGINT, len(l) - 1) + 1] AS q FROM (SELECT event_type, list_sort(list(k)) AS l FROM {E} GROUP BY ALL)")
logsql("logsql_top", "* | top 7 by (user_id) hits as n", {"user_id": B, "n": B}, f"SELECT user_id, n FROM (SELECT user_id, count(*) AS n FROM {E} GROUP BY user_id) ORDER BY n DESC, user_id::VARCHAR LIMIT 7")
logsql("logsql_uniq", "k:<20 | uniq by (k, level) hits", {"k": B, "level": "string", "hits": B}, f"SELECT k, level, count(*) AS hits FROM {E} WHERE k < 20 GROUP BY ALL")
logsql("logsql_field_values", "* | field_values event_type", {"event_type": "string", "hits": B}, f"SELECT event_type, count(*) AS hits FROM {E} GROUP BY ALL")
logsql("logsql_field_names", "level:error | field_names", {"name": "string", "hits": B}, f"SELECT unnest(['_time', '_msg', 'level', 'k', 'user_id', 'event_type']) AS name, count(*) AS hits FROM {E} WHERE level = 'error' GROUP BY ALL")
ORACLE_SQL["logsql_field_names"] = f"SELECT name, hits FROM (SELECT count(*) AS hits FROM {E} WHERE level = 'error'), (SELECT unnest(['_time', '_msg', 'level', 'k', 'user_id', 'event_type']) AS name)"
logsql("logsql_first_last", "* | first 2 by (_time) partition by (event_type) | fields event_type, _msg", {"event_type": "string", "_msg": "string"}, f"SELECT event_type, message AS _msg FROM {E} QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, seq) <= 2")
logsql("logsql_math_format", 'level:error | math (k * 2 + user_id) / 4 as x | format "<uc:event_type>:<k>" as y | fields x, y', {"x": "double", "y": "string"}, f"SELECT round((k * 2 + user_id) / 4, 6) AS x, upper(event_type) || ':' || k AS y FROM {E} WHERE level = 'error'")
logsql("logsql_extract_replace", 'level:notice | extract "<what> user <who>" | replace ("user", "u") | fields what, who, _msg', {"what": "string", "who": B, "_msg": "string"}, f"SELECT event_type AS what, user_id AS who, replace(message, 'user', 'u') AS _msg FROM {E} WHERE level = 'notice'")
logsql("logsql_pack_unpack", "level:warning | pack_json fields (k, user_id) as j | delete k, user_id | unpack_json from j result_prefix u_ | fields j, u_k, u_user_id", {"j": "string", "u_k": B, "u_user_id": B}, f"""SELECT '{{"k":' || k || ',"user_id":' || user_id || '}}' AS j, k AS u_k, user_id AS u_user_id FROM {E} WHERE level = 'warning'""")
logsql("logsql_split_unroll", 'level:error | split " " as w | unroll by (w) | stats by (w) count() n | filter w:~"^[a-z]+$"', {"w": "string", "n": B}, f"SELECT w, count(*) AS n FROM (SELECT unnest(string_split(message, ' ')) AS w FROM {E} WHERE level = 'error') WHERE regexp_full_match(w, '[a-z]+') GROUP BY ALL")
logsql("logsql_join", "level:error | join by (user_id) (level:notice | stats by (user_id) count() n) inner | stats by (user_id) count() c, max(n) n", {"user_id": B, "c": B, "n": B}, f"SELECT user_id, count(*) AS c, max(n) AS n FROM {E} JOIN (SELECT user_id, count(*) AS n FROM {E} WHERE level = 'notice' GROUP BY ALL) USING (user_id) WHERE level = 'error' GROUP BY ALL")
logsql("logsql_union", "level:error | union (level:notice) | stats by (level) count() n", {"level": "string", "n": B}, f"SELECT level, count(*) AS n FROM {E} WHERE level IN ('error', 'notice') GROUP BY ALL")
logsql("logsql_running_stats", "level:notice | running_stats by (user_id) count() n, sum(k) s | fields user_id, n, s", {"user_id": B, "n": B, "s": B}, f"SELECT user_id, count(*) OVER w AS n, sum(k) OVER w AS s FROM {E} WHERE level = 'notice' WINDOW w AS (PARTITION BY user_id ORDER BY ts, seq)".replace("sum(k) OVER w", "(sum(k) OVER w)::BIGINT"))
logsql("logsql_total_stats", "level:notice | total_stats by (user_id) max(k) m | fields user_id, m", {"user_id": B, "m": B}, f"SELECT user_id, max(k) OVER (PARTITION BY user_id) AS m FROM {E} WHERE level = 'notice'")
logsql("logsql_subquery_in", "user_id:in(level:error k:>95 | fields user_id) level:notice | count() n", {"n": B}, f"SELECT count(*) AS n FROM {E} WHERE level = 'notice' AND user_id IN (SELECT user_id FROM {E} WHERE level = 'error' AND k > 95)")
logsql("logsql_facets", "level:error | facets 3 | filter field_name:in(k, event_type) | fields field_name, field_value, hits", {"field_name": "string", "field_value": "string", "hits": B}, f"SELECT 'k' AS field_name, k::VARCHAR AS field_value, count(*) AS hits FROM {E} WHERE level = 'error' GROUP BY ALL ORDER BY hits DESC, field_value LIMIT 3")
logsql("logsql_prose", '"the" -~"[|#]" lang:en | stats by (source) count() n', {"source": "string", "n": B}, "SELECT source, count(*) AS n FROM documents WHERE lang = 'en' AND regexp_matches(text, '(^|[^\\p{L}\\p{Nd}_])the($|[^\\p{L}\\p{Nd}_])') AND NOT regexp_matches(text, '[|#]') GROUP BY ALL", prose)
logsql("logsql_len_range", "_msg:len_range(100, 500) | stats by (lang) count() n", {"lang": "string", "n": B}, "SELECT lang, count(*) AS n FROM documents WHERE length(text) BETWEEN 100 AND 500 GROUP BY ALL", prose)
logsql("logsql_hash", "level:error | hash(_msg) as h | fields h", {"h": B}, "")
logsql("logsql_syslog", 'level:error | format "1 2024-01-01T00:00:00Z host app <k> ID - <_msg>" as m | unpack_syslog from m | stats by (proc_id) count() n', {"proc_id": B, "n": B}, f"SELECT k AS proc_id, count(*) AS n FROM {E} WHERE level = 'error' GROUP BY ALL")
logsql("logsql_collapse_nums", "* | collapse_nums | uniq by (_msg) hits", {"_msg": "string", "hits": B}, f"SELECT event_type || ' user <N>' AS _msg, count(*) AS hits FROM {E} GROUP BY ALL")


# traces


@query(f"SELECT DISTINCT service FROM ({SPANS})")
def trace_services(spark, sf_dir):
    return traces.services(spans(spark, sf_dir))


@query(f"SELECT DISTINCT name FROM ({SPANS}) WHERE service = 'R'")
def trace_operations(spark, sf_dir):
    return traces.operations(spans(spark, sf_dir), "R")


_YEAR = 365 * 86_400 * 10**9


@query(f"SELECT start_ts // {_YEAR} * {_YEAR} AS bucket, service, count(*) AS spans, count(*) FILTER (status = 'error') AS errors, sum(duration_ns)::BIGINT AS dur_sum, min(duration_ns) AS dur_min, max(duration_ns) AS dur_max, quantile_disc(duration_ns, 0.5) AS p50, quantile_disc(duration_ns, 0.95) AS p95, quantile_disc(duration_ns, 0.99) AS p99 FROM ({SPANS}) WHERE start_ts >= 0 GROUP BY ALL")
def trace_buckets(spark, sf_dir):
    return traces.buckets(spans(spark, sf_dir), 0, 2**62, _YEAR)


@query(f"""SELECT trace_id, count(*) AS rows, count(DISTINCT span_id) AS spans, count(*) FILTER (status = 'error') AS errors, min(start_ts) AS start_ts, max(start_ts + duration_ns) AS end_ts, max(start_ts + duration_ns) - min(start_ts) AS duration_ns, count(DISTINCT service) AS service_count,
CASE count(*) FILTER (parent_span_id IS NULL) WHEN 1 THEN 'unique' WHEN 0 THEN 'missing' ELSE 'ambiguous' END AS root_state, CASE WHEN count(*) FILTER (parent_span_id IS NULL) = 1 THEN min(name) FILTER (parent_span_id IS NULL) END AS root_name, CASE WHEN count(*) FILTER (parent_span_id IS NULL) = 1 THEN min(service) FILTER (parent_span_id IS NULL) END AS root_service FROM ({SPANS}) GROUP BY trace_id""")  # fmt: skip
def trace_summaries(spark, sf_dir):
    return traces.summaries(spans(spark, sf_dir))


@query(f"WITH f AS (SELECT * FROM ({SPANS}) WHERE service = 'R' AND duration_ns >= 1500000 ORDER BY start_ts DESC, span_id DESC LIMIT 200) SELECT trace_id, count(*) AS spans, min(start_ts) AS start_ts, max(start_ts + duration_ns) AS end_ts FROM f GROUP BY trace_id")
def trace_search(spark, sf_dir):
    return traces.search(spans(spark, sf_dir), "R", min_duration="1.5ms", limit=200).drop("span_ids")


@query(f"SELECT trace_id, span_id, start_ts, true AS has_more FROM ({SPANS}) WHERE kind = 'server' AND status = 'error' AND name LIKE '%part-1%' ORDER BY start_ts DESC, span_id DESC LIMIT 30 OFFSET 10")
def trace_span_search(spark, sf_dir):
    return traces.span_search(spans(spark, sf_dir), "server", "error", "PART-1", 30, 10).select("trace_id", "span_id", "start_ts", "has_more")


@query(f"SELECT trace_id, span_id, service, name, start_ts, duration_ns FROM ({SPANS}) WHERE trace_id = 7")
def trace_by_id(spark, sf_dir):
    return traces.trace(spans(spark, sf_dir), 7).select("trace_id", "span_id", "service", "name", "start_ts", "duration_ns")


@query("")
def trace_jaeger(spark, sf_dir):
    return traces.jaeger_trace(spans(spark, sf_dir), 7)


# health


@query(f"SELECT event_type, shard, max(ts) AS ts_ms, round(arg_max(v, ts), 6) AS value, CASE WHEN arg_max(v, ts) >= 100 THEN 'critical' WHEN arg_max(v, ts) >= 50 THEN 'warning' ELSE 'ok' END AS state FROM ({SAMPLES}) GROUP BY ALL")
def health_report(spark, sf_dir):
    report = tables.health_report(samples(spark, sf_dir), {"events_value": (50.0, 100.0)})
    return report.select(F.get_json_object("lkey", "$.event_type").alias("event_type"), F.get_json_object("lkey", "$.shard").alias("shard"), "ts_ms", F.round("value", 6).alias("value"), "state")


@query(f"SELECT event_type, shard, round(arg_min(v, ts), 6) AS first_value, round(arg_max(v, ts), 6) AS last_value, round((arg_max(v, ts) - arg_min(v, ts)) * 1000 / (max(ts) - min(ts)), 9) AS per_second FROM ({SAMPLES}) GROUP BY ALL")
def health_trends(spark, sf_dir):
    trends = tables.health_trends(samples(spark, sf_dir))
    return trends.select(F.get_json_object("lkey", "$.event_type").alias("event_type"), F.get_json_object("lkey", "$.shard").alias("shard"), F.round("first_value", 6).alias("first_value"), F.round("last_value", 6).alias("last_value"), F.round("per_second", 9).alias("per_second"))
