"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = f"{HERE}:{os.environ.get('PYTHONPATH', '')}"
SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
HEADLINES = (
    "promql_instant_selector promql_avg_over_time promql_avg_long_window promql_rate promql_agg_sum promql_topk promql_group_left promql_histogram_quantile"
    " table_latest table_aggregate table_window_p95 table_rollup_ladder table_log_buckets logsql_stats logsql_boolean trace_buckets trace_summaries trace_by_id"
).split()


def main() -> None:
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tellurion.queries import QUERIES

    QUERIES["table_latest"](spark, SF).write.format("noop").mode("overwrite").save()  # the JVM warms up
    took = {}
    for name in HEADLINES:
        began = time.time()
        QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF.rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
