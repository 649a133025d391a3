"""Time the headline queries: BENCH_SF_DIR (tables), BENCH_CPUS (local cores), BENCH_QUERIES (comma list, optional).

Prints one JSON line. Each query writes its whole result to Spark's no-op sink: once to warm up, then twice, of which the
faster run counts.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["clean_fhvhv", "clean_report", "anomaly_scorecard", "mart_shared_daily", "trips_daily", "trips_by_zone_daily", "monthly_by_type_indexed",
            "zone_wait_cube", "wav_dashboard_cells", "wav_v2_monthly_metrics", "wav_v2_zone_metrics", "product_metrics_yearly", "event_impact",
            "panel_worst_wait_zones", "mann_whitney_hist", "ols_elasticity_calendar_hc3", "busiest_day_flows", "road_edges"]


def main() -> None:
    from pyspark.sql import SparkSession

    import catalog

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", str(cpus)).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.adaptive.enabled", "true").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for n in names:
        took = []
        for _ in range(3):
            t = time.perf_counter()
            catalog.QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - t)
        times[n] = round(min(took[1:]), 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf.group(1)) if sf else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
