"""A sample of registered queries against their oracles on the smallest tables; tools_check.py runs all of them."""

import contextlib
import io
import re

import duckdb
import pytest

import catalog
from tools_check import canonical
from tripmarts.adapter import BASE

SAMPLE = ["mart_shared_daily", "zone_wait_cube", "wav_v2_monthly_metrics", "event_impact", "clean_fhvhv", "anomaly_scorecard", "mann_whitney_hist",
          "product_metrics_yearly", "panel_worst_wait_zones", "road_edges", "effect_share_within_hc3", "feed_combined_calendar"]


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_oracle(spark, sf, name):
    con = duckdb.connect()
    for b in BASE:
        con.execute(f"CREATE VIEW {b} AS SELECT * FROM '{sf}/{b}.parquet'")
    got = catalog.QUERIES[name](spark, sf).toPandas()
    assert canonical(got) == canonical(con.execute(catalog.ORACLES[name]).df())


def test_registry_is_consistent():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) and len(catalog.QUERIES) > 200


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_generated_code_of_wide_projections_is_compiled(spark, sf, broadcast):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before, printed = spark.conf.get(name), io.StringIO()
    spark.conf.set(name, broadcast)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # a plan that is not run yet has no code under adaptive execution
    try:
        with contextlib.redirect_stdout(printed):
            catalog.QUERIES["trip_features"](spark, sf).explain("codegen")
    finally:
        spark.conf.set(name, before)
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", printed.getvalue())]
    assert sizes and max(sizes) < 8000
