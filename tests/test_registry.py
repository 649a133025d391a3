from tripmarts.adapter import table
from tripmarts.plans import panels, registry
from tripmarts.plans.suite import union_families


def test_marts_build_once_and_serve_panels(spark, sf, tmp_path):
    t = lambda n: table(spark, sf, n)
    inputs = registry.Inputs(t("fhvhv_trips"), union_families({"yellow": (t("yellow_trips"), "tpep_pickup_datetime", "PULocationID"), "fhvhv": (t("fhvhv_trips"), "pickup_datetime", "PULocationID")}),
                             t("zones"), t("weather"), t("transit"), t("stations"), t("venues"), t("event_calendar"))
    st = registry.store(spark, str(tmp_path))
    settings = registry.Settings("1996-01-01", 1996, 1996, ("1996-03-01", "1996-03-11"))
    names = ["monthly_recovery_indexed", "zone_wait_by_aggregator", "zone_access", "zone_dominant_type", "event_hypothesis_venue", "trips_heatmap", "mart_shared_daily"]
    marts = registry.build(st, inputs, names, settings)
    assert set(names) <= set(marts) and "daily_by_borough" in marts and "wait_histogram" in marts
    written = st.records().count()
    again = registry.build(st, inputs, names, settings)
    assert st.records().count() == written and again["trips_heatmap"].count() == 7
    assert panels.panel("worst_wait_zones", marts, min_n=1).count() == 15
    assert panels.panel("recovery_series", marts, boroughs=["ASIA"]).where("series = 'transit'").count() > 0
