"""Regression, effects, forecasting and clustering."""

from pyspark.sql import functions as F

from catalog import access, events, regress, shared, stats, suite, tails
from catalog.base import T, cte, register
from tripmarts import lineage
from tripmarts.functions import trip as X
from tripmarts.operators import cluster as K
from tripmarts.operators import effects as E
from tripmarts.operators import forecast as FC
from tripmarts.operators import linear as L
from tripmarts.operators import window as W
from tripmarts.plans import access as A
from tripmarts.plans import panels as P
from tripmarts.plans import shared as S
from tripmarts.plans import suite as M

CAL = ("weekday", "month", "year")
OLS = "term:str coef:real se:real stat:real n r2:real"


def calendar(df, date="date"):
    return df.withColumns({"weekday": F.weekday(date), "month": F.month(date), "year": F.year(date)})


def city_days(spark, d):
    """Daily city panel with weather, transit, logs and calendar columns."""
    c = M.daily_citywide(T("fhvhv_trips")(spark, d), T("weather")(spark, d), T("transit")(spark, d)).join(
        T("weather")(spark, d).select("date", "awnd_ms"), "date", "left")
    return calendar(c.where("fare_per_mile > 0").withColumns({"log_trips": X.log_clip1("trips"), "log_fpm": F.log("fare_per_mile"), "log_subway": F.log(F.col("subway_ridership").cast("double"))}))


cte("city_days", """SELECT c.*, w.awnd_ms, ln(greatest(trips, 1)) AS log_trips, ln(fare_per_mile) AS log_fpm, ln(subway_ridership) AS log_subway
FROM m_daily_citywide c JOIN weather w ON w.date = c.date WHERE fare_per_mile > 0""")
# Simple regression with HC3 errors, in closed form.
HC3_1 = """SELECT '{term}' AS term, b AS coef, sqrt(v) AS se, b / sqrt(v) AS stat, n, r2 FROM (
  SELECT max(b) AS b, max(n) AS n, max(r2) AS r2, sum(pow((x - mx) * (y - a - b * x) / (1 - (1 / n + (x - mx) * (x - mx) / sxx)), 2)) / pow(max(sxx), 2) AS v FROM (
    SELECT x, y, avg(x) OVER () AS mx, regr_slope(y, x) OVER () AS b, regr_intercept(y, x) OVER () AS a, CAST(count(*) OVER () AS DOUBLE) AS n, regr_sxx(y, x) OVER () AS sxx,
      regr_r2(y, x) OVER () AS r2 FROM ({src}) s) q) w"""
OLS_1 = """SELECT '{term}' AS term, b AS coef, se, b / se AS stat, n, r2 FROM (SELECT regr_slope(y, x) AS b, count(*) AS n, regr_r2(y, x) AS r2,
  sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 2) / regr_sxx(y, x)) AS se FROM ({src}) s) q"""


cte("city_calendar", "SELECT *, isodow(date) AS weekday, month(date) AS month, year(date) AS year FROM city_days")
ROBUST_P = tails.normal_two_sided("stat")

# --- least squares -----------------------------------------------------------------------------------------------

@register("ols_naive_elasticity_hc3", OLS, HC3_1.format(term="log_fpm", src="SELECT log_fpm AS x, log_trips AS y FROM city_days"))
def q_naive(spark, d):
    return L.ols(city_days(spark, d), "log_trips", ["log_fpm"], cov="HC3", terms=["log_fpm"])


@register("ols_elasticity_calendar_hc3", "term:str coef:real se:real stat:real p_value:real n r2:real", tails.with_p(
    regress.table(regress.least_squares("SELECT * FROM city_calendar", "log_trips", ["log_fpm"], CAL, cov="HC3"), ["log_fpm"]), ROBUST_P))
def q_elasticity(spark, d):
    return L.ols(city_days(spark, d), "log_trips", ["log_fpm"], CAL, cov="HC3", terms=["log_fpm"])


@register("ols_rain_month_effects", "term:str coef:real n", """
SELECT 'prcp_mm' AS term, regr_slope(y, x) AS coef, count(*) AS n FROM (
  SELECT log_trips - avg(log_trips) OVER (PARTITION BY month(date)) AS y, prcp_mm - avg(prcp_mm) OVER (PARTITION BY month(date)) AS x FROM city_days) q""")
def q_month(spark, d):
    return L.ols(city_days(spark, d), "log_trips", ["prcp_mm"], ["month"], terms=["prcp_mm"])


NEIGHBOURS = ["prcp_mm", "prcp_mm_tom", "prcp_mm_yest", "tmax_c", "tmax_c_tom", "awnd_ms"]
cte("city_neighbours", """SELECT *, lead(prcp_mm) OVER (ORDER BY date) AS prcp_mm_tom, lag(prcp_mm) OVER (ORDER BY date) AS prcp_mm_yest, lead(tmax_c) OVER (ORDER BY date) AS tmax_c_tom
FROM city_calendar""")


@register("ols_forecast_anticipation_hac", "outcome:str term:str coef:real se:real stat:real p_value:real n", " UNION ALL ".join(
    f"SELECT '{y}' AS outcome, * FROM (" + tails.with_p(regress.table(regress.least_squares(
        "SELECT * FROM city_neighbours", y, NEIGHBOURS, ("weekday", "month"), cov="HAC", order="date"), NEIGHBOURS[:3]), ROBUST_P) + ") one" for y in ("log_trips", "fare_per_mile")))
def q_hac(spark, d):
    days = W.Window.partitionBy(F.lit(1)).orderBy("date")
    p = city_days(spark, d).withColumns({f"{c}_{s}": (F.lead(c).over(days) if s == "tom" else F.lag(c).over(days)) for c in ("prcp_mm", "tmax_c") for s in ("tom", "yest")})
    p = lineage.cut(p)
    x = NEIGHBOURS
    out = None
    for y in ("log_trips", "fare_per_mile"):
        one = L.ols(p, y, x, ["weekday", "month"], cov="HAC", order="date", lags=3, terms=x[:3]).withColumn("outcome", F.lit(y))
        out = one if out is None else out.unionByName(one)
    return out


HAC_1 = """SELECT 'prcp_mm' AS term, b AS coef, sqrt((g0 + 2 * (0.75 * g1 + 0.5 * g2 + 0.25 * g3)) / pow(sxx, 2)) AS se, n FROM (
  SELECT max(b) AS b, max(sxx) AS sxx, max(n) AS n, sum(s * s) AS g0, sum(s * s1) AS g1, sum(s * s2) AS g2, sum(s * s3) AS g3 FROM (
    SELECT *, lag(s, 1) OVER (ORDER BY date) AS s1, lag(s, 2) OVER (ORDER BY date) AS s2, lag(s, 3) OVER (ORDER BY date) AS s3 FROM (
      SELECT date, b, sxx, n, (x - mx) * (y - a - b * x) AS s FROM (SELECT date, prcp_mm AS x, log_trips AS y, avg(prcp_mm) OVER () AS mx, regr_slope(log_trips, prcp_mm) OVER () AS b,
        regr_intercept(log_trips, prcp_mm) OVER () AS a, regr_sxx(log_trips, prcp_mm) OVER () AS sxx, count(*) OVER () AS n FROM city_days) q) r) t) u"""


@register("ols_rain_hac", "term:str coef:real se:real n", HAC_1)
def q_hac1(spark, d):
    return L.ols(city_days(spark, d), "log_trips", ["prcp_mm"], cov="HAC", order="date", lags=3, terms=["prcp_mm"])


@register("lead_lag_weather", "date:date prcp_mm:real prcp_mm_tom:real prcp_mm_yest:real", """
SELECT date, prcp_mm, lead(prcp_mm) OVER (ORDER BY date) AS prcp_mm_tom, lag(prcp_mm) OVER (ORDER BY date) AS prcp_mm_yest FROM weather""")
def q_leadlag(spark, d):
    w = W.Window.partitionBy(F.lit(1)).orderBy("date")
    return T("weather")(spark, d).withColumns({"prcp_mm_tom": F.lead("prcp_mm").over(w), "prcp_mm_yest": F.lag("prcp_mm").over(w)})


@register("ols_event_cluster_venue", "term:str coef:real se:real n", """
SELECT 'price_tier' AS term, b AS coef, sqrt(sum(sg * sg) / pow(max(sxx), 2) * count(*) / (count(*) - 1) * (max(n) - 1) / (max(n) - 2)) AS se, max(n) AS n FROM (
  SELECT venue_id, b, sum((x - mx) * (y - a - b * x)) AS sg, max(sxx) AS sxx, max(n) AS n FROM (SELECT venue_id, price_tier AS x, post_pu_lift_pct AS y, avg(price_tier) OVER () AS mx,
    regr_slope(post_pu_lift_pct, price_tier) OVER () AS b, regr_intercept(post_pu_lift_pct, price_tier) OVER () AS a, regr_sxx(post_pu_lift_pct, price_tier) OVER () AS sxx, count(*) OVER () AS n
    FROM m_event_hyp) q GROUP BY 1, 2) g GROUP BY b""")
def q_cluster(spark, d):
    return L.ols(events.hypothesis(spark, d), "post_pu_lift_pct", ["price_tier"], cov="cluster", cluster="venue_id", terms=["price_tier"])


def slot_rows(spark, d):
    h = A.hourly_daily(access.cells(spark, d))
    long = h.unpivot(["date", "provider", "dow", "hour"], ["accessibility_trips", "ordinary_trips"], "segment", "trips")
    return long.select("date", "provider", (F.col("dow") * 24 + F.col("hour")).alias("slot"), F.trunc("date", "MM").cast("string").alias("month"),
                       (F.col("segment") == "accessibility_trips").cast("double").alias("is_access"), F.log1p(F.col("trips").cast("double")).alias("log1p_trips"))


@register("wald_slot_interactions", "terms rank chi2:real p_value:real")
def q_wald(spark, d):
    rows = lineage.cut(slot_rows(spark, d))
    f = L.fit(rows, "log1p_trips", ["is_access"], ["slot", "provider", "month"], cov="cluster", cluster="date", interact=[("is_access", "slot")])["all"]
    return L.wald_block(rows, f, "is_access:slot=")


@register("glm_shared_duration", "term:str coef:real odds_ratio:real converged:bool", f"""
SELECT 'duration_group=' || g AS term, l - l0 AS coef, exp(l - l0) AS odds_ratio, TRUE AS converged FROM (
  SELECT {stats.DUR} AS g, ln(1.0 * count(*) FILTER (WHERE {stats.SH}) / count(*) FILTER (WHERE NOT {stats.SH})) AS l FROM shared_clean GROUP BY 1) a
CROSS JOIN (SELECT ln(1.0 * count(*) FILTER (WHERE {stats.SH}) / count(*) FILTER (WHERE NOT {stats.SH})) AS l0 FROM shared_clean WHERE trip_time < 600) b WHERE g <> '0-10'
UNION ALL SELECT 'const', ln(1.0 * count(*) FILTER (WHERE {stats.SH}) / count(*) FILTER (WHERE NOT {stats.SH})), 1.0 * count(*) FILTER (WHERE {stats.SH}) / count(*) FILTER (WHERE NOT {stats.SH}), TRUE
FROM shared_clean WHERE trip_time < 600""")
def q_glm(spark, d):
    return L.binomial_table(L.binomial(S.by_duration(shared.clean(spark, d)), "shared_trips", "total_trips", [], ["duration_group"]))


def _wav_glm(spark, d):
    z = A.peak_zone(access.cells(spark, d)).withColumns({"high": F.col("high_demand").cast("double"), "is_lyft": (F.col("provider") == "Lyft").cast("double")})
    return L.binomial(z, "ordinary_wav_trips", "ordinary_trips", ["high", "is_lyft"], ["zone_id"], cluster="zone_id")


@register("glm_wav_peak_cluster", "term:str coef:real se:real p_value:real odds_ratio:real or_low:real or_high:real converged:bool adjusted_difference:real")
def q_glm_zone(spark, d):
    f = _wav_glm(spark, d)
    return L.binomial_table(f, ["high", "is_lyft"]).withColumn("adjusted_difference", L.marginal_difference(f, "high", "ordinary_trips").scalar())


@register("standardised_weather_regression", "term:str coef:real r2:real", """
SELECT term, CASE term WHEN 'prcp_mm' THEN (r1 - r2 * r12) / (1 - r12 * r12) WHEN 'tmax_c' THEN (r2 - r1 * r12) / (1 - r12 * r12) ELSE 0 END AS coef,
  (r1 * r1 + r2 * r2 - 2 * r1 * r2 * r12) / (1 - r12 * r12) AS r2 FROM (SELECT corr(taxi_anom, prcp_mm) AS r1, corr(taxi_anom, tmax_c) AS r2, corr(prcp_mm, tmax_c) AS r12 FROM weather_days) q
CROSS JOIN (VALUES ('const'), ('prcp_mm'), ('tmax_c')) AS t(term)""")
def q_std(spark, d):
    return L.standardised(stats.weather_days(spark, d), "taxi_anom", ["prcp_mm", "tmax_c"])


FOUR = ["prcp_mm", "snow_mm", "tmax_c", "awnd_ms"]


@register("standardised_weather_regression_four", "term:str coef:real se:real r2:real", regress.table(regress.least_squares(
    "SELECT " + ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in ["fhvhv_anom", *FOUR])
    + " FROM weather_days WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in ["fhvhv_anom", *FOUR]), "fhvhv_anom", FOUR)))
def q_std4(spark, d):
    return L.standardised(stats.weather_days(spark, d), "fhvhv_anom", FOUR)


@register("ols_event_lift", "term:str coef:real n r2:real", """
SELECT t.term, CASE t.term WHEN 'price_tier' THEN b1 WHEN 'log_dist_m' THEN b2 ELSE my - b1 * m1 - b2 * m2 END AS coef, n, (b1 * s1y + b2 * s2y) / syy AS r2 FROM (
  SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM (
    SELECT count(*) AS n, avg(y) AS my, avg(a) AS m1, avg(b) AS m2, regr_sxx(y, a) AS s11, regr_sxx(y, b) AS s22, regr_sxy(b, a) AS s12, regr_sxy(y, a) AS s1y, regr_sxy(y, b) AS s2y, regr_syy(y, a) AS syy
    FROM (SELECT post_pu_lift_pct AS y, CAST(price_tier AS DOUBLE) AS a, log_dist_m AS b FROM m_event_hyp WHERE dist_m IS NOT NULL) e) s) c CROSS JOIN (VALUES ('const'), ('price_tier'), ('log_dist_m')) AS t(term)""")
def q_lift(spark, d):
    return L.ols(events.hypothesis(spark, d).where("dist_m is not null"), "post_pu_lift_pct", ["price_tier", "log_dist_m"])


@register("line_fit_rain_anomaly", "slope:real intercept:real r2:real", "SELECT regr_slope(fhvhv_anom, prcp_mm) AS slope, regr_intercept(fhvhv_anom, prcp_mm) AS intercept, regr_r2(fhvhv_anom, prcp_mm) AS r2 FROM weather_days")
def q_line(spark, d):
    return L.line_fit(stats.weather_days(spark, d), "fhvhv_anom", "prcp_mm")


# --- effects -----------------------------------------------------------------------------------------------------

ATE = "model:str treatment:str outcome:str n naive_r:real ate:real se:real ci_low:real ci_high:real p_value:real partial_r2:real robustness_value:real"


WEATHER = ["tmax_c", "awnd_ms", "snow_mm"]


def effect_sql(src: str, treatment: str, outcome: str, adjust: list[str], categories: tuple[str, ...], by: str = "'all'", model: str = "g", **more: str) -> str:
    """An adjusted effect with interval and sensitivity, from least squares in SQL."""
    used = " AND ".join(f"{c} IS NOT NULL" for c in [treatment, outcome, *adjust, *categories])
    fitted = regress.table(regress.least_squares(src, outcome, [treatment, *adjust], categories, by), [treatment])
    naive = f"SELECT {by} AS g, corr({outcome}, {treatment}) AS naive_r FROM ({src}) rows WHERE {used} GROUP BY 1"
    cols = ", ".join(f"{sql} AS {name}" for name, sql in more.items())
    return tails.with_p(f"""SELECT {model} AS model, '{treatment}' AS treatment, '{outcome}' AS outcome, n, naive_r, coef AS ate, se, coef - 1.96 * se AS ci_low, coef + 1.96 * se AS ci_high,
  stat * stat / (stat * stat + df) AS partial_r2, (sqrt(pow(stat * stat / df, 2) + 4 * stat * stat / df) - stat * stat / df) / 2 AS robustness_value, stat, df{', ' + cols if cols else ''}
FROM ({fitted}) fitted JOIN ({naive}) naive USING (g)""", tails.t_two_sided("stat", "df"))


def draw_sql(seed: int, key: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}-' || CAST({key} AS VARCHAR)), 1, 8) AS BIGINT)"


def moved_sql(src: str, key: str, column: str, seed: int = 42) -> str:
    """src with the column's values at other places: the value of hash rank p goes to the row of key rank p."""
    return f"""SELECT a.* EXCLUDE ({column}, pos), b.{column} FROM (SELECT *, row_number() OVER (ORDER BY {key}) - 1 AS pos FROM ({src}) s) a JOIN (
  SELECT {column}, row_number() OVER (ORDER BY {draw_sql(seed, 'pos')}, pos) - 1 AS place FROM (SELECT {column}, row_number() OVER (ORDER BY {key}) - 1 AS pos FROM ({src}) s) t) b ON b.place = a.pos"""


cte("rain_days", "SELECT date, prcp_mm, log_trips, " + ", ".join([*WEATHER, *CAL]) + " FROM city_calendar WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in ["prcp_mm", "log_trips", *WEATHER]))


def rain_again(src: str, *more: str) -> str:
    return regress.coefficient(regress.least_squares(src, "log_trips", ["prcp_mm", *WEATHER, *more], CAL), "prcp_mm")


@register("effect_rain_citywide", ATE + " placebo:real random_cause:real subset80:real", effect_sql(
    "SELECT * FROM rain_days", "prcp_mm", "log_trips", WEATHER, CAL, model="'citywide'", placebo=rain_again(moved_sql("SELECT * FROM rain_days", "date", "prcp_mm")),
    random_cause=rain_again(f"SELECT *, {draw_sql(42, 'date')} / 4294967296.0 AS noise FROM rain_days", "noise"),
    subset80=rain_again(f"SELECT * FROM rain_days WHERE {draw_sql(43, 'date')} / 4294967296.0 < 0.8")))
def q_rain(spark, d):
    return E.adjusted_effect(city_days(spark, d), "prcp_mm", "log_trips", WEATHER, CAL, key="date",
                             refute=("placebo", "random_cause", "subset"), label="citywide")


def borough_days(spark, d):
    b = suite.by_borough(spark, d).join(T("weather")(spark, d), "date")
    return calendar(b).withColumn("log_trips", X.log_clip1("trips"))


cte("borough_calendar", """SELECT b.borough, b.date, ln(greatest(b.trips, 1)) AS log_trips, w.prcp_mm, w.tmax_c, w.awnd_ms, w.snow_mm, isodow(b.date) AS weekday, month(b.date) AS month,
  year(b.date) AS year FROM m_daily_by_borough b JOIN weather w ON w.date = b.date""")


@register("effect_rain_by_borough", ATE + " pct_per_10mm:real", "SELECT *, 100 * (exp(10 * ate) - 1) AS pct_per_10mm FROM (" + effect_sql(
    "SELECT * FROM borough_calendar", "prcp_mm", "log_trips", WEATHER, CAL, by="borough") + ") boroughs")
def q_rain_borough(spark, d):
    return E.adjusted_effect(borough_days(spark, d), "prcp_mm", "log_trips", WEATHER, CAL, by="borough").withColumn("pct_per_10mm", X.pct_effect("ate"))


@register("effect_rain_by_borough_simple", "model:str n naive_r:real ate:real se:real", """
SELECT borough AS model, count(*) AS n, corr(p, y) AS naive_r, regr_slope(y, p) AS ate, sqrt((regr_syy(y, p) - regr_slope(y, p) * regr_sxy(y, p)) / (count(*) - 2) / regr_sxx(y, p)) AS se
FROM (SELECT borough, ln(greatest(trips, 1)) AS y, w.prcp_mm AS p FROM m_daily_by_borough b JOIN weather w ON w.date = b.date) q GROUP BY 1""")
def q_rain_simple(spark, d):
    return E.adjusted_effect(borough_days(spark, d), "prcp_mm", "log_trips", [], by="borough")


def event_panel(spark, d):
    h = events.hypothesis(spark, d).join(T("weather")(spark, d), "date", "left").where("venue_id <> 'v5'")
    return h.withColumns({"key": F.xxhash64("date", "venue_id", "title"), "dow": F.weekday("date"), "month": F.month("date"), "weekend": X.flag_int(F.dayofweek("date").isin(1, 7)),
                          "premium": X.flag_int(F.col("price_tier") >= 4), "far_metro": X.flag_int(F.coalesce("dist_m", F.lit(999.0)) > 300)})


cte("event_panel", """SELECT h.*, w.prcp_mm, w.tmax_c, month(h.date) AS month
FROM m_event_hyp h LEFT JOIN weather w ON w.date = h.date WHERE h.venue_id <> 'v5'""")
EVENT_MODELS = (("log_dist_m", ["price_tier", "prcp_mm", "tmax_c"]), ("price_tier", ["log_dist_m", "prcp_mm", "tmax_c"]))
_KINDS = ("event_type", "month")


def event_effect_sql(treatment: str, adjust: list[str]) -> str:
    clustered = regress.table(regress.least_squares("SELECT * FROM event_panel", "post_pu_lift_pct", [treatment, *adjust], _KINDS, cov="cluster", cluster="venue_id"), [treatment])
    sub = regress.least_squares(f"SELECT * FROM event_panel WHERE {draw_sql(43, 'date')} / 4294967296.0 < 0.8", "post_pu_lift_pct", [treatment, *adjust], _KINDS)
    return effect_sql("SELECT * FROM event_panel", treatment, "post_pu_lift_pct", adjust, _KINDS, model=f"'{treatment}'", subset80=regress.coefficient(sub, treatment),
                      cluster_p=f"(SELECT {tails.normal_two_sided('stat')} FROM ({clustered}) c)")


@register("event_effects", ATE + " subset80:real cluster_p:real", " UNION ALL ".join(f"SELECT * FROM ({event_effect_sql(*m)}) one" for m in EVENT_MODELS))
def q_event_effects(spark, d):
    p = lineage.cut(event_panel(spark, d))
    out = None
    for t, adj in EVENT_MODELS:
        one = E.adjusted_effect(p, t, "post_pu_lift_pct", adj, ["event_type", "month"], key="date", refute=("subset",), cluster="venue_id", label=t)
        out = one if out is None else out.unionByName(one)
    return out


@register("event_effects_by_venue", "model:str n naive_r:real ate:real", """
SELECT 'price_tier' AS model, count(*) AS n, corr(price_tier, post_pu_lift) AS naive_r, regr_slope(post_pu_lift, price_tier) AS ate FROM m_hyp_venue""")
def q_venue_effect(spark, d):
    return E.adjusted_effect(events.q_hyp_venue(spark, d), "price_tier", "post_pu_lift", [], label="price_tier")


cte("policy", """SELECT borough, avg(trips) FILTER (WHERE year(date) = 1996) AS trips_0, avg(trips) FILTER (WHERE year(date) = 1997) AS trips_1,
  avg(fare_per_mile) FILTER (WHERE year(date) = 1996) AS fare_0, avg(fare_per_mile) FILTER (WHERE year(date) = 1997) AS fare_1
FROM m_daily_by_borough WHERE month(date) BETWEEN 1 AND 6 AND year(date) IN (1996, 1997) GROUP BY 1""")
cte("policy_yoy", "SELECT *, 100 * (trips_1 / trips_0 - 1) AS trips_yoy_pct, 100 * (fare_1 / fare_0 - 1) AS fare_yoy_pct FROM policy")


def policy(spark, d):
    return E.before_after(suite.by_borough(spark, d), "borough", 1996, 1997)


@register("policy_before_after", "borough:str trips_0:real trips_1:real fare_0:real fare_1:real trips_yoy_pct:real fare_yoy_pct:real", "SELECT * FROM policy_yoy")
def q_policy(spark, d):
    return policy(spark, d)


@register("policy_did_elasticity", "did_trips_pp:real did_fare_pp:real did_log_trips:real did_log_fare:real elasticity:real", """
SELECT t.trips_yoy_pct - c.trips_yoy_pct AS did_trips_pp, t.fare_yoy_pct - c.fare_yoy_pct AS did_fare_pp, ln(t.trips_1 / t.trips_0) - ln(c.trips_1 / c.trips_0) AS did_log_trips,
  ln(t.fare_1 / t.fare_0) - ln(c.fare_1 / c.fare_0) AS did_log_fare, (ln(t.trips_1 / t.trips_0) - ln(c.trips_1 / c.trips_0)) / (ln(t.fare_1 / t.fare_0) - ln(c.fare_1 / c.fare_0)) AS elasticity
FROM policy_yoy t CROSS JOIN policy_yoy c WHERE t.borough = 'AMERICA' AND c.borough = 'ASIA'""")
def q_did(spark, d):
    return E.did_elasticity(policy(spark, d), "borough", "AMERICA", "ASIA")


@register("panel_yoy_bars", "borough:str trips_yoy_pct:real fare_yoy_pct:real", "SELECT borough, trips_yoy_pct, fare_yoy_pct FROM policy_yoy WHERE borough IN ('ASIA', 'AMERICA')")
def q_bars(spark, d):
    return P.panel("yoy_bars", {"policy_yoy": policy(spark, d)}, boroughs=["ASIA", "AMERICA"])


@register("zone_entries_monthly", "month:date mean:real", "SELECT CAST(date_trunc('month', date) AS DATE) AS month, avg(crz_entries) AS mean FROM transit GROUP BY 1")
def q_entries(spark, d):
    return E.monthly_mean(T("transit")(spark, d), "date", "crz_entries")


@register("mediation_rain_fare", "treatment:str mediator:str outcome:str total_effect:real direct:real indirect:real n", """
SELECT 'prcp_mm' AS treatment, 'fare_per_mile' AS mediator, 'trips' AS outcome, sty / stt AS total_effect, (sty * smm - smy * stm) / (stt * smm - stm * stm) AS direct,
  (smy * stt - sty * stm) / (stt * smm - stm * stm) * (stm / stt) AS indirect, n FROM (SELECT count(*) AS n, regr_sxx(trips, prcp_mm) AS stt, regr_sxx(trips, fare_per_mile) AS smm,
  regr_sxy(fare_per_mile, prcp_mm) AS stm, regr_sxy(trips, prcp_mm) AS sty, regr_sxy(trips, fare_per_mile) AS smy FROM city_days) q""")
def q_mediation(spark, d):
    return E.mediation(city_days(spark, d), "prcp_mm", "fare_per_mile", "trips", [])


def coefficient_sql(src: str, y: str, x: list[str], categories: tuple[str, ...], term: str) -> str:
    return regress.coefficient(regress.least_squares(src, y, x, categories), term)


MEDIATION_X = ["tmax_c", "awnd_ms"]
MEDIATION_ROWS = "SELECT * FROM city_calendar WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in ["prcp_mm", "fare_per_mile", "trips", *MEDIATION_X])
_FULL, _WEEK = ["prcp_mm", "fare_per_mile", *MEDIATION_X], ("weekday", "month")


@register("mediation_rain_fare_adjusted", "treatment:str mediator:str outcome:str total_effect:real direct:real indirect:real n", f"""
SELECT 'prcp_mm' AS treatment, 'fare_per_mile' AS mediator, 'trips' AS outcome, {coefficient_sql(MEDIATION_ROWS, "trips", ["prcp_mm", *MEDIATION_X], _WEEK, "prcp_mm")} AS total_effect,
  {coefficient_sql(MEDIATION_ROWS, "trips", _FULL, _WEEK, "prcp_mm")} AS direct, {coefficient_sql(MEDIATION_ROWS, "trips", _FULL, _WEEK, "fare_per_mile")}
  * {coefficient_sql(MEDIATION_ROWS, "fare_per_mile", ["prcp_mm", *MEDIATION_X], _WEEK, "prcp_mm")} AS indirect, (SELECT count(*) FROM ({MEDIATION_ROWS}) r) AS n""")
def q_mediation_adj(spark, d):
    return E.mediation(city_days(spark, d), "prcp_mm", "fare_per_mile", "trips", MEDIATION_X, ["weekday", "month"])


SUBWAY_ROWS = "SELECT * FROM city_calendar WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in ["prcp_mm", "log_subway", "log_trips", *WEATHER])
_TO_SUBWAY = tails.with_p(regress.table(regress.least_squares(SUBWAY_ROWS, "log_subway", ["prcp_mm", *WEATHER], CAL, cov="HC3"), ["prcp_mm"]), ROBUST_P)
_SUBWAY_X = ["prcp_mm", "log_subway", *WEATHER]


@register("transit_substitution", "n to_mediator:real to_mediator_p:real without_mediator:real with_mediator:real mediator_coef:real shrinkage_pct:real", f"""
SELECT *, 100 * (1 - with_mediator / without_mediator) AS shrinkage_pct FROM (SELECT n, coef AS to_mediator, p_value AS to_mediator_p, {rain_again(SUBWAY_ROWS)} AS without_mediator,
  {coefficient_sql(SUBWAY_ROWS, "log_trips", _SUBWAY_X, CAL, "prcp_mm")} AS with_mediator, {coefficient_sql(SUBWAY_ROWS, "log_trips", _SUBWAY_X, CAL, "log_subway")} AS mediator_coef
FROM ({_TO_SUBWAY}) m) s""")
def q_transit(spark, d):
    return E.mediator_shrinkage(city_days(spark, d), "prcp_mm", "log_subway", "log_trips", WEATHER, CAL)


def panel(spark, d):
    return suite.zone_year_panel(spark, d)


cte("zone_panel", """SELECT zone, year(pickup_datetime) AS year, count(*) FILTER (WHERE taxi_type = 'yellow') AS yellow, count(*) FILTER (WHERE taxi_type = 'green') AS green,
  count(*) FILTER (WHERE taxi_type = 'fhvhv') AS fhvhv, 1.0 * count(*) FILTER (WHERE taxi_type = 'fhvhv') / count(*) AS fhvhv_share,
  1.0 * count(*) FILTER (WHERE taxi_type = 'fhvhv') / nullif(count(*) FILTER (WHERE taxi_type IN ('fhvhv', 'green')), 0) AS pair_share,
  ln(greatest(count(*) FILTER (WHERE taxi_type = 'yellow'), 1)) AS log_yellow, ln(greatest(count(*) FILTER (WHERE taxi_type = 'green'), 1)) AS log_green
FROM all_trips WHERE zone IS NOT NULL GROUP BY 1, 2""")


@register("effect_share_naive", OLS, HC3_1.format(term="fhvhv_share", src="SELECT fhvhv_share AS x, log_yellow AS y FROM zone_panel"))
def q_share_naive(spark, d):
    return L.ols(panel(spark, d), "log_yellow", ["fhvhv_share"], cov="HC3", terms=["fhvhv_share"])


DM = """SELECT x1 - avg(x1) OVER (PARTITION BY year) AS x, y1 - avg(y1) OVER (PARTITION BY year) AS y FROM (
  SELECT year, {x} - avg({x}) OVER (PARTITION BY zone) AS x1, {y} - avg({y}) OVER (PARTITION BY zone) AS y1 FROM zone_panel WHERE {x} IS NOT NULL) q"""


@register("effect_share_within_hc3", OLS, HC3_1.format(term="fhvhv_share_of_pair_dm", src=DM.format(x="pair_share", y="log_green")))
def q_within(spark, d):
    return E.within_effect(panel(spark, d), "zone", "year", "fhvhv_share_of_pair", "log_green")


KEYED_DM = DM.replace("AS x, y1", "AS x, zone, year, y1").replace("SELECT year,", "SELECT zone, year,").format(x="pair_share", y="log_green")


@register("effect_share_within_placebo", "term:str coef:real se:real n", OLS_1.format(term="fhvhv_share_of_pair_dm", src=moved_sql(KEYED_DM, "zone * 10000 + year", "x")))
def q_placebo(spark, d):
    p = lineage.cut(panel(spark, d).select("zone", "year", "log_green", "fhvhv_share_of_pair").dropna())
    dm = W.demean(p, ["fhvhv_share_of_pair", "log_green"], [["zone"], ["year"]]).withColumn("key", F.col("zone").cast("long") * 10000 + F.col("year"))
    return L.ols(E._shuffle_column(dm, "key", "fhvhv_share_of_pair_dm", 42), "log_green_dm", ["fhvhv_share_of_pair_dm"], terms=["fhvhv_share_of_pair_dm"])


#: Unit dummies are taken out by subtracting unit means from every column, those of the periods stay as columns; years without rows and the one
#: that the others determine are passed over.
_YEARS = [f"year_{y}" for y in range(1992, 2005)]
_PANEL = "SELECT zone, " + ", ".join([f"{c} - avg({c}) OVER (PARTITION BY zone) AS {c}" for c in ("fhvhv_share", "log_yellow")] + [
    f"(CASE WHEN year = {c[5:]} THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN year = {c[5:]} THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY zone) AS {c}" for c in _YEARS]) + " FROM zone_panel"


@register("effect_share_fixed_effects", "n units times ate:real se:real p_value:real", tails.with_p(f"""
SELECT n, units, times, coef AS ate, sqrt(bread * ssr / (n - units - times)) AS se, coef / sqrt(bread * ssr / (n - units - times)) AS t, CAST(n - units - times AS DOUBLE) AS df
FROM ({regress.least_squares(_PANEL, "log_yellow", ["fhvhv_share", *_YEARS], intercept=False)}) f CROSS JOIN (SELECT count(DISTINCT zone) AS units, count(DISTINCT year) AS times FROM zone_panel) c
WHERE term = 'fhvhv_share'""", tails.t_two_sided("t", "df")))
def q_fe(spark, d):
    return E.dummy_fixed_effects(panel(spark, d), "zone", "year", "fhvhv_share", "log_yellow")


def cross(spark, d):
    return E.recovery_cross_section(panel(spark, d), T("zones")(spark, d), 1996, 1998, min_base=3)


cte("cross_section", """SELECT a.zone, z.borough, a.pair_share AS share_0, 1.0 * b.green / a.green AS green_recovery, 1.0 * b.yellow / greatest(a.yellow, 1) AS yellow_recovery,
  ln(greatest(b.fhvhv, 1)) - ln(greatest(a.fhvhv, 1)) AS fhvhv_growth FROM zone_panel a JOIN zone_panel b ON a.zone = b.zone AND a.year = 1996 AND b.year = 1998 JOIN zones z ON z.LocationID = a.zone WHERE a.green >= 3""")


@register("recovery_cross_section", "zone borough:str green_recovery:real yellow_recovery:real fhvhv_growth:real", "SELECT * FROM cross_section")
def q_cross(spark, d):
    return cross(spark, d)


for _x, _name, _sql in (("fhvhv_share_of_pair_0", "share", "share_0"), ("fhvhv_growth", "growth", "fhvhv_growth")):
    register(f"ols_recovery_{_name}_borough", "term:str coef:real n", f"""SELECT '{_x}' AS term, regr_slope(y, x) AS coef, count(*) AS n FROM (
      SELECT green_recovery - avg(green_recovery) OVER (PARTITION BY borough) AS y, {_sql} - avg({_sql}) OVER (PARTITION BY borough) AS x FROM cross_section) q""")(
        lambda spark, d, x=_x: L.ols(cross(spark, d), "green_recovery", [x], ["borough"], cov="HC3", terms=[x]))


@register("yoy_by_type", "taxi_type:str year trips yoy_pct:real", """
SELECT *, 100 * (1.0 * trips / lag(trips) OVER (PARTITION BY taxi_type ORDER BY year) - 1) AS yoy_pct FROM (
  SELECT taxi_type, year(month) AS year, sum(trips) AS trips FROM m_monthly_by_type GROUP BY 1, 2) q""")
def q_yoy(spark, d):
    y = suite.monthly_by_type(spark, d).groupBy("taxi_type", F.year("month").alias("year")).agg(F.sum("trips").alias("trips"))
    return W.yoy(y, "trips", ["taxi_type"], "year")


def tiers(spark, d):
    z = T("zones")(spark, d).select("LocationID", "borough").join(events.distances(spark, d), "LocationID")
    return W.threshold_tiers(lineage.cut(z), "dist_m", ["near", "mid", "far"])


cte("zone_tiers", """SELECT LocationID, borough, dist_m, CASE WHEN dist_m <= (SELECT quantile_cont(dist_m, 1.0 / 3) FROM zone_distance) THEN 'near'
  WHEN dist_m <= (SELECT quantile_cont(dist_m, 2.0 / 3) FROM zone_distance) THEN 'mid' ELSE 'far' END AS tier FROM zone_distance d JOIN zones z USING (LocationID)""")


@register("zone_distance_tiers", "LocationID dist_m:real tier:str", "SELECT * FROM zone_tiers")
def q_tiers(spark, d):
    return tiers(spark, d)


cte("tier_days", """SELECT t.tier, CAST(f.pickup_datetime AS DATE) AS date, count(*) AS trips FROM fhvhv_trips f JOIN zone_tiers t ON t.LocationID = f.PULocationID GROUP BY 1, 2""")


def tier_days(spark, d):
    v = M.day_zone_volume(T("fhvhv_trips")(spark, d))
    return v.join(tiers(spark, d).select(F.col("LocationID").alias("zone"), "tier"), "zone").groupBy("tier", "date").agg(F.sum("trips").alias("trips"))


@register("tier_daily_trips", "tier:str date:date trips", "SELECT * FROM tier_days")
def q_tier_days(spark, d):
    return tier_days(spark, d)


cte("tier_calendar", """SELECT t.tier, ln(greatest(t.trips, 1)) AS log_trips, w.prcp_mm, w.tmax_c, w.awnd_ms, w.snow_mm, isodow(t.date) AS weekday, month(t.date) AS month, year(t.date) AS year
FROM tier_days t JOIN weather w ON w.date = t.date""")


@register("effect_rain_by_distance_tier", "tier:str coef:real se:real p_value:real pct_per_10mm:real n", "SELECT *, g AS tier, 100 * (exp(10 * coef) - 1) AS pct_per_10mm FROM (" + tails.with_p(
    regress.table(regress.least_squares("SELECT * FROM tier_calendar", "log_trips", ["prcp_mm", *WEATHER], CAL, by="tier", cov="HC3"), ["prcp_mm"]), ROBUST_P) + ") tiers")
def q_rain_tier(spark, d):
    p = calendar(tier_days(spark, d).join(T("weather")(spark, d), "date")).withColumn("log_trips", X.log_clip1("trips"))
    return L.ols(p, "log_trips", ["prcp_mm", *WEATHER], CAL, cov="HC3", by="tier", terms=["prcp_mm"]).withColumn("pct_per_10mm", X.pct_effect("coef"))


@register("ols_zone_trips_distance", "outcome:str term:str coef:real n", """
SELECT o AS outcome, 'log_dist' AS term, regr_slope(y, x) AS coef, count(*) AS n FROM (SELECT o, y - avg(y) OVER (PARTITION BY o, borough) AS y, x - avg(x) OVER (PARTITION BY o, borough) AS x FROM (
  SELECT 'log_trips' AS o, ln(annual_trips) AS y, ln(1 + dist_m) AS x, borough FROM m_zone_access UNION ALL SELECT 'fare_per_mile', fare_per_mile, ln(1 + dist_m), borough FROM m_zone_access
  UNION ALL SELECT 'avg_trip_miles', avg_trip_miles, ln(1 + dist_m), borough FROM m_zone_access) a) b GROUP BY 1""")
def q_zone_distance(spark, d):
    z = lineage.cut(events.q_access(spark, d).withColumns({"log_trips": F.log(F.col("annual_trips").cast("double")), "log_dist": F.log1p("dist_m")}))
    out = None
    for y in ("log_trips", "fare_per_mile", "avg_trip_miles"):
        one = L.ols(z, y, ["log_dist"], ["borough"], cov="HC3", terms=["log_dist"]).withColumn("outcome", F.lit(y))
        out = one if out is None else out.unionByName(one)
    return out


# --- forecasting -------------------------------------------------------------------------------------------------

def fc_features(spark, d):
    daily = T("fhvhv_trips")(spark, d).groupBy(X.day_of("pickup_datetime").alias("date")).agg(F.count(F.lit(1)).alias("trips"))
    return FC.features(daily, T("weather")(spark, d))


cte("fc_rows", """SELECT * FROM (SELECT q.date, q.trips, lag(trips, 1) OVER w AS lag1, lag(trips, 7) OVER w AS lag7,
    CASE WHEN count(*) OVER r = 7 THEN avg(trips) OVER r END AS roll7, p.prcp_mm, p.tmax_c FROM (SELECT CAST(pickup_datetime AS DATE) AS date, count(*) AS trips FROM fhvhv_trips GROUP BY 1) q
  LEFT JOIN weather p ON p.date = q.date WINDOW w AS (ORDER BY q.date), r AS (ORDER BY q.date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)) z
WHERE lag1 IS NOT NULL AND lag7 IS NOT NULL AND roll7 IS NOT NULL AND prcp_mm IS NOT NULL AND tmax_c IS NOT NULL""")


@register("forecast_features", "date:date trips lag1 lag7 roll7:real prcp_mm:real tmax_c:real", "SELECT * FROM fc_rows")
def q_features(spark, d):
    return fc_features(spark, d)


@register("forecast_baseline_scores", "model:str mae:real rmse:real mape_pct:real n", " UNION ALL ".join(
    f"SELECT '{m}' AS model, avg(abs(trips - {c})) AS mae, sqrt(avg(pow(trips - {c}, 2))) AS rmse, 100 * avg(abs(trips - {c}) / trips) AS mape_pct, count(*) AS n FROM fc_rows WHERE date >= DATE '2000-01-01'"
    for m, c in FC.BASELINES.items()))
def q_baselines(spark, d):
    return FC.scores(FC.predict(fc_features(spark, d), "2000-01-01", models=()))


@register("forecast_scores", "model:str mae:real rmse:real mape_pct:real n")
def q_scores(spark, d):
    return FC.scores(FC.predict(fc_features(spark, d), "2000-01-01"))


# --- clustering --------------------------------------------------------------------------------------------------

@register("zone_demand_profiles", "zone " + " ".join(f"{s}:real" for s in K.SLOTS), "SELECT zone, " + ", ".join(
    f"coalesce(sum(n) FILTER (WHERE p = '{s[:2]}' AND h = {s[2:]}) / sum(n) FILTER (WHERE p = '{s[:2]}'), 0) AS {s}" for s in K.SLOTS) + """
FROM (SELECT PULocationID AS zone, CASE WHEN dayofweek(pickup_datetime) IN (0, 6) THEN 'we' ELSE 'wd' END AS p, hour(pickup_datetime) AS h, CAST(count(*) AS DOUBLE) AS n FROM fhvhv_trips
  WHERE year(pickup_datetime) = 1996 GROUP BY 1, 2, 3) q GROUP BY 1""")
def q_profiles(spark, d):
    return K.profiles(M.in_year(T("fhvhv_trips")(spark, d), "pickup_datetime", 1996))


@register("cluster_silhouettes", "k silhouette:real")
def q_silhouette(spark, d):
    return K.silhouettes(K.vectors(K.profiles(T("fhvhv_trips")(spark, d))))


def members(spark, d):
    return K.assign(K.vectors(K.profiles(T("fhvhv_trips")(spark, d))))


@register("zone_clusters", "zone cluster cluster_label:str")
def q_members(spark, d):
    return members(spark, d)


@register("cluster_profiles", "cluster n_zones " + " ".join(f"{s}:real" for s in K.SLOTS))
def q_centroids(spark, d):
    return K.centroids(members(spark, d))


@register("cluster_borough_counts", "cluster_label:str borough:str n_zones")
def q_cluster_borough(spark, d):
    return K.borough_counts(members(spark, d), T("zones")(spark, d))


@register("panel_cluster_sizes", "cluster_label:str n_zones")
def q_cluster_sizes(spark, d):
    m = members(spark, d).join(T("zones")(spark, d).select(F.col("LocationID").alias("zone"), "borough"), "zone", "left")
    return P.panel("cluster_sizes", {"zone_clusters": m}, boroughs=["ASIA", "EUROPE", "AFRICA", "AMERICA"])
