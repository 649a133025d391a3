"""Statistical tests."""

from pyspark.sql import functions as F

from catalog import access, events, shared, suite, tails
from catalog.base import T, cte, register
from tripmarts.functions import trip as X
from tripmarts.operators import clean as C
from tripmarts.operators import hypothesis as Y
from tripmarts.operators import resample as R
from tripmarts.operators.quantile import bin_quantile
from tripmarts.operators.window import demean
from tripmarts.plans import access as A
from tripmarts.plans import overview as O
from tripmarts.plans import shared as S
from tripmarts.plans import suite as M

INC, ORD = X.INCLUSIVE, X.ORDINARY


def wait_fact(spark, d):
    """Waits with their group: every trip citywide, airport trips also at the airport."""
    w = O.wav_wait_fact(C.complete_trips(T("fhvhv_trips")(spark, d)))
    return w.select("provider", "wait_sec", F.explode(X.wait_group("PULocationID")).alias("wait_group"))


cte("m_wait_fact", """SELECT wait_group, provider, w FROM (SELECT 'citywide' AS wait_group, hvfhs_license_num, date_diff('second', request_datetime, pickup_datetime) AS w FROM complete_clean
  UNION ALL SELECT CASE PULocationID WHEN 132 THEN 'jfk' ELSE 'lga' END, hvfhs_license_num, date_diff('second', request_datetime, pickup_datetime) FROM complete_clean WHERE PULocationID IN (132, 138)) q
JOIN (VALUES ('HV0002', 'Juno'), ('HV0003', 'Uber'), ('HV0004', 'Via'), ('HV0005', 'Lyft')) AS p(code, provider) ON p.code = q.hvfhs_license_num""")
cte("m_welch", """SELECT wait_group, count(*) FILTER (WHERE provider = 'Lyft') AS n_a, count(*) FILTER (WHERE provider = 'Uber') AS n_b,
  avg(w) FILTER (WHERE provider = 'Lyft') AS mean_a, avg(w) FILTER (WHERE provider = 'Uber') AS mean_b, var_samp(w) FILTER (WHERE provider = 'Lyft') AS var_a,
  var_samp(w) FILTER (WHERE provider = 'Uber') AS var_b FROM m_wait_fact GROUP BY 1""")


WELCH = """
SELECT wait_group, n_a, n_b, mean_a - mean_b AS diff, (mean_a - mean_b) / sqrt(var_a / n_a + var_b / n_b) AS t,
  pow(var_a / n_a + var_b / n_b, 2) / (pow(var_a / n_a, 2) / (n_a - 1) + pow(var_b / n_b, 2) / (n_b - 1)) AS df,
  (mean_a - mean_b) / sqrt((var_a * (n_a - 1) + var_b * (n_b - 1)) / (n_a + n_b - 2)) AS cohens_d FROM m_welch"""


@register("welch_wait", "wait_group:str n_a n_b diff:real t:real df:real cohens_d:real p_value:sig", tails.with_p(WELCH, tails.t_two_sided("t", "df")))
def q_welch(spark, d):
    return Y.welch(Y.moments(wait_fact(spark, d), "provider", "wait_sec", ["wait_group"]), "provider", "Lyft", "Uber", ["wait_group"])


def _did_cells(spark, d):
    t = C.complete_trips(T("fhvhv_trips")(spark, d)).where(F.col("hvfhs_license_num").isin("HV0003", "HV0005"))
    rush = X.rush_hour(X.dow_sunday0("request_datetime"), F.hour("request_datetime"))
    return t.select((F.col("hvfhs_license_num") == "HV0005").alias("is_lyft"), rush.alias("rush"), X.wait_seconds().alias("wait"),
                    F.when((F.col("trip_miles") >= 2) & (F.col("trip_miles") < 5), F.col("base_passenger_fare") / F.col("trip_miles")).alias("fpm"))


def _did(spark, d, value):
    cells = _did_cells(spark, d).where(F.col(value).isNotNull()).groupBy("is_lyft", "rush").agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))
    return Y.did_means(cells, "is_lyft", "rush")


DID = """SELECT (m11 - m10) AS treated_change, (m01 - m00) AS control_change, (m11 - m10) - (m01 - m00) AS did, sqrt(s) AS se, ((m11 - m10) - (m01 - m00)) / sqrt(s) AS z FROM (
  SELECT max(m) FILTER (WHERE l AND r) AS m11, max(m) FILTER (WHERE l AND NOT r) AS m10, max(m) FILTER (WHERE NOT l AND r) AS m01, max(m) FILTER (WHERE NOT l AND NOT r) AS m00, sum(v / n) AS s FROM (
    SELECT hvfhs_license_num = 'HV0005' AS l, dayofweek(request_datetime) NOT IN (0, 6) AND hour(request_datetime) IN (7, 8, 9, 17, 18, 19) AS r, avg({v}) AS m, var_samp({v}) AS v, count({v}) AS n
    FROM complete_clean WHERE hvfhs_license_num IN ('HV0003', 'HV0005') AND {f} GROUP BY 1, 2) q) w"""
DID_SPEC = "treated_change:real control_change:real did:real se:real z:real p_value:sig"
RUSH_WAIT = tails.with_p(DID.format(v="date_diff('second', request_datetime, pickup_datetime)", f="TRUE"), tails.normal_two_sided("z"))
RUSH_FARE = tails.with_p(DID.format(v="(base_passenger_fare / trip_miles)", f="trip_miles >= 2 AND trip_miles < 5"), tails.normal_two_sided("z"))
register("did_rush_wait", DID_SPEC, RUSH_WAIT)(lambda spark, d: _did(spark, d, "wait"))
register("did_rush_fare_per_mile", DID_SPEC, RUSH_FARE)(lambda spark, d: _did(spark, d, "fpm"))


@register("significance_tests", "hypothesis:str effect:real stat:real p_value:sig", f"""
SELECT 'wait ' || wait_group AS hypothesis, diff AS effect, t AS stat, p_value FROM ({tails.with_p(WELCH, tails.t_two_sided("t", "df"))}) w
UNION ALL SELECT 'rush wait', did, z, p_value FROM ({RUSH_WAIT}) a UNION ALL SELECT 'rush fare per mile', did, z, p_value FROM ({RUSH_FARE}) b""")
def q_significance(spark, d):
    from tripmarts.plans.panels import panel
    return panel("significance", {"significance_tests": significance_table(spark, d)}, table="significance_tests", effect="effect")


def significance_table(spark, d):
    w = q_welch(spark, d).select(F.concat(F.lit("wait "), "wait_group").alias("hypothesis"), F.col("diff").alias("effect"), F.col("t").alias("stat"), "p_value")
    for value, name in (("wait", "rush wait"), ("fpm", "rush fare per mile")):
        w = w.unionByName(_did(spark, d, value).select(F.lit(name).alias("hypothesis"), F.col("did").alias("effect"), F.col("z").alias("stat"), "p_value"))
    return w


CHI = """SELECT total, chi2, dof, sqrt(chi2 / (total * least(nr - 1, nc - 1))) AS cramers_v FROM (
  SELECT sum(n) AS total, sum(pow(n - e, 2) / e) AS chi2, (count(DISTINCT r) - 1) * (count(DISTINCT c) - 1) AS dof, count(DISTINCT r) AS nr, count(DISTINCT c) AS nc FROM (
    SELECT r, c, n, 1.0 * sum(n) OVER (PARTITION BY r) * sum(n) OVER (PARTITION BY c) / sum(n) OVER () AS e FROM (
      SELECT r.r, c.c, coalesce(n, 0) AS n FROM (SELECT DISTINCT r FROM {src} a) r CROSS JOIN (SELECT DISTINCT c FROM {src} b) c
      LEFT JOIN {src} s ON s.r = r.r AND s.c = c.c) f) g) h"""
CHI_SPEC = "total chi2:real dof cramers_v:real p_value:sig"
SH = "(shared_request_flag = 'Y' OR shared_match_flag = 'Y')"
DUR = ("CASE WHEN trip_time < 600 THEN '0-10' WHEN trip_time < 1200 THEN '10-20' WHEN trip_time < 1800 THEN '20-30' "
       "WHEN trip_time < 2700 THEN '30-45' WHEN trip_time < 3600 THEN '45-60' ELSE '60+' END")
cte("chi_duration", f"SELECT {DUR} AS r, {SH} AS c, count(*) AS n FROM shared_clean GROUP BY 1, 2")
cte("chi_hour", f"SELECT hour(request_datetime) AS r, {SH} AS c, count(*) AS n FROM shared_clean GROUP BY 1, 2")
cte("slot_counts", """SELECT segment AS r, dow * 24 + hour AS c, dow, hour, n FROM (
  SELECT 'accessibility' AS segment, dow, hour, sum(accessibility_trips) AS n FROM m_cells GROUP BY 2, 3 UNION ALL SELECT 'ordinary', dow, hour, sum(ordinary_trips) FROM m_cells GROUP BY 2, 3) q""")


def _shared_long(df, key):
    return df.select(key, F.col("shared_trips").alias("shared"), (F.col("total_trips") - F.col("shared_trips")).alias("other")).unpivot([key], ["shared", "other"], "kind", "n").where("n > 0")


@register("chi2_shared_duration", CHI_SPEC, tails.with_p(CHI.format(src="chi_duration"), tails.chi2_sf("chi2", "dof")))
def q_chi_dur(spark, d):
    return Y.chi_square(_shared_long(S.by_duration(shared.clean(spark, d)), "duration_group"), "duration_group", "kind")


@register("chi2_shared_hour", CHI_SPEC, tails.with_p(CHI.format(src="chi_hour"), tails.chi2_sf("chi2", "dof")))
def q_chi_hour(spark, d):
    return Y.chi_square(_shared_long(S.by_hour(shared.clean(spark, d)), "hour"), "hour", "kind")


def slots(spark, d):
    g = access.cells(spark, d).groupBy("dow", "hour").agg(F.sum("accessibility_trips").alias("accessibility"), F.sum("ordinary_trips").alias("ordinary"))
    return g.unpivot(["dow", "hour"], ["accessibility", "ordinary"], "segment", "n")


@register("chi2_weekly_slots", CHI_SPEC, tails.with_p(CHI.format(src="slot_counts"), tails.chi2_sf("chi2", "dof")))
def q_chi_slots(spark, d):
    return Y.chi_square(slots(spark, d).withColumn("slot", F.col("dow") * 24 + F.col("hour")), "segment", "slot")


cte("slot_profile", """SELECT dow, hour, 100.0 * a / sum(a) OVER () AS share_a_pct, 100.0 * b / sum(b) OVER () AS share_b_pct, 100.0 * a / sum(a) OVER () - 100.0 * b / sum(b) OVER () AS difference_pp,
  (a - (a + b) * sum(a) OVER () / sum(a + b) OVER ()) / sqrt((a + b) * sum(a) OVER () / sum(a + b) OVER ()) AS residual_a
FROM (SELECT dow, hour, CAST(sum(accessibility_trips) AS DOUBLE) AS a, CAST(sum(ordinary_trips) AS DOUBLE) AS b FROM m_cells GROUP BY 1, 2) q""")


@register("slot_profile_difference", "dow hour share_a_pct:real share_b_pct:real difference_pp:real residual_a:real", "SELECT * FROM slot_profile")
def q_profile(spark, d):
    return Y.profile_difference(slots(spark, d), "segment", ["dow", "hour"], "accessibility", "ordinary")


@register("extreme_slots", "side:str dow hour difference_pp:real", """
SELECT * FROM (SELECT 'more often in a' AS side, dow, hour, difference_pp FROM slot_profile ORDER BY difference_pp DESC, dow, hour LIMIT 6) a
UNION ALL SELECT * FROM (SELECT 'more often in b' AS side, dow, hour, difference_pp FROM slot_profile ORDER BY difference_pp, dow, hour LIMIT 6) b""")
def q_extreme(spark, d):
    return Y.extreme_slots(q_profile(spark, d), ["dow", "hour"])


@register("js_distance_slots", "js_distance:real", """
SELECT sqrt((sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END)) / 2) AS js_distance
FROM (SELECT share_a_pct / 100 AS p, share_b_pct / 100 AS q FROM slot_profile) s""")
def q_js(spark, d):
    return Y.js_distance(slots(spark, d), "segment", ["dow", "hour"], "accessibility", "ordinary")


PROP = """SELECT pa AS share_a, pb AS share_b, pa - pb AS diff, (pa - pb) / sqrt(pp * (1 - pp) * (1 / na + 1 / nb)) AS z,
  pa - pb - 1.96 * sqrt(pa * (1 - pa) / na + pb * (1 - pb) / nb) AS ci_low, pa - pb + 1.96 * sqrt(pa * (1 - pa) / na + pb * (1 - pb) / nb) AS ci_high,
  pa / pb - 1 AS relative_lift, 2 * (asin(sqrt(pa)) - asin(sqrt(pb))) AS cohens_h FROM (
  SELECT na, nb, xa / na AS pa, xb / nb AS pb, (xa + xb) / (na + nb) AS pp FROM (SELECT CAST(sum(x) FILTER (WHERE g) AS DOUBLE) AS xa, CAST(sum(n) FILTER (WHERE g) AS DOUBLE) AS na,
    CAST(sum(x) FILTER (WHERE NOT g) AS DOUBLE) AS xb, CAST(sum(n) FILTER (WHERE NOT g) AS DOUBLE) AS nb FROM {src} s) q) w"""
PROP_SPEC = "share_a:real share_b:real diff:real z:real ci_low:real ci_high:real relative_lift:real cohens_h:real p_two_sided:sig p_larger:sig"


@register("proportions_shared_peak", PROP_SPEC, tails.with_p(PROP.format(src=f"""(SELECT (dayofweek(request_datetime) NOT IN (0, 6) AND hour(request_datetime) IN (7, 8, 9, 17, 18, 19)) OR
  (dayofweek(request_datetime) IN (0, 6) AND hour(request_datetime) IN (0, 1, 2, 10, 11, 12, 13, 14, 15)) AS g, CASE WHEN {SH} THEN 1 ELSE 0 END AS x, 1 AS n FROM shared_clean)"""), tails.normal_two_sided("z"), p_two_sided=tails.normal_two_sided("z"), p_larger=tails.normal_sf("z")))
def q_prop_shared(spark, d):
    return Y.two_proportions(S.by_peak(shared.clean(spark, d)), "is_peak", "Peak", "Non-peak", "shared_trips", "total_trips")


@register("proportions_wav_peak", PROP_SPEC, tails.with_p(PROP.format(src="(SELECT high_demand AS g, ordinary_wav_trips AS x, ordinary_trips AS n FROM m_cells_peak)"), tails.normal_two_sided("z"), p_two_sided=tails.normal_two_sided("z"), p_larger=tails.normal_sf("z")))
def q_prop_wav(spark, d):
    return Y.two_proportions(A.peak_counts(access.cells(spark, d)), "high_demand", True, False, "ordinary_wav_trips", "ordinary_trips")


cte("zone_rates", """SELECT PULocationID, count(*) AS total_trips, 100.0 * count(*) FILTER (WHERE shared_match_flag = 'Y') / count(*) FILTER (WHERE shared_request_flag = 'Y') AS match_rate
FROM shared_clean s JOIN zones z ON s.PULocationID = z.LocationID WHERE hvfhs_license_num = 'HV0003' GROUP BY 1 HAVING count(*) FILTER (WHERE shared_request_flag = 'Y') >= 5""")


@register("spearman_zone_match", "n r:real p_value:sig", tails.with_p("""
SELECT count(*) AS n, corr(rx, ry) AS r FROM (SELECT rank() OVER (ORDER BY total_trips) + (count(*) OVER (PARTITION BY total_trips) - 1) / 2.0 AS rx,
  rank() OVER (ORDER BY match_rate) + (count(*) OVER (PARTITION BY match_rate) - 1) / 2.0 AS ry FROM zone_rates) q""", tails.OF_R))
def q_spearman(spark, d):
    return Y.spearman(shared.zone_summary(spark, d), "total_trips", "match_rate")


for _c in ("price_tier", "dist_m"):
    register(f"spearman_event_{_c}", "n r:real p_value:sig", tails.with_p(f"""
SELECT count(*) AS n, corr(rx, ry) AS r FROM (SELECT rank() OVER (ORDER BY {_c}) + (count(*) OVER (PARTITION BY {_c}) - 1) / 2.0 AS rx,
  rank() OVER (ORDER BY k) + (count(*) OVER (PARTITION BY k) - 1) / 2.0 AS ry FROM (SELECT {_c}, post_pu_lift_pct AS k FROM m_event_hyp WHERE dist_m IS NOT NULL) s) q""", tails.OF_R))(
        lambda spark, d, c=_c: Y.spearman(events.hypothesis(spark, d).where("dist_m is not null"), c, "post_pu_lift_pct"))


def hist(spark, d):
    return A.wait_hist_daily(access.core(spark, d))


@register("wait_hist_quantiles", "segment:str n p50:real p95:real p99:real", """
SELECT segment, max(total) AS n, min(CASE WHEN cum >= .5 * total THEN b END) AS p50, min(CASE WHEN cum >= .95 * total THEN b END) AS p95, min(CASE WHEN cum >= .99 * total THEN b END) AS p99
FROM (SELECT segment, b, sum(n) OVER (PARTITION BY segment ORDER BY b) AS cum, sum(n) OVER (PARTITION BY segment) AS total FROM (
  SELECT segment, wait_bin_min AS b, sum(trips) AS n FROM m_wait_hist GROUP BY 1, 2) q) w GROUP BY 1""")
def q_hist_quantiles(spark, d):
    h = hist(spark, d).groupBy("segment", "wait_bin_min").agg(F.sum("trips").alias("trips"))
    return bin_quantile(h, ["segment"], "wait_bin_min", "trips", {"p50": .5, "p95": .95, "p99": .99})


@register("wait_hist_cdf", "segment:str wait_bin_min:real n cdf:real", """
SELECT segment, wait_bin_min, n, 1.0 * sum(n) OVER (PARTITION BY segment ORDER BY wait_bin_min) / sum(n) OVER (PARTITION BY segment) AS cdf FROM (
  SELECT segment, wait_bin_min, sum(trips) AS n FROM m_wait_hist GROUP BY 1, 2) q""")
def q_cdf(spark, d):
    return Y.histogram_cdf(hist(spark, d), "segment", "wait_bin_min", "trips")


@register("mann_whitney_hist", "n_a:real n_b:real u:real z:real p_superiority:real rank_biserial:real p_value:sig", tails.with_p("""
SELECT n_a, n_b, u, (u - n_a * n_b / 2 - 0.5) / sqrt(n_a * n_b / 12 * (n_a + n_b + 1 - ties / ((n_a + n_b) * (n_a + n_b - 1)))) AS z, u / (n_a * n_b) AS p_superiority, 2 * u / (n_a * n_b) - 1 AS rank_biserial
FROM (SELECT sum(a) AS n_a, sum(b) AS n_b, sum(a * (less + 0.5 * b)) AS u, sum(pow(a + b, 3) - (a + b)) AS ties FROM (
  SELECT a, b, coalesce(sum(b) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS less FROM (
    SELECT wait_bin_min AS bin, CAST(coalesce(sum(trips) FILTER (WHERE segment = 'Инклюзивные'), 0) AS DOUBLE) AS a, CAST(coalesce(sum(trips) FILTER (WHERE segment = 'Обычные'), 0) AS DOUBLE) AS b
    FROM m_wait_hist GROUP BY 1) q) w) s""", tails.normal_sf("z")))
def q_mw(spark, d):
    return Y.mann_whitney(hist(spark, d), "segment", INC, ORD, "wait_bin_min", "trips")


DRAWS = """SELECT rep, CAST('0x' || substr(md5(CAST(rep AS VARCHAR) || '-' || CAST(i AS VARCHAR)), 1, 8) AS BIGINT) % n AS pos
FROM (SELECT unnest(range(0, {reps})) AS rep) r CROSS JOIN (SELECT unnest(range(0, (SELECT count(*) FROM {units}))) AS i) s CROSS JOIN (SELECT count(*) AS n FROM {units}) c"""
cte("boot_days", """SELECT *, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT date, sum(ordinary_wav_trips) FILTER (WHERE high_demand) AS xa, sum(ordinary_trips) FILTER (WHERE high_demand) AS na,
  sum(ordinary_wav_trips) FILTER (WHERE NOT high_demand) AS xb, sum(ordinary_trips) FILTER (WHERE NOT high_demand) AS nb FROM m_cells_peak GROUP BY 1) q WHERE na IS NOT NULL AND nb IS NOT NULL""")


@register("bootstrap_share_difference", "diff_low:real diff_high:real", f"""
SELECT quantile_cont(dd, .025) AS diff_low, quantile_cont(dd, .975) AS diff_high FROM (SELECT rep, 1.0 * sum(xa) / sum(na) - 1.0 * sum(xb) / sum(nb) AS dd
FROM ({DRAWS.format(reps=2000, units='boot_days')}) x JOIN boot_days b ON b.pos = x.pos GROUP BY 1) q""")
def q_boot(spark, d):
    return R.bootstrap_share_difference(A.peak_daily(access.cells(spark, d)), "date", "high_demand", True, False, "ordinary_wav_trips", "ordinary_trips")


cte("hist_days", "SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM m_wait_hist) q")


@register("bootstrap_wait_quantiles", "p50_low:real p50_high:real p95_low:real p95_high:real", f"""
SELECT quantile_cont(m, .025) AS p50_low, quantile_cont(m, .975) AS p50_high, quantile_cont(p, .025) AS p95_low, quantile_cont(p, .975) AS p95_high FROM (
  SELECT rep, max(m) FILTER (WHERE segment = 'Инклюзивные') - max(m) FILTER (WHERE segment = 'Обычные') AS m, max(p) FILTER (WHERE segment = 'Инклюзивные') - max(p) FILTER (WHERE segment = 'Обычные') AS p FROM (
    SELECT rep, segment, min(CASE WHEN cum >= .5 * total THEN b END) AS m, min(CASE WHEN cum >= .95 * total THEN b END) AS p FROM (
      SELECT rep, segment, b, sum(n) OVER (PARTITION BY rep, segment ORDER BY b) AS cum, sum(n) OVER (PARTITION BY rep, segment) AS total FROM (
        SELECT rep, segment, wait_bin_min AS b, sum(trips) AS n FROM ({DRAWS.format(reps=2000, units='hist_days')}) x JOIN hist_days u ON u.pos = x.pos JOIN m_wait_hist h ON h.date = u.date GROUP BY 1, 2, 3) a) c
    GROUP BY 1, 2) e GROUP BY 1) f""")
def q_boot_q(spark, d):
    return R.bootstrap_quantile_difference(hist(spark, d), "date", "segment", INC, ORD, "wait_bin_min", "trips", {"p50": .5, "p95": .95})


def weather_days(spark, d):
    """Daily counts of two families with weekday anomalies and weather."""
    days = M.daily_families(suite.all_trips(spark, d), T("weather")(spark, d), ["yellow", "green", "fhvhv"])
    days = days.withColumns({"taxi": F.col("yellow") + F.col("green"), "weekday": F.dayofweek("date")})
    return demean(days, ["taxi", "fhvhv"], [["weekday"]], "_anom")


cte("weather_days", """SELECT c.date, taxi, fhvhv, taxi - avg(taxi) OVER (PARTITION BY dayofweek(c.date)) AS taxi_anom, fhvhv - avg(fhvhv) OVER (PARTITION BY dayofweek(c.date)) AS fhvhv_anom,
  w.prcp_mm, w.snow_mm, w.tmax_c, w.awnd_ms, row_number() OVER (ORDER BY c.date) - 1 AS pos FROM (SELECT CAST(pickup_datetime AS DATE) AS date, count(*) FILTER (WHERE taxi_type IN ('yellow', 'green')) AS taxi,
  count(*) FILTER (WHERE taxi_type = 'fhvhv') AS fhvhv FROM all_trips GROUP BY 1) c JOIN weather w ON w.date = c.date""")


@register("weekday_anomalies", "date:date taxi_anom:real fhvhv_anom:real", "SELECT * FROM weather_days")
def q_anom(spark, d):
    return weather_days(spark, d)


@register("pearson_weather", "n r:real p_value:sig", tails.with_p("SELECT count(*) AS n, corr(taxi_anom, tmax_c) AS r FROM weather_days", tails.OF_R))
def q_pearson(spark, d):
    return Y.pearson(weather_days(spark, d), "taxi_anom", "tmax_c")


SHUF = f"""SELECT rep, pos, row_number() OVER (PARTITION BY rep ORDER BY (b * b + a * 12345) % {R.PRIME}, pos) - 1 AS place FROM (
  SELECT rep, pos, a, (a * a % {R.PRIME} + rep * 31 + pos) % {R.PRIME} AS b FROM (
    SELECT rep, pos, (rep * 1000003 + pos * 8191 + 17) % {R.PRIME} AS a FROM (SELECT unnest(range(0, 20000)) AS rep) r CROSS JOIN (SELECT pos FROM weather_days) s) t) u"""


@register("permutation_correlation", "r:real p_value:real", f"""
SELECT max(obs) AS r, avg(CASE WHEN abs(r) >= abs(obs) - 1e-12 THEN 1.0 ELSE 0.0 END) AS p_value FROM (SELECT rep, corr(a.prcp_mm, b.fhvhv_anom) AS r, (SELECT corr(prcp_mm, fhvhv_anom) FROM weather_days) AS obs
FROM ({SHUF}) s JOIN weather_days a ON a.pos = s.place JOIN weather_days b ON b.pos = s.pos GROUP BY 1) q""")
def q_perm(spark, d):
    return R.permutation_correlation(weather_days(spark, d), "date", "prcp_mm", "fhvhv_anom")


for _name, _cond in (("rain", "prcp_mm >= 1.0"), ("heavy_rain", "prcp_mm >= 8.0"), ("snow", "snow_mm > 0")):
    register(f"permutation_{_name}_difference", "diff:real p_value:real", f"""
SELECT max(obs) AS diff, avg(CASE WHEN abs(dd) >= abs(obs) - 1e-9 THEN 1.0 ELSE 0.0 END) AS p_value FROM (
  SELECT rep, avg(a.fhvhv_anom) FILTER (WHERE b.{_cond}) - avg(a.fhvhv_anom) FILTER (WHERE NOT b.{_cond}) AS dd,
    (SELECT avg(fhvhv_anom) FILTER (WHERE {_cond}) - avg(fhvhv_anom) FILTER (WHERE NOT {_cond}) FROM weather_days) AS obs
  FROM ({SHUF}) s JOIN weather_days a ON a.pos = s.place JOIN weather_days b ON b.pos = s.pos GROUP BY 1) q""")(
        lambda spark, d, c=_cond: R.permutation_group_difference(weather_days(spark, d).withColumn("mask", F.expr(c)), "date", "fhvhv_anom", "mask"))
