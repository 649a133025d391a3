"""Effect estimates: adjusted effects with refuters, differences in differences, elasticities, mediation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripmarts import lineage
from tripmarts.functions import tails
from tripmarts.functions.hashing import draw, draw_unit
from tripmarts.operators import linear as L
from tripmarts.operators.hypothesis import finish
from tripmarts.operators.resample import number_units
from tripmarts.operators.rollup import correlation
from tripmarts.operators.window import demean


def _term(f: L.Fit, name: str) -> tuple:
    return next(r for r in f.rows() if r[0] == name)


def _shuffle_column(df: DataFrame, key: str, column: str, seed: int) -> DataFrame:
    """The column in hash order of the key, joined back by position: the same values at random places. The key must be unique."""
    n, keys = df.agg(F.count(F.lit(1)), F.count_distinct(key)).first()
    if n != keys:
        raise ValueError(f"{key} is not unique: {keys} values in {n} rows")
    units = number_units(df, key)
    placed = df.select(key, column).join(units, key)
    total = units.agg(F.count(F.lit(1))).scalar()
    # Position by hash order: rank of the draw, spread over parts by its leading bits.
    hashed = placed.select(F.col(column).alias("_moved"), draw(seed, F.col("pos")).alias("_h"), "pos").withColumn("_t", total)
    parts = 64
    part = F.floor(F.col("_h") / (2 ** 32 / parts)).cast("int")
    parted = hashed.withColumn("_part", part)
    before = parted.groupBy("_part").agg(F.count(F.lit(1)).alias("_c")).select(
        "_part", (F.sum("_c").over(Window.orderBy("_part")) - F.col("_c")).alias("_before"))
    ranked = (parted.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy("_h", "pos")))
              .join(before, "_part").select((F.col("_before") + F.col("_in") - 1).alias("pos"), "_moved"))
    return df.join(units, key).drop(column).join(ranked.withColumnRenamed("_moved", column), "pos").drop("pos")


def sensitivity(t: float, df_resid: int) -> tuple[float, float]:
    """Partial R² of the treatment and the robustness value: the confounding needed to explain the effect away."""
    part = t * t / (t * t + df_resid)
    f2 = part / (1 - part) if part < 1 else math.inf
    rv = 0.5 * (math.sqrt(f2 * f2 + 4 * f2) - f2) if math.isfinite(f2) else 1.0
    return part, rv


def adjusted_effect(df: DataFrame, treatment: str, outcome: str, adjust: list[str], categories: list[str] | None = None, key: str | None = None,
                    refute: tuple[str, ...] = (), cluster: str | None = None, label: str = "all", by: str | None = None, seed: int = 42) -> DataFrame:
    """Effect of a treatment on an outcome given an adjustment set (one linear model per group of `by`), naive r,
    interval, sensitivity and refuters: placebo (shuffled treatment), random_cause, subset (80 %)."""
    cols = list(dict.fromkeys([treatment, outcome, *adjust, *(categories or [])]))
    keep = list(dict.fromkeys(c for c in (key, cluster, by) if c))
    rows = lineage.cut(df.select(*dict.fromkeys([*cols, *keep])).dropna(subset=cols))
    x = [treatment, *[a for a in adjust if a != treatment]]
    fits = L.fit(rows, outcome, x, categories, by=by)
    naive = {str(r["g"]): r["r"] for r in rows.groupBy((F.col(by) if by else F.lit("all")).alias("g")).agg(
        correlation(treatment, outcome).alias("r")).collect()}  # as many rows as fits
    extra: dict[str, dict[str, float]] = {g: {} for g in fits}
    tests = {"placebo": lambda: _shuffle_column(rows, key, treatment, seed) if "placebo" in refute else None,
             "random_cause": lambda: rows.withColumn("_noise", draw_unit(seed, F.col(key))) if "random_cause" in refute else None,
             "subset": lambda: rows.where(draw_unit(seed + 1, F.col(key)) < 0.8) if "subset" in refute else None}
    for name, build in tests.items():
        data = build()
        if data is not None:
            again = L.fit(data, outcome, x + (["_noise"] if name == "random_cause" else []), categories, by=by)
            for g, f in again.items():
                extra[g][name] = _term(f, treatment)[1]
    if cluster:
        for g, f in L.fit(rows, outcome, x, categories, cov="cluster", cluster=cluster, by=by).items():
            extra[g]["cluster_p"] = _term(f, treatment)[4]
    out = []
    for g, f in fits.items():
        _, b, se, t, p = _term(f, treatment)
        part, rv = sensitivity(t, f.df_resid) if t is not None and f.df_resid > 0 else (None, None)
        e = extra[g]
        out.append((label if by is None else g, treatment, outcome, f.n, naive.get(g), b, se, b - 1.96 * se, b + 1.96 * se, p, part, rv,
                    e.get("placebo"), e.get("random_cause"), e.get("subset"), e.get("cluster_p")))
    return df.sparkSession.createDataFrame(out, (
        "model string, treatment string, outcome string, n bigint, naive_r double, ate double, se double, ci_low double, ci_high double, p_value double, "
        "partial_r2 double, robustness_value double, placebo double, random_cause double, subset80 double, cluster_p double"))


def before_after(daily: DataFrame, unit: str, year0: int, year1: int, months: tuple[int, int] = (1, 6)) -> DataFrame:
    """Mean daily trips and mean daily fare per mile of the same months in two years, per unit, with changes.
    `daily` has one row per date and unit with trips and fare_per_mile."""
    inside = daily.where(F.month("date").between(*months) & F.year("date").isin(year0, year1))

    def mean(c: str, y: int) -> Column:
        return F.avg(F.when(F.year("date") == y, F.col(c)))

    out = inside.groupBy(unit).agg(mean("trips", year0).alias("trips_0"), mean("trips", year1).alias("trips_1"),
                                   mean("fare_per_mile", year0).alias("fare_0"), mean("fare_per_mile", year1).alias("fare_1"))
    return out.withColumns({"trips_yoy_pct": (F.try_divide(F.col("trips_1"), F.col("trips_0")) - 1) * 100,
                            "fare_yoy_pct": (F.try_divide(F.col("fare_1"), F.col("fare_0")) - 1) * 100})


def did_elasticity(yoy: DataFrame, unit: str, treated: str, control: str) -> DataFrame:
    """Difference in differences of the yearly changes, and the price elasticity it implies:
    [dlog q treated - dlog q control] / [dlog p treated - dlog p control]."""
    def pick(u: str, c: str) -> Column:
        return F.max(F.when(F.col(unit) == u, F.col(c)))

    w = yoy.agg(*[pick(u, c).alias(f"{c}_{s}") for s, u in (("t", treated), ("c", control))
                  for c in ("trips_0", "trips_1", "fare_0", "fare_1", "trips_yoy_pct", "fare_yoy_pct")])
    dlog = lambda v, s: F.log(F.col(f"{v}_1_{s}") / F.col(f"{v}_0_{s}"))
    q, p = dlog("trips", "t") - dlog("trips", "c"), dlog("fare", "t") - dlog("fare", "c")
    return w.select((F.col("trips_yoy_pct_t") - F.col("trips_yoy_pct_c")).alias("did_trips_pp"),
                    (F.col("fare_yoy_pct_t") - F.col("fare_yoy_pct_c")).alias("did_fare_pp"), q.alias("did_log_trips"), p.alias("did_log_fare"),
                    F.try_divide(q, p).alias("elasticity"))


def mediation(df: DataFrame, treatment: str, mediator: str, outcome: str, adjust: list[str], categories: list[str] | None = None) -> DataFrame:
    """Direct and indirect effect by two regressions: outcome on treatment and mediator, mediator on treatment."""
    rows = lineage.cut(df.select(*dict.fromkeys([treatment, mediator, outcome, *adjust, *(categories or [])])).dropna())
    second = L.fit(rows, outcome, [treatment, mediator, *adjust], categories)["all"]
    first = L.fit(rows, mediator, [treatment, *adjust], categories)["all"]
    total = L.fit(rows, outcome, [treatment, *adjust], categories)["all"]
    nde, nie = _term(second, treatment)[1], _term(second, mediator)[1] * _term(first, treatment)[1]
    return df.sparkSession.createDataFrame([(treatment, mediator, outcome, _term(total, treatment)[1], nde, nie, first.n)],
                                           "treatment string, mediator string, outcome string, total_effect double, direct double, indirect double, n bigint")


def mediator_shrinkage(df: DataFrame, treatment: str, mediator: str, outcome: str, adjust: list[str], categories: list[str] | None = None) -> DataFrame:
    """How much of the treatment coefficient goes away once the mediator is controlled (HC3 errors)."""
    rows = lineage.cut(df.select(*dict.fromkeys([treatment, mediator, outcome, *adjust, *(categories or [])])).dropna())
    base = _term(L.fit(rows, outcome, [treatment, *adjust], categories, cov="HC3")["all"], treatment)
    ctrl_fit = L.fit(rows, outcome, [treatment, mediator, *adjust], categories, cov="HC3")["all"]
    ctrl, med = _term(ctrl_fit, treatment), _term(ctrl_fit, mediator)
    to_med = _term(L.fit(rows, mediator, [treatment, *adjust], categories, cov="HC3")["all"], treatment)
    row = (ctrl_fit.n, to_med[1], to_med[4], base[1], base[4], ctrl[1], ctrl[4], med[1], med[4], 100 * (1 - ctrl[1] / base[1]) if base[1] else None)
    return df.sparkSession.createDataFrame([row], (
        "n bigint, to_mediator double, to_mediator_p double, without_mediator double, without_mediator_p double, with_mediator double, "
        "with_mediator_p double, mediator_coef double, mediator_p double, shrinkage_pct double"))


def within_effect(panel: DataFrame, unit: str, time: str, treatment: str, outcome: str, cov: str = "HC3") -> DataFrame:
    """Two-way fixed effects by demeaning: unit first, then time, once each."""
    rows = panel.select(unit, time, treatment, outcome).dropna()
    return L.ols(demean(rows, [treatment, outcome], [[unit], [time]]), f"{outcome}_dm", [f"{treatment}_dm"], cov=cov, terms=[f"{treatment}_dm"])


def dummy_fixed_effects(panel: DataFrame, unit: str, time: str, treatment: str, outcome: str, rounds: int = 50, tol: float = 1e-12) -> DataFrame:
    """The estimate of unit and time dummies without building them: demean both ways until the means vanish.
    Each round is one aggregate per direction on a panel of units x periods."""
    rows = lineage.cut(panel.select(unit, time, F.col(treatment).cast("double").alias("_t"), F.col(outcome).cast("double").alias("_y")).dropna())
    for _ in range(rounds):
        for keys in (unit, time):
            means = rows.groupBy(keys).agg(F.avg("_t").alias("_mt"), F.avg("_y").alias("_my"))
            rows = rows.join(means, keys).select(unit, time, (F.col("_t") - F.col("_mt")).alias("_t"), (F.col("_y") - F.col("_my")).alias("_y"))
        rows = lineage.cut(rows)
        left = rows.groupBy(unit).agg(F.avg("_t").alias("_t"), F.avg("_y").alias("_y")).agg(F.max(F.greatest(F.abs("_t"), F.abs("_y")))).first()[0]
        if left is None or left < tol:
            break
    else:
        raise RuntimeError("two-way means did not vanish")
    s = rows.agg(F.sum(F.col("_t") * F.col("_t")).alias("tt"), F.sum(F.col("_t") * F.col("_y")).alias("ty"), F.sum(F.col("_y") * F.col("_y")).alias("yy"),
                 F.count(F.lit(1)).alias("n"), F.count_distinct(unit).alias("units"), F.count_distinct(time).alias("times"))
    ate = F.try_divide(F.col("ty"), F.col("tt"))
    df_resid = F.col("n") - F.col("units") - F.col("times")
    out = s.select("n", "units", "times", ate.alias("ate"), F.sqrt(F.try_divide((F.col("yy") - ate * F.col("ty")) / df_resid, F.col("tt"))).alias("se"), df_resid.alias("df_resid"))
    return finish(out.withColumn("t", F.try_divide(F.col("ate"), F.col("se"))), lambda r: {"p_value": tails.t_two_sided(r["t"], r["df_resid"])})


def recovery_cross_section(panel: DataFrame, zones: DataFrame, year0: int, year1: int, min_base: int = 100) -> DataFrame:
    """Zones in two years side by side: recovery of the street-hail family, its earlier app share, app growth."""
    cols = ["green", "yellow", "fhvhv", "fhvhv_share_of_pair"]
    at = lambda y, s: panel.where(F.col("year") == y).select("zone", *[F.col(c).alias(f"{c}_{s}") for c in cols])
    both = at(year0, 0).join(at(year1, 1), "zone").where(F.col("green_0") >= min_base)
    return both.join(zones.select(F.col("LocationID").alias("zone"), "borough"), "zone").withColumns({
        "green_recovery": F.col("green_1") / F.col("green_0"), "yellow_recovery": F.col("yellow_1") / F.greatest(F.col("yellow_0"), F.lit(1)),
        "fhvhv_growth": F.log(F.greatest(F.col("fhvhv_1"), F.lit(1)).cast("double")) - F.log(F.greatest(F.col("fhvhv_0"), F.lit(1)).cast("double"))})


def monthly_mean(daily: DataFrame, date: str, value: str) -> DataFrame:
    return daily.where(F.col(value).isNotNull()).groupBy(F.trunc(date, "MM").alias("month")).agg(F.avg(value).alias("mean"))


