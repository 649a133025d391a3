"""Tests on grouped counts, moments and histograms. Spark reduces the data to a few numbers; the driver
only turns those into a statistic and a p-value."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripmarts import lineage
from tripmarts.functions import tails
from tripmarts.operators.rollup import correlation
from tripmarts.operators.window import average_rank

MAX_RESULT_ROWS = 1000


def finish(stats: DataFrame, fn: Callable[[dict], dict]) -> DataFrame:
    """Apply a driver-side formula to each row of an already reduced table."""
    got = stats.limit(MAX_RESULT_ROWS + 1).collect()
    if len(got) > MAX_RESULT_ROWS:
        raise ValueError("a test result has one row per comparison; this input is not reduced")
    out = [{**r.asDict(), **fn(r.asDict())} for r in got]
    spark = stats.sparkSession
    names = list(out[0]) if out else stats.columns
    kinds = {f.name: f.dataType.simpleString() for f in stats.schema.fields}
    schema = ", ".join(f"`{n}` {kinds.get(n, 'double')}" for n in names)
    return spark.createDataFrame([tuple(row[n] for n in names) for row in out], schema)


# --- means -------------------------------------------------------------------------------------------------------

def moments(df: DataFrame, group: str, value: str, by: list[str] | None = None) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*(by or []), group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))


def welch(mom: DataFrame, group: str, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Welch t-test of group a against b from (n, mean, var) rows, with Cohen's d."""
    def pick(g: str, c: str) -> Column:
        return F.max(F.when(F.col(group) == g, F.col(c)))

    wide = mom.groupBy(*(by or [])).agg(*[pick(g, c).alias(f"{c}_{s}") for s, g in (("a", a), ("b", b)) for c in ("n", "mean", "var")])
    va, vb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    pooled = (F.col("var_a") * (F.col("n_a") - 1) + F.col("var_b") * (F.col("n_b") - 1)) / (F.col("n_a") + F.col("n_b") - 2)
    stats = wide.withColumns({
        "diff": F.col("mean_a") - F.col("mean_b"), "t": (F.col("mean_a") - F.col("mean_b")) / F.sqrt(va + vb),
        "df": F.pow(va + vb, 2) / (F.pow(va, 2) / (F.col("n_a") - 1) + F.pow(vb, 2) / (F.col("n_b") - 1)),
        "cohens_d": (F.col("mean_a") - F.col("mean_b")) / F.sqrt(pooled)})
    return finish(stats, lambda r: {"p_value": tails.t_two_sided(r["t"], r["df"]) if r["t"] is not None else None})


def did_means(cells: DataFrame, treated: str, after: str, by: list[str] | None = None) -> DataFrame:
    """(treated after - treated before) - (control after - control before) from four (n, mean, var) cells.
    `treated` and `after` are boolean columns."""
    def cell(t: bool, a: bool, c: str) -> Column:
        return F.max(F.when((F.col(treated) == t) & (F.col(after) == a), F.col(c)))

    combos = [(True, True), (True, False), (False, True), (False, False)]
    wide = cells.groupBy(*(by or [])).agg(*[cell(t, a, c).alias(f"{c}_{int(t)}{int(a)}") for t, a in combos for c in ("n", "mean", "var")])
    did = (F.col("mean_11") - F.col("mean_10")) - (F.col("mean_01") - F.col("mean_00"))
    se = F.sqrt(sum((F.col(f"var_{int(t)}{int(a)}") / F.col(f"n_{int(t)}{int(a)}") for t, a in combos), F.lit(0.0)))
    stats = wide.withColumns({"treated_change": F.col("mean_11") - F.col("mean_10"), "control_change": F.col("mean_01") - F.col("mean_00"),
                              "did": did, "se": se, "z": F.try_divide(did, se)})
    return finish(stats, lambda r: {"p_value": tails.normal_two_sided(r["z"]) if r["z"] is not None else None})


# --- counts ------------------------------------------------------------------------------------------------------

def with_expected(counts: DataFrame, row: str, col: str, n: str = "n") -> DataFrame:
    """Expected counts under independence, standardised residual and profile of each row category."""
    r, c = F.sum(n).over(Window.partitionBy(row)), F.sum(n).over(Window.partitionBy(col))
    total = counts.agg(F.sum(n)).scalar()
    out = counts.withColumns({"_r": r, "_c": c, "_t": total})
    expected = F.col("_r") * F.col("_c") / F.col("_t").cast("double")
    return (out.withColumn("expected", expected).withColumn("std_residual", (F.col(n) - F.col("expected")) / F.sqrt("expected"))
            .withColumn("profile_pct", F.col(n) * 100.0 / F.col("_r")).drop("_r", "_c", "_t"))


def chi_square(counts: DataFrame, row: str, col: str, n: str = "n") -> DataFrame:
    """Independence test on long counts (absent cells count as zero), with Cramér's V."""
    e = with_expected(counts, row, col, n)
    # Cells without a row have observation 0 and contribute their expectation: total - sum of present expectations.
    stats = e.agg(F.sum(F.pow(F.col(n) - F.col("expected"), 2) / F.col("expected")).alias("_seen"), F.sum(n).alias("total"),
                  F.sum("expected").alias("_exp"), F.count_distinct(row).alias("rows"), F.count_distinct(col).alias("cols"))
    stats = stats.select("total", "rows", "cols", (F.col("_seen") + F.col("total") - F.col("_exp")).alias("chi2"),
                         ((F.col("rows") - 1) * (F.col("cols") - 1)).alias("dof"))
    stats = stats.withColumn("cramers_v", F.sqrt(F.col("chi2") / (F.col("total") * F.least(F.col("rows") - 1, F.col("cols") - 1))))
    return finish(stats, lambda r: {"p_value": tails.chi2_sf(r["chi2"], r["dof"])})


def profile_difference(counts: DataFrame, segment: str, slot: list[str], a: str, b: str, n: str = "n") -> DataFrame:
    """Share of each slot in two segments, the difference in points and the standardised residual of segment a."""
    keyed = counts.withColumn("_slot", F.struct(*slot))
    e = with_expected(keyed, segment, "_slot", n)
    pick = lambda g, c: F.coalesce(F.max(F.when(F.col(segment) == g, F.col(c))), F.lit(0.0))
    return e.groupBy(*slot).agg(pick(a, "profile_pct").alias("share_a_pct"), pick(b, "profile_pct").alias("share_b_pct"),
                                pick(a, "std_residual").alias("residual_a")).withColumn(
        "difference_pp", F.col("share_a_pct") - F.col("share_b_pct"))


def extreme_slots(diff: DataFrame, slot: list[str], n: int = 6) -> DataFrame:
    """The n largest and n smallest differences."""
    high = diff.orderBy(F.desc("difference_pp"), *slot).limit(n).withColumn("side", F.lit("more often in a"))
    low = diff.orderBy(F.asc("difference_pp"), *slot).limit(n).withColumn("side", F.lit("more often in b"))
    return high.unionByName(low)


def js_distance(counts: DataFrame, segment: str, slot: list[str], a: str, b: str, n: str = "n") -> DataFrame:
    """Jensen-Shannon distance (base 2) between two profiles."""
    wide = counts.groupBy(*slot).agg(*[F.coalesce(F.sum(F.when(F.col(segment) == g, F.col(n))), F.lit(0)).alias(s) for s, g in (("_a", a), ("_b", b))])
    totals = wide.agg(F.sum("_a").alias("ta"), F.sum("_b").alias("tb"))
    p = wide.withColumns({"_ta": totals.select("ta").scalar(), "_tb": totals.select("tb").scalar()}).select(
        (F.col("_a") / F.col("_ta")).alias("p"), (F.col("_b") / F.col("_tb")).alias("q")).withColumn("m", (F.col("p") + F.col("q")) / 2)
    term = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / F.col("m"))).otherwise(F.lit(0.0))
    return p.agg(F.sqrt(F.greatest(F.lit(0.0), (F.sum(term("p")) + F.sum(term("q"))) / 2)).alias("js_distance"))


def two_proportions(counts: DataFrame, group: str, a: object, b: object, success: str, total: str, z_value: float = 1.96) -> DataFrame:
    """Pooled z of share(a) - share(b), Wald interval, relative lift and Cohen's h."""
    def pick(g, c: str) -> Column:
        return F.sum(F.when(F.col(group) == g, F.col(c)))

    s = counts.agg(*[pick(g, c).cast("double").alias(f"{k}_{i}") for i, g in (("a", a), ("b", b)) for k, c in (("x", success), ("n", total))])
    pa, pb = F.col("x_a") / F.col("n_a"), F.col("x_b") / F.col("n_b")
    pool = (F.col("x_a") + F.col("x_b")) / (F.col("n_a") + F.col("n_b"))
    wald = F.sqrt(pa * (1 - pa) / F.col("n_a") + pb * (1 - pb) / F.col("n_b"))
    stats = s.select(pa.alias("share_a"), pb.alias("share_b"), (pa - pb).alias("diff"),
                     ((pa - pb) / F.sqrt(pool * (1 - pool) * (1 / F.col("n_a") + 1 / F.col("n_b")))).alias("z"),
                     (pa - pb - z_value * wald).alias("ci_low"), (pa - pb + z_value * wald).alias("ci_high"), (pa / pb - 1).alias("relative_lift"),
                     (2 * (F.asin(F.sqrt(pa)) - F.asin(F.sqrt(pb)))).alias("cohens_h"))
    return finish(stats, lambda r: {"p_two_sided": tails.normal_two_sided(r["z"]), "p_larger": tails.normal_sf(r["z"])})


# --- association -------------------------------------------------------------------------------------------------

def _r_p_value(r: dict) -> dict:
    rho, n = r["r"], r["n"]
    if rho is None or n < 3:
        return {"p_value": None}
    t = math.inf if abs(rho) >= 1 else rho * math.sqrt((n - 2) / (1 - rho * rho))
    return {"p_value": tails.t_two_sided(t, n - 2)}


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return finish(both.agg(F.count(F.lit(1)).alias("n"), correlation(x, y).alias("r")), _r_p_value)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson correlation of mid-ranks."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    both = lineage.cut(both)  # ranked twice: do not replay the plan behind it
    ranked = average_rank(average_rank(both, "_x", "_rx"), "_y", "_ry")
    return finish(ranked.agg(F.count(F.lit(1)).alias("n"), correlation("_rx", "_ry").alias("r")), _r_p_value)


def histogram_cdf(hist: DataFrame, segment: str, value: str, n: str) -> DataFrame:
    """Cumulative share per segment over histogram bins."""
    per_bin = hist.groupBy(segment, value).agg(F.sum(n).alias("n"))
    w = Window.partitionBy(segment)
    return per_bin.withColumn("cdf", F.sum("n").over(w.orderBy(value)) / F.sum("n").over(w))


def mann_whitney(hist: DataFrame, segment: str, a: str, b: str, value: str, n: str) -> DataFrame:
    """Rank test of a against b from binned counts: U, tie-corrected z, P(superiority), rank-biserial."""
    bins = hist.groupBy(value).agg(*[F.coalesce(F.sum(F.when(F.col(segment) == g, F.col(n))), F.lit(0)).cast("double").alias(s) for s, g in (("_a", a), ("_b", b))])
    # One row per bin of the histogram: a bounded number.
    less = F.sum("_b").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    t = F.col("_a") + F.col("_b")
    s = bins.withColumn("_less", F.coalesce(less, F.lit(0.0))).agg(
        F.sum("_a").alias("n_a"), F.sum("_b").alias("n_b"), F.sum(F.col("_a") * (F.col("_less") + 0.5 * F.col("_b"))).alias("u"), F.sum(t * t * t - t).alias("ties"))
    total = F.col("n_a") + F.col("n_b")
    var = F.col("n_a") * F.col("n_b") / 12 * (total + 1 - F.col("ties") / (total * (total - 1)))
    stats = s.select("n_a", "n_b", "u", ((F.col("u") - F.col("n_a") * F.col("n_b") / 2 - 0.5) / F.sqrt(var)).alias("z"),
                     (F.col("u") / (F.col("n_a") * F.col("n_b"))).alias("p_superiority")).withColumn("rank_biserial", 2 * F.col("p_superiority") - 1)
    return finish(stats, lambda r: {"p_value": tails.normal_sf(r["z"])})
