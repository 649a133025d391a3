"""Least squares and grouped-binomial models on Spark.

Tasks turn their Arrow batches into k x k cross products; Spark adds these up, and only k x k numbers reach
the driver for the solve. Robust covariances take a second pass for the "meat". k is the number of terms, a
property of the model and not of the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripmarts import lineage
from tripmarts.functions import tails
from tripmarts.operators.window import global_rank

MAX_TERMS = 2000
#: Rows of a block in which lagged products are taken.
LAG_BLOCK = 65_536
BLOCK = "grp string, i int, v array<double>"


@dataclass
class Design:
    """Columns of a model matrix: intercept, numeric columns, dummies (first level dropped), numeric x dummy."""

    numeric: list[str]
    levels: dict[str, list] = field(default_factory=dict)
    interact: list[tuple[str, str]] = field(default_factory=list)
    intercept: bool = True

    def names(self) -> list[str]:
        out = (["const"] if self.intercept else []) + list(self.numeric)
        for c, lv in self.levels.items():
            out += [f"{c}={v}" for v in lv[1:]]
        for x, c in self.interact:
            out += [f"{x}:{c}={v}" for v in self.levels[c][1:]]
        return out

    def columns(self) -> list[str]:
        return list(dict.fromkeys([*self.numeric, *self.levels]))

    def matrix(self, pdf: pd.DataFrame) -> np.ndarray:
        parts = [np.ones((len(pdf), 1))] if self.intercept else []
        parts += [pdf[c].to_numpy(dtype=float)[:, None] for c in self.numeric]
        dummies = {}
        for c, lv in self.levels.items():
            code = pd.Categorical(pdf[c], categories=lv).codes
            one = np.zeros((len(pdf), len(lv)))
            one[np.arange(len(pdf)), code] = 1.0
            dummies[c] = one[:, 1:]
            parts.append(dummies[c])
        parts += [pdf[x].to_numpy(dtype=float)[:, None] * dummies[c] for x, c in self.interact]
        return np.hstack(parts)


def design(df: DataFrame, numeric: list[str], categories: list[str] | None = None, interact: list[tuple[str, str]] | None = None,
           intercept: bool = True) -> Design:
    """Read the levels of the categories (sorted; the first is the base)."""
    levels = {}
    for c in categories or []:
        rows = df.select(c).distinct().limit(MAX_TERMS + 1).collect()
        if len(rows) > MAX_TERMS:
            raise ValueError(f"{c} has more than {MAX_TERMS} levels; demean by it instead")
        levels[c] = sorted(r[0] for r in rows)
    return Design(numeric, levels, interact or [], intercept)


def prepare(df: DataFrame, cols: list[str], keep: list[str] | None = None) -> DataFrame:
    """Drop rows with a missing model column and materialise what the passes will read."""
    return lineage.cut(df.select(*dict.fromkeys([*cols, *(keep or [])])).dropna(subset=list(dict.fromkeys(cols))))


def _emit(sums: dict[str, np.ndarray]) -> pd.DataFrame:
    grp, idx, val = [], [], []
    for g, m in sums.items():
        for i, row in enumerate(m):
            grp.append(g)
            idx.append(i)
            val.append(row.tolist())
    return pd.DataFrame({"grp": grp, "i": idx, "v": val})


def _collect(blocks: DataFrame) -> dict[str, np.ndarray]:
    """Add up the partial matrices of all tasks: one row per (group, matrix row), numbers summed by position."""
    long = blocks.select("grp", "i", F.posexplode("v").alias("j", "x")).groupBy("grp", "i", "j").agg(F.sum("x").alias("x"))
    rows = long.groupBy("grp", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda s: s["x"]).alias("v"))
    out: dict[str, dict[int, list[float]]] = {}
    for r in rows.toLocalIterator():
        out.setdefault(r["grp"], {})[r["i"]] = r["v"]
    return {g: np.array([m[i] for i in sorted(m)]) for g, m in out.items()}


def _groups(pdf: pd.DataFrame, by: str | None):
    if by is None:
        yield "all", pdf
    else:
        for g, part in pdf.groupby(by, sort=False):
            yield str(g), part


def cross_products(df: DataFrame, dsg: Design, y: str, by: str | None = None, weight: str | None = None) -> dict[str, np.ndarray]:
    """[X, y]' W [X, y] per group."""
    def partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for g, part in _groups(pdf, by):
                z = np.hstack([dsg.matrix(part), part[y].to_numpy(dtype=float)[:, None]])
                w = z if weight is None else z * part[weight].to_numpy(dtype=float)[:, None]
                m = z.T @ w
                sums[g] = sums.get(g, 0) + m
        yield _emit(sums)

    cols = list(dict.fromkeys([*dsg.columns(), y, *([by] if by else []), *([weight] if weight else [])]))
    return _collect(df.select(*cols).mapInPandas(partials, BLOCK))


@dataclass
class Fit:
    names: list[str]
    beta: np.ndarray
    bread: np.ndarray
    n: int
    ssr: float
    tss: float
    cov: np.ndarray | None = None
    robust: bool = False

    @property
    def df_resid(self) -> int:
        return self.n - int(np.linalg.matrix_rank(self.bread))

    @property
    def r2(self) -> float:
        return 1 - self.ssr / self.tss if self.tss else float("nan")

    def rows(self) -> list[tuple]:
        se = np.sqrt(np.clip(np.diag(self.cov), 0, None))
        out = []
        for name, b, s in zip(self.names, self.beta, se):
            stat = b / s if s > 0 else None
            p = None
            if stat is not None:
                p = tails.normal_two_sided(stat) if self.robust else tails.t_two_sided(stat, self.df_resid)
            out.append((name, float(b), float(s), None if stat is None else float(stat), p))
        return out


def solve(m: np.ndarray, names: list[str]) -> Fit:
    """Coefficients from the augmented cross product; collinear terms share the minimum-norm solution."""
    xtx, xty, yty = m[:-1, :-1], m[:-1, -1], m[-1, -1]
    scale = np.sqrt(np.where(np.diag(xtx) > 0, np.diag(xtx), 1.0))
    bread = np.linalg.pinv(xtx / np.outer(scale, scale), rcond=1e-10, hermitian=True) / np.outer(scale, scale)
    beta = bread @ xty
    n = int(round(xtx[0, 0])) if names and names[0] == "const" else 0
    tss = yty - xty[0] ** 2 / n if n else yty
    return Fit(names, beta, bread, n, float(max(yty - beta @ xty, 0.0)), float(tss))


def _scores(df: DataFrame, dsg: Design, y: str, fits: dict[str, Fit], by: str | None, keep: list[str], leverage: bool) -> DataFrame:
    """Per-row score vectors x*e (or x*e/(1-h)) with the kept key columns."""
    beta = {g: f.beta for g, f in fits.items()}
    bread = {g: f.bread for g, f in fits.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for g, part in _groups(pdf, by):
                x = dsg.matrix(part)
                e = part[y].to_numpy(dtype=float) - x @ beta[g]
                if leverage:
                    h = np.einsum("ij,jk,ik->i", x, bread[g], x)
                    e = np.where(1 - h > 1e-10, e / np.maximum(1 - h, 1e-10), 0.0)
                out = part[keep].copy()
                out["grp"] = g
                out["s"] = list(x * e[:, None])
                yield out

    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep), "grp string", "s array<double>"])
    cols = list(dict.fromkeys([*dsg.columns(), y, *([by] if by else []), *keep]))
    return df.select(*cols).mapInPandas(run, schema)


def _outer(scores: DataFrame, left: str = "s", right: str = "s") -> dict[str, np.ndarray]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for g, part in pdf.groupby("grp", sort=False):
                m = np.vstack(part[left].to_numpy()).T @ np.vstack(part[right].to_numpy())
                sums[g] = sums.get(g, 0) + m
        yield _emit(sums)

    return _collect(scores.select("grp", *dict.fromkeys([left, right])).mapInPandas(run, BLOCK))


def _cluster_scores(scores: DataFrame, cluster: str) -> DataFrame:
    """Score sums per cluster, by position so that Spark combines them before the shuffle."""
    long = scores.select("grp", cluster, F.posexplode("s").alias("j", "x")).groupBy("grp", cluster, "j").agg(F.sum("x").alias("x"))
    return long.groupBy("grp", cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda s: s["x"]).alias("s"))


def with_earlier(scores: DataFrame, order: str, lags: int, block_rows: int = LAG_BLOCK) -> DataFrame:
    """Score vectors s next to s_earlier, the Bartlett-weighted sum of the `lags` vectors before them in their group.

    Rows are numbered by (group, order) and worked on in blocks of equal size; the last `lags` rows of a block go along to the next one, so that no
    group is the work of one task and a lag that reaches over a border finds its row.
    """
    size = max(block_rows, lags)
    at = F.col("_rn") - 1
    here, place = F.floor(at / size), at % size
    blocks = F.when(place >= size - lags, F.array(here, here + 1)).otherwise(F.array(here))
    rows = global_rank(scores, "grp", [order], "_rn").withColumn("_here", here).withColumn("_block", F.explode(blocks))
    w = Window.partitionBy("_block").orderBy("_rn")
    total = F.transform("s", lambda x: x * 0.0)
    for k in range(1, lags + 1):
        earlier, weight = F.lag(F.struct("grp", "s"), k).over(w), 1 - k / (lags + 1)
        rows = rows.withColumn(f"_lag{k}", F.when(earlier["grp"] == F.col("grp"), earlier["s"]))
        total = F.when(F.col(f"_lag{k}").isNull(), total).otherwise(F.zip_with(total, f"_lag{k}", lambda a, b: a + weight * b))  # noqa: B023
    return rows.where("_block = _here").select("grp", "s", total.alias("s_earlier"))


def covariance(df: DataFrame, dsg: Design, y: str, fits: dict[str, Fit], cov: str, by: str | None = None,
               cluster: str | None = None, order: str | None = None, lags: int = 3) -> None:
    """Fill in the covariance of each fit: nonrobust, HC3, HAC (Bartlett, `order` rows apart) or cluster."""
    if cov == "nonrobust":
        for f in fits.values():
            f.cov = f.bread * (f.ssr / f.df_resid) if f.df_resid > 0 else f.bread * np.nan
        return
    if cov == "HC3":
        meat = _outer(_scores(df, dsg, y, fits, by, [], True))
    elif cov == "cluster":
        sums = lineage.cut(_cluster_scores(_scores(df, dsg, y, fits, by, [cluster], False), cluster))
        meat = _outer(sums)
        g_n = {r["grp"]: r["n"] for r in sums.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}
        for g, f in fits.items():
            meat[g] = meat[g] * (g_n[g] / (g_n[g] - 1)) * ((f.n - 1) / (f.n - len(f.beta)))
    elif cov == "HAC":
        scores = lineage.cut(_scores(df, dsg, y, fits, by, [order], False))
        meat = _outer(scores)
        for g, m in _outer(with_earlier(scores, order, lags), "s", "s_earlier").items():
            meat[g] = meat[g] + m + m.T
    else:
        raise ValueError(f"unknown covariance {cov}")
    for g, f in fits.items():
        f.cov, f.robust = f.bread @ meat[g] @ f.bread, True


def fit(df: DataFrame, y: str, x: list[str], categories: list[str] | None = None, cov: str = "nonrobust", by: str | None = None,
        cluster: str | None = None, order: str | None = None, lags: int = 3, interact: list[tuple[str, str]] | None = None) -> dict[str, Fit]:
    """Least squares per group of `by` (key "all" without one)."""
    keep = [c for c in (by, cluster, order) if c]
    data = prepare(df, [y, *x, *(categories or [])], keep)
    if by is not None and data.select(by).distinct().limit(MAX_TERMS + 1).count() > MAX_TERMS:
        raise ValueError(f"{by} has more than {MAX_TERMS} groups; fit them in several calls")
    dsg = design(data, x, categories, interact)
    fits = {g: solve(m, dsg.names()) for g, m in cross_products(data, dsg, y, by).items()}
    covariance(data, dsg, y, fits, cov, by, cluster, order, lags)
    return fits


def table(df: DataFrame, fits: dict[str, Fit], by: str | None = None, terms: list[str] | None = None) -> DataFrame:
    """Result rows: (group,) term, coef, se, stat, p_value, n, r2."""
    rows = []
    for g, f in fits.items():
        for r in f.rows():
            if terms is None or r[0] in terms:
                rows.append(((g,) if by else ()) + r + (f.n, f.r2))
    head = f"`{by}` string, " if by else ""
    return df.sparkSession.createDataFrame(rows, head + "term string, coef double, se double, stat double, p_value double, n bigint, r2 double")


def ols(df: DataFrame, y: str, x: list[str], categories: list[str] | None = None, cov: str = "nonrobust", by: str | None = None,
        terms: list[str] | None = None, **kw) -> DataFrame:
    return table(df, fit(df, y, x, categories, cov, by, **kw), by, terms)


def wald_block(df: DataFrame, f: Fit, prefix: str) -> DataFrame:
    """Joint chi-square test that all coefficients with a name prefix are zero."""
    pos = [i for i, n in enumerate(f.names) if n.startswith(prefix)]
    b, v = f.beta[pos], f.cov[np.ix_(pos, pos)]
    rank = int(np.linalg.matrix_rank(v))
    stat = float(b @ np.linalg.pinv(v, hermitian=True) @ b)
    return df.sparkSession.createDataFrame([(len(pos), rank, stat, tails.chi2_sf(stat, rank))], "terms int, rank int, chi2 double, p_value double")


def standardised(df: DataFrame, y: str, x: list[str]) -> DataFrame:
    """Regression on z-scores (population deviation), so that coefficients are comparable."""
    rows = df.select(y, *x).dropna()
    agg = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in [y, *x]], *[F.stddev_pop(c).alias(f"s_{c}") for c in [y, *x]]).first()
    z = rows.select(*[((F.col(c) - agg[f"m_{c}"]) / agg[f"s_{c}"]).alias(c) for c in [y, *x]])
    return ols(z, y, x)


def line_fit(df: DataFrame, y: str, x: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


# --- grouped binomial --------------------------------------------------------------------------------------------

@dataclass
class BinomialFit:
    names: list[str]
    beta: np.ndarray
    cov: np.ndarray
    converged: bool
    design: Design
    data: DataFrame
    n_rows: int


def binomial(df: DataFrame, success: str, total: str, x: list[str], categories: list[str] | None = None, cluster: str | None = None,
             max_iter: int = 30, tol: float = 1e-9) -> BinomialFit:
    """Logistic regression on counts by reweighted least squares; every round is one pass over the grouped rows."""
    data = prepare(df, [success, total, *x, *(categories or [])], [cluster] if cluster else [])
    dsg = design(data, x, categories)
    k = len(dsg.names())
    beta, converged, m = np.zeros(k), False, None

    def step(b: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            acc = np.zeros((k, k + 1))
            for pdf in batches:
                mat = dsg.matrix(pdf)
                n = pdf[total].to_numpy(dtype=float)
                mu = 1 / (1 + np.exp(-np.clip(mat @ b, -30, 30)))
                w = n * mu * (1 - mu)
                acc += mat.T @ np.hstack([mat * w[:, None], (pdf[success].to_numpy(dtype=float) - n * mu)[:, None]])
            yield _emit({"all": acc})
        return _collect(data.mapInPandas(run, BLOCK))["all"]

    for _ in range(max_iter):
        m = step(beta)
        delta = np.linalg.pinv(m[:, :k], rcond=1e-12, hermitian=True) @ m[:, k]
        beta = beta + delta
        if np.max(np.abs(delta)) < tol:
            converged = True
            break
    m = step(beta)
    bread = np.linalg.pinv(m[:, :k], rcond=1e-12, hermitian=True)
    cov = bread
    n_rows = data.count()
    if cluster is not None:
        def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                mat = dsg.matrix(pdf)
                mu = 1 / (1 + np.exp(-np.clip(mat @ beta, -30, 30)))
                e = pdf[success].to_numpy(dtype=float) - pdf[total].to_numpy(dtype=float) * mu
                yield pd.DataFrame({cluster: pdf[cluster], "grp": "all", "s": list(mat * e[:, None])})
        schema = f"`{cluster}` {data.schema[cluster].dataType.simpleString()}, grp string, s array<double>"
        sums = lineage.cut(_cluster_scores(data.mapInPandas(scores, schema), cluster))
        g = sums.count()
        cov = bread @ (_outer(sums)["all"] * (g / (g - 1)) * ((n_rows - 1) / max(n_rows - k, 1))) @ bread
    return BinomialFit(dsg.names(), beta, cov, converged, dsg, data, n_rows)


def binomial_table(f: BinomialFit, terms: list[str] | None = None) -> DataFrame:
    """Coefficients with odds ratios and 95 % intervals."""
    se = np.sqrt(np.clip(np.diag(f.cov), 0, None))
    rows = []
    for name, b, s in zip(f.names, f.beta, se):
        if terms is None or name in terms:
            z = float(b / s) if s > 0 else None
            rows.append((name, float(b), float(s), z, None if z is None else tails.normal_two_sided(z), math.exp(b), math.exp(b - 1.959963984540054 * s),
                         math.exp(b + 1.959963984540054 * s), f.converged))
    return f.data.sparkSession.createDataFrame(rows, "term string, coef double, se double, z double, p_value double, odds_ratio double, or_low double, or_high double, converged boolean")


def marginal_difference(f: BinomialFit, column: str, weight: str) -> DataFrame:
    """Weighted mean change of the predicted share when `column` goes from 0 to 1."""
    dsg, beta = f.design, f.beta

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            p = [1 / (1 + np.exp(-np.clip(dsg.matrix(pdf.assign(**{column: v})) @ beta, -30, 30))) for v in (1.0, 0.0)]
            yield pd.DataFrame({"w": pdf[weight].astype(float), "d": p[0] - p[1]})

    return f.data.mapInPandas(run, "w double, d double").agg((F.sum(F.col("w") * F.col("d")) / F.sum("w")).alias("adjusted_difference"))
