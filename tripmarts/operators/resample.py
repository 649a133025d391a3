"""Bootstrap and permutation on reduced units (days): hash draws, so every run and engine agrees."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tripmarts import lineage
from tripmarts.functions.hashing import draw_index
from tripmarts.operators.window import global_rank


def number_units(df: DataFrame, key: str) -> DataFrame:
    """(key, pos): 0-based position of each distinct unit in key order; keys are dates or numbers."""
    numeric = isinstance(df.schema[key].dataType, NumericType)
    order = F.col(key) if numeric else F.datediff(key, F.lit("1970-01-01").cast("date"))
    units = df.select(key).distinct().withColumn("_ord", order.cast("double"))
    return global_rank(units, "_ord", [key], "_rn").select(key, (F.col("_rn") - 1).alias("pos"))


def _replicates(units: DataFrame, reps: int) -> DataFrame:
    """(rep, pos): n draws with replacement for every replicate, spread over the cluster by replicate."""
    spark = units.sparkSession
    tasks = min(reps, max(8, spark.sparkContext.defaultParallelism))
    n = units.agg(F.count(F.lit(1))).scalar()
    base = spark.range(0, reps, 1, tasks).withColumnRenamed("id", "rep").withColumn("_n", n)
    slots = base.select("rep", "_n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).alias("_i"))
    return slots.select("rep", draw_index(F.col("_n"), F.col("rep"), F.col("_i")).alias("pos"))


def _interval(reps: DataFrame, cols: list[str], level: float = 0.95) -> DataFrame:
    a = (1 - level) / 2
    return reps.agg(*[F.percentile(c, F.lit(q)).alias(f"{c}_{s}") for c in cols for s, q in (("low", a), ("high", 1 - a))])


def bootstrap_share_difference(daily: DataFrame, date: str, group: str, a: object, b: object, success: str, total: str, reps: int = 2000) -> DataFrame:
    """Percentile interval of share(a) - share(b), resampling whole days that have both groups."""
    def pick(g, c: str) -> Column:
        return F.sum(F.when(F.col(group) == g, F.col(c)))

    wide = daily.groupBy(date).agg(pick(a, success).alias("xa"), pick(a, total).alias("na"), pick(b, success).alias("xb"), pick(b, total).alias("nb"))
    wide = lineage.cut(wide.where("na is not null and nb is not null"))  # one row per day, read several times below
    units = wide.join(number_units(wide, date), date)
    drawn = _replicates(wide, reps).join(units, "pos").groupBy("rep").agg(*[F.sum(c).alias(c) for c in ("xa", "na", "xb", "nb")])
    diffs = drawn.withColumn("diff", F.col("xa") / F.col("na") - F.col("xb") / F.col("nb"))
    return _interval(diffs, ["diff"])


def bootstrap_quantile_difference(hist: DataFrame, date: str, segment: str, a: str, b: str, value: str, n: str,
                                  probs: dict[str, float], reps: int = 2000) -> DataFrame:
    """Percentile intervals of quantile differences, the same resampled days for both segments."""
    hist = lineage.cut(hist.select(date, segment, value, n))
    units = number_units(hist, date)
    weights = _replicates(units, reps).groupBy("rep", "pos").agg(F.count(F.lit(1)).alias("_w"))
    placed = hist.join(units, date).select("pos", segment, value, n)
    sums = weights.join(placed, "pos").groupBy("rep", segment, value).agg(F.sum(F.col("_w") * F.col(n)).alias("_n"))
    w = Window.partitionBy("rep", segment)
    cum = sums.withColumns({"_cum": F.sum("_n").over(w.orderBy(value)), "_total": F.sum("_n").over(w)})
    quant = cum.groupBy("rep", segment).agg(*[F.min(F.when(F.col("_cum") >= F.lit(q) * F.col("_total"), F.col(value))).alias(k) for k, q in probs.items()])
    diffs = quant.groupBy("rep").agg(*[(F.max(F.when(F.col(segment) == a, F.col(k))) - F.max(F.when(F.col(segment) == b, F.col(k)))).alias(k) for k in probs])
    return _interval(diffs, list(probs))


#: The order of a shuffle: units by shuffle_key(replicate, position), then position.
PRIME = 2_147_483_647
#: Replicates that one Arrow row stands for.
BLOCK = 256


def shuffle_key(rep, pos):
    """A number below PRIME from two integers, with operations that every engine has; works on numpy arrays."""
    a = (rep * 1_000_003 + pos * 8191 + 17) % PRIME
    b = (a * a % PRIME + rep * 31 + pos) % PRIME
    return (b * b + a * 12_345) % PRIME


def _permuted(units: DataFrame, reps: int, statistic: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], slack: float) -> DataFrame:
    """(obs, hits, reps): the statistic of the units (pos, a, b), and the shuffles of b in which it is as extreme.

    The units of a resampling are days or the like; each task gets their vector and a block of replicates, Spark adds up the hits.
    statistic(a, b, orders) has one value per row of orders.
    """
    spark = units.sparkSession
    vector = units.agg(F.sort_array(F.collect_list(F.struct("pos", "a", "b")))).scalar()
    blocks = -(-reps // BLOCK)
    tasks = spark.range(0, blocks, 1, min(blocks, max(8, spark.sparkContext.defaultParallelism))).select((F.col("id") * BLOCK).alias("start"), vector.alias("units"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not rows:
                    continue
                a, b = (np.array([float(r[c]) for r in rows]) for c in ("a", "b"))
                pos = np.arange(len(rows), dtype=np.int64)
                observed = float(statistic(a, b, pos[None])[0])
                hits = 0
                for at in range(start, min(start + BLOCK, reps), 32):
                    rep = np.arange(at, min(at + 32, start + BLOCK, reps), dtype=np.int64)
                    orders = np.argsort(shuffle_key(rep[:, None], pos[None]), axis=1, kind="stable")
                    hits += int((np.abs(statistic(a, b, orders)) >= abs(observed) - slack).sum())
                yield pa.RecordBatch.from_pydict({"obs": [observed], "hits": [hits]})

    return tasks.mapInArrow(run, "obs double, hits bigint").agg(F.max("obs").alias("obs"), (F.sum("hits") / F.lit(reps)).alias("p_value"))


def _correlations(x: np.ndarray, y: np.ndarray, orders: np.ndarray) -> np.ndarray:
    x, y = x - x.mean(), y - y.mean()
    return y[orders] @ x / np.sqrt((x @ x) * (y @ y))


def _gaps(v: np.ndarray, m: np.ndarray, orders: np.ndarray) -> np.ndarray:
    inside, n = m[orders] @ v, m.sum()
    return inside / n - (v.sum() - inside) / (len(v) - n)


def permutation_correlation(df: DataFrame, key: str, x: str, y: str, reps: int = 20000) -> DataFrame:
    """Two-sided permutation p-value of Pearson's r."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(key, F.col(x).cast("double").alias("a"), F.col(y).cast("double").alias("b"))
    rows = lineage.cut(rows)
    # A replicate equal to the observation up to rounding counts as at least as extreme.
    out = _permuted(rows.join(number_units(rows, key), key), reps, _correlations, 1e-12)
    return out.select(F.col("obs").alias("r"), "p_value")


def permutation_group_difference(df: DataFrame, key: str, value: str, mask: str, reps: int = 20000) -> DataFrame:
    """Permutation p-value of mean(value | mask) - mean(value | not mask); the mask is shuffled."""
    rows = df.where(F.col(value).isNotNull() & F.col(mask).isNotNull()).select(key, F.col(value).cast("double").alias("a"), F.col(mask).cast("int").cast("double").alias("b"))
    rows = lineage.cut(rows)
    out = _permuted(rows.join(number_units(rows, key), key), reps, _gaps, 1e-9)
    return out.select(F.col("obs").alias("diff"), "p_value")
