"""Daily demand forecasting: features, baselines, linear and boosted models, scores."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripmarts import lineage
from tripmarts.operators.window import trailing_mean

NUMERIC = ["lag1", "lag7", "roll7", "prcp_mm", "tmax_c", "year"]
CATEGORIES = ["weekday", "month"]
BASELINES = {"naive": "lag1", "seasonal": "lag7", "trailing7": "roll7"}


def features(daily: DataFrame, weather: DataFrame, series: list[str] | None = None) -> DataFrame:
    """Lags are row shifts of each daily series (check for date gaps first); incomplete rows are dropped."""
    keys = series or ["_all"]
    base = daily if series else daily.withColumn("_all", F.lit(1))
    w = Window.partitionBy(*keys).orderBy("date")
    out = (base.join(weather.select("date", "prcp_mm", "tmax_c"), "date", "left")
           .withColumns({"lag1": F.lag("trips", 1).over(w), "lag7": F.lag("trips", 7).over(w), "roll7": trailing_mean("trips", keys, "date", 7),
                         "weekday": F.weekday("date").cast("string"), "month": F.month("date").cast("string"), "year": F.year("date")}))
    return (out if series else out.drop("_all")).dropna(subset=["lag1", "lag7", "roll7", "prcp_mm", "tmax_c"])


def _models(max_iter: int, label: str) -> dict[str, Pipeline]:
    codes = [StringIndexer(inputCol=c, outputCol=f"{c}_i", handleInvalid="keep", stringOrderType="alphabetAsc") for c in CATEGORIES]
    hot = OneHotEncoder(inputCols=[f"{c}_i" for c in CATEGORIES], outputCols=[f"{c}_v" for c in CATEGORIES], handleInvalid="keep")
    vec = VectorAssembler(inputCols=[*NUMERIC, *[f"{c}_v" for c in CATEGORIES]], outputCol="features")
    return {"linear": Pipeline(stages=[*codes, hot, vec, LinearRegression(labelCol=label, predictionCol="pred_linear", solver="normal", regParam=1e-6)]),
            "boosting": Pipeline(stages=[*codes, hot, vec, GBTRegressor(labelCol=label, predictionCol="pred_boosting", maxIter=max_iter, maxDepth=4, stepSize=0.05, seed=42)])}


def predict(feats: DataFrame, test_start: str, max_iter: int = 300, models: tuple[str, ...] = ("linear", "boosting")) -> DataFrame:
    """Test-period predictions of the baselines and of the models fitted on the earlier part."""
    cut = F.lit(test_start).cast("date")
    data = lineage.cut(feats.withColumn("trips", F.col("trips").cast("double")))
    train, test = data.where(F.col("date") < cut), data.where(F.col("date") >= cut)
    out = test
    for name, pipe in _models(max_iter, "trips").items():
        if name in models:
            out = pipe.fit(train).transform(out).drop("features", *[f"{c}_{s}" for c in CATEGORIES for s in "iv"])
    return out.select("date", "trips", *[F.col(c).alias(f"pred_{n}") for n, c in BASELINES.items()], *[f"pred_{m}" for m in models])


def scores(pred: DataFrame) -> DataFrame:
    """MAE, RMSE and MAPE per model, one aggregate over the unpivoted predictions."""
    cols = [c for c in pred.columns if c.startswith("pred_")]
    long = pred.select("trips", *[F.col(c).cast("double").alias(c[5:]) for c in cols]).unpivot(["trips"], [c[5:] for c in cols], "model", "pred")
    err = F.col("trips") - F.col("pred")
    return long.groupBy("model").agg(F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
                                     (F.avg(F.try_divide(F.abs(err), F.abs("trips"))) * 100).alias("mape_pct"), F.count(F.lit(1)).alias("n"))
