"""Tree models of forward returns with pyspark.ml."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.evaluate import pct_rank


def train_and_predict(panel: DataFrame, features: Sequence[str], label: str, train_end: str, date: str = "date", trees: int = 300, depth: int = 3, seed: int = 7) -> tuple[DataFrame, dict[str, float]]:
    """Predictions for all rows by gradient-boosted trees fit up to ``train_end``, their rank by date less one half, and feature importances.

    Missing features take the training median, then zero.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    train = panel.where((F.col(date) <= F.lit(train_end).cast("date")) & F.col(label).isNotNull())
    some = train.agg(*[F.count(f).alias(f) for f in features]).first()
    used = [f for f in features if some[f]]  # a column without values has no median
    filled = [f"_{f}" for f in features]
    frame = lambda df: df.select("*", *[F.lit(0.0).alias(f"_{f}") for f in features if f not in used])
    stages = [Imputer(inputCols=used, outputCols=[f"_{f}" for f in used], strategy="median")] if used else []
    model = Pipeline(stages=[*stages, VectorAssembler(inputCols=filled, outputCol="_x"), GBTRegressor(featuresCol="_x", labelCol=label, predictionCol="prediction", maxIter=trees, maxDepth=depth, seed=seed)]).fit(frame(train))
    out = model.transform(frame(panel)).drop("_x", *filled)
    return out.withColumn("prediction_rank", pct_rank(F.col("prediction"), date) - 0.5), dict(zip(features, model.stages[-1].featureImportances.toArray().tolist()))


def importance_by_correlation(predictions: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, importance): absolute correlation of each feature with the prediction."""
    from tidewell.operators.evaluate import correlation

    long = predictions.unpivot(["prediction"], list(features), "feature", "x")
    return long.groupBy("feature").agg(F.abs(correlation(F.col("x"), F.col("prediction"))).alias("importance"))
