"""The model step on Spark ML: fit per fold, score the test rows, search a small grid.

Feature rows have ``features`` (array), ``answer``, ``fold_index``, ``role``, the participant and
time columns and ``sample_id``. Folds are independent fits; the training itself is distributed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwell.functions.probabilities import softmax_pair
from panelwell.operators.scaling import with_class_weights
from panelwell.operators.splits import union_folds

COLUMNS = {"featuresCol": "vector", "labelCol": "answer", "weightCol": "weight"}


def logistic(penalty: str = "l2", strength: float = 0.01) -> Pipeline:
    if penalty not in ("l1", "l2"):
        raise ValueError(f"penalty must be 'l1' or 'l2'; got {penalty!r}")
    return Pipeline(stages=[
        LogisticRegression(elasticNetParam=1.0 if penalty == "l1" else 0.0, regParam=strength, maxIter=25, tol=1e-4, **COLUMNS)
    ])


def random_forest(trees: int = 20, depth: int = 5, seed: int = 42) -> Pipeline:
    return Pipeline(stages=[RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, **COLUMNS)])


def boosted_trees(rounds: int = 10, depth: int = 3, seed: int = 42) -> Pipeline:
    return Pipeline(stages=[GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed, **COLUMNS)])


def linear_svm(c: float = 1.0) -> Pipeline:
    """Scaled linear support vector machine; a larger ``c`` regularises less."""
    if not 0.01 <= c <= 100:
        raise ValueError(f"C must be in [0.01, 100]; got {c}")
    scaler = StandardScaler(inputCol="vector", outputCol="scaled", withMean=True, withStd=True)
    svm = LinearSVC(regParam=0.01 / c, maxIter=20, tol=1e-4, **{**COLUMNS, "featuresCol": "scaled"})
    return Pipeline(stages=[scaler, svm])


MODELS: dict[str, Callable[[], Pipeline]] = {
    "lr_l2": lambda: logistic("l2"),
    "lr_l1": lambda: logistic("l1"),
    "rf": random_forest,
    "gbt": boosted_trees,
    "svm": linear_svm,
}


def prepared(df: DataFrame, explicit_weights: Sequence[float] | None = None, weight: Column | None = None) -> DataFrame:
    """Adds ``vector`` and ``weight``: the given column, explicit weights by class, or balanced ones per fold."""
    weighted = with_class_weights(df, explicit_weights) if weight is None else df.withColumns({"answer": F.col("answer").cast("bigint"), "weight": weight})
    return weighted.withColumn("vector", array_to_vector("features"))


def scored(df: DataFrame, softmax_again: bool = False) -> DataFrame:
    """Class probabilities of a fitted pipeline's output; a model without them gets a sigmoid.

    ``softmax_again`` squeezes the values through one more softmax, which keeps their order and
    the cut at one half, for comparison with stored tables that did so.
    """
    if "probability" in df.columns:
        p1 = F.element_at(vector_to_array("probability"), 2)
    else:
        p1 = 1.0 / (1.0 + F.exp(-F.element_at(vector_to_array("rawPrediction"), 2)))
    p0 = 1.0 - p1
    if softmax_again:
        p0, p1 = softmax_pair(p0, p1)
    return df.withColumns({"prob_class_0": p0, "prob_class_1": p1})


def prediction_join_back(scores: DataFrame, samples: DataFrame, key: str = "survey_response_id") -> DataFrame:
    """Scores with the sample's participant and time. A score without a sample fails the job."""
    missing = F.raise_error(F.concat(F.lit("no sample for prediction "), F.col(key).cast("string")))
    found = samples.select(key, "app_user_id", "record_timestamp", F.lit(True).alias("__found"))
    joined = scores.join(found, key, "left")
    user = F.when(F.col("__found"), F.col("app_user_id")).otherwise(missing.cast("bigint"))
    return joined.withColumn("app_user_id", user).drop("__found")


def fit_predict_fold(df: DataFrame, fold: int, model: Callable[[], Pipeline], key: str = "survey_response_id") -> DataFrame:
    """Fits a fresh model on the fold's train rows and scores its test rows."""
    rows = prepared(df.filter(F.col("fold_index") == fold))
    # the optimiser passes over the train rows many times
    train = rows.filter("role = 'train'").select("vector", "answer", "weight").persist()
    try:
        fitted = model().fit(train)
    finally:
        train.unpersist()
    test = fitted.transform(rows.filter("role = 'test'"))
    return scored(test).select(
        F.lit(fold).alias("fold_index"), F.lit("test").alias("stage"), F.col(key), "app_user_id", "record_timestamp",
        F.col("answer").cast("int").alias("y_true"), "prob_class_0", "prob_class_1",
    )


def fit_predict(df: DataFrame, folds: Sequence[int], model: Callable[[], Pipeline], parallel: int = 4) -> DataFrame:
    """All folds, a few at a time, as one prediction table."""
    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        parts = list(pool.map(lambda f: fit_predict_fold(df, f, model), folds))
    return union_folds(parts)


def search(df: DataFrame, fold: int, strengths: Sequence[float] = (0.01, 0.1), n_inner: int = 3) -> DataFrame:
    """Grid search by AUROC on a fold's train rows, inner folds grouped by participant."""
    inner = F.pmod(F.xxhash64("app_user_id"), F.lit(n_inner)).cast("int")
    train = prepared(df.filter(F.col("fold_index") == fold)).filter("role = 'train'").withColumn("inner", inner)
    model = LogisticRegression(maxIter=15, tol=1e-4, **COLUMNS)
    grid = ParamGridBuilder().addGrid(model.regParam, list(strengths)).addGrid(model.elasticNetParam, [0.0, 1.0]).build()
    judge = BinaryClassificationEvaluator(labelCol="answer", metricName="areaUnderROC", weightCol="weight")
    tuned = CrossValidator(
        estimator=model, estimatorParamMaps=grid, evaluator=judge, numFolds=n_inner, foldCol="inner", parallelism=4
    ).fit(train.select("vector", "answer", "weight", "inner"))
    rows = [
        (float(g[model.regParam]), float(g[model.elasticNetParam]), float(a)) for g, a in zip(grid, tuned.avgMetrics)
    ]
    return df.sparkSession.createDataFrame(rows, "reg_param double, elastic_net double, auroc double")


def grid_summary(results: DataFrame) -> DataFrame:
    """Mean and sample deviation of a metric over the settings, per pipeline."""
    return results.groupBy("pipeline").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("value").alias("n_settings")
    )


def grid_heatmap(results: DataFrame, bins: Sequence[float]) -> DataFrame:
    """Lookback × bin table of mean values; the bins are fixed, so there is no extra pass."""
    return results.groupBy("lookback_hours").agg(
        *[F.avg(F.when(F.col("bin_hours") == b, F.col("value"))).alias(f"bin_{int(b)}h") for b in bins]
    )
