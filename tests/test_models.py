"""Model families on fold rows, and the nested search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwell.operators import search
from panelwell.operators.metrics import pooled_metrics
from panelwell.operators.model import MODELS, fit_predict, logistic
from panelwell.operators.newton import NewtonPipeline, newton_logistic, newton_scores

SCHEMA = "fold_index int, role string, survey_response_id long, app_user_id long, record_timestamp timestamp_ntz, answer long, features array<double>"


def make(flip=0.02, seed=1):
    import datetime

    draw = np.random.default_rng(seed)
    rows = []
    for i in range(400):
        x = draw.standard_normal(4)
        y = int(x[0] + 0.5 * x[1] + 0.3 * draw.standard_normal() > 0.5)
        rows += [(f, "test" if i % 2 == f else "train", i, i % 20, datetime.datetime(2026, 1, 1) + datetime.timedelta(hours=i), y, x.tolist()) for f in (0, 1)]
    return rows


@pytest.fixture(scope="module")
def folds(spark):
    return spark.createDataFrame(make(), SCHEMA).cache()


@pytest.mark.parametrize("kind", list(MODELS))
def test_families_learn_from_train_rows_alone(spark, folds, kind):
    got = fit_predict(folds, [0, 1], MODELS[kind]).cache()
    assert got.count() == 400 and got.filter("stage <> 'test' OR abs(prob_class_0 + prob_class_1 - 1) > 1e-9 OR prob_class_1 < 0 OR prob_class_1 > 1").count() == 0
    assert {r["metric"]: r["value"] for r in pooled_metrics(got).collect()}["auroc"] > 0.93
    # other labels of the test rows change no score
    turned = folds.withColumn("answer", F.when(F.col("role") == "test", 1 - F.col("answer")).otherwise(F.col("answer")))
    again = fit_predict(turned, [0, 1], MODELS[kind])
    both = got.alias("a").join(again.alias("b"), ["fold_index", "survey_response_id"])
    assert both.filter("abs(a.prob_class_1 - b.prob_class_1) > 1e-9 OR a.y_true = b.y_true").count() == 0


def test_logistic_scores_equal_batched_newton(folds):
    ml = fit_predict(folds, [0, 1], lambda: logistic("l2", 0.05))
    models = newton_logistic(folds, ["fold_index"], {"x": NewtonPipeline(strength=0.05)})
    newton = newton_scores(folds, models, ["fold_index"], keep=["survey_response_id"])
    both = ml.alias("a").join(newton.alias("b"), ["fold_index", "survey_response_id"])
    assert both.count() == 400 and both.filter("abs(a.prob_class_1 - b.prob_class_1) > 2e-3").count() == 0


def test_inner_splits_keep_participants_apart(folds):
    train = folds.filter("fold_index = 0 AND role = 'train'")
    seen = set()
    for inner in range(3):
        learned, judged = (
            {r[0] for r in part.select("app_user_id").distinct().collect()} for part in search.inner_rows(train, inner, 3)
        )
        assert learned and judged and not learned & judged and len(learned | judged) == 10
        assert not seen & judged
        seen |= judged
    assert len(seen) == 10


def test_search_takes_the_better_setting_and_refits(folds):
    grid = [("idle", lambda: logistic("l1", 5.0)), ("good", lambda: logistic("l2", 0.05)), ("same", lambda: logistic("l2", 0.05))]
    got = search.nested_search(folds, [0, 1], grid).cache()
    assert {(r["fold_index"], r["setting"]) for r in got.collect()} == {(0, "good"), (1, "good")}
    plain = fit_predict(folds, [0, 1], lambda: logistic("l2", 0.05))
    both = got.alias("a").join(plain.alias("b"), ["fold_index", "survey_response_id"])
    assert both.count() == 400 and both.filter("abs(a.prob_class_1 - b.prob_class_1) > 1e-12").count() == 0
    scores = search.inner_scores(folds, search.inner_splits(folds, [0, 1]), grid[1:2]).cache()
    assert scores.filter("fold_index = 0").count() == 200 and scores.groupBy("app_user_id", "fold_index").agg(F.countDistinct("inner").alias("n")).filter("n > 1").count() == 0
    ranks = [(r["fold_index"], r["inner"], r["y_true"], r["prob_class_1"]) for r in scores.collect()]
    for fold in (0, 1):
        values = []
        for inner in range(3):
            pos, neg = ([r[3] for r in ranks if r[:3] == (fold, inner, y)] for y in (1, 0))
            values.append(np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg]))
        assert got.filter(F.col("fold_index") == fold).first()["inner_auroc"] == pytest.approx(np.mean(values), abs=1e-9)


def test_search_without_a_choice(spark, folds):
    # one participant: no inner split has rows on both sides
    alone = folds.withColumn("app_user_id", F.lit(7))
    got = search.nested_search(alone, [0], search.GRIDS["lr_l2"])
    assert {(r["setting"], r["inner_auroc"]) for r in got.collect()} == {("strength=0.01", None)} and got.count() == 200
    with pytest.raises(ValueError):
        search.nested_search(alone, [0], [])
    with pytest.raises(ValueError):
        search.nested_search(alone, [0], search.GRIDS["lr_l2"], 1)
