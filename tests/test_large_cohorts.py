import random

import pytest
from pyspark.sql import functions as F

from panelwell.operators import bootstrap, weightings
from panelwell.operators.metrics import binary_metrics, score_table
from panelwell.operators.weightings import score_segments, weighted_metrics
from panelwell.session import BROADCAST_ROWS_KEY


@pytest.fixture(scope="module")
def predictions(spark):
    draw = random.Random(3)
    rows = [(u if u else None, draw.randrange(2) if u % 5 else 1, draw.choice([None, float("nan"), 0.1, 0.3, 0.5, 0.7, 0.9, 1.0])) for u in range(12) for _ in range(u + 1)]
    return spark.createDataFrame(rows, "app_user_id bigint, y_true int, prob_class_1 double").localCheckpoint()


def exact(rows):
    return sorted(tuple("nan" if v != v else v if v is None or isinstance(v, int) else round(v, 10) for v in r) for r in map(tuple, rows))


def test_draws_are_not_broadcast_whatever_their_estimate(spark, predictions):
    weights = bootstrap.bootstrap_weights(predictions, 20)
    rows = bootstrap.rows_by_user_resample(predictions, weights)
    weights.collect()
    assert "Broadcast" not in weights._jdf.queryExecution().executedPlan().toString()
    rows.collect()
    assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()


def test_resampled_vectors_equal_multiplied_rows(spark, predictions):
    weights = bootstrap.bootstrap_weights(predictions, 20).localCheckpoint()
    multiplied = score_table(predictions.join(weights, "app_user_id"), ["replicate"], weight="weight")
    key = lambda rows: sorted(map(repr, map(tuple, rows)))
    expected = key(multiplied.select("replicate", "score", "pos", "neg").collect())
    for bound in (None, 300):
        assert key(bootstrap.rows_by_user_resample(predictions, weights, bound).collect()) == expected


def test_left_out_sets_of_short_and_long_curves_are_equal(spark, predictions):
    short = bootstrap.jackknife(predictions)
    spark.conf.set(BROADCAST_ROWS_KEY, "2")
    try:
        long = bootstrap.jackknife(predictions)
    finally:
        spark.conf.unset(BROADCAST_ROWS_KEY)
    assert short.schema == long.schema
    found = short.orderBy("left_out").collect()
    assert len(found) == 12
    for a, b in zip(found, long.orderBy("left_out").collect(), strict=True):
        assert a.asDict() == pytest.approx(b.asDict())


def test_the_driver_keeps_no_sums_of_earlier_blocks(spark, predictions, monkeypatch):
    monkeypatch.setattr(weightings, "BLOCK", 3)
    kept = []
    broadcast = spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda v: kept.append(broadcast(v)) or kept[-1])
    own = score_table(predictions.dropna(subset=["app_user_id"]), ["app_user_id"]).withColumn("entries", F.array(F.col("app_user_id").cast("int")))
    made = weighted_metrics(score_segments(own), 12, "left_out", base=1, step=-1).collect()
    assert len(made) == 12 and len(kept) == 4
    assert all(b._jbroadcast is not None and not b._jbroadcast.isValid() for b in kept)
    whole = binary_metrics(score_table(predictions.filter("app_user_id != 7"))).first()
    assert next(r for r in made if r["left_out"] == 7)["n_predictions"] == whole["n_predictions"]
