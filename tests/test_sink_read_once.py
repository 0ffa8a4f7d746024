"""The fold metrics sink makes the predictions once, for its metrics and its identity."""

from __future__ import annotations

from pyspark.sql import functions as F

import __spark_entry__ as entry
from panelwell.registry import frames, manifests


def test_sink_makes_predictions_once(spark, monkeypatch):
    p1 = (F.col("id") % 7) / 10.0
    rows = spark.range(0, 40).select(
        (F.col("id") % 2).cast("int").alias("fold_index"), F.col("id").alias("survey_response_id"), (F.col("id") % 5).alias("app_user_id"),
        (F.col("id") % 3 == 0).cast("int").alias("y_true"), (1 - p1).alias("prob_class_0"), p1.alias("prob_class_1"),
    )
    made, read = [], []
    identity = manifests.fold_identity
    monkeypatch.setattr(frames, "predictions", lambda spark, sf: (made.append(sf), rows)[1])
    monkeypatch.setattr(frames, "master", lambda spark, sf: rows)
    monkeypatch.setattr(frames, "in_all", lambda spark, sf: 40)
    monkeypatch.setattr(manifests, "fold_identity", lambda cohort, tested: (read.append(tested), identity(cohort, tested))[1])
    got = entry.queries()["sink_fold_metrics"](spark, "nowhere").collect()
    assert len(made) == 1 and "Range (" not in read[0]._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["fold_index"], r["test_n_responses"]) for r in got) == [(0, 20), (1, 20)]
