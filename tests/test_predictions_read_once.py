"""Queries that read the predictions twice make them once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from panelwell.registry import frames


@pytest.mark.parametrize("name", ["apply_threshold", "average_rank", "fold_breakdown"])
def test_predictions_are_made_once(spark, monkeypatch, name):
    p1 = (F.col("id") % 7) / 10.0
    rows = spark.range(0, 40).select(
        (F.col("id") % 2).cast("int").alias("fold_index"), F.col("id").alias("survey_response_id"), (F.col("id") % 5).alias("app_user_id"),
        (F.col("id") % 3 == 0).cast("int").alias("y_true"), (1 - p1).alias("prob_class_0"), p1.alias("prob_class_1"),
    )
    monkeypatch.setattr(frames, "predictions", lambda spark, sf: rows)
    monkeypatch.setattr(frames, "in_all", lambda spark, sf: 40)
    made = entry.queries()[name](spark, "nowhere")
    assert "Range (" not in made._jdf.queryExecution().executedPlan().toString()
    assert made.count() == (2 if name == "fold_breakdown" else 40)
