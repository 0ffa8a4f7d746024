import datetime

import pytest
from pyspark.sql import functions as F

from panelwell.plans.walk_forward import fold_matrix

START = datetime.datetime(2026, 1, 1)


@pytest.mark.parametrize("scaled", [False, True])
def test_fold_rows_and_windows_are_not_broadcast(spark, scaled):
    settings = F.explode(F.array(F.lit(24.0), F.lit(48.0)))
    rows = [(f, "train" if (i + f) % 3 else "test", i, i % 2, START, i % 2) for i in range(12) for f in range(2)]
    folds = spark.createDataFrame(rows, "fold_index int, role string, survey_response_id bigint, app_user_id bigint, record_timestamp timestamp_ntz, answer int")
    windows = spark.createDataFrame([(i, [float(i), 1.0], [2.0, float(-i)]) for i in range(12)], "survey_response_id bigint, a array<double>, b array<double>")
    made = fold_matrix(windows.withColumn("lookback_hours", settings), folds.withColumn("lookback_hours", settings), ("a", "b"), "stats", scaled, setting=["lookback_hours"])
    assert len(made.collect()) == 48
    plan = made._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.split("Initial Plan")[0].splitlines() if "Join" in line and "survey_response_id" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
