import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwell.operators.cleaning import clip_by_fold, fold_upper_quantiles

AT = datetime.datetime(2026, 1, 1)
SENSOR = "app_user_id bigint, modality string, start_timestamp timestamp_ntz, value double"
FOLD = "fold_index int, role string, app_user_id bigint, record_timestamp timestamp_ntz"


def hours(n):
    return AT + datetime.timedelta(hours=n)


def study():
    rng = np.random.default_rng(3)
    sensors = [(u, m, hours(h), float(rng.integers(0, 40))) for u in range(4) for m in ("step", "distance") for h in range(0, 400, 3)]
    sensors += [(0, "step", hours(5), None), (9, "step", hours(5), 1e9)]
    folds = []
    for f, (a, b) in enumerate(((300, 390), (150, 200), (0, 60))):
        for u in range(3):
            folds += [(f, "test" if a <= h <= b else "train", u, hours(h)) for h in range(0, 400, 10)]
    # user 3 is tested only in fold 0 and trains whole in fold 1
    folds += [(0, "test", 3, hours(200)), (1, "train", 3, hours(350))]
    return sensors, folds


def plain(sensors, folds, q, lookback):
    limits = {}
    for f in {x[0] for x in folds}:
        for m in {x[1] for x in sensors}:
            values = []
            for u, modality, t, v in sensors:
                train = [x[3] for x in folds if x[:3] == (f, "train", u)]
                test = [x[3] for x in folds if x[:3] == (f, "test", u)]
                held = test and min(test) - datetime.timedelta(hours=lookback) <= t <= max(test)
                if modality == m and v is not None and train and t < max(train) and not held:
                    values.append(v)
            if values:
                limits[f, m] = float(np.quantile(values, q))
    return limits


def found(spark, sensors, folds, q=0.9, lookback=24.0):
    made = fold_upper_quantiles(spark.createDataFrame(sensors, SENSOR), spark.createDataFrame(folds, FOLD), q, lookback)
    return {(r["fold_index"], r["modality"]): r["upper"] for r in made.collect()}


def test_limits_equal_plain_quantiles_of_training_rows(spark):
    sensors, folds = study()
    assert found(spark, sensors, folds) == pytest.approx(plain(sensors, folds, 0.9, 24.0))


def test_segmented_groups_give_the_same_limits(spark, tiny_groups):
    sensors, folds = study()
    assert found(spark, sensors, folds) == pytest.approx(plain(sensors, folds, 0.9, 24.0))


def test_no_test_row_shapes_a_limit(spark):
    sensors, folds = study()
    # all that the test surveys of fold 1 can look at becomes enormous, and so does a user who only tests in fold 0
    def spoilt(f, rows):
        for u, m, t, v in rows:
            held = u < 3 and hours(150 - 24) <= t <= hours(200) if f == 1 else u == 3
            yield u, m, t, 1e12 if held else v

    base = found(spark, sensors, folds)
    for f in (0, 1):
        changed = found(spark, list(spoilt(f, sensors)), folds)
        assert {m: changed[f, m] for m in ("step", "distance")} == {m: base[f, m] for m in ("step", "distance")}


def test_clipped_rows_and_empty_tables(spark):
    sensors, folds = study()
    df = spark.createDataFrame(sensors, SENSOR)
    limits = fold_upper_quantiles(df, spark.createDataFrame(folds, FOLD), 0.9, 24.0)
    clipped = clip_by_fold(df, limits)
    assert clipped.count() == 3 * len(sensors) and clipped.filter("value is null").count() == 3
    assert clipped.join(limits, ["fold_index", "modality"]).filter(F.col("value") > F.col("upper")).isEmpty()
    assert fold_upper_quantiles(df.limit(0), spark.createDataFrame(folds, FOLD)).isEmpty()
    assert fold_upper_quantiles(df, spark.createDataFrame([], FOLD)).isEmpty()
