"""Statistics of scaled windows come from unscaled ones, and inner fits read their own fold's folder."""

import pytest
from pyspark.sql import functions as F

from panelwell.operators import model, search
from panelwell.operators.features import summary_stats
from panelwell.operators.scaling import class_weights, dual_scale_packed, dual_scale_stats, with_class_weights


@pytest.fixture()
def fold_rows(spark):
    rows = [(f, "train" if i % 4 else "test", i, i % 5 if i != 7 else None) for f in (0, 1) for i in range(24)]
    rows += [(0, "val", 3, 77), (1, "test", 24, 9)]
    return spark.createDataFrame(rows, "fold_index int, role string, survey_response_id long, app_user_id long")


@pytest.fixture()
def windows(spark):
    arrays = [([float((i * 7 + b * b) % 11) for b in range(6)], [5.0] * 6 if i % 3 else [float(b) for b in range(5)]) for i in range(23)]
    rows = [(i, *a) for i, a in enumerate(arrays)] + [(23, [], [1.0, None]), (24, None, [float("nan"), 2.0])]
    return spark.createDataFrame(rows, "survey_response_id long, step array<double>, distance array<double>")


def test_scaled_statistics_equal_those_of_scaled_windows(fold_rows, windows):
    channels, keys = ["distance", "step"], ["fold_index", "role", "survey_response_id", "app_user_id"]
    packed, names = dual_scale_packed(fold_rows, windows, channels)
    expected = summary_stats(packed, names, keep=keys)
    got, columns = dual_scale_stats(fold_rows, windows, channels)
    assert [*keys, *columns] == expected.columns
    read = lambda df: sorted((tuple(r) for r in df.select(*keys, *columns).collect()), key=repr)
    left, right = read(got), read(expected)
    assert len(left) == len(right) > 40
    for a, b in zip(sorted(left, key=lambda r: str(r[:4])), sorted(right, key=lambda r: str(r[:4]))):
        assert a[:4] == b[:4]
        for x, y in zip(a[4:], b[4:]):
            assert (x is None) == (y is None)
            assert x is None or x == pytest.approx(y, abs=1e-9, nan_ok=True)


def test_statistics_are_made_before_the_folds(fold_rows, windows):
    made, _ = dual_scale_stats(fold_rows, windows, ["step"])
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    above = plan[:plan.index("Join")]
    assert "array_sort" not in above and "transform(" not in above


def test_weights_of_all_outer_folds_come_from_one_aggregation(spark):
    rows = spark.createDataFrame([(f, "train" if i % 3 else "test", i % (2 + f)) for f in range(3) for i in range(30)], "fold_index int, role string, answer int")
    rows = rows.filter("NOT (fold_index = 2 AND role = 'train')")
    weights = search.balanced_weights(rows, [0, 1, 2])
    for fold in range(3):
        own = rows.filter(F.col("fold_index") == fold).withColumn("features", F.array(F.lit(1.0)))
        got = model.prepared(own, weight=weights[fold]).select("answer", "weight")
        expected = with_class_weights(own).select("answer", "weight")
        assert got.schema["answer"].dataType == expected.schema["answer"].dataType
        assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))
    assert class_weights(rows).count() == 4
