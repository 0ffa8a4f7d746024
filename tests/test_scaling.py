"""Scaling of packed windows."""

import pytest

from panelwell.operators.scaling import dual_scale_packed


def test_packed_windows_are_scaled_twice(spark):
    windows = spark.createDataFrame(
        [(1, [1.0, 3.0]), (2, [5.0, 7.0]), (3, [10.0, 20.0]), (4, [4.0, 4.0]), (5, None)], "survey_response_id long, step array<double>"
    )
    rows = spark.createDataFrame(
        [(0, "train", 1, 1), (0, "train", 1, 2), (0, "test", 2, 3), (0, "test", 3, 4), (0, "test", 4, 9)],
        "fold_index int, role string, app_user_id long, survey_response_id long",
    )
    made, names = dual_scale_packed(rows, windows, ["step"])
    assert names == ["global_step", "subject_step"]
    got = {r["survey_response_id"]: r for r in made.collect()}
    spread = 5 ** 0.5  # of 1, 3, 5, 7
    assert set(got) == {1, 2, 3, 4}  # a row without a window is left out
    assert got[1]["global_step"] == pytest.approx([-3 / spread, -1 / spread]) == got[1]["subject_step"]
    assert got[3]["global_step"] == pytest.approx([6 / spread, 16 / spread])
    # participants without train rows use their own windows; one without spread is only centred
    assert got[3]["subject_step"] == pytest.approx([-1, 1]) and got[4]["subject_step"] == pytest.approx([0, 0])
    empty, _ = dual_scale_packed(rows.limit(0), windows, ["step"])
    assert empty.count() == 0
