import datetime

import pytest

from panelwell.operators import features, windows
from panelwell.operators.windows import OffsetSampler, RollingSampler

SENSOR = "id bigint, app_user_id bigint, modality string, start_timestamp timestamp_ntz, end_timestamp timestamp_ntz, value double"
MASTER = "survey_response_id bigint, app_user_id bigint, record_timestamp timestamp_ntz"


@pytest.fixture(scope="module")
def hourly(spark):
    start = datetime.datetime(2026, 1, 1)
    hours = [start + datetime.timedelta(hours=h) for h in range(48)]
    return spark.createDataFrame([(i, 1, "step", h, h, 10.0) for i, h in enumerate(hours)], SENSOR)


def survey(spark, *rows):
    return spark.createDataFrame([(i, u, datetime.datetime.fromisoformat(t)) for i, u, t in rows], MASTER)


def test_rolling(spark, hourly):
    one = windows.sample_windows(survey(spark, (1, 1, "2026-01-02 12:30:00")), hourly, RollingSampler(12, 1), ["step"])
    rows = one.collect()
    assert len(rows) == 12 and sum(r["step"] for r in rows) == 120.0 and len(one.columns) == 4 + 5
    four = windows.packed_windows(survey(spark, (1, 1, "2026-01-02 12:30:00")), hourly, RollingSampler(12, 4), ["step"])
    assert four.first()["step"] == [40.0, 40.0, 40.0]


def test_offset(spark, hourly):
    rows = windows.sample_windows(survey(spark, (1, 1, "2026-01-02 12:30:00")), hourly, OffsetSampler(-6, 6, 1), ["step"])
    assert rows.count() == 12 and sum(r["step"] for r in rows.collect()) == 120.0 and len(rows.columns) == 4 + 3


def test_window_without_rows_is_zero(spark, hourly):
    empty = windows.packed_windows(survey(spark, (1, 9, "2026-01-02 12:30:00")), hourly, RollingSampler(12, 4), ["step"])
    assert empty.first()["step"] == [0.0, 0.0, 0.0]
    stats = features.summary_stats(empty, ["step"]).first()
    assert tuple(stats)[1:] == (0.0, 0.0, 0.0, 0.0, 0.0)


def test_misaligned_settings_are_refused():
    for bad in (lambda: RollingSampler(10, 4), lambda: OffsetSampler(-5, 7, 4), lambda: OffsetSampler(-10, 0, 5)):
        with pytest.raises(ValueError):
            bad()
    assert windows.lookback_hours(RollingSampler(72, 6)) == 72 and windows.lookback_hours(OffsetSampler(-6, 6, 1)) == 12
    assert windows.lookback_hours(None) == 0.0


def test_gate_sees_long_records_that_start_before_the_window(spark):
    at = datetime.datetime.fromisoformat
    sensors = spark.createDataFrame([
        (1, 1, "step", at("2025-01-01 00:00:00"), at("2026-01-02 01:00:00"), 1.0),  # a year long, ends inside
        (2, 2, "step", at("2026-01-01 00:00:00"), at("2026-01-01 12:00:00"), 1.0),  # ends at the window start
        (3, 3, "step", at("2026-01-02 12:00:00"), at("2026-01-02 13:00:00"), 1.0),  # starts at the window end
        (4, 4, "step", at("2026-01-02 11:59:59"), None, 1.0),  # an unknown end covers nothing
    ], SENSOR)
    surveys = survey(spark, *[(u, u, "2026-01-02 12:30:00") for u in (1, 2, 3, 4, 5)])
    kept = windows.coverage_gate(surveys, sensors, RollingSampler(24, 4))
    assert sorted(r["app_user_id"] for r in kept.collect()) == [1]
    assert windows.coverage_gate(surveys, sensors, None).count() == 5


def test_summary_stats_and_names(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0], [])], "survey_response_id bigint, step array<double>, none array<double>")
    row = features.summary_stats(df, ["step", "none"]).first().asDict()
    assert (row["step__mean"], row["step__median"], row["step__min"], row["step__max"]) == (2.5, 2.5, 1.0, 4.0)
    assert abs(row["step__std"] - 1.25**0.5) < 1e-12 and row["none__mean"] == 0.0
    with pytest.raises(ValueError, match="no such window statistics"):
        features.summary_stats(df, ["step"], ["mode"])
    assert features.feature_names(["step"], ["mean"], 2) == ["step__mean", "col1__mean"]
    with pytest.raises(ValueError, match="nothing is left"):
        features.exclude_time_columns(["a", "b"], 2)
    assert features.select_channels(["a", "b", "c", "d"], "subject", 2) == ["c", "d"]
    assert features.select_channels(["a", "b"], "global", 2) == ["a", "b"]


def test_catch22_on_short_constant_and_long_windows(spark):
    import numpy as np

    from panelwell.operators.catch22 import NAMES, catch22_features

    draw = np.random.default_rng(0)
    long = [float(v) for v in draw.normal(size=60)]
    ramp = [float(i % 7) for i in range(28)]
    data = [(1, long), (2, ramp), (3, [5.0] * 8), (4, [1.0, 2.0]), (5, [])]
    df = spark.createDataFrame(data, "survey_response_id bigint, step array<double>")
    got = {r["survey_response_id"]: r.asDict() for r in catch22_features(df, ["step"], fill_value=-1.0).collect()}
    assert len(NAMES) == 22 and all(len(r) == 23 for r in got.values())
    assert set(list(got[3].values())[1:]) == {-1.0} and set(list(got[4].values())[1:]) == {-1.0}
    assert set(list(got[5].values())[1:]) == {0.0}
    z = (np.array(long) - np.mean(long)) / np.std(long, ddof=1)
    assert abs(got[1]["step__CO_trev_1_num"] - np.mean(np.diff(z) ** 3)) < 1e-9
    assert got[1]["step__MD_hrv_classic_pnn40"] == np.mean(np.abs(np.diff(z)) * 1000 > 40)
    ac = np.correlate(z, z, "full")[59:] / (z @ z)
    first = next(i for i in range(1, 59) if ac[i] < ac[i - 1] and ac[i] < ac[i + 1])
    assert got[1]["step__CO_FirstMin_ac"] == first
    residual = [z[i + 3] - z[i : i + 3].mean() for i in range(57)]
    assert abs(got[1]["step__FC_LocalSimple_mean3_stderr"] - np.std(residual, ddof=1)) < 1e-9
    assert got[2]["step__SB_BinaryStats_diff_longstretch0"] == 1.0 and got[2]["step__SB_BinaryStats_mean_longstretch1"] == 3.0
    assert all(np.isfinite(v) for r in got.values() for v in list(r.values())[1:])
