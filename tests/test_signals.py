"""The signal features against plain NumPy forms."""

import math

import numpy as np
import pytest

import plain_signals
from panelwell.operators.catch22 import NAMES, catch22_features


def series():
    rng = np.random.default_rng(5)
    made = [rng.normal(size=n) for n in (3, 4, 5, 8, 12, 17, 31, 32, 33, 64, 90)]
    t = np.arange(72)
    made += [np.sin(t / 4) + rng.normal(size=72) / 5, np.cumsum(rng.normal(size=72)), t * 1.0, (t % 24 > 16) * 500.0]
    made += [rng.poisson(0.4, size=48) * 100.0, rng.exponential(size=40), np.r_[np.zeros(30), 1.0], -np.r_[np.zeros(30), 1.0]]
    return [[float(v) for v in s] for s in made]


def test_signal_features_equal_plain_forms(spark):
    rows = list(enumerate(series()))
    df = spark.createDataFrame(rows, "survey_response_id int, step array<double>").repartition(4)
    got = {r["survey_response_id"]: r.asDict() for r in catch22_features(df, ["step"], fill_value=-7.0).collect()}
    assert len(got) == len(rows)
    wrong = []
    for i, values in rows:
        y = np.array(values)
        for name, expected in plain_signals.numeric_features((y - y.mean()) / y.std(ddof=1)).items():
            expected = expected if math.isfinite(expected) else -7.0
            if got[i][f"step__{name}"] != pytest.approx(expected, rel=1e-7, abs=1e-9):
                wrong.append((i, len(values), name, got[i][f"step__{name}"], expected))
    assert not wrong


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 4.0])], "survey_response_id int, step array<double>")
    plan = catch22_features(df, ["step"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and len(NAMES) == 22
