"""The windows of catch22 are dealt to all cores; outlier timing judges each set of values once."""

from __future__ import annotations

import random
import statistics

from pyspark.sql import functions as F

from panelwell.operators.catch22 import catch22_features
from panelwell.operators.signals import outlier_timing


def test_windows_of_one_task_are_dealt_to_all_cores(spark):
    rows = [(i, [float((i * k) % 7) for k in range(12)]) for i in range(64)]
    df = spark.createDataFrame(rows, "survey_response_id long, step array<double>").coalesce(1)
    made = catch22_features(df, ["step"])
    at = made.select(F.spark_partition_id().alias("p")).distinct().count()
    assert at > 1 and made.count() == 64


def plain(z: list[float], sign: int) -> float | None:
    """Every threshold by itself."""
    side = [v * sign for v in z]
    if max(side) < 0.01:
        return 0.0
    n_side, found, k = sum(v >= 0 for v in side), [], 0
    while k <= int(max(side) / 0.01):
        beyond = [i + 1.0 for i, v in enumerate(side) if v >= k * 0.01]
        if len(beyond) >= 2 and (len(beyond) - 1) * 100 / n_side > 2:
            found.append(statistics.median(beyond) / (len(side) / 2) - 1)
        k += 1
    return statistics.median(found) if found else None


def test_outlier_timing_equals_every_threshold_by_itself(spark):
    draw = random.Random(3)
    series = [[draw.gauss(0, 1) for _ in range(n)] for n in (3, 12, 12, 60)]
    # values on the thresholds themselves, where quotients are rounded, and repeated ones
    series += [[k * 0.01 for k in range(-40, 230, 7)], [0.29, 0.57, 0.58, 1.13, 1.15, 0.29, -0.07], [0.0, 0.0, -1.0], [0.5, 0.5, 0.5, -1.5]]
    df = spark.createDataFrame(list(enumerate(series)), "i int, z array<double>")
    got = {r["i"]: (r["p"], r["n"]) for r in df.select("i", outlier_timing(F.col("z"), 1).alias("p"), outlier_timing(F.col("z"), -1).alias("n")).collect()}
    for i, z in enumerate(series):
        for value, expected in zip(got[i], (plain(z, 1), plain(z, -1))):
            assert (value is None) == (expected is None) and (value is None or abs(value - expected) < 1e-12), (z, value, expected)
