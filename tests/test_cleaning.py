from pyspark.sql import functions as F

from panelwell.functions.answers import coerce_answer
from panelwell.operators import cleaning
from panelwell.sources.tables import modality_union

STEP = "id bigint, app_user_id bigint, start_timestamp timestamp_ntz, end_timestamp timestamp_ntz, steps double, app_source string"


def sensors(spark, ts, rows, value="steps", modality="step"):
    df = spark.createDataFrame([(i, u, ts(a), ts(b), v, s) for i, (u, a, b, v, s) in enumerate(rows)], STEP.replace("steps", value))
    return modality_union({modality: (df, value)})


def test_steps_keep_one_row_per_record_with_duration(spark, ts):
    df = sensors(spark, ts, [
        (26, "2026-01-01 10:00:00", "2026-01-01 10:05:00", 10.0, "Health"),
        (1, "2026-01-01 10:00:00", "2026-01-01 10:00:00", 5.0, "iPhone"),
        (22, "2026-01-01 10:00:00", "2026-01-01 10:05:00", 7.0, "com.Android.fit"),
        (1, "2026-01-01 11:00:00", "2026-01-01 11:05:00", 3.0, "iPhone"),
        (1, "2026-01-01 11:00:00", "2026-01-01 11:05:00", 3.0, "iPhone"),
    ])
    got = sorted((r["app_user_id"], r["id"], r["app_source"]) for r in cleaning.clean_steps(df).collect())
    assert got == [(1, 3, "iPhone"), (26, 0, "Apple Watch")]


def test_zero_duration_without_steps_and_unknown_source_stay(spark, ts):
    df = sensors(spark, ts, [
        (22, "2026-01-01 10:00:00", "2026-01-01 10:00:00", 0.0, None),
    ])
    assert cleaning.clean_steps(df).count() == 1


def test_distances_lose_points_and_copies(spark, ts):
    df = sensors(spark, ts, [
        (5, "2025-10-01 10:00:00", "2025-10-01 10:00:00", 0.0, "a"),
        (5, "2025-08-01 10:00:00", "2025-08-01 10:05:00", 1.0, "a"),
        (5, "2025-10-01 10:00:00", "2025-10-01 10:05:00", 1.0, "a"),
        (5, "2025-10-01 10:00:00", "2025-10-01 10:05:00", 1.0, "a"),
        (6, "2025-10-01 10:00:00", "2025-10-01 10:05:00", 1.0, "a"),
    ], "distance", "distance")
    assert sorted(r["id"] for r in cleaning.clean_distance(df).collect()) == [2, 4]


def test_enrollment_uses_all_surveys_only_if_none_is_daily(spark, ts):
    rows = [(1, 9, ts("2026-01-10 00:00:00"), 2), (2, 9, ts("2026-01-20 00:00:00"), 0)]
    schema = "id int, app_user_id bigint, timestamp timestamp_ntz, survey_id int"
    both = cleaning.enrollment_windows(spark.createDataFrame(rows, schema)).first()
    assert both["window_start"] == ts("2026-01-13 00:00:00") and both["window_end"] == ts("2026-01-21 00:00:00")
    only = cleaning.enrollment_windows(spark.createDataFrame(rows[:1], schema)).first()
    assert only["window_start"] == ts("2026-01-03 00:00:00")


def test_exclusion_of_nobody_keeps_all(spark):
    df = spark.createDataFrame([(1,), (5,)], "app_user_id bigint")
    assert cleaning.exclude_users(df, []).count() == 2
    assert [r[0] for r in cleaning.exclude_users(df).collect()] == [5]


def test_os_classes(spark, ts):
    span = ("2026-01-01 10:00:00", "2026-01-01 10:05:00")
    df = sensors(spark, ts, [
        (1, *span, 1.0, "iPhone 13"), (2, *span, 1.0, "androidx.health"), (3, *span, 1.0, "iPhone"), (3, *span, 1.0, "androidx"), (4, *span, 1.0, None),
    ])
    got = {r["app_user_id"]: r["os"] for r in cleaning.os_class(df).collect()}
    assert got == {1: "ios", 2: "android", 3: "both", 4: "both"}
    device = {r["app_user_id"]: tuple(r)[1:] for r in cleaning.device_source_onehot(df).collect()}
    assert device[3] == (0.0, 1.0, 0.0, 0.0) and device[4] == (0.0, 0.0, 0.0, 1.0)


def test_copies_without_ids_keep_their_columns(spark, ts):
    rows = [(7, "step", ts("2024-03-01T08:10:00"), ts("2024-03-01T08:20:00"), 11.0, "Health")] * 2
    df = spark.createDataFrame(rows, "app_user_id long, modality string, start_timestamp timestamp_ntz, end_timestamp timestamp_ntz, value double, app_source string")
    assert [tuple(r)[:2] for r in cleaning.drop_duplicates_first(df).collect()] == [(7, "step")]
    with_null = df.withColumn("id", F.lit(None).cast("bigint"))
    assert [r["modality"] for r in cleaning.drop_duplicates_first(with_null).collect()] == ["step"]


def test_only_plain_numbers_are_answers(spark):
    texts = ["1d", "2.5", " 3e1 ", "0x1", "NaN", "yes", "No", "-.5"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = [r["n"] for r in df.select("i", coerce_answer(F.col("t")).alias("n")).orderBy("i").collect()]
    assert found == [None, 2.5, 30.0, None, None, 1.0, 0.0, -0.5]
