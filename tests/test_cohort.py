"""The cohort build on tables with text times, and without enrolment windows."""

from panelwell.operators import cleaning
from panelwell.plans.cohort import CohortSettings, StudyTables, build_cohort, clean_sensors

SENSOR = "id bigint, app_user_id bigint, modality string, start_timestamp timestamp_ntz, end_timestamp timestamp_ntz, value double, app_source string"
ANSWER = "id bigint, survey_response_id bigint, question_id int, answer string"


def sensors(spark, ts):
    days = ("2025-01-05", "2025-09-10", "2026-01-01", "2026-03-01")
    rows = [(i, 1, "heart", ts(f"{d} 10:00:00"), ts(f"{d} 10:05:00"), 60.0, "iPhone 13") for i, d in enumerate(days)]
    return spark.createDataFrame(rows, SENSOR)


def test_without_windows_the_study_start_counts(spark, ts):
    none = spark.createDataFrame([], "id bigint, app_user_id bigint, timestamp timestamp_ntz, survey_id int")
    tables = StudyTables(sensors(spark, ts), none, spark.createDataFrame([], ANSWER))
    settings = CohortSettings(preprocessors={}, exclude=(), study_start="2025-09-01")
    assert sorted(r["id"] for r in clean_sensors(tables, settings).collect()) == [1, 2, 3]
    some = spark.createDataFrame([(1, 1, ts("2026-01-01 08:00:00"), 0)], none.schema)
    windows = cleaning.enrollment_windows(some)
    assert [r["id"] for r in cleaning.restrict_to_study(sensors(spark, ts), windows, "2025-09-01").collect()] == [2]
    # a user without a window keeps nothing as long as others have one
    assert cleaning.restrict_to_study(sensors(spark, ts).replace(1, 2, ["app_user_id"]), windows).count() == 0


def test_survey_times_may_be_text(spark, ts):
    responses = spark.createDataFrame(
        [(1, 1, "2026-01-01 08:00:00", 0), (2, 1, "2026-01-01 20:00:00", 1), (3, 1, "no time", 0)],
        "id bigint, app_user_id bigint, timestamp string, survey_id int",
    )
    question = CohortSettings().rules[0].ids[0]
    answers = spark.createDataFrame([(i, i, question, str(i)) for i in (1, 2)], ANSWER)
    settings = CohortSettings(preprocessors={}, exclude=(), os=None)
    cohort = build_cohort(StudyTables(sensors(spark, ts), responses, answers), settings)
    got = sorted((r["survey_response_id"], r["record_timestamp"]) for r in cohort.master.collect())
    assert got == [(1, ts("2026-01-01 08:00:00")), (2, ts("2026-01-01 20:00:00"))]
    assert [r["id"] for r in cohort.sensors.collect()] == [2]
