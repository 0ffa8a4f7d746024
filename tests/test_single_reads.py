import datetime

from pyspark.sql import functions as F

from panelwell.operators.labels import coerced_answers, question_filter
from panelwell.operators.ordered import ordered_columns
from panelwell.operators.splits import walk_forward_cyclic
from panelwell.session import GROUP_ROWS_KEY
from panelwell.sources import study


def test_cyclic_folds_read_their_rows_once(spark):
    rows = spark.range(60).selectExpr(
        "id AS survey_response_id", "CASE WHEN id < 3 THEN NULL ELSE id % 4 END AS app_user_id",
        "TIMESTAMP_NTZ'2024-01-01' + make_dt_interval(0, cast(id * 5 AS int)) AS record_timestamp",
    )
    near = walk_forward_cyclic(rows, 0.8, 0.2, 24.0, max_group=100)
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Range (0, 60") == 1
    spark.conf.set(GROUP_ROWS_KEY, "4")
    try:
        far = walk_forward_cyclic(rows, 0.8, 0.2, 24.0).collect()
    finally:
        spark.conf.unset(GROUP_ROWS_KEY)
    found = near.collect()
    assert found and sorted(found) == sorted(far)
    assert all(r["app_user_id"] is not None for r in found)


def test_answers_read_their_properties_once(spark, tmp_path):
    events = [(i, datetime.datetime(2024, 1, 1), i % 3, "signup" if i % 2 else "view", 1.0, f'{{"k": {i}}}') for i in range(40)]
    spark.createDataFrame(events, study.EVENTS).write.parquet(f"{tmp_path}/events.parquet")
    coerced = coerced_answers(question_filter(study.answer(spark, str(tmp_path)), (2, 8)))
    assert coerced._jdf.queryExecution().optimizedPlan().toString().count("get_json_object") == 1
    assert {r["survey_response_id"] for r in coerced.collect()} <= {i for i in range(40) if i % 2}
    assert coerced.count() > 20


def test_a_bound_that_does_not_fit_reads_the_rows_once(spark):
    spark.conf.set(GROUP_ROWS_KEY, "50")
    try:
        seen = spark.sparkContext.accumulator(0)

        def look(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        rows = spark.range(40, numPartitions=2).selectExpr("id", "id % 2 AS g").mapInArrow(look, "id long, g long")
        placed = ordered_columns(rows, ["g"], [F.col("id")], position="p", max_group=1000).collect()
    finally:
        spark.conf.unset(GROUP_ROWS_KEY)
    assert sorted(r["p"] for r in placed) == sorted([*range(20), *range(20)])
    assert seen.value == 40
