import pytest
from pyspark.sql import functions as F

from panelwell.functions.timegrid import clock_to_hours
from panelwell.operators import labels
from panelwell.operators.labels import Rule

ANSWER = "id bigint, survey_response_id bigint, question_id int, answer string"
RESPONSE = "id bigint, app_user_id bigint, timestamp timestamp_ntz, survey_id int"


def answers(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ANSWER)


def made(spark, rows, rules, logic="any"):
    coerced = labels.coerced_answers(answers(spark, rows))
    return {r[0]: r[1] for r in labels.combine_rules(coerced, rules, logic).collect()}


def test_ge_or_any_eq(spark):
    rows = [(1, 2, "1"), (1, 5, "0"), (2, 3, "2"), (2, 8, "0"), (3, 7, "1"), (3, 12, "Yes ")]
    rules = [Rule((2, 3, 7), "ge", 2), Rule((5, 8, 12, 13), "any_eq", 1)]
    assert made(spark, rows, rules) == {1: 0, 2: 1, 3: 1}


def test_sums(spark):
    rows = [(1, 2, "2"), (1, 3, "2"), (2, 2, "3"), (2, 3, "3"), (3, 9, "1")]
    assert made(spark, rows, [Rule((2, 3), "sum_le", 5)]) == {1: 1, 2: 0, 3: 1}  # nothing answered sums to 0
    assert made(spark, rows, [Rule((2, 3), "sum", 6)]) == {1: 0, 2: 1, 3: 0}
    assert made(spark, rows, [Rule((2, 3), "mean", 2)]) == {1: 1, 2: 1, 3: 0}


def test_absent_questions_skip_the_rule(spark):
    rows = [(1, 2, "3")]
    assert made(spark, rows, [Rule((2,), "ge", 2), Rule((40,), "ge", 1)], "all") == {1: 1}
    assert made(spark, rows, [Rule((40,), "sum_le", 5)]) == {1: 0}
    with pytest.raises(ValueError, match="is not known"):
        made(spark, rows, [Rule((2,), "median", 1)])


def test_pivot_refuses_duplicates(spark):
    coerced = labels.coerced_answers(answers(spark, [(1, 2, "3"), (1, 2, "4")]))
    with pytest.raises(Exception, match="two answers"):
        labels.answers_pivot(coerced, [2]).collect()


@pytest.mark.parametrize("strategy,expected", [("mean", 3.0), ("max", 4.0), ("min", 2.0), ("first", 2.0), ("last", 4.0)])
def test_collapse(spark, ts, strategy, expected):
    responses = spark.createDataFrame(
        [(10, 1, ts("2026-03-02 17:00:00"), 1), (11, 1, ts("2026-03-02 09:00:00"), 0)], RESPONSE
    )
    rows = answers(spark, [(11, 2, "2"), (10, 2, "4"), (11, 11, "no"), (10, 11, "yes"), (11, 54, "10:00 PM"), (10, 54, "11:00 PM")])
    kept, collapsed = labels.collapse_daily(responses, rows, strategy, None, (54, 55))
    got = {r["question_id"]: (r["survey_response_id"], r["answer_num"], r["answer"]) for r in collapsed.collect()}
    assert kept.first()["id"] == 10 and kept.first()["timestamp"] == ts("2026-03-02 17:00:00")
    assert got[2][:2] == (10, expected) and got[11][1] == 1.0 and got[54] == (10, None, "11:00 PM")


def test_referent(spark, ts):
    rows = [(1, 5, "2026-03-02 09:00:00", 0), (2, 5, "2026-03-02 17:00:00", 1), (3, 5, "2026-03-03 09:00:00", 0), (4, 6, "2026-03-03 09:00:00", 0)]
    master = spark.createDataFrame(
        [(i, u, ts(t), s) for i, u, t, s in rows], "survey_response_id bigint, app_user_id bigint, record_timestamp timestamp_ntz, survey_id int"
    )
    got = {r["survey_response_id"]: (r["referent_hours"], r["is_morning"]) for r in labels.referent_window(master).collect()}
    assert got == {1: (None, 1.0), 2: (8.0, 0.0), 3: (16.0, 1.0), 4: (None, 1.0)}


def test_sleep(spark):
    rows = [
        (1, 54, "10:00 PM"), (1, 55, "07:00 AM"), (2, 54, "1:00 AM"), (2, 55, "5:00 am "), (3, 54, "8:00 PM"), (3, 55, "7:00 AM"),
        (4, 54, "9:00 PM"), (5, 54, "soon"), (5, 55, "7:00 AM"),
    ]
    got = {r[0]: (r[1], r[2]) for r in labels.sleep_hours(answers(spark, rows)).collect()}
    assert got == {1: (9.0, 1), 2: (4.0, 0), 3: (11.0, 2), 4: (None, None), 5: (None, None)}


def test_clock_text(spark):
    df = spark.createDataFrame([("12:00 AM",), ("12:30 pm",), ("13:00 PM",), ("7.5",), (None,)], "t string")
    assert [r[0] for r in df.select(clock_to_hours(F.col("t"))).collect()] == [0.0, 12.5, None, 7.5, None]


def test_rules_refuse_two_answers_to_one_question(spark):
    with pytest.raises(Exception, match="two answers"):
        made(spark, [(1, 2, "3"), (1, 2, "3")], [Rule((2,), "sum", 5)])
