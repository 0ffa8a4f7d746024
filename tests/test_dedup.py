import random

from pyspark.sql import functions as F

from panelwell.functions.timegrid import MICROS_PER_MINUTE
from panelwell.operators import dedup, ordered
from panelwell.session import GROUP_ROWS_KEY

RESPONSE = "id bigint, app_user_id bigint, timestamp timestamp_ntz, survey_id int"
ANSWER = "id bigint, survey_response_id bigint, question_id int, answer string"


def test_hand_case(spark, ts):
    rows = [(1, 1, "10:00"), (2, 1, "10:02"), (3, 1, "10:12"), (4, 2, "10:00"), (5, 2, "10:01"), (6, 3, "10:00"), (7, 3, "10:05")]
    responses = spark.createDataFrame([(i, u, ts(f"2026-01-01 {t}:00"), 0) for i, u, t in rows], RESPONSE)
    given = [(i, 2, "3") for i in (1, 2, 3, 4)] + [(5, 2, "4")]  # user 3 answered nothing: equal maps
    answers = spark.createDataFrame([(n, *g) for n, g in enumerate(given)], ANSWER)
    kept, left = dedup.dedup_responses(responses, answers)
    assert sorted(r["id"] for r in kept.collect()) == [1, 3, 4, 5, 6]
    assert sorted(r["survey_response_id"] for r in left.collect()) == [1, 3, 4, 5]


def greedy(rows, gap):
    kept, anchor, mark = [], {}, {}
    for t, i, u, f in sorted(rows):
        if u in anchor and t - anchor[u] <= gap and mark[u] == f:
            continue
        anchor[u], mark[u] = t, f
        kept.append(i)
    return sorted(kept)


def test_long_runs_by_jumps_equal_the_greedy_pass(spark, monkeypatch, tiny_groups):
    draw = random.Random(1)
    gap = 10 * MICROS_PER_MINUTE
    rows, t = [], 0
    for i in range(140):
        # user 1 sends the same answers in one long burst; some rows share a time
        t += draw.choice([0, 0, gap // 3, gap // 2, gap, draw.randint(1, gap)])
        rows.append((t, i, 1, "a"))
    rows += [(draw.randint(0, 20 * gap), 500 + i, 2, draw.choice("ab")) for i in range(60)]
    responses = spark.createDataFrame([(i, u, t) for t, i, u, _ in rows], "id bigint, app_user_id bigint, t bigint").select(
        "id", "app_user_id", F.timestamp_micros("t").cast("timestamp_ntz").alias("timestamp")
    )
    answers = spark.createDataFrame([(i, i, 2, f) for _, i, _, f in rows], ANSWER)
    expected = greedy(rows, gap)
    monkeypatch.setattr(dedup, "FOLD_ROWS", 5)
    assert sorted(r["id"] for r in dedup.kept_responses(responses, answers).collect()) == expected
    monkeypatch.setattr(dedup, "FOLD_ROWS", 10_000)
    assert sorted(r["id"] for r in dedup.kept_responses(responses, answers).collect()) == expected


def test_a_burst_inside_one_gap_is_spread_over_segments(spark, monkeypatch):
    gap, n = 10 * MICROS_PER_MINUTE, 100_000
    # one user's copies: all of them inside one gap, then a few later ones
    times = [i * 1000 for i in range(n)] + [gap + 5, 2 * gap + 6, 2 * gap + 7]
    responses = spark.range(n + 3).select(
        "id", F.lit(7).cast("bigint").alias("app_user_id"),
        F.timestamp_micros(F.when(F.col("id") < n, F.col("id") * 1000).otherwise(F.element_at(F.array(*map(F.lit, times[n:])), (F.col("id") - n + 1).cast("int")))).cast("timestamp_ntz").alias("timestamp"),
    )
    answers = spark.createDataFrame([], ANSWER)
    sizes = []

    def watched(df, group, order, segments):
        out = segmented(df, group, order, segments)
        sizes.append(out.groupBy(ordered.SEGMENT).count().agg(F.max("count")).first()[0])
        return out

    segmented = ordered.range_segments
    monkeypatch.setattr(ordered, "range_segments", watched)
    spark.conf.set(GROUP_ROWS_KEY, "20000")
    try:
        kept = sorted(r["id"] for r in dedup.kept_responses(responses, answers).collect())
    finally:
        spark.conf.unset(GROUP_ROWS_KEY)
    assert kept == greedy([(t, i, 7, "") for i, t in enumerate(times)], gap)
    # positions, runs and successors: none of the passes has more in a segment than a task may order
    assert len(sizes) == 3 and max(sizes) <= 20_000
