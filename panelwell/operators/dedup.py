"""Removal of repeated survey responses.

Per user and survey, in time order, a response is dropped if it comes at most ``gap`` after
the last KEPT response and has the same answers. The kept response is the anchor, so a plain
lag is not enough. What a lag does tell: a response that comes more than ``gap`` after its
predecessor, or that differs from it, is always kept. Such responses start a new run, and
within a run all answers are equal, so only times matter: the first is kept, then the first
one later than ``gap`` after it, and so on.

Almost all runs have one row. Short runs are folded in one task each. A long run (a burst of
copies may hold a third of all rows) is never collected: each row's successor is found by one
ordered pass over range segments, and the rows reached from the run's start are marked by
doubling jumps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwell.functions.timegrid import MICROS_PER_MINUTE, micros
from panelwell.operators.ordered import ordered_columns
from panelwell.session import cut_lineage

#: Runs of at most this many distinct times are folded in one task.
FOLD_ROWS = 10_000


def answer_fingerprint(answers: DataFrame) -> DataFrame:
    """Per response the last raw answer to each question, as a hash of the sorted answer map.

    One response has few questions, and copies of an answer are reduced before the shuffle.
    """
    last = answers.groupBy("survey_response_id", "question_id").agg(F.max_by("answer", "id").alias("answer"))
    pairs = F.array_sort(F.collect_list(F.struct("question_id", F.coalesce("answer", F.lit("\x00")).alias("answer"))))
    return last.groupBy("survey_response_id").agg(F.sha2(F.to_json(pairs), 256).alias("fingerprint"))


def kept_responses(
    responses: DataFrame, answers: DataFrame, gap_minutes: float = 10.0, max_group: int | None = None
) -> DataFrame:
    """Ids of the responses that stay. Two responses without answers count as equal.

    ``max_group`` is a proven bound on the responses of one user, if the caller has one.
    """
    gap = int(gap_minutes * MICROS_PER_MINUTE)
    keys = ["app_user_id"] + (["survey_id"] if "survey_id" in responses.columns else [])
    marked = (
        responses.select("id", *keys, micros(F.col("timestamp")).alias("t"))
        .join(answer_fingerprint(answers).withColumnRenamed("survey_response_id", "id"), "id", "left")
        .withColumn("fingerprint", F.coalesce("fingerprint", F.lit("")))
    )
    order = [F.col("t"), F.col("id")]
    lagged = ordered_columns(marked, keys, order, lags={"__t": F.col("t"), "__f": F.col("fingerprint")}, max_group=max_group)
    starts = F.col("__t").isNull() | (F.col("t") - F.col("__t") > gap) | (F.col("fingerprint") != F.col("__f"))
    runs = ordered_columns(
        lagged.withColumn("__start", F.coalesce(starts, F.lit(True)).cast("int")),
        keys, order, sums={"__run": F.col("__start")}, max_group=max_group,
    )
    run_key = [*keys, "__run"]
    # copies at the same time: only the first can be kept, so a run shrinks to its distinct times
    points = runs.groupBy(*run_key, "t").agg(F.min("id").alias("id"))
    if max_group is not None and max_group <= FOLD_ROWS:
        return _fold_runs(points, run_key, gap)
    # the run sizes and the walk read the same points; keep them instead of finding them twice
    points = cut_lineage(points)
    sizes = points.groupBy(*run_key).agg(F.count(F.lit(1)).alias("__points"))
    longest = sizes.agg(F.max("__points")).first()[0] or 0
    if longest <= FOLD_ROWS:
        return _fold_runs(points, run_key, gap)
    labelled = points.join(sizes, run_key)
    short = _fold_runs(labelled.filter(F.col("__points") <= FOLD_ROWS).drop("__points"), run_key, gap)
    long = _jump_runs(labelled.filter(F.col("__points") > FOLD_ROWS).drop("__points"), run_key, gap)
    return short.unionByName(long)


def _fold_runs(points: DataFrame, run_key: Sequence[str], gap: int) -> DataFrame:
    row = F.struct("t", "id")
    ordered = F.array_sort(F.collect_list(row))
    empty = F.struct(
        F.lit(None).cast("bigint").alias("anchor"), F.array().cast("array<bigint>").alias("kept")
    )

    def step(state: Column, point: Column) -> Column:
        stays = state["anchor"].isNull() | (point["t"] - state["anchor"] > F.lit(gap))
        return F.when(
            stays, F.struct(point["t"].alias("anchor"), F.concat(state["kept"], F.array(point["id"])).alias("kept"))
        ).otherwise(state)

    kept = F.aggregate(ordered, empty, step, lambda state: state["kept"])
    return points.groupBy(*run_key).agg(kept.alias("__kept")).select(F.explode("__kept").alias("id"))


def _jump_runs(points: DataFrame, run_key: Sequence[str], gap: int) -> DataFrame:
    """Exact for runs of any length: the successor of every row, then pointer doubling.

    A row's successor is the first one later than ``t + gap``. Rows and their ``t + gap`` are passed
    in descending order, and the least time met so far is the answer; at equal times a ``t + gap`` comes
    first. The pass goes through range segments, so rows crowded into one gap are no single task.
    """
    points = cut_lineage(points)
    events = points.select(*run_key, F.col("t").alias("__at"), F.lit(1).alias("__is_row"), F.col("t").alias("__from")).unionByName(
        points.select(*run_key, (F.col("t") + gap).alias("__at"), F.lit(0).alias("__is_row"), F.col("t").alias("__from"))
    )
    downwards = [F.col("__at").desc(), F.col("__is_row"), F.col("__from")]
    passed = ordered_columns(events, run_key, downwards, maxima={"__least": F.when(F.col("__is_row") == 1, -F.col("__at"))})
    edges = passed.filter("__is_row = 0").select(*run_key, F.col("__from").alias("t"), (-F.col("__least")).alias("__next"))
    jumps = cut_lineage(edges.filter("__next is not null"))
    reached = cut_lineage(points.groupBy(*run_key).agg(F.min("t").alias("t")))
    found = reached.count()
    while True:
        step = reached.join(jumps, [*run_key, "t"]).select(*run_key, F.col("__next").alias("t"))
        reached = cut_lineage(reached.unionByName(step).distinct())
        now = reached.count()
        if now == found:
            break
        found = now
        hop = jumps.select(*run_key, F.col("t").alias("__next"), F.col("__next").alias("__after"))
        jumps = cut_lineage(jumps.join(hop, [*run_key, "__next"]).select(*run_key, "t", F.col("__after").alias("__next")))
    return points.join(reached, [*run_key, "t"], "left_semi").select("id")


def dedup_responses(
    responses: DataFrame, answers: DataFrame, gap_minutes: float = 10.0, max_group: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Responses and answers without repeated submissions."""
    # both tables, and whatever is built on them, read the list of kept ids
    kept = cut_lineage(kept_responses(responses, answers, gap_minutes, max_group))
    return (
        responses.join(kept, "id", "left_semi"),
        answers.join(kept.withColumnRenamed("id", "survey_response_id"), "survey_response_id", "left_semi"),
    )
