"""Survey answers to labels: filters, coercion, rules, collapse per day, referents, sleep."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwell.functions.answers import coerce_answer
from panelwell.functions.timegrid import clock_to_hours, hours_between, sleep_category
from panelwell.operators.cleaning import DAILY_SURVEYS
from panelwell.operators.ordered import ordered_columns

# Sleep questions, and the yes/no questions used if there is no question table.
ASLEEP_QUESTION, AWAKE_QUESTION = 54, 55
FALLBACK_YES_NO = (8, 11, 12, 13, 15, 16, 17, 18)
COLLAPSE_STRATEGIES = ("mean", "max", "min", "first", "last")


@dataclass(frozen=True)
class Rule:
    """A clause over some questions: ``op`` compares their answers with ``val``."""

    ids: tuple[int, ...]
    op: str
    val: float | str

    @property
    def is_text(self) -> bool:
        return self.op == "any_eq" and isinstance(self.val, str)


# The risk label of the study.
RISK_RULES = (Rule((2, 3, 5, 7), "ge", 2.0), Rule((8, 12, 13), "any_gt", 0))


def question_ids(rules: Sequence[Rule]) -> list[int]:
    return sorted({i for rule in rules for i in rule.ids})


def daily_surveys(responses: DataFrame, ids: Sequence[int] = DAILY_SURVEYS) -> DataFrame:
    if "survey_id" not in responses.columns:
        return responses
    return responses.filter(F.col("survey_id").isin(*ids))


def answers_semi_responses(answers: DataFrame, responses: DataFrame) -> DataFrame:
    """Answers whose response is still there."""
    kept = responses.select(F.col("id").alias("survey_response_id"))
    return answers.join(kept, "survey_response_id", "left_semi")


def question_filter(answers: DataFrame, ids: Sequence[int]) -> DataFrame:
    return answers.filter(F.col("question_id").isin(*ids))


def coerced_answers(answers: DataFrame, text_questions: Collection[int] = ()) -> DataFrame:
    """Adds ``answer_num`` and drops answers without one; text questions only need some text."""
    number = coerce_answer(F.col("answer"))
    if not text_questions:
        return answers.withColumn("answer_num", number).filter("answer_num is not null")
    is_text = F.col("question_id").isin(*text_questions)
    return answers.withColumn("answer_num", F.when(~is_text, number)).filter(
        F.when(is_text, F.col("answer").isNotNull()).otherwise(F.col("answer_num").isNotNull())
    )


def answered_twice(question: int) -> Column:
    return F.count_if(F.col("question_id") == question) > 1


def refusal(question: int) -> Column:
    return F.raise_error(F.lit(f"question {question} has two answers in the same response"))


def answers_pivot(answers: DataFrame, ids: Sequence[int], value: str = "answer_num") -> DataFrame:
    """Response × question matrix; two answers to one question of a response fail the job."""
    cells = []
    for i in ids:
        cell = F.when(F.col("question_id") == i, F.col(value))
        cells.append(F.when(answered_twice(i), refusal(i).cast("double")).otherwise(F.max(cell)).alias(f"q{i}"))
    return answers.groupBy("survey_response_id").agg(*cells)


def rule_condition(rule: Rule) -> Column:
    """The clause as an aggregate over one response's answers."""
    mine = F.col("question_id").isin(*rule.ids)
    number, val = F.when(mine, F.col("answer_num")), F.lit(rule.val)

    def any_of(test: Column) -> Column:
        return F.coalesce(F.bool_or(F.when(mine, test)), F.lit(False))

    if rule.op == "mean":
        return F.coalesce(F.avg(number) >= val, F.lit(False))
    if rule.op == "sum":
        return F.coalesce(F.sum(number), F.lit(0.0)) >= val
    if rule.op == "sum_le":
        # a response without any of the answers sums to zero, so it passes
        return F.coalesce(F.sum(number), F.lit(0.0)) <= val
    if rule.op == "max":
        return F.coalesce(F.max(number) >= val, F.lit(False))
    if rule.op == "ge":
        return any_of(F.col("answer_num") >= val)
    if rule.op == "any_eq":
        return any_of((F.col("answer") if rule.is_text else F.col("answer_num")) == val)
    if rule.op == "any_gt":
        return any_of(F.col("answer_num") > val)
    raise ValueError(f"rule operation {rule.op!r} is not known")


def applicable_rules(answers: DataFrame, rules: Sequence[Rule], logic: str) -> list[Rule]:
    """Rules with at least one of their questions in the table.

    A rule whose questions are absent can only matter if its empty value is true or if all
    rules must hold; only then one small aggregate is run to see which questions occur.
    """
    if logic not in ("any", "all"):
        raise ValueError(f"rules combine by any or all, not by {logic!r}")

    def true_when_empty(rule: Rule) -> bool:
        return (rule.op == "sum_le" and rule.val >= 0) or (rule.op == "sum" and rule.val <= 0)

    for rule in rules:
        rule_condition(rule)
    if logic == "any" and not any(true_when_empty(r) for r in rules):
        return list(rules)
    present = answers.agg(
        *[F.coalesce(F.bool_or(F.col("question_id").isin(*r.ids)), F.lit(False)).alias(f"r{i}") for i, r in enumerate(rules)]
    ).first()
    return [r for i, r in enumerate(rules) if present[f"r{i}"]]


def combine_rules(answers: DataFrame, rules: Sequence[Rule] = RISK_RULES, logic: str = "any") -> DataFrame:
    """``(survey_response_id, answer)`` with 0/1 labels; no applicable rule gives 0 everywhere.

    Two answers of one response to a question of the rules fail the job: they would count twice.
    """
    active = applicable_rules(answers, rules, logic)
    combined: Column = F.lit(False)
    for i, rule in enumerate(active):
        condition = rule_condition(rule)
        combined = condition if i == 0 else (combined | condition if logic == "any" else combined & condition)
    if not active:
        return answers.select("survey_response_id").distinct().withColumn("answer", F.lit(0))
    label = combined.cast("int")
    for question in sorted({i for rule in active for i in rule.ids}):
        label = F.when(answered_twice(question), refusal(question).cast("int")).otherwise(label)
    return answers.groupBy("survey_response_id").agg(label.alias("answer"))


def mean_label(answers: DataFrame, threshold: float | None = None) -> DataFrame:
    return _scalar_label(answers, F.avg("answer_num"), threshold)


def max_label(answers: DataFrame, threshold: float | None = None) -> DataFrame:
    return _scalar_label(answers, F.max("answer_num"), threshold)


def _scalar_label(answers: DataFrame, score: Column, threshold: float | None) -> DataFrame:
    label = score if threshold is None else (score >= F.lit(threshold)).cast("int")
    return answers.groupBy("survey_response_id").agg(label.alias("answer"))


def target_type(labels: DataFrame, is_regression: bool = False) -> DataFrame:
    """Labels as integer classes, or as numbers for a regression target."""
    return labels.withColumn("answer", F.col("answer").cast("float" if is_regression else "bigint"))


def labels_join_responses(labels: DataFrame, responses: DataFrame) -> DataFrame:
    """Label with user and time; responses without a targeted answer disappear."""
    columns = [F.col("id").alias("survey_response_id"), "app_user_id", F.col("timestamp").alias("record_timestamp")]
    if "survey_id" in responses.columns:
        columns.append("survey_id")
    return labels.join(responses.select(*columns), "survey_response_id")


def referent_window(master: DataFrame, max_group: int | None = None) -> DataFrame:
    """Adds the user's previous response time, hours since it, and the morning flag."""
    order = [F.col("record_timestamp"), F.col("survey_response_id")]
    lagged = ordered_columns(
        master, ["app_user_id"], order, lags={"prev_record_timestamp": F.col("record_timestamp")}, max_group=max_group
    )
    morning = (F.col("survey_id") == 0).cast("double") if "survey_id" in master.columns else F.lit(0.0)
    return lagged.withColumns(
        {
            "referent_hours": hours_between(F.col("record_timestamp"), F.col("prev_record_timestamp")),
            "is_morning": morning,
        }
    )


def sleep_hours(answers: DataFrame) -> DataFrame:
    """Hours from falling asleep to waking, over midnight if need be, and their category."""
    asleep = F.max(F.when(F.col("question_id") == ASLEEP_QUESTION, F.col("answer")))
    awake = F.max(F.when(F.col("question_id") == AWAKE_QUESTION, F.col("answer")))
    span = (
        question_filter(answers, (ASLEEP_QUESTION, AWAKE_QUESTION))
        .groupBy("survey_response_id")
        .agg(asleep.alias("__asleep"), awake.alias("__awake"))
        .withColumns({"__a": clock_to_hours(F.col("__asleep")), "__w": clock_to_hours(F.col("__awake"))})
    )
    gap = F.col("__w") - F.col("__a")
    hours = F.when(gap >= 0, gap).otherwise(gap + 24.0)
    return span.withColumn("sleep_hours", hours).select(
        "survey_response_id", "sleep_hours", sleep_category(F.col("sleep_hours")).alias("sleep_category")
    )


def sleep_left_join(master: DataFrame, sleep: DataFrame) -> DataFrame:
    return master.join(sleep, "survey_response_id", "left")


def answers_by_user_day(answers: DataFrame, responses: DataFrame) -> DataFrame:
    """Answers with the user and calendar date of their response."""
    keyed = responses.select(
        F.col("id").alias("survey_response_id"), "app_user_id", F.to_date("timestamp").alias("date")
    )
    return answers.join(keyed, "survey_response_id")


def daily_representative(responses: DataFrame) -> DataFrame:
    """The last response of each user and day; each column takes its last known value."""
    order = F.struct("timestamp", "id")
    others = [c for c in responses.columns if c not in ("app_user_id",)]
    picks = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in others]
    return responses.groupBy("app_user_id", F.to_date("timestamp").alias("date")).agg(*picks)


def representative_join(day_answers: DataFrame, representative: DataFrame) -> DataFrame:
    """Day aggregates, keyed by the day's representative response."""
    keyed = representative.select("app_user_id", "date", F.col("id").alias("survey_response_id"))
    return day_answers.join(keyed, ["app_user_id", "date"])


def collapse_daily(
    responses: DataFrame,
    answers: DataFrame,
    strategy: str | None = "none",
    questions: DataFrame | None = None,
    text_questions: Collection[int] = (),
) -> tuple[DataFrame, DataFrame]:
    """One response per user and day.

    Yes/no questions take their maximum, text questions their last text, other questions the
    strategy; "first" and "last" follow the order of answer ids. Answers come back with text
    in ``answer`` and numbers in ``answer_num``.
    """
    if strategy in (None, "none"):
        return responses, answers
    if strategy not in COLLAPSE_STRATEGIES:
        raise ValueError(f"collapse strategy {strategy!r} is none of {sorted(COLLAPSE_STRATEGIES)}")
    coerced = coerced_answers(answers, text_questions)
    placed = answers_by_user_day(coerced, responses)
    if questions is None:
        placed = placed.withColumn("__yes_no", F.col("question_id").isin(*FALLBACK_YES_NO))
    else:
        # the question table has one row per question; it is small by its nature, but the
        # choice of a broadcast is left to the size statistics
        styles = questions.select(F.col("id").alias("question_id"), (F.col("style") == "yes-no").alias("__yes_no"))
        placed = placed.join(styles, "question_id", "left").withColumn("__yes_no", F.coalesce("__yes_no", F.lit(False)))
    number = F.col("answer_num")
    by_strategy = {
        "mean": F.avg(number),
        "max": F.max(number),
        "min": F.min(number),
        "first": F.min_by(number, F.col("id")),
        "last": F.max_by(number, F.col("id")),
    }[strategy]
    grouped = placed.groupBy("app_user_id", "date", "question_id", "__yes_no").agg(
        F.max(number).alias("__max"), by_strategy.alias("__stat"), F.max_by("answer", F.col("id")).alias("__text")
    )
    is_text = F.col("question_id").isin(*text_questions) if text_questions else F.lit(False)
    value = F.when(F.col("__yes_no"), F.col("__max")).otherwise(F.col("__stat"))
    day_answers = grouped.select(
        "app_user_id", "date", "question_id",
        F.when(is_text, F.col("__text")).otherwise(value.cast("string")).alias("answer"),
        F.when(~is_text, value).alias("answer_num"),
    )
    representative = daily_representative(responses)
    collapsed = representative_join(day_answers, representative).select(
        "survey_response_id", "question_id", "answer", "answer_num"
    )
    return representative.select(*responses.columns), collapsed
