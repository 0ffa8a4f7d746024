"""The cohort build: from raw tables to cleaned sensors and one labelled row per survey."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from panelwell.operators.cleaning import (
    DAILY_SURVEYS,
    DEFAULT_EXCLUDED_USERS,
    PREPROCESSORS,
    STUDY_START,
    clip_upper_quantile,
    coerce_timestamps,
    enrollment_windows,
    exclude_users,
    os_filter,
    preprocess,
    restrict_to_study,
)
from panelwell.operators.dedup import dedup_responses
from panelwell.operators.labels import (
    RISK_RULES,
    Rule,
    answers_semi_responses,
    coerced_answers,
    collapse_daily,
    combine_rules,
    daily_surveys,
    labels_join_responses,
    question_filter,
    question_ids,
    referent_window,
    sleep_hours,
    sleep_left_join,
)
from panelwell.operators.ordered import largest_group
from panelwell.operators.people import eav_pivot
from panelwell.operators.windows import Sampler, coverage_gate
from panelwell.session import require_utc, store


@dataclass(frozen=True)
class CohortSettings:
    rules: Sequence[Rule] = RISK_RULES
    logic: str = "any"
    exclude: Sequence[int] = DEFAULT_EXCLUDED_USERS
    daily: Sequence[int] = DAILY_SURVEYS
    dedup_minutes: float = 10.0
    collapse: str | None = "none"
    lead_days: float = 7.0
    trail_days: float = 1.0
    study_start: str = STUDY_START
    clip: float = 0.99
    os: str | None = "both"
    use_sleep: bool = False
    sampler: Sampler | None = None
    preprocessors: Mapping[str, Callable[..., DataFrame]] = field(default_factory=lambda: PREPROCESSORS)


@dataclass(frozen=True)
class StudyTables:
    """Raw inputs. ``sensors`` is the long table of ``sources.tables.modality_union``."""

    sensors: DataFrame
    responses: DataFrame
    answers: DataFrame
    questions: DataFrame | None = None
    demographic: DataFrame | None = None


@dataclass(frozen=True)
class Cohort:
    sensors: DataFrame
    master: DataFrame
    demographics: DataFrame | None


def clean_sensors(tables: StudyTables, settings: CohortSettings, max_sensors: int | None = None) -> DataFrame:
    """Preprocess, exclude, restrict to enrolment windows (from all responses), clip.

    Without any response there are no windows; the study start takes their place.
    """
    sensors = preprocess(tables.sensors, settings.preprocessors, settings.study_start)
    sensors = exclude_users(sensors, settings.exclude)
    windows = enrollment_windows(tables.responses, settings.daily, settings.lead_days, settings.trail_days)
    # written once: the quantile, the OS filter, the coverage gate and all windows read it
    enrolled = store(restrict_to_study(sensors, windows, settings.study_start), "sensors", ["modality"])
    return clip_upper_quantile(enrolled, settings.clip, max_group=max_sensors)


def build_master(tables: StudyTables, settings: CohortSettings, max_responses: int | None = None) -> DataFrame:
    """Labels: exclude, daily, dedup, collapse, questions, rules, times, referents, sleep.

    The order matters: a dropped repeat must not count as the previous response.
    """
    text_questions = {i for r in settings.rules if r.is_text for i in r.ids}
    sleep_questions = {54, 55} if settings.use_sleep else set()
    responses = daily_surveys(exclude_users(tables.responses, settings.exclude), settings.daily)
    answers = answers_semi_responses(tables.answers, responses)
    responses, answers = dedup_responses(responses, answers, settings.dedup_minutes, max_responses)
    responses, answers = collapse_daily(
        responses, answers, settings.collapse, tables.questions, text_questions | sleep_questions
    )
    wanted = question_filter(answers, question_ids(settings.rules))
    labels = combine_rules(coerced_answers(wanted, text_questions), settings.rules, settings.logic)
    master = referent_window(labels_join_responses(labels, responses), max_responses)
    return sleep_left_join(master, sleep_hours(answers)) if settings.use_sleep else master


def build_cohort(tables: StudyTables, settings: CohortSettings = CohortSettings()) -> Cohort:
    """Cleaned sensors, labelled surveys that pass the OS filter and coverage gate, demographics.

    Survey times may be text; text that is no time becomes null.
    """
    require_utc(tables.responses.sparkSession)
    tables = replace(tables, responses=coerce_timestamps(tables.responses, ["timestamp"]))
    # a count over the responses bounds every group of surveys that the build has to order
    max_responses, _ = largest_group(tables.responses, ["app_user_id"])
    sensors = clean_sensors(tables, settings)
    master = store(build_master(tables, settings, max_responses), "master")
    master = coverage_gate(os_filter(master, sensors, settings.os), sensors, settings.sampler)
    people = eav_pivot(exclude_users(tables.demographic, settings.exclude)) if tables.demographic is not None else None
    return Cohort(sensors, master, people)
