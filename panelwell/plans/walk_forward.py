"""The evaluation plan: cohort → window features → folds → model → pooled metrics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwell.operators.catch22 import catch22_features
from panelwell.operators.features import assemble_features, flatten_window, summary_stats
from panelwell.operators.model import fit_predict
from panelwell.operators.people import demographics_by_fold
from panelwell.operators.scaling import CONTEXT_MODES, SLEEP_MODES, dual_scale_packed, dual_scale_stats, scale_sleep, survey_context
from panelwell.operators.splits import cyclic_cuts, walk_forward_cyclic
from panelwell.operators.windows import RollingSampler, covered_by_setting, lookback_hours, packed_windows


def fold_features(
    master: DataFrame, sensors: DataFrame, sampler: RollingSampler, modalities: Sequence[str],
    train_width: float = 0.8, step: float = 0.2, purge_hours: float | None = None,
    max_group: int | None = None,
) -> DataFrame:
    """Samples of all folds with summary-statistic features; the purge defaults to the lookback."""
    purge = lookback_hours(sampler) if purge_hours is None else purge_hours
    columns = ["survey_response_id", "app_user_id", "record_timestamp", "answer"]
    stats = summary_stats(packed_windows(master.select(*columns), sensors, sampler, modalities), sorted(modalities), keep=columns)
    names = [c for c in stats.columns if c not in columns]
    featured = assemble_features(stats, names, keep=columns)
    return walk_forward_cyclic(featured, train_width, step, purge, max_group=max_group)


def listed_folds(folds: DataFrame) -> DataFrame:
    """One row per survey with ``folds``, the list of its (fold_index, role)."""
    survey = ["survey_response_id", "app_user_id", "record_timestamp", "answer"]
    return folds.groupBy(*survey).agg(F.collect_list(F.struct("fold_index", "role")).alias("folds"))


FEATURIZERS = ("raw", "stats", "catch22")


def fold_matrix(
    windows: DataFrame, folds: DataFrame | None, channels: Sequence[str], featurizer: str = "stats", scaled: bool = True,
    demographics: DataFrame | None = None, sleep: str = "none", context: str = "none", setting: Sequence[str] = (),
) -> DataFrame:
    """Fold rows with ``features``: window features, demographics, sleep, context, all fitted on the fold's train rows.

    ``windows`` are packed windows by survey, ``folds`` the rows of all folds with ``sleep_hours`` and
    ``sleep_category``, ``referent_hours`` and ``is_morning`` where the sleep and context modes need
    them. Scaled windows have each channel twice, first scaled over all participants, then by participant.
    A fold row without a window is left out. Without ``folds`` the windows have the columns of ``listed_folds``, and each has one
    row with its list, for features that are the same in all folds. ``setting`` names columns of both tables that tell several
    samplings apart; everything is fitted per setting and fold then.
    """
    if featurizer not in FEATURIZERS:
        raise ValueError(f"featurizer {featurizer!r} is none of {', '.join(FEATURIZERS)}")
    by, sample = [*setting, "fold_index"], [*setting, "survey_response_id"]
    keep = [*by, "role", "survey_response_id", "app_user_id", "record_timestamp", "answer"]
    extra = [*SLEEP_MODES[sleep], *CONTEXT_MODES[context]]
    if folds is None:
        if scaled or extra or demographics is not None:
            raise ValueError("scaled windows, demographics, sleep and context differ by fold: they need fold rows")
        listed = [*setting, "folds", *keep[keep.index("survey_response_id"):]]
        if featurizer == "raw":
            made, columns = flatten_window(windows, list(channels), "window", keep=listed), ["window"]
        else:
            made = (summary_stats if featurizer == "stats" else catch22_features)(windows, list(channels), keep=listed)
            columns = [c for c in made.columns if c not in listed]
        return assemble_features(made, columns, keep=listed)
    rows = folds
    if sleep != "none":
        rows = scale_sleep(rows, by)
    if context != "none":
        rows = survey_context(rows, by)
    people: list[str] = []
    rows = rows.select(*keep, *extra)
    if demographics is not None:
        rows = demographics_by_fold(rows, demographics, by=by)
        people = [c for c in rows.columns if c not in (*keep, *extra)]
    carried = [*keep, *people, *extra]
    if scaled and featurizer == "stats":
        made, columns = dual_scale_stats(rows, windows, channels, by, sample)
        return assemble_features(made, columns, people, SLEEP_MODES[sleep], CONTEXT_MODES[context], keep=keep)
    if scaled:
        rows, names = dual_scale_packed(rows, windows, channels, by, sample)
    else:
        # fold rows and packed windows are far larger than Spark estimates
        rows, names = rows.join(windows.select(*sample, *channels).hint("merge"), sample), list(channels)
    if featurizer == "raw":
        made, columns = flatten_window(rows, names, "window", keep=carried), ["window"]
    else:
        made = (summary_stats if featurizer == "stats" else catch22_features)(rows, names, keep=carried)
        columns = [c for c in made.columns if c not in carried]
    return assemble_features(made, columns, people, SLEEP_MODES[sleep], CONTEXT_MODES[context], keep=keep)


def walk_forward(features: DataFrame, model: Callable[[], Pipeline], train_width: float = 0.8, step: float = 0.2) -> DataFrame:
    """Pooled out-of-fold predictions. The fold list is fixed before the first fit."""
    folds = [c[0] for c in cyclic_cuts(train_width, step)]
    return fit_predict(features, folds, model)


def tested_by_setting(
    master: DataFrame, sensors: DataFrame, samplers: Sequence[RollingSampler],
    train_width: float = 0.8, step: float = 0.2, purge_hours: float = 120.0,
    max_group: int | None = None, max_records: int | None = None,
) -> DataFrame:
    """Surveys that enter the pooled test predictions of each setting, for the whole grid at once.

    ``max_group`` bounds the surveys of a participant, ``max_records`` surveys and sensor records together.
    """
    covered = covered_by_setting(master, sensors, samplers, max_group=max_records)
    by = ["lookback_hours", "bin_hours", "app_user_id"]
    return walk_forward_cyclic(covered, train_width, step, purge_hours, by=by, max_group=max_group).filter(F.col("role") == "test")
