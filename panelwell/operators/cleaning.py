"""Sensor cleaning: filters, duplicate removal, source rules, enrolment windows, clipping, OS."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwell.functions.answers import coerce_timestamp
from panelwell.functions.timegrid import MICROS_PER_MINUTE, micros, shift_hours
from panelwell.operators.ordered import ordered_columns, row_rank_first

# Fixed values of the study protocol.
DEFAULT_EXCLUDED_USERS = (1, 2, 3, 10, 12, 21, 22, 30, 43, 44, 53, 54, 55)
DAILY_SURVEYS = (0, 1)
STUDY_START = "2025-09-01"
DEDUP_COLUMNS = ("app_user_id", "start_timestamp", "end_timestamp", "value", "app_source")


@dataclass(frozen=True)
class SourceRule:
    """A per-user correction of the recorded source."""

    user: int
    source: str
    replacement: str | None = None


# One user's source is renamed, another user's Android rows are dropped.
RENAME_RULES = (SourceRule(26, "Health", "Apple Watch"),)
DROP_RULES = (SourceRule(22, "android"),)


def exclude_users(df: DataFrame, users: Sequence[int] | DataFrame = DEFAULT_EXCLUDED_USERS) -> DataFrame:
    """Drops the listed users; an empty list keeps everybody. A table of users is anti-joined."""
    if isinstance(users, DataFrame):
        return df.join(users.select("app_user_id").distinct(), "app_user_id", "left_anti")
    if not users:
        return df
    return df.filter(F.col("app_user_id").isNull() | ~F.col("app_user_id").isin(*users))


def coerce_timestamps(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text time columns, where they exist, become naive timestamps; bad text becomes null."""
    return df.withColumns({c: coerce_timestamp(F.col(c)) for c in columns if c in df.columns})


def drop_zero_duration_positive(df: DataFrame) -> DataFrame:
    """Steps: no record may have a positive value and no duration. An unknown end is kept."""
    if "end_timestamp" not in df.columns:
        return df
    zero = (F.col("end_timestamp") == F.col("start_timestamp")) & (F.col("value") > 0)
    return df.filter(~F.coalesce(zero, F.lit(False)))


def drop_same_start_end(df: DataFrame) -> DataFrame:
    """Distance: no record may start and end at the same time, whatever its value."""
    if "end_timestamp" not in df.columns:
        return df
    return df.filter(~F.coalesce(F.col("end_timestamp") == F.col("start_timestamp"), F.lit(False)))


def study_start_cutoff(df: DataFrame, start: str = STUDY_START) -> DataFrame:
    return df.filter(F.col("start_timestamp") >= F.to_timestamp_ntz(F.lit(start)))


def drop_duplicates_first(df: DataFrame, keys: Sequence[str] = DEDUP_COLUMNS, order: str = "id") -> DataFrame:
    """Of rows equal in the key columns that exist, the one with the smallest ``order`` stays.

    Rows without ``order`` come last, and among themselves by a hash of the row: the order is never
    null, so a table without ids keeps its rows whole. Different modalities are never merged.
    """
    present = [k for k in keys if k in df.columns]
    if not present:
        return df
    present += [k for k in ("modality",) if k in df.columns and k not in present]
    number = F.col(order) if order in df.columns else F.lit(None).cast("bigint")
    return row_rank_first(df, present, F.struct(number.isNull().alias("none"), number.alias("number"), F.xxhash64(*df.columns).alias("row")))


def rename_source_for_user(df: DataFrame, rules: Sequence[SourceRule] = RENAME_RULES) -> DataFrame:
    if "app_source" not in df.columns:
        return df
    source = F.col("app_source")
    renamed = source
    for rule in rules:
        hit = (F.col("app_user_id") == rule.user) & (source == rule.source)
        renamed = F.when(hit, F.lit(rule.replacement)).otherwise(renamed)
    return df.withColumn("app_source", renamed)


def drop_source_for_user(df: DataFrame, rules: Sequence[SourceRule] = DROP_RULES) -> DataFrame:
    """Drops a user's rows whose source contains the text in any case; an unknown source stays."""
    if "app_source" not in df.columns:
        return df
    keep = F.lit(True)
    for rule in rules:
        hit = (F.col("app_user_id") == rule.user) & F.lower("app_source").contains(rule.source.lower())
        keep = keep & ~F.coalesce(hit, F.lit(False))
    return df.filter(keep)


def clean_steps(df: DataFrame, study_start: str = STUDY_START) -> DataFrame:
    """Step preprocessor: zero durations, duplicates, then the two source rules, in this order."""
    return (
        df.transform(drop_zero_duration_positive)
        .transform(drop_duplicates_first)
        .transform(rename_source_for_user)
        .transform(drop_source_for_user)
    )


def clean_distance(df: DataFrame, study_start: str = STUDY_START) -> DataFrame:
    """Distance preprocessor: equal start and end, records before the study, duplicates."""
    return (
        df.transform(drop_same_start_end)
        .transform(study_start_cutoff, study_start)
        .transform(drop_duplicates_first)
    )


#: Preprocessors by modality; a caller may pass its own mapping (table → table).
PREPROCESSORS: Mapping[str, Callable[..., DataFrame]] = {"step": clean_steps, "distance": clean_distance}


def preprocess(
    sensors: DataFrame,
    preprocessors: Mapping[str, Callable[..., DataFrame]] = PREPROCESSORS,
    study_start: str = STUDY_START,
) -> DataFrame:
    """Applies each modality's preprocessor to its rows; a modality without one passes through."""
    others = sensors.filter(~F.col("modality").isin(*preprocessors)) if preprocessors else sensors
    out = others
    for modality in sorted(preprocessors):
        part = sensors.filter(F.col("modality") == modality)
        out = out.unionByName(preprocessors[modality](part, study_start))
    return out


def enrollment_windows(
    responses: DataFrame,
    daily_surveys: Sequence[int] = DAILY_SURVEYS,
    lead_days: float = 7.0,
    trail_days: float = 1.0,
) -> DataFrame:
    """Per user the span from the first to the last daily survey, widened on both sides.

    If there is no daily survey in the whole table, all surveys count.
    """
    bounded = responses
    if "survey_id" in responses.columns:
        daily = responses.filter(F.col("survey_id").isin(*daily_surveys))
        if not daily.isEmpty():
            bounded = daily
    return bounded.groupBy("app_user_id").agg(
        shift_hours(F.min("timestamp"), -24 * lead_days).alias("window_start"),
        shift_hours(F.max("timestamp"), 24 * trail_days).alias("window_end"),
    )


def enrollment_join(sensors: DataFrame, windows: DataFrame) -> DataFrame:
    """Sensor rows that start inside their user's window, both ends included."""
    inside = F.col("start_timestamp").between(F.col("window_start"), F.col("window_end"))
    return sensors.join(windows, "app_user_id").filter(inside).select(*sensors.columns)


def restrict_to_study(sensors: DataFrame, windows: DataFrame, start: str = STUDY_START) -> DataFrame:
    """Sensor rows inside their user's enrolment window; without any window, rows since the study start."""
    return study_start_cutoff(sensors, start) if windows.isEmpty() else enrollment_join(sensors, windows)


def exact_quantile(
    df: DataFrame, group: Sequence[str], value: str, q: float, name: str = "quantile", max_group: int | None = None
) -> DataFrame:
    """Linear-interpolated quantile per group, exact at any size.

    Equal values are counted first; running counts then locate the two neighbouring ranks.
    No group is ever held in one task's memory.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("__c"))
    return quantile_of_counts(counts, group, value, q, name, max_group)


def quantile_of_counts(
    counts: DataFrame, group: Sequence[str], value: str, q: float, name: str = "quantile", max_group: int | None = None
) -> DataFrame:
    """Linear-interpolated quantile per group from ``(*group, value, __c)``, one row per distinct value."""
    ranked = ordered_columns(
        counts, group, [F.col(value)], sums={"__cum": F.col("__c")}, totals={"__n": F.col("__c")}, max_group=max_group,
    )
    spot = (F.col("__n") - 1) * F.lit(float(q))
    low = F.floor(spot)
    located = ranked.withColumns({"__spot": spot, "__low": low})
    ends = located.groupBy(*group).agg(
        F.min(F.when(F.col("__cum") > F.col("__low"), F.col(value))).alias("__a"),
        F.min(F.when(F.col("__cum") > F.col("__low") + 1, F.col(value))).alias("__b"),
        F.max("__spot").alias("__spot"),
        F.max("__low").alias("__low"),
    )
    fraction = F.col("__spot") - F.col("__low")
    result = F.col("__a") + fraction * (F.coalesce(F.col("__b"), F.col("__a")) - F.col("__a"))
    return ends.select(*group, result.alias(name))


def fold_spans(folds: DataFrame, lookback_hours: float) -> DataFrame:
    """``(app_user_id, spans)``: for every fold that trains on the user, when that training ends and which
    time its test surveys can look at. One row per user, one array entry per fold.
    """
    at = micros(F.col("record_timestamp"))
    spans = folds.groupBy("fold_index", "app_user_id").agg(
        F.max(F.when(F.col("role") == "train", at)).alias("train_to"),
        (F.min(F.when(F.col("role") == "test", at)) - F.lit(int(lookback_hours * 60 * MICROS_PER_MINUTE))).alias("held_from"),
        F.max(F.when(F.col("role") == "test", at)).alias("held_to"),
    )
    return (
        spans.filter("train_to is not null")
        .groupBy("app_user_id")
        .agg(F.collect_list(F.struct("fold_index", "train_to", "held_from", "held_to")).alias("spans"))
    )


def fold_upper_quantiles(
    sensors: DataFrame, folds: DataFrame, q: float = 0.99, lookback_hours: float = 72.0, max_group: int | None = None
) -> DataFrame:
    """``(fold_index, modality, upper)``: each fold's limits, from its training rows alone.

    ``folds`` has ``(fold_index, role, app_user_id, record_timestamp)``. A sensor row counts for a fold that
    trains on its user if it starts before the last training survey, and not from ``lookback_hours``
    before the first to the last test survey. The training sets of the folds overlap, so rows are counted
    once per value and set of folds; only these counts are repeated for each fold. Null values and users
    without a fold count nowhere; a modality without training rows has no limit.
    """

    def trains(start: Column) -> Column:
        def inside(s: Column) -> Column:
            held = F.coalesce(start.between(s["held_from"], s["held_to"]), F.lit(False))
            return (start < s["train_to"]) & ~held

        return F.sort_array(F.transform(F.filter("spans", inside), lambda s: s["fold_index"]))

    rows = sensors.filter("value is not null").select("app_user_id", "modality", "value", micros(F.col("start_timestamp")).alias("__t"))
    counts = (
        rows.join(fold_spans(folds, lookback_hours), "app_user_id")
        .groupBy("modality", "value", trains(F.col("__t")).alias("__folds"))
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(F.explode("__folds").alias("fold_index"), "modality", "value", "__n")
        .groupBy("fold_index", "modality", "value")
        .agg(F.sum("__n").alias("__c"))
    )
    return quantile_of_counts(counts, ["fold_index", "modality"], "value", q, "upper", max_group)


def clip_by_fold(sensors: DataFrame, limits: DataFrame) -> DataFrame:
    """Sensor rows of every fold, capped at its limit for the modality; ``limits`` (one row per fold and
    modality) are broadcast. Rows of a modality without limit are left out, null values stay null."""
    capped = F.when(F.col("value").isNotNull(), F.least("value", "upper"))
    joined = sensors.join(F.broadcast(limits.select("fold_index", "modality", "upper")), "modality")
    return joined.withColumn("value", capped).select("fold_index", *sensors.columns)


def clip_upper_quantile(
    sensors: DataFrame, q: float = 0.99, approximate: bool = False, max_group: int | None = None
) -> DataFrame:
    """Caps values at the modality's quantile. One limit per modality, so the limits are broadcast.

    ``approximate`` uses a sketch for the limit where an exact one is not needed.
    """
    if approximate:
        limits = sensors.groupBy("modality").agg(F.percentile_approx("value", q, 10_000).alias("__limit"))
    else:
        limits = exact_quantile(sensors, ["modality"], "value", q, "__limit", max_group)
    clipped = F.when(F.col("value").isNotNull(), F.least("value", "__limit"))
    return (
        sensors.join(F.broadcast(limits), "modality", "left")
        .withColumn("value", clipped)
        .select(*sensors.columns)
    )


def os_class(sensors: DataFrame) -> DataFrame:
    """Per user ``ios``, ``android`` or ``both`` (both kinds of source, or neither)."""
    source = F.col("app_source")
    ios = F.bool_or(source.contains("iPhone") | source.contains("Apple Watch") | source.contains("HealthKit"))
    android = F.bool_or(source.contains("androidx"))
    flags = sensors.groupBy("app_user_id").agg(
        F.coalesce(ios, F.lit(False)).alias("__ios"), F.coalesce(android, F.lit(False)).alias("__android")
    )
    label = (
        F.when(F.col("__ios") & ~F.col("__android"), "ios")
        .when(F.col("__android") & ~F.col("__ios"), "android")
        .otherwise("both")
    )
    return flags.select("app_user_id", label.alias("os"))


def os_filter(df: DataFrame, sensors: DataFrame, mode: str | None = "both") -> DataFrame:
    """``both`` or nothing keeps all rows; otherwise only users of exactly that class."""
    if not mode or mode == "both":
        return df
    users = os_class(sensors).filter(F.col("os") == mode.lower())
    return df.join(users.select("app_user_id"), "app_user_id", "left_semi")


def collect_sources(sensors: DataFrame) -> DataFrame:
    """Distinct known sources per user, one row each."""
    return sensors.filter("app_source is not null").select("app_user_id", "app_source").distinct()


def device_source_onehot(sensors: DataFrame, step_modality: str = "step") -> DataFrame:
    """Device of a user's step records as four flags; watch outranks phone outranks Android."""
    source = F.col("app_source")

    def seen(*texts: str) -> Column:
        hit = F.lit(False)
        for text in texts:
            hit = hit | source.contains(text)
        return F.coalesce(F.bool_or(hit), F.lit(False))

    flags = (
        sensors.filter(F.col("modality") == step_modality)
        .groupBy("app_user_id")
        .agg(
            seen("Apple Watch").alias("__w"),
            seen("iPhone", "Iphone").alias("__i"),
            seen("androidx", "health.connect").alias("__a"),
        )
    )
    device = F.when(F.col("__w"), "watch").when(F.col("__i"), "iphone").when(F.col("__a"), "android").otherwise("unknown")
    return flags.withColumn("__d", device).select(
        "app_user_id",
        *[(F.col("__d") == d).cast("double").alias(f"device_{d}") for d in ("android", "iphone", "watch", "unknown")],
    )
