"""Scaling and context features, fitted on the train rows of each fold.

Windows are long here: one row per (sample, bin, channel) with the fold columns ``by``. Fitted
statistics are DataFrames (fit) that transforms join (transform). Statistics are moments, so a
participant with a third of all rows is reduced by partial aggregation before any shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwell.operators.features import SUPPORTED_STATS, window_stats
from panelwell.session import broadcast_rows, cut_lineage

FOLD = ("fold_index",)
SLEEP_DEFAULTS = (7.0, 2.0)
REFERENT_DEFAULTS = (12.0, 6.0)


def _moments(value: str) -> tuple[Column, Column]:
    return F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")


def _guarded(std: Column) -> Column:
    """A channel without spread is only centred."""
    return F.when((std == 0) | std.isNull(), F.lit(1.0)).otherwise(std)


def fit_global_scaler(long: DataFrame, by: Sequence[str] = FOLD, value: str = "value") -> DataFrame:
    """Mean and population deviation per (fold, channel) over all train (sample, bin) rows."""
    return long.filter("role = 'train'").groupBy(*by, "channel").agg(*_moments(value))


def fit_subject_scaler(long: DataFrame, by: Sequence[str] = FOLD, value: str = "value") -> DataFrame:
    """The same per participant."""
    return long.filter("role = 'train'").groupBy(*by, "app_user_id", "channel").agg(*_moments(value))


def subject_stats(long: DataFrame, by: Sequence[str] = FOLD, value: str = "value") -> DataFrame:
    """Statistics each (fold, role, participant) is scaled with.

    Participants with train rows use these; others the rows of the split in which they first
    appear, validation before test. Per-role moments are aggregated once and then chosen.
    """
    keys = [*by, "app_user_id", "channel"]
    seen = long.groupBy(*keys).agg(
        *[
            f(F.when(F.col("role") == role, F.col(value))).alias(f"__{role}_{name}")
            for role in ("train", "val", "test")
            for f, name in ((F.avg, "mean"), (F.stddev_pop, "std"))
        ]
    )
    pick = {
        name: F.coalesce(*[F.col(f"__{role}_{name}") for role in ("train", "val", "test")]) for name in ("mean", "std")
    }
    return seen.select(*keys, pick["mean"].alias("mean"), pick["std"].alias("std"))


def _apply(long: DataFrame, stats: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    named = stats.select(*keys, F.col("mean").alias("__mean"), F.col("std").alias("__std"))
    joined = long.join(named, list(keys), "left")
    scaled = (F.col(value) - F.col("__mean")) / _guarded(F.col("__std"))
    return joined.withColumn(out, scaled).drop("__mean", "__std")


def transform_global(long: DataFrame, stats: DataFrame, by: Sequence[str] = FOLD, value: str = "value", out: str = "scaled") -> DataFrame:
    return _apply(long, stats, [*by, "channel"], value, out)


def transform_by_subject(long: DataFrame, by: Sequence[str] = FOLD, value: str = "value", out: str = "scaled") -> DataFrame:
    """Scales every participant with its own statistics; unseen ones with those of their own rows."""
    return _apply(long, subject_stats(long, by, value), [*by, "app_user_id", "channel"], value, out)


def dual_scale(
    long: DataFrame, time_channels: Sequence[str] = (), by: Sequence[str] = FOLD, value: str = "value"
) -> DataFrame:
    """Globally scaled, then subject-scaled, then untouched time channels, told apart by ``block``.

    The rows are aggregated once, per participant and role; the global statistics are pooled from
    these moments, and both kinds reach the rows in one join.
    """
    is_time = F.col("channel").isin(*time_channels) if time_channels else F.lit(False)
    keys = [*by, "app_user_id", "channel"]

    def of(role: str) -> Column:
        return F.when(F.col("role") == role, F.col(value))

    seen = long.filter(~is_time).groupBy(*keys).agg(
        F.count(of("train")).alias("__n"),
        *[F.avg(of(r)).alias(f"__m_{r}") for r in ("train", "val", "test")],
        *[F.var_pop(of(r)).alias(f"__v_{r}") for r in ("train", "val", "test")],
    )
    # three readers of a table with one row per participant and channel
    seen = cut_lineage(seen)
    shared = [*by, "channel"]
    centre = seen.groupBy(*shared).agg((F.sum(F.col("__n") * F.col("__m_train")) / F.sum(F.when(F.col("__n") > 0, F.col("__n")))).alias("__gm"))
    around = F.col("__m_train") - F.col("__gm")
    spread = seen.join(F.broadcast(centre), shared).groupBy(*shared).agg(
        F.first("__gm").alias("__gm"),
        F.sqrt(F.sum(F.col("__n") * (F.col("__v_train") + around * around)) / F.sum(F.when(F.col("__n") > 0, F.col("__n")))).alias("__gs"),
    )
    # one row per fold and channel, both short lists
    stats = seen.join(F.broadcast(spread), shared).select(
        *keys, "__gm", "__gs",
        F.coalesce("__m_train", "__m_val", "__m_test").alias("__sm"),
        F.sqrt(F.coalesce("__v_train", "__v_val", "__v_test")).alias("__ss"),
    )
    blocks = F.when(
        is_time, F.array(F.struct(F.lit("time").alias("block"), F.col(value).alias("scaled")))
    ).otherwise(F.array(
        F.struct(F.lit("global").alias("block"), ((F.col(value) - F.col("__gm")) / _guarded(F.col("__gs"))).alias("scaled")),
        F.struct(F.lit("subject").alias("block"), ((F.col(value) - F.col("__sm")) / _guarded(F.col("__ss"))).alias("scaled")),
    ))
    joined = long.join(stats, keys, "left")
    return joined.withColumn("__b", F.explode(blocks)).select(*long.columns, "__b.block", "__b.scaled")


#: A variance below this share of the mean square is rounding: sums of squares can't resolve it.
NO_SPREAD = 1e-12


def packed_scalers(rows: DataFrame, windows: DataFrame, channels: Sequence[str], by: Sequence[str], sample: Sequence[str]) -> DataFrame:
    """Per fold and participant what packed windows are scaled with: mean and deviation over all and of its own.

    A survey's window is reduced to its count, sum and sum of squares on the row, these are pooled per fold,
    participant and role. Participants without train rows are scaled by their validation rows, or else their test rows.
    """
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, v: s + f(v))
    sums = {}
    for c in channels:
        sums |= {f"__n_{c}": F.size(c).cast("double"), f"__s_{c}": total(c, lambda v: v), f"__q_{c}": total(c, lambda v: v * v)}
    moments = windows.select(*sample, *[v.alias(k) for k, v in sums.items()])
    # exploded fold rows and packed windows are far larger than Spark estimates: neither is broadcast
    pooled = rows.select(*{*by, *sample, "role", "app_user_id"}).join(moments.hint("merge"), list(sample)).groupBy(*by, "app_user_id").agg(
        *[F.sum(F.when(F.col("role") == r, F.col(k))).alias(f"{k}_{r}") for k in sums for r in ("train", "val", "test")]
    )
    pooled = cut_lineage(pooled)  # a row per fold and participant, read twice

    def mean_std(n: Column, s: Column, q: Column) -> tuple[Column, Column]:
        mean = F.try_divide(s, n)
        square = F.try_divide(q, n)
        variance = square - mean * mean
        return mean, F.when(variance > NO_SPREAD * square, F.sqrt(variance)).otherwise(1.0)

    everyone, own = [], []
    for c in channels:
        m, s = mean_std(*(F.sum(f"__{k}_{c}_train") for k in "nsq"))
        everyone += [m.alias(f"__gm_{c}"), s.alias(f"__gs_{c}")]
        has = [F.col(f"__n_{c}_{r}").isNotNull() for r in ("train", "val", "test")]
        pick = lambda k: F.when(has[0], F.col(f"__{k}_{c}_train")).when(has[1], F.col(f"__{k}_{c}_val")).otherwise(F.col(f"__{k}_{c}_test"))
        m, s = mean_std(*(pick(k) for k in "nsq"))
        own += [m.alias(f"__um_{c}"), s.alias(f"__us_{c}")]
    shared = pooled.groupBy(*by).agg(*everyone)
    each = pooled.select(*by, "app_user_id", *own).join(shared, list(by))
    return F.broadcast(each) if pooled.count() <= broadcast_rows(rows.sparkSession) else each


SCALED = (("global", "g"), ("subject", "u"))


def dual_scale_packed(
    rows: DataFrame, windows: DataFrame, channels: Sequence[str], by: Sequence[str] = FOLD, sample: Sequence[str] = ("survey_response_id",)
) -> tuple[DataFrame, list[str]]:
    """The fold rows with their packed windows scaled twice, and the new column names, global ones first.

    As ``dual_scale``, without exploding: arrays are scaled in place. ``sample`` are the columns that name a window.
    """
    each = packed_scalers(rows, windows, channels, by, sample)
    joined = rows.join(windows.select(*sample, *channels).hint("merge"), list(sample)).join(each, [*by, "app_user_id"])

    def scaled(c: str, kind: str) -> Column:
        return F.transform(c, lambda v: (v - F.col(f"__{kind}m_{c}")) / F.col(f"__{kind}s_{c}"))

    new = {f"{name}_{c}": scaled(c, kind) for name, kind in SCALED for c in channels}
    return joined.select(*rows.columns, *[v.alias(k) for k, v in new.items()]), list(new)


def dual_scale_stats(
    rows: DataFrame, windows: DataFrame, channels: Sequence[str], by: Sequence[str] = FOLD, sample: Sequence[str] = ("survey_response_id",)
) -> tuple[DataFrame, list[str]]:
    """The fold rows with the summary statistics of the windows of ``dual_scale_packed``, and their names.

    Scaling shifts and stretches a whole window, and its statistics with it: they are made once per survey,
    before the folds, and scaled on the fold rows. An empty window gives 0.
    """
    each = packed_scalers(rows, windows, channels, by, sample)
    held = window_stats(windows, channels, SUPPORTED_STATS, [*sample, *[(F.size(c) > 0).alias(f"__has_{c}") for c in channels]])
    joined = rows.join(held.hint("merge"), list(sample)).join(each, [*by, "app_user_id"])

    def scaled(c: str, stat: str, kind: str) -> Column:
        mean, value = F.col(f"__{kind}m_{c}"), F.col(f"{c}__{stat}")
        # a deviation is not shifted, but has no value where the mean has none
        shifted = value + (mean - mean) if stat == "std" else value - mean
        return F.when(F.col(f"__has_{c}"), shifted / F.col(f"__{kind}s_{c}")).otherwise(F.lit(0.0))

    new = {f"{name}_{c}__{stat}": scaled(c, stat, kind) for name, kind in SCALED for c in channels for stat in SUPPORTED_STATS}
    return joined.select(*rows.columns, *[v.alias(k) for k, v in new.items()]), list(new)


def _train_scale(df: DataFrame, column: str, defaults: tuple[float, float], by: Sequence[str]) -> DataFrame:
    """Adds ``__m`` and ``__s``: train mean and sample deviation per fold, defaults where undefined.

    One row per fold, so the statistics are broadcast.
    """
    value = F.when(F.col("role") == "train", F.col(column))
    stats = df.groupBy(*by).agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"))
    stats = stats.select(
        *by, F.coalesce("__m", F.lit(defaults[0])).alias("__m"),
        F.when(F.col("__s") > 0, F.col("__s")).otherwise(F.lit(defaults[1])).alias("__s"),
    )
    return df.join(F.broadcast(stats), list(by), "left")


def scale_sleep(df: DataFrame, by: Sequence[str] = FOLD) -> DataFrame:
    """Scaled sleep hours (missing → train mean, so 0) and the category as flags with "unknown"."""
    joined = _train_scale(df, "sleep_hours", SLEEP_DEFAULTS, by)
    flags = {
        f"sleep_class_{k}": F.coalesce((F.col("sleep_category") == k).cast("double"), F.lit(0.0)) for k in (0, 1, 2)
    }
    scaled = (F.coalesce("sleep_hours", "__m") - F.col("__m")) / F.col("__s")
    return joined.withColumns(
        {"sleep_hours_scaled": scaled, **flags, "sleep_unknown": F.col("sleep_category").isNull().cast("double")}
    ).drop("__m", "__s")


def survey_context(df: DataFrame, by: Sequence[str] = FOLD) -> DataFrame:
    """Morning flag, scaled hours since the previous response, and a flag for its absence."""
    joined = _train_scale(df, "referent_hours", REFERENT_DEFAULTS, by)
    morning = F.col("is_morning").cast("double") if "is_morning" in df.columns else F.lit(0.0)
    scaled = (F.coalesce("referent_hours", "__m") - F.col("__m")) / F.col("__s")
    return joined.withColumns(
        {
            "is_morning": morning,
            "referent_hours_scaled": scaled,
            "referent_missing": F.col("referent_hours").isNull().cast("double"),
        }
    ).drop("__m", "__s")


# Feature columns of each mode, and what a missing column is filled with.
SLEEP_MODES = {
    "hours_only": ("sleep_hours_scaled",),
    "category_only": ("sleep_class_0", "sleep_class_1", "sleep_class_2", "sleep_unknown"),
    "both": ("sleep_hours_scaled", "sleep_class_0", "sleep_class_1", "sleep_class_2", "sleep_unknown"),
    "none": (),
}
CONTEXT_MODES = {
    "morning_only": ("is_morning",),
    "referent_only": ("referent_hours_scaled", "referent_missing"),
    "both": ("is_morning", "referent_hours_scaled", "referent_missing"),
    "none": (),
}
FLAG_COLUMNS = ("sleep_unknown", "referent_missing")


def feature_mode(df: DataFrame, sleep: str | None = "both", context: str | None = "both", keep: Sequence[str] = ()) -> DataFrame:
    """Feature columns of the chosen modes; an absent column is 0, an absent "unknown" flag 1.

    Any mode name that is not listed means both, as a missing one means none.
    """
    names = [*SLEEP_MODES.get(sleep or "none", SLEEP_MODES["both"]), *CONTEXT_MODES.get(context or "none", CONTEXT_MODES["both"])]
    filled = [
        F.col(n) if n in df.columns else F.lit(1.0 if n in FLAG_COLUMNS else 0.0).alias(n) for n in names
    ]
    return df.select(*keep, *filled)


def class_weights(df: DataFrame, by: Sequence[str] = FOLD, classes: Sequence[int] = (0, 1), label: str = "answer") -> DataFrame:
    """Balanced weight per (fold, class): ``n / (classes · count)``, counts at least 1."""
    counts = df.filter("role = 'train'").groupBy(*by).agg(
        *[F.greatest(F.count_if(F.col(label) == c), F.lit(1)).alias(f"__c{c}") for c in classes]
    )
    total = sum((F.col(f"__c{c}") for c in classes), F.lit(0))
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("label"), F.col(f"__c{c}").alias("n"),
            (total / (F.lit(len(classes)) * F.col(f"__c{c}"))).alias("weight"),
        )
        for c in classes
    ])
    return counts.select(*by, F.explode(rows).alias("__w")).select(*by, "__w.*")


def with_class_weights(df: DataFrame, explicit: Sequence[float] | None = None, by: Sequence[str] = FOLD, label: str = "answer") -> DataFrame:
    """Adds a ``weight`` column: explicit weights by class, or balanced ones per fold."""
    if explicit is not None:
        table = F.array(*[F.lit(float(w)) for w in explicit])
        return df.withColumn("weight", F.element_at(table, F.col(label).cast("int") + 1))
    weights = class_weights(df, by, label=label).select(*by, F.col("label").cast("bigint").alias(label), "weight")
    return df.withColumn(label, F.col(label).cast("bigint")).join(F.broadcast(weights), [*by, label], "left")
