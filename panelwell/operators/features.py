"""Window features over packed windows (one array of bin sums per survey and channel).

All of them are array expressions on the row: no shuffle beyond the one that packed the window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUPPORTED_STATS = ("mean", "median", "std", "min", "max")
INPUT_STATS = ("mean", "std", "min", "max", "last")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, also when a lambda in ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def array_mean(a: Column) -> Column:
    return F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, v: s + v), F.size(a))


def array_std(a: Column, ddof: int = 0) -> Column:
    """Two passes: the mean first, then squared deviations."""

    def spread(mean: Column) -> Column:
        squares = F.aggregate(a, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean))
        return F.sqrt(F.try_divide(squares, F.size(a) - ddof))

    return let(array_mean(a), spread)


def array_median(a: Column) -> Column:
    n = F.size(a)

    def middle(ordered: Column) -> Column:
        upper = F.element_at(ordered, (F.floor(n / 2) + 1).cast("int"))
        lower = F.element_at(ordered, F.greatest(F.floor((n + 1) / 2), F.lit(1)).cast("int"))
        return (lower + upper) / 2.0

    # sort_array compares without a lambda; it has nulls first, where they count as last
    return F.when(F.get(F.sort_array(a), F.lit(0)).isNotNull(), middle(F.sort_array(a))).otherwise(middle(F.array_sort(a)))


_STATS = {
    "mean": array_mean,
    "median": array_median,
    "std": array_std,
    "min": F.array_min,
    "max": F.array_max,
    "last": lambda a: F.element_at(a, -1),
}


def feature_names(channels: Sequence[str], stats: Sequence[str], n_channels: int | None = None) -> list[str]:
    """``<channel>__<stat>``; channels without a name are called by their position."""
    total = len(channels) if n_channels is None else n_channels
    names = list(channels[:total]) + [f"col{i}" for i in range(len(channels), total)]
    return [f"{c}__{s}" for c in names for s in stats]


def exclude_time_columns(channels: Sequence[str], exclude_last_n: int | str | None = "auto", n_time: int = 0) -> list[str]:
    """Channels without the trailing time columns; leaving none is an error."""
    n = n_time if exclude_last_n in ("auto", None) else int(exclude_last_n)
    kept = list(channels[: len(channels) - n]) if n else list(channels)
    if not kept:
        raise ValueError(f"all {len(channels)} channels are time channels ({exclude_last_n}); nothing is left to describe")
    return kept


def select_channels(channels: Sequence[str], mode: str = "global", n_modalities: int | None = None) -> list[str]:
    """One half of doubled channels: the globally or the subject-scaled block; ``all`` keeps both."""
    if mode not in ("all", "global", "subject"):
        raise ValueError(f"channel mode {mode!r} is none of all, global, subject")
    channels, n = list(channels), len(channels)
    if mode == "all" or n % 2 or n == 0 or n == n_modalities:
        return channels
    half = n_modalities if n_modalities is not None and n == 2 * n_modalities else n // 2
    return channels[:half] if mode == "global" else channels[half : 2 * half]


def window_stats(windows: DataFrame, channels: Sequence[str], stats: Sequence[str], keep: Sequence[str]) -> DataFrame:
    columns = []
    for c in channels:
        for s in stats:
            columns.append(
                F.when(F.size(c) > 0, _STATS[s](F.col(c))).otherwise(F.lit(0.0)).alias(f"{c}__{s}")
            )
    return windows.select(*keep, *columns)


def summary_stats(
    windows: DataFrame,
    channels: Sequence[str],
    stats: Sequence[str] = SUPPORTED_STATS,
    keep: Sequence[str] = ("survey_response_id",),
) -> DataFrame:
    """Mean, median, population deviation, minimum and maximum over the bins of each channel.

    An empty window gives 0. Columns come channel by channel.
    """
    unknown = sorted(set(stats) - set(SUPPORTED_STATS))
    if unknown:
        raise ValueError(f"no such window statistics: {unknown}")
    return window_stats(windows, channels, stats, keep)


def input_stats(windows: DataFrame, channels: Sequence[str], keep: Sequence[str] = ("survey_response_id",)) -> DataFrame:
    """Mean, population deviation, minimum, maximum and last value per channel."""
    return window_stats(windows, channels, INPUT_STATS, keep)


def flatten_window(
    windows: DataFrame, channels: Sequence[str], name: str = "features", keep: Sequence[str] = ("survey_response_id",)
) -> DataFrame:
    """Bins × channels as one array, bin by bin."""
    rows = F.arrays_zip(*[F.col(c) for c in channels])
    flat = F.flatten(F.transform(rows, lambda r: F.array(*[r[c] for c in channels])))
    return windows.select(*keep, flat.alias(name))


def flatten_columns(windows: DataFrame, channels: Sequence[str], n_bins: int, keep: Sequence[str] = ("survey_response_id",)) -> DataFrame:
    """The same as ``n_bins`` × channels named columns."""
    cells = [F.get(F.col(c), b).alias(f"{c}__{b}") for b in range(n_bins) for c in channels]
    return windows.select(*keep, *cells)


def assemble_features(
    df: DataFrame,
    window_columns: Sequence[str],
    demographic_columns: Sequence[str] = (),
    sleep_columns: Sequence[str] = (),
    context_columns: Sequence[str] = (),
    name: str = "features",
    keep: Sequence[str] = ("survey_response_id",),
) -> DataFrame:
    """One feature array per sample: window, demographics, sleep, context, in this order."""
    ordered = [*window_columns, *demographic_columns, *sleep_columns, *context_columns]
    parts = []
    for c in ordered:
        is_array = df.schema[c].dataType.typeName() == "array"
        parts.append(F.col(c).cast("array<double>") if is_array else F.array(F.col(c).cast("double")))
    return df.select(*keep, F.concat(*parts).alias(name))
