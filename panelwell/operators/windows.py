"""Look-back windows: bins, samplers, the coverage gate.

All windows are read from one packed history. Sensor rows are summed per (user, block, slot),
where a block is ``SLOTS`` base bins; a survey looks up the few blocks its widest window
touches, and every (lookback, bin) setting is a slice of that array. So the whole setting grid
costs one scan, one partial aggregation and one equi-join on (user, block).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwell.functions.timegrid import (
    MICROS_PER_DAY,
    MICROS_PER_HOUR,
    cyclic_hour,
    cyclic_weekday,
    floor_div,
    from_micros,
    grid_index,
    hours_to_micros,
    micros,
)
from panelwell.operators.ordered import ordered_columns

#: Base bins per block.
SLOTS = 12
TIME_CHANNELS = ("sin_hour", "cos_hour", "sin_weekday", "cos_weekday")


@dataclass(frozen=True)
class RollingSampler:
    """``lookback_hours`` before the survey time floored to the bin width."""

    lookback_hours: float = 24.0
    freq_hours: float = 1.0
    time_features: bool = True

    def __post_init__(self) -> None:
        _check_multiple("lookback_hours", self.lookback_hours, self.freq_hours)

    @property
    def n_bins(self) -> int:
        return round(self.lookback_hours / self.freq_hours)

    @property
    def window_hours(self) -> float:
        return self.lookback_hours

    @property
    def time_channels(self) -> tuple[str, ...]:
        return TIME_CHANNELS if self.time_features else ()

    @property
    def grid_hours(self) -> list[float]:
        return [self.freq_hours]

    def end_micros(self, ts: Column) -> Column:
        us = micros(ts)
        return us - F.pmod(us, F.lit(hours_to_micros(self.freq_hours)).cast("bigint"))


@dataclass(frozen=True)
class OffsetSampler:
    """Hours ``start`` to ``end`` around the midnight of the survey day."""

    start_hours: float = -24.0
    end_hours: float = 0.0
    freq_hours: float = 1.0
    time_features: bool = True

    def __post_init__(self) -> None:
        if self.end_hours <= self.start_hours:
            raise ValueError("end_hours must be after start_hours")
        _check_multiple("end_hours - start_hours", self.end_hours - self.start_hours, self.freq_hours)
        _check_multiple("start_hours", self.start_hours, self.freq_hours)
        # bins are counted from the epoch, so midnight must lie on the bin grid as well
        _check_multiple("24 hours", 24.0, self.freq_hours)

    @property
    def n_bins(self) -> int:
        return round((self.end_hours - self.start_hours) / self.freq_hours)

    @property
    def window_hours(self) -> float:
        return self.end_hours - self.start_hours

    @property
    def time_channels(self) -> tuple[str, ...]:
        return TIME_CHANNELS[2:] if self.time_features else ()

    @property
    def grid_hours(self) -> list[float]:
        return [self.freq_hours, self.end_hours]

    def end_micros(self, ts: Column) -> Column:
        us = micros(ts)
        midnight = us - F.pmod(us, F.lit(MICROS_PER_DAY).cast("bigint"))
        return midnight + F.lit(hours_to_micros(self.end_hours)).cast("bigint")


Sampler = RollingSampler | OffsetSampler

# The 5 × 4 grid of settings.
GRID_LOOKBACKS = (24, 48, 72, 96, 120)
GRID_BINS = (4, 6, 8, 12)


def sampler_grid() -> list[RollingSampler]:
    return [RollingSampler(float(lb), float(b)) for lb in GRID_LOOKBACKS for b in GRID_BINS]


def lookback_hours(sampler: Sampler | None) -> float:
    """Width of a sampler's window, the default purge of the splits; 0 without a sampler."""
    return 0.0 if sampler is None else sampler.window_hours


def _check_multiple(name: str, hours: float, width: float) -> None:
    if width <= 0 or hours_to_micros(hours) % hours_to_micros(width):
        raise ValueError(f"{name} ({hours} h) must be a multiple of the bin width ({width} h)")


def base_micros(samplers: Sequence[Sampler]) -> int:
    """The widest bin that all windows and bins of the samplers are multiples of."""
    return math.gcd(*[hours_to_micros(h) for s in samplers for h in s.grid_hours])


def window_bounds(df: DataFrame, sampler: Sampler, ts: str = "record_timestamp") -> DataFrame:
    """Adds the half-open span ``[window_start, window_end)``."""
    end = sampler.end_micros(F.col(ts))
    start = end - F.lit(hours_to_micros(sampler.window_hours)).cast("bigint")
    return df.withColumns({"window_start": from_micros(start), "window_end": from_micros(end)})


def bin_sum(sensors: DataFrame, freq_hours: float) -> DataFrame:
    """Sum of a modality per user and epoch-aligned bin; partial sums come before the shuffle."""
    width = hours_to_micros(freq_hours)
    index = grid_index(F.col("start_timestamp"), width)
    return (
        sensors.groupBy("app_user_id", "modality", index.alias("__bin"))
        .agg(F.sum("value").alias("value"))
        .select("app_user_id", "modality", from_micros(F.col("__bin") * F.lit(width).cast("bigint")).alias("bin_start"), "value")
    )


def pack_blocks(sensors: DataFrame, modalities: Sequence[str], base: int) -> DataFrame:
    """Per user and block one array of ``SLOTS`` sums for each modality, in one aggregation."""
    index = grid_index(F.col("start_timestamp"), base)
    placed = sensors.filter(F.col("modality").isin(*modalities)).select(
        "app_user_id", "modality", "value",
        floor_div(index, SLOTS).alias("block"),
        F.pmod(index, F.lit(SLOTS)).cast("int").alias("slot"),
    )
    arrays = [
        F.array(*[
            F.coalesce(F.sum(F.when((F.col("modality") == m) & (F.col("slot") == s), F.col("value"))), F.lit(0.0))
            for s in range(SLOTS)
        ]).alias(f"__{i}")
        for i, m in enumerate(modalities)
    ]
    # a hot user is reduced to its blocks by the map-side combine, before the only shuffle
    return placed.groupBy("app_user_id", "block").agg(*arrays)


def packed_history(
    surveys: DataFrame,
    sensors: DataFrame,
    samplers: Sequence[Sampler],
    modalities: Sequence[str],
    key: str = "survey_response_id",
    ts: str = "record_timestamp",
) -> DataFrame:
    """Surveys with ``__first`` (base bin number) and, per modality, the array of base-bin sums
    over the union of all sampler windows. Missing bins are 0."""
    base = base_micros(samplers)
    width = F.lit(base).cast("bigint")
    ends = [s.end_micros(F.col(ts)) for s in samplers]
    starts = [e - F.lit(hours_to_micros(s.window_hours)).cast("bigint") for e, s in zip(ends, samplers)]
    low = F.least(*starts) if len(starts) > 1 else starts[0]
    high = F.greatest(*ends) if len(ends) > 1 else ends[0]
    slots = F.lit(SLOTS).cast("bigint")
    placed = surveys.withColumns({"__lo": F.call_function("div", low, width), "__hi": F.call_function("div", high, width)})
    placed = placed.withColumns(
        {"__b0": floor_div(F.col("__lo"), SLOTS), "__b1": floor_div(F.col("__hi") - 1, SLOTS)}
    )
    # survey columns travel with the look-up, so the surveys are read once
    carried = [c for c in placed.columns if c != key]
    wanted = placed.withColumn("block", F.explode(F.sequence("__b0", "__b1")))
    blocks = pack_blocks(sensors, modalities, base)
    cells = F.struct(*[F.col(f"__{i}") for i in range(len(modalities))])
    found = F.when(F.col("__0").isNotNull(), F.struct(F.col("block"), cells.alias("cell")))
    joined = (
        wanted.join(blocks, ["app_user_id", "block"], "left")
        .groupBy(key)
        .agg(
            F.first(F.struct(*carried)).alias("__row"),
            # a survey reads a handful of blocks, so the map is small; nulls are left out of it
            F.map_from_entries(F.collect_list(found)).alias("__cells"),
        )
        .select(key, "__row.*", "__cells")
    )
    zeros = F.array_repeat(F.lit(0.0), SLOTS)

    def series(i: int) -> Column:
        whole = F.flatten(
            F.transform(
                F.sequence("__b0", "__b1"),
                lambda b: F.coalesce(F.try_element_at("__cells", b)[f"__{i}"], zeros),
            )
        )
        return F.slice(
            whole, (F.col("__lo") - F.col("__b0") * slots + 1).cast("int"), (F.col("__hi") - F.col("__lo")).cast("int")
        )

    return joined.select(
        *surveys.columns, F.col("__lo").alias("__first"),
        *[series(i).alias(f"__h_{m}") for i, m in enumerate(modalities)],
    )


def _rolled(series: Column, start: Column, ratio: int, n_bins: int) -> Column:
    """``n_bins`` sums of ``ratio`` neighbouring base bins each, from position ``start`` (0 is the first) of a series on."""
    if ratio == 1:
        return F.slice(series, start + 1, n_bins)
    # the bins are few and known, so each is written out: lambdas would be interpreted for each value
    return F.array(*[sum((F.get(series, start + (b * ratio + i)) for i in range(ratio)), F.lit(0.0)) for b in range(n_bins)])


def _setting_windows(
    history: DataFrame, sampler: Sampler, modalities: Sequence[str], base: int, ts: str, keep: Sequence[str]
) -> DataFrame:
    ratio = hours_to_micros(sampler.freq_hours) // base
    span = hours_to_micros(sampler.window_hours) // base
    end = sampler.end_micros(F.col(ts))
    start = F.call_function("div", end, F.lit(base).cast("bigint")) - F.lit(span) - F.col("__first")

    def bins(name: str) -> Column:
        return _rolled(F.col(name), start.cast("int"), ratio, sampler.n_bins)

    return history.select(
        *keep, from_micros(end).alias("window_end"), *[bins(f"__h_{m}").alias(m) for m in modalities]
    )


def packed_windows(
    surveys: DataFrame,
    sensors: DataFrame,
    sampler: Sampler,
    modalities: Sequence[str],
    key: str = "survey_response_id",
    ts: str = "record_timestamp",
) -> DataFrame:
    """One row per survey with an array of bin sums per modality, oldest bin first."""
    modalities = sorted(modalities)
    history = packed_history(surveys, sensors, [sampler], modalities, key, ts)
    return _setting_windows(history, sampler, modalities, base_micros([sampler]), ts, surveys.columns)


def packed_grid(
    surveys: DataFrame,
    sensors: DataFrame,
    samplers: Sequence[RollingSampler],
    modalities: Sequence[str],
    key: str = "survey_response_id",
    ts: str = "record_timestamp",
) -> DataFrame:
    """The same for many settings from one packed history; adds ``lookback_hours`` and ``bin_hours``."""
    modalities = sorted(modalities)
    base = base_micros(samplers)
    history = packed_history(surveys, sensors, samplers, modalities, key, ts)
    # settings of one bin width end at the same bin, so they are slices of its longest window
    longest = {s.freq_hours: s for s in sorted(samplers, key=lambda s: s.n_bins)}
    rolled: dict[str, Column] = {}
    for i, s in enumerate(longest.values()):
        ratio, span = hours_to_micros(s.freq_hours) // base, hours_to_micros(s.window_hours) // base
        start = F.call_function("div", s.end_micros(F.col(ts)), F.lit(base).cast("bigint")) - F.lit(span) - F.col("__first")
        for m in modalities:
            rolled[f"__r{i}_{m}"] = _rolled(F.col(f"__h_{m}"), start.cast("int"), ratio, s.n_bins)
    number = {freq: i for i, freq in enumerate(longest)}
    settings = F.array(*[
        F.struct(
            F.lit(s.lookback_hours).alias("lookback_hours"), F.lit(s.freq_hours).alias("bin_hours"),
            from_micros(s.end_micros(F.col(ts))).alias("window_end"),
            *[
                F.slice(f"__r{number[s.freq_hours]}_{m}", longest[s.freq_hours].n_bins - s.n_bins + 1, s.n_bins).alias(m)
                for m in modalities
            ],
        )
        for s in samplers
    ])
    exploded = history.withColumns(rolled).select(*surveys.columns, F.explode(settings).alias("__s"))
    return exploded.select(*surveys.columns, "__s.*")


def window_bin_join(windows: DataFrame, sampler: Sampler, modalities: Sequence[str], keep: Sequence[str] = ("survey_response_id",)) -> DataFrame:
    """Packed windows as long rows ``(…, modality, bin_idx, bin_start, value)``."""
    width = F.lit(hours_to_micros(sampler.freq_hours)).cast("bigint")
    n = sampler.n_bins
    values = F.arrays_zip(*[F.col(m) for m in sorted(modalities)])
    exploded = windows.select(*keep, "window_end", F.posexplode(values).alias("bin_idx", "__v"))
    pairs = F.array(*[F.struct(F.lit(m).alias("modality"), F.col(f"__v.{m}").alias("value")) for m in sorted(modalities)])
    start = from_micros(micros(F.col("window_end")) + (F.col("bin_idx") - n).cast("bigint") * width)
    return exploded.select(*keep, "bin_idx", start.alias("bin_start"), F.explode(pairs).alias("__p")).select(
        *keep, "__p.modality", "bin_idx", "bin_start", "__p.value"
    )


def cyclic_time(bins: DataFrame, channels: Sequence[str] = TIME_CHANNELS, start: str = "bin_start") -> DataFrame:
    """Adds the sine and cosine of the bin's hour and weekday."""
    made = dict(zip(TIME_CHANNELS, [*cyclic_hour(F.col(start)), *cyclic_weekday(F.col(start))]))
    return bins.withColumns({c: made[c] for c in channels})


def sample_windows(
    surveys: DataFrame,
    sensors: DataFrame,
    sampler: Sampler,
    modalities: Sequence[str],
    key: str = "survey_response_id",
    ts: str = "record_timestamp",
) -> DataFrame:
    """A sampler's matrix, one row per (survey, bin): modality columns in name order, then time channels."""
    modalities = sorted(modalities)
    windows = packed_windows(surveys.select(key, "app_user_id", ts), sensors, sampler, modalities, key, ts)
    width = F.lit(hours_to_micros(sampler.freq_hours)).cast("bigint")
    values = F.arrays_zip(*[F.col(m) for m in modalities])
    exploded = windows.select(key, "app_user_id", "window_end", F.posexplode(values).alias("bin_idx", "__v"))
    start = from_micros(micros(F.col("window_end")) + (F.col("bin_idx") - sampler.n_bins).cast("bigint") * width)
    rows = exploded.select(key, "app_user_id", "bin_idx", start.alias("bin_start"), *[F.col(f"__v.{m}").alias(m) for m in modalities])
    return cyclic_time(rows, sampler.time_channels)


def sensor_reach(sensors: DataFrame, base: int) -> DataFrame:
    """Per user and base bin of the start: the latest end.

    Without an end column a record ends where it starts; a null end in the column covers nothing.
    """
    end = F.col("end_timestamp") if "end_timestamp" in sensors.columns else F.col("start_timestamp")
    return sensors.groupBy("app_user_id", grid_index(F.col("start_timestamp"), base).alias("__b")).agg(
        F.max(micros(end)).alias("__reach")
    )


def coverage_flags(
    surveys: DataFrame, sensors: DataFrame, samplers: Sequence[Sampler], ts: str = "record_timestamp", max_group: int | None = None
) -> DataFrame:
    """Surveys × settings with the ``setting`` number and ``covered``: some record overlaps the window.

    A record overlaps when it starts before the window end and ends after the window start.
    Window ends lie on the base grid, so "starts before the end" is a matter of whole bins, and
    the records can be reduced to the latest end per (user, bin). A running maximum of that
    gives, for each window end a survey asks for, how far the records before it reach. Both
    sides are bounded by the number of bins in a user's history, however many rows there are;
    no record is spread over the time it spans, and nothing is paired within a user. ``max_group``
    is a proven bound on a user's surveys and records together; without it they are counted.
    """
    base = base_micros(samplers)
    width = F.lit(base).cast("bigint")
    settings = F.array(*[
        F.struct(
            F.lit(i).alias("setting"),
            F.call_function("div", s.end_micros(F.col(ts)), width).alias("__b"),
            (s.end_micros(F.col(ts)) - F.lit(hours_to_micros(s.window_hours)).cast("bigint")).alias("__start"),
        )
        for i, s in enumerate(samplers)
    ])
    asked = surveys.withColumn("__s", F.explode(settings)).select(*surveys.columns, "__s.*")
    ends = asked.select("app_user_id", "__b").distinct().select(
        "app_user_id", "__b", F.lit(0).alias("__kind"), F.lit(None).cast("bigint").alias("__reach")
    )
    reach = sensor_reach(sensors, base).select("app_user_id", "__b", F.lit(1).alias("__kind"), "__reach")
    # the end of a window sorts before the records of the bin that starts there
    steps = ordered_columns(
        ends.unionByName(reach), ["app_user_id"], [F.col("__b"), F.col("__kind")],
        maxima={"__upto": F.col("__reach")},
        # a survey asks for one window end per setting at most, a record reaches from one bin
        max_group=None if max_group is None else max_group * len(samplers),
    )
    lookup = steps.filter("__kind = 0").select("app_user_id", "__b", "__upto")
    return asked.join(lookup, ["app_user_id", "__b"]).select(
        *surveys.columns, "setting", F.coalesce(F.col("__upto") > F.col("__start"), F.lit(False)).alias("covered")
    )


def coverage_gate(
    surveys: DataFrame, sensors: DataFrame, sampler: Sampler | None, ts: str = "record_timestamp", max_group: int | None = None
) -> DataFrame:
    """Surveys with at least one record in their window; without a sampler all stay."""
    if sampler is None:
        return surveys
    return coverage_flags(surveys, sensors, [sampler], ts, max_group).filter("covered").select(*surveys.columns)


def covered_by_setting(
    surveys: DataFrame, sensors: DataFrame, samplers: Sequence[RollingSampler], ts: str = "record_timestamp", max_group: int | None = None
) -> DataFrame:
    """Covered surveys of every setting, one row per (survey, setting), from one pass."""
    settings = F.array(*[
        F.struct(F.lit(s.lookback_hours).alias("lookback_hours"), F.lit(s.freq_hours).alias("bin_hours")) for s in samplers
    ])
    covered = coverage_flags(surveys, sensors, samplers, ts, max_group).filter("covered")
    return covered.withColumn("__s", F.element_at(settings, F.col("setting") + 1)).select(*surveys.columns, "__s.*")


def cohort_members(rows: DataFrame) -> DataFrame:
    """Per setting and participant: surveys and positives among the given (tested) surveys."""
    return rows.groupBy("lookback_hours", "bin_hours", "app_user_id").agg(
        F.count(F.lit(1)).alias("n_surveys"), F.sum("answer").cast("bigint").alias("n_positive")
    )


def cohort_by_setting(members: DataFrame) -> DataFrame:
    """Participants, surveys and positives per setting. Who they are stays in the member table."""
    return members.groupBy("lookback_hours", "bin_hours").agg(
        F.count(F.lit(1)).alias("n_participants"),
        F.sum("n_surveys").cast("bigint").alias("n_surveys"),
        F.sum("n_positive").cast("bigint").alias("n_positive"),
    )
