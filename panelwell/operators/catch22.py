"""The 22 canonical time-series characteristics of each window channel.

Definitions follow the published feature set (Lubba et al. 2019), on the z-scored series. All of
them are array expressions on packed windows; a window is one row. Windows are few bytes but much work,
so they are dealt to all cores first.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwell.operators.features import array_mean, array_std, let
from panelwell.operators.signals import (
    after,
    before,
    count_equal,
    differences,
    embedding_fit,
    fluctuation_split,
    letter_pairs,
    low_frequency_power,
    middle_frequency,
    outlier_timing,
    spectral_density,
    spline_period,
    tercile_letters,
    total,
    transition_spread,
)
from panelwell.session import shuffle_partitions

# The published feature names, in their published order.
NAMES = (
    "DN_HistogramMode_5",
    "DN_HistogramMode_10",
    "CO_f1ecac",
    "CO_FirstMin_ac",
    "CO_HistogramAMI_even_2_5",
    "CO_trev_1_num",
    "MD_hrv_classic_pnn40",
    "SB_BinaryStats_mean_longstretch1",
    "SB_TransitionMatrix_3ac_sumdiagcov",
    "PD_PeriodicityWang_th0_01",
    "CO_Embed2_Dist_tau_d_expfit_meandiff",
    "IN_AutoMutualInfoStats_40_gaussian_fmmi",
    "FC_LocalSimple_mean1_tauresrat",
    "DN_OutlierInclude_p_001_mdrmd",
    "DN_OutlierInclude_n_001_mdrmd",
    "SP_Summaries_welch_rect_area_5_1",
    "SB_BinaryStats_diff_longstretch0",
    "SB_MotifThree_quantile_hh",
    "SC_FluctAnal_2_rsrangefit_50_1_logi_prop_r1",
    "SC_FluctAnal_2_dfa_50_1_2_logi_prop_r1",
    "SP_Summaries_welch_rect_centroid",
    "FC_LocalSimple_mean3_stderr",
)


def _lags(n: Column) -> Column:
    return F.sequence(F.lit(0), n - 1)


def autocorrelation(centred: Column) -> Column:
    """Sum of lagged products over the sum of squares of a centred series, for lags 0..n-1."""

    def over(power: Column) -> Column:
        return F.transform(
            _lags(F.size(centred)),
            lambda lag: F.try_divide(total(F.zip_with(after(centred, lag), before(centred, lag), lambda x, y: x * y)), power),
        )

    return let(total(F.transform(centred, lambda v: v * v)), over)


def histogram_mode(z: Column, bins: int) -> Column:
    """Centre of the fullest of equal-width bins; the mean of the centres on a tie."""

    def from_range(edge: Column) -> Column:
        low, width = edge["low"], edge["width"]
        placed = F.transform(z, lambda v: F.least(F.floor(F.try_divide(v - low, width)), F.lit(bins - 1)))
        return let(placed, lambda p: from_bins(p, low, width))

    def from_bins(placed: Column, low: Column, width: Column) -> Column:
        counts = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(placed, lambda p: p == b)))
        return let(
            counts,
            lambda c: array_mean(F.filter(
                F.transform(c, lambda k, i: F.when(k == F.array_max(c), low + width * (i + 0.5))), lambda v: v.isNotNull()
            )),
        )

    span = F.struct(F.array_min(z).alias("low"), ((F.array_max(z) - F.array_min(z)) / bins).alias("width"))
    return let(span, from_range)


def first_one_over_e(ac: Column) -> Column:
    """First lag where the autocorrelation falls below 1/e, interpolated; n if it never does."""
    limit = F.lit(1 / math.e)
    crossings = F.filter(
        F.transform(_lags(F.size(ac) - 1), lambda i: F.when(F.get(ac, i + 1) < limit, i.cast("double") + F.try_divide(limit - F.get(ac, i), F.get(ac, i + 1) - F.get(ac, i)))),
        lambda v: v.isNotNull(),
    )
    return F.coalesce(F.get(crossings, 0), F.size(ac).cast("double"))


def first_minimum(values: Column, default: Column) -> Column:
    """First position that is below both neighbours."""
    spots = F.filter(
        F.sequence(F.lit(1), F.greatest(F.size(values) - 2, F.lit(1))),
        lambda i: (F.get(values, i) < F.get(values, i - 1)) & (F.get(values, i) < F.get(values, i + 1)),
    )
    return F.coalesce(F.get(spots, 0), default).cast("double")


def first_zero(ac: Column) -> Column:
    spots = F.filter(_lags(F.size(ac)), lambda i: F.get(ac, i) <= 0)
    return F.coalesce(F.get(spots, 0), F.size(ac)).cast("double")


def longest_run(flags: Column) -> Column:
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(state: Column, flag: Column) -> Column:
        run = F.when(flag, state["run"] + 1).otherwise(F.lit(0))
        return F.struct(run.alias("run"), F.greatest(state["best"], run).alias("best"))

    return F.aggregate(flags, start, step, lambda s: s["best"]).cast("double")


def histogram_ami(z: Column, lag: int = 2, bins: int = 5) -> Column:
    """Mutual information of the series and its lagged self over equal-width bins."""

    def label(edge: Column) -> Column:
        return F.transform(z, lambda v: F.least(F.floor((v - edge["low"]) / edge["width"]), F.lit(bins - 1)))

    def information(pairs: Column) -> Column:
        def term(cell: Column) -> Column:
            joint = F.size(F.filter(pairs, lambda p: p == cell))
            left = F.size(F.filter(pairs, lambda p: F.floor(p / bins) == F.floor(cell / bins)))
            right = F.size(F.filter(pairs, lambda p: p % bins == cell % bins))
            n = F.size(pairs)
            return F.when(joint > 0, joint / n * F.log(joint * n / (left * right))).otherwise(F.lit(0.0))

        return total(F.transform(F.array_distinct(pairs), term))

    span = F.struct(
        (F.array_min(z) - 0.1).alias("low"), ((F.array_max(z) - F.array_min(z) + 0.2) / bins).alias("width")
    )
    labels = let(span, label)
    return let(labels, lambda x: let(F.zip_with(before(x, lag), after(x, lag), lambda a, b: a * bins + b), information))


def _lag_correlation(z: Column, lag: Column) -> Column:
    """Correlation of a z-scored series with its lagged self, from sums of one pass."""
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("x", "y", "xx", "yy", "xy")])
    pairs = F.zip_with(before(z, lag), after(z, lag), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def add(s: Column, p: Column) -> Column:
        a, b = p["a"], p["b"]
        return F.struct(
            (s["x"] + a).alias("x"), (s["y"] + b).alias("y"), (s["xx"] + a * a).alias("xx"),
            (s["yy"] + b * b).alias("yy"), (s["xy"] + a * b).alias("xy"),
        )

    n = F.size(z) - lag

    def finish(s: Column) -> Column:
        spread = (n * s["xx"] - s["x"] * s["x"]) * (n * s["yy"] - s["y"] * s["y"])
        return F.try_divide(n * s["xy"] - s["x"] * s["y"], F.when(spread > 0, F.sqrt(spread)))

    return F.aggregate(pairs, zero, add, finish)


def gaussian_ami_minimum(z: Column, most: int = 40) -> Column:
    top = F.least(F.lit(most), F.ceil(F.size(z) / 2).cast("int"))
    info = F.transform(
        F.transform(F.sequence(F.lit(1), top), lambda lag: _lag_correlation(z, lag)), lambda r: -0.5 * F.log(1 - r * r)
    )
    return let(info, lambda values: first_minimum(values, top))


def motif_entropy(z: Column) -> Column:
    """Entropy of two-letter words over a three-letter quantile alphabet."""

    def entropy(found: Column) -> Column:
        share = F.transform(F.array_distinct(found), lambda w: F.try_divide(count_equal(found, w), F.size(found)))
        return -total(F.transform(share, lambda p: p * F.log(p)))

    return let(let(tercile_letters(z), letter_pairs), entropy)


def expression_features(z: Column, ac: Column, ac_diff: Column, density: Column) -> dict[str, Column]:
    """All features of a z-scored series, given two autocorrelations and the power density."""
    step = differences(z)
    means = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(z) - 4, F.lit(0))),
        lambda i: F.get(z, i + 3) - (F.get(z, i) + F.get(z, i + 1) + F.get(z, i + 2)) / 3.0,
    )
    forecast = F.filter(means, lambda v: v.isNotNull())
    return {
        "DN_HistogramMode_5": histogram_mode(z, 5),
        "DN_HistogramMode_10": histogram_mode(z, 10),
        "CO_f1ecac": first_one_over_e(ac),
        "CO_FirstMin_ac": first_minimum(ac, F.size(ac)),
        "CO_HistogramAMI_even_2_5": histogram_ami(z),
        "CO_trev_1_num": array_mean(F.transform(step, lambda d: d * d * d)),
        "MD_hrv_classic_pnn40": F.try_divide(F.size(F.filter(step, lambda d: F.abs(d) * 1000 > 40)), F.size(step)),
        "SB_BinaryStats_mean_longstretch1": longest_run(F.transform(z, lambda v: v > 0)),
        "IN_AutoMutualInfoStats_40_gaussian_fmmi": gaussian_ami_minimum(z),
        "FC_LocalSimple_mean1_tauresrat": F.try_divide(first_zero(ac_diff), first_zero(ac)),
        "SB_BinaryStats_diff_longstretch0": longest_run(F.transform(step, lambda d: d < 0)),
        "SB_MotifThree_quantile_hh": motif_entropy(z),
        "FC_LocalSimple_mean3_stderr": let(forecast, lambda r: F.when(F.size(r) > 1, array_std(r, 1))),
        "SB_TransitionMatrix_3ac_sumdiagcov": transition_spread(z, first_zero(ac).cast("int")),
        "PD_PeriodicityWang_th0_01": spline_period(z),
        "CO_Embed2_Dist_tau_d_expfit_meandiff": embedding_fit(z, first_zero(ac)),
        "DN_OutlierInclude_p_001_mdrmd": outlier_timing(z, 1),
        "DN_OutlierInclude_n_001_mdrmd": outlier_timing(z, -1),
        "SP_Summaries_welch_rect_area_5_1": low_frequency_power(density),
        "SP_Summaries_welch_rect_centroid": middle_frequency(density),
        "SC_FluctAnal_2_rsrangefit_50_1_logi_prop_r1": fluctuation_split(z, 1, "range"),
        "SC_FluctAnal_2_dfa_50_1_2_logi_prop_r1": fluctuation_split(z, 2, "dfa"),
    }


def _standardised(channel: str) -> Column:
    mean, spread = F.col(f"__m_{channel}"), F.col(f"__s_{channel}")
    return F.when(spread.isNotNull(), F.transform(channel, lambda v: (v - mean) / spread))


def catch22_features(
    windows: DataFrame,
    channels: Sequence[str],
    fill_value: float = 0.0,
    keep: Sequence[str] = ("survey_response_id",),
) -> DataFrame:
    """22 columns per channel, ``<channel>__<feature>``.

    Undefined values become ``fill_value``, as do all features of a window under three bins and
    of a constant window; a window without bins gives 0.
    """
    # a shuffle sized by bytes would leave all windows to one task
    spark = windows.sparkSession
    out = windows.select(*keep, *channels).repartition(max(shuffle_partitions(spark), 4 * spark.sparkContext.defaultParallelism))
    for c in channels:
        series = F.col(c)
        spread = F.when(F.size(series) >= 3, array_std(series, 1))
        mean = array_mean(series)
        out = out.withColumns({f"__m_{c}": mean, f"__s_{c}": F.when(spread > 0, spread)})
    for c in channels:
        out = out.withColumn(f"__z_{c}", _standardised(c))
    for c in channels:
        z = F.col(f"__z_{c}")
        step = let(differences(z), lambda d: let(array_mean(d), lambda m: F.transform(d, lambda v: v - m)))
        out = out.withColumns({f"__d_{c}": step, f"__p_{c}": spectral_density(z)})
    for c in channels:
        out = out.withColumns(
            {f"__ac_{c}": autocorrelation(F.col(f"__z_{c}")), f"__ad_{c}": autocorrelation(F.col(f"__d_{c}"))}
        )
    columns = []
    for c in channels:
        made = expression_features(F.col(f"__z_{c}"), F.col(f"__ac_{c}"), F.col(f"__ad_{c}"), F.col(f"__p_{c}"))
        for name in NAMES:
            value = F.nanvl(F.when(F.col(f"__z_{c}").isNotNull(), made[name].cast("double")), F.lit(None).cast("double"))
            finite = let(value, lambda v: F.when(F.abs(v) < float("inf"), v))
            filled = F.when(F.size(c) == 0, F.lit(0.0)).otherwise(F.coalesce(finite, F.lit(float(fill_value))))
            columns.append(filled.alias(f"{c}__{name}"))
    return out.select(*keep, *columns)
