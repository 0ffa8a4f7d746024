"""Signal kernels on short packed series, as array expressions on the row.

Projections, power spectra by cosine and sine sums, detrended fluctuation curves and straight-line
pieces. Nothing leaves the JVM and nothing is shuffled; the work is at most quadratic in the length
of one window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelwell.operators.features import array_mean, array_std, let


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def after(a: Column, lag: Column | int) -> Column:
    """``a`` without its first ``lag`` values."""
    lag = F.lit(lag) if isinstance(lag, int) else lag
    return F.slice(a, lag + 1, F.greatest(F.size(a) - lag, F.lit(0)))


def before(a: Column, lag: Column | int) -> Column:
    """``a`` without its last ``lag`` values."""
    lag = F.lit(lag) if isinstance(lag, int) else lag
    return F.slice(a, 1, F.greatest(F.size(a) - lag, F.lit(0)))


def differences(a: Column) -> Column:
    return F.zip_with(after(a, 1), before(a, 1), lambda x, y: x - y)


def positions(n: Column) -> Column:
    """0..n-1; empty for n = 0."""
    n = n.cast("int")
    return F.slice(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), 1, F.greatest(n, F.lit(0)))


def running_sum(a: Column) -> Column:
    return F.transform(positions(F.size(a)), lambda i: total(F.slice(a, F.lit(1), i + 1)))


def known(a: Column) -> Column:
    return F.filter(a, lambda v: v.isNotNull())


def middle(ordered: Column) -> Column:
    """Median of an array that is in order already."""
    n = F.size(ordered)
    return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2.0


def count_equal(a: Column, value: Column) -> Column:
    return F.size(F.filter(a, lambda v: v == value))


# --- letters ----------------------------------------------------------------------------------------


def tercile_letters(z: Column) -> Column:
    """0, 1 or 2 for each value, cut at the quantiles through the points ((i + 1/2) / n, i-th value)."""
    n = F.size(z)

    def cut(ordered: Column, q: float) -> Column:
        spot = F.greatest(F.lit(0.0), F.least(n * F.lit(q) - 0.5, (n - 1).cast("double")))
        i = F.floor(spot).cast("int")
        low, high = F.get(ordered, i), F.coalesce(F.get(ordered, i + 1), F.get(ordered, i))
        return low + (spot - i) * (high - low)

    cuts = let(F.sort_array(z), lambda o: F.struct(cut(o, 1 / 3).alias("a"), cut(o, 2 / 3).alias("b")))
    return let(cuts, lambda c: F.transform(z, lambda v: F.when(v <= c["a"], 0).when(v <= c["b"], 1).otherwise(2)))


def letter_pairs(letters: Column) -> Column:
    return F.zip_with(before(letters, 1), after(letters, 1), lambda a, b: a * 3 + b)


def transition_spread(z: Column, step: Column) -> Column:
    """Sum of the column variances of the transition matrix of every ``step``-th value's letter."""

    def spread(pairs: Column) -> Column:
        columns = [
            F.array(*[F.try_divide(count_equal(pairs, F.lit(3 * a + b)), F.size(pairs)) for a in range(3)]) for b in range(3)
        ]
        variances = [F.pow(array_std(c, 1), 2) for c in columns]
        return F.when(F.size(pairs) > 0, variances[0] + variances[1] + variances[2])

    sampled = let(step, lambda every: F.filter(z, lambda _, i: i % every == 0))
    return let(sampled, lambda s: let(let(tercile_letters(s), letter_pairs), spread))


# --- projections ------------------------------------------------------------------------------------


def without_span(a: Column, vectors: Sequence[Column]) -> Column:
    """What is left of ``a`` after its projection on the vectors, taken off one orthogonal vector at a time.

    A vector that the others span already (short windows) takes nothing off.
    """
    if not vectors:
        return a
    first, rest = vectors[0], vectors[1:]
    unit = let(
        dot(first, first),
        lambda power: F.transform(first, lambda v: F.when(power > 1e-10, v / F.sqrt(power)).otherwise(F.lit(0.0))),
    )

    def strip(vector: Column, u: Column) -> Column:
        return let(dot(vector, u), lambda c: F.zip_with(vector, u, lambda v, w: v - c * w))

    def stripped(u: Column) -> Column:
        fields = F.struct(*[strip(v, u).alias(f"v{i}") for i, v in enumerate([a, *rest])])
        return let(fields, lambda s: without_span(s["v0"], [s[f"v{i + 1}"] for i in range(len(rest))]))

    return let(unit, stripped)


def spline_detrended(z: Column) -> Column:
    """Residual of the least-squares cubic spline with one knot in the middle."""
    n = F.size(z)

    def residual(x: Column) -> Column:
        basis = [
            F.transform(x, lambda v: F.lit(1.0)), x, F.transform(x, lambda v: v * v), F.transform(x, lambda v: v * v * v),
            F.transform(x, lambda v: F.pow(F.greatest(v, F.lit(0.0)), F.lit(3))),
        ]
        return without_span(z, basis)

    return let(F.transform(positions(n), lambda i: i * 2.0 / (n - 1) - 1.0), residual)


def spline_period(z: Column) -> Column:
    """First autocovariance peak that is positive and 0.01 above the trough before it; 0 if there is none."""

    def peaks(cov: Column) -> Column:
        inner = F.filter(positions(F.size(cov) - 1), lambda i: i > 0)

        def rises(i: Column) -> Column:
            return F.get(cov, i) > F.get(cov, i - 1)

        troughs = F.filter(inner, lambda i: (F.get(cov, i) < F.get(cov, i - 1)) & rises(i + 1))

        def first(low: Column) -> Column:
            def counts(i: Column) -> Column:
                last = F.array_max(F.filter(low, lambda t: t < i))
                falls = F.get(cov, i + 1) < F.get(cov, i)
                return rises(i) & falls & (F.get(cov, i) > 0) & (F.get(cov, i) - F.get(cov, last) >= 0.01)

            return F.coalesce(F.get(F.filter(inner, counts), 0).cast("double") + 1.0, F.lit(0.0))

        return let(troughs, first)

    def covariance(rest: Column) -> Column:
        n = F.size(rest)
        lags = F.sequence(F.lit(1), F.ceil(n / 3).cast("int"))
        return F.transform(lags, lambda lag: F.try_divide(dot(after(rest, lag), before(rest, lag)), n - lag))

    return let(spline_detrended(z), lambda rest: let(covariance(rest), peaks))


# --- distances and extremes -------------------------------------------------------------------------


def embedding_fit(z: Column, lag: Column) -> Column:
    """Mean gap between the histogram of embedding distances and an exponential of equal mean.

    Distances that differ by no more than rounding have no histogram: the feature is undefined.
    """
    tau = F.greatest(F.lit(1), F.least(lag.cast("int"), F.floor(F.size(z) / 10).cast("int")))

    def gap(d: Column, s: Column) -> Column:
        n, bins = F.size(d), s["bins"]
        width = (s["high"] - s["low"]) / bins
        placed = F.transform(d, lambda v: F.least(F.floor((v - s["low"]) / width).cast("int"), bins - 1))

        def error(p: Column) -> Column:
            def one(b: Column) -> Column:
                centre = s["low"] + (b + 0.5) * width
                return F.abs(count_equal(p, b) / n - F.exp(-centre / s["mean"]) / s["mean"])

            return array_mean(F.transform(positions(bins), one))

        return F.when(s["std"] > s["mean"] * 1e-12, let(placed, error))

    def measured(d: Column) -> Column:
        low, high, std = F.array_min(d), F.array_max(d), array_std(d, 1)
        bins = F.ceil(F.try_divide((high - low) * F.pow(F.size(d).cast("double"), F.lit(1 / 3)), 3.5 * std)).cast("int")
        stats = F.struct(
            low.alias("low"), high.alias("high"), std.alias("std"), array_mean(d).alias("mean"),
            F.greatest(F.coalesce(bins, F.lit(1)), F.lit(1)).alias("bins"),
        )
        return F.when(F.size(d) >= 2, let(stats, lambda s: gap(d, s)))

    def distances(step: Column) -> Column:
        return F.zip_with(before(step, tau), after(step, tau), lambda x, y: F.hypot(x, y))

    return let(differences(z), lambda step: let(distances(step), measured))


def outlier_timing(z: Column, sign: int) -> Column:
    """Median over rising thresholds (0, 0.01, 0.02 and so on) of how early or late the values beyond them lie.

    What lies beyond changes only where a threshold passes a value, so each set of values is judged once, for as many
    thresholds as it holds.
    """

    def timing(side: Column) -> Column:
        def spot(beyond: Column, n_side: Column) -> Column:
            enough = (F.size(beyond) >= 2) & (F.try_divide((F.size(beyond) - 1) * 100, n_side) > 2)
            return F.when(enough, let(F.transform(beyond, lambda p: p["at"]), middle) / (F.size(side) / 2) - 1)

        def spots(placed: Column) -> Column:
            def judged(levels: Column) -> Column:
                def one(k: Column, j: Column) -> Column:
                    held = (k - F.coalesce(F.get(levels, j - 1), F.lit(-1))).cast("int")
                    beyond = F.filter(placed, lambda p: p["level"] >= k)
                    return let(beyond, lambda b: F.array_repeat(spot(b, F.size(placed)), held))

                return F.sort_array(known(F.flatten(F.transform(levels, one))))

            return let(F.sort_array(F.array_distinct(F.transform(placed, lambda p: p["level"]))), judged)

        def with_levels(highest: Column) -> Column:
            def level(v: Column) -> Column:
                """The number of the last threshold that ``v`` reaches; a quotient may be rounded across it."""
                near = F.floor(v / 0.01)
                return F.least(highest, F.when(v >= (near + 1) * 0.01, near + 1).when(v >= near * 0.01, near).otherwise(near - 1))

            # no threshold is below zero, so the values of the other side never count
            ahead = F.filter(F.transform(side, lambda v, i: F.struct(v.alias("v"), (i + 1.0).alias("at"))), lambda p: p["v"] >= 0)
            return F.transform(ahead, lambda p: F.struct(level(p["v"]).alias("level"), p["at"].alias("at")))

        return let(F.array_max(side), lambda most: F.when(most < 0.01, F.lit(0.0)).otherwise(
            let(let(let(F.floor(most / 0.01), with_levels), spots), lambda s: F.when(F.size(s) > 0, middle(s)))
        ))

    return let(F.transform(z, lambda v: v * F.lit(float(sign))), timing)


# --- spectrum ---------------------------------------------------------------------------------------


def spectral_density(z: Column) -> Column:
    """One-sided power density at the frequencies of a transform of the next power of two in length."""
    n = F.size(z)
    length = F.pow(F.lit(2.0), F.length(F.bin((n - 1).cast("bigint")))).cast("int")

    def density(m: Column) -> Column:
        def power(k: Column) -> Column:
            def part(wave) -> Column:
                return total(F.transform(z, lambda v, t: v * wave(k * t * (2 * math.pi) / m)))

            sides = F.when((k == 0) | (k * 2 == m), 1.0).otherwise(2.0)
            return sides * (F.pow(part(F.cos), 2) + F.pow(part(F.sin), 2)) / n / (2 * math.pi)

        return F.transform(positions(m / 2 + 1), power)

    return let(length, density)


def low_frequency_power(density: Column) -> Column:
    """Power in the lowest fifth of frequencies."""
    step = math.pi / (F.size(density) - 1)
    return total(F.slice(density, F.lit(1), F.floor(F.size(density) / 5).cast("int"))) * step


def middle_frequency(density: Column) -> Column:
    """The frequency that halves the power."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("below"))

    def position(half: Column) -> Column:
        def step(s: Column, v: Column) -> Column:
            new = s["sum"] + v
            return F.struct(new.alias("sum"), (s["below"] + F.when(new > half, 0).otherwise(1)).alias("below"))

        return F.aggregate(density, start, step, lambda s: s["below"])

    return let(total(density) / 2, position) * (math.pi / (F.size(density) - 1))


# --- fluctuation ------------------------------------------------------------------------------------


def line_residuals(x: Column, y: Column) -> Column:
    """What is left of ``y`` after its least-squares line over ``x``."""

    def rest(s: Column) -> Column:
        slope = F.try_divide(total(F.zip_with(x, y, lambda a, b: (a - s["x"]) * (b - s["y"]))), total(F.transform(x, lambda a: F.pow(a - s["x"], 2))))
        return let(slope, lambda b: F.zip_with(x, y, lambda u, v: v - s["y"] - b * (u - s["x"])))

    return let(F.struct(array_mean(x).alias("x"), array_mean(y).alias("y")), rest)


def fluctuation_split(z: Column, lag: int, kind: str) -> Column:
    """Share of scales in the first of two straight pieces of the log-log fluctuation curve.

    ``kind`` is ``range`` (rescaled range) or ``dfa`` (root mean square) of the detrended pieces of
    the running sum of every ``lag``-th value. A window with under 12 scales gives 0.
    """
    half = F.floor(F.size(z) / 2).cast("int")
    low = math.log(5)
    scales = F.array_distinct(
        F.transform(F.sequence(F.lit(0), F.lit(49)), lambda i: F.round(F.exp(i * (F.log(half) - low) / 49 + low)).cast("int"))
    )

    def fluctuation(walk: Column, scale: Column) -> Column:
        def piece(p: Column) -> Column:
            x = F.transform(positions(scale), lambda t: t.cast("double"))
            rest = line_residuals(x, F.slice(walk, p * scale + 1, scale))
            if kind == "range":
                return let(rest, lambda r: F.pow(F.array_max(r) - F.array_min(r), 2))
            return let(rest, lambda r: dot(r, r) / scale)

        return F.sqrt(array_mean(F.transform(positions(F.floor(F.size(walk) / scale)), piece)))

    def share(found: Column) -> Column:
        def best(points: Column) -> Column:
            x, f, n = points["x"], points["f"], F.size(points["x"])

            def misfit(first: Column, size: Column) -> Column:
                rest = line_residuals(F.slice(x, first, size), F.slice(f, first, size))
                return let(rest, lambda r: F.sqrt(dot(r, r)))

            costs = F.transform(F.sequence(F.lit(6), n - 6), lambda i: misfit(F.lit(1), i) + misfit(i, n - i + 1))
            return let(costs, lambda c: (F.array_position(c, F.array_min(c)) + 5) / n)

        def logs(curve: Column) -> Column:
            points = F.struct(F.transform(found, lambda s: F.log(s)).alias("x"), F.transform(curve, lambda v: F.log(v)).alias("f"))
            return F.when(F.array_min(curve) > 0, let(points, best))

        sampled = running_sum(F.filter(z, lambda _, i: i % lag == 0))
        curve = let(sampled, lambda walk: F.transform(found, lambda s: fluctuation(walk, s)))
        return F.when(F.size(found) < 12, F.lit(0.0)).otherwise(let(curve, logs))

    return F.when(half < 6, F.lit(0.0)).otherwise(let(scales, share))
