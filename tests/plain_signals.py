"""Plain NumPy forms of the signal features, on one z-scored series at a time."""

from __future__ import annotations

import math

import numpy as np


def _acf(y: np.ndarray) -> np.ndarray:
    full = np.correlate(y - y.mean(), y - y.mean(), "full")[len(y) - 1 :]
    return full / full[0]


def _first_zero(y: np.ndarray) -> int:
    below = np.flatnonzero(_acf(y) <= 0)
    return int(below[0]) if below.size else len(y)


def _tercile_labels(y: np.ndarray) -> np.ndarray:
    cuts = np.quantile(y, [1 / 3, 2 / 3], method="hazen")
    return np.searchsorted(cuts, y, side="left")


def transition_spread(y: np.ndarray) -> float:
    """Sum of the column variances of the transition matrix of the down-sampled tercile series."""
    letters = _tercile_labels(y[:: max(_first_zero(y), 1)])
    if len(letters) < 2:
        return math.nan
    table = np.zeros((3, 3))
    np.add.at(table, (letters[:-1], letters[1:]), 1.0)
    return float(np.var(table / (len(letters) - 1), axis=0, ddof=1).sum())


def spline_period(y: np.ndarray) -> float:
    """First autocovariance peak that is positive and 0.01 above the trough before it."""
    x = np.linspace(-1, 1, len(y))
    basis = np.column_stack([np.ones_like(x), x, x**2, x**3, np.clip(x, 0, None) ** 3])
    rest = y - basis @ np.linalg.lstsq(basis, y, rcond=None)[0]
    cov = np.array([np.mean(rest[lag:] * rest[: len(y) - lag]) for lag in range(1, math.ceil(len(y) / 3) + 1)])
    turn = np.sign(np.diff(cov))
    troughs = [i for i in range(1, len(cov) - 1) if turn[i - 1] < 0 < turn[i]]
    for i in range(1, len(cov) - 1):
        if turn[i - 1] > 0 > turn[i]:
            before = [t for t in troughs if t < i]
            if before and cov[i] - cov[before[-1]] >= 0.01 and cov[i] > 0:
                return float(i + 1)
    return 0.0


def embedding_fit(y: np.ndarray) -> float:
    """Mean gap between the histogram of embedding distances and an exponential of equal mean."""
    tau = max(1, min(_first_zero(y), len(y) // 10))
    steps = np.diff(y)
    d = np.hypot(steps[: len(steps) - tau], steps[tau:])
    if len(d) < 2 or d.std(ddof=1) <= 1e-12 * d.mean():
        return math.nan
    bins = max(1, math.ceil((d.max() - d.min()) / (3.5 * d.std(ddof=1) / len(d) ** (1 / 3))))
    counts, edges = np.histogram(d, bins)
    centres = (edges[1:] + edges[:-1]) / 2
    return float(np.mean(np.abs(counts / len(d) - np.exp(-centres / d.mean()) / d.mean())))


def outlier_timing(y: np.ndarray, sign: int) -> float:
    """Median over rising thresholds of how early or late the values beyond them lie."""
    side = sign * y
    if side.max() < 0.01:
        return 0.0
    half, n_side, spots = len(y) / 2, int((side >= 0).sum()), []
    for level in np.arange(int(side.max() / 0.01) + 1) * 0.01:
        at = np.flatnonzero(side >= level) + 1
        if len(at) < 2 or (len(at) - 1) * 100 / n_side <= 2:
            break
        spots.append(np.median(at) / half - 1)
    return float(np.median(spots)) if spots else math.nan


def spectrum(y: np.ndarray) -> tuple[float, float]:
    """Power in the lowest fifth of frequencies, and the frequency that halves the power."""
    n_fft = 1 << (len(y) - 1).bit_length()
    power = np.abs(np.fft.rfft(y - y.mean(), n_fft)) ** 2 / len(y)
    power[1:-1] *= 2
    omega = 2 * np.pi * np.arange(len(power)) / n_fft
    density = power / (2 * np.pi)
    total = np.cumsum(density)
    centroid = omega[np.flatnonzero(total > total[-1] / 2)[0]]
    return float(density[: len(power) // 5].sum() * (omega[1] - omega[0])), float(centroid)


def fluctuation_split(y: np.ndarray, lag: int, kind: str) -> float:
    """Share of scales in the first of two straight pieces of the log-log fluctuation curve."""
    n = len(y)
    if n // 2 < 6:
        return 0.0
    scales = np.unique(np.round(np.exp(np.linspace(math.log(5), math.log(n // 2), 50))).astype(int))
    if len(scales) < 12:
        return 0.0
    walk = np.cumsum(y[::lag])
    curve = []
    for scale in scales:
        parts = walk[: len(walk) // scale * scale].reshape(-1, scale)
        if not len(parts):
            return 0.0
        design = np.column_stack([np.ones(scale), np.arange(scale)])
        rest = parts - (design @ np.linalg.lstsq(design, parts.T, rcond=None)[0]).T
        curve.append(np.sqrt(np.mean(np.ptp(rest, axis=1) ** 2)) if kind == "range" else np.sqrt(np.mean(rest**2)))
    if min(curve) <= 0:
        return math.nan
    x, f = np.log(scales), np.log(curve)

    def misfit(a: np.ndarray, b: np.ndarray) -> float:
        design = np.column_stack([np.ones(len(a)), a])
        return float(np.linalg.norm(b - design @ np.linalg.lstsq(design, b, rcond=None)[0]))

    cost = [misfit(x[:i], f[:i]) + misfit(x[i - 1 :], f[i - 1 :]) for i in range(6, len(x) - 5)]
    return float((6 + int(np.argmin(cost))) / len(x)) if cost else 0.0


def numeric_features(y: np.ndarray) -> dict[str, float]:
    area, centroid = spectrum(y)
    return {
        "SB_TransitionMatrix_3ac_sumdiagcov": transition_spread(y),
        "PD_PeriodicityWang_th0_01": spline_period(y),
        "CO_Embed2_Dist_tau_d_expfit_meandiff": embedding_fit(y),
        "DN_OutlierInclude_p_001_mdrmd": outlier_timing(y, 1),
        "DN_OutlierInclude_n_001_mdrmd": outlier_timing(y, -1),
        "SP_Summaries_welch_rect_area_5_1": area,
        "SC_FluctAnal_2_rsrangefit_50_1_logi_prop_r1": fluctuation_split(y, 1, "range"),
        "SC_FluctAnal_2_dfa_50_1_2_logi_prop_r1": fluctuation_split(y, 2, "dfa"),
        "SP_Summaries_welch_rect_centroid": centroid,
    }
