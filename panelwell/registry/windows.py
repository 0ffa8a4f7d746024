"""Bins, samplers, the coverage gate and window features."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwell.operators import features as feats
from panelwell.operators.windows import (
    GRID_BINS,
    GRID_LOOKBACKS,
    OffsetSampler,
    bin_sum,
    cohort_by_setting,
    cohort_members,
    coverage_gate,
    covered_by_setting,
    cyclic_time,
    packed_grid,
    packed_windows,
    sample_windows,
    sampler_grid,
    window_bin_join,
    window_bounds,
)
from panelwell.plans.walk_forward import tested_by_setting
from panelwell.registry import frames
from panelwell.registry.core import q6, query, r6
from panelwell.registry.views import CUTS_80_20, H, cyclic
from panelwell.sources import study

MODALITIES, SAMPLER = frames.MODALITIES, frames.SAMPLER
OFFSET = OffsetSampler(-30.0, 6.0, 6.0)


@query(
    "window_bounds_rolling",
    f"SELECT survey_response_id, make_timestamp(CAST(epoch_us(record_timestamp) // {6 * H} * {6 * H} - {72 * H} AS BIGINT)) AS window_start, "
    f"make_timestamp(CAST(epoch_us(record_timestamp) // {6 * H} * {6 * H} AS BIGINT)) AS window_end FROM v_master",
    ("v_master",),
)
def _(spark, sf):
    return window_bounds(frames.master(spark, sf), SAMPLER).select("survey_response_id", "window_start", "window_end")


@query(
    "window_bounds_offset",
    "SELECT survey_response_id, date_trunc('day', record_timestamp) - INTERVAL 30 HOUR AS window_start, "
    "date_trunc('day', record_timestamp) + INTERVAL 6 HOUR AS window_end FROM v_master",
    ("v_master",),
)
def _(spark, sf):
    return window_bounds(frames.master(spark, sf), OFFSET).select("survey_response_id", "window_start", "window_end")


@query(
    "bin_sum",
    f"SELECT app_user_id, modality, make_timestamp(CAST(epoch_us(start_timestamp) // {4 * H} * {4 * H} AS BIGINT)) AS bin_start, {q6('sum(value)')} AS value FROM v_sensor GROUP BY 1, 2, 3",
    ("v_sensor",),
)
def _(spark, sf):
    return bin_sum(study.sensor(spark, sf), 4.0).withColumn("value", r6("value"))


@query(
    "window_bin_join",
    f"SELECT survey_response_id, modality, bin_idx, bin_start, {q6('value')} AS value FROM v_window",
    ("v_window",),
)
def _(spark, sf):
    return window_bin_join(frames.windows(spark, sf), SAMPLER, MODALITIES).withColumn("value", r6("value"))


CYCLIC_COLUMNS = (
    f"{q6('sin(2 * pi() * hour(bin_start) / 24.0)')} AS sin_hour, {q6('cos(2 * pi() * hour(bin_start) / 24.0)')} AS cos_hour, "
    f"{q6('sin(2 * pi() * (isodow(bin_start) - 1) / 7.0)')} AS sin_weekday, {q6('cos(2 * pi() * (isodow(bin_start) - 1) / 7.0)')} AS cos_weekday"
)


@query(
    "cyclic_time",
    f"SELECT DISTINCT bin_start, {CYCLIC_COLUMNS} FROM (SELECT make_timestamp(CAST(epoch_us(start_timestamp) // {4 * H} * {4 * H} AS BIGINT)) AS bin_start FROM v_sensor)",
    ("v_sensor",),
)
def _(spark, sf):
    starts = bin_sum(study.sensor(spark, sf), 4.0).select("bin_start").distinct()
    made = cyclic_time(starts)
    return made.select("bin_start", *[r6(c).alias(c) for c in made.columns if c != "bin_start"])


@query(
    "rolling_sampler",
    f"""SELECT survey_response_id, app_user_id, bin_idx, bin_start, {q6("max(value) FILTER (modality = 'distance')")} AS distance,
  {q6("max(value) FILTER (modality = 'step')")} AS step, {CYCLIC_COLUMNS} FROM v_window GROUP BY survey_response_id, app_user_id, bin_idx, bin_start""",
    ("v_window",),
)
def _(spark, sf):
    rows = sample_windows(frames.master(spark, sf), study.sensor(spark, sf), SAMPLER, MODALITIES)
    fixed = ("survey_response_id", "app_user_id", "bin_idx", "bin_start")
    return rows.select(*fixed, *[r6(c).alias(c) for c in rows.columns if c not in fixed])


@query(
    "offset_sampler",
    f"""SELECT survey_response_id, app_user_id, bin_idx, bin_start, {q6('sum(CASE WHEN modality = ' + "'distance'" + ' THEN value ELSE 0 END)')} AS distance,
  {q6('sum(CASE WHEN modality = ' + "'step'" + ' THEN value ELSE 0 END)')} AS step,
  {q6('sin(2 * pi() * (isodow(bin_start) - 1) / 7.0)')} AS sin_weekday, {q6('cos(2 * pi() * (isodow(bin_start) - 1) / 7.0)')} AS cos_weekday
FROM (SELECT m.survey_response_id, m.app_user_id, CAST(i.bin_idx AS INTEGER) AS bin_idx,
    date_trunc('day', m.record_timestamp) - INTERVAL 30 HOUR + CAST(i.bin_idx AS INTEGER) * INTERVAL 6 HOUR AS bin_start
  FROM v_master m CROSS JOIN (SELECT unnest(range(6)) AS bin_idx) i) w
LEFT JOIN v_sensor s ON s.app_user_id = w.app_user_id AND s.start_timestamp >= w.bin_start AND s.start_timestamp < w.bin_start + INTERVAL 6 HOUR
GROUP BY survey_response_id, w.app_user_id, bin_idx, bin_start""".replace("SELECT survey_response_id, app_user_id,", "SELECT survey_response_id, w.app_user_id,"),
    ("v_master", "v_sensor"),
)
def _(spark, sf):
    rows = sample_windows(frames.master(spark, sf), study.sensor(spark, sf), OFFSET, MODALITIES)
    fixed = ("survey_response_id", "app_user_id", "bin_idx", "bin_start")
    return rows.select(*fixed, *[r6(c).alias(c) for c in rows.columns if c not in fixed])


GRID_SQL = (
    "(SELECT CAST(lookback AS DOUBLE) AS lookback_hours, CAST(bin AS DOUBLE) AS bin_hours, lookback, bin FROM "
    f"(VALUES {', '.join(f'({v})' for v in GRID_LOOKBACKS)}) a(lookback), (VALUES {', '.join(f'({v})' for v in GRID_BINS)}) b(bin))"
)


@query(
    "sampler_grid",
    f"""SELECT survey_response_id, lookback_hours, bin_hours, CAST(lookback // bin AS BIGINT) AS n_bins,
  {q6("coalesce(sum(value) FILTER (modality = 'distance'), 0)")} AS distance_total,
  {q6("coalesce(max(b) FILTER (modality = 'step'), 0)")} AS step_top
FROM (SELECT m.survey_response_id, g.lookback_hours, g.bin_hours, g.lookback, g.bin, s.modality, s.w, sum(s.value) AS value,
    sum(s.value) AS b
  FROM v_master m CROSS JOIN {GRID_SQL} g
  LEFT JOIN (SELECT app_user_id, modality, start_timestamp, value, epoch_us(start_timestamp) AS w0, bin AS sbin, epoch_us(start_timestamp) // (bin * {H}) AS w
    FROM v_sensor CROSS JOIN (VALUES {', '.join(f'({v})' for v in GRID_BINS)}) b(bin)) s
    ON s.app_user_id = m.app_user_id AND s.sbin = g.bin
    AND s.w < epoch_us(m.record_timestamp) // (g.bin * {H}) AND s.w >= epoch_us(m.record_timestamp) // (g.bin * {H}) - g.lookback // g.bin
  GROUP BY ALL)
GROUP BY survey_response_id, lookback_hours, bin_hours, lookback, bin""",
    ("v_master", "v_sensor"),
)
def _(spark, sf):
    grid = packed_grid(frames.master(spark, sf), study.sensor(spark, sf), sampler_grid(), MODALITIES)
    total = F.aggregate("distance", F.lit(0.0), lambda a, v: a + v)
    return grid.select(
        "survey_response_id", "lookback_hours", "bin_hours", F.size("step").cast("bigint").alias("n_bins"),
        r6(total).alias("distance_total"), r6(F.array_max("step")).alias("step_top"),
    )


STATS_SQL = {
    "mean": "avg(value)", "median": "quantile_cont(value, 0.5)", "std": "stddev_pop(value)",
    "min": "min(value)", "max": "max(value)", "last": "arg_max(value, bin_idx)",
}


def stats_sql(names) -> str:
    columns = ", ".join(
        f"{q6(STATS_SQL[s].replace('value', 'CASE WHEN modality = ' + repr(m) + ' THEN value END'))} AS {m}__{s}" for m in MODALITIES for s in names
    )
    return f"SELECT survey_response_id, {columns} FROM v_window GROUP BY survey_response_id"


@query("summary_stats", stats_sql(feats.SUPPORTED_STATS), ("v_window",))
def _(spark, sf):
    rows = feats.summary_stats(frames.windows(spark, sf), MODALITIES)
    return rows.select("survey_response_id", *[r6(c).alias(c) for c in rows.columns[1:]])


@query("input_stats", stats_sql(feats.INPUT_STATS), ("v_window",))
def _(spark, sf):
    rows = feats.input_stats(frames.windows(spark, sf), MODALITIES)
    return rows.select("survey_response_id", *[r6(c).alias(c) for c in rows.columns[1:]])


@query(
    "flatten_window",
    "SELECT survey_response_id, " + ", ".join(
        q6(f"max(value) FILTER (modality = '{m}' AND bin_idx = {b})") + f" AS {m}__{b}" for b in range(12) for m in MODALITIES
    ) + " FROM v_window GROUP BY survey_response_id",
    ("v_window",),
)
def _(spark, sf):
    rows = feats.flatten_columns(frames.windows(spark, sf), MODALITIES, SAMPLER.n_bins)
    return rows.select("survey_response_id", *[r6(c).alias(c) for c in rows.columns[1:]])


@query(
    "exclude_time_columns",
    f"SELECT survey_response_id, {q6('sum(value)')} AS signal FROM v_window GROUP BY survey_response_id",
    ("v_window",),
)
def _(spark, sf):
    rows = sample_windows(frames.master(spark, sf), study.sensor(spark, sf), SAMPLER, MODALITIES)
    channels = [c for c in rows.columns if c not in ("survey_response_id", "app_user_id", "bin_idx", "bin_start")]
    signal = feats.exclude_time_columns(channels, "auto", len(SAMPLER.time_channels))
    total = sum((F.col(c) for c in signal[1:]), F.col(signal[0]))
    return rows.groupBy("survey_response_id").agg(r6(F.sum(total)).alias("signal"))


GATE = f"""EXISTS (SELECT 1 FROM v_sensor s WHERE s.app_user_id = m.app_user_id
  AND epoch_us(s.end_timestamp) > epoch_us(m.record_timestamp) // {6 * H} * {6 * H} - {72 * H}
  AND epoch_us(s.start_timestamp) < epoch_us(m.record_timestamp) // {6 * H} * {6 * H})"""


@query("coverage_gate", f"SELECT survey_response_id, app_user_id, answer FROM v_master m WHERE {GATE}", ("v_master", "v_sensor"))
def _(spark, sf):
    return coverage_gate(frames.master(spark, sf), study.sensor(spark, sf), SAMPLER, max_group=frames.per_user(spark, sf, "all events")).select("survey_response_id", "app_user_id", "answer")


@query(
    "coverage_gate_offset",
    """SELECT survey_response_id, app_user_id FROM v_master m WHERE EXISTS (SELECT 1 FROM v_sensor s WHERE s.app_user_id = m.app_user_id
  AND s.end_timestamp > date_trunc('day', m.record_timestamp) - INTERVAL 30 HOUR AND s.start_timestamp < date_trunc('day', m.record_timestamp) + INTERVAL 6 HOUR)""",
    ("v_master", "v_sensor"),
)
def _(spark, sf):
    return coverage_gate(frames.master(spark, sf), study.sensor(spark, sf), OFFSET, max_group=frames.per_user(spark, sf, "all events")).select("survey_response_id", "app_user_id")


COVERED = f"""SELECT DISTINCT m.survey_response_id, m.app_user_id, m.record_timestamp, m.answer, g.lookback_hours, g.bin_hours
FROM v_master m CROSS JOIN {GRID_SQL} g JOIN v_sensor s ON s.app_user_id = m.app_user_id
  AND epoch_us(s.end_timestamp) > epoch_us(m.record_timestamp) // (g.bin * {H}) * (g.bin * {H}) - g.lookback * {H}
  AND epoch_us(s.start_timestamp) < epoch_us(m.record_timestamp) // (g.bin * {H}) * (g.bin * {H})"""


@query("covered_by_setting", f"SELECT survey_response_id, app_user_id, answer, lookback_hours, bin_hours FROM ({COVERED})", ("v_master", "v_sensor"))
def _(spark, sf):
    rows = covered_by_setting(frames.master(spark, sf), study.sensor(spark, sf), sampler_grid(), max_group=frames.per_user(spark, sf, "all events"))
    return rows.select("survey_response_id", "app_user_id", "answer", "lookback_hours", "bin_hours")


TESTED = f"""covered AS ({COVERED}),
tested AS ({cyclic('covered', CUTS_80_20, 0.8, 120, by='lookback_hours, bin_hours, app_user_id')})"""


@query(
    "cohort_members",
    f"WITH {TESTED} SELECT lookback_hours, bin_hours, app_user_id, count(*) AS n_surveys, CAST(sum(answer) AS BIGINT) AS n_positive FROM tested WHERE role = 'test' GROUP BY ALL",
    ("v_master", "v_sensor"),
)
def _(spark, sf):
    return cohort_members(tested_by_setting(frames.master(spark, sf), study.sensor(spark, sf), sampler_grid(), max_group=frames.per_user(spark, sf), max_records=frames.per_user(spark, sf, "all events")))


@query(
    "cohort_by_setting",
    f"WITH {TESTED} SELECT lookback_hours, bin_hours, count(DISTINCT app_user_id) AS n_participants, count(*) AS n_surveys, CAST(sum(answer) AS BIGINT) AS n_positive FROM tested WHERE role = 'test' GROUP BY ALL",
    ("v_master", "v_sensor"),
)
def _(spark, sf):
    tested = tested_by_setting(frames.master(spark, sf), study.sensor(spark, sf), sampler_grid(), max_group=frames.per_user(spark, sf), max_records=frames.per_user(spark, sf, "all events"))
    return cohort_by_setting(cohort_members(tested))
