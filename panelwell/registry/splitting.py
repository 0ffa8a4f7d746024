"""Positions, edges and the four splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwell.operators import splits
from panelwell.registry import frames
from panelwell.registry.core import query
from panelwell.registry.views import CUTS_80_20, H, cyclic, numbered
from panelwell.sources import study


def history(spark, sf):
    return study.history(spark, sf)


def study_bound(spark, sf):
    return dict(max_group=frames.per_user(spark, sf))


def history_bound(spark, sf):
    return dict(tie="id", max_group=frames.per_user(spark, sf, "orders"))


@query("position_in_history", f"SELECT id, app_user_id, position, n_history FROM ({numbered('v_history', tie='id')})", ("v_history",))
def _(spark, sf):
    return splits.position_in_history(history(spark, sf), **history_bound(spark, sf)).select("id", "app_user_id", "position", "n_history")


USER_SIZES = "ceil(n * (1 - 0.7::DOUBLE)) AS held"


@query(
    "split_by_user",
    """SELECT survey_response_id, app_user_id, CASE WHEN p < n - held THEN 'train' WHEN p < n - held + floor(held * (0.15::DOUBLE / (0.15::DOUBLE + 0.15::DOUBLE))) THEN 'val' ELSE 'test' END AS role
FROM v_master JOIN (SELECT app_user_id, p, n, ceil(n * (1.0::DOUBLE - 0.7::DOUBLE)) AS held FROM (
  SELECT app_user_id, row_number() OVER (ORDER BY md5('42:' || app_user_id), app_user_id) - 1 AS p, count(*) OVER () AS n
  FROM (SELECT DISTINCT app_user_id FROM v_master))) USING (app_user_id)""",
    ("v_master",),
)
def _(spark, sf):
    return splits.split_by_user(frames.master(spark, sf), max_group=frames.in_all(spark, sf)).select("survey_response_id", "app_user_id", "role")


def longitudinal_sql(source: str, tie: str, r: tuple[float, float, float], purge_hours: float, keep: str) -> str:
    a, b = r[0], r[0] + r[1]
    return f"""
SELECT *, CASE WHEN {keep.format(purge=int(purge_hours * H))} THEN 1 ELSE 0 END AS stays FROM (
  SELECT *, min(CASE WHEN role = 'val' THEN t END) OVER (PARTITION BY app_user_id) AS val_first,
    min(CASE WHEN role = 'test' THEN t END) OVER (PARTITION BY app_user_id) AS test_first FROM (
    SELECT *, epoch_us(record_timestamp) AS t, CASE WHEN n_history < 3 OR position < cut1 THEN 'train' WHEN position < greatest(cut1 + 1, floor(n_history * {b!r}::DOUBLE)) THEN 'val' ELSE 'test' END AS role
    FROM (SELECT *, greatest(1, floor(n_history * {a!r}::DOUBLE)) AS cut1 FROM ({numbered(source, tie=tie)}))))"""


STANDARD = "(role = 'train' AND (val_first IS NULL OR t < val_first - {purge})) OR (role = 'val' AND (test_first IS NULL OR t < test_first - {purge})) OR role = 'test'"
SYMMETRIC = "(role = 'train') OR (role = 'val' AND t >= val_first + {purge}) OR (role = 'test' AND t >= test_first + {purge})"
RATIOS = (0.6, 0.2, 0.2)


@query(
    "split_longitudinal",
    f"SELECT survey_response_id, app_user_id, position, role FROM ({longitudinal_sql('v_master', 'survey_response_id', RATIOS, 24, STANDARD)}) WHERE stays = 1",
    ("v_master",),
)
def _(spark, sf):
    return splits.split_longitudinal(frames.master(spark, sf), RATIOS, 24.0, **study_bound(spark, sf)).select("survey_response_id", "app_user_id", "position", "role")


@query(
    "split_longitudinal_ties",
    f"SELECT id, app_user_id, position, role FROM ({longitudinal_sql('v_history', 'id', RATIOS, 720, STANDARD)}) WHERE stays = 1",
    ("v_history",),
)
def _(spark, sf):
    return splits.split_longitudinal(history(spark, sf), RATIOS, 720.0, **history_bound(spark, sf)).select("id", "app_user_id", "position", "role")


@query(
    "swap_val_test",
    "SELECT survey_response_id, app_user_id, CASE role WHEN 'val' THEN 'test' WHEN 'test' THEN 'val' ELSE role END AS role FROM "
    f"({longitudinal_sql('v_master', 'survey_response_id', RATIOS, 24, STANDARD)}) WHERE stays = 1",
    ("v_master",),
)
def _(spark, sf):
    return splits.split_longitudinal(frames.master(spark, sf), RATIOS, 24.0, swap_val_test=True, **study_bound(spark, sf)).select("survey_response_id", "app_user_id", "role")


@query(
    "symmetric_purge",
    f"SELECT survey_response_id, app_user_id, role FROM ({longitudinal_sql('v_master', 'survey_response_id', RATIOS, 24, SYMMETRIC)}) WHERE stays = 1",
    ("v_master",),
)
def _(spark, sf):
    return splits.split_longitudinal(frames.master(spark, sf), RATIOS, 24.0, symmetric_purge=True, **study_bound(spark, sf)).select("survey_response_id", "app_user_id", "role")


@query(
    "slice_edges",
    f"SELECT app_user_id, min(t) FILTER (role = 'val') AS val_first, min(t) FILTER (role = 'test') AS test_first, max(t) FILTER (role = 'test') AS test_last "
    f"FROM ({longitudinal_sql('v_master', 'survey_response_id', RATIOS, 0, 'true')}) GROUP BY app_user_id",
    ("v_master",),
)
def _(spark, sf):
    return splits.slice_edges(splits.split_longitudinal(frames.master(spark, sf), RATIOS, **study_bound(spark, sf)), ["app_user_id"])


def expanding_sql(source: str, tie: str, burn_in: float, step: float, val: float, purge_hours: float) -> str:
    values = ", ".join(f"({f}, {a!r}::DOUBLE, {v!r}::DOUBLE, {t!r}::DOUBLE)" for f, a, v, t in splits.expanding_cuts(burn_in, step, val))
    purge, edge = int(purge_hours * H), "val_first" if val > 0 else "test_first"
    return f"""
SELECT * FROM (
  SELECT *, min(CASE WHEN role = 'val' THEN t END) OVER (PARTITION BY app_user_id, fold_index) AS val_first,
    min(CASE WHEN role = 'test' THEN t END) OVER (PARTITION BY app_user_id, fold_index) AS test_first FROM (
    SELECT h.*, epoch_us(record_timestamp) AS t, f.fold_index,
      CASE WHEN position < floor(n_history * f.a) THEN 'train' WHEN position < floor(n_history * f.v) THEN 'val'
        WHEN position < floor(n_history * f.e) THEN 'test' END AS role
    FROM ({numbered(source, tie=tie)}) h, (VALUES {values}) f(fold_index, a, v, e)
    WHERE NOT EXISTS (SELECT 1 FROM (VALUES {values}) g(fold_index, a, v, e)
      WHERE g.fold_index <= f.fold_index AND floor(h.n_history * g.e) <= floor(h.n_history * g.v))
  ) WHERE role IS NOT NULL)
WHERE role = 'test' OR (role = 'train' AND ({edge} IS NULL OR t < {edge} - {purge})) OR (role = 'val' AND (test_first IS NULL OR t < test_first - {purge}))"""


@query(
    "walk_forward_pct",
    f"SELECT survey_response_id, app_user_id, fold_index, role FROM ({expanding_sql('v_master', 'survey_response_id', 0.5, 0.15, 0.0, 24)})",
    ("v_master",),
)
def _(spark, sf):
    return splits.walk_forward_pct(frames.master(spark, sf), 0.5, 0.15, purge_hours=24.0, **study_bound(spark, sf)).select("survey_response_id", "app_user_id", "fold_index", "role")


@query(
    "walk_forward_pct_val",
    f"SELECT id, app_user_id, fold_index, role FROM ({expanding_sql('v_history', 'id', 0.3, 0.1, 0.1, 2400)})",
    ("v_history",),
)
def _(spark, sf):
    return splits.walk_forward_pct(history(spark, sf), 0.3, 0.1, 0.1, 2400.0, **history_bound(spark, sf)).select("id", "app_user_id", "fold_index", "role")


def _register_cyclic(name: str, source: str, tie: str, width: float, step: float, purge: float) -> None:
    cuts = splits.cyclic_cuts(width, step)

    @query(name, f"SELECT {tie}, app_user_id, fold_index, role FROM ({cyclic(source, cuts, width, purge, tie=tie)})", (source,))
    def _(spark, sf):
        rows = frames.master(spark, sf) if source == "v_master" else history(spark, sf)
        bound = study_bound(spark, sf) if source == "v_master" else history_bound(spark, sf)
        return splits.walk_forward_cyclic(rows, width, step, purge, **{"tie": tie, **bound}).select(tie, "app_user_id", "fold_index", "role")


_register_cyclic("walk_forward_cyclic", "v_master", "survey_response_id", 0.8, 0.2, 24)
_register_cyclic("walk_forward_cyclic_120h", "v_master", "survey_response_id", 0.8, 0.2, 120)
_register_cyclic("walk_forward_cyclic_narrow", "v_master", "survey_response_id", 0.4, 0.15, 24)
_register_cyclic("walk_forward_cyclic_ties", "v_history", "id", 0.4, 0.15, 2400)


@query("union_folds", f"SELECT survey_response_id, fold_index, role FROM ({cyclic('v_master', CUTS_80_20, 0.8, 24)})", ("v_master",))
def _(spark, sf):
    rows = splits.walk_forward_cyclic(frames.master(spark, sf), 0.8, 0.2, 24.0, **study_bound(spark, sf))
    parts = [splits.select_fold(rows, f, 5) for f in range(5)]
    return splits.union_folds(parts).select("survey_response_id", "fold_index", "role")


@query(
    "split_roles_disjoint",
    "SELECT 'user' AS split_mode, CAST(0 AS BIGINT) AS users_in_two_roles",
)
def _(spark, sf):
    rows = splits.split(frames.master(spark, sf), "user", max_group=frames.in_all(spark, sf)).groupBy("app_user_id").agg(F.countDistinct("role").alias("n"))
    return rows.agg(F.count_if(F.col("n") > 1).alias("users_in_two_roles")).select(F.lit("user").alias("split_mode"), "users_in_two_roles")
