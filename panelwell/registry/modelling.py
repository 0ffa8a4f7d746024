"""The model step: predictions of every kind of model, search, setting grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwell.operators import catch22, labels, metrics, model, people, search
from panelwell.operators.newton import NewtonPipeline, fit_grid, newton_logistic
from panelwell.operators.windows import GRID_BINS, GRID_LOOKBACKS, packed_grid, sampler_grid
from panelwell.plans.walk_forward import fold_matrix, listed_folds, walk_forward
from panelwell.registry import frames
from panelwell.registry.core import q6, query, r6
from panelwell.registry.views import H
from panelwell.session import run_scope, shared_path, store
from panelwell.sources import study

MODALITIES = frames.MODALITIES


def features(spark, sf):
    """Fold rows with the whole feature matrix (windows scaled per fold, people, sleep, context), written once.

    The optimisers run a job per step; a written table keeps the window plan out of their lineage, and its
    folders by fold and role let a fit read its own rows alone.
    """
    folds = labels.sleep_left_join(frames.cyclic(spark, sf), labels.sleep_hours(study.answer(spark, sf)))
    windows = store(frames.windows(spark, sf).select("survey_response_id", *MODALITIES), "packed-windows")
    rows = fold_matrix(windows, store(folds, "folds"), MODALITIES, "stats", True, people.eav_pivot(study.demographic(spark, sf)), "both", "both")
    return store(rows, "features", ["fold_index", "role"])


def _register_model(name: str, kind: str) -> None:
    @query(name)
    def _(spark, sf):
        return walk_forward(features(spark, sf), model.MODELS[kind])


_register_model("logistic_l2", "lr_l2")
_register_model("logistic_l1", "lr_l1")
_register_model("random_forest", "rf")
_register_model("boosted_trees", "gbt")
_register_model("support_vector_machine", "svm")


def _register_search(kind: str) -> None:
    @query(f"nested_search_{kind}")
    def _(spark, sf):
        return search.nested_search(features(spark, sf), range(5), search.GRIDS[kind], max_group=frames.in_all(spark, sf))


for _kind in search.GRIDS:
    _register_search(_kind)


@query("fit_predict_fold")
def _(spark, sf):
    return model.fit_predict_fold(features(spark, sf), 0, model.MODELS["lr_l2"])


@query("hyper_parameter_search")
def _(spark, sf):
    return model.search(features(spark, sf), 0)


@query(
    "prediction_join_back",
    f"SELECT survey_response_id, app_user_id, record_timestamp, {q6('prob_class_1')} AS prob_class_1 FROM v_predictions",
    ("v_predictions",),
)
def _(spark, sf):
    scores = frames.predictions(spark, sf).select("survey_response_id", "prob_class_1")
    joined = model.prediction_join_back(scores, frames.master(spark, sf))
    return joined.select("survey_response_id", "app_user_id", "record_timestamp", r6("prob_class_1").alias("prob_class_1"))


SETTING = ["lookback_hours", "bin_hours"]
GROUP = [*SETTING, "fold_index"]
#: Mean and deviation of each channel's window, in the order of the summary statistics.
PAIRS = {"level": NewtonPipeline((0, 5), 0.01), "spread": NewtonPipeline((2, 7), 0.01)}


def grid_folds(folds, samplers):
    """The fold rows of each of the settings."""
    settings = F.array(*[F.struct(F.lit(s.lookback_hours).alias("lookback_hours"), F.lit(s.freq_hours).alias("bin_hours")) for s in samplers])
    return folds.select("*", F.explode(settings).alias("__s")).select("*", "__s.*").drop("__s")


def grid_matrix(spark, sf):
    """Features of every survey and setting, with the folds in a list: they are the same in all folds and settings.

    The lists travel with the surveys below the settings, so that nothing as long as the grid is joined.
    """
    surveys = listed_folds(frames.cyclic(spark, sf))
    windows = packed_grid(surveys, study.sensor(spark, sf), sampler_grid(), MODALITIES)
    return fold_matrix(windows, None, MODALITIES, "stats", False, setting=SETTING)


def grid_results(spark, sf):
    """AUROC of two trained pipelines per setting: five fits each, their test rows pooled."""
    scores = fit_grid(grid_matrix(spark, sf), GROUP, PAIRS).withColumn("prob_class_1", F.round("prob_class_1", 10))
    by = ["pipeline", *SETTING]
    # five metrics readers of one pass over the scores
    table = store(metrics.score_table(scores, by), "grid-scores")
    return metrics.binary_metrics(table, by, max_group=frames.in_all(spark, sf)).select(*by, F.col("auroc").alias("value"))


def newton_sql(steps=8):
    """Weighted ridge logistic regressions of two features, their Newton steps written out (the 3 x 3 system by cofactors)."""
    key = "pipeline, lookback, bin, fold_index"
    parts = [f"""x AS MATERIALIZED (SELECT p.pipeline, s.lookback, s.bin, c.fold_index, c.role, c.survey_response_id, c.answer AS y,
    CASE p.pipeline WHEN 'level' THEN s.m0 ELSE s.s0 END AS x1, CASE p.pipeline WHEN 'level' THEN s.m1 ELSE s.s1 END AS x2
  FROM v_cyclic c JOIN s USING (survey_response_id), (VALUES ('level'), ('spread')) p(pipeline))""",
             f"""w AS (SELECT {key}, count(*) / (2.0::DOUBLE * count_if(y = 0)) AS w0, count(*) / (2.0::DOUBLE * count_if(y = 1)) AS w1 FROM x WHERE role = 'train' GROUP BY ALL
  HAVING count_if(y = 0) > 0 AND count_if(y = 1) > 0)""",
             f"t AS MATERIALIZED (SELECT x.*, CASE WHEN y = 1 THEN w1 ELSE w0 END AS w FROM x JOIN w USING ({key}) WHERE role = 'train')",
             f"m AS (SELECT {key}, sum(w) AS total, sum(w * w) AS squares, sum(w * x1) / sum(w) AS m1, sum(w * x2) / sum(w) AS m2 FROM t GROUP BY ALL)",
             f"""d AS MATERIALIZED (SELECT {key}, first(total) AS total, first(m1) AS m1, first(m2) AS m2, sqrt(sum(w * (x1 - m1) * (x1 - m1)) / (first(total) - first(squares) / first(total))) AS d1,
    sqrt(sum(w * (x2 - m2) * (x2 - m2)) / (first(total) - first(squares) / first(total))) AS d2 FROM t JOIN m USING ({key}) GROUP BY ALL)""",
             f"""z AS MATERIALIZED (SELECT {key}, y, w / total AS w, (x1 - m1) / CASE WHEN d1 > 0 THEN d1 ELSE 1 END AS z1, (x2 - m2) / CASE WHEN d2 > 0 THEN d2 ELSE 1 END AS z2 FROM t JOIN d USING ({key}))""",
             f"b0 AS (SELECT {key}, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, 0.0::DOUBLE AS b3 FROM d)"]
    ridge = repr(PAIRS["level"].strength)
    for i in range(steps):
        parts.append(f"""h{i} AS (SELECT {key}, first(b1) AS b1, first(b2) AS b2, first(b3) AS b3,
    sum(w * (p - y) * z1) + {ridge} * first(b1) AS g1, sum(w * (p - y) * z2) + {ridge} * first(b2) AS g2, sum(w * (p - y)) AS g3,
    sum(w * p * (1 - p) * z1 * z1) + {ridge} AS a, sum(w * p * (1 - p) * z1 * z2) AS b, sum(w * p * (1 - p) * z1) AS c,
    sum(w * p * (1 - p) * z2 * z2) + {ridge} AS d, sum(w * p * (1 - p) * z2) AS e, sum(w * p * (1 - p)) AS f
  FROM (SELECT z.*, b1, b2, b3, 1 / (1 + exp(-(b1 * z1 + b2 * z2 + b3))) AS p FROM z JOIN b{i} USING ({key})) GROUP BY ALL)""")
        parts.append(f"""b{i + 1} AS MATERIALIZED (SELECT {key}, b1 - ((d * f - e * e) * g1 + (c * e - b * f) * g2 + (b * e - c * d) * g3) / q AS b1,
    b2 - ((c * e - b * f) * g1 + (a * f - c * c) * g2 + (b * c - a * e) * g3) / q AS b2, b3 - ((b * e - c * d) * g1 + (b * c - a * e) * g2 + (a * d - b * b) * g3) / q AS b3
  FROM (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS q FROM h{i}))""")
    parts.append(f"""k AS MATERIALIZED (SELECT {key}, b3 - b1 * m1 / e1 - b2 * m2 / e2 AS b0, b1 / e1 AS b1, b2 / e2 AS b2
  FROM b{steps} JOIN (SELECT *, CASE WHEN d1 > 0 THEN d1 ELSE 1 END AS e1, CASE WHEN d2 > 0 THEN d2 ELSE 1 END AS e2 FROM d) USING ({key}))""")
    return ",\n".join(parts)


GRID_FITS = f"""bins AS (SELECT app_user_id, modality, bin, epoch_us(start_timestamp) // (bin * {H}) AS w, sum(value) AS value
  FROM v_sensor, (VALUES {', '.join(f'({v})' for v in GRID_BINS)}) g(bin) GROUP BY ALL),
cells AS (SELECT m.survey_response_id, l.lookback, g.bin, mo.modality, coalesce(b.value, 0.0::DOUBLE) AS v
  FROM v_master m, (VALUES (24), (48), (72), (96), (120)) l(lookback), (VALUES {', '.join(f'({v})' for v in GRID_BINS)}) g(bin), (VALUES ('distance'), ('step')) mo(modality), range(30) i(i)
  LEFT JOIN bins b ON b.app_user_id = m.app_user_id AND b.bin = g.bin AND b.modality = mo.modality AND b.w = epoch_us(m.record_timestamp) // (g.bin * {H}) - 1 - i.i
  WHERE i.i < l.lookback // g.bin),
s AS MATERIALIZED (SELECT survey_response_id, lookback, bin, avg(v) FILTER (modality = 'distance') AS m0, avg(v) FILTER (modality = 'step') AS m1,
    stddev_pop(v) FILTER (modality = 'distance') AS s0, stddev_pop(v) FILTER (modality = 'step') AS s1 FROM cells GROUP BY ALL),
{newton_sql()}"""
GRID_VALUES = f"""{GRID_FITS},
p AS (SELECT pipeline, lookback, bin, y, round(1 / (1 + exp(-(k.b0 + k.b1 * x1 + k.b2 * x2))), 10) AS score FROM x JOIN k USING (pipeline, lookback, bin, fold_index) WHERE role = 'test'),
r AS (SELECT *, rank() OVER (PARTITION BY pipeline, lookback, bin ORDER BY score) + (count(*) OVER (PARTITION BY pipeline, lookback, bin, score) - 1) / 2.0::DOUBLE AS rk FROM p),
a AS (SELECT pipeline, CAST(lookback AS DOUBLE) AS lookback_hours, bin, (sum(rk) FILTER (y = 1) - count_if(y = 1) * (count_if(y = 1) + 1) / 2.0::DOUBLE) / (count_if(y = 1)::DOUBLE * count_if(y = 0)) AS value
  FROM r GROUP BY ALL)"""
GRID_NEEDS = ("v_master", "v_sensor", "v_cyclic")


@query(
    "newton_grid",
    f"WITH {GRID_FITS} SELECT pipeline, CAST(lookback AS DOUBLE) AS lookback_hours, CAST(bin AS DOUBLE) AS bin_hours, fold_index, {q6('b0')} AS intercept, {q6('b1')} AS first, {q6('b2')} AS second FROM k",
    GRID_NEEDS,
)
def _(spark, sf):
    """The 200 fits behind the grid's summary: intercept and coefficients."""
    matrix = store(grid_matrix(spark, sf), "grid-matrix")
    first = F.element_at("coefficients", F.when(F.col("pipeline") == "level", 1).otherwise(3))
    second = F.element_at("coefficients", F.when(F.col("pipeline") == "level", 6).otherwise(8))
    return newton_logistic(matrix, GROUP, PAIRS).select("pipeline", *GROUP, r6("intercept").alias("intercept"), r6(first).alias("first"), r6(second).alias("second"))


@query(
    "grid_summary",
    f"WITH {GRID_VALUES} SELECT pipeline, {q6('avg(value)')} AS mean, {q6('stddev_samp(value)')} AS std, count(*) AS n_settings FROM a GROUP BY pipeline",
    GRID_NEEDS,
)
def _(spark, sf):
    return model.grid_summary(grid_results(spark, sf)).withColumns({"mean": r6("mean"), "std": r6("std")})


@query(
    "grid_heatmap",
    f"WITH {GRID_VALUES} SELECT lookback_hours, {', '.join(q6(f'avg(value) FILTER (bin = {b})') + f' AS bin_{b}h' for b in GRID_BINS)} FROM a GROUP BY lookback_hours",
    GRID_NEEDS,
)
def _(spark, sf):
    table = model.grid_heatmap(grid_results(spark, sf), GRID_BINS)
    return table.select("lookback_hours", *[r6(c).alias(c) for c in table.columns[1:]])


#: Window statistics scaled over all (0-9) and by participant (10-19), then people, sleep and context (20-35).
FULL = {
    f"{name}_{label}": NewtonPipeline(columns, strength)
    for name, columns in (("global", tuple(range(10))), ("subject", tuple(range(10, 20))), ("dual", tuple(range(20))), ("full", None))
    for label, strength in (("firm", 0.1), ("loose", 0.001))
}


def full_scores(folds, windows, demographics, pipelines=FULL):
    """The score table of the pipelines on the whole fold matrix, which differs by fold, lookback by lookback.

    The fold rows of a lookback and all that is stored for its fits go before the next one begins; its score table stays.
    """
    spark, by = folds.sparkSession, ["pipeline", *SETTING]
    path, table = shared_path(spark, "grid-scores"), None
    for lookback in GRID_LOOKBACKS:
        with run_scope(spark):
            own = [s for s in sampler_grid() if s.lookback_hours == lookback]
            matrix = fold_matrix(windows.filter(F.col("lookback_hours") == lookback), grid_folds(folds, own), MODALITIES, "stats", True, demographics, "both", "both", SETTING)
            table = metrics.score_table(fit_grid(matrix, GROUP, pipelines), by)
            table.write.mode("append").parquet(path)
    return spark.read.schema(table.schema).parquet(path)


@query("pipeline_grid")
def _(spark, sf):
    """Eight pipelines x 20 settings x 5 folds on the whole fold matrix: AUROC and AUPRC of the pooled test rows."""
    folds = store(labels.sleep_left_join(frames.cyclic(spark, sf), labels.sleep_hours(study.answer(spark, sf))), "grid-folds")
    windows = store(packed_grid(frames.master(spark, sf), study.sensor(spark, sf), sampler_grid(), MODALITIES), "grid-windows", ["lookback_hours"])
    table = full_scores(folds, windows, people.eav_pivot(study.demographic(spark, sf)))
    by = ["pipeline", *SETTING]
    return metrics.binary_metrics(table, by, max_group=frames.in_all(spark, sf)).select(*by, "auroc", "auprc", "n_positive", "n_predictions")


@query("catch22")
def _(spark, sf):
    return catch22.catch22_features(frames.windows(spark, sf), MODALITIES)
