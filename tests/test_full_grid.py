import datetime
import glob

from pyspark.sql import functions as F

from panelwell.operators.newton import NewtonPipeline
from panelwell.operators.windows import sampler_grid
from panelwell.registry import modelling
from panelwell.session import ensure_checkpoint_dir, run_scope

REAL = modelling.fold_matrix
PIPELINES = {"pair": NewtonPipeline((0, 3), 0.1)}


def test_a_lookback_leaves_only_its_scores(spark, monkeypatch):
    rows = [(f, "test" if i % 5 == f else "train", i, i % 4, datetime.datetime(2026, 1, 9, i % 24), (i * 7 // 5) % 2, None, None, float(i % 9), i % 2 == 0) for i in range(40) for f in range(2)]
    folds = spark.createDataFrame(rows, "fold_index int, role string, survey_response_id bigint, app_user_id bigint, record_timestamp timestamp_ntz, answer int, "
                                        "sleep_hours double, sleep_category int, referent_hours double, is_morning boolean")
    cells = [(i, s.lookback_hours, s.freq_hours, [float((i * k + s.freq_hours) % 7) for k in range(3)], [float(i % 5), 1.0, s.lookback_hours]) for i in range(40) for s in sampler_grid()]
    windows = spark.createDataFrame(cells, "survey_response_id bigint, lookback_hours double, bin_hours double, distance array<double>, step array<double>")
    # people are left out: their columns are not what is tested
    monkeypatch.setattr(modelling, "fold_matrix", lambda w, f, c, kind, scaled, people, *more: REAL(w, f, c, kind, scaled, None, *more))
    ensure_checkpoint_dir(spark)
    held, fit = [], modelling.fit_grid

    def counted(matrix, by, pipelines):
        scores = fit(matrix, by, pipelines)
        held.append(len(glob.glob(spark.sparkContext.getCheckpointDir().removeprefix("file:").split("/run-")[0] + "/**/grid-matrix-*", recursive=True)))
        return scores

    monkeypatch.setattr(modelling, "fit_grid", counted)
    key = lambda r: (r["pipeline"], r["lookback_hours"], r["bin_hours"], round(r["score"], 6), r["pos"], r["neg"])
    with run_scope(spark):
        got = sorted(map(key, modelling.full_scores(folds, windows, None, PIPELINES).collect()))
    assert held == [1] * 5
    with run_scope(spark):
        matrix = REAL(windows, modelling.grid_folds(folds, sampler_grid()), modelling.MODALITIES, "stats", True, None, "both", "both", modelling.SETTING)
        whole = fit(matrix, modelling.GROUP, PIPELINES).groupBy("pipeline", *modelling.SETTING, F.col("prob_class_1").alias("score")).agg(F.sum("y_true").alias("pos"), F.sum(1 - F.col("y_true")).alias("neg"))
        want = sorted(map(key, whole.collect()))
    total = lambda rows: {s: (sum(r[4] for r in rows if r[:3] == s), sum(r[5] for r in rows if r[:3] == s)) for s in {r[:3] for r in rows}}
    assert len({r[:3] for r in got}) == 20 and total(got) == total(want) and {r[:4] for r in got} == {r[:4] for r in want}
