import os

import pytest

from panelwell.registry import REGISTRY

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
# one query per family; tools/check_oracle.py compares all of them
NAMES = [
    "table_digest", "id_ranges", "cohort_sensors", "collapse_daily_first", "dedup_responses_12h", "sampler_grid",
    "cohort_by_setting", "split_longitudinal_ties", "dual_scale", "fit_demographics", "pooled_metrics", "tune_threshold",
    "cluster_bootstrap", "fold_identity", "newton_grid", "fold_matrix_stats", "sink_fold_metrics", "write_manifest",
]


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return connection


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, db, name):
    entry = REGISTRY[name]
    df = entry.run(spark, SF)
    columns = sorted(df.columns)
    mine = sorted(str(tuple(r)) for r in df.select(*columns).collect())
    quoted = ", ".join(f'"{c}"' for c in columns)
    theirs = sorted(str(r) for r in db.execute(f"SELECT {quoted} FROM ({entry.sql})").fetchall())
    assert mine == theirs and mine


def test_every_name_has_a_callable_and_most_have_sql():
    without = {n for n, e in REGISTRY.items() if e.sql is None}
    assert without == {
        "clip_upper_quantile_approximate", "bca_interval", "logistic_l2", "logistic_l1", "random_forest",
        "boosted_trees", "support_vector_machine", "fit_predict_fold", "hyper_parameter_search", "catch22",
        "pipeline_grid", "nested_search_lr_l2", "nested_search_lr_l1", "nested_search_rf", "nested_search_gbt", "nested_search_svm",
    }
