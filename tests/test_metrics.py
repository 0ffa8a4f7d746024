import hashlib
import random
from statistics import NormalDist

import numpy as np
import pytest

from panelwell.operators import bootstrap, identity, metrics
from panelwell.session import cut_lineage


@pytest.fixture(scope="module")
def data():
    draw = random.Random(5)
    rows = []
    for u in range(12):
        for i in range(draw.randint(3, 12)):
            y = int(draw.random() < (0.6 if u < 5 else 0.15))
            rows.append((i % 3, u * 100 + i, u, y, round(min(1.0, max(0.0, draw.gauss(0.35 + 0.25 * y, 0.2))), 1)))
    return rows


@pytest.fixture(scope="module")
def predictions(spark, data):
    df = spark.createDataFrame(
        [(f, s, u, y, 1.0 - p, p) for f, s, u, y, p in data],
        "fold_index int, survey_response_id bigint, app_user_id bigint, y_true int, prob_class_0 double, prob_class_1 double",
    )
    return cut_lineage(df)


def brute(y, p, w=None):
    y, p = np.array(y), np.array(p)
    w = np.ones(len(y)) if w is None else np.array(w, float)
    pos, neg = y == 1, y == 0
    P, N = w[pos].sum(), w[neg].sum()
    if P == 0 or N == 0:
        return None
    wins = sum(w[i] * w[j] * (1.0 if p[i] > p[j] else 0.5 if p[i] == p[j] else 0.0) for i in np.flatnonzero(pos) for j in np.flatnonzero(neg))
    ap = ss = 0.0
    last = 0.0
    for s in sorted(set(p[w > 0]), reverse=True):
        tp, fp = w[pos & (p >= s)].sum(), w[neg & (p >= s)].sum()
        ap += (tp - last) / P * tp / (tp + fp)
        last = tp
        if 1 - fp / N >= 0.9:
            ss = max(ss, tp / P)
    tp, fp = w[pos & (p > 0.5)].sum(), w[neg & (p > 0.5)].sum()
    fn, tn = P - tp, N - fp
    f1 = (2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2
    return {
        "auroc": wins / (P * N), "auprc": ap, "sensitivity_at_specificity": ss, "precision": tp / (tp + fp) if tp + fp else 0.0,
        "recall": tp / P, "specificity": tn / N, "balanced_accuracy": (tp / P + tn / N) / 2, "f1": f1,
    }


def test_pooled(predictions, data):
    got = {r["metric"]: r["value"] for r in metrics.pooled_metrics(predictions).collect()}
    expected = brute([r[3] for r in data], [r[4] for r in data])
    assert all(abs(got[m] - expected[m]) < 1e-9 for m in expected)
    assert got["n_users"] == 12 and got["n_predictions"] == len(data)
    assert metrics.pooled_metrics(predictions.filter("y_true = 1")).count() == 0
    assert metrics.pooled_metrics(predictions.limit(0)).count() == 0


def test_draws_and_intervals(predictions, data):
    b = 60
    users = sorted({r[2] for r in data})
    def draw(rep):
        picks = [int(hashlib.md5(f"0:{rep}:{slot}".encode()).hexdigest()[:15], 16) % len(users) for slot in range(len(users))]
        return {u: picks.count(i) for i, u in enumerate(users)}
    y, p = [r[3] for r in data], [r[4] for r in data]
    reps = [brute(y, p, [draw(k)[r[2]] for r in data]) for k in range(b)]
    got = {r["replicate"]: r for r in bootstrap.cluster_bootstrap(predictions, b).collect()}
    assert len(got) == b
    for k in range(b):
        for m in metrics.BINARY_METRICS:
            assert abs(got[k][m] - reps[k][m]) < 1e-9
    weights = bootstrap.bootstrap_weights(predictions, b).groupBy("replicate").sum("weight").collect()
    assert {r[1] for r in weights} == {len(users)}
    jack = [brute(y, p, [0 if r[2] == u else 1 for r in data]) for u in users]
    shown = {r["metric"]: r for r in bootstrap.pooled_metrics_with_intervals(predictions, b).collect()}
    point, normal = brute(y, p), NormalDist()
    for m in ("auroc", "auprc", "f1"):
        theta, left = np.array([r[m] for r in reps]), np.array([r[m] for r in jack])
        share = (np.sum(theta < point[m]) + 0.5 * np.sum(theta == point[m])) / b
        z0, d = normal.inv_cdf(share), left.mean() - left
        a = (d**3).sum() / (6 * (d**2).sum() ** 1.5)
        for side, q in (("ci_low", 0.025), ("ci_high", 0.975)):
            z = z0 + normal.inv_cdf(q)
            level = normal.cdf(z0 + z / (1 - a * z))
            assert abs(shown[m][side] - np.quantile(theta, level)) < 1e-7, m
        assert shown[m]["ci_low"] <= point[m] <= shown[m]["ci_high"]


def test_blocks_pieces_and_null_scores_give_the_same(spark, predictions, monkeypatch):
    from panelwell.operators import weightings

    odd = spark.createDataFrame(
        [(9, 900 + i, 50 + i % 2, i % 2 if i < 4 else None, None, None if i < 3 else 0.3) for i in range(6)], predictions.schema
    )
    df = cut_lineage(predictions.unionByName(odd))

    def rows(made, key):
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in made.orderBy(key).collect())

    monkeypatch.setattr(bootstrap, "DRAW_BYTES", 0)
    joined = rows(bootstrap.cluster_bootstrap(df, 30), "replicate")
    monkeypatch.undo()
    left = rows(bootstrap.jackknife(df), "left_out")
    for block, cells in ((4096, 2_000_000), (7, 14)):
        monkeypatch.setattr(weightings, "BLOCK", block)
        monkeypatch.setattr(weightings, "CELLS", cells)
        assert rows(bootstrap.cluster_bootstrap(df, 30), "replicate") == joined
        assert rows(bootstrap.jackknife(df), "left_out") == left
    assert len(joined) == 30 and len(left) == 14 and len(rows(bootstrap.jackknife(df, 4), "left_out")) == 4
    assert bootstrap.jackknife(predictions.limit(0)).count() == bootstrap.cluster_bootstrap(predictions.limit(0), 5).count() == 0


def test_one_user_with_all_positives_has_no_interval(spark):
    rows = [(u, int(u == 0 and i < 3), 0.3 + 0.1 * (i % 4)) for u in range(6) for i in range(5)]
    df = cut_lineage(spark.createDataFrame([(u, y, 1 - p, p) for u, y, p in rows], "app_user_id bigint, y_true int, prob_class_0 double, prob_class_1 double"))
    out = bootstrap.pooled_metrics_with_intervals(df, 30).collect()
    assert all(r["ci_low"] is None and r["ci_high"] is None and r["value"] is not None for r in out)


def test_threshold(predictions, data):
    y, p = np.array([r[3] for r in data]), np.array([r[4] for r in data])
    uniq = np.unique(p)
    best, best_t = -1.0, None
    for t in [0.0, *((uniq[1:] + uniq[:-1]) / 2), 1.0]:
        ba = ((p >= t)[y == 1].mean() + (p < t)[y == 0].mean()) / 2
        if ba > best + 1e-12:
            best, best_t = ba, t
    row = metrics.tune_threshold(predictions).first()
    assert abs(row["threshold"] - best_t) < 1e-9 and abs(row["balanced_accuracy"] - best) < 1e-9
    assert metrics.tune_threshold(predictions.filter("y_true = 0")).first()["threshold"] is None


def test_within_person(predictions, data):
    aucs = []
    for u in {r[2] for r in data}:
        mine = [r for r in data if r[2] == u]
        value = brute([r[3] for r in mine], [r[4] for r in mine])
        if len(mine) >= 4 and value:
            aucs.append(value["auroc"])
    row = metrics.within_person_auroc(predictions).first()
    assert row["n_users"] == len(aucs) and abs(row["within_person_auroc"] - np.mean(aucs)) < 1e-9


def test_user_hash_ignores_order_and_duplicates(spark):
    def h(users):
        return identity.user_set_hash(spark.createDataFrame([(u,) for u in users], "app_user_id bigint")).first()["user_hash"]

    assert h([3, 1, 2]) == h([1, 2, 3, 3, 1]) != h([1, 2, 4]) and 0 <= h([1, 2]) < 2**32


def test_row_bootstrap_centres_on_the_estimate(predictions, data):
    got = {r["metric"]: r for r in bootstrap.row_bootstrap(predictions, 80).collect()}
    expected = brute([r[3] for r in data], [r[4] for r in data])
    assert len(got) == 7 and all(abs(r["var"] - r["std"] ** 2) < 1e-12 for r in got.values())
    assert all(abs(got[m]["mean"] - expected[m]) < 3 * got[m]["std"] for m in ("auroc", "f1", "recall"))
