"""Ranks, curves, pooled metrics, bootstrap, fingerprints."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from panelwell.functions.probabilities import positive_prob, softmax_pair
from panelwell.operators import bootstrap, identity, metrics
from panelwell.operators.metrics import BINARY_METRICS
from panelwell.registry import frames
from panelwell.registry.core import q6, query, r6
from panelwell.sources import study

PREDICTIONS = "(SELECT *, 0 AS g FROM v_predictions)"


def table_sql(source: str, by: str, weight: str = "1") -> str:
    return (
        f"SELECT {by}, prob_class_1 AS score, sum(CASE WHEN y_true = 1 THEN {weight} ELSE 0 END) AS pos, "
        f"sum(CASE WHEN y_true = 1 THEN 0 ELSE {weight} END) AS neg FROM {source} GROUP BY {by}, prob_class_1"
    )


def curve_sql(table: str, by: str) -> str:
    return (
        f"SELECT *, sum(pos) OVER (PARTITION BY {by} ORDER BY score DESC) AS tp, sum(neg) OVER (PARTITION BY {by} ORDER BY score DESC) AS fp, "
        f"sum(pos) OVER (PARTITION BY {by}) AS n_pos, sum(neg) OVER (PARTITION BY {by}) AS n_neg FROM ({table})"
    )


RAW = {
    "auroc": "w / (p * n)", "auprc": "ap / p", "sensitivity_at_specificity": "coalesce(ss, 0)",
    "precision": "CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END", "recall": "tp / (tp + fn)", "specificity": "tn / (tn + fp)",
    "balanced_accuracy": "(tp / (tp + fn) + tn / (tn + fp)) / 2",
    "f1": "(2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2",
}


def metrics_sql(table: str, by: str, exact: bool = False) -> str:
    """Every metric per group, null with one class; ``exact`` leaves them unrounded."""
    shown = {m: f"CAST({RAW[m]} AS DOUBLE)" if exact else q6(RAW[m]) for m in BINARY_METRICS}
    made = ", ".join(f"CASE WHEN p > 0 AND n > 0 THEN {shown[m]} END AS {m}" for m in BINARY_METRICS)
    return f"""
SELECT {by}, {made}, CAST(p AS BIGINT) AS n_positive, CAST(p + n AS BIGINT) AS n_predictions FROM (
  SELECT {by}, CAST(max(n_pos) AS DOUBLE) AS p, CAST(max(n_neg) AS DOUBLE) AS n,
    CAST(sum(pos * (n_neg - fp + neg / 2.0)) AS DOUBLE) AS w, CAST(sum(CASE WHEN pos > 0 THEN pos * (tp / CAST(tp + fp AS DOUBLE)) END) AS DOUBLE) AS ap,
    max(CASE WHEN n_neg > 0 AND 1.0::DOUBLE - fp / CAST(n_neg AS DOUBLE) >= 0.9::DOUBLE THEN tp / CAST(n_pos AS DOUBLE) END) AS ss,
    CAST(sum(CASE WHEN score > 0.5 THEN pos ELSE 0 END) AS DOUBLE) AS tp, CAST(sum(CASE WHEN score > 0.5 THEN neg ELSE 0 END) AS DOUBLE) AS fp,
    CAST(sum(CASE WHEN score > 0.5 THEN 0 ELSE pos END) AS DOUBLE) AS fn, CAST(sum(CASE WHEN score > 0.5 THEN 0 ELSE neg END) AS DOUBLE) AS tn
  FROM ({curve_sql(table, by)}) GROUP BY {by})"""


def rounded(df, *keep):
    return df.select(*keep, *[r6(m).alias(m) for m in BINARY_METRICS], F.col("n_positive").cast("bigint"), F.col("n_predictions").cast("bigint"))


@query(
    "average_rank",
    "SELECT survey_response_id, rank() OVER (ORDER BY prob_class_1) + (count(*) OVER (PARTITION BY prob_class_1) - 1) / 2.0::DOUBLE AS average_rank FROM v_predictions",
    ("v_predictions",),
)
def _(spark, sf):
    return metrics.average_rank(frames.stored_predictions(spark, sf), "prob_class_1", max_group=frames.in_all(spark, sf)).select("survey_response_id", "average_rank")


@query(
    "average_rank_by_user",
    "SELECT survey_response_id, rank() OVER (PARTITION BY app_user_id ORDER BY prob_class_1) + (count(*) OVER (PARTITION BY app_user_id, prob_class_1) - 1) / 2.0::DOUBLE AS average_rank FROM v_predictions",
    ("v_predictions",),
)
def _(spark, sf):
    ranked = metrics.average_rank(frames.predictions(spark, sf), "prob_class_1", ["app_user_id"], max_group=frames.per_user(spark, sf))
    return ranked.select("survey_response_id", "average_rank")


@query(
    "curve_cumsums",
    f"SELECT fold_index, {q6('score')} AS score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg FROM ({curve_sql(table_sql('v_predictions', 'fold_index'), 'fold_index')})",
    ("v_predictions",),
)
def _(spark, sf):
    curve = metrics.curve_cumsums(frames.predictions(spark, sf), ["fold_index"], frames.in_all(spark, sf))
    return curve.select("fold_index", r6("score").alias("score"), *[F.col(c).cast("bigint").alias(c) for c in ("tp", "fp", "n_pos", "n_neg")])


@query(
    "confusion_matrix",
    "SELECT a.a AS actual, b.b AS predicted, CAST(count_if(y_true = a.a AND CAST(prob_class_1 > prob_class_0 AS INTEGER) = b.b) AS BIGINT) AS n FROM v_predictions, (VALUES (0), (1)) a(a), (VALUES (0), (1)) b(b) GROUP BY a.a, b.b",
    ("v_predictions",),
)
def _(spark, sf):
    return metrics.confusion_matrix(metrics.with_predicted_class(frames.predictions(spark, sf)))


@query(
    "classification_report",
    f"""SELECT class, {q6('CASE WHEN called = 0 THEN 0 ELSE tp / called END')} AS precision, {q6('CASE WHEN support = 0 THEN 0 ELSE tp / support END')} AS recall,
  {q6('CASE WHEN support + called = 0 THEN 0 ELSE 2 * tp / (support + called) END')} AS f1, support FROM (
  SELECT k AS class, count_if(y_true = k AND y_pred = k)::DOUBLE AS tp, CAST(count_if(y_true = k) AS BIGINT) AS support, count_if(y_pred = k) AS called
  FROM (SELECT y_true, CAST(prob_class_1 > prob_class_0 AS INTEGER) AS y_pred FROM v_predictions), (VALUES (0), (1)) c(k) GROUP BY k)""",
    ("v_predictions",),
)
def _(spark, sf):
    report = metrics.classification_report(metrics.with_predicted_class(frames.predictions(spark, sf)))
    return report.select("class", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], F.col("support").cast("bigint").alias("support"))


def _register_metric(name: str, columns: list[str]) -> None:
    """One metric family per fold, from the shared curve."""
    listed = ", ".join(columns)

    @query(name, f"SELECT fold_index, {listed} FROM ({metrics_sql(table_sql('v_predictions', 'fold_index'), 'fold_index')})", ("v_predictions",))
    def _(spark, sf):
        table = metrics.score_table(frames.predictions(spark, sf), ["fold_index"])
        wide = metrics.binary_metrics(table, ["fold_index"], max_group=frames.in_all(spark, sf))
        return wide.select("fold_index", *[r6(c).alias(c) for c in columns])


_register_metric("binary_rates", ["recall", "specificity", "precision"])
_register_metric("macro_f1", ["f1"])
_register_metric("balanced_accuracy", ["balanced_accuracy"])
_register_metric("auroc", ["auroc"])
_register_metric("auprc", ["auprc"])
_register_metric("sensitivity_at_specificity", ["sensitivity_at_specificity"])


@query(
    "pooled_metrics",
    f"""WITH m AS ({metrics_sql(table_sql(PREDICTIONS, 'g'), 'g')})
{' UNION ALL '.join(f"SELECT '{m}' AS metric, {m} AS value FROM m" for m in BINARY_METRICS)}
UNION ALL SELECT 'n_predictions', CAST(n_predictions AS DOUBLE) FROM m UNION ALL SELECT 'n_positive', CAST(n_positive AS DOUBLE) FROM m
UNION ALL SELECT 'n_users', CAST(count(DISTINCT app_user_id) AS DOUBLE) FROM v_predictions""",
    ("v_predictions",),
)
def _(spark, sf):
    return metrics.pooled_metrics(frames.predictions(spark, sf), max_group=frames.in_all(spark, sf)).withColumn("value", r6("value"))


@query(
    "fold_breakdown",
    f"SELECT fold_index, n_predictions, n_users, n_positive, auroc FROM ({metrics_sql(table_sql('v_predictions', 'fold_index'), 'fold_index')}) "
    "JOIN (SELECT fold_index, count(DISTINCT app_user_id) AS n_users FROM v_predictions GROUP BY 1) USING (fold_index)",
    ("v_predictions",),
)
def _(spark, sf):
    rows = metrics.fold_breakdown(frames.stored_predictions(spark, sf), max_group=frames.in_all(spark, sf))
    return rows.select("fold_index", F.col("n_predictions").cast("bigint"), "n_users", F.col("n_positive").cast("bigint"), r6("auroc").alias("auroc"))


@query(
    "fold_mean_metrics",
    f"WITH m AS ({metrics_sql(table_sql('v_predictions', 'fold_index'), 'fold_index', True)}) "
    + " UNION ALL ".join(f"SELECT '{m}' AS metric, {q6(f'avg({m})')} AS mean, {q6(f'stddev_samp({m})')} AS std, count({m}) AS n_folds FROM m" for m in BINARY_METRICS),
    ("v_predictions",),
)
def _(spark, sf):
    return metrics.fold_mean_metrics(metrics.fold_metrics(frames.predictions(spark, sf), max_group=frames.in_all(spark, sf))).withColumns({"mean": r6("mean"), "std": r6("std")})


@query(
    "within_person_auroc",
    f"""SELECT {q6('avg(w / (p * n))')} AS within_person_auroc, count(*) AS n_users FROM (
  SELECT app_user_id, CAST(max(n_pos) AS DOUBLE) AS p, CAST(max(n_neg) AS DOUBLE) AS n, CAST(sum(pos * (n_neg - fp + neg / 2.0)) AS DOUBLE) AS w
  FROM ({curve_sql(table_sql('v_predictions', 'app_user_id'), 'app_user_id')}) GROUP BY app_user_id) WHERE p > 0 AND n > 0 AND p + n >= 4""",
    ("v_predictions",),
)
def _(spark, sf):
    return metrics.within_person_auroc(frames.predictions(spark, sf), max_group=frames.per_user(spark, sf)).withColumn("within_person_auroc", r6("within_person_auroc"))


TUNE = """WITH v AS (SELECT fold_index, prob_class_1 AS s, y_true AS y FROM v_predictions),
u AS (SELECT DISTINCT fold_index, s FROM v),
cand AS (SELECT fold_index, (s + lag(s) OVER (PARTITION BY fold_index ORDER BY s)) / 2.0::DOUBLE AS t FROM u UNION ALL SELECT DISTINCT fold_index, 0.0::DOUBLE FROM u UNION ALL SELECT DISTINCT fold_index, 1.0::DOUBLE FROM u),
judged AS (SELECT fold_index, t, (count_if(y = 1 AND s >= t) / CAST(count_if(y = 1) AS DOUBLE) + count_if(y = 0 AND s < t) / CAST(count_if(y = 0) AS DOUBLE)) / 2.0::DOUBLE AS ba
  FROM cand JOIN v USING (fold_index) WHERE t IS NOT NULL GROUP BY fold_index, t),
tuned AS (SELECT fold_index, min(t) AS threshold, max(ba) AS balanced_accuracy FROM judged j WHERE ba >= (SELECT max(ba) FROM judged k WHERE k.fold_index = j.fold_index) - 1e-12 GROUP BY fold_index)"""


@query("tune_threshold", f"{TUNE} SELECT fold_index, {q6('threshold')} AS threshold, {q6('balanced_accuracy')} AS balanced_accuracy FROM tuned", ("v_predictions",))
def _(spark, sf):
    tuned = metrics.tune_threshold(frames.predictions(spark, sf), ["fold_index"], frames.in_all(spark, sf))
    return tuned.select("fold_index", r6("threshold").alias("threshold"), r6("balanced_accuracy").alias("balanced_accuracy"))


@query(
    "apply_threshold",
    f"{TUNE} SELECT p.survey_response_id, CAST(p.prob_class_1 >= t.threshold AS INTEGER) AS y_pred FROM v_predictions p JOIN tuned t ON t.fold_index = 0",
    ("v_predictions",),
)
def _(spark, sf):
    # read by the tuning and by the calls
    rows = frames.stored_predictions(spark, sf)
    tuned = metrics.tune_threshold(rows.filter("fold_index = 0"), (), frames.in_all(spark, sf))
    return metrics.apply_threshold(rows, tuned).select("survey_response_id", "y_pred")


@query(
    "degenerate_guard",
    f"SELECT app_user_id, auroc, n_classes FROM ({metrics_sql(table_sql('v_predictions', 'app_user_id'), 'app_user_id')}) JOIN (SELECT app_user_id, count(DISTINCT y_true) AS n_classes FROM v_predictions GROUP BY 1) USING (app_user_id)",
    ("v_predictions",),
)
def _(spark, sf):
    rows = frames.predictions(spark, sf)
    classes = rows.groupBy("app_user_id").agg(F.countDistinct("y_true").alias("n_classes"))
    raw = metrics.fold_breakdown(rows, ["app_user_id"], frames.per_user(spark, sf)).join(classes, "app_user_id")
    # a finite stand-in for the undefined value, which the guard has to remove
    filled = raw.withColumn("auroc", F.coalesce("auroc", F.lit(0.25)))
    return metrics.degenerate_guard(filled, ["auroc"]).select("app_user_id", r6("auroc").alias("auroc"), "n_classes")


@query(
    "best_so_far",
    f"SELECT app_user_id, fold_index, {q6('max(v) OVER (PARTITION BY app_user_id ORDER BY fold_index)')} AS best FROM (SELECT app_user_id, fold_index, max(prob_class_1) AS v FROM v_predictions GROUP BY ALL)",
    ("v_predictions",),
)
def _(spark, sf):
    steps = frames.predictions(spark, sf).groupBy("app_user_id", "fold_index").agg(F.max("prob_class_1").alias("value"))
    return metrics.best_so_far(steps, ["app_user_id"], "fold_index", max_group=5).select("app_user_id", "fold_index", r6("best").alias("best"))


K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


def multiclass(spark, sf):
    """Three classes over all events: the event's remainder is the class, k decides the scores."""
    k = F.get_json_object("props", "$.k").cast("int")
    scores = [((k + 37 * c) % 50 + F.when(F.col("event_id") % 3 == c, 20).otherwise(0) + 1).cast("double") for c in range(3)]
    total = scores[0] + scores[1] + scores[2]
    return study.events(spark, sf).select(
        "event_id", (F.col("event_id") % 3).cast("int").alias("y_true"),
        *[(s / total).alias(f"prob_class_{c}") for c, s in enumerate(scores)],
    )


def multiclass_sql(body: str) -> str:
    score = [f"CAST(({K} + {37 * c}) % 50 + CASE WHEN event_id % 3 = {c} THEN 20 ELSE 0 END + 1 AS DOUBLE)" for c in range(3)]
    return f"""WITH s AS (SELECT event_id, CAST(event_id % 3 AS INTEGER) AS y_true, {', '.join(f'{x} AS s{c}' for c, x in enumerate(score))} FROM events),
p AS (SELECT event_id, y_true, s0 / (s0 + s1 + s2) AS p0, s1 / (s0 + s1 + s2) AS p1, s2 / (s0 + s1 + s2) AS p2 FROM s),
c AS (SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS y_pred FROM p),
r AS ({' UNION ALL '.join(f'SELECT {k} AS class, p{k} AS prob_class_1, CAST(y_true = {k} AS INTEGER) AS y_true, y_pred = {k} AS hit FROM c' for k in range(3))}),
f AS (SELECT class, count_if(hit AND y_true = 1)::DOUBLE AS tp, count_if(hit AND y_true = 0)::DOUBLE AS fp, count_if(NOT hit AND y_true = 1)::DOUBLE AS fn, count_if(NOT hit AND y_true = 0)::DOUBLE AS tn FROM r GROUP BY class),
m AS ({metrics_sql(table_sql('r', 'class'), 'class', True)})
{body}"""


MACRO = f"""SELECT {q6('avg(2 * tp / (2 * tp + fp + fn))')} AS f1, {q6('avg(auroc)')} AS auroc, {q6('avg(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END)')} AS precision,
  {q6('avg(tp / (tp + fn))')} AS recall, {q6('avg(tn / (tn + fp))')} AS specificity, {q6('avg(sensitivity_at_specificity)')} AS sensitivity_at_specificity,
  {q6('avg(tp / (tp + fn))')} AS balanced_accuracy FROM f JOIN (SELECT class, auroc, sensitivity_at_specificity FROM m) USING (class)"""
BY_CLASS = f"""SELECT class, {q6('2 * tp / (2 * tp + fp + fn)')} AS f1, {q6('auroc')} AS auroc, {q6('CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END')} AS precision,
  {q6('tp / (tp + fn)')} AS recall, {q6('tn / (tn + fp)')} AS specificity, {q6('sensitivity_at_specificity')} AS sensitivity_at_specificity, {q6('auprc')} AS auprc,
  CAST(tp + fn AS BIGINT) AS support, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn
  FROM f JOIN (SELECT class, auroc, sensitivity_at_specificity, auprc FROM m) USING (class)"""


@query("multiclass_metrics", multiclass_sql(MACRO))
def _(spark, sf):
    wide = metrics.multiclass_metrics(multiclass(spark, sf), 3)
    return wide.select(*[r6(c).alias(c) for c in wide.columns])


@query("multiclass_by_class", multiclass_sql(BY_CLASS))
def _(spark, sf):
    wide = metrics.multiclass_by_class(multiclass(spark, sf), 3)
    whole = ("class", "support", "tp", "fp", "fn", "tn")
    return wide.select(*[c if c in whole else r6(c).alias(c) for c in wide.columns])


@query(
    "softmax_pair",
    f"SELECT survey_response_id, {q6('exp(prob_class_0) / (exp(prob_class_0) + exp(prob_class_1))')} AS p0, {q6('exp(prob_class_1) / (exp(prob_class_0) + exp(prob_class_1))')} AS p1 FROM v_predictions",
    ("v_predictions",),
)
def _(spark, sf):
    p0, p1 = softmax_pair(F.col("prob_class_0"), F.col("prob_class_1"))
    return frames.predictions(spark, sf).select("survey_response_id", r6(p0).alias("p0"), r6(p1).alias("p1"))


@query(
    "positive_prob",
    f"""SELECT event_id, CASE event_id % 3 WHEN 0 THEN {q6(f'1.0::DOUBLE / (1.0::DOUBLE + exp(-({K} - 50) / 25.0::DOUBLE))')}
  WHEN 1 THEN {q6(f'exp(({K} - 50) / 25.0::DOUBLE) / (exp(({K} - 50) / 25.0::DOUBLE) + exp(0.5::DOUBLE))')} END AS p FROM events""",
)
def _(spark, sf):
    score = (F.get_json_object("props", "$.k").cast("int") - 50) / F.lit(25.0)
    scores = (
        F.when(F.col("event_id") % 3 == 0, F.array(score))
        .when(F.col("event_id") % 3 == 1, F.array(F.lit(0.5), score))
        .otherwise(F.array(score, score, score))
    )
    return study.events(spark, sf).select("event_id", r6(positive_prob(scores)).alias("p"))


N_BOOTSTRAPS = 1000
DRAWS = f"""u AS (SELECT app_user_id, row_number() OVER (ORDER BY app_user_id) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT app_user_id FROM v_predictions)),
d AS (SELECT replicate, CAST('0x' || substr(md5('0:' || replicate || ':' || u.r), 1, 15) AS BIGINT) % u.n AS r FROM u, (SELECT CAST(unnest(range({N_BOOTSTRAPS})) AS INTEGER) AS replicate)),
weights AS (SELECT d.replicate, u.app_user_id, count(*) AS weight FROM d JOIN u USING (r) GROUP BY ALL)"""


@query("bootstrap_weights", f"WITH {DRAWS} SELECT * FROM weights", ("v_predictions",))
def _(spark, sf):
    return bootstrap.bootstrap_weights(frames.stored_predictions(spark, sf), N_BOOTSTRAPS)


WEIGHTED = "(SELECT p.*, w.replicate, w.weight FROM v_predictions p JOIN weights w USING (app_user_id))"


@query(
    "rows_by_user_resample",
    f"WITH {DRAWS} SELECT replicate, {q6('score')} AS score, CAST(pos AS BIGINT) AS pos, CAST(neg AS BIGINT) AS neg FROM ({table_sql(WEIGHTED, 'replicate', 'weight')})",
    ("v_predictions",),
)
def _(spark, sf):
    rows = frames.stored_predictions(spark, sf)
    table = bootstrap.rows_by_user_resample(rows, bootstrap.bootstrap_weights(rows, N_BOOTSTRAPS))
    return table.select("replicate", r6("score").alias("score"), F.col("pos").cast("bigint"), F.col("neg").cast("bigint"))


@query("cluster_bootstrap", f"WITH {DRAWS} SELECT * FROM ({metrics_sql(table_sql(WEIGHTED, 'replicate', 'weight'), 'replicate')})", ("v_predictions",))
def _(spark, sf):
    return rounded(bootstrap.cluster_bootstrap(frames.stored_predictions(spark, sf), N_BOOTSTRAPS), "replicate")


LEFT_OUT = "(SELECT p.*, u.r AS left_out FROM v_predictions p JOIN u ON u.app_user_id <> p.app_user_id)"


@query("jackknife", f"WITH {DRAWS} SELECT * FROM ({metrics_sql(table_sql(LEFT_OUT, 'left_out'), 'left_out')})", ("v_predictions",))
def _(spark, sf):
    return rounded(bootstrap.jackknife(frames.stored_predictions(spark, sf)), "left_out")


@query("bca_interval")
def _(spark, sf):
    return bootstrap.pooled_metrics_with_intervals(frames.stored_predictions(spark, sf), N_BOOTSTRAPS)


ROW_BOOTSTRAPS = 200


def row_bootstrap_sql() -> str:
    """The Poisson draws and metrics of every replicate, then their spread."""
    term, bound, steps = math.exp(-1.0), 0.0, []
    for k in range(20):
        bound += term
        steps.append(f"WHEN u < {bound!r}::DOUBLE THEN {k}")
        term /= k + 1
    shown = [m for m in BINARY_METRICS if m != "auprc"]
    return f"""WITH drawn AS (SELECT p.*, replicate, CAST('0x' || substr(md5('0:' || replicate || ':' || survey_response_id), 1, 15) AS BIGINT) / {float(1 << 60)!r}::DOUBLE AS u
  FROM v_predictions p, (SELECT CAST(unnest(range({ROW_BOOTSTRAPS})) AS INTEGER) AS replicate)),
w AS (SELECT * FROM (SELECT *, CASE {' '.join(steps)} ELSE 20 END AS weight FROM drawn) WHERE weight > 0),
m AS ({metrics_sql(table_sql('w', 'replicate', 'weight'), 'replicate', True)}),
long AS ({' UNION ALL '.join(f"SELECT '{m}' AS metric, {m} AS value FROM m" for m in shown)})
SELECT metric, {q6('avg(value)')} AS mean, {q6('stddev_samp(value)')} AS std, {q6('var_samp(value)')} AS var, count(value) AS n FROM long GROUP BY metric"""


@query("row_bootstrap", row_bootstrap_sql(), ("v_predictions",))
def _(spark, sf):
    rows = bootstrap.row_bootstrap(frames.stored_predictions(spark, sf), ROW_BOOTSTRAPS)
    return rows.select("metric", *[r6(c).alias(c) for c in ("mean", "std", "var")], "n")



def hash_sql(by: str, source: str, name: str = "user_hash") -> str:
    return (
        f"SELECT {by} CAST(sum(CAST('0x' || substr(md5(CAST(app_user_id AS VARCHAR)), 1, 8) AS BIGINT)) % 4294967296 AS BIGINT) AS {name}, "
        f"count(*) AS n_users FROM (SELECT DISTINCT {by} app_user_id FROM {source}) " + (f"GROUP BY {by.rstrip(', ')}" if by else "")
    )


@query("user_set_hash", hash_sql("fold_index, ", "v_predictions"), ("v_predictions",))
def _(spark, sf):
    return identity.user_set_hash(frames.predictions(spark, sf), ["fold_index"])


@query(
    "fold_identity",
    f"SELECT fold_index, c.user_hash AS cohort_hash, c.n_users AS cohort_n_users, (SELECT count(*) FROM v_master) AS cohort_n_responses, "
    f"t.user_hash AS test_user_hash, t.n_users AS test_n_users, t.n AS test_n_responses FROM ({hash_sql('', 'v_master')}) c, "
    f"(SELECT * FROM ({hash_sql('fold_index, ', 'v_predictions')}) JOIN (SELECT fold_index, count(*) AS n FROM v_predictions GROUP BY 1) USING (fold_index)) t",
    ("v_predictions", "v_master"),
)
def _(spark, sf):
    return identity.fold_identity(frames.master(spark, sf), frames.predictions(spark, sf))


@query(
    "cohort_drift_check",
    f"SELECT count(*) AS n_units, count(DISTINCT user_hash) AS n_cohorts, count(DISTINCT user_hash) > 1 AS drifted FROM ({hash_sql('survey_id, ', 'v_master')})",
    ("v_master",),
)
def _(spark, sf):
    return identity.cohort_drift_check(frames.master(spark, sf), ["survey_id"])
