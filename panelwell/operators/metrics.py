"""Evaluation metrics over predictions ``(…, app_user_id, y_true, prob_class_0, prob_class_1)``.

Everything starts from a score table: weighted positives and negatives per distinct score. It
is a partial aggregation, so ties and copies are merged before any ordering, and the running
counts over it (``score_curve``) are segment-safe. One curve serves every curve metric of every
group (folds, users or bootstrap replicates) in one further aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwell.operators.ordered import ordered_columns

BINARY_METRICS = (
    "f1", "auroc", "precision", "recall", "specificity", "sensitivity_at_specificity", "balanced_accuracy", "auprc",
)
MIN_SPECIFICITY = 0.9


def _ratio(top: Column, bottom: Column) -> Column:
    """Zero where the denominator is zero."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def average_rank(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "average_rank", max_group: int | None = None) -> DataFrame:
    """1-based rank of ``value`` in its group, equal values sharing the mean of their ranks.

    Ranks are worked out on distinct values and joined back, so neither a hot group nor a hot
    value is ordered row by row.
    """
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__c"))
    ranked = ordered_columns(counts, by, [F.col(value)], sums={"__cum": F.col("__c")}, max_group=max_group)
    rank = F.col("__cum") - (F.col("__c") - 1) / 2.0
    return df.join(ranked.select(*by, value, rank.alias(name)), [*by, value])


def score_table(
    predictions: DataFrame, by: Sequence[str] = (), score: str = "prob_class_1", label: str = "y_true", weight: str | None = None
) -> DataFrame:
    """``(by…, score, pos, neg)`` with weighted counts per distinct score."""
    w = F.col(weight) if weight else F.lit(1)
    return predictions.groupBy(*by, F.col(score).alias("score")).agg(
        F.sum(F.when(F.col(label) == 1, w).otherwise(F.lit(0))).alias("pos"),
        F.sum(F.when(F.col(label) == 1, F.lit(0)).otherwise(w)).alias("neg"),
    )


def score_curve(table: DataFrame, by: Sequence[str] = (), max_group: int | None = None) -> DataFrame:
    """Adds ``tp`` and ``fp`` (counts at or above the score) and the totals ``n_pos``, ``n_neg``."""
    return ordered_columns(
        table, by, [F.col("score").desc()],
        sums={"tp": F.col("pos"), "fp": F.col("neg")},
        totals={"n_pos": F.col("pos"), "n_neg": F.col("neg")},
        max_group=max_group,
    )


def curve_cumsums(predictions: DataFrame, by: Sequence[str] = (), max_group: int | None = None, **columns: str) -> DataFrame:
    return score_curve(score_table(predictions, by, **columns), by, max_group)


def curve_aggregates(min_specificity: float = MIN_SPECIFICITY) -> dict[str, Column]:
    """The three curve metrics as aggregates over a score curve."""
    positives, negatives = F.max("n_pos"), F.max("n_neg")
    wins = F.sum(F.col("pos") * (F.col("n_neg") - F.col("fp") + F.col("neg") / 2.0))
    precision = F.col("tp") / F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") + F.col("fp"))
    average_precision = F.sum(F.when(F.col("pos") > 0, F.col("pos") * precision))
    specific = F.lit(1.0) - F.col("fp") / F.col("n_neg") >= F.lit(min_specificity)
    sensitive = F.max(F.when((F.col("n_neg") > 0) & specific, F.col("tp") / F.col("n_pos")))
    both = (positives > 0) & (negatives > 0)
    return {
        "auroc": F.when(both, wins / (positives * negatives)),
        "auprc": F.when(both, average_precision / positives),
        "sensitivity_at_specificity": F.when(both, F.coalesce(sensitive, F.lit(0.0))),
    }


def count_aggregates(threshold: float = 0.5) -> dict[str, Column]:
    """Confusion counts over a score table; positive iff the score is above the threshold."""
    hit = F.col("score") > threshold
    return {
        "tp": F.sum(F.when(hit, F.col("pos")).otherwise(F.lit(0))),
        "fp": F.sum(F.when(hit, F.col("neg")).otherwise(F.lit(0))),
        "fn": F.sum(F.when(hit, F.lit(0)).otherwise(F.col("pos"))),
        "tn": F.sum(F.when(hit, F.lit(0)).otherwise(F.col("neg"))),
    }


def threshold_metrics(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Metrics of the counts at 0.5, where argmax and threshold agree (a tie goes to class 0)."""
    recall, specificity = _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    f1_pos, f1_neg = _ratio(2 * tp, 2 * tp + fp + fn), _ratio(2 * tn, 2 * tn + fp + fn)
    return {
        "precision": _ratio(tp, tp + fp),
        "recall": recall,
        "specificity": specificity,
        "balanced_accuracy": (recall + specificity) / 2.0,
        "f1": (f1_pos + f1_neg) / 2.0,
    }


def binary_metrics(
    table: DataFrame, by: Sequence[str] = (), min_specificity: float = MIN_SPECIFICITY, max_group: int | None = None
) -> DataFrame:
    """All metrics per group from a score table, one row each; null where only one class occurs."""
    curve = score_curve(table, by, max_group)
    counts = {k: c for k, c in count_aggregates().items()}
    counts = {f"__{k}": c for k, c in counts.items()}
    whole = curve.groupBy(*by).agg(
        *[c.alias(k) for k, c in curve_aggregates(min_specificity).items()],
        *[c.alias(k) for k, c in counts.items()],
        F.sum("pos").alias("n_positive"),
        F.sum(F.col("pos") + F.col("neg")).alias("n_predictions"),
    )
    made = threshold_metrics(*[F.col(f"__{k}") for k in ("tp", "fp", "fn", "tn")])
    both = (F.col("n_positive") > 0) & (F.col("n_positive") < F.col("n_predictions"))
    rows = whole.withColumns({k: F.when(both, c) for k, c in made.items()})
    return rows.select(*by, *BINARY_METRICS, "n_positive", "n_predictions")


def melt_metrics(wide: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return wide.select(*by, F.explode(pairs).alias("__m")).select(*by, "__m.*")


def pooled_metrics(predictions: DataFrame, min_specificity: float = MIN_SPECIFICITY, max_group: int | None = None) -> DataFrame:
    """Long ``(metric, value)`` over all folds pooled; no rows if a class is missing or input is empty."""
    # users and scores are both read off one reduced table
    per_user = score_table(predictions, ["app_user_id"])
    users = per_user.select("app_user_id").distinct().agg(F.count(F.lit(1)).alias("n_users"))
    table = per_user.groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    wide = binary_metrics(table, (), min_specificity, max_group).withColumn("n_users", users.scalar())
    both = (F.col("n_positive") > 0) & (F.col("n_positive") < F.col("n_predictions"))
    return melt_metrics(wide.filter(both), (), [*BINARY_METRICS, "n_predictions", "n_users", "n_positive"])


def fold_breakdown(predictions: DataFrame, by: Sequence[str] = ("fold_index",), max_group: int | None = None) -> DataFrame:
    """Rows, users, positives and AUROC per fold (null with one class)."""
    curve = score_curve(score_table(predictions, by), by, max_group)
    auroc = curve.groupBy(*by).agg(
        curve_aggregates()["auroc"].alias("auroc"),
        F.sum("pos").alias("n_positive"), F.sum(F.col("pos") + F.col("neg")).alias("n_predictions"),
    )
    users = predictions.select(*by, "app_user_id").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n_users"))
    return auroc.join(users, list(by)).select(*by, "n_predictions", "n_users", "n_positive", "auroc")


def fold_metrics(predictions: DataFrame, by: Sequence[str] = ("fold_index",), max_group: int | None = None) -> DataFrame:
    """Long metrics per fold."""
    return melt_metrics(binary_metrics(score_table(predictions, by), by, max_group=max_group), by, BINARY_METRICS)


def fold_mean_metrics(long_metrics: DataFrame) -> DataFrame:
    """Per metric the mean over folds; folds without a value do not count."""
    return long_metrics.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("value").alias("n_folds")
    )


def within_person_auroc(predictions: DataFrame, min_samples: int = 4, max_group: int | None = None) -> DataFrame:
    """Mean AUROC within participants that have enough rows and both classes, and their number."""
    per_user = score_curve(score_table(predictions, ["app_user_id"]), ["app_user_id"], max_group).groupBy("app_user_id").agg(
        curve_aggregates()["auroc"].alias("auroc"), F.sum(F.col("pos") + F.col("neg")).alias("n")
    )
    eligible = per_user.filter((F.col("n") >= min_samples) & F.col("auroc").isNotNull())
    return eligible.agg(
        F.avg("auroc").alias("within_person_auroc"), F.count(F.lit(1)).alias("n_users")
    )


def confusion_matrix(predictions: DataFrame, classes: Sequence[int] = (0, 1), label: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """Count of every (actual, predicted) pair, zeros included."""
    cells = [
        F.count_if((F.col(label) == a) & (F.col(predicted) == p)).alias(f"c{a}_{p}") for a in classes for p in classes
    ]
    wide = predictions.agg(*cells)
    rows = F.array(*[
        F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(f"c{a}_{p}").alias("n"))
        for a in classes for p in classes
    ])
    return wide.select(F.explode(rows).alias("__c")).select("__c.*")


def classification_report(predictions: DataFrame, classes: Sequence[int] = (0, 1), label: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """Precision, recall, F1 and support per class; a zero denominator gives 0."""
    matrix = confusion_matrix(predictions, classes, label, predicted)
    sides = F.array(
        F.struct(F.col("actual").alias("class"), F.lit(True).alias("is_actual")),
        F.struct(F.col("predicted").alias("class"), F.lit(False).alias("is_actual")),
    )
    hit = F.when(F.col("is_actual") & (F.col("actual") == F.col("predicted")), F.col("n")).otherwise(0)
    per_class = matrix.withColumn("__s", F.explode(sides)).select("*", "__s.*").groupBy("class").agg(
        F.sum(hit).alias("tp"),
        F.sum(F.when(F.col("is_actual"), F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(~F.col("is_actual"), F.col("n")).otherwise(0)).alias("called"),
    )
    tp, support, called = F.col("tp"), F.col("support"), F.col("called")
    return per_class.select(
        "class", _ratio(tp, called).alias("precision"), _ratio(tp, support).alias("recall"),
        _ratio(2 * tp, support + called).alias("f1"), "support",
    )


def with_predicted_class(predictions: DataFrame, n_classes: int = 2) -> DataFrame:
    """Adds ``y_pred``: the class of highest probability, the first of equals."""
    probs = F.array(*[F.col(f"prob_class_{k}") for k in range(n_classes)])
    return predictions.withColumn("y_pred", (F.array_position(probs, F.array_max(probs)) - 1).cast("int"))


def multiclass_by_class(
    predictions: DataFrame, n_classes: int, min_specificity: float = MIN_SPECIFICITY, label: str = "y_true",
    max_group: int | None = None,
) -> DataFrame:
    """One-vs-rest metrics, one row per class with its counts ``tp, fp, fn, tn``.

    Every row is exploded to one row per class, then all classes go through the same curve. Curve
    metrics are null for a class that has no positives or no negatives; ratios without a denominator are 0.
    """
    called = with_predicted_class(predictions, n_classes)
    per_class = F.array(*[
        F.struct(
            F.lit(k).alias("class"), F.col(f"prob_class_{k}").alias("p"),
            (F.col(label) == k).cast("int").alias("y"), (F.col("y_pred") == k).alias("hit"),
        )
        for k in range(n_classes)
    ])
    rows = called.select(F.explode(per_class).alias("__c")).select("__c.*")
    # (score, hit) is one cell of the table, so that counts and curve come from one aggregation
    table = rows.groupBy("class", F.col("p").alias("score")).agg(
        F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"),
        F.sum(F.when(F.col("hit"), F.col("y")).otherwise(0)).alias("hit_pos"),
        F.sum(F.when(F.col("hit"), 1 - F.col("y")).otherwise(0)).alias("hit_neg"),
    )
    curve = score_curve(table, ["class"], max_group)
    stats = curve.groupBy("class").agg(
        *[c.alias(k) for k, c in curve_aggregates(min_specificity).items()],
        F.sum("hit_pos").alias("tp"), F.sum("hit_neg").alias("fp"),
        F.sum(F.col("pos") - F.col("hit_pos")).alias("fn"), F.sum(F.col("neg") - F.col("hit_neg")).alias("tn"),
    )
    made = threshold_metrics(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    return stats.select(
        "class", _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"), "auroc",
        *[made[m].alias(m) for m in ("precision", "recall", "specificity")], "sensitivity_at_specificity", "auprc",
        (F.col("tp") + F.col("fn")).alias("support"), "tp", "fp", "fn", "tn",
    )


def multiclass_metrics(
    predictions: DataFrame, n_classes: int, min_specificity: float = MIN_SPECIFICITY, label: str = "y_true",
    max_group: int | None = None,
) -> DataFrame:
    """Macro one-vs-rest metrics. A class that is neither present nor predicted stays out of F1,
    precision and recall means."""
    rows = multiclass_by_class(predictions, n_classes, min_specificity, label, max_group)
    seen = F.col("tp") + F.col("fp") + F.col("fn") > 0
    return rows.agg(
        F.avg(F.when(seen, F.col("f1"))).alias("f1"),
        F.avg("auroc").alias("auroc"),
        F.avg(F.when(seen, F.col("precision"))).alias("precision"),
        F.avg(F.when(seen, F.col("recall"))).alias("recall"),
        F.avg("specificity").alias("specificity"),
        F.avg("sensitivity_at_specificity").alias("sensitivity_at_specificity"),
        F.avg(F.when(seen, F.col("recall"))).alias("balanced_accuracy"),
    )


def tune_threshold(predictions: DataFrame, by: Sequence[str] = (), max_group: int | None = None) -> DataFrame:
    """Threshold with the best balanced accuracy among 0, the midpoints of neighbouring scores
    and 1 (positive iff p ≥ threshold); the smallest of equals. Null with a single class.

    Per distinct score s the candidate just below it is its midpoint with the next lower score,
    or 0 for the lowest; it calls exactly the rows at or above s. The candidate 1 calls rows of
    score 1 only. A single distinct score has the one candidate 0.5.
    """
    table = score_table(predictions, by)
    rising = ordered_columns(table, by, [F.col("score")], lags={"__below": F.col("score")}, position="__pos", group_size="__n", max_group=max_group)
    curve = score_curve(rising, by, max_group)
    single = F.col("__n") == 1
    below = F.when(F.col("__below").isNull(), F.lit(0.0)).otherwise((F.col("__below") + F.col("score")) / 2.0)

    def balanced(tp: Column, fp: Column) -> Column:
        return (tp / F.col("n_pos") + (F.col("n_neg") - fp) / F.col("n_neg")) / 2.0

    at_one = F.col("score") >= 1.0
    one_half = F.col("score") >= 0.5
    zero = F.lit(0)
    top = F.col("__pos") == F.col("__n") - 1
    candidates = F.when(
        single,
        F.array(F.struct(F.lit(0.5).alias("threshold"), balanced(F.when(one_half, F.col("tp")).otherwise(zero), F.when(one_half, F.col("fp")).otherwise(zero)).alias("ba"))),
    ).otherwise(
        F.concat(
            F.array(F.struct(below.alias("threshold"), balanced(F.col("tp"), F.col("fp")).alias("ba"))),
            F.when(
                top,
                F.array(F.struct(F.lit(1.0).alias("threshold"), balanced(F.when(at_one, F.col("tp")).otherwise(zero), F.when(at_one, F.col("fp")).otherwise(zero)).alias("ba"))),
            ).otherwise(F.array().cast("array<struct<threshold:double,ba:double>>")),
        )
    )
    rows = curve.filter((F.col("n_pos") > 0) & (F.col("n_neg") > 0)).select(*by, F.explode(candidates).alias("__c")).select(*by, "__c.*")
    best = rows.groupBy(*by).agg(F.max(F.struct(F.col("ba"), -F.col("threshold"))).alias("__b"))
    return best.select(*by, (-F.col("__b")["col2"]).alias("threshold"), F.col("__b")["ba"].alias("balanced_accuracy"))


def apply_threshold(predictions: DataFrame, tuned: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``y_pred`` at the tuned threshold, one per group."""
    if by:
        joined = predictions.join(tuned.select(*by, "threshold"), list(by))
        return joined.withColumn("y_pred", (F.col("prob_class_1") >= F.col("threshold")).cast("int"))
    threshold = tuned.select("threshold").scalar()
    return predictions.withColumn("threshold", threshold).withColumn(
        "y_pred", (F.col("prob_class_1") >= F.col("threshold")).cast("int")
    )


def degenerate_guard(metrics: DataFrame, metric_columns: Sequence[str], n_classes: str = "n_classes") -> DataFrame:
    """Metrics of a group with fewer than two classes become null."""
    return metrics.withColumns({m: F.when(F.col(n_classes) >= 2, F.col(m)) for m in metric_columns})


def best_so_far(
    metrics: DataFrame, by: Sequence[str], step: str = "step", value: str = "value", max_group: int | None = None
) -> DataFrame:
    """Running maximum over steps; null and NaN values do not count."""
    clean = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    return ordered_columns(metrics, by, [F.col(step)], maxima={"best": clean}, max_group=max_group)
