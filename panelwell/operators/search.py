"""Nested hyper-parameter search: settings are chosen inside each outer fold's train rows.

Inner folds are whole participants, so no participant is on both sides of an inner split, and the outer
test rows take no part in the choice. The inner fits of a fold are independent jobs on stored rows; all
their validation scores are judged in one pass. The chosen setting is fitted anew on all train rows of its
outer fold and scores the fold's test rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwell.operators.metrics import binary_metrics, score_table
from panelwell.operators.model import boosted_trees, fit_predict_fold, linear_svm, logistic, prepared, random_forest, scored
from panelwell.operators.scaling import class_weights
from panelwell.operators.splits import union_folds
from panelwell.session import store

Setting = tuple[str, Callable[[], Pipeline]]

#: The settings tried per family, by name; of equally good ones the first is chosen.
GRIDS: Mapping[str, Sequence[Setting]] = {
    "lr_l2": [(f"strength={s}", lambda s=s: logistic("l2", s)) for s in (0.01, 0.1, 1.0)],
    "lr_l1": [(f"strength={s}", lambda s=s: logistic("l1", s)) for s in (0.001, 0.01, 0.05)],
    "rf": [(f"trees={n},depth={d}", lambda n=n, d=d: random_forest(n, d)) for n, d in ((10, 3), (10, 6))],
    "gbt": [(f"rounds={n},depth={d}", lambda n=n, d=d: boosted_trees(n, d)) for n, d in ((5, 2), (5, 4))],
    "svm": [(f"c={c}", lambda c=c: linear_svm(c)) for c in (0.1, 1.0, 10.0)],
}


def inner_fold(n_inner: int, user: str = "app_user_id", seed: int = 0) -> Column:
    """The inner fold of a participant, by a hash."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(user)), F.lit(n_inner)).cast("int")


def inner_rows(train: DataFrame, inner: int, n_inner: int) -> tuple[DataFrame, DataFrame]:
    """The rows an inner fit learns from, and those it is judged on."""
    own = inner_fold(n_inner) == inner
    return train.filter(~own), train.filter(own)


def inner_splits(df: DataFrame, folds: Sequence[int], n_inner: int = 3) -> list[tuple[int, int]]:
    """The (outer fold, inner fold) pairs with both classes on both sides, from one aggregation."""
    rows = df.filter((F.col("role") == "train") & F.col("fold_index").isin(list(folds)))
    counts = rows.groupBy("fold_index", inner_fold(n_inner).alias("inner")).agg(*[F.count_if(F.col("answer") == c).alias(f"n{c}") for c in (0, 1)]).collect()
    fine = []
    for r in counts:
        others = [o for o in counts if o["fold_index"] == r["fold_index"] and o["inner"] != r["inner"]]
        if all(r[c] and sum(o[c] for o in others) for c in ("n0", "n1")):
            fine.append((r["fold_index"], r["inner"]))
    return sorted(fine)


def balanced_weights(df: DataFrame, folds: Sequence[int]) -> dict[int, Column]:
    """The class weight of a row of each outer fold, from one aggregation; its fits need no join."""
    found = class_weights(df.filter(F.col("fold_index").isin(list(folds)))).collect()  # two rows per fold
    weights = {f: F.lit(None).cast("double") for f in folds}
    for r in found:
        weights[r["fold_index"]] = F.when(F.col("answer") == r["label"], r["weight"]).otherwise(weights[r["fold_index"]])
    return weights


def inner_scores(df: DataFrame, splits: Sequence[tuple[int, int]], grid: Sequence[Setting], n_inner: int = 3, parallel: int = 8) -> DataFrame:
    """Validation scores of the inner fits of all (outer, inner) splits: fold_index, setting, inner, app_user_id, y_true, prob_class_1."""
    folds = sorted({f for f, _ in splits})
    weights = balanced_weights(df, folds)
    rows = {f: prepared(df.filter((F.col("fold_index") == f) & (F.col("role") == "train")), weight=weights[f]) for f in folds}

    def run(job: tuple[int, str, Callable[[], Pipeline], int]) -> DataFrame:
        fold, name, make, inner = job
        learned, judged = inner_rows(rows[fold], inner, n_inner)
        fitted = make().fit(learned.select("vector", "answer", "weight"))
        return scored(fitted.transform(judged)).select(
            F.lit(fold).alias("fold_index"), F.lit(name).alias("setting"), F.lit(inner).alias("inner"), "app_user_id",
            F.col("answer").cast("int").alias("y_true"), "prob_class_1",
        )

    jobs = [(f, name, make, i) for f, i in splits for name, make in grid]
    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        return union_folds(list(pool.map(run, jobs)))


def chosen_settings(scores: DataFrame, grid: Sequence[Setting], max_group: int | None = None) -> DataFrame:
    """Per outer fold the setting of largest mean inner AUROC: fold_index, setting, inner_auroc, n_inner."""
    by = ["fold_index", "setting", "inner"]
    each = binary_metrics(store(score_table(scores, by), "inner-scores"), by, max_group=max_group).filter("auroc IS NOT NULL")
    means = each.groupBy("fold_index", "setting").agg(F.avg("auroc").alias("inner_auroc"), F.count("auroc").alias("n_inner"))
    place = F.array_position(F.array(*[F.lit(name) for name, _ in grid]), F.col("setting"))
    best = F.max_by(F.struct("setting", "inner_auroc", "n_inner"), F.struct(F.round("inner_auroc", 12), -place)).alias("b")
    return means.groupBy("fold_index").agg(best).select("fold_index", "b.*")


def nested_search(
    df: DataFrame, folds: Sequence[int], grid: Sequence[Setting], n_inner: int = 3, key: str = "survey_response_id",
    parallel: int = 8, max_group: int | None = None,
) -> DataFrame:
    """Out-of-fold predictions with the setting chosen for each fold and its inner AUROC.

    ``df`` are stored feature rows of all folds. A fold where no inner split has both classes on both sides
    falls back to the first setting, with a null inner AUROC.
    """
    if n_inner < 2:
        raise ValueError(f"n_inner must be 2 at least; got {n_inner}")
    if not grid:
        raise ValueError("the grid has no settings")
    makers = dict(grid)
    splits, chosen = inner_splits(df, folds, n_inner), {}
    if splits:  # one row per outer fold
        chosen = {r["fold_index"]: r for r in chosen_settings(inner_scores(df, splits, grid, n_inner, parallel), grid, max_group).collect()}

    def refit(fold: int) -> DataFrame:
        best = chosen.get(fold)
        name = best["setting"] if best else grid[0][0]
        scores = fit_predict_fold(df, fold, makers[name], key)
        return scores.withColumns({"setting": F.lit(name), "inner_auroc": F.lit(best["inner_auroc"] if best else None).cast("double")})

    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        return union_folds(list(pool.map(refit, folds)))
