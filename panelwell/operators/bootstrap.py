"""Resampling: participant-cluster bootstrap with BCa intervals, and the row bootstrap.

Draws are weights, never copied rows: a replicate is ``(replicate, app_user_id, weight)``, and
all metrics of all replicates come from one walk down the score table (``weightings``). Draws are hashes of (seed,
replicate, slot), so they do not depend on partitioning and SQL can repeat them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwell.operators.metrics import BINARY_METRICS, MIN_SPECIFICITY, binary_metrics, melt_metrics, score_table
from panelwell.operators.ordered import largest_group, ordered_columns
from panelwell.operators.weightings import CELLS, left_out_metrics, score_segments, weighted_metrics
from panelwell.session import broadcast_rows, cut_lineage, group_rows, shuffle_partitions

#: Draws of a bootstrap up to this size are broadcast.
DRAW_BYTES = 64 << 20


def hash_number(*parts: Column | int | str) -> Column:
    """60-bit number from the MD5 of the parts joined by colons."""
    texts = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *texts)), 1, 15), 16, 10).cast("bigint")


def ranked_users(predictions: DataFrame) -> DataFrame:
    """Users with ``user_rank`` 0..U-1 in id order and ``n_users`` = U."""
    users = predictions.select("app_user_id").distinct()
    return ordered_columns(users, [], [F.col("app_user_id")], position="user_rank", group_size="n_users")


def _drawn(users: DataFrame, n_bootstraps: int, seed: int) -> DataFrame:
    """``(replicate, user_rank)`` per draw. Each user becomes a thousand hashes, so the few users are spread over all tasks first."""
    slots = users.repartition(shuffle_partitions(users.sparkSession), "user_rank").select(
        F.col("user_rank").alias("slot"), "n_users",
        F.explode(F.sequence(F.lit(0), F.lit(n_bootstraps - 1))).alias("replicate"),
    )
    return slots.select(
        "replicate", (hash_number(seed, F.col("replicate"), F.col("slot")) % F.col("n_users")).alias("user_rank")
    )


def bootstrap_weights(predictions: DataFrame, n_bootstraps: int = 1000, seed: int = 0) -> DataFrame:
    """``(replicate, app_user_id, weight)``: every replicate draws U users with replacement."""
    users = ranked_users(predictions)
    counts = _drawn(users, n_bootstraps, seed).groupBy("replicate", "user_rank").agg(F.count(F.lit(1)).alias("weight"))
    # Spark takes exploded draws for as few as the users they come from and would broadcast them
    named = users.select("user_rank", "app_user_id").hint("shuffle_hash")
    return counts.join(named, "user_rank").select("replicate", "app_user_id", "weight")


def _resampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per score the sums of all replicates, as vectors, from one row per user with its draws and its scores."""
    for batch in batches:
        if not batch.num_rows:
            continue
        numbers = np.unique(batch.column("__draws").flatten().field("replicate").to_numpy(zero_copy_only=False))
        height = max(1, CELLS // max(1, len(numbers)))
        for start in range(0, batch.num_rows, height):
            part = batch.slice(start, height)
            draws, own = part.column("__draws"), part.column("__own")
            drawn, scored = draws.flatten(), own.flatten()
            weights = np.zeros((part.num_rows, len(numbers)), np.int64)
            place = np.searchsorted(numbers, drawn.field("replicate").to_numpy(zero_copy_only=False))
            np.add.at(weights, (np.repeat(np.arange(part.num_rows), np.diff(draws.offsets.to_numpy())), place), drawn.field("weight").to_numpy(zero_copy_only=False))
            user = np.repeat(np.arange(part.num_rows), np.diff(own.offsets.to_numpy()))
            pos, neg = (scored.field(name).to_numpy(zero_copy_only=False) for name in ("pos", "neg"))
            coded = scored.field("score").dictionary_encode("encode")
            codes = coded.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            for at in range(0, len(order), height):
                rows = order[at:at + height]
                starts = np.flatnonzero(np.r_[True, codes[rows][1:] != codes[rows][:-1]])
                times = weights[user[rows]]
                sums = [np.add.reduceat(c[rows][:, None] * times, starts, axis=0) for c in (pos, neg)]
                kept = np.add.reduceat(times, starts, axis=0) > 0
                offsets = pa.array(np.r_[0, np.cumsum(kept.sum(axis=1))], pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (np.broadcast_to(numbers, kept.shape)[kept], sums[0][kept], sums[1][kept])]
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(codes[rows][starts])), *lists], names=["score", "replicate", "pos", "neg"])


def rows_by_user_resample(predictions: DataFrame, weights: DataFrame, max_weights: int | None = None) -> DataFrame:
    """Weighted score table per replicate: ``(replicate, score, pos, neg)``.

    Rows are reduced to (user, score) first. Each user's draws and scores travel as one array each, a hot
    user's scores in as many as its size needs. Tasks add up vectors with an entry per replicate
    for each score, so users and draws are never multiplied into rows. Only draws with a given bound on
    their rows are broadcast.
    """
    scores = score_table(predictions, ["app_user_id"])
    draws = weights.groupBy("app_user_id").agg(F.collect_list(F.struct("replicate", "weight")).alias("__draws"))
    spark = predictions.sparkSession
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((scores, "score"), (weights, "replicate"))}
    own = F.collect_list(F.struct("score", "pos", "neg")).alias("__own")
    if max_weights is not None and max_weights <= broadcast_rows(spark):
        joined = scores.groupBy("app_user_id").agg(own).join(F.broadcast(draws), "app_user_id")
    else:
        top, _ = largest_group(scores, ["app_user_id"])
        salts = max(1, math.ceil(top / group_rows(spark)))
        salted = scores.withColumn("__salt", F.pmod(F.xxhash64("score"), F.lit(salts)).cast("int"))
        copies = draws.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = salted.groupBy("app_user_id", "__salt").agg(own).join(copies.hint("merge"), ["app_user_id", "__salt"])
    vectors = joined.select("__draws", "__own").mapInArrow(
        _resampled, f"score {kinds['score']}, replicate array<{kinds['replicate']}>, pos array<bigint>, neg array<bigint>"
    )
    return (
        vectors.select("score", F.explode(F.arrays_zip("replicate", "pos", "neg")).alias("__d"))
        .groupBy(F.col("__d.replicate").alias("replicate"), "score")
        .agg(F.sum("__d.pos").alias("pos"), F.sum("__d.neg").alias("neg"))
    )


def _n_scores(predictions: DataFrame) -> int:
    return predictions.select("prob_class_1").distinct().count()


def cluster_bootstrap(
    predictions: DataFrame, n_bootstraps: int = 1000, seed: int = 0, min_specificity: float = MIN_SPECIFICITY
) -> DataFrame:
    """Every metric of every replicate, one row per replicate; null where a draw has one class.

    The draws of all participants are broadcast while their proven size (one number per draw) is within
    ``DRAW_BYTES``; then the draws and the (participant, score) rows are all that is shuffled. Larger cohorts join their draws by participant.
    """
    users = ranked_users(predictions)
    n_users = users.count()
    if 8 * n_users * n_bootstraps > DRAW_BYTES:
        table = rows_by_user_resample(predictions, bootstrap_weights(predictions, n_bootstraps, seed), n_users * n_bootstraps)
        # a replicate has no more distinct scores than the predictions have
        return binary_metrics(table, ["replicate"], min_specificity, max_group=_n_scores(predictions))
    picked = _drawn(users, n_bootstraps, seed).groupBy("user_rank").agg(F.collect_list("replicate").alias("entries"))
    # both passes read them
    draws = cut_lineage(users.select("user_rank", "app_user_id").join(picked, "user_rank").select("app_user_id", "entries"))
    segments = score_segments(score_table(predictions, ["app_user_id"]))
    return weighted_metrics(segments, n_bootstraps, "replicate", draws=draws, min_specificity=min_specificity)


def jackknife(predictions: DataFrame, groups: int | None = None, min_specificity: float = MIN_SPECIFICITY) -> DataFrame:
    """Every metric with one participant left out, one row per left-out participant.

    A curve of at most ``broadcastRows`` distinct scores is sent to the tasks, where each set takes its own
    counts off it. With more scores a left-out set is a weighting: zero for its participant, one for all
    others, and each set adds up the whole curve inside the tasks. No rows of sets and scores are made. For
    cohorts where that takes too long, ``groups`` leaves out one group of participants at a time, the
    usual form for large samples.
    """
    users = ranked_users(predictions)
    n_users = users.count()
    n_sets = n_users if groups is None else min(groups, n_users)
    placed = predictions.join(
        users.select("app_user_id", (F.col("user_rank") % max(n_sets, 1)).alias("left_out")), "app_user_id"
    )
    own = cut_lineage(score_table(placed, ["left_out"]))
    curve = own.groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    if 0 < curve.count() <= broadcast_rows(predictions.sparkSession):
        return left_out_metrics(own, curve, n_sets, min_specificity)
    own = own.withColumn("entries", F.array(F.col("left_out").cast("int")))
    sets = weighted_metrics(score_segments(own), n_sets, "left_out", base=1, step=-1, min_specificity=min_specificity)
    return sets.withColumn("left_out", F.col("left_out").cast("bigint"))


def bca_interval(
    point: DataFrame,
    replicates: DataFrame,
    left_out: DataFrame,
    metrics: Sequence[str] = BINARY_METRICS,
    confidence: float = 0.95,
) -> DataFrame:
    """``(metric, value, ci_low, ci_high)`` by the bias-corrected and accelerated bootstrap.

    The bias correction is the share of replicates below the estimate, the acceleration comes
    from the left-out estimates. Spark reduces both to a few numbers per metric; the normal
    quantiles are taken in the driver. Bounds are null if any piece is undefined, for example
    if a replicate or a left-out set has one class only.
    """
    values = point.select(*[F.col(m).cast("double").alias(m) for m in metrics]).first()
    estimate = {m: (values[m] if values else None) for m in metrics}
    boot = replicates.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(m).alias(f"k_{m}") for m in metrics],
        *[F.count_if(F.col(m) < F.lit(estimate[m])).alias(f"lt_{m}") for m in metrics],
        *[F.count_if(F.col(m) == F.lit(estimate[m])).alias(f"eq_{m}") for m in metrics],
    ).first()
    means = left_out.agg(F.count(F.lit(1)).alias("n"), *[F.count(m).alias(f"k_{m}") for m in metrics], *[F.avg(m).alias(f"m_{m}") for m in metrics]).first()
    deviations = {m: F.lit(means[f"m_{m}"]) - F.col(m) for m in metrics}
    powers = left_out.agg(
        *[F.sum(d * d).alias(f"s2_{m}") for m, d in deviations.items()],
        *[F.sum(d * d * d).alias(f"s3_{m}") for m, d in deviations.items()],
    ).first()
    levels = {
        m: _bca_levels(
            boot["n"] if boot[f"k_{m}"] == boot["n"] else 0, boot[f"lt_{m}"], boot[f"eq_{m}"],
            powers[f"s2_{m}"] if means[f"k_{m}"] == means["n"] else None, powers[f"s3_{m}"], confidence,
        )
        for m in metrics
    }
    rows = []
    for m in metrics:
        low, high = levels[m] if levels[m] and estimate[m] is not None else (None, None)
        bounds = [
            F.percentile(m, F.lit(q)) if q is not None else F.lit(None).cast("double") for q in (low, high)
        ]
        rows.append(F.struct(
            F.lit(m).alias("metric"), F.lit(estimate[m]).cast("double").alias("value"),
            bounds[0].alias("ci_low"), bounds[1].alias("ci_high"),
        ))
    packed = replicates.agg(F.array(*rows).alias("__rows"))
    return packed.select(F.explode("__rows").alias("__r")).select("__r.*")


def _bca_levels(n, below, equal, s2, s3, confidence) -> tuple[float, float] | None:
    if not n or not s2:
        return None
    share = (below + 0.5 * equal) / n
    if not 0.0 < share < 1.0:
        return None
    normal = NormalDist()
    z0 = normal.inv_cdf(share)
    acceleration = s3 / (6.0 * s2**1.5)
    levels = []
    for q in ((1 - confidence) / 2, (1 + confidence) / 2):
        z = z0 + normal.inv_cdf(q)
        if 1 - acceleration * z == 0:
            return None
        levels.append(normal.cdf(z0 + z / (1 - acceleration * z)))
    return levels[0], levels[1]


def pooled_metrics_with_intervals(
    predictions: DataFrame, n_bootstraps: int = 1000, seed: int = 0, groups: int | None = None
) -> DataFrame:
    """Pooled metrics, each with its participant-cluster interval."""
    point = binary_metrics(score_table(predictions))
    return bca_interval(point, cluster_bootstrap(predictions, n_bootstraps, seed), jackknife(predictions, groups))


def poisson_weight(uniform: Column) -> Column:
    """Poisson(1) count of a uniform number by inversion; the tail beyond 19 is below its resolution."""
    cumulative, term, steps = 0.0, math.exp(-1.0), []
    for k in range(20):
        cumulative += term
        steps.append((k, cumulative))
        term /= k + 1
    count: Column = F.lit(20)
    for k, bound in reversed(steps):
        count = F.when(uniform < bound, F.lit(k)).otherwise(count)
    return count


def row_bootstrap(
    predictions: DataFrame, n_bootstraps: int = 200, seed: int = 0, key: str = "survey_response_id"
) -> DataFrame:
    """Mean, sample deviation and variance of each metric over Poisson-weighted row replicates.

    The weight of a row in a replicate is a function of the row alone, so there is no join.
    """
    uniform = hash_number(seed, F.col("replicate"), F.col(key)) / F.lit(float(1 << 60))
    weighted = (
        predictions.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n_bootstraps - 1))))
        .withColumn("__w", poisson_weight(uniform))
        .filter("__w > 0")
    )
    table = score_table(weighted, ["replicate"], weight="__w")
    metrics = [m for m in BINARY_METRICS if m != "auprc"]
    long = melt_metrics(binary_metrics(table, ["replicate"], max_group=_n_scores(predictions)), ["replicate"], metrics)
    spread = F.stddev_samp("value")
    return long.groupBy("metric").agg(
        F.avg("value").alias("mean"), spread.alias("std"), (spread * spread).alias("var"), F.count("value").alias("n")
    )
