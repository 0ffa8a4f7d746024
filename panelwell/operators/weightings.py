"""Curve metrics of many weightings of the same participants, in two passes over one score table.

A bootstrap replicate or a leave-one-out set is a weight per participant. Instead of one score
table per weighting, the rows (participant, score) are range-partitioned by score once and every
task adds up vectors with one entry per weighting, in score order. The first pass gives the sums
of each segment, from which the counts above a segment follow; the second one walks down the
curve. What is shuffled are the (participant, score) rows, whatever the number of weightings.

Limits of memory: a task holds ``CELLS`` numbers per vector table, the driver two numbers per
segment and weighting, for at most ``SEGMENTS`` segments and ``BLOCK`` weightings at a time; with several
blocks each one is written before the next.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwell.operators.metrics import BINARY_METRICS, MIN_SPECIFICITY, threshold_metrics
from panelwell.session import cut_lineage, shuffle_partitions

SEGMENTS = 512
BLOCK = 4096
CELLS = 2_000_000

SUMS = "segment int, pos binary, neg binary"
PARTS = "weighting int, wins double, area double, above double, hit_pos double, hit_neg double, pos double, neg double"


def score_segments(table: DataFrame) -> DataFrame:
    """Rows in descending order of score, cut into segments; equal scores share a segment.

    Written to the checkpoint folder, since bounds come from a sample; its partitions are the segments.
    """
    downwards = F.col("score").desc()
    segments = min(SEGMENTS, shuffle_partitions(table.sparkSession))
    ordered = table.repartitionByRange(segments, downwards).sortWithinPartitions(downwards)
    return cut_lineage(ordered.withColumn("segment", F.spark_partition_id()))


def _pieces(batches: Iterator[pa.RecordBatch], first: int, size: int, base: int, step: int):
    """(segment, scores, hits, positives, negatives, weights) of short row ranges; weights are rows × weightings."""
    height = max(1, CELLS // size)
    for batch in batches:
        for start in range(0, batch.num_rows, height):
            part = batch.slice(start, height)
            entries, n = part.column("entries"), part.num_rows
            rows = np.repeat(np.arange(n), np.diff(entries.offsets.to_numpy()))
            number = entries.flatten().to_numpy(zero_copy_only=False).astype(np.int64) - first
            mine = (number >= 0) & (number < size)
            times = np.bincount(rows[mine] * size + number[mine], minlength=n * size)
            weights = base + step * times.reshape(n, size).astype(float)
            scores, hits, pos, neg = (
                part.column(name).to_numpy(zero_copy_only=False).astype(float) for name in ("score", "hit", "pos", "neg")
            )
            yield part.column("segment")[0].as_py(), scores, hits, pos, neg, weights


def _segment_sums(first: int, size: int, base: int, step: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, sums = None, np.zeros((2, size))
        for segment, _, _, pos, neg, weights in _pieces(batches, first, size, base, step):
            sums += np.stack([pos, neg]) @ weights
        if segment is not None:
            yield pa.RecordBatch.from_pydict(
                {"segment": pa.array([segment], pa.int32()), "pos": [sums[0].tobytes()], "neg": [sums[1].tobytes()]}
            )

    return run


def _walk(first: int, size: int, base: int, step: int, carried, min_specificity: float) -> Callable:
    """Walks down a segment; the counts above it and the totals come from the broadcast ``carried``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, above = carried.value
        n_neg = totals[1]
        out = np.zeros((7, size))  # wins, area, above, hit_pos, hit_neg, pos, neg
        counts = held = None

        def settle(pos: np.ndarray, neg: np.ndarray) -> None:
            """Adds whole scores (rows) to the curve."""
            nonlocal counts
            tp, fp = counts[0] + np.cumsum(pos, axis=0), counts[1] + np.cumsum(neg, axis=0)
            out[0] += (pos * (n_neg - fp + neg / 2.0)).sum(axis=0)
            out[1] += (pos * tp / np.maximum(tp + fp, 1.0)).sum(axis=0)
            with np.errstate(divide="ignore", invalid="ignore"):
                specific = 1.0 - fp / n_neg >= min_specificity
            out[2] = np.maximum(out[2], np.where(specific, tp, 0.0).max(axis=0))
            counts = tp[-1], fp[-1]

        for segment, scores, hits, pos, neg, weights in _pieces(batches, first, size, base, step):
            if counts is None:
                counts = above[segment]
            own = np.stack([pos, neg, hits * pos, hits * neg]) @ weights
            out[3:7] += own[[2, 3, 0, 1]]
            # null scores come as NaN, behind all others
            starts = np.flatnonzero(np.concatenate([[True], ~((scores[1:] == scores[:-1]) | (np.isnan(scores[1:]) & np.isnan(scores[:-1])))]))
            p = np.add.reduceat(pos[:, None] * weights, starts, axis=0)
            n = np.add.reduceat(neg[:, None] * weights, starts, axis=0)
            if held is not None:
                if held[0] == scores[0] or (np.isnan(held[0]) and np.isnan(scores[0])):
                    p[0] += held[1]
                    n[0] += held[2]
                else:
                    settle(held[1][None], held[2][None])
            # the last score may go on in the next piece
            held = scores[-1], p[-1], n[-1]
            if len(p) > 1:
                settle(p[:-1], n[:-1])
        if held is not None:
            settle(held[1][None], held[2][None])
            names = ["wins", "area", "above", "hit_pos", "hit_neg", "pos", "neg"]
            yield pa.RecordBatch.from_pydict(
                {"weighting": pa.array(np.arange(first, first + size), pa.int32()), **dict(zip(names, out))}
            )

    return run


def weighted_metrics(
    segments: DataFrame, n_weightings: int, name: str, base: int = 0, step: int = 1, draws: DataFrame | None = None,
    min_specificity: float = MIN_SPECIFICITY,
) -> DataFrame:
    """Every metric of every weighting, one row each; null where a weighting has one class only.

    ``segments`` (see ``score_segments``) has ``score, pos, neg, entries``, or instead of the entries
    ``app_user_id``, for which ``draws`` (app_user_id, entries) are broadcast; the caller checks
    their size. Entries are numbers of weightings; the weight of a row is ``base`` plus ``step`` for
    each time the weighting is listed. A null score counts as below all others, a null label as
    negative; an empty table gives no rows.
    """
    rows = segments.join(F.broadcast(draws), "app_user_id") if draws is not None else segments
    rows = rows.select("segment", "score", F.coalesce(F.col("score") > 0.5, F.lit(False)).alias("hit"), "pos", "neg", "entries")
    context = segments.sparkSession.sparkContext
    parts = []
    for first in range(0, n_weightings, BLOCK):
        size = min(BLOCK, n_weightings - first)
        sums = {
            r["segment"]: np.stack([np.frombuffer(r["pos"]), np.frombuffer(r["neg"])])
            for r in rows.mapInArrow(_segment_sums(first, size, base, step), SUMS).collect()
        }
        running, above = np.zeros((2, size)), {}
        for segment in sorted(sums):
            above[segment] = running
            running = running + sums[segment]
        carried = context.broadcast((running, above))
        walked = rows.mapInArrow(_walk(first, size, base, step, carried, min_specificity), PARTS)
        if n_weightings > BLOCK:  # else the driver would hold the sums of all blocks at once
            walked = cut_lineage(walked)
            carried.destroy()
        parts.append(walked)
    if not parts:
        parts = [segments.sparkSession.createDataFrame([], PARTS)]
    return _finished(reduce(DataFrame.union, parts), name)


def _left_out(pos: np.ndarray, neg: np.ndarray, hit: np.ndarray, min_specificity: float) -> Callable:
    """The curve sums without each row's own counts; ``pos``, ``neg`` and ``hit`` are the whole curve from the top score down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        height = max(1, CELLS // len(pos))
        for batch in batches:
            for start in range(0, batch.num_rows, height):
                part = batch.slice(start, height)
                own, n = part.column("__own"), part.num_rows
                at = np.repeat(np.arange(n), np.diff(own.offsets.to_numpy())) * len(pos)
                counts = own.flatten()
                at = at + counts.field("place").to_numpy(zero_copy_only=False)
                p, q = (
                    whole - np.bincount(at, counts.field(name).to_numpy(zero_copy_only=False), n * len(pos)).reshape(n, -1)
                    for name, whole in (("pos", pos), ("neg", neg))
                )
                tp, fp = np.cumsum(p, axis=1), np.cumsum(q, axis=1)
                n_neg = fp[:, -1:]
                with np.errstate(divide="ignore", invalid="ignore"):
                    specific = 1.0 - fp / n_neg >= min_specificity
                sums = {
                    "wins": (p * (n_neg - fp + q / 2.0)).sum(axis=1),
                    "area": (p * tp / np.maximum(tp + fp, 1.0)).sum(axis=1),
                    "above": np.where(specific, tp, 0.0).max(axis=1),
                    "hit_pos": p @ hit, "hit_neg": q @ hit, "pos": tp[:, -1], "neg": fp[:, -1],
                }
                yield pa.RecordBatch.from_pydict({"weighting": part.column("weighting"), **{k: pa.array(v) for k, v in sums.items()}})

    return run


def left_out_metrics(own: DataFrame, curve: DataFrame, n_sets: int, min_specificity: float = MIN_SPECIFICITY) -> DataFrame:
    """Every metric without one of the sets 0 to ``n_sets`` - 1 at a time, from the sets' own counts (left_out, score, pos, neg) and their sum.

    ``curve`` has a row per distinct score, one at least, and goes to every task; the caller checks its size.
    """
    placed = cut_lineage(curve.withColumn("place", F.row_number().over(Window.orderBy(F.col("score").desc())) - 1))
    # null scores come last
    hit = F.coalesce(F.col("score") > 0.5, F.lit(False)).cast("double")
    whole = np.array(placed.orderBy("place").select("pos", "neg", hit).collect(), float).reshape(-1, 3)
    found = F.broadcast(placed.select(F.col("score").alias("__score"), "place"))
    sets = own.join(found, F.col("score").eqNullSafe(F.col("__score"))).groupBy("left_out").agg(
        F.collect_list(F.struct("place", "pos", "neg")).alias("__own")
    )
    # a set without rows leaves out nothing
    sets = own.sparkSession.range(n_sets).withColumnRenamed("id", "left_out").join(sets.hint("merge"), "left_out", "left")
    walked = sets.select(F.col("left_out").cast("int").alias("weighting"), "__own").mapInArrow(_left_out(*whole.T, min_specificity), PARTS)
    return _finished(walked, "left_out").withColumn("left_out", F.col("left_out").cast("bigint"))


def _finished(parts: DataFrame, name: str) -> DataFrame:
    whole = parts.groupBy("weighting").agg(
        F.max("above").alias("above"),
        *[F.sum(c).alias(c) for c in ("wins", "area", "hit_pos", "hit_neg", "pos", "neg")],
    )
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    tp, fp = F.col("hit_pos"), F.col("hit_neg")
    made = threshold_metrics(tp, fp, F.col("pos") - tp, F.col("neg") - fp) | {
        "auroc": F.col("wins") / (F.col("pos") * F.col("neg")),
        "auprc": F.col("area") / F.col("pos"),
        "sensitivity_at_specificity": F.col("above") / F.col("pos"),
    }
    return whole.filter("pos + neg > 0").select(
        F.col("weighting").alias(name),
        *[F.when(both, made[m]).alias(m) for m in BINARY_METRICS],
        F.col("pos").cast("bigint").alias("n_positive"),
        (F.col("pos") + F.col("neg")).cast("bigint").alias("n_predictions"),
    )
