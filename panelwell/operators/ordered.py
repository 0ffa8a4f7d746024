"""Ordered-sequence primitives that hold when one group has a third of all rows.

A window function puts a whole group into one task. Here the group sizes are counted first
(one partial aggregation over the key column). If every group fits a task, the plain window
is used: one shuffle. Otherwise the rows are range-partitioned over (group, order), which
cuts a hot group into many segments; the window runs per (group, segment), and the few
per-segment totals are accumulated and joined back. Both ways give the same result.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwell.session import cut_lineage, group_rows

SEGMENT = "__segment"


def largest_group(df: DataFrame, group: Sequence[str]) -> tuple[int, int]:
    """(rows of the largest group, rows in all), from one partial aggregation."""
    sizes = df.groupBy(*[F.col(g) for g in group]).agg(F.count(F.lit(1)).alias("rows"))
    row = sizes.agg(F.max("rows").alias("top"), F.sum("rows").alias("total")).first()
    return int(row["top"] or 0), int(row["total"] or 0)


def range_segments(df: DataFrame, group: Sequence[str], order: Sequence[Column], segments: int) -> DataFrame:
    """Adds a segment number: segments follow (group, order) and are of near equal size.

    The result is written to the checkpoint folder, because range bounds come from a sample
    and every later use has to see the same bounds.
    """
    placed = df.repartitionByRange(segments, *[F.col(g) for g in group], *order)
    return cut_lineage(placed.withColumn(SEGMENT, F.spark_partition_id()))


def ordered_columns(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    position: str | None = None,
    group_size: str | None = None,
    sums: Mapping[str, Column] | None = None,
    totals: Mapping[str, Column] | None = None,
    lags: Mapping[str, Column] | None = None,
    maxima: Mapping[str, Column] | None = None,
    max_group: int | None = None,
) -> DataFrame:
    """Adds ordered columns per group.

    ``position`` 0-based row number, ``group_size`` rows of the group, ``sums`` running sums
    including the current row, ``totals`` sums over the whole group, ``lags`` the previous
    row's value, ``maxima`` running maxima including the current row. ``order`` must end in a
    unique column (except for running sums over rows that are unique by ``order`` already).
    ``max_group`` states a proven bound on the group size, for example the rows per user of a
    base table; if it fits a task, nothing is counted. A bound that does not fit may still be far
    above the real groups: the rows are written once, then counted and ordered from there.
    """
    sums, totals, lags, maxima = dict(sums or {}), dict(totals or {}), dict(lags or {}), dict(maxima or {})
    spark = df.sparkSession
    limit = group_rows(spark)
    if max_group is not None and max_group <= limit:
        return _plain(df, group, order, position, group_size, sums, totals, lags, maxima)
    if max_group is not None:
        df = cut_lineage(df)
    largest, total = largest_group(df, group)
    if largest <= limit:
        return _plain(df, group, order, position, group_size, sums, totals, lags, maxima)
    segments = max(2, math.ceil(2 * total / max(limit, 1)))
    return _segmented(df, group, order, position, group_size, sums, totals, lags, maxima, segments)


def _keys(group: Sequence[str]) -> list[Column]:
    return [F.col(g) for g in group] or [F.lit(0)]


def _plain(df, group, order, position, group_size, sums, totals, lags, maxima) -> DataFrame:
    whole = Window.partitionBy(*_keys(group))
    ordered = whole.orderBy(*order)
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new: dict[str, Column] = {}
    if position:
        new[position] = (F.row_number().over(ordered) - 1).cast("bigint")
    if group_size:
        new[group_size] = F.count(F.lit(1)).over(whole)
    new |= {k: F.sum(c).over(running) for k, c in sums.items()}
    new |= {k: F.sum(c).over(whole) for k, c in totals.items()}
    new |= {k: F.lag(c).over(ordered) for k, c in lags.items()}
    new |= {k: F.max(c).over(running) for k, c in maxima.items()}
    return df.withColumns(new)


def _segmented(df, group, order, position, group_size, sums, totals, lags, maxima, segments) -> DataFrame:
    rows = range_segments(df, group, order, segments)
    part = Window.partitionBy(*[F.col(g) for g in group], SEGMENT)
    ordered = part.orderBy(*order)
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local: dict[str, Column] = {"__rn": F.row_number().over(ordered)}
    local |= {f"__sum_{k}": F.sum(c).over(running) for k, c in sums.items()}
    local |= {f"__max_{k}": F.max(c).over(running) for k, c in maxima.items()}
    local |= {f"__in_{k}": c for k, c in [*totals.items(), *lags.items()]}
    local |= {f"__lag_{k}": F.lag(c).over(ordered) for k, c in lags.items()}
    rows = rows.withColumns(local)

    # one row per (group, segment): a hot group has at most as many as there are segments
    ends = [F.count(F.lit(1)).alias("__n")]
    ends += [F.max_by(f"__sum_{k}", "__rn").alias(f"__end_{k}") for k in sums]
    ends += [F.max(f"__max_{k}").alias(f"__top_{k}") for k in maxima]
    ends += [F.sum(f"__in_{k}").alias(f"__tot_{k}") for k in totals]
    ends += [F.max_by(f"__in_{k}", "__rn").alias(f"__last_{k}") for k in lags]
    per_segment = rows.groupBy(*[F.col(g) for g in group], SEGMENT).agg(*ends)
    whole = Window.partitionBy(*_keys(group))
    seq = whole.orderBy(SEGMENT)
    before = seq.rowsBetween(Window.unboundedPreceding, -1)
    carry: dict[str, Column] = {
        "__before": F.coalesce(F.sum("__n").over(before), F.lit(0)),
        "__all": F.sum("__n").over(whole),
    }
    carry |= {f"__off_{k}": F.sum(f"__end_{k}").over(before) for k in sums}
    carry |= {f"__offmax_{k}": F.max(f"__top_{k}").over(before) for k in maxima}
    carry |= {f"__whole_{k}": F.sum(f"__tot_{k}").over(whole) for k in totals}
    carry |= {f"__prev_{k}": F.lag(f"__last_{k}").over(seq) for k in lags}
    offsets = per_segment.withColumns(carry).select(
        *[F.col(g).alias(f"__g_{g}") for g in group], F.col(SEGMENT).alias("__g_segment"), *carry
    )
    match = F.col(SEGMENT) == F.col("__g_segment")
    for g in group:
        match = match & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    joined = rows.join(offsets, match, "inner")

    new: dict[str, Column] = {}
    if position:
        new[position] = (F.col("__rn") - 1 + F.col("__before")).cast("bigint")
    if group_size:
        new[group_size] = F.col("__all")
    for k in sums:
        own, off = F.col(f"__sum_{k}"), F.col(f"__off_{k}")
        new[k] = F.when(own.isNull(), off).otherwise(own + F.coalesce(off, F.lit(0)))
    new |= {k: F.greatest(f"__max_{k}", f"__offmax_{k}") for k in maxima}
    new |= {k: F.col(f"__whole_{k}") for k in totals}
    new |= {k: F.when(F.col("__rn") == 1, F.col(f"__prev_{k}")).otherwise(F.col(f"__lag_{k}")) for k in lags}
    keep = [c for c in df.columns if c not in new]
    return joined.select(*keep, *[v.alias(k) for k, v in new.items()])


def row_rank_first(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Keeps, per key, the row that comes first by ``order``.

    Written as an aggregation (``min_by`` over the row struct), so that copies are reduced
    before the shuffle: a key with a third of all rows costs one row per input task.
    """
    others = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*[F.col(k) for k in keys]).agg(
        F.min_by(F.struct(*[F.col(c) for c in others]), order).alias("__row")
    )
    return packed.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns])
