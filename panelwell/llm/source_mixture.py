"""Mixing sources to target weights: raking, then sampling with calibrated probabilities.

Documents are counted into cells (source, language, topic) first; only cells are raked. A round of
iterative proportional fitting scales the cells' token weights to the target shares of each margin
in turn. A document's probability is its cell's raked weight over the cell's tokens, scaled so that
the expected tokens meet a budget and no probability exceeds one; each document draws a hash of its id.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwell.llm.common import hash_number
from panelwell.session import broadcast_rows, cut_lineage

#: Rounds between two cuts of the plan; a plan of many more windows would be slow to compile.
ROUNDS_PER_PLAN = 4


@dataclass(frozen=True)
class Margin:
    """Target shares of a column's values: given ones, or the observed shares to the power ``temperature``.

    Values that given shares don't name get nothing. Shares of values that don't occur are spread over
    the others in proportion. Null is a value; given shares name it by the key ``None``.
    """

    column: str
    shares: Mapping[str | None, float] | None = None
    temperature: float = 1.0

    def share(self, total: Column) -> Column:
        if self.shares is None:
            return F.when(total > 0, F.pow(total, F.lit(self.temperature))).otherwise(0.0)
        column, out = F.col(self.column), F.lit(0.0)
        for value, share in self.shares.items():
            out = F.when(column.eqNullSafe(F.lit(value)), F.lit(float(share))).otherwise(out)
        return out


def raked(cells: DataFrame, margins: Sequence[Margin], rounds: int) -> DataFrame:
    """Adds ``weight`` (shares that add up to one) to cells with ``tokens``, raked for a fixed number of rounds.

    A cell without tokens keeps weight 0. Where margins contradict each other, the last one is met exactly.
    """
    spark = cells.sparkSession
    total = cells.agg(F.sum("tokens").cast("double")).first()[0] or 0.0
    table = cells.withColumn("weight", F.col("tokens") / F.lit(total or 1.0))
    goals = [f"__goal{i}" for i in range(len(margins))]
    for margin, goal in zip(margins, goals):
        shares = cut_lineage(cells.groupBy(margin.column).agg(F.sum("tokens").cast("double").alias("__n")).withColumn(goal, margin.share(F.col("__n"))))
        norm = shares.agg(F.sum(F.when(F.col("__n") > 0, F.col(goal)))).first()[0] or 1.0
        right = shares.select(F.col(margin.column).alias("__value"), (F.col(goal) / F.lit(norm)).alias(goal))
        table = table.join(right, F.col(margin.column).eqNullSafe(F.col("__value")), "left").drop("__value")
    table = cut_lineage(table)
    if table.count() <= broadcast_rows(spark):
        table = cut_lineage(table.coalesce(1))  # few cells: in one partition the windows need no exchange
    for done in range(1, rounds + 1):
        for margin, goal in zip(margins, goals):
            held = F.sum("weight").over(Window.partitionBy(margin.column))
            table = table.withColumn("weight", F.when(held > 0, F.col("weight") * F.col(goal) / held).otherwise(0.0))
        if done % ROUNDS_PER_PLAN == 0 or done == rounds:
            table = cut_lineage(table)
    return table.drop(*goals)


def calibrated(cells: DataFrame, keep: float, rounds: int) -> DataFrame:
    """Adds ``probability`` = min(1, scale * weight / tokens) with expected tokens of ``keep`` of all.

    The scale is raised round by round for what the cells that reached one can't give; it stays below
    the budget only if more rounds were needed or all cells with weight reached one.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    budget, scale = keep * total, keep * total
    ratio = F.try_divide(F.col("weight"), F.col("tokens"))
    for _ in range(rounds):
        full = (ratio * F.lit(scale) >= 1) & (F.col("tokens") > 0)
        row = cells.agg(F.sum(F.when(full, F.col("tokens"))).cast("double"), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        given, left = row[0] or 0.0, row[1] or 0.0
        if left <= 1e-12 or given >= budget:
            break
        scale = (budget - given) / left
    return cells.withColumn("probability", F.when(F.col("tokens") > 0, F.least(F.lit(1.0), ratio * F.lit(scale))).otherwise(0.0))


def mixture(docs: DataFrame, tokens: Column, topic: Column, margins: Sequence[Margin], keep: float = 0.5, rounds: int = 12,
            scale_rounds: int = 8, seed: str = "mixture") -> DataFrame:
    """The documents with ``mix_topic``, ``mix_tokens``, ``mix_probability`` and ``mix_sampled``.

    ``margins`` may name ``source``, ``lang`` and ``mix_topic``; ``tokens`` and ``topic`` are columns
    over ``docs``, null tokens count 0. All other columns stay; columns with these four names are
    replaced. A null source, language or topic is a value of its own. Documents without tokens get
    probability 0. Rows with equal ids (null is one id) draw the same number, so repeated rows stay or
    go together. An empty table gives an empty one.

    Documents are never shuffled to be counted (cells are pre-aggregated), and the raked cells reach
    them by broadcast only if they were counted as few; else by a shuffled join.
    """
    own = ["mix_topic", "mix_tokens", "mix_probability", "mix_sampled"]
    rows = docs.withColumns({"mix_tokens": F.coalesce(tokens, F.lit(0)).cast("long")}).withColumn("mix_topic", topic)
    keys = ["source", "lang", "mix_topic"]
    cells = cut_lineage(rows.groupBy(*keys).agg(F.sum("mix_tokens").alias("tokens")))
    fitted = cut_lineage(calibrated(raked(cells, margins, rounds), keep, scale_rounds).select(*keys, "probability"))
    right = fitted.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("probability").alias("__probability"))
    if fitted.count() <= broadcast_rows(docs.sparkSession):
        right = F.broadcast(right)
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"__{k}"))
    joined = rows.join(right, condition, "left")
    probability = F.when(F.col("mix_tokens") > 0, F.coalesce(F.col("__probability"), F.lit(0.0))).otherwise(0.0)
    draw = hash_number(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))) / F.lit(float(16 ** 15))
    rest = [c for c in docs.columns if c not in own]
    return joined.withColumn("mix_probability", probability).withColumn("mix_sampled", draw < F.col("mix_probability")).select(*rest, *own)
