"""Score to probability expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax_pair(score_0: Column, score_1: Column) -> tuple[Column, Column]:
    """Softmax of two scores, shifted by their maximum so that large scores do not overflow."""
    top = F.greatest(score_0, score_1)
    e0, e1 = F.exp(score_0 - top), F.exp(score_1 - top)
    return e0 / (e0 + e1), e1 / (e0 + e1)


def positive_prob(scores: Column) -> Column:
    """Positive-class probability of a score array: width 1 sigmoid, width 2 softmax, else null."""
    s0, s1 = F.get(scores, 0), F.get(scores, 1)
    return F.when(F.size(scores) == 1, 1.0 / (1.0 + F.exp(-s0))).when(
        F.size(scores) == 2, softmax_pair(s0, s1)[1]
    )
