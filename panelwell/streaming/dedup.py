"""Deduplication over a stream of fingerprinted responses, by event time.

Whether a response stays depends on the last kept one before it, so a response is judged only
once no earlier one can follow: when the watermark has passed it. Until then it waits in the
state. A timer wakes the participant's state at the first waiting response, and later once the
last kept one is older than the gap: it can no longer make a repeat, and the state is removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from panelwell.functions.timegrid import MICROS_PER_MINUTE, micros
from panelwell.session import require_utc

OUTPUT = "id bigint, app_user_id bigint, survey_id int, t bigint, fingerprint string"
STATE = "anchor bigint, mark string, times array<bigint>, ids array<bigint>, marks array<string>"


def stream_dedup(responses: DataFrame, gap_minutes: float = 10.0, delay: str = "1 hour") -> DataFrame:
    """Keeps a response unless it repeats the last kept one within the gap.

    Input columns: ``id, app_user_id, survey_id, timestamp, fingerprint``. Rows may come in any
    order as long as none is more than ``delay`` behind the latest; later ones are dropped by the
    watermark. The result equals the batch form. A key holds the rows of one delay and one batch
    in memory. Rows without a time are dropped: they never settle. A null fingerprint counts as empty.
    """
    require_utc(responses.sparkSession)
    gap = int(gap_minutes * MICROS_PER_MINUTE)

    def keep_settled(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        anchor, mark, times, ids, marks = state.get if state.exists else (None, None, [], [], [])
        waiting = list(zip(times, ids, marks))
        for chunk in chunks:
            waiting += zip(chunk["t"].tolist(), chunk["id"].tolist(), chunk["fingerprint"].tolist())
        waiting.sort()
        now = state.getCurrentWatermarkMs()
        settled = 0
        kept = []
        while settled < len(waiting) and waiting[settled][0] <= now * 1000:
            t, number, fingerprint = waiting[settled]
            settled += 1
            if anchor is None or t - anchor > gap or fingerprint != mark:
                kept.append((number, t, fingerprint))
                anchor, mark = t, fingerprint
        waiting = waiting[settled:]
        if not waiting and (anchor is None or anchor + gap < now * 1000):
            if state.exists:
                state.remove()
        else:
            times, ids, marks = (list(column) for column in zip(*waiting)) if waiting else ([], [], [])
            state.update((anchor, mark, times, ids, marks))
            wake = waiting[0][0] if waiting else anchor + gap
            # timers count milliseconds, must lie ahead, and fire once the watermark is beyond them
            state.setTimeoutTimestamp(max(now + 1, -(-wake // 1000)))
        if kept:
            rows = pd.DataFrame(kept, columns=["id", "t", "fingerprint"])
            yield rows.assign(app_user_id=key[0], survey_id=key[1])[["id", "app_user_id", "survey_id", "t", "fingerprint"]]

    timed = responses.filter("timestamp is not null").withColumn("__at", F.col("timestamp").cast("timestamp")).withWatermark("__at", delay)
    keyed = timed.select(
        "__at", "id", "app_user_id", "survey_id", micros(F.col("timestamp")).alias("t"), F.coalesce("fingerprint", F.lit("")).alias("fingerprint")
    )
    return keyed.groupBy("app_user_id", "survey_id").applyInPandasWithState(
        keep_settled, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
