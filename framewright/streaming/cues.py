"""Cues from a stream of transcript segments: beyond what the batch operators need, and the same result.

A video's open group lives in state; it is emitted when a segment beyond its window arrives, or when the watermark passes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.cues import cue_of

_OUT = "video_id string, timestamp double, tier int, phrase string"
_STATE = "opened double, timestamp double, tier int, phrase string"


def stream_cues(segments: DataFrame, tiers: Sequence[int] = (1, 2, 3), window: float = 15.0, late: str = "30 seconds") -> DataFrame:
    """``video_id, timestamp, tier, phrase`` of ``segments(video_id, start, text, event_time)``; one cue a group.

    Segments of a video that arrive in one batch may be in any order; across batches they must be in order of start.
    """
    cue = segments.withWatermark("event_time", late).select(F.col("video_id").cast("string").alias("video_id"), F.col("start").alias("timestamp"), cue_of(F.coalesce("text", F.lit("")), tiers).alias("c"), "event_time")
    hits = cue.filter(F.col("c").isNotNull()).select("video_id", "timestamp", "c.tier", "c.phrase", "event_time")

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        group = state.get if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], *group[1:])], columns=["video_id", "timestamp", "tier", "phrase"])
            return
        rows = pd.concat(list(batches)).sort_values("timestamp", kind="stable")
        for t, tier, phrase in zip(rows["timestamp"].tolist(), rows["tier"].tolist(), rows["phrase"].tolist()):
            if group is None or t - group[0] > window:
                if group is not None:
                    out.append((key[0], *group[1:]))
                group = (t, t, tier, phrase)
            elif (tier, t) < (group[2], group[1]):
                group = (group[0], t, tier, phrase)
        state.update(group)
        state.setTimeoutTimestamp(max(int(rows["event_time"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + int(window * 1000) + 1)
        if out:
            yield pd.DataFrame(out, columns=["video_id", "timestamp", "tier", "phrase"])

    return hits.groupBy("video_id").applyInPandasWithState(fold, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
