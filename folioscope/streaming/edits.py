"""Streams of edits: debounced sessions, and the last action of each member as keyed state."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def debounced(events: DataFrame, key: str, at: str, gap: str, late: str | None = None) -> DataFrame:
    """Bursts of a key's events, parted by longer pauses than gap; on a stream, late bounds what is waited for."""
    rows = events.withWatermark(at, late) if late else events
    return rows.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("events")).select(key, "first_at", "last_at", "events")


MEMBER = "collection long, slug long, action string, at timestamp, seq long"


def effective_stream(ops: DataFrame) -> DataFrame:
    """On a stream of edits, each member's action whenever it changes; edits that come late change nothing."""
    def update(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known = state.get if state.exists else (None, None, None)
        best = known
        for part in parts:
            for action, at, seq in zip(part["action"], part["at"], part["seq"]):
                if best[1] is None or (at.value, seq) > (best[1], best[2]):
                    best = (action, at.value, int(seq))
        state.update(best)
        if best != known:
            yield pd.DataFrame({"collection": [key[0]], "slug": [key[1]], "action": [best[0]], "at": [pd.Timestamp(best[1])], "seq": [best[2]]})

    return ops.groupBy("collection", "slug").applyInPandasWithState(update, MEMBER, "action string, at long, seq long", "update", "NoTimeout")
