"""The queue of edits as keyed state: one entry for each member, opposite edits cancel, sent ones overlay until they age.

Messages are (collection, slug, kind, at, published): kind is add or remove for an edit, sent or refused for what a
flush reports, page for a page that was seen. published tells whether the page, or the one that the edit was made on,
has the member. A sent edit ends when a page agrees with it, or by a timer when it is too old: no message need come.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Fixed value: a sent edit overlays a page that disagrees with it for seven days.
OVERLAY_MS = 7 * 24 * 60 * 60 * 1000
ENTRY = "collection long, slug long, state string, action string, at timestamp"
_STATE = "sent string, sent_at long, pending string, pending_at long"
NOTHING = (None, None, None, None)


def step(state: tuple, kind: str, at: int, published: bool, overlay_ms: int = OVERLAY_MS) -> tuple:
    """(sent, sent_at, pending, pending_at) after a message; times are in milliseconds."""
    sent, sent_at, pending, pending_at = aged(state, at, overlay_ms)
    if kind == "page" and sent is not None and published == (sent == "add"):
        sent, sent_at = None, None
    if kind in ("add", "remove"):
        held = sent == "add" if sent is not None else published
        pending, pending_at = (None, None) if (kind == "add") == held else (kind, at)
    elif kind == "sent" and pending is not None:
        sent, sent_at, pending, pending_at = pending, at, None, None
    elif kind == "refused":
        pending, pending_at = None, None
    return sent, sent_at, pending, pending_at


def aged(state: tuple, now: int, overlay_ms: int = OVERLAY_MS) -> tuple:
    """Without the sent edit, if it is too old."""
    return (None, None, *state[2:]) if state[0] is not None and now - state[1] > overlay_ms else state


class Queue(StatefulProcessor):
    """One member's entry as a value, and a timer for when what it sent is too old."""

    def __init__(self, overlay_ms: int):
        self.overlay_ms = overlay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", _STATE)

    def _known(self) -> tuple:
        return tuple(self.entry.get()) if self.entry.exists() else NOTHING

    def _kept(self, key: tuple, before: tuple, now: tuple) -> Iterator[pd.DataFrame]:
        """The state and its timer brought up to date; the entry's row, if it changed."""
        if before[1] != now[1]:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if now[1] is not None:
                self.handle.registerTimer(now[1] + self.overlay_ms + 1)
        if now == NOTHING:
            self.entry.clear()
        else:
            self.entry.update(now)
        if now != before:
            name, action, at = ("pending", now[2], now[3]) if now[2] else ("sent", now[0], now[1]) if now[0] else ("none", None, None)
            yield pd.DataFrame({"collection": [key[0]], "slug": [key[1]], "state": [name], "action": [action], "at": [pd.Timestamp(at, unit="ms") if at is not None else pd.NaT]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = now = self._known()
        messages = pd.concat(list(rows)).sort_values("at", kind="stable")
        for kind, at, published in zip(messages["kind"], messages["at"], messages["published"]):
            now = step(now, kind, at.value // 1_000_000, bool(published), self.overlay_ms)
        yield from self._kept(key, before, now)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before = self._known()
        # The timer that fired is gone already; what it was set for is checked again.
        yield from self._kept(key, before, aged(before, expiredTimerInfo.getExpiryTimeInMs(), self.overlay_ms))

    def close(self) -> None:
        pass


def entries(messages: DataFrame, overlay_ms: int = OVERLAY_MS) -> DataFrame:
    """On a stream of messages, each member's entry whenever it changes (state: pending, sent or none).

    A sent edit that no page agrees with ends overlay_ms after it was sent by the cluster's clock, in a batch without
    messages if need be; a member without an entry keeps no state. The session's state store must be RocksDB's.
    """
    return messages.groupBy("collection", "slug").transformWithStateInPandas(Queue(overlay_ms), ENTRY, "update", "processingTime")
