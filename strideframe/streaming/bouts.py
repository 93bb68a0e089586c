"""Bouts of a live series: an extension, as the batch operators have no streams.

A subject's epochs may come late and out of order. They wait, by subject, until the
watermark has passed them, and then go through the bouts' rule in order; what is kept of
the past is the bout that is open. A bout is given out once no epoch can belong to it any
more, so the result is that of the batch over all epochs up to the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "subject string, start_index long, end_index long, active_epochs long"
#: Epochs that wait and their flags and times, the last one that went through, and the open bout (0 active epochs: none).
STATE = "epochs array<long>, flags array<boolean>, times array<long>, at long, first long, last long, active long"


class OpenBout:
    """The bouts' rule, an epoch at a time: at most ``allowed`` epochs between two active ones."""

    def __init__(self, least: int, allowed: int, first: int, last: int, active: int) -> None:
        self.least, self.allowed = least, allowed
        self.first, self.last, self.active = first, last, active

    def closed(self, at: int) -> list[tuple[int, int, int]]:
        """The open bout, if it is over now that epoch ``at`` has gone through, and is long enough."""
        if not self.active or at - self.last <= self.allowed:
            return []
        found = [(self.first, self.last, self.active)] if self.last - self.first + 1 >= self.least else []
        self.active = 0
        return found

    def take(self, at: int, flag: bool) -> list[tuple[int, int, int]]:
        out = self.closed(at - 1)
        if flag:
            self.first, self.last, self.active = (self.first if self.active else at), at, self.active + 1
        return out + self.closed(at)


def bouts_stream(epochs: DataFrame, least: int = 10, allowed: int = 2, delay: str = "1 hour") -> DataFrame:
    """Bouts of a stream of epochs (subject, epoch, timestamp, flag), each once, as soon as the watermark (``delay`` behind the latest time) tells that it is over.

    Epochs that come behind the watermark are left out; of an epoch that comes twice the first counts.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting_epochs, flags, times, at, first, last, active = state.get if state.exists else ([], [], [], 0, 0, 0, 0)
        waiting = {e: (f, t) for e, f, t in zip(waiting_epochs, flags, times)}
        if not state.hasTimedOut:
            for rows in batches:
                stamps = rows["timestamp"].astype("datetime64[us]").astype("int64") // 1000
                for e, f, t in zip(rows["epoch"].tolist(), rows["flag"].fillna(False).tolist(), stamps.tolist()):
                    if e > at:
                        waiting.setdefault(e, (bool(f), t))
        upto, bout, found = state.getCurrentWatermarkMs(), OpenBout(least, allowed, first, last, active), []
        for e in sorted(e for e, (_, t) in waiting.items() if t < upto):
            found += bout.take(e, waiting.pop(e)[0])
            at = e
        if waiting or bout.active:
            order = sorted(waiting)
            state.update((order, [waiting[e][0] for e in order], [waiting[e][1] for e in order], at, bout.first, bout.last, bout.active))
            if waiting:
                state.setTimeoutTimestamp(max(upto + 1, min(t for _, t in waiting.values()) + 1))
        else:
            state.update(([], [], [], at, 0, 0, 0))
        if found:
            yield pd.DataFrame([(key[0], *b) for b in found], columns=["subject", "start_index", "end_index", "active_epochs"])

    marked = epochs.select("subject", "epoch", "timestamp", "flag").withWatermark("timestamp", delay)
    return marked.groupBy("subject").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)

