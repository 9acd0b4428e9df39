"""Alert life cycle as a state machine per fingerprint."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "fingerprint STRING, poll BIGINT, state STRING"


#: polls that are held at once, one bit each while they wait
BUCKET = 1 << 16


class LifecycleProcessor(StatefulProcessor):
    """State: the last live sighting.  A timer shortly before the next poll announces recovery.

    The polls of a micro-batch come in chunks of any order.  More than one chunk is kept as bitmaps of
    consecutive polls in map state and taken from there in order, so memory is bounded by a chunk and a bucket.
    """

    def __init__(self, hold: int, poll_ms: int, bucket: int = BUCKET):
        self.hold, self.poll_ms, self.bucket = hold, poll_ms, bucket

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "live BIGINT, open BOOLEAN")
        self.waiting = handle.getMapState("waiting", "bucket BIGINT", "bits BINARY")

    def _in_order(self, rows):
        """Distinct polls in order, a bucket at a time."""
        first, second = next(rows), next(rows, None)
        if second is None:
            yield np.unique(first["poll"].to_numpy(np.int64))
            return
        for chunk in chain((first, second), rows):
            polls = np.unique(chunk["poll"].to_numpy(np.int64))
            bucket = polls // self.bucket
            for b in np.unique(bucket).tolist():
                bits = np.zeros(self.bucket, bool)
                if self.waiting.containsKey((b,)):
                    bits |= np.unpackbits(np.frombuffer(self.waiting.getValue((b,))[0], np.uint8), count=self.bucket).astype(bool)
                bits[polls[bucket == b] - b * self.bucket] = True
                self.waiting.updateValue((b,), (np.packbits(bits).tobytes(),))
        for (b,) in sorted(tuple(n) for n in self.waiting.keys()):
            bits = np.unpackbits(np.frombuffer(self.waiting.getValue((b,))[0], np.uint8), count=self.bucket)
            yield np.flatnonzero(bits) + b * self.bucket
            self.waiting.removeKey((b,))

    def handleInputRows(self, key, rows, timerValues):
        for polls in self._in_order(rows):
            yield self._states(key, polls.tolist())
        live, is_open = self.seen.get()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if is_open:
            self.handle.registerTimer((live + 2) * self.poll_ms - 1)

    def _states(self, key, polls: list[int]) -> pd.DataFrame:
        live, is_open = self.seen.get() if self.seen.exists() else (None, False)
        out = []
        for poll in polls:
            gap = None if live is None else poll - live
            if is_open and gap is not None and gap > 1:
                out.append((key[0], live + 1, "resolved"))
                is_open = False
            if gap is None:
                state = "new"
            elif gap == 1:
                state = "ongoing"
            elif gap > self.hold:
                state = "recurrence"
            else:
                state = "suppressed"
            out.append((key[0], poll, state))
            if state != "suppressed":
                live, is_open = poll, True
        self.seen.update((live, is_open))
        return pd.DataFrame(out, columns=["fingerprint", "poll", "state"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        live, is_open = self.seen.get()
        if is_open:
            self.seen.update((live, False))
            yield pd.DataFrame([(key[0], live + 1, "resolved")],
                               columns=["fingerprint", "poll", "state"])

    def close(self) -> None:
        pass


def live_states(polls: DataFrame, hold: int = 3, poll_s: int = 60, bucket: int = BUCKET) -> DataFrame:
    """``polls`` has fingerprint and poll, ``poll_s`` apart; event time is ``(poll + 1) * poll_s``,
    since a row at the epoch itself would count as late.

    Gives the rows of the batch ``lifecycle``: a state per sighting, and each recovery.
    """
    timed = polls.select("fingerprint", "poll", F.timestamp_seconds((F.col("poll") + 1) * poll_s)
                         .alias("at")).withWatermark("at", "0 seconds")
    return timed.groupBy("fingerprint").transformWithStateInPandas(
        LifecycleProcessor(hold, poll_s * 1000, bucket), OUT, "Append", "EventTime")
