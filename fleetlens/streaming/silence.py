"""Silences judged by the clock: a key that sends nothing more is reported although no event follows.

A processing-time timer per key fires when the clock has passed the key's newest event by the limit, so
a hang of *all* keys is seen, where a watermark would stand still.  Events carry wall-clock times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class SilenceProcessor(StatefulProcessor):
    """State: the open run of events (first, newest, facts of the newest) and whether its end was told.

    A run is a chain of events no further apart than the limit.  Input is taken chunk by chunk and reduced
    to runs, so memory follows the number of silences in a micro-batch, not its events.  Events older than
    the run in the state are late and left out.
    """

    def __init__(self, keys: list[str], facts: list[str], kinds: str, limit_us: int):
        self.keys, self.facts, self.kinds, self.limit = keys, facts, kinds, limit_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState(
            "run", "first BIGINT, newest BIGINT, told BOOLEAN" + (f", {self.kinds}" if self.facts else ""))

    def _runs(self, rows: Iterator[pd.DataFrame]) -> list[list]:
        """[first, newest, facts of the newest] of every run of the input, in order."""
        runs: list[list] = []
        for chunk in rows:
            chunk = chunk.sort_values(["us", *self.facts], kind="stable")
            us = chunk["us"].to_numpy(np.int64)
            if not len(us):
                continue
            cut = np.flatnonzero(np.diff(us) > self.limit)
            facts = chunk[self.facts]
            for a, b in zip([0, *(cut + 1)], [*cut, len(us) - 1]):
                runs.append([int(us[a]), int(us[b]), _plain(facts.iloc[b])])
            runs = self._joined(runs)
        return runs

    def _joined(self, runs: list[list]) -> list[list]:
        out: list[list] = []
        for run in sorted(runs, key=lambda r: (r[0], r[1])):
            if out and run[0] - out[-1][1] <= self.limit:
                if run[1] >= out[-1][1]:
                    out[-1][1:] = run[1:]
            else:
                out.append(run)
        return out

    def handleInputRows(self, key, rows, timerValues):
        told, runs = False, self._runs(rows)
        if self.run.exists():
            first, newest, told, *facts = self.run.get()
            runs = [r for r in runs if r[1] >= first]
            runs = self._joined([[first, newest, facts], *[[max(r[0], first), *r[1:]] for r in runs]])
            told = told and runs[0][1] == newest
        if runs:
            # every run but the last ended in a silence; the first of them may have been told already
            ended = [r for i, r in enumerate(runs[:-1]) if not (told and i == 0)]
            told = told and len(runs) == 1
            first, newest, facts = runs[-1]
            self.run.update((first, newest, told, *facts))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if not told:
                self.handle.registerTimer((newest + self.limit) // 1000 + 1)
            yield self._rows(key, ended)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        first, newest, told, *facts = self.run.get()
        if not told:
            self.run.update((first, newest, True, *facts))
            yield self._rows(key, [[first, newest, facts]])

    def _rows(self, key, runs: list[list]) -> pd.DataFrame:
        return pd.DataFrame([(*key, first, newest, *facts) for first, newest, facts in runs],
                            columns=[*self.keys, "online_us", "last_us", *self.facts])

    def close(self) -> None:
        pass


def _plain(facts: pd.Series) -> list:
    return [None if pd.isna(v) else v.item() if isinstance(v, np.generic) else v for v in facts]


def silences(events: DataFrame, keys: list[str], limit_s: float, facts: list[str] = ()) -> DataFrame:
    """One row per silence longer than the limit: the run's first and newest event time, and the
    ``facts`` of its newest event.  ``events`` has an event time ``ts``; rows without one are left out.

    A run that the clock has not yet outlived gives no row; one that it has gives one, once.
    """
    facts = list(facts)
    rows = events.where("ts IS NOT NULL").select(*keys, F.unix_micros("ts").alias("us"), *facts)

    def schema(names):
        return T.StructType([f for n in names for f in rows.schema.fields if f.name == n])
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema(facts).fields)
    long = T.LongType()
    out = T.StructType([*schema(keys).fields, T.StructField("online_us", long), T.StructField("last_us", long),
                        *schema(facts).fields])
    return rows.groupBy(*keys).transformWithStateInPandas(
        SilenceProcessor(list(keys), facts, kinds, round(limit_s * 1_000_000)), out, "Append", "ProcessingTime")


def hung_streams(calls: DataFrame, idle_s: float = 300.0) -> DataFrame:
    """Streams silent for longer than the limit by the clock, with their last call."""
    return silences(calls, ["rank", "stream"], idle_s, ["function", "op_count"]).select(
        "rank", "stream", "function", "op_count", "last_us")


def connection_events(beats: DataFrame, timeout_s: float = 1200.0) -> DataFrame:
    """Offline events of clients as the clock passes the timeout, each with the ``recovered`` event (first
    contact or return) that it follows."""
    gone = silences(beats, ["client_id"], timeout_s)
    both = F.array(F.struct(F.col("online_us").alias("us"), F.lit("recovered").alias("event")),
                   F.struct((F.col("last_us") + round(timeout_s * 1_000_000)).alias("us"), F.lit("offline").alias("event")))
    return gone.select("client_id", F.explode(both).alias("_e")).select("client_id", "_e.us", "_e.event")
