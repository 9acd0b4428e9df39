"""Sliding link bandwidth with the last sends of each device as state.

The sends of a micro-batch are put into buckets of consecutive send numbers, which tasks take one by one.  Windows that
lie in one bucket need nothing else.  Those across the ends of buckets, and into earlier micro-batches, need only the
first and last sends of each: one row per bucket, which a device's state processor takes in order.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetlens.functions.numbers import div
from fleetlens.operators.links import DEVICE, GBIT_FACTOR, WINDOW_SENDS

OUT = "nic STRING, dev INT, rn BIGINT, func_times BIGINT, gbps BIGINT"
EDGES = "nic STRING, dev INT, bucket BIGINT, sends BINARY"


COLUMNS = ["rn", "func_times", "size", "t_ns"]
#: send numbers that are sorted and held at once
BUCKET = 1 << 16
#: bucket of the sends without a number, which come first
UNNUMBERED = -1 << 63


class Sends:
    """Sends in order: a row of values and a row of validity for each of ``COLUMNS``."""

    def __init__(self, values: np.ndarray, valid: np.ndarray):
        self.values, self.valid = values, valid

    @classmethod
    def of(cls, table: pa.Table) -> Sends:
        columns = [table.column(c).combine_chunks() for c in COLUMNS]
        values = np.array([c.fill_null(0).to_numpy() for c in columns], np.int64)
        valid = np.array([c.is_valid().to_numpy(zero_copy_only=False) for c in columns], bool)
        rn = values[0]
        if not valid[0].all() or (rn[1:] <= rn[:-1]).any():
            order = np.argsort(rn, kind="stable")
            if not valid[0].all() or (rn[order[1:]] == rn[order[:-1]]).any():
                # sends of one number in the same order whenever they are read
                order = np.lexsort([row for pair in zip(values[::-1], valid[::-1]) for row in pair])
            values, valid = values[:, order], valid[:, order]
        return cls(values, valid)

    def __len__(self) -> int:
        return self.values.shape[1]

    def first(self, n: int) -> Sends:
        return Sends(self.values[:, :n], self.valid[:, :n])

    def last(self, n: int) -> Sends:
        start = max(len(self) - n, 0)
        return Sends(self.values[:, start:], self.valid[:, start:])

    def __add__(self, other: Sends) -> Sends:
        return Sends(np.hstack([self.values, other.values]), np.hstack([self.valid, other.valid]))

    def packed(self) -> bytes:
        return self.values.tobytes() + self.valid.tobytes()

    @classmethod
    def unpacked(cls, data: bytes) -> Sends:
        n = len(data) // (9 * len(COLUMNS))
        whole = np.frombuffer(data, np.int64, n * len(COLUMNS))
        return cls(whole.reshape(len(COLUMNS), n), np.frombuffer(data, bool, offset=whole.nbytes).reshape(len(COLUMNS), n))

    def rates(self, k: int, start: int = 0) -> list[pa.Array]:
        """``rn, func_times, gbps`` of the full windows of ``k`` sends that end at position ``start`` or later."""
        (rn, ft, size, t), (has_rn, has_ft, has_size, has_t) = self.values, self.valid
        change = np.concatenate([[0], np.cumsum((ft[1:] != ft[:-1]) & has_ft[1:] & has_ft[:-1])])
        total = np.concatenate([[0], np.cumsum(size)])
        last = np.arange(max(start, k - 1), len(self))
        first = last - (k - 1)
        ok = (change[last] == change[first]) & (t[last] > t[first]) & has_t[last] & has_t[first]
        last, first = last[ok], first[ok]
        rate = (total[last + 1] - total[first + 1]) * GBIT_FACTOR / (t[last] - t[first])
        return [pa.array(rn[last], mask=~has_rn[last]), pa.array(ft[last], mask=~has_ft[last]),
                pa.array(np.floor(rate).astype(np.int64), mask=~has_size[first])]


def _rates_inside(window: int):
    """Rates of the windows that lie in one bucket."""
    def rates(key, table):
        columns = Sends.of(table).rates(window)
        n = len(columns[0])
        return pa.Table.from_arrays([pa.repeat(key[0].cast(pa.string()), n), pa.repeat(key[1].cast(pa.int32()), n), *columns],
                                    ["nic", "dev", "rn", "func_times", "gbps"])
    return rates


def _edges(window: int):
    """The first and the last ``window - 1`` sends of a bucket, as one row."""
    def edges(key, table):
        near, rn = window - 1, table.column("rn")
        if len(rn) > 2 * window and rn.null_count == 0:
            rn = rn.to_numpy()
            ends = np.partition(rn, (window, len(rn) - 1 - window))
            table = table.filter(pa.array((rn <= ends[window]) | (rn >= ends[-1 - window])))
        sends = Sends.of(table)
        if len(sends) > 2 * near:
            sends = sends.first(near) + sends.last(near)
        return pa.table({"nic": pa.repeat(key[0].cast(pa.string()), 1), "dev": pa.repeat(key[1].cast(pa.int32()), 1),
                         "bucket": pa.repeat(key[2].cast(pa.int64()), 1).fill_null(UNNUMBERED), "sends": [sends.packed()]})
    return edges


class BandwidthProcessor(StatefulProcessor):
    """Rates of the windows that begin before the bucket they end in.  State: the newest ``window - 1`` sends.

    A micro-batch's buckets of a device come in chunks of any order.  More than one chunk is kept as map state and
    taken from there bucket by bucket in order, so memory is bounded by a chunk.
    """

    def __init__(self, window: int):
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tail = handle.getValueState("tail", "sends BINARY")
        self.waiting = handle.getMapState("waiting", "bucket BIGINT", "sends BINARY")

    def handleInputRows(self, key, rows, timerValues):
        first, second = next(rows), next(rows, None)
        if second is None:
            first = first.sort_values("bucket")
            yield from self._rates(key, first["sends"])
            return
        for chunk in chain((first, second), rows):
            for bucket, sends in zip(chunk["bucket"], chunk["sends"]):
                self.waiting.updateValue((int(bucket),), (bytes(sends),))
        buckets = sorted(tuple(n) for n in self.waiting.keys())
        yield from self._rates(key, (self.waiting.getValue(name)[0] for name in buckets))
        self.waiting.clear()

    def _rates(self, key, buckets):
        """Rates of windows that end in the first sends of these buckets; they follow all earlier ones."""
        near, out = self.window - 1, []
        tail = Sends.unpacked(bytes(self.tail.get()[0]) if self.tail.exists() else b"")
        for data in buckets:
            sends = Sends.unpacked(bytes(data))
            out.append((tail + sends.first(near)).rates(self.window, len(tail)))
            tail = (tail + sends).last(near)
            if len(out) == 1000:
                yield self._frame(key, out)
                out = []
        self.tail.update((tail.packed(),))
        yield self._frame(key, out)

    @staticmethod
    def _frame(key, out) -> pd.DataFrame:
        columns = [pa.chunked_array(c, pa.int64()).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get) for c in
                   (zip(*out) if out else ([], [], []))]
        return pd.DataFrame({"nic": key[0], "dev": key[1], **dict(zip(("rn", "func_times", "gbps"), columns))})

    def close(self) -> None:
        pass


def live_bandwidth(sends: DataFrame, window: int = WINDOW_SENDS, bucket: int = BUCKET) -> DataFrame:
    buckets = sends.select(*DEVICE, *COLUMNS, div(F.col("rn"), bucket).alias("bucket")).groupBy(*DEVICE, "bucket")
    across = buckets.applyInArrow(_edges(window), EDGES).groupBy(*DEVICE).transformWithStateInPandas(
        BandwidthProcessor(window), OUT, "Append", "None")
    return buckets.applyInArrow(_rates_inside(window), OUT).unionByName(across)
