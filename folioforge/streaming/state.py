"""Keyed state on streams: an entry that expires, and starts that keep a gap.

Both are processors of ``transformWithStateInPandas``. Their state is kept by Spark's state store, so a query that is started again from its
checkpoint goes on where it stopped. The store must be RocksDB (``use_state_store``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Let queries of this session that start from now on keep their state in RocksDB, which processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class Expiring(StatefulProcessor):
    """Holds each entry of a key until its time has come, and hands it on then.

    An entry with the name of one that is held replaces it. Entries whose time the watermark has passed already are handed on at once.
    """

    def __init__(self, keys: list[str], entry: str, expires: str):
        self.keys, self.entry, self.expires = keys, entry, expires

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "entry string", "expires bigint")

    def _out(self, key: tuple, rows: list[tuple[str, int]]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame([(*key, *r) for r in rows], columns=[*self.keys, self.entry, self.expires])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        past, passed = [], timerValues.getCurrentWatermarkInMs()
        for batch in rows:
            for entry, expires in zip(batch[self.entry].astype(str), batch[self.expires], strict=True):
                if expires < passed:
                    past.append((entry, int(expires)))
                    continue
                self.held.updateValue((entry,), (int(expires),))
                self.handle.registerTimer(int(expires))
        yield from self._out(key, past)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due = expiredTimerInfo.getExpiryTimeInMs()
        gone = [(name[0], value[0]) for name, value in self.held.iterator() if value[0] <= due]
        for name, _ in gone:
            self.held.removeKey((name,))
        yield from self._out(key, gone)

    def close(self) -> None:
        pass


def expired_stream(events: DataFrame, keys: list[str], entry: str, expires: str, at: str, late: str = "0 seconds") -> DataFrame:
    """(keys, entry, expires) of the entries of a stream whose time, in milliseconds, the watermark on ``at`` has passed. What has not come out is live: with the
    watermark at a time, the rest is what ``stores.live`` gives for it. Keys are strings or numbers; the state of a key without entries is gone."""
    kinds = ", ".join(f"{k} {events.schema[k].dataType.simpleString()}" for k in keys)
    own = events.select(*keys, events[entry].cast("string").alias(entry), events[expires].cast("long").alias(expires), at).withWatermark(at, late)
    return own.groupBy(*keys).transformWithStateInPandas(Expiring(keys, entry, expires), f"{kinds}, {entry} string, {expires} long", "Append", "EventTime")


class Gate(StatefulProcessor):
    """Holds the last start of each key; a request starts at its own time, or ``gap`` after that."""

    def __init__(self, keys: list[str], request: str, at: str, gap: int):
        self.keys, self.request, self.at, self.gap = keys, request, at, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "start bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        came = pd.concat(list(rows)).sort_values([self.at, self.request])
        free = self.last.get()[0] + self.gap if self.last.exists() else None
        out = []
        for request, at in zip(came[self.request], came[self.at], strict=True):
            start = int(at) if free is None else max(int(at), free)
            out.append((*key, request, int(at), start))
            free = start + self.gap
        self.last.update((free - self.gap,))
        yield pd.DataFrame(out, columns=[*self.keys, self.request, self.at, "start"])

    def close(self) -> None:
        pass


def gate_stream(requests: DataFrame, keys: list[str], request: str, at: str, gap: int) -> DataFrame:
    """(keys, request, at, start) of a stream of requests, as ``flows.gate_schedule`` gives them: each starts at its time in milliseconds or ``gap`` after the last
    start of its keys. Requests of one batch go by time and then by ``request``, a number or a string; batches come in order of time."""
    kinds = ", ".join(f"{k} {requests.schema[k].dataType.simpleString()}" for k in [*keys, request])
    own = requests.select(*keys, request, requests[at].cast("long").alias(at))
    return own.groupBy(*keys).transformWithStateInPandas(Gate(keys, request, at, gap), f"{kinds}, {at} long, start long", "Append", "None")
