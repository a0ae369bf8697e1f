"""Stateful streams: a restoration vault whose sessions expire by timers, and windowed counts of findings."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# How long a session, and what is known of its end, is kept; the largest mapping.
TTL_MS = 900_000
MAX_BYTES = 1 << 20
OUTPUT = "session string, op string, code string, mapping string"


def _mapping_size(text: str) -> int | None:
    """Bytes of a mapping's keys and values; None if it isn't one."""
    try:
        found = json.loads(text)
    except ValueError:
        return None
    if not isinstance(found, dict) or not found or not all(k and isinstance(v, str) for k, v in found.items()):
        return None
    return sum(len(k.encode()) + len(v.encode()) for k, v in found.items())


class Vault(StatefulProcessor):
    """Events (session, op, mapping, single, at) -> codes.

    store keeps a mapping (JSON); consume hands it out, once if it is single, which leaves a tombstone; clear forgets all of
    a session. A timer ends each session when its time is up and leaves a tombstone as well, so that a late consume
    says expired and a second one consumed; another timer takes the tombstone away, after which the session is unknown.
    An ended session gives a row of op cleanup.
    """

    def __init__(self, ttl_ms: int = TTL_MS, by_event: bool = False):
        self.ttl_ms, self.by_event = ttl_ms, by_event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.mapping = handle.getValueState("mapping", "m string, single boolean, until long")
        self.ended = handle.getValueState("ended", "code string, until long")

    def _wait(self, until: int) -> None:
        self.handle.registerTimer(until)

    def _end(self, code: str, now: int) -> None:
        self.mapping.clear()
        self.ended.update((code, now + self.ttl_ms))
        self._wait(now + self.ttl_ms)

    def _settle(self, now: int) -> bool:
        """Bring the state up to now; whether the session has just expired."""
        if self.ended.exists() and self.ended.get()[1] <= now:
            self.ended.clear()
        if self.mapping.exists() and self.mapping.get()[2] <= now:
            self._end("expired", now)
            return True
        return False

    def _store(self, m: str | None, single: bool, now: int) -> str:
        if self.mapping.exists() or self.ended.exists():
            return "exists"
        size = None if m is None else _mapping_size(m)
        if size is None:
            return "malformed"
        if size > MAX_BYTES:
            return "too_large"
        self.mapping.update((m, single, now + self.ttl_ms))
        self._wait(now + self.ttl_ms)
        return "stored"

    def _consume(self, now: int) -> tuple[str, str | None]:
        if self.ended.exists():
            return self.ended.get()[0], None
        if not self.mapping.exists():
            return "unknown", None
        m, single, _ = self.mapping.get()
        if single:
            self._end("consumed", now)
        return "ok", m

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        events = pd.concat(list(rows))
        if self.by_event:
            events = events.sort_values("at_ms", kind="stable")
        for op, m, single, at in zip(events["op"], events["mapping"], events["single"], events["at_ms"], strict=True):
            now = int(at) if self.by_event else timerValues.getCurrentProcessingTimeInMs()
            if self._settle(now):
                out.append((key[0], "cleanup", "expired", None))
            given = None
            if op == "store":
                code = self._store(m, bool(single), now)
            elif op == "consume":
                code, given = self._consume(now)
            elif op == "clear":
                self.mapping.clear()
                self.ended.clear()
                code = "cleared"
            else:
                code = "malformed"
            out.append((key[0], op, code, given))
        yield pd.DataFrame(out, columns=["session", "op", "code", "mapping"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # a timer may be of a state that has gone since; what its time says of the present state counts
        ended = self._settle(expiredTimerInfo.getExpiryTimeInMs())
        yield pd.DataFrame([(key[0], "cleanup", "expired", None)] if ended else [], columns=["session", "op", "code", "mapping"])

    def close(self) -> None:
        pass


def vault(events: DataFrame, ttl_ms: int = TTL_MS, late: str | None = None) -> DataFrame:
    """A stream of codes for a stream of vault events (session, op, mapping[, single][, at]); needs the RocksDB state store.

    Time is the clock's. Given late, it is that of the events' column at: timers then follow the watermark, this much
    behind, so that a stream read again gives the same codes; events later than that are dropped. Under an available-now
    trigger a stream by the clock must have spark.sql.streaming.noDataMicroBatches.enabled off: timers ask for one more
    batch, so it would not end.
    """
    own = events if "single" in events.columns else events.withColumn("single", F.lit(True))
    if late is not None:
        own = own.withWatermark("at", late).withColumn("at_ms", F.unix_millis("at"))
    else:
        own = own.withColumn("at_ms", F.lit(None).cast("long"))
    mode = "ProcessingTime" if late is None else "EventTime"
    return own.groupBy("session").transformWithStateInPandas(Vault(ttl_ms, late is not None), OUTPUT, "Append", mode)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type in tumbling windows; a stream drops what comes later than late."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
