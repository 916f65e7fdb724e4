"""Operators whose results depend on the order of arrival, for batch replay and for Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from siftwell.operators import monitor
from siftwell.operators.semcache import REPLAYED

#: What a stream of replays needs of its session: timers and map state live in this store.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class CacheProcessor(StatefulProcessor):
    """The cache of one roles key: a map of its live entries, and a timer for each of them.

    A request takes the nearest live entry or, if none is near enough, becomes one.  An entry leaves when the watermark
    passes the end of its life, whether or not its key gets another request.
    """

    def __init__(self, threshold: float, ttl: float):
        self.threshold, self.micros = threshold, int(ttl * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "request_id long", "created long, vector array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        requests = pd.concat(list(rows)).sort_values(["ts", "request_id"], kind="stable")
        known = sorted((created, i, vector) for (i,), (created, vector) in self.entries.iterator())
        live = [(created, i, np.asarray(vector, float)) for created, i, vector in known]
        out = [self._serve(int(r.request_id), r.ts, r.vector, live) for r in requests.itertuples()]
        yield pd.DataFrame({"request_id": requests["request_id"].to_numpy(), "key": key[0], "cache": [o[0] for o in out], "similarity": [o[1] for o in out], "entry_id": pd.array([o[2] for o in out], dtype="Int64")})

    def _serve(self, request_id: int, ts: pd.Timestamp, vector: object, live: list) -> tuple[str, float, int | None]:
        v = np.asarray([] if vector is None else vector, float)
        if ts is pd.NaT or not len(v) or not np.isfinite(v).all():
            return "miss", 0.0, None
        at = ts.value // 1000
        near = [e for e in live if at - e[0] <= self.micros and len(e[2]) == len(v)]
        best, similarity = None, 0.0
        if near:
            m = np.stack([e[2] for e in near])
            length = np.linalg.norm(m, axis=1) * np.linalg.norm(v)
            scores = (m @ v / np.where(length == 0, 1, length)).round(6)
            k = int(scores.argmax())  # the oldest of equals
            if scores[k] > 0:
                best, similarity = near[k][1], float(scores[k])
        if best is not None and similarity >= self.threshold:
            return "hit", similarity, best
        live.append((at, request_id, v))
        self.entries.updateValue((request_id,), (at, v.tolist()))
        self.handle.registerTimer(self._end(at))
        return "miss", similarity, None

    def _end(self, created: int) -> int:
        """The first millisecond at which an entry is surely dead."""
        return (created + self.micros) // 1000 + 1

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for (i,), (created, _) in list(self.entries.iterator()):
            if self._end(created) <= expiredTimerInfo.getExpiryTimeInMs():
                self.entries.removeKey((i,))
        yield from ()

    def close(self) -> None:
        pass


def replay_stream(requests: DataFrame, threshold: float = 0.92, ttl: float = 3600, late: str = "10 minutes") -> DataFrame:
    """semcache.replay over a stream of requests (request_id, key, ts, vector) that come in order of time, but for `late`.

    Requests of a batch are served in order.  The session needs the settings of STORE.  Entries end by the watermark, so a
    key that gets no more requests leaves nothing behind.
    """
    rows = requests.filter("key is not null").select("request_id", "key", "ts", "vector").withWatermark("ts", late).groupBy("key")
    return rows.transformWithStateInPandas(CacheProcessor(threshold, ttl), REPLAYED, "append", "EventTime")


def kpi_windows(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Requests, mean time and refusal rate by tumbling window and type; on a stream, windows close behind the watermark."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    by = rows.groupBy(F.window("ts", window).alias("w"), "event_type")
    return by.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("avg_value")).select(F.col("w.start").alias("window_start"), "event_type", "n", "avg_value")


def alert_each_batch(log: DataFrame, order: list[str], sink: Callable[[DataFrame, int], None]):
    """A stream writer that checks the alert rules on every batch of a request log and hands the rows to `sink`."""
    return log.writeStream.foreachBatch(lambda df, epoch: sink(monitor.alerts(df, order), epoch))
