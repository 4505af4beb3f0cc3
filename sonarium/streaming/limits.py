"""Rate limits over a stream of hits: state of three buckets a key, and timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sonarium.operators.requests import BUCKET_SECONDS, BUCKETS

#: A stream needs this store for its state.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Buckets that wait with their hits, and what the last decided ones accepted, those of a window.
_STATE = "waiting ARRAY<BIGINT>, hits ARRAY<BIGINT>, past ARRAY<BIGINT>, accepted ARRAY<BIGINT>"
_WINDOW = BUCKETS * BUCKET_SECONDS


class _Limiter(StatefulProcessor):
    """Buckets of a key wait until the watermark has passed their end, and are then decided in their order.

    As many wait as the watermark's delay has; one value holds all of them, and one timer, for the first one's end, is set at a time. A key that is idle for a window has no state."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("buckets", _STATE)

    def _held(self) -> tuple[dict[int, int], dict[int, int]]:
        held = self.state.get() if self.state.exists() else ([], [], [], [])
        return dict(zip(held[0], held[1], strict=True)), dict(zip(held[2], held[3], strict=True))

    def _keep(self, waiting: dict[int, int], past: dict[int, int]) -> None:
        self.state.update((list(waiting), list(waiting.values()), list(past), list(past.values())))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        waiting, past = self._held()
        before = min(waiting, default=None)
        decided = timerValues.getCurrentWatermarkInMs() // 1000 - BUCKET_SECONDS
        for part in rows:
            for bucket, hits in part.groupby("bucket")["hits"].sum().items():
                if bucket > decided:
                    waiting[int(bucket)] = waiting.get(int(bucket), 0) + int(hits)
        if waiting:
            self._keep(waiting, past)
            if min(waiting) != before:
                self.handle.registerTimer((min(waiting) + BUCKET_SECONDS) * 1000)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        waiting, past = self._held()
        now = timerValues.getCurrentWatermarkInMs() // 1000
        out = []
        for bucket in sorted(b for b in waiting if b + BUCKET_SECONDS <= now):
            hits = waiting.pop(bucket)
            past = {b: n for b, n in past.items() if b > bucket - _WINDOW}
            past[bucket] = min(hits, max(0, self.most - sum(past.values())))
            out.append((key[0], bucket, hits, past[bucket]))
        if waiting or any(b + _WINDOW + BUCKET_SECONDS > now for b in past):
            self._keep(waiting, past)
            self.handle.registerTimer((min(waiting) + BUCKET_SECONDS if waiting else max(past) + _WINDOW + BUCKET_SECONDS) * 1000)
        else:
            self.state.clear()
        if out:
            yield pd.DataFrame(out, columns=["key", "bucket", "hits", "accepted"])

    def close(self) -> None:
        pass


def limited_stream(hits: DataFrame, key: str, time: str, per_second: float, late: str = "10 seconds") -> DataFrame:
    """key, bucket, hits and accepted, as requests.limited() has them, of a stream of hits: each bucket comes once, when the watermark has passed it.

    Hits that are later than `late` are left out. The session needs STORE."""
    most = int(per_second * BUCKET_SECONDS * BUCKETS)
    when = F.col(time).cast("timestamp")
    seconds = F.unix_timestamp(when)
    held = hits.select(F.col(key).cast("string").alias("key"), when.alias("at"), (seconds - F.pmod(seconds, F.lit(BUCKET_SECONDS))).alias("bucket"), F.lit(1).cast("long").alias("hits"))
    of_key = held.withWatermark("at", late).groupBy("key")
    return of_key.transformWithStateInPandas(_Limiter(most), "key STRING, bucket LONG, hits LONG, accepted LONG", "append", "EventTime")
