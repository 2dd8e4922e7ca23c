"""Ready probes that fail to come, on streams.

A window in which a service sent no good probe has no row to aggregate, so silence is found by
timers: each service keeps when its last good probe was, and a timer at the end of every
5-minute window compares.  Timers go by the watermark, which all requests of all services move
forward; a window is judged once, after everything that may still belong to it has come.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import (
    ExpiredTimerInfo,
    StatefulProcessor,
    StatefulProcessorHandle,
    TimerValues,
)

from postlake import schema as S
from postlake.operators import sli

#: What the timers need of the state store.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}
_WINDOW_MS = sli.SLI_MINUTES * 60_000


class _Silence(StatefulProcessor):
    """State of a service: the latest good probe of each window not judged yet, and the next
    window's end with the last good probe before it (microseconds)."""

    def __init__(self, minutes: int):
        self.allowed = minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "slot long", "at long")
        self.clock = handle.getValueState("clock", "next long, last long")

    def _wait_for(self, end: int, last: int) -> None:
        self.clock.update((end, last))
        self.handle.registerTimer(end)

    def handleInputRows(
        self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues
    ) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            at = part["at"].to_numpy()
            slots = at // (1000 * _WINDOW_MS)
            for slot, latest in pd.Series(at).groupby(slots).max().items():
                name = (int(slot),)
                held = self.seen.getValue(name)[0] if self.seen.containsKey(name) else 0
                self.seen.updateValue(name, (max(int(latest), held),))
                first = int(slot) if first is None else min(first, int(slot))
        if first is not None:
            end = (first + 1) * _WINDOW_MS
            clock = self.clock.get() if self.clock.exists() else None
            if clock is None or timerValues.getCurrentWatermarkInMs() < end < clock[0]:
                self._wait_for(end, -1 if clock is None else clock[1])
        return iter(())

    def handleExpiredTimer(
        self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo
    ) -> Iterator[pd.DataFrame]:
        end, last = self.clock.get()
        found: list[tuple[str, int, int]] = []
        if expiredTimerInfo.getExpiryTimeInMs() == end:  # others were replaced by an earlier one
            while end <= timerValues.getCurrentWatermarkInMs():
                slot = (end // _WINDOW_MS - 1,)
                if self.seen.containsKey(slot):
                    last = max(last, self.seen.getValue(slot)[0])
                    self.seen.removeKey(slot)
                if last >= 0 and 1000 * end - last >= self.allowed:
                    found.append((key[0], 1000 * end, last))
                end += _WINDOW_MS
            self._wait_for(end, last)
        if found:
            service, ends, lasts = zip(*found, strict=True)
            # plain objects: strings that pandas keeps in Arrow come in chunks, which Spark refuses
            names = pd.Series(service, dtype=object)
            yield pd.DataFrame({"service": names, "end": ends, "last": lasts})


def stream_silent_probes(
    log: DataFrame, service: str, watermark: str = "10 minutes", minutes: int = S.READY_BREACH_MINUTES
) -> DataFrame:
    """What ``sli.silent_probes`` finds, on a streaming log, for windows that the watermark has
    passed.  Needs ``SETTINGS`` when it is started."""
    # Names the event time, so that the watermark sees the other requests too.
    good = F.when(sli.good_probe(), F.unix_micros("ts"))
    probes = (
        log.withWatermark("ts", watermark)
        .select("ts", F.col(service).cast("string").alias("service"), good.alias("at"))
        .filter(F.col("at").isNotNull() & F.col("service").isNotNull())
    )
    found = probes.groupBy("service").transformWithStateInPandas(
        statefulProcessor=_Silence(minutes),
        outputStructType="service string, end long, last long",
        outputMode="Append",
        timeMode="EventTime",
    )
    return sli.silent_windows(found, service)
