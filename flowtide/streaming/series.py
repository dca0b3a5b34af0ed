"""Series of metrics that vanish on a stream: a while after their interface or kind has gone, unless they come back.

The batch twin is metrics.expire_series: a series expires when its key was deleted ttl ago and it hasn't been active
since. Timers are in event time, so a stream over old data gives what it would have given then.
"""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EXPIRED = "key string, series string, expired_ns long"
MS = 1_000_000


class SeriesExpiry(StatefulProcessor):
    """Keyed by what is deleted (an interface, a kind); its series, and when it was last deleted, are the state."""

    def __init__(self, ttl_ns: int, boot_ns: int = 0):
        self.ttl_ns, self.boot_ns = ttl_ns, boot_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.series = handle.getMapState("series", "series string", "last_ns long")
        self.deleted = handle.getValueState("deleted", "at_ns long")

    def _expire(self, key, at_ns: int) -> pd.DataFrame:
        gone = [s[0] for s, last in self.series.iterator() if last[0] <= at_ns]
        for series in gone:
            self.series.removeKey((series,))
        self.deleted.clear()
        return _table([(key[0], series, at_ns + self.ttl_ns) for series in gone])

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        seen, at = {}, self.deleted.get()[0] if self.deleted.exists() else None
        for part in rows:
            for event, series, ts in zip(part["event"].tolist(), part["series"].tolist(), part["ts_ns"].tolist()):
                if event == "deleted":
                    at = ts if at is None else max(at, ts)
                else:
                    seen[series] = max(ts, seen.get(series, ts))
        for series, ts in seen.items():
            last = self.series.getValue((series,))[0] if self.series.containsKey((series,)) else ts
            self.series.updateValue((series,), (max(ts, last),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if at is None:
            yield _table([])
        elif self.ttl_ns == 0:
            yield self._expire(key, at)
        else:
            self.deleted.update((at,))
            self.handle.registerTimer((self.boot_ns + at + self.ttl_ns) // MS + 1)
            yield _table([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        yield self._expire(key, self.deleted.get()[0]) if self.deleted.exists() else _table([])

    def close(self) -> None:
        pass


def _table(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["key", "series", "expired_ns"], dtype=object)


def expired_series(events: DataFrame, ttl_ns: int, boot_ns: int, delay: str = "10 seconds") -> DataFrame:
    """(key, series, expired_ns) of a stream of events: key, series, event (active or deleted) and ts_ns.

    A series that is active after its key was deleted stays, and with a ttl of 0 series go at once.
    """
    moment = F.timestamp_micros(F.expr(f"(ts_ns + {boot_ns}) DIV 1000"))
    rows = events.withColumn("event_time", moment).withWatermark("event_time", delay).select("key", "series", "event", "ts_ns", "event_time")
    return rows.groupBy("key").transformWithStateInPandas(SeriesExpiry(ttl_ns, boot_ns), outputStructType=EXPIRED, outputMode="append", timeMode="EventTime")
