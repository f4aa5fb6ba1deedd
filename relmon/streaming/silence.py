"""Alerts for sources that fall silent, from a stream.

A batch freshness check sees a silence when it happens to run; here each source
keeps its own timer.  A silence of more than the threshold after an event is
reported once, as soon as the watermark proves that nothing came in between
(event time), or when the clock says so (processing time: also if the whole
stream stops, when no watermark moves any more).  Reminders follow while the
silence lasts, at two, four, eight ... times the threshold.

The state of a source is the list of its stretches of activity that can still
change: usually one; times closer together than the threshold are one stretch,
so late rows that fill a gap join two of them.  In event time a reported silence
leaves the state; in processing time a source that never comes back is
forgotten after ``ttl_days``.  Which alerts come out doesn't depend on how the
rows are dealt to micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def merge_stretches(stretches: list[tuple[int, int, int]], times: Sequence[int], threshold: int) -> list[tuple[int, int, int]]:
    """(start, end, reports so far) of stretches with sorted ``times`` added;
    what lies no further apart than ``threshold`` is one stretch, whose reports
    are those of the part that ends last."""
    out: list[list[int]] = []
    for s, e, n in sorted([*stretches, *((t, t, 0) for t in times)]):
        if out and s - out[-1][1] <= threshold:
            if e > out[-1][1]:
                out[-1][1:] = [e, n]
            elif e == out[-1][1]:
                out[-1][2] = max(out[-1][2], n)
        else:
            out.append([s, e, n])
    return [tuple(x) for x in out]


class SilenceProcessor(StatefulProcessor):
    """``transformWithState`` processor; times are microseconds."""

    def __init__(self, keys: Sequence[str], threshold: int, reminders: int, event_time: bool, ttl_ms: int | None):
        self.keys, self.threshold, self.reminders, self.event_time, self.ttl_ms = list(keys), threshold, reminders, event_time, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("stretches", "start array<bigint>, end array<bigint>, reports array<int>", self.ttl_ms)

    def _load(self) -> list[tuple[int, int, int]]:
        if not self.state.exists():
            return []
        return list(zip(*self.state.get()))

    def _due(self, stretch: tuple[int, int, int]) -> int:
        """Time of the stretch's next report."""
        return stretch[1] + (self.threshold << stretch[2])

    def _store(self, stretches: list[tuple[int, int, int]]) -> None:
        """Keep what can still be reported, with a timer for each."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        keep = []
        for i, s in enumerate(stretches):
            last = i + 1 == len(stretches)
            # a report whose time comes after the next stretch began will never be due
            pending = s[2] <= self.reminders and (last or self._due(s) < stretches[i + 1][0])
            if pending or (last and not self.event_time):
                keep.append(s)
            if pending:
                self.handle.registerTimer(self._due(s) // 1000 + 1)
        if keep:
            self.state.update(tuple(list(x) for x in zip(*keep)))
        else:
            self.state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = pd.concat([r["micros"] for r in rows]).dropna().astype("int64").drop_duplicates().sort_values().tolist()
        self._store(merge_stretches(self._load(), times, self.threshold))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # all that is due by now, whichever timer came first
        ms = timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        stretches, out = self._load(), []
        for i, s in enumerate(stretches):
            while s[2] <= self.reminders and self._due(s) // 1000 + 1 <= ms and (i + 1 == len(stretches) or self._due(s) < stretches[i + 1][0]):
                out.append((s[1], self._due(s), s[2]))
                s = stretches[i] = (s[0], s[1], s[2] + 1)
        self._store(stretches)
        if out:
            since, at, n = zip(*out)
            yield pd.DataFrame({**{k: [v] * len(out) for k, v in zip(self.keys, key)}, "silent_since": pd.to_datetime(list(since), unit="us"),
                                "alert_timestamp": pd.to_datetime(list(at), unit="us"), "reminder": pd.Series(n, dtype="int32")})

    def close(self) -> None:
        pass


def silent_sources(stream: DataFrame, ts_col: str, by: Sequence[str], threshold_minutes: float, watermark: str = "10 minutes",
                   reminders: int = 0, time_mode: str = "EventTime", ttl_days: float | None = 90.0) -> DataFrame:
    """by..., silent_since, alert_timestamp (when the silence passed the
    threshold, or a reminder's multiple of it), reminder (0 for the first report).

    One alert per silence and reminder; a gap of exactly the threshold is none.
    Rows without a key, or with a time that is null or not between 1700 and 2200,
    are left out.  Needs the RocksDB state store: start
    the query within ``rocksdb_state``."""
    from relmon.streaming.streams import event_time
    event = time_mode == "EventTime"
    spark_types = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    s = event_time(stream, ts_col)
    for c in by:
        s = s.filter(F.col(c).isNotNull())
    # no time that Arrow can't hand over in nanoseconds (one far in the future would also end all waiting)
    s = s.filter(F.col("event_time").between(F.lit("1700-01-01").cast("timestamp"), F.lit("2200-01-01").cast("timestamp")))
    s = s.withWatermark("event_time", watermark).select(*by, "event_time", F.unix_micros("event_time").alias("micros"))
    proc = SilenceProcessor(by, int(round(threshold_minutes * 6e7)), reminders, event,
                            None if event or ttl_days is None else int(ttl_days * 86_400_000))
    schema = ", ".join([*(f"`{k}` {spark_types[k]}" for k in by), "silent_since timestamp_ntz, alert_timestamp timestamp_ntz, reminder int"])
    return s.groupBy(*by).transformWithStateInPandas(proc, schema, "Append", time_mode)


class rocksdb_state:
    """Queries started inside use the RocksDB state store; the session's setting is restored behind."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self):
        self.old = self.spark.conf.get(STATE_PROVIDER, None)
        self.spark.conf.set(STATE_PROVIDER, ROCKSDB)

    def __exit__(self, *_):
        if self.old is None:
            self.spark.conf.unset(STATE_PROVIDER)
        else:
            self.spark.conf.set(STATE_PROVIDER, self.old)
