"""Sessions that close by a timer, with their manifest's verdict, and heartbeats.

State is kept by ``transformWithState``: the files received are a map (a repeated file counts once), the
manifest's number a value, and a session's quiet time a timer on event time. All of it is checkpointed with the
stream, so a restart goes on where it was, and expires ``keep_ms`` after its last change.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: State of this kind needs the state store that keeps more than one value for a key.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUT = "session_id string, kind string, at timestamp, start timestamp, files bigint, expected bigint, verdict string"


def millis(at: pd.Timestamp) -> int:
    return int(at.value // 1_000_000)


def verdict(files: int, expected: int | None) -> str:
    """What a closed session is: complete, INCOMPLETE, or unknown without a usable manifest."""
    return "unknown" if expected is None else "complete" if files >= expected else "INCOMPLETE"


class Closing(StatefulProcessor):
    """Announces a session once it was quiet for ``quiet_ms``, and again each time that more files came after that."""

    def __init__(self, quiet_ms: int, heartbeat_ms: int | None, keep_ms: int | None):
        self.quiet, self.heartbeat, self.keep = quiet_ms, heartbeat_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.files = handle.getMapState("files", "rel string", "n int", self.keep)
        # first and last activity and the next heartbeat (milliseconds), files, expected, whether it is announced
        self.own = handle.getValueState("own", "first bigint, last bigint, beat bigint, files bigint, expected bigint, closed boolean", self.keep)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, last, beat, files, expected, closed = self.own.get() or (None, None, None, 0, None, False)
        before = last
        # A key's rows of a batch go in order of time.
        for rel, ts, number in pd.concat(list(rows))[["rel", "ts", "expected"]].sort_values("ts", kind="stable").itertuples(index=False):
            if pd.notna(number):
                expected = int(number)
            if rel is None or pd.isna(ts):
                continue
            at = millis(ts)
            if last is not None and at - last > self.quiet and not closed:  # the timer can't have come between
                closed, beat = True, None
                yield self._closed(key, last, first, files, expected)
            if not self.files.containsKey((rel,)):
                self.files.updateValue((rel,), (1,))
                files += 1
                closed = False
            first, last = at if first is None else min(first, at), at if last is None else max(last, at)
        if last is not None and (before is None or last > before or not closed):
            if before is not None:
                self.handle.deleteTimer(before + self.quiet + 1)
            self.handle.registerTimer(last + self.quiet + 1)  # more than quiet
            if self.heartbeat and beat is None:
                beat = first + self.heartbeat
                self.handle.registerTimer(beat)
        self.own.update((first, last, beat, files, expected, closed))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        first, last, beat, files, expected, closed = self.own.get() or (None,) * 6
        if first is None:
            return
        if self.heartbeat and at == beat and at <= last + self.quiet:
            beat = at + self.heartbeat
            self.handle.registerTimer(beat)
            yield self._event(key, "heartbeat", at, first, files, expected, None)
        if at == last + self.quiet + 1 and not closed:
            closed, beat = True, None
            yield self._closed(key, last, first, files, expected)
        self.own.update((first, last, beat, files, expected, closed))

    def _closed(self, key, last: int, first: int, files: int, expected: int | None) -> pd.DataFrame:
        return self._event(key, "closed", last + self.quiet + 1, first, files, expected, verdict(files, expected))

    def _event(self, key, kind: str, at: int, first: int, files: int, expected: int | None, said: str | None) -> pd.DataFrame:
        names = [c.split()[0] for c in OUT.split(", ")]
        row = [key[0], kind, pd.Timestamp(at, unit="ms"), pd.Timestamp(first, unit="ms"), files, expected, said]
        return pd.DataFrame([row], columns=names).astype({"expected": "Int64"})

    def close(self) -> None:
        pass


def session_closings(files: DataFrame, manifests: DataFrame | None = None, *, quiet_seconds: float = 6.0, heartbeat_seconds: float | None = None, keep_seconds: float | None = None, late: str = "0 seconds") -> DataFrame:
    """Streams of files (session_id, rel, ts) and manifests (session_id, ts, expected) to events (``OUT``).

    ``closed`` says that a session had no file for more than ``quiet_seconds`` of event time, as a timer or a later file
    shows, with the files received so far against the manifest's number; a new file after that arms it anew. ``heartbeat`` comes each
    ``heartbeat_seconds`` from its first file until it closes. Rows without a session are left out; a manifest alone closes nothing.
    """
    spark: SparkSession = files.sparkSession
    spark.conf.set(*STORE)
    rows = files.select("session_id", "rel", "ts", F.lit(None).cast("bigint").alias("expected"))
    if manifests is not None:
        rows = rows.unionByName(manifests.select("session_id", F.lit(None).cast("string").alias("rel"), "ts", F.col("expected").cast("bigint").alias("expected")))
    rows = rows.where("session_id is not null").withWatermark("ts", late)
    ms = lambda s: None if s is None else int(s * 1000)
    return rows.groupBy("session_id").transformWithStateInPandas(Closing(ms(quiet_seconds), ms(heartbeat_seconds), ms(keep_seconds)), OUT, "append", "eventTime")
