"""Structured Streaming forms of the stateful operators.

State is kept per key by Spark (``applyInPandasWithState``), checkpointed with
the stream. Event times come with a watermark, which the batch forms don't
need: rows later than it are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import DataType, StructType

from ..sources.schema import STREAMS


def stream_source(spark: SparkSession, root: str, name: str, *, files_per_trigger: int = 100) -> DataFrame:
    """New lines of a stream's files under ``root``; partial uploads (.part) are not picked up.

    The file source's checkpoint makes ingestion exactly once, and its limit of
    files for each trigger bounds the backlog taken at a time.
    """
    return (
        spark.readStream.schema(STREAMS[name]).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", f"{name}.jsonl").option("recursiveFileLookup", True).json(root)
    ).withColumn("session_id", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def _with(schema: StructType, name: str, kind: DataType | str) -> StructType:
    return StructType([*schema.fields]).add(name, kind)


def rate_gate(rows: DataFrame, by: str, *, t: str = "t", hz: float) -> DataFrame:
    """Rows that a gate of ``hz`` lets through, per key; the due time is the state.

    Within a batch a key's rows are taken in order of time.
    """
    step = 1.0 / max(0.01, hz)

    def gate(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        due = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(t, kind="stable")
        keep = []
        for x in rows[t]:
            fires = due is None or x >= due
            if fires:
                due = x + step if due is None or x - due >= step else due + step
            keep.append(fires)
        state.update((due,))
        yield rows[keep]

    return rows.groupBy(by).applyInPandasWithState(gate, rows.schema, "due double", "append", GroupStateTimeout.NoTimeout)


def throttle(log: DataFrame, by: list[str], *, t: str = "t", event: str = "event", interval: float = 1.0) -> DataFrame:
    """Change log with ``updated`` rows at most once per ``interval`` and key."""

    def fold(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(t, kind="stable")
        keep = []
        for x, kind in zip(rows[t], rows[event], strict=True):
            passes = kind != "updated" or last is None or x - last >= interval
            if passes:
                last = None if kind == "removed" else x
            keep.append(passes)
        if last is None:
            if state.exists:
                state.remove()
        else:
            state.update((last,))
        yield rows[keep]

    return log.groupBy(*by).applyInPandasWithState(fold, log.schema, "last double", "append", GroupStateTimeout.NoTimeout)


def transitions(states: DataFrame, by: str, *, t: str = "t", hot: str = "hot") -> DataFrame:
    """Rows where a key's boolean ``hot`` changes (false before the first)."""

    def fold(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        was = bool(state.get[0]) if state.exists else False
        rows = pd.concat(list(frames)).sort_values(t, kind="stable")
        keep = []
        for now in rows[hot]:
            keep.append(bool(now) != was)
            was = bool(now)
        state.update((was,))
        yield rows[keep]

    return states.groupBy(by).applyInPandasWithState(fold, states.schema, "was boolean", "append", GroupStateTimeout.NoTimeout)


def idle_sessions(rows: DataFrame, by: str, *, ts: str = "ts", quiet: str = "6 seconds", late: str = "30 seconds") -> DataFrame:
    """Activity closed by ``quiet`` without any: start, end, rows; emitted when the watermark passes."""
    marked = rows.withWatermark(ts, late)
    out = marked.groupBy(by, F.session_window(ts, quiet).alias("w")).agg(F.count("*").alias("rows"), F.max(ts).alias("end"))
    return out.select(by, F.col("w.start").alias("start"), "end", "rows")


def upload_progress(done: DataFrame, *, ts: str = "done_at", late: str = "10 minutes") -> DataFrame:
    """Files and bytes acknowledged per session, each file once (idempotent)."""
    once = done.withWatermark(ts, late).dropDuplicatesWithinWatermark(["session_id", "rel"])
    return once.groupBy("session_id").agg(F.count("*").alias("completed"), F.sum("bytes").alias("bytes_sent"))
