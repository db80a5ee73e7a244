"""Change logs and state machines over ordered events."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import WIDTH, keys_of, numbered, previous, running, runs, safe_join


def compact(log: DataFrame, by: Sequence[str], *, key: str, order: Sequence[str], event: str = "event", removed: str = "removed") -> DataFrame:
    """Last row of each key in file order, unless it removes the key. A key added again lives again.

    An aggregation, not a window: partial maxima are combined before the shuffle.
    """
    rest = [c for c in log.columns if c not in (*by, key)]
    last = log.groupBy(*by, key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last"))
    return last.where(F.col(f"__last.{event}") != removed).select(*by, key, "__last.*")


def throttle(log: DataFrame, by: Sequence[str], *, t: str = "t", order: Sequence[str] = (), event: str = "event", interval: float = 1.0, width: float = WIDTH) -> DataFrame:
    """Keeps an ``updated`` row at most once per ``interval`` and key; others always pass.

    The time of the last row let through is forgotten when a key is removed.
    The fold streams through each key's rows in order; a key is cut where it pauses for the
    interval, which every row after passes. A null key is a key; of rows without a time, all but updates pass.
    """
    timed = F.col(t).isNotNull() & ~F.isnan(F.col(t).cast("double"))
    rows, apart = runs(log.where(timed), by, [t, *order], interval, width=width)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for batch in batches:
            names, keep = batch.schema.names, []
            times, kinds = (batch.column(names.index(c)).to_pylist() for c in (t, event))
            for key, x, kind in zip(keys_of(batch, apart), times, kinds, strict=True):
                if key != now:
                    now, last = key, None
                passes = kind != "updated" or last is None or x - last >= interval
                if passes:
                    last = None if kind == "removed" else x
                keep.append(passes)
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns[:-1], names=names[:-1])

    untimed = log.where(~timed & ~F.col(event).eqNullSafe(F.lit("updated")))
    return rows.mapInArrow(task, log.schema).unionByName(untimed)


def transitions(states: DataFrame, by: Sequence[str], *, t: str = "t", order: Sequence[str] = (), hot: Column, initially: bool = False, width: float = WIDTH) -> DataFrame:
    """Rows where a two-state machine enters (``throttled`` true) or leaves its hot state."""
    rows = previous(states.withColumn("throttled", hot), by, [t, *order], {"__was": "throttled"}, width=width)
    return rows.where(F.col("throttled") != F.coalesce("__was", F.lit(initially))).drop("__was")


def idle_sessions(events: DataFrame, by: Sequence[str], *, t: str = "t", order: Sequence[str] = (), quiet: float = 6.0, width: float = WIDTH) -> DataFrame:
    """Sessions of activity, each closed by more than ``quiet`` without any: start, end, rows."""
    rows = previous(events, by, [t, *order], {"__before": t}, width=width)
    fresh = F.col("__before").isNull() | (F.col(t) - F.col("__before") > quiet)
    rows = running(rows, by, [t, *order], {"session": F.when(fresh, 1).otherwise(0)}, width=width)
    return rows.groupBy(*by, "session").agg(F.min(t).alias("start"), F.max(t).alias("end"), F.count("*").alias("rows"))


def idle_verdict(sessions: DataFrame, expected: DataFrame, by: Sequence[str]) -> DataFrame:
    """Closed sessions (rows: files received) with their manifest's number of files: complete, INCOMPLETE or unknown."""
    out = safe_join(sessions, expected.select(*by, "expected"), by, "left")
    return out.withColumn("verdict", F.when(F.col("expected").isNull(), "unknown").when(F.col("rows") >= F.col("expected"), "complete").otherwise("INCOMPLETE"))


def ticks(rows: DataFrame, by: Sequence[str], *, elapsed: str = "elapsed", free: str = "free", least: int, every: int = 60) -> DataFrame:
    """A recording's ticks up to its stop: ``stop`` marks the first without ``least`` bytes free, ``heartbeat`` those of each minute before it."""
    ends = rows.where(F.col(free) < least).groupBy(*by).agg(F.min(elapsed).alias("__end"))
    out = safe_join(rows, ends, by, "left").where(F.col("__end").isNull() | (F.col(elapsed) <= F.col("__end")))
    stop = F.coalesce(F.col(elapsed) == F.col("__end"), F.lit(False))
    return out.withColumns({"stop": stop, "heartbeat": ~stop & (F.floor(elapsed) % every == 0)}).drop("__end")


def latest(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key: the last in order (a dictionary filled in file order)."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last")).select(*key, "__last.*")


def thinned(df: DataFrame, by: Sequence[str], order: Sequence[str], *, every: int = 6, keep: int = 900, width: float = WIDTH) -> DataFrame:
    """Rows 6, 12, 18, ... of a track, and of those the last ``keep``."""
    rows = numbered(df, by, order, "__i", width=width).withColumn("__i", F.col("__i") + 1)
    counts = rows.groupBy(*by).agg(F.floor(F.count("*") / F.lit(every)).alias("__n"))
    rows = safe_join(rows.where(F.col("__i") % every == 0), counts, by)
    return rows.where(F.col("__i") / every > F.col("__n") - keep).drop("__i", "__n")
