"""Filters of session rows, and choices among them.

Nulls: a predicate that can't be told (a null time, tracking state or depth) lets no row
pass; a null session key is a session like any other. Repeated rows are kept each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import WIDTH, numbered, safe_join

PORTRAIT = ("portrait", "portrait (inverted)")


def tracking_normal(rows: DataFrame, *, tracking: str = "tracking", keep_limited: bool = False) -> DataFrame:
    """Rows whose tracking has converged; all of them with ``keep_limited``."""
    return rows if keep_limited else rows.where(F.col(tracking) == "normal")


def after_settled(rows: DataFrame, settled: DataFrame, by: Sequence[str], *, t: str = "t") -> DataFrame:
    """Rows from ``start`` + ``settled`` on; sessions without one of these keep all rows."""
    since = settled.select(*by, (F.col("start") + F.col("settled")).alias("__since"))
    return safe_join(rows, since, by, "left").where(F.col("__since").isNull() | (F.col(t) >= F.col("__since"))).drop("__since")


def by_orientation(rows: DataFrame, shot: DataFrame, by: Sequence[str], *, force: bool = False) -> DataFrame:
    """Rows of sessions not shot in portrait (all with ``force``), with ``rotate`` (upside down) and ``mixed``.

    ``shot`` has each session's dominant orientation and whether others occur; sessions it lacks pass.
    """
    state = shot.select(*by, F.col("dominant").alias("__dominant"), "mixed")
    out = safe_join(rows, state, by, "left")
    out = out.withColumn("rotate", F.coalesce(F.col("__dominant") == "landscape (upside down)", F.lit(False))).withColumn("mixed", F.coalesce("mixed", F.lit(False)))
    return (out if force else out.where(~F.coalesce(F.col("__dominant").isin(*PORTRAIT), F.lit(False)))).drop("__dominant")


def depth_valid(z: Column, low: float = 0.1, high: float = 5.0) -> Column:
    """Finite depth strictly between the bounds."""
    return F.coalesce(~F.isnan(z) & (z > low) & (z < high), F.lit(False))


def confident(z: Column, confidence: Column, least: int = 1) -> Column:
    """Depth, NaN where its confidence was recorded and is under ``least``."""
    return F.when(confidence < least, float("nan")).otherwise(z)


def notable(events: DataFrame, *, kind: str = "kind", parts: Sequence[str] = ("thermal", "ar", "app"), but: Sequence[str] = ("ar.started",)) -> DataFrame:
    """Events whose kind begins with one of ``parts``."""
    return events.where(F.substring_index(kind, ".", 1).isin(*parts) & ~F.col(kind).isin(*but))


def floors(planes: DataFrame, *, classification: str = "classification") -> DataFrame:
    return planes.where(F.col(classification) == "floor")


def strided(rows: DataFrame, by: Sequence[str], order: Sequence[str], *, stride: int = 1, limit: int | None = None, width: float = WIDTH) -> DataFrame:
    """Every ``stride``-th row of a session from the first on, and of these the first ``limit``."""
    out = numbered(rows, by, order, "__i", width=width).where(F.col("__i") % stride == 0)
    return (out if limit is None else out.where(F.col("__i") < stride * limit)).drop("__i")


def capped(rows: DataFrame, by: Sequence[str], key: Sequence[str], *, most: int = 8000, seed: str = "0") -> DataFrame:
    """``most`` rows of each session, the same in every run: those of least hash of ``key`` (ties by key)."""
    place = F.md5(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in key]).cast("binary"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(place, *key))
    return rows.withColumn("__k", rank).where(F.col("__k") <= most).drop("__k")


def lidar_scale(pixels: DataFrame, by: Sequence[str], *, measured: str = "measured", predicted: str = "predicted", confidence: str = "confidence", least: int = 1000, otherwise: float | None = None) -> DataFrame:
    """Least-squares scale of predicted to measured depth over trusted pixels, and their number.

    Pixels count with both depths over 0.05 and a confidence over 0.5; ``otherwise`` stands where
    no more than ``least`` do.
    """
    m, p = F.col(measured), F.col(predicted)
    good = depth_valid(m, 0.05, float("inf")) & (F.col(confidence) > 0.5) & (p > 0.05)
    out = pixels.groupBy(*by).agg(F.sum(F.when(good, p * m)).alias("__pm"), F.sum(F.when(good, p * p)).alias("__pp"), F.count(F.when(good, 1)).alias("pixels"))
    scale = F.when(F.col("pixels") > least, F.col("__pm") / F.greatest(F.col("__pp"), F.lit(1e-9))).otherwise(F.lit(otherwise).cast("double"))
    return out.withColumn("scale", scale).drop("__pm", "__pp")


def usable_sessions(surveyed: DataFrame) -> DataFrame:
    return surveyed.where(F.col("verdict") == "ok")


def newest_first(sessions: DataFrame, session: str = "session") -> DataFrame:
    """Ids begin with their time, so the newest sort last."""
    return sessions.orderBy(F.desc(session))


def card_order(sessions: DataFrame, *, in_scope: Column, cond: str = "cond") -> DataFrame:
    """Sessions in scope first, then by falling conditioning."""
    return sessions.orderBy(F.when(in_scope, 0).otherwise(1), F.desc_nulls_last(cond))


def merged_log(logs: Sequence[DataFrame], by: Sequence[str], t: str = "t") -> DataFrame:
    """Several logs of a session as one, in time order."""
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log, allowMissingColumns=True)
    return out.sort(*by, t)
