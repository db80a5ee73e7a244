"""Lens tables and raster lookups as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def magnification(radius: Column, table: Column, r_max: Column) -> Column:
    """Linear interpolation of a radial table over 0..r_max; beyond it the last entry holds."""
    n = F.size(table)
    x = F.greatest(F.lit(0.0), F.least(radius / r_max, F.lit(1.0))) * (n - 1)
    i = F.least(F.floor(x).cast("int"), n - 2)
    lo, hi = F.get(table, i), F.get(table, i + 1)
    return F.when(n < 2, F.get(table, F.lit(0))).otherwise(lo + (hi - lo) * (x - i))


def source_pixel(u: Column, v: Column, *, out_f: Column, out_cx: Column, out_cy: Column, f: Column, cx: Column, cy: Column, table: Column, r_max: Column) -> Column:
    """Source pixel of a pinhole output pixel (centres at +0.5): struct<x, y, r>."""
    px, py = (u + 0.5 - out_cx) / out_f * f, (v + 0.5 - out_cy) / out_f * f
    r = F.hypot(px, py)
    m = 1 + magnification(r, table, r_max)
    return F.struct((cx + px * m).alias("x"), (cy + py * m).alias("y"), r.alias("r"))


def coverage(mapped: DataFrame, width: int, height: int, *, x: str = "x", y: str = "y") -> DataFrame:
    """Output pixels whose source lies outside the image, and their percentage."""
    out = (F.col(x) < 0) | (F.col(y) < 0) | (F.col(x) > width - 1) | (F.col(y) > height - 1)
    return mapped.agg(F.count("*").alias("pixels"), F.count(F.when(out, 1)).alias("outside"), (100.0 * F.avg(F.when(out, 1.0).otherwise(0.0))).alias("outside_percent"))


def corrected(x: Column, y: Column, *, cx: Column, cy: Column, table: Column, r_max: Column) -> Column:
    """A pixel moved along its radius by a table's magnification: struct<x, y>."""
    dx, dy = x - cx, y - cy
    m = 1 + magnification(F.hypot(dx, dy), table, r_max)
    return F.struct((cx + dx * m).alias("x"), (cy + dy * m).alias("y"))


def correction(pixels: DataFrame, by: list[str], *, cx: Column, cy: Column, inverse: Column, forward: Column, r_max: Column) -> DataFrame:
    """Largest distance that the inverse table moves a pixel (x, y), and what both tables in turn leave of it."""
    far = lambda p: F.hypot(p["x"] - F.col("x"), p["y"] - F.col("y"))
    rows = pixels.withColumn("__there", corrected(F.col("x"), F.col("y"), cx=cx, cy=cy, table=inverse, r_max=r_max))
    there = F.col("__there")
    rows = rows.withColumn("__back", corrected(there["x"], there["y"], cx=cx, cy=cy, table=forward, r_max=r_max))
    return rows.groupBy(*by).agg(F.max(far(there)).alias("displacement"), F.max(far(F.col("__back"))).alias("round_trip"))


def aspect_verdict(fx: Column, fy: Column) -> Column:
    """What the ratio of focal lengths says of the frame."""
    ratio = fx / fy
    return F.when(F.abs(ratio - 1.0) < 0.06, "square pixels").when(F.abs(ratio - 4 / 3) < 0.10, "squeezed from 4:3").otherwise("no common resize")


def weakly_constrained(base: Column, longer: Column, shorter: Column, least: float = 2.0) -> Column:
    """Whether a focal length 10 % off either way costs less than ``least`` times the best score."""
    return F.least(longer, shorter) / F.greatest(base, F.lit(1e-9)) < least


def bilinear(values: Column, width: int, x: Column, y: Column) -> Column:
    """Bilinear sample of a raster held as an array by rows; null outside."""
    i, j = F.floor(x).cast("int"), F.floor(y).cast("int")
    a, b = x - i, y - j
    at = lambda dx, dy: F.get(values, (j + dy) * width + i + dx)
    inside = (i >= 0) & (j >= 0) & (i + 1 < width) & ((j + 1) * width < F.size(values))
    return F.when(inside, (1 - b) * ((1 - a) * at(0, 0) + a * at(1, 0)) + b * ((1 - a) * at(0, 1) + a * at(1, 1)))


def focal_search(pairs: DataFrame, *, width: int, height: int, low: float, high: float, steps: int = 21, rounds: int = 8) -> tuple[float, float, float]:
    """(fx, fy, score): grid search of focal lengths by median Sampson distance, refined ``rounds`` times.

    ``pairs`` has x1, y1, x2, y2 and an essential matrix e. Each round scores a
    grid of ``steps``^2 candidates in one aggregation; only the best comes back.
    """
    from . import geometry as g

    spark = pairs.sparkSession
    box = [low, high, low, high]
    best = (0.0, 0.0, float("inf"))
    for _ in range(rounds):
        xs = [box[0] + (box[1] - box[0]) * k / (steps - 1) for k in range(steps)]
        ys = [box[2] + (box[3] - box[2]) * k / (steps - 1) for k in range(steps)]
        grid = spark.createDataFrame([(x, y) for x in xs for y in ys], "fx double, fy double")
        scored = pairs.crossJoin(F.broadcast(grid))
        d = g.sampson(g.fundamental("e", "fx", "fy", F.lit(width / 2), F.lit(height / 2)), "x1", "y1", "x2", "y2")
        top = scored.groupBy("fx", "fy").agg(F.median(d).alias("m")).orderBy("m", "fx", "fy").first()
        best = min(best, (top.fx, top.fy, top.m), key=lambda b: b[2])
        sx, sy = (box[1] - box[0]) / 8, (box[3] - box[2]) / 8
        box = [best[0] - sx, best[0] + sx, best[1] - sy, best[1] + sy]
    return best
